"""graphloom: an RDFS reasoning and data-processing engine on PySpark DataFrames."""

__version__ = "0.1.0"
