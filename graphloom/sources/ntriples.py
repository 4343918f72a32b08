"""N-Triples: a splittable text source, and a sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.terms import is_blank

_IRI, _BLANK = r"<[^\x00-\x20<>\"{}|^`\\]*(?:\\[uU][0-9A-Fa-f]+[^\x00-\x20<>\"{}|^`\\]*)*>", r"_:[^\s<>\"]+"
_LITERAL = r'"(?:[^"\\\n\r]|\\.)*"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^' + _IRI + ")?"
LINE = rf"^\s*({_IRI}|{_BLANK})\s*({_IRI}|{_BLANK})\s*({_IRI}|{_BLANK}|{_LITERAL})\s*\.\s*(?:#.*)?$"


def read_ntriples(spark: SparkSession, path, mode: str = "PERMISSIVE") -> DataFrame:
    """(s, p, o) from N-Triples files. Blank and comment lines are skipped; others that are
    no triple are left out (PERMISSIVE) or raise an error (FAILFAST)."""
    if mode not in ("PERMISSIVE", "FAILFAST"):
        raise ValueError(f"mode {mode!r}: PERMISSIVE or FAILFAST")
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|$)"))
    hit = F.col("value").rlike(LINE)
    if mode == "FAILFAST":
        value = F.when(hit, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a triple: "), F.col("value"))))
        lines = lines.select(value.alias("value"))
    else:
        lines = lines.filter(hit)
    return lines.select(*[F.regexp_extract("value", LINE, k).alias(c) for k, c in ((1, "s"), (2, "p"), (3, "o"))])


def line(s="s", p="p", o="o") -> Column:
    return F.concat(F.col(s), F.lit(" "), F.col(p), F.lit(" "), F.col(o), F.lit(" ."))


def to_lines(df: DataFrame) -> DataFrame:
    """One column ``line``; triples with a blank predicate are not written."""
    return df.filter(~is_blank("p")).select(line().alias("line"))


def write_ntriples(df: DataFrame, path: str, entailed_only: bool = False, mode: str = "errorifexists") -> None:
    if entailed_only:
        df = df.filter("entailed")
    to_lines(df).write.mode(mode).text(path)
