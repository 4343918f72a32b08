"""Terms as canonical N-Triples strings; the first character tells the kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The only record shape: subject, predicate, object.
TRIPLE = "s string, p string, o string"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_literal(c: Column | str) -> Column:
    return col(c).startswith('"')


def is_blank(c: Column | str) -> Column:
    return col(c).startswith("_:")


def is_iri(c: Column | str) -> Column:
    return col(c).startswith("<")


def lexical(c: Column | str) -> Column:
    """The text of a term without its kind, data type or language."""
    c = col(c)
    return (
        F.when(is_iri(c), F.substring(c, 2, F.length(c) - 2))
        .when(is_literal(c), F.regexp_extract(c, r'^"((?:[^"\\]|\\.)*)"', 1))
        .otherwise(c)
    )


def plain_literal(c: Column | str) -> Column:
    """A literal without its data type or language; other terms unchanged."""
    c = col(c)
    return F.when(is_literal(c), F.concat(F.lit('"'), lexical(c), F.lit('"'))).otherwise(c)


def escape(text: str) -> str:
    """Text as it stands between the quotes of an N-Triples literal."""
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")


def iri(text: str) -> str:
    return f"<{text}>"
