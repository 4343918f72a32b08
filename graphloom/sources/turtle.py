"""Turtle: a parser after the W3C grammar, a reader by whole files, and a data source.

A Turtle file cannot be split, so a file is one unit of work; for bulk data use
N-Triples or Parquet.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphloom.functions.terms import TRIPLE, escape
from graphloom.functions.vocab import RDF, XSD

_NAME = r"[A-Za-z0-9_·À-ÖØ-öø-ͽͿ-῿‌-‍‿-⁀⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�\U00010000-\U000EFFFF]"
_TOKEN = re.compile(
    rf"""
    (?P<skip>\s+|\#[^\n\r]*)
  | (?P<iri><(?:[^\x00-\x20<>"{{}}|^`\\]|\\u[0-9A-Fa-f]{{4}}|\\U[0-9A-Fa-f]{{8}})*>)
  | (?P<long>\"\"\"(?:(?:\"|\"\")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
  | (?P<short>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
  | (?P<blank>_:{_NAME}(?:(?:{_NAME}|[.-])*(?:{_NAME}|-))?)
  | (?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<number>[+-]?(?:[0-9]+\.[0-9]*[eE][+-]?[0-9]+|\.?[0-9]+[eE][+-]?[0-9]+|[0-9]*\.[0-9]+|[0-9]+))(?!{_NAME}|:)
  | (?P<qname>(?:{_NAME}(?:(?:{_NAME}|[.-])*(?:{_NAME}|-))?)?:(?:(?:{_NAME}|:|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:{_NAME}|[.:-]|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:{_NAME}|[:-]|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
  | (?P<word>[A-Za-z]+)
  | (?P<sign>\^\^|[.;,()\[\]])
    """,
    re.X | re.S,
)
#: Triples that leave the reader at once, so that a large file's triples are never all in memory.
BATCH = 20_000
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
#: What a backslash and a letter stand for.
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\", ">": ">"}


class TurtleError(ValueError):
    """The text is not Turtle."""


def _unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        if len(x) > 1:
            return chr(int(x[1:], 16))
        if x not in ESCAPES:
            raise TurtleError(f"unknown escape \\{x}")
        return ESCAPES[x]

    return _ESCAPE.sub(one, text) if "\\" in text else text


class Parser:
    """Triples of one text. Blank labels are made unique by ``scope``; generated ones have a reserved form."""

    def __init__(self, text: str, scope: str = "", base: str = "", permissive: bool = False):
        self.text, self.scope, self.base, self.permissive = text, scope, base, permissive
        self.at, self.made, self.prefixes, self.errors = 0, 0, {}, []
        self.kind, self.value = "", ""
        self.out: list[tuple[str, str, str]] = []

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        while True:
            self.out = []
            try:
                self._next()
                if self.kind == "end":
                    return
                self._statement()
            except TurtleError as e:
                if not self.permissive:
                    raise
                self.errors.append(str(e))
                self._recover()
                continue
            yield from self.out

    def _fail(self, what: str) -> TurtleError:
        return TurtleError(f"line {self.text.count(chr(10), 0, self.at) + 1}: {what}, found {self.value!r}")

    def _next(self) -> None:
        while True:
            if self.at >= len(self.text):
                self.kind = self.value = "end"
                return
            m = _TOKEN.match(self.text, self.at)
            if not m:
                self.value = self.text[self.at]
                raise self._fail("unreadable")
            self.at = m.end()
            self.kind, self.value = m.lastgroup, m[m.lastgroup]
            if self.kind != "skip":
                return

    def _recover(self) -> None:
        """To the end of the statement: a dot that white space or the end follows, outside strings and comments."""
        while self.at < len(self.text):
            if self.kind == "sign" and self.value == ".":
                return
            try:
                self._next()
            except TurtleError:
                self.at += 1
                self.kind = ""

    def _sign(self, which: str) -> bool:
        return self.kind == "sign" and self.value == which

    def _expect(self, which: str) -> None:
        if not self._sign(which):
            raise self._fail(f"{which} expected")

    def _resolved(self, raw: str) -> str:
        ref = _unescaped(raw)
        if not self.base or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", ref):
            return ref
        # urljoin leaves out an empty fragment, which prefixes often end with
        return urljoin(self.base, ref) + ("#" if ref.endswith("#") else "")

    def _statement(self) -> None:
        word = self.value.lower()
        if self.kind == "at" and word in ("@prefix", "@base") or self.kind == "word" and word in ("prefix", "base"):
            dotted = self.kind == "at"
            if word.endswith("prefix"):
                self._next()
                if self.kind != "qname" or not self.value.endswith(":"):
                    raise self._fail("a prefix expected")
                prefix = self.value[:-1]
                self._next()
                if self.kind != "iri":
                    raise self._fail("an IRI expected")
                self.prefixes[prefix] = self._resolved(self.value[1:-1])
            else:
                self._next()
                if self.kind != "iri":
                    raise self._fail("an IRI expected")
                self.base = self._resolved(self.value[1:-1])
            if dotted:
                self._next()
                self._expect(".")
            return
        anonymous = self._sign("[")
        subject = self._node(False)
        self._next()
        if not (anonymous and self._sign(".")):
            self._predicates(subject)
        self._expect(".")

    def _predicates(self, subject: str) -> None:
        while True:
            if self._sign(";"):
                self._next()
                continue
            if self._sign(".") or self._sign("]"):
                return
            if self.kind == "word" and self.value == "a":
                predicate = f"<{RDF}type>"
            elif self.kind in ("iri", "qname"):
                predicate = self._name()
            else:
                raise self._fail("a predicate expected")
            while True:
                self._next()
                self.out.append((subject, predicate, self._node(True)))
                self._next()
                if not self._sign(","):
                    break
            if not (self._sign(";") or self._sign(".") or self._sign("]")):
                raise self._fail("; , or . expected")

    def _name(self) -> str:
        if self.kind == "iri":
            return f"<{self._resolved(self.value[1:-1])}>"
        prefix, _, local = self.value.partition(":")
        if prefix not in self.prefixes:
            raise self._fail(f"unknown prefix {prefix}:")
        return f"<{self.prefixes[prefix]}{re.sub(r'\\(.)', r'\1', local)}>"

    def _fresh(self) -> str:
        self.made += 1
        return f"_:{self.scope}-{self.made}"

    def _node(self, literals: bool) -> str:
        if self.kind in ("iri", "qname"):
            return self._name()
        if self.kind == "word" and self.value == "a":
            return f"<{RDF}type>"
        if self.kind == "blank":
            return f"_:{self.scope}{self.value[2:]}"
        if self._sign("["):
            node = self._fresh()
            self._next()
            self._predicates(node)
            self._expect("]")
            return node
        if self._sign("("):
            items = []
            self._next()
            while not self._sign(")"):
                items.append(self._node(True))
                self._next()
            names = [self._fresh() for _ in items] + [f"<{RDF}nil>"]
            for k, item in enumerate(items):
                self.out += [(names[k], f"<{RDF}first>", item), (names[k], f"<{RDF}rest>", names[k + 1])]
            return names[0]
        if literals and self.kind in ("long", "short", "number") or literals and self.kind == "word" and self.value in ("true", "false"):
            return self._literal()
        raise self._fail("a node expected")

    def _literal(self) -> str:
        if self.kind == "number":
            kind = "double" if "e" in self.value.lower() else "decimal" if "." in self.value else "integer"
            return f'"{self.value}"^^<{XSD}{kind}>'
        if self.kind == "word":
            return f'"{self.value}"^^<{XSD}boolean>'
        n = 3 if self.kind == "long" else 1
        text = f'"{escape(_unescaped(self.value[n:-n]))}"'
        here = self.at, self.kind, self.value
        try:
            self._next()
        except TurtleError:
            self.at, self.kind, self.value = here
            return text
        if self.kind == "at" and self.value.lower() not in ("@prefix", "@base"):
            return text + self.value
        if self._sign("^^"):
            self._next()
            if self.kind not in ("iri", "qname"):
                raise self._fail("a data type expected")
            return f"{text}^^{self._name()}"
        self.at, self.kind, self.value = here
        return text


def scope_of(path: str) -> str:
    """What makes blank labels of one file differ from those of others."""
    return f"f{hashlib.sha1(path.encode()).hexdigest()[:12]}"


def read_turtle(spark: SparkSession, path, mode: str = "FAILFAST") -> DataFrame:
    """(s, p, o) from Turtle files, through Spark's own file access, a file in one task.

    PERMISSIVE leaves out statements that cannot be read; FAILFAST raises an error.
    """
    if mode not in ("PERMISSIVE", "FAILFAST"):
        raise ValueError(f"mode {mode!r}: PERMISSIVE or FAILFAST")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, file in zip(batch["value"], batch["file"], strict=True):
                rows = iter(Parser(text, scope_of(file), permissive=mode == "PERMISSIVE"))
                while part := list(islice(rows, BATCH)):
                    yield pd.DataFrame(part, columns=["s", "p", "o"])

    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return files.mapInPandas(parse, TRIPLE)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        import glob
        import os

        out = []
        for p in self.options.get("path", "").split(","):
            p = p.removeprefix("file://")
            out += sorted(glob.glob(os.path.join(p, "*.ttl")) if os.path.isdir(p) else glob.glob(p))
        if not out:
            raise FileNotFoundError(self.options.get("path", ""))
        return [_File(p) for p in out]

    def read(self, partition):
        with open(partition.path, encoding="utf-8") as f:
            yield from Parser(f.read(), scope_of(partition.path), permissive=self.options.get("mode", "FAILFAST").upper() == "PERMISSIVE")


class TurtleSource(DataSource):
    """spark.read.format("turtle") for files that every executor can open; ``read_turtle`` reads any store."""

    @classmethod
    def name(cls) -> str:
        return "turtle"

    def schema(self) -> str:
        return TRIPLE

    def reader(self, schema):
        return _Reader(self.options)
