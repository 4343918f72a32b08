"""Command line: read triples, print or write what they entail, report counts and times."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from graphloom.sources.ntriples import read_ntriples, to_lines, write_ntriples
from graphloom.sources.turtle import read_turtle

from .reasoner import Reasoner, ReasonerError


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description="Materialise the RDFS entailments of RDF triples with Spark.")
    p.add_argument("-i", "--input-file", required=True, nargs="+", help="Turtle (.ttl), N-Triples (.nt) or Parquet (columns s, p, o) files")
    p.add_argument("-r", "--rules", choices=("rhodf", "rdfs"), default="rhodf", help="rule set")
    p.add_argument("-a", "--axioms", action="store_true", help="add the axiomatic triples")
    p.add_argument("-m", "--mode", choices=("phased", "complete"), default="phased", help="one run of the rules in order, or until nothing new follows")
    p.add_argument("--vocab", choices=("compat", "w3c"), default="compat", help="namespaces of Property and Datatype")
    p.add_argument("--identity", choices=("rdf", "lexical"), default="rdf", help="what makes two terms one")
    p.add_argument("--on-cycle", choices=("close", "error"), default="close", help="what a cyclic hierarchy does")
    p.add_argument("-l", "--local-dedup", action="store_true", help="make each rule's output distinct before all are merged")
    p.add_argument("-g", "--no-global-dedup", action="store_true", help="leave repeated derivations in the output")
    p.add_argument("--permissive", action="store_true", help="leave out statements that cannot be read")
    p.add_argument("-p", "--print-triples", action="store_true", help="print entailed triples as N-Triples")
    p.add_argument("--print-all", action="store_true", help="print asserted triples too")
    p.add_argument("-o", "--output", help="write the triples there instead: Parquet, or N-Triples if it ends in .nt")
    p.add_argument("-t", "--time", action="store_true", help="report seconds by phase")
    p.add_argument("--master", help="Spark master, if the environment sets none")
    return p


def _read(spark: SparkSession, paths: list[str], mode: str):
    readers = {"ttl": read_turtle, "nt": read_ntriples}
    frames = []
    for path in paths:
        kind = path.rstrip("/").rpartition(".")[2]
        frames.append(readers[kind](spark, path, mode) if kind in readers else spark.read.parquet(path).select("s", "p", "o"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def main(args: list[str] | None = None) -> int:
    """0 on success, 1 on a bad option, an unreadable input or an error of the closure."""
    try:
        o = options().parse_args(args)
    except SystemExit as e:
        return 1 if e.code else 0
    builder = SparkSession.builder.appName("graphloom")
    spark = (builder.master(o.master) if o.master else builder).getOrCreate()
    times, began = {}, time.perf_counter()
    try:
        given = _read(spark, o.input_file, "PERMISSIVE" if o.permissive else "FAILFAST").persist()
        given.count()
        times["reading"] = time.perf_counter() - began
        began = time.perf_counter()
        reasoner = Reasoner(spark, o.rules, o.axioms, o.vocab, o.identity, o.mode, o.on_cycle, o.local_dedup, not o.no_global_dedup)
        every = reasoner.closure(given).persist()
        counts = reasoner.stats().first()
        times["closure"] = time.perf_counter() - began
        began = time.perf_counter()
        shown = every if o.print_all else every.filter("entailed")
        if o.output and o.output.endswith(".nt"):
            write_ntriples(shown, o.output, mode="overwrite")
        elif o.output:
            shown.write.mode("overwrite").parquet(o.output)
        elif o.print_triples or o.print_all:
            for row in to_lines(shown).toLocalIterator():
                print(row["line"])
        times["output"] = time.perf_counter() - began
    except ReasonerError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except Exception as e:  # Spark's errors for paths and texts that cannot be read
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 1
    print(f"asserted triples: {counts['asserted']}\ninferred triples: {counts['inferred_unique']}\ninferred duplicates: {counts['inferred_duplicates']}", file=sys.stderr)
    if o.time:
        for k, v in {**times, **reasoner.timings()}.items():
            print(f"{k}: {v:.3f} s", file=sys.stderr)
    return 0
