"""The corpus pipeline, stage by stage."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from . import brute  # noqa: E402
from .test_operators import PASSAGE, edited, prose  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    r = random.Random(4)
    rows = [(k, " ".join(w.upper() + "!!" for w in prose(30, 1000 + k).split()) if k % 4 == 0 else prose(r.randint(40, 120), 1000 + k)) for k in range(160)]
    rows += [(200 + k, edited(rows[1][1], k % 2, k)) for k in range(4)] + [(300, prose(30, 300) + " " + PASSAGE), (301, prose(40, 301) + " call +1 (743) 555-3824 or a.b@c.de")]
    rows += [(1, rows[1][1]), (302, None), (303, ""), (None, rows[2][1]), (2**53 + 1, rows[5][1] + " tail")]
    spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        steps[name] = [r.asDict() for r in out.collect()]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == COLUMNS
            docs = spark.createDataFrame(out.collect(), out.schema)
    first, near, clean, private, packed = steps.values()
    kept = {r["doc_id"] for r in first}
    junk = {k for k in range(160) if k % 4 == 0}
    assert len(kept & junk) <= 2 and len({k for k in range(160)} - junk - kept) <= 2
    groups = brute.jaccard([(r["doc_id"], r["text"]) for r in first], 5, 80)
    assert len(near) == len({c for _, n, c in groups if n}) + sum(n == 0 for _, n, _ in groups)
    assert sum(r["doc_id"] in (1, 200, 201, 202, 203) for r in near) == 1
    leaked = {r["doc_id"] for r in near if brute.contamination(r["text"], [(1, PASSAGE)])[4]}
    assert leaked == {300} and {r["doc_id"] for r in clean} == {r["doc_id"] for r in near} - leaked
    assert len(private) == len(clean)
    text = next(r for r in private if r["doc_id"] == 301)
    assert "[PHONE]" in text["text"] and "[EMAIL]" in text["text"] and text["n_chars"] == len(text["text"])
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in private}


def test_stages_on_empty_tables_and_clashing_columns(spark, folder, tmp_path):
    """Stages take no rows, no benchmark and no labels, and keep columns whose names they use inside."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    clash = docs.limit(30).selectExpr("*", "1 AS _key", "2 AS k", "3 AS _redacted_", "4 AS _changed")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        out = stage(spark, clash, str(tmp_path))
        assert out.columns == clash.columns and out.agg({"_key": "max", "k": "max", "_changed": "max"}).count() == 1, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_stages_free_what_the_last_one_left(spark, folder, monkeypatch):
    """Every stage begins by letting the executors collect, before it reads anything."""
    from graphloom.llm import common

    def collections():
        return sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())

    before = collections()
    common.free_executors(spark)
    assert collections() > before  # a local session's executor is the driver's JVM

    class Freed(Exception):
        pass

    def freed(_):
        raise Freed

    monkeypatch.setattr(corpus_pipeline, "free_executors", freed)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Freed):
            stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
