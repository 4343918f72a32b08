"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from . import brute

rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def edited(text, k, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(k):
        w[r.randrange(len(w))] = "zz"
    return " ".join(w)


A, B, PASSAGE = prose(400, 1), prose(260, 2), prose(70, 3)
TEXTS = [
    (1, A),
    (2, B),
    (3, A),
    (3, A),  # a repeated row
    (4, edited(A, 2, 1)),
    (5, edited(A, 6, 2)),
    (6, None),
    (7, ""),
    (8, " \n\t "),
    (9, "one"),
    (10, "ONE"),
    (11, prose(30, 4) + "\n" + PASSAGE + " " + prose(40, 5)),
    (12, prose(90, 6) + " " + PASSAGE),
    (13, PASSAGE + " " + PASSAGE),
    (14, "spam " * 150),
    (15, "x " + "spam " * 120),
    (16, B.upper()),
    (None, A),
    (17, prose(6000, 7)),  # long
    (2**53 + 1, "é€😀 " * 80),  # ids beyond what a float holds, beside a null one
    (2**53 + 3, edited(B, 1, 3)),
    (2**53 + 5, B + " " + "tail"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "id", len(t or ""), 0.5, "x") for i, t in TEXTS]
    # columns whose names the operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, id string, n_chars long, score double, h string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def key(x):
    return tuple((v is not None, v) if not isinstance(v, bool) else (True, v) for v in x)


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=key)


def test_substring_dedup(docs, none):
    from graphloom.llm.substring_dedup import dedup_substrings

    cols = ("doc_id", "n_words", "n_removed", "kept_sha256")
    got = dedup_substrings(docs)
    assert rows_of(got, *cols) == sorted(brute.substrings(TEXTS, 50), key=key)
    kept = {r["doc_id"]: r["kept_text"] for r in got.collect()}
    assert kept[12] == prose(90, 6) and kept[1] is None
    assert dedup_substrings(none).count() == 0


@pytest.mark.parametrize("group", [4096, 1])
def test_suffix_dedup(docs, none, monkeypatch, group):
    from graphloom.llm import repeats, suffix_dedup

    monkeypatch.setattr(repeats, "GROUP", group)  # with 1 every symbol is split, up to single windows
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows_of(suffix_dedup.dedup_suffixes(docs), *cols) == sorted(brute.suffixes(TEXTS, 200), key=key)
    if group > 1:
        assert suffix_dedup.dedup_suffixes(none).count() == 0
    some = [(i, t) for i, t in TEXTS if i is not None and (i, t) != (3, A)]
    first = suffix_dedup.dedup_suffixes(docs.dropna(subset=["doc_id"]).filter("doc_id <> 3"), keep="first")
    assert rows_of(first, *cols) == sorted(brute.suffixes(some, 200, "first"), key=key)


def test_substring_dedup_splits(docs, monkeypatch):
    from graphloom.llm import repeats, substring_dedup

    monkeypatch.setattr(repeats, "GROUP", 1)
    got = substring_dedup.dedup_substrings(docs)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substrings(TEXTS, 50), key=key)


def test_a_group_above_the_limit(spark, monkeypatch):
    """More contexts of one gram than a suffix array takes: a shared passage with other bytes around it in each text."""
    from graphloom.llm import repeats, suffix_dedup

    monkeypatch.setattr(repeats, "GROUP", 16)
    passage = prose(60, 900)
    rows = [(k, prose(20, 910 + k) + " " + passage + " " + prose(20, 990 + k % 7)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows_of(suffix_dedup.dedup_suffixes(df), *cols) == sorted(brute.suffixes(rows, 200), key=key)


def test_factors():
    from graphloom.llm.repeats import factors

    r = random.Random(1)
    for width in (1, 3, 5, 8, 16, 21):
        contents = [np.array([r.choice((1, 2)) for _ in range(r.randint(0, 60))], np.int64) for _ in range(6)]
        of, start, lpf, source, later = factors(contents, width)
        seen = [tuple(contents[a][b : b + width]) for a, b in zip(of, start, strict=True)]
        common = lambda x, y: next((k for k in range(width) if x[k] != y[k]), width)
        assert list(lpf) == [max((common(x, y) for y in seen[:k]), default=0) for k, x in enumerate(seen)]
        assert list(later) == [x in seen[k + 1 :] for k, x in enumerate(seen)]
        assert all(s < k and common(seen[k], seen[s]) == lpf[k] for k, s in enumerate(source) if s >= 0)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join(docs, none, n, percent):
    from graphloom.llm.jaccard_join import jaccard_components

    got = rows_of(jaccard_components(docs, n=n, percent=percent), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.jaccard(TEXTS, n, percent), key=key)
    if n == 5:
        assert jaccard_components(none).count() == 0


@pytest.mark.parametrize("block", [256, 4])
def test_jaccard_near_the_threshold(spark, monkeypatch, block):
    from graphloom.llm import jaccard_join
    from graphloom.llm.jaccard_join import jaccard_components

    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    base = prose(120, 9)
    rows = [(k, edited(base, k % 9, 100 + k)) for k in range(60)] + [(100 + k, prose(20, 50 + k) + " " + base) for k in range(6)]
    rows += [(200 + k, edited(prose(200, 10), k % 14, 300 + k)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(jaccard_components(df, n=4, percent=85), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(rows, 4, 85), key=key)


def test_jaccard_buckets_in_parts(spark):
    """Buckets that give entries out early, and shingles too common for a bucket, lose nothing."""
    import pyarrow as pa

    from graphloom.llm import jaccard_join as J

    r = random.Random(12)
    sets = [np.unique(np.array([(r.randrange(40) * 0x9E3779B97F4A7C15 + 1) % 2**64 for _ in range(12)], np.uint64)) for _ in range(30)]
    flushes, bits = [sets[:10], sets[10:20], sets[20:]], 4
    rows = []
    for f, part in enumerate(flushes):
        tok, of = np.concatenate(part), np.repeat(np.arange(len(part)), [len(s) for s in part])
        for b in range(16):
            at = (tok >> np.uint64(60)).astype(int) == b
            if at.any():
                rows.append((b, list(range(10 * f, 10 * f + len(part))), [len(s) for s in part], np.bincount(of[at], minlength=len(part)).tolist(), J._packed(tok[at], bits)))
    rows.sort(key=lambda x: x[0])
    cols = list(zip(*rows, strict=True))
    batch = pa.RecordBatch.from_pydict({"id": pa.nulls(len(rows), pa.int64()), "bucket": pa.array(cols[0], pa.int64()), "n": pa.array([0] * len(rows), pa.int64()), "sig": pa.array([0] * len(rows), pa.int64()), "docs": pa.array(cols[1], pa.list_(pa.int64())), "sizes": pa.array(cols[2], pa.list_(pa.int32())), "many": pa.array(cols[3], pa.list_(pa.int32())), "tok": pa.array(cols[4], pa.binary())})
    seen = {}
    for k, s in enumerate(sets):
        for t in s.tolist():
            seen.setdefault(t >> 12 << 12, set()).add(k)
    want = {(t, k) for t, ks in seen.items() if len(ks) > 1 for k in ks}
    for held in (1 << 20, 8):
        J.HELD = held
        got = set()
        for _, _, c in J._shared(bits)(iter([batch])):
            got |= {(t % 2**64, k) for ts, k in zip(c["toks"].to_pylist(), c["c"].to_pylist(), strict=True) for t in ts}
        assert got == want
    J.HELD = 4 << 20


def test_string_ids(spark):
    from graphloom.llm.jaccard_join import jaccard_components

    rows = [("b", A), ("a", A), (None, A), ("c", "x y")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert rows_of(jaccard_components(df), "doc_id", "component_id") == [(None, "a"), ("a", "a"), ("b", "a"), ("c", "c")]


def test_components(spark):
    from graphloom.llm.common import Scratch
    from graphloom.llm.graph import components

    chain = [(k, k + 1) for k in range(40) if k != 20] + [(100, 101), (101, 100), (7, 7)]
    got = {r["v"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {**{k: 0 for k in range(21)}, **{k: 21 for k in range(21, 41)}, 100: 100, 101: 100}


def test_decontamination(spark, docs, none):
    from graphloom.llm.decontaminate import find_contamination

    items = [(1, " ".join(PASSAGE.split()[5:40]).upper()), (2, "one"), (3, None), (4, "..."), (5, prose(15, 77)), (6, PASSAGE), (6, B[:200]), (None, "spam spam"), (10, "spam " * 12)]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = [(i, *brute.contamination(t, items)) for i, t in TEXTS]
    assert rows_of(find_contamination(docs, bench), *cols) == sorted(want, key=key)
    assert find_contamination(none, bench).count() == 0
    clean = find_contamination(docs, bench.limit(0)).agg(F.count(F.lit(1)), F.sum("n_hit")).first()
    assert tuple(clean) == (len(TEXTS), 0)


def test_license_scan(spark):
    from graphloom.llm.license_scan import BASE, scan_licenses

    texts = [
        (1, "Released under the MIT License. x under the mit LICENSE"),
        (2, "Apache License, Version 2.0; Licensed under CC BY-NC 4.0."),
        (3, None),
        (4, ""),
        (5, "...!"),
        (6, "under the mit licenseé the mit license"),
        (7, "This work is licensed under the GNU General Public License, version 3."),
        (8, "cc by nc " * 500),
        (8, "cc by nc " * 500),
        (None, "under\x00the-mit/license"),
        (9, "\u212aelvin under the m\u0130t license"),
        (10, "gnu lesser general public license"),
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, n_words int")
    got = scan_licenses(df)
    cols = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert rows_of(got, *cols) == sorted([(i, *brute.licenses(t, BASE)) for i, t in texts], key=key)
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in got.collect()}
    assert labels[7] == ("gpl-3", 1.0) and labels[10][0] == "lgpl" and labels[1] == ("mit", 1.0) and labels[3] == ("", 0.0)
    assert scan_licenses(df.limit(0)).count() == 0
    # whole notices, with words changed outside the key phrase, and a notice whose key phrase is broken
    from graphloom.llm.license_scan import TEMPLATES

    notices = []
    for k, (label, words, must) in enumerate(TEMPLATES):
        changed = words.replace("software", "program") if "software" not in must else words
        notices += [(3 * k, label, prose(5, k) + " " + changed.title() + ". " + prose(5, k)), (3 * k + 1, "", must.replace(must.split()[1], "x")), (3 * k + 2, label, must if must == words else words[words.index(must) :])]
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame([(i, t) for i, _, t in notices], "doc_id long, text string")).collect()}
    for i, label, text in notices:
        if i % 3 == 0 or not label:
            assert label in got[i]["labels"].split(","), (text, got[i])
    # a megabyte of one phrase is read in linear time
    long = spark.createDataFrame([(1, "cc by nc " * 110_000), (2, (TEMPLATES[1][2] + " ") * 12_000)], "doc_id long, text string")
    began = time.time()
    assert {r["doc_id"]: (r["n_words"], r["n_base"]) for r in scan_licenses(long).collect()} == {1: (330_000, 110_000), 2: (180_000, 0)}
    print("long runs of licences", time.time() - began)
    assert time.time() - began < 60


def test_oracle_sql(spark):
    """Each operator's SQL in DuckDB at the smallest scale."""
    import os

    import duckdb

    from graphloom.llm import registry

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, d)
        cols = sorted(df.columns)
        got = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
        assert got == sorted(map(repr, con.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())), name


def test_url_filters(spark):
    from graphloom.llm.url_filters import RULES, judge_urls

    urls = {
        "http://A.Example.NET/en/x": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/EN/": ("example.net", "/EN/", "net/", "block"),
        "x://net/": ("net", "/", "net/", "block"),
        "x://net": ("net", "", None, "allow"),
        "x://notnet/": ("notnet", "/", None, "allow"),
        "https://b.example.com/de/?q=/": ("b.example.com", "/de/", "example.com/de/", "block"),
        "https://b.example.com#/de/": ("b.example.com", "", None, "allow"),
        "http://a.org/fr/b?c": ("a.org", "/fr/b", "org/fr/", "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "a://b://net/": ("b:", "//net/", None, "allow"),
        "http://" + "s." * 300 + "net/" + "p" * 5000: ("s." * 300 + "net", "/" + "p" * 5000, "net/", "block"),
    }
    rows = [(k, u, "h", "r") for k, u in enumerate(urls)] + [(0, next(iter(urls)), "h", "r"), (None, "x://net/", "h", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame([*RULES, (None, "/", "block")], "host string, path string, action string")
    got = judge_urls(pages, rules)
    want = [(i, *urls[u]) for i, u, _, _ in rows]
    assert rows_of(got, "page_id", "host", "path", "rule", "verdict") == sorted(want, key=key)
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert judge_urls(pages, rules.limit(0)).filter("verdict = 'allow'").count() == len(rows)
    both = spark.createDataFrame([("net", "/", "allow"), ("net", "/", "block")], "host string, path string, action string")
    assert judge_urls(pages.filter("page_id = 2"), both).first()["verdict"] == "block"


def test_topk(spark):
    from graphloom.llm.topk_search import top_k

    g = np.random.default_rng(0)
    rows = [(k, [float(x) for x in g.normal(0, 0.3, 8)], 1) for k in range(300)]
    rows += [(300 + k, rows[7][1], 1) for k in range(9)]  # ties
    rows += [(400, None, 1), (450, [1.0, None] * 4, 1), (500, [float("nan")] * 8, 1), (550, [1.0, 2.0], 1), (None, rows[0][1], 1), (551, [3.0, 1.0], 1), (600, [float("inf")] * 8, 1), (650, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(np.float64))) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for q, v in good:
        if q % 50 == 0:
            s = sorted((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v))[:5]
            want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert rows_of(top_k(df, df.filter("vec_id % 50 = 0")), "query_id", "rank", "vec_id", "score") == sorted(want)
    assert top_k(df.limit(0), df.limit(0)).count() == 0
    big = spark.createDataFrame([(0, [1e6, 1e6]), (1, [1e6, 1.0]), (2, [3e6, -1e6])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in top_k(big, big.filter("vec_id = 0")).orderBy("rank").collect()] == [2, 1]


def test_topk_bounds_enclose_scores():
    from graphloom.llm.topk_search import Block

    g = np.random.default_rng(1)
    x, q = np.floor(g.normal(0, 50, (200, 6))), np.floor(g.normal(0, 50, (5, 6)))
    block = Block(np.arange(200), x)
    for depth in (1, 50, 150, 200):
        lower, upper = block.bounds(q, depth)
        assert (lower <= block.x @ q.T).all() and (block.x @ q.T <= upper).all()
    assert (lower == upper).all()


def test_topk_stops_early():
    """On skewed data most rows are closed by their bounds, and their scores are never computed."""
    from graphloom.llm.topk_search import Block

    g = np.random.default_rng(2)
    x = np.floor(g.normal(0, 20, (1000, 16)))
    x[:8] += 400  # a few rows far ahead
    q = np.floor(np.abs(g.normal(0, 30, (6, 16)))) + 1
    block = Block(np.arange(1000), x)
    got = {k: (i, s) for k, i, s in block.top(np.full(6, -1), q, 5, np.full(6, -np.inf))}
    for k in range(6):
        s = x @ q[k]
        best = np.lexsort((np.arange(1000), -s))[:5]
        order = np.lexsort((got[k][0], -got[k][1]))[:5]
        assert list(got[k][0][order]) == list(best)
    assert block.resolved <= 6 * 8 and block.closed == block.pairs - block.resolved
    # once the floor is known, a block of others stops without a single score
    rest = Block(np.arange(8, 1000), x[8:])
    assert list(rest.top(np.full(6, -1), q, 5, np.array([np.sort(x @ v)[-5] for v in q]))) == []
    assert rest.stopped == 6 and rest.resolved == 0


def test_topk_grid(spark, monkeypatch):
    """Many cells, and queries of one id with different vectors."""
    from graphloom.llm import topk_search as T

    monkeypatch.setattr(T, "CELL_ROWS", 40)
    monkeypatch.setattr(T, "CELL_QUERIES", 3)
    g = np.random.default_rng(4)
    rows = [(int(k), [float(v) for v in g.normal(0, 1, 5)]) for k in range(200)] + [(50, [9.0, 0.0, 0.0, 0.0, 0.0]), (50, [9.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    vec = [(i, np.floor(256 * np.array(v))) for i, v in rows]
    want = []
    for q, v in {(i, tuple(v)) for i, v in vec if i % 50 == 0}:
        s = sorted((-int(np.array(v) @ w), i) for i, w in vec if i != q)[:5]
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert rows_of(T.top_k(df, df.filter("vec_id % 50 = 0")), "query_id", "rank", "vec_id", "score") == sorted(want)


def test_packing(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    from graphloom.llm.packing import pack

    path = public_tokenizers.path("word_bpe_49k.json")
    got = pack(docs, path)
    want = brute.pieces(TEXTS, Tokenizer.from_file(path))
    assert rows_of(got, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=key)
    bins = {}
    for r in got.collect():
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        ends = [0]
        for at, n in sorted(b):
            assert at == ends[-1]
            ends.append(at + n)
        assert ends[-1] <= 4096
    assert len(bins) == -(-sum(n for b in bins.values() for _, n in b) // 4096)
    assert pack(none, path).count() == 0


def test_encoder_equals_the_library():
    import public_tokenizers
    from hypothesis import example, given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    from graphloom.llm.packing import encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, mine = Tokenizer.from_file(path), encoder(path)

    @settings(max_examples=300, deadline=None)
    @example("It's the <|endoftext|> İstanbul ΣΑΣ e\u0301\xa0x\x85y\x1cz ½²3 µßÀ×÷")
    @given(st.text(st.one_of(st.characters(max_codepoint=255), st.characters(exclude_categories=["Cs"])), max_size=40))
    def same(text):
        assert mine(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    same()


def test_bins():
    from graphloom.llm.packing import plan_bins

    r = random.Random(2)
    counts = {}
    for _ in range(3000):
        n = r.randint(1, 100)
        counts[n] = counts.get(n, 0) + 1
    bins = plan_bins(counts, 100)
    used = {}
    for times, took in bins:
        assert sum(n * m for n, m in took.items()) <= 100
        for n, m in took.items():
            used[n] = used.get(n, 0) + m * times
    assert used == counts
    assert sum(t for t, _ in bins) <= 1.02 * sum(n * c for n, c in counts.items()) / 100 + 1
    assert plan_bins({}, 10) == []


def test_quality(spark, docs, none):
    from graphloom.llm import quality as Q

    junk = lambda k: " ".join(w.upper() + "!!" for w in prose(60, k).split()[:15]) * 3
    rows = [(k, prose(80, k) if k % 3 else junk(k)) for k in range(240)]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(bool(k % 3)), 0) for k, _ in rows], "doc_id long, quality int, toxic int")
    model = Q.fit(train, labels)
    got = {r["doc_id"]: r for r in Q.score_documents(train, model).collect()}
    held = [k for k in got if got[k]["held_out"]]
    assert 30 < len(held) < 90
    assert sum(got[k]["predicted"] == bool(k % 3) for k in held) / len(held) > 0.95
    every = Q.score_documents(docs, model).collect()
    assert len(every) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in every)
    assert Q.score_documents(none, Q.fit(none, labels.limit(0))).count() == 0
    # gradients agree with differences
    x, first = Q.passages([b"a b c D!! " * 40, b"x", b""])
    w, y = Q.train([b"a b c D!! " * 40, b"x"], np.array([0, 1])), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean([np.log(p if t else 1 - p) for p, t in zip(Q._forward(w, x, first)["p"], y, strict=True)])
    g = Q._gradients(w, x.astype(float), first, y)
    for name in ("v", "u", "w1"):
        at = (1, 2)
        w[name][at] += 1e-5
        up = loss()
        w[name][at] -= 2e-5
        down = loss()
        w[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-5


def test_pii(spark, docs, none):
    import re

    from graphloom.llm import pii as P

    assert P.base_spans("a.b@c.de, x@y z@q.r") == [("email", 0, 8), ("email", 14, 19)]
    assert P.base_spans("a@b@c.d") == [("email", 2, 7)]
    assert P.base_spans("1.2.3.4.5 256.1.1.1 é 10.0.0.255") == [("ip", 0, 7), ("ip", 22, 32)]
    assert P.base_spans("1.2.3.4.5.6.7.8.9") == [("ip", 0, 7), ("ip", 8, 15)]
    assert P.base_spans("4111 1111-1111 1111 4111111111111112") == []
    assert P.base_spans("4111 1111-1111 1111, x") == [("card", 0, 19)]
    assert P.base_spans("+1 (743) 555-3824 x") == [("phone", 0, 17)]

    def naive(s):
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        ok = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda m: 13 <= len(digits(m)) <= 19 and P.luhn(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15}
        return [(k, *m.span()) for k in P.BASE_KINDS for m in P.PATTERNS[k].finditer(s) if ok[k](m)]

    r = random.Random(8)
    for _ in range(3000):
        s = "".join(r.choice("a1@..1.+- 45é%()") for _ in range(r.randint(0, 40)))
        assert P.base_spans(s) == naive(s)

    def made(seed):
        r = random.Random(seed)
        x = r.choice([f"{r.choice(VOCAB)}.{r.randint(10, 99)}@mail{r.randint(1, 9)}.example.com", ".".join(str(r.randint(1, 255)) for _ in range(4)), f"+1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)}", f"room {r.randint(1, 99)}", f"v{r.randint(1, 9)}.{r.randint(0, 9)}"])
        return f"{prose(12, seed)} {x} {prose(12, seed + 1)}"

    # spans that no base pattern fits, and look-alikes, in prose of their own
    planted, other = [], random.Random(99)
    for k in range(240):
        before, span, after = P.made_span(P.KINDS[k % 5], other) if k % 6 else ("", P.look_alike(other), "")
        text = f"{prose(9, 5000 + k)} {before}"
        planted.append((1000 + k, f"{text}{span}{after} {prose(9, 6000 + k)}", (P.KINDS[k % 5], len(text), len(text) + len(span)) if k % 6 else None))
    df = spark.createDataFrame([(k, made(k)) for k in range(500)], "doc_id long, text string")
    model = P.train(*P.labelled_windows(df))
    assert 0.5 <= model["sure"] <= 1
    got = P.find_pii(docs, model).collect()
    assert sorted(key((r["doc_id"],)) for r in got) == sorted(key((i,)) for i, _ in TEXTS)
    out = {r["doc_id"]: r for r in P.find_pii(df, model, with_text=True).collect()}
    for k in range(500):
        base = P.base_spans(made(k))
        assert out[k]["base_sha256"] == brute.sha(P._listed(base)) and set(P._listed(base).split(",")) <= set(out[k]["spans"].split(",")) | {""}
    new = [set(every) - set(P.base_spans(t)) for (_, t, _), every in zip(planted, P.spans_of([t for _, t, _ in planted], model, None), strict=True)]
    want = [{gold} - set(P.base_spans(t)) if gold else set() for _, t, gold in planted]
    free = [(n, w) for n, w, (_, t, _) in zip(new, want, planted, strict=True) if not P.base_spans(t)]
    hit, found, true = sum(len(n & w) for n, w in free), sum(len(n) for n, _ in free), sum(len(w) for _, w in free)
    print("added spans: precision", hit / max(1, found), "recall", hit / true, "of", true)
    assert hit / max(1, found) > 0.85 and hit / true > 0.4
    assert P.train(*P.labelled_windows(none)) is None
    assert P.find_pii(none, None).count() == 0
    changed = P.redact(df, None)
    assert changed.columns == [*df.columns, "_redacted"] and changed.filter("_redacted.text like '%[EMAIL]%'").count() > 50
    # windows that overlap agree on spans over their borders
    text = "a" * 50 + " someone.12@mail.example.com " + "b" * 40
    starts = P.window_starts(text)
    tags = np.array([P.tags_of(P.base_spans(text), s) for s in starts])
    assert [s[:3] for s in P.reconcile(starts, tags, np.ones(tags.shape), len(text))] == P.base_spans(text)
    # long runs of digits neither fail nor take long
    began = time.time()
    assert P.base_spans("1.2.3." + "0" * 5000 + "1") == [("ip", 0, 5007)]
    for t in ("1" * 300_000 + ".", "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "1.2.3." + "9" * 300_000):
        assert all(k == "ip" for k, _, _ in P.base_spans(t))
    assert time.time() - began < 20


def test_pii_every_place(monkeypatch):
    """Each character of a text is tagged once, with at least 32 characters of the text on either side of it."""
    from graphloom.llm import pii as P

    def tag(w, x, lengths):
        out = np.zeros(x.shape, np.int8)
        for row, to in zip(x, out, strict=True):
            n = np.flatnonzero(row)[-1] + 1
            to[0 if row[0] == ord("S") + 1 else 32 : n if row[n - 1] == ord("E") + 1 else n - 32] = 2
        return out, np.ones(x.shape, np.float32)

    sizes = [*range(2, 1100), 5000, 250_000]
    texts = ["S" + "x" * (n - 2) + "E" for n in sizes]
    for t in texts:
        starts = P.window_starts(t)
        assert starts[0] == 0 and starts[-1] + P.LENGTH >= len(t) and all(b - a <= P.LENGTH for a, b in zip(starts, starts[1:], strict=False))
    monkeypatch.setattr(P, "tag", tag)
    got = P.decoded(texts, {})
    assert [[s[:3] for s in spans] for spans in got] == [[("email", 0, n)] for n in sizes]


def test_pii_posteriors():
    """Posteriors of long rows, short ones beside them, are those of sums in double precision."""
    from graphloom.llm import pii as P

    g = np.random.default_rng(4)
    w = P.weights(g)
    w["out"] *= 30
    lengths = np.array([128, 512, 64, 512, 320])
    x = np.where(np.arange(512) < lengths[:, None], g.integers(1, P.CHARS, (5, 512)), 0).astype(np.uint8)
    tags, sure = P.tag(w, x, lengths)
    exact = {k: v.astype(np.float64) for k, v in w.items()}
    for row, n, t, p in zip(x, lengths, tags, sure, strict=True):
        e = P._emissions(exact, row[None, :n])[0]
        post = P._marginals(exact, e)[1][:, 0]
        assert t[:n].any() and (t[:n] == P._viterbi(exact, e)[0]).mean() > 0.99
        assert abs(p[:n] - post[np.arange(n), t[:n]]).max() < 2e-3


def test_pii_scores_and_rows_of_unlike_length():
    """Scores are the network's own, and rows that start at different places are decoded as alone."""
    from graphloom.llm import pii as P

    g = np.random.default_rng(6)
    w = P.weights(g)
    for k in ("next", "first"):
        w[k] = g.normal(size=w[k].shape).astype(np.float32)
    exact = {k: v.astype(np.float64) for k, v in w.items()}
    sizes = np.array([320, 256, 256, 64])
    x = np.where(np.arange(320) < sizes[:, None], g.integers(1, P.CHARS, (4, 320)), 0).astype(np.uint8)
    e = P._scores(w, x, (sizes[None] > np.arange(320)[:, None]).sum(axis=1))
    lined, starts = np.zeros((320, 4, P.TAGS), np.float32), 320 - sizes
    for j, n in enumerate(sizes):
        h, c, want = np.zeros(P.HIDDEN), np.zeros(P.HIDDEN), []
        for code in x[j, :n]:  # the forward half, by the textbook
            i, f, o, u = np.split(exact["inf"][code] + h @ exact["ref"], 4)
            c = c / (1 + np.exp(-f)) + np.tanh(u) / (1 + np.exp(-i))
            h = np.tanh(c) / (1 + np.exp(-o))
            want.append(h)
        assert abs(P._lstm(exact, "f", x[j : j + 1, :n])[0][:, 0] - want).max() < 1e-9
        assert abs(e[:n, :, j] - P._emissions(exact, x[j : j + 1, :n])[0][:, 0]).max() < 1e-4
        lined[starts[j] :, j] = e[:n, :, j]
    best, post = P._viterbi(w, lined, starts), P._posteriors(w, lined, starts)
    for j, s in enumerate(starts):
        alone = lined[s:, j : j + 1].astype(np.float64)
        assert (best[j, s:] == P._viterbi(w, lined[s:, j : j + 1])[0]).all()
        assert abs(post[s:, j] - P._marginals(exact, alone, False)[1][:, 0]).max() < 1e-9
    far = np.where(np.arange(P.TAGS) == np.arange(6)[:, None, None] % 2, 1000.0, 0.0)  # beyond exponentials
    barred = exact | {"next": np.where(np.eye(P.TAGS) > 0, 0.0, -900.0)}
    assert abs(P._posteriors(barred, far) - P._marginals(barred, far, False)[1]).max() < 1e-9


def test_pii_scores_by_exponentials_alone(monkeypatch):
    """Gates far beyond the range of an exponential have their limits, and rows of one and of many lengths go both ways; no tanh is taken."""
    from graphloom.llm import pii as P

    g = np.random.default_rng(8)
    sizes = np.array([192, 192, 130, 64, 1])
    x = np.where(np.arange(192) < sizes[:, None], g.integers(1, P.CHARS, (5, 192)), 0).astype(np.uint8)
    for size in (1, 400):  # at 400, exponents reach 1,000 and more
        w = P.weights(g)
        for d in "fb":
            w["in" + d] = w["in" + d] * np.float32(size)
        want = [P._emissions({k: v.astype(np.float64) for k, v in w.items()}, x[j : j + 1, :n])[0][:, 0] for j, n in enumerate(sizes)]
        with monkeypatch.context() as no, np.errstate(all="raise", under="ignore"):
            no.setattr(P.np, "tanh", None)
            e = P._scores(w, x, (sizes[None] > np.arange(192)[:, None]).sum(axis=1))
        for j, n in enumerate(sizes):
            assert abs(e[:n, :, j] - want[j]).max() < 1e-4


def test_pii_scores_by_graph(monkeypatch):
    """The graph's scores are the network's and numpy's, also far beyond the range of an exponential; numpy stands in where onnxruntime is missing."""
    from graphloom.llm import pii as P

    assert P.lstm_session(P.HIDDEN, P.TAGS) is not None
    g = np.random.default_rng(12)
    sizes = np.array([200, 200, 130, 64, 64, 1])
    x = np.where(np.arange(200) < sizes[:, None], g.integers(1, P.CHARS, (6, 200)), 0).astype(np.uint8)
    active = (sizes[None] > np.arange(200)[:, None]).sum(axis=1)
    for size in (1, 400):
        w = P.weights(g)
        for d in "fb":
            w["in" + d] = w["in" + d] * np.float32(size)
        graph = P._scores(w, x, active)
        with monkeypatch.context() as no:
            no.setattr(P, "lstm_session", lambda *a: None)
            plain = P._scores(w, x, active)
        for j, n in enumerate(sizes):
            want = P._emissions({k: v.astype(np.float64) for k, v in w.items()}, x[j : j + 1, :n])[0][:, 0]
            assert abs(graph[:n, :, j] - want).max() < 1e-4 and abs(plain[:n, :, j] - want).max() < 1e-4


def test_pii_doubtful_rows_together(monkeypatch):
    """Doubtful rows of all batches of a call are decoded together, with the results that each has alone."""
    from graphloom.llm import pii as P

    g = np.random.default_rng(13)
    w = P.weights(g)
    w["out"] *= 10
    lengths = g.integers(1, 100, 600)
    x = np.where(np.arange(100) < lengths[:, None], g.integers(1, P.CHARS, (600, 100)), 0).astype(np.uint8)
    alone = [P.tag(w, x[j : j + 1], lengths[j : j + 1]) for j in range(600)]
    calls, viterbi = [], P._viterbi
    monkeypatch.setattr(P, "TOGETHER", 20)
    monkeypatch.setattr(P, "_viterbi", lambda w, e, starts: calls.append(e.shape[1]) or viterbi(w, e, starts))
    tags, sure = P.tag(w, x, lengths)
    assert sum(calls) > 300 and len(calls) == -(-sum(calls) // 256)  # 30 batches
    for (t, p), row, q in zip(alone, tags, sure, strict=True):
        assert (t[0] == row).mean() > 0.99 and (abs(p[0] - q)[t[0] == row] < 1e-3).all()


def test_crf_by_enumeration():
    """Viterbi, log Z and the posteriors against all tag sequences; the gradient against differences."""
    from itertools import product

    from graphloom.llm import pii as P

    g = np.random.default_rng(3)
    length, tags = 5, 3
    w, e = {"first": g.normal(size=tags), "next": g.normal(size=(tags, tags))}, g.normal(size=(length, 2, tags))
    z, post, moves = P._marginals(w, e)
    best = P._viterbi(w, e)
    for k in range(2):
        every = list(product(range(tags), repeat=length))
        score = np.array([w["first"][s[0]] + sum(e[t, k, s[t]] for t in range(length)) + sum(w["next"][a, b] for a, b in zip(s, s[1:], strict=False)) for s in every])
        assert tuple(best[k]) == every[int(score.argmax())]
        p = np.exp(score - score.max())
        assert abs(z[k] - (score.max() + np.log(p.sum()))) < 1e-9
        p /= p.sum()
        for t in range(length):
            for x in range(tags):
                assert abs(post[t, k, x] - sum(q for s, q in zip(every, p, strict=True) if s[t] == x)) < 1e-9
    net = {k: v.astype(np.float64) for k, v in P.weights(g).items()}
    x, y = g.integers(0, P.CHARS, (3, 7)), g.integers(0, P.TAGS, (7, 3))
    _, grad = P._gradients(net, x, y)
    for name, at in (("out", (1, 2)), ("next", (0, 3)), ("first", (1,)), ("ref", (2, 5)), ("reb", (3, 40)), ("inf", (int(x[0, 0]), 6)), ("inb", (int(x[1, 3]), 30))):
        net[name][at] += 1e-6
        up = P._gradients(net, x, y)[0]
        net[name][at] -= 2e-6
        down = P._gradients(net, x, y)[0]
        net[name][at] += 1e-6
        assert abs((up - down) / 2e-6 - grad[name][at]) < 1e-6, name


def test_quality_by_loops():
    """The score of whole texts, passage by passage in plain Python."""
    import math

    from graphloom.llm import quality as Q

    texts = [t.encode() if t else b"" for _, t in TEXTS]
    w = Q.train([b"good words here " * 30, b"BAD!! 1 2 3"], np.array([1, 0]))
    x, first = Q.passages(texts)
    p = Q._forward(w, x, first)["p"]
    for k, t in enumerate(texts):
        words = t.split()
        bags = [words[a : a + Q.PASSAGE] for a in range(0, max(1, len(words)), Q.PASSAGE)]
        assert len(bags) == first[k + 1] - first[k]
        hidden, energy = [], []
        for j, bag in enumerate(bags):
            row = x[first[k] + j]
            assert abs(row[Q.CLASSES + 5] - len(bag) / Q.PASSAGE) < 1e-6
            if bag:
                assert abs(row[Q.CLASSES] - len(set(bag)) / len(bag)) < 1e-6
                assert abs(row[Q.CLASSES + 1] - sum(min(len(b), 100) for b in bag) / len(bag)) < 1e-4
            h = [math.tanh(sum(max(-8, min(8, (row[f] - w["mean"][f]) / w["scale"][f])) * w["w1"][f, c] for f in range(Q.FEATURES)) + w["b1"][c]) for c in range(Q.HIDDEN)]
            gate = [math.tanh(sum(h[a] * w["v"][a, c] for a in range(Q.HIDDEN))) / (1 + math.exp(-sum(h[a] * w["u"][a, c] for a in range(Q.HIDDEN)))) for c in range(Q.HIDDEN)]
            hidden.append(h)
            energy.append(sum(gate[c] * w["a"][c] for c in range(Q.HIDDEN)))
        share = [math.exp(v - max(energy)) for v in energy]
        z = [sum(s * h[c] for s, h in zip(share, hidden, strict=True)) / sum(share) for c in range(Q.HIDDEN)]
        assert abs(p[k] - 1 / (1 + math.exp(-(sum(z[c] * w["w2"][c] for c in range(Q.HIDDEN)) + w["b2"])))) < 1e-6


def test_registry(spark):
    from graphloom.llm import registry

    names = list(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)
