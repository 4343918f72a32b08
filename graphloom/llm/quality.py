"""Quality classifier: gated-attention multiple-instance learning over passages, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, runs_by_bytes, table, texts_of
from .wordhash import U, Words

#: Words of a passage.
PASSAGE = 64
#: Labelled documents of each class that a fit takes at most, by hash of their id.
SAMPLE = 1500
#: Score from which a document is predicted to be of label 1.
THRESHOLD = 0.7
HIDDEN, EPOCHS, BATCH, RATE = 16, 30, 128, 0.01

#: Byte classes: a-z, A-Z, digits, white space, each other ASCII sign on its own, control bytes, bytes above 127.
CLASS = np.zeros(256, np.int64)
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 0, 1, 2
CLASS[:32], CLASS[127], CLASS[128:] = 4, 4, 5
CLASS[[32, 9, 10, 11, 12, 13]] = 3
SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
CLASS[SIGNS] = np.arange(6, 6 + len(SIGNS))
CLASSES = 6 + len(SIGNS)
FEATURES = CLASSES + 6


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features, first): a row for each passage; those of text k are first[k]:first[k + 1], at least one.

    Shares of the byte classes, share of distinct words, mean and deviation of the
    words' lengths, shares of words in capitals and of one letter, and fullness.
    """
    words = Words(texts)
    n = np.diff(words.first)
    many = np.maximum(1, -(-n // PASSAGE))
    first = np.concatenate([[0], np.cumsum(many)])
    doc = np.repeat(np.arange(len(texts)), n)
    of = first[doc] + (np.arange(len(doc)) - words.first[doc]) // PASSAGE  # the passage of each word
    p = int(first[-1])
    count = np.bincount(of, minlength=p).astype(np.float64)
    raw = np.frombuffer(words.data, np.uint8)
    edge = np.searchsorted(of, np.arange(p))  # the first word of each passage
    begin = np.append(words.start, len(raw))[edge]
    span = np.diff(np.append(begin, len(raw)))
    cut = int(begin[0]) if p else 0
    hist = np.bincount(np.repeat(np.arange(p), span) * CLASSES + CLASS[raw[cut:]], minlength=p * CLASSES).reshape(p, CLASSES)
    out = np.zeros((p, FEATURES), np.float32)
    out[:, :CLASSES] = hist / np.maximum(1, hist.sum(axis=1, keepdims=True))
    some = np.maximum(count, 1)
    key = np.sort((of.astype(np.uint64) << U(36)) | (words.hash >> U(28)))
    fresh = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    size = np.minimum(words.end - words.start, 100).astype(np.float64)
    mean = np.bincount(of, size, minlength=p) / some
    capital = np.concatenate([[0], np.cumsum(CLASS[raw] == 1)])
    small = np.concatenate([[0], np.cumsum(CLASS[raw] == 0)])
    shout = ((capital[words.end] - capital[words.start]) > 1) & (small[words.end] == small[words.start])
    out[:, CLASSES] = np.bincount((key[fresh] >> U(36)).astype(np.int64), minlength=p) / some
    out[:, CLASSES + 1] = mean
    out[:, CLASSES + 2] = np.sqrt(np.maximum(0, np.bincount(of, size**2, minlength=p) / some - mean**2))
    out[:, CLASSES + 3] = np.bincount(of, shout, minlength=p) / some
    out[:, CLASSES + 4] = np.bincount(of, size == 1, minlength=p) / some
    out[:, CLASSES + 5] = count / PASSAGE
    out[count == 0, :CLASSES] = 0
    return out, first


def _forward(w: dict, x: np.ndarray, first: np.ndarray) -> dict:
    h = np.tanh(((x - w["mean"]) / w["scale"]).clip(-8, 8) @ w["w1"] + w["b1"])
    t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
    e = (t * g) @ w["a"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), np.diff(first)))
    a = e / np.repeat(np.add.reduceat(e, first[:-1]), np.diff(first))
    z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": 1 / (1 + np.exp(-(z @ w["w2"] + w["b2"])))}


def _gradients(w: dict, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
    f, n = _forward(w, x, first), np.diff(first)
    ds = (f["p"] - y) / len(y)
    dz = np.repeat(ds[:, None] * w["w2"], n, axis=0)
    da = (dz * f["h"]).sum(axis=1)
    de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first[:-1]), n))
    dt = de[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2)
    dg = de[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["a"][:, None] * dz + dt @ w["v"].T + dg @ w["u"].T) * (1 - f["h"] ** 2)
    scaled = ((x - w["mean"]) / w["scale"]).clip(-8, 8)
    return {"w1": scaled.T @ dh, "b1": dh.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "a": (de[:, None] * f["t"] * f["g"]).sum(axis=0), "w2": f["z"].T @ ds, "b2": ds.sum()}


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> dict:
    """Weights from whole texts and their 0/1 labels; both classes weigh the same."""
    rng = np.random.default_rng(seed)
    texts = texts or [b""]
    parts = [passages(texts[s]) for s in runs_by_bytes(texts)]  # in parts, for the driver's memory
    x = np.concatenate([p for p, _ in parts]).astype(np.float64)
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in parts]))])
    w = {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 1e-3}
    for name, shape in (("w1", (FEATURES, HIDDEN)), ("v", (HIDDEN, HIDDEN)), ("u", (HIDDEN, HIDDEN)), ("a", (HIDDEN,)), ("w2", (HIDDEN,))):
        w[name] = rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w["b1"], w["b2"] = np.zeros(HIDDEN), np.float64(0)
    by = [np.flatnonzero(labels == k) for k in (0, 1)]
    if not all(map(len, by)):  # one class only: its share is the score
        w["w2"] *= 0
        w["b2"] = np.float64(4.0 if len(by[1]) else -4.0 if len(by[0]) else 1.0)
        return w
    m, v, step = {}, {}, 0
    rounds = max(1, max(map(len, by)) * 2 // BATCH)
    for _ in range(EPOCHS * rounds):
        pick = np.concatenate([rng.choice(b, BATCH // 2) for b in by])
        size = np.diff(first)[pick]
        own = np.concatenate([[0], np.cumsum(size)])
        rows = np.concatenate([np.arange(first[k], first[k + 1]) for k in pick])
        g = _gradients(w, x[rows], own, labels[pick].astype(np.float64))
        step += 1
        for k, d in g.items():
            d = d + (1e-4 * w[k] if k in ("w1", "w2") else 0)
            m[k] = 0.9 * m.get(k, 0) + 0.1 * d
            v[k] = 0.999 * v.get(k, 0) + 0.001 * d * d
            w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w


def held_out(id_):
    """Rows that no fit may see: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> dict:
    """Fit on at most ``sample`` labelled rows of each class that are not held out, taken by hash of their id."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).dropna().filter(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y"), F.min("y").alias("least")).filter("y = least").drop("least")
    parts = [known.filter(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * sample rows
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(chosen, "id").dropDuplicates(["id"]).toPandas().sort_values("id")
    w = train([t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts["text"]], texts["y"].to_numpy())
    shares = {r["y"]: r["n"] for r in known.filter("y IN (0, 1)").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(shares) == 2:  # training saw both classes alike; scores follow the labels' shares
        w["b2"] = w["b2"] + np.log(shares[1] / shares[0])
    return w


def score_documents(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text with a fitted model, in one narrow pass.

    Every passage is encoded, gated attention weighs the passages, and the weighted
    representation is scored. Null and empty texts are one passage without words; a
    very long text is one bag, read in parts of 2 MB with others. Rows are judged one
    by one: repeated rows, null ids and equal scores each keep their row, and ids of
    any type go through unchanged. An empty table gives no rows; other columns take
    no part.

    Returns ``id_col``, held_out, score, predicted, passages, key_passage (the one
    with the most attention).
    """
    weights = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), held_out(F.col(f"`{id_col}`")).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = texts_of(batch.column(2))
            score, many, top = [], [], []
            for s in runs_by_bytes(texts):
                x, first = passages(texts[s])
                f = _forward(weights.value, x, first)
                score.append(f["p"])
                many.append(np.diff(first))
                top += [int(f["a"][a:b].argmax()) for a, b in zip(first[:-1], first[1:], strict=True)]
            if texts:
                p = np.round(np.concatenate(score), 6)
                yield batch, None, {"score": p, "predicted": (p >= threshold).astype(np.int32), "passages": np.concatenate(many), "key_passage": np.array(top, np.int64)}

    return map_arrow(rows, ["id", "held_out"], "score double, predicted int, passages long, key_passage long", judge).withColumnRenamed("id", id_col)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("passages", "key_passage")
    return Scratch(spark, "quality").save(scored, "scored")  # written here, in small Arrow batches


QUERIES = {"op2_quality": op2_quality}
