"""Repeated windows across documents: what the two substring dedup operators share.

A document is a sequence of tokens (words or bytes). Each window of ``width``
tokens has a key: the smallest symbol in a fixed part of the window, a choice that
depends on the window's tokens only, so equal windows have equal keys at equal
places. Consecutive windows with one key occurrence make an *anchor*: its symbol,
the range of window starts, and a hash of all the tokens that the range covers (its
*context*).

Anchors with one symbol and one hash form a class: all their windows are equal (the
two are 128 bits). Where a symbol has several classes, a suffix array over one
context of each tells which windows stand in others too. A symbol of more classes
than one task should hold is split by longer keys of the same kind, until its parts
are small. Work and shuffles follow the number of anchors (about one for a dozen
words, or ninety bytes), never pairs of documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lists, map_arrow, runs_by_bytes, small, texts_of
from .wordhash import U, mix, prefix_hash, range_hash, sliding_min

#: Contexts of a symbol that go to one suffix array at most; more are split by a longer key.
GROUP = 4096
#: Bytes of contexts that one suffix array takes; the contexts of a symbol stay together.
ARRAY_BYTES = 1 << 19

#: anchors(texts) -> for each text (tokens, digest of the text as kept, sym, u, lo, n); see ``anchors_of``.
Anchors = Callable[[list[bytes]], Iterator[tuple[int, str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]


class Kind:
    """What a token is: ``anchors`` of texts, ``cut`` a context from a text, ``tokens`` of a context as numbers."""

    width: int
    #: Lengths of the grams whose least hash splits a symbol's contexts further, ending with the width.
    splits: tuple[int, ...]

    def anchors(self, texts: list[bytes]) -> Iterator[tuple]:
        raise NotImplementedError

    def split(self, text: bytes):
        """A text as something that ``context`` slices."""
        raise NotImplementedError

    def context(self, parts, start: int, end: int) -> bytes:
        raise NotImplementedError

    def tokens(self, contexts: list[bytes]) -> list[np.ndarray]:
        """Small non-negative numbers, equal where the tokens of these contexts are equal."""
        raise NotImplementedError


def anchors_of(order: np.ndarray, symbol: np.ndarray, total: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int, skip: int, reach: int):
    """(sym, u, lo, n) of each text, whose tokens are ``begin[k]:begin[k] + size[k]``.

    ``order``: what is minimised at each token (its low 32 bits are its place);
    ``symbol``: the symbol there; ``total``: prefix hashes of the tokens. The key of
    a window is the least of ``reach`` places from ``skip`` on.
    """
    starts = np.maximum(size - width + 1, 0)
    doc = np.repeat(np.arange(len(size)), starts)
    at = np.arange(len(doc)) - (np.cumsum(starts) - starts)[doc] + begin[doc] if len(doc) else np.zeros(0, np.int64)
    least = sliding_min(order, reach)
    key = (least[at + skip] & U(0xFFFFFFFF)).astype(np.int64) if len(at) else at
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(at) else np.zeros(0, np.int64)
    last = np.concatenate([new[1:], [len(at)]]) - 1 if len(at) else new
    lo, hi, place, of = at[new], at[last], key[new], doc[new]
    with np.errstate(over="ignore"):
        u = mix(range_hash(total, lo, hi + width) + (place - lo).astype(np.uint64))
    sym = symbol[place]
    bounds = np.searchsorted(of, np.arange(len(size) + 1))
    for k in range(len(size)):
        s = slice(bounds[k], bounds[k + 1])
        yield sym[s].view(np.int64), u[s].view(np.int64), lo[s] - begin[k], hi[s] - lo[s] + 1


def gram_anchors(values: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int, gram: int, seed: int = 0):
    """anchors_of with the least hash of ``gram`` consecutive tokens as key; ``values`` hash the tokens, with ``gram`` more at the end."""
    total = prefix_hash(values)
    place = np.arange(len(values) - gram + 1)
    symbol = range_hash(total, place, place + gram)
    order = (mix(symbol ^ U(seed)) >> U(32) << U(32)) | place.astype(np.uint64)
    return anchors_of(order, symbol, total, begin, size, width, 0, width - gram + 1)


def _nearest_smaller(p: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each, -1 without one; pointers jump over what is known to be larger."""
    prev = np.arange(-1, len(p) - 1)
    todo = np.flatnonzero((prev >= 0) & (p[prev] > p))
    while len(todo):
        prev[todo] = prev[prev[todo]]
        at = prev[todo]
        todo = todo[(at >= 0) & (p[at] > p[todo])]
    return prev


def factors(contents: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(content, start, lpf, source, later) for every start of ``width`` tokens in the contents.

    The suffix array: starts ordered by their first ``width`` tokens (prefix doubling
    over ranks), then by place. The previous and the next suffix in that order with a
    smaller place are the two candidates for the longest earlier match; ``lpf`` is the
    longer of the common prefixes (up to ``width``, from the ranks by powers of two)
    and ``source`` the index of its start (-1: no earlier start). ``later``: whether
    the next suffix in order is equal over the whole width, and so is a later match.
    """
    size = np.array([len(c) for c in contents], np.int64)
    begin = np.cumsum(size) - size
    many = np.maximum(size - width + 1, 0)
    of = np.repeat(np.arange(len(contents)), many)
    start = np.arange(len(of)) - (np.cumsum(many) - many)[of] if len(of) else of
    if not len(of):
        none = np.zeros(0, np.int64)
        return of, start, none, none, np.zeros(0, bool)
    at = begin[of] + start
    ranks, length = [np.concatenate([*contents, np.zeros(width, np.int64)]).astype(np.int64)], [1]
    while length[-1] < width:
        r, shift = ranks[-1], min(length[-1], width - length[-1])
        moved = np.concatenate([r[shift:], np.zeros(shift, np.int64)])
        pair = (r << 32) | moved
        if length[-1] + shift == width:
            pair = pair[at]
        ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
        length.append(length[-1] + shift)
    full = ranks[-1] if width > 1 else ranks[0][at]
    order = np.argsort(full, kind="stable")  # places ascend within a rank
    place = at[order]
    before = _nearest_smaller(place)
    after = len(place) - 1 - _nearest_smaller(place[::-1])[::-1]
    after[after == len(place)] = -1
    lpf, source = np.zeros(len(order), np.int64), np.full(len(order), -1)
    for other in (before, after):
        some = np.flatnonzero(other >= 0)
        x, y = order[some], order[other[some]]
        same = full[x] == full[y]
        common = np.where(same, width, 0)
        rest = np.flatnonzero(~same)
        a, b, got = at[x[rest]], at[y[rest]], np.zeros(len(rest), np.int64)
        for r, n in zip(ranks[-2::-1], length[-2::-1], strict=True):
            got += np.where(r[a + got] == r[b + got], n, 0) * (got + n <= width)
        common[rest] = got
        better = common > lpf[x]
        lpf[x[better]], source[x[better]] = common[better], y[better]
    later = np.zeros(len(order), bool)
    later[order[:-1]] = full[order[1:]] == full[order[:-1]]
    return of, start, lpf, source, later


def _solved(kind: Kind, keep: str, cs: list, contents: list[bytes], owners: np.ndarray) -> dict:
    """Window starts of each context that stand elsewhere in the group: earlier, in an earlier owner, or anywhere."""
    of, start, lpf, source, later = factors(kind.tokens(contents), kind.width)
    earlier = lpf >= kind.width
    if keep == "first":
        hit = earlier
    elif keep == "none":
        hit = earlier | later
    else:
        # the first of equal windows: sources lead to it, as each is an earlier equal start
        first = np.where(earlier, source, np.arange(len(of)))
        while (first[first] != first).any():
            first = first[first]
        hit = owners[of[first]] < owners[of]
    of, start = of[hit], start[hit]
    cut = np.searchsorted(of, np.arange(len(contents) + 1))
    some = np.flatnonzero(np.diff(cut))
    return {"c": np.array(cs, np.int64)[some], "js": lists([start[cut[k] : cut[k + 1]] for k in some], np.int32)}


def _arrays(kind: Kind, keep: str):
    """Suffix arrays over the contexts of each symbol, a few symbols at a time; rows come by symbol, id and place."""

    def run(batches: Iterator[pa.RecordBatch]):
        cs, contents, owners, size, sym, owner = [], [], [], 0, None, None

        def solved():
            return None, None, _solved(kind, keep, cs, contents, np.array(owners, np.int64))

        for batch in batches:
            col = lambda n, b=batch: b.column(b.schema.get_field_index(n))
            ids = col("id")
            fresh = np.ones(batch.num_rows, bool)
            if batch.num_rows > 1:
                import pyarrow.compute as pc

                fresh[1:] = pc.fill_null(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)), True).to_numpy(zero_copy_only=False)
            first = ids[0].as_py()
            fresh[0] = first is None or first != owner
            owner = ids[len(ids) - 1].as_py()
            for s, c, t, f in zip(col("sym").to_pylist(), col("c").to_pylist(), col("content").to_pylist(), fresh, strict=True):
                if size >= ARRAY_BYTES and s != sym:
                    yield solved()
                    cs, contents, owners, size = [], [], [], 0
                sym = s
                owners.append(len(owners) if f or not owners else owners[-1])
                cs.append(c)
                contents.append(t)
                size += len(t)
        if cs:
            yield solved()

    return run


def _again(kind: Kind, gram: int):
    """Contexts cut at the anchors of a longer gram: parts of contexts, under symbols of both."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            col = lambda n, b=batch: b.column(b.schema.get_field_index(n))
            take, out = [], {"sym": [], "u": [], "lo": [], "j": [], "content": []}
            for k, (sym, lo, j, t) in enumerate(zip(col("sym").to_pylist(), col("lo").to_pylist(), col("j").to_pylist(), col("content").to_pylist(), strict=True)):
                parts = kind.split(t)
                values = np.concatenate([kind.values(t), np.zeros(gram, np.uint64)])
                size = np.array([len(values) - gram])
                for s, u, at, n in gram_anchors(values, np.zeros(1, np.int64), size, kind.width, gram, gram):
                    for x, h, a, m in zip(mix(s.view(np.uint64) ^ U(sym & (2**64 - 1))).view(np.int64).tolist(), u.tolist(), at.tolist(), n.tolist(), strict=True):
                        take.append(k)
                        out["sym"].append(x)
                        out["u"].append(h)
                        out["lo"].append(lo + a)
                        out["j"].append(j + a)
                        out["content"].append(kind.context(parts, a, a + m + kind.width - 1))
            if take:
                yield batch, np.array(take, np.int64), out

    return run


def _in_contexts(contexts: DataFrame, scratch: Scratch, kind: Kind, keep: str) -> DataFrame:
    """(c, js) from contexts (sym, id, lo, j, c, content): a symbol's contexts in one array, or split further."""
    found, todo = [], contexts
    for level, gram in enumerate((*kind.splits, 0)):
        many = scratch.save(todo.groupBy(F.col("sym").alias("s")).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > GROUP), f"large{level}")
        hot = not many.isEmpty()
        few = todo.join(many, F.col("sym") == F.col("s"), "left_anti") if hot else todo
        few = few.repartition("sym").sortWithinPartitions("sym", "id", "lo", "c", "j")
        hits = map_arrow(few.withColumn("c", F.col("c")), [], "c long, js array<int>", _arrays(kind, keep), rows=1024)
        if level:  # parts of contexts: their starts count from the context's own
            hits = hits.join(todo.select(F.col("c").alias("p"), "j", F.col("owner")), F.col("c") == F.col("p")).select(F.col("owner").alias("c"), F.transform("js", lambda x: (x + F.col("j")).cast("int")).alias("js"))
        found.append(hits)
        if not hot:
            break
        large = todo.join(many, F.col("sym") == F.col("s"), "left_semi")
        if not gram:
            # equal windows alone are left under a symbol; they are told apart by their tokens and counted
            place = F.struct("id", "lo", "c") if keep == "first" else F.struct("id")
            same = scratch.save(large.groupBy(F.col("sym").alias("s"), F.col("content").alias("t")).agg(F.count(F.lit(1)).alias("k"), F.min(place).alias("f")), "equal")
            told = large.join(same, (F.col("sym") == F.col("s")) & (F.col("content") == F.col("t")))
            told = told.filter(F.col("k") > 1 if keep == "none" else place > F.col("f"))
            found.append(told.select(F.col("owner").alias("c"), F.array(F.col("j").cast("int")).alias("js")))
            break
        owner = "owner" if level else "c"
        parts = map_arrow(large.select("id", F.col(owner).alias("owner"), "sym", "lo", "j", "content"), ["id", "owner"], "sym long, u long, lo long, j long, content binary", _again(kind, gram), rows=64)
        todo = scratch.save(parts.withColumn("c", F.monotonically_increasing_id()), f"parts{level}")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def with_texts(keyed: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds text to rows with (k, h), from docs (k, h, text); one shuffle of the texts concerned.

    k and h hash the id and the text, so repeated ids keep their own texts. Texts of
    other documents are left out before the shuffle while the keys are few.
    """
    docs = docs.select("k", "h", "text")
    wanted = small(keyed.select("k", "h").distinct())
    return keyed.join(docs.join(wanted, ["k", "h"], "left_semi").dropDuplicates(["k", "h"]), ["k", "h"])


def find_repeats(docs: DataFrame, scratch: Scratch, kind: Kind, keep: str) -> tuple[DataFrame, DataFrame]:
    """(rows, removed) for docs (id, k, h, text).

    rows: row, id, k, h, n (tokens), digest (of the text with nothing removed).
    removed: row, s, e: two arrays, window starts from s to e whose window also starts
    elsewhere: in a document with a smaller id (keep="document"), earlier in the order
    of id and place (keep="first"), or anywhere (keep="none").
    """

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = texts_of(batch.column(batch.schema.get_field_index("text")))
            got = [x for s in runs_by_bytes(texts) for x in kind.anchors(texts[s])]
            n, digest, sym, u, lo, size = zip(*got, strict=True) if got else [()] * 6
            yield batch, None, {"n": list(n), "digest": list(digest), "sym": lists(sym, np.int64), "u": lists(u, np.int64), "lo": lists(lo, np.int64), "len": lists(size, np.int32)}

    rows = map_arrow(docs, ["id", "k", "h"], "n long, digest string, sym array<long>, u array<long>, lo array<long>, len array<int>", scan)
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    # a null id has no place in an order, so it neither loses nor takes windows there
    ordered = keep != "none"
    taken = rows.filter("id IS NOT NULL") if ordered else rows
    ident = [F.col("id").alias("id")] if ordered else []
    found = taken.select("row", *ident, F.inline(F.arrays_zip("sym", "u", "lo", "len")))
    several = found.groupBy("sym").agg(F.count(F.lit(1)).alias("k"), F.min("u").alias("a"), F.max("u").alias("b")).filter("k > 1")
    # tables of their own, so that Spark can split hot symbols in the joins
    several = scratch.save(several.select(F.col("sym").alias("s"), (F.col("a") < F.col("b")).alias("mixed")), "several")
    shared = scratch.save(found.join(several, F.col("sym") == F.col("s")).drop("s"), "shared")
    scratch.drop("several")
    id_ = F.col("id") if ordered else F.lit(0)
    classed = shared if ordered else shared.filter("mixed")
    place = F.struct(id_.alias("id"), "lo", "row", "len")
    classes = classed.groupBy("sym", "u").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("f"), F.max("mixed").alias("mixed"))
    classes = scratch.save(classes.withColumn("c", F.monotonically_increasing_id()), "classes")

    at = F.struct(F.col("f.lo").alias("lo"), F.col("f.len").alias("len"), "c", "sym", F.col("f.id").alias("id"))
    by_row = classes.filter("mixed").groupBy(F.col("f.row").alias("w")).agg(F.collect_list(at).alias("at"))  # at most a document's anchors in one array
    by_row = by_row.join(rows.select("row", "k", "h"), F.col("w") == F.col("row")).select("k", "h", "at")
    by_row = with_texts(by_row, docs).select(F.col("at")[0]["id"].alias("id"), "text", F.col("at.c").alias("c"), F.col("at.sym").alias("sym"), F.col("at.lo").alias("lo"), F.col("at.len").alias("len"))

    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            col = lambda n, b=batch: b.column(b.schema.get_field_index(n)).to_pylist()
            take, out = [], {"sym": [], "lo": [], "j": [], "c": [], "content": []}
            for row, (text, *ats) in enumerate(zip(texts_of(batch.column(batch.schema.get_field_index("text"))), col("sym"), col("lo"), col("c"), col("len"), strict=True)):
                parts = kind.split(text)
                for sym, lo, c, size in zip(*ats, strict=True):
                    take.append(row)
                    out["sym"].append(sym)
                    out["lo"].append(lo)
                    out["j"].append(0)
                    out["c"].append(c)
                    out["content"].append(kind.context(parts, lo, lo + size + kind.width - 1))
            if take:
                yield batch, np.array(take, np.int64), out

    contexts = scratch.save(map_arrow(by_row, ["id"], "sym long, lo long, j long, c long, content binary", cut), "contexts")
    js = _in_contexts(contexts, scratch, kind, keep).select("c", F.explode("js").alias("j"))
    hits = scratch.save(js.groupBy("c").agg(F.array_sort(F.collect_set("j")).alias("js")), "hits")  # at most an anchor's windows
    scratch.drop("contexts", *[f"{x}{k}" for x in ("large", "parts") for k in range(len(kind.splits) + 1)], "equal")

    last = F.col("lo") + F.col("len") - 1
    info = classes.join(hits, "c", "left").filter("n > 1 OR js IS NOT NULL").select(F.col("sym").alias("s1"), F.col("u").alias("u1"), "n", "f", "js")
    occurring = classed.join(info, (F.col("sym") == F.col("s1")) & (F.col("u") == F.col("u1")))
    if keep == "none":
        whole = F.col("n") > 1
    elif keep == "document":
        whole = F.col("id") > F.col("f.id")
    else:
        whole = F.struct("id", "lo", "row") > F.struct("f.id", "f.lo", "f.row")
    # runs of consecutive window starts, as two arrays of numbers
    starts = F.filter("js", lambda j: ~F.array_contains("js", j - 1))
    ends = F.filter("js", lambda j: ~F.array_contains("js", j + 1))
    move = lambda js: F.transform(js, lambda j: F.col("lo") + j)
    spans = F.struct(F.when(whole, F.array("lo")).otherwise(move(starts)).alias("s"), F.when(whole, F.array(last)).otherwise(move(ends)).alias("e"))
    removed = occurring.select("row", spans.alias("x")).filter(F.size("x.s") > 0)
    if not ordered:  # a symbol of one class occurs in several places: all its windows go
        removed = removed.unionByName(shared.filter("NOT mixed").select("row", F.struct(F.array("lo").alias("s"), F.array(last).alias("e")).alias("x")))
    removed = removed.groupBy("row").agg(F.collect_list("x").alias("x"))
    removed = scratch.save(removed.select("row", F.flatten("x.s").alias("s"), F.flatten("x.e").alias("e")), "removed")
    scratch.drop("shared", "classes", "hits")
    return rows.select("row", "id", "k", "h", "n", "digest"), removed


def covered(s: np.ndarray, e: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n tokens lie in a window that starts in one of the ranges from s to e."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, s, 1)
    np.add.at(change, e + width, -1)
    return np.cumsum(change[:-1]) > 0


def apply_removal(docs: DataFrame, rows: DataFrame, removed: DataFrame, cut: Callable[[bytes, np.ndarray, np.ndarray], tuple], extra: str) -> DataFrame:
    """rows with what ``cut`` (text, s, e) returns for documents with removals; one row for each document.

    ``extra``: the columns that cut returns, the last a digest and then the text kept.
    """
    names = [x.split()[0] for x in extra.split(", ")]

    def done(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            col = lambda n, b=batch: b.column(b.schema.get_field_index(n))
            s, e = col("s"), col("e")
            got = [cut(t, s[k].values.to_numpy(), e[k].values.to_numpy()) for k, t in enumerate(texts_of(col("text")))]
            yield batch, None, dict(zip(names, map(list, zip(*got, strict=True)), strict=True)) if got else {n: [] for n in names}

    keyed = removed.withColumnRenamed("row", "w").join(rows.select("row", "k", "h"), F.col("w") == F.col("row")).drop("row")
    changed = map_arrow(with_texts(keyed, docs).select("w", "text", "s", "e"), ["w"], extra, done)
    return rows.select("row", "id", "n", "digest").join(changed, F.col("row") == F.col("w"), "left")
