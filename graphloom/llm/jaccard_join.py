"""N-gram Jaccard join with set relations: index blocks are skipped, answers are derived from hubs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lists, map_arrow, runs_by_bytes, small, table, texts_of
from .graph import components
from .wordhash import U, Words, mix, shingles

#: Shingles that a task gathers before it sends them on, and documents among them at most.
FLUSH, FLUSH_DOCS = 1 << 19, 1 << 16
#: Buckets of shingles for each shuffle partition, at least; a bucket is resolved at once.
BUCKETS = 2
#: Entries after which a bucket lets go of those that are decided.
HELD = 4 << 20
#: Postings of a block; lists are compared block by block.
BLOCK = 256
#: Bits of a set's parity map.
PARITY = 1024


def _sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    for s in runs_by_bytes(texts):
        words = Words(texts[s], lower=True)
        for k in range(len(words.first) - 1):
            yield shingles(words.hash[words.first[k] : words.first[k + 1]], n)


def _packed(tok: np.ndarray, bits: int) -> bytes:
    """48 bits of each shingle after the ``bits`` that name its bucket."""
    return np.ascontiguousarray((((tok << U(bits)) >> U(16)).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(bucket: int, raw: bytes, bits: int) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return ((out.reshape(-1).view("<u8").astype(np.uint64) << U(16)) >> U(bits)) | U((bucket << (64 - bits)) & (2**64 - 1))


def _gather(n: int, bits: int):
    """Tasks send a row for each document, and for each bucket the shingles of many documents together.

    Equal sets of one flush count once. Of a shingle that more than two sets of a
    flush hold, two entries go to its bucket, which make it shared there; the others
    are known to be shared already and go anywhere, so a very common shingle floods
    no bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        toks, sigs, sizes, known, held = [], [], [], set(), 0
        spread = TaskContext.get().partitionId() * 1_000_003 if TaskContext.get() else 0

        def blobs():
            nonlocal toks, sigs, sizes, known, held, spread
            if not toks:
                return
            tok, of = np.concatenate(toks), np.repeat(np.arange(len(toks)), sizes)
            sig, size = np.array(sigs, np.int64), np.array(sizes, np.int32)
            toks, sigs, sizes, known, held = [], [], [], set(), 0
            order = np.argsort(tok, kind="stable")
            tok, of = tok[order], of[order]
            new = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
            nth = np.arange(len(tok)) - np.repeat(new, np.diff(np.append(new, len(tok))))
            bucket = (tok >> U(64 - bits)).astype(np.int64)
            more = nth >= 2
            out = {"bucket": [], "docs": [], "sizes": [], "many": [], "tok": []}
            for part, sign in ((~more, 1), (more, -1)):
                t, o, b = tok[part], of[part], bucket[part]
                by = np.lexsort((o, b))
                t, o, b = t[by], o[by], b[by]
                cut = np.append(np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])), len(b)) if len(b) else np.zeros(1, np.int64)
                for x, y in zip(cut[:-1], cut[1:], strict=True):
                    docs, many = np.unique(o[x:y], return_counts=True)
                    spread += 1
                    out["bucket"].append(int(b[x]) if sign > 0 else -1 - int(b[x]) - (spread << bits))
                    out["docs"].append(sig[docs])
                    out["sizes"].append(size[docs])
                    out["many"].append(many)
                    out["tok"].append(_packed(t[x:y], bits))
            m = len(out["tok"])
            yield None, None, out | {"n": [0] * m, "sig": [0] * m, "docs": lists(out["docs"], np.int64), "sizes": lists(out["sizes"], np.int32), "many": lists(out["many"], np.int32)}

        empty = None
        for batch in batches:
            spread += 1
            rows = [], []
            for s in _sets(texts_of(batch.column(1)), n):
                with np.errstate(over="ignore"):
                    sig = int(mix(mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).reshape(1) + U(len(s)))[0].astype(np.int64)) if len(s) else 0
                rows[0].append(len(s))
                rows[1].append(sig)
                if len(s) and (sig, len(s)) not in known:
                    known.add((sig, len(s)))
                    toks.append(s)
                    sigs.append(sig)
                    sizes.append(len(s))
                    held += len(s)
                    if held >= FLUSH or len(toks) >= FLUSH_DOCS:
                        for _, _, cols in blobs():
                            yield empty_ids(batch, len(cols["n"])), None, cols
            m = batch.num_rows
            none = [None] * m
            spread += m
            yield batch, None, {"bucket": [-1 - ((spread - k) << bits) for k in range(m)], "n": rows[0], "sig": rows[1], "docs": none, "sizes": none, "many": none, "tok": none}
            empty = batch.slice(0, 0)
        if empty is not None:
            for _, _, cols in blobs():
                yield empty_ids(empty, len(cols["n"])), None, cols

    def empty_ids(batch: pa.RecordBatch, m: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(m, f.type) for f in batch.schema], schema=batch.schema)

    return run


def _shared(bits: int):
    """For each bucket, the entries of shingles that two or more sets hold; document rows go through.

    Memory follows the different shingles of a bucket, not how often one occurs:
    beyond HELD entries those of shingles known to be shared are given out.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        now, tok, sig, size, held, common = None, [], [], [], 0, np.zeros(0, np.uint64)

        def entries(t, s, z):
            """A row for each set, with its shared shingles of this bucket."""
            by = np.argsort(s, kind="stable")
            t, s, z = t[by], s[by], z[by]
            cut = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (z[1:] != z[:-1])]))
            toks = pa.ListArray.from_arrays(pa.array(np.append(cut, len(t)).astype(np.int32)), pa.array(t.view(np.int64)))
            return None, None, {"kind": pa.array(np.ones(len(cut), np.int32)), "toks": toks, "c": pa.array(s[cut]), "n": pa.array(z[cut].astype(np.int64))}

        def resolve(last: bool):
            nonlocal tok, sig, size, held, common
            if not sum(map(len, tok)):
                tok, sig, size, held, common = [], [], [], 0, np.zeros(0, np.uint64) if last else common
                return
            t, s, z = np.concatenate(tok), np.concatenate(sig), np.concatenate(size)
            order = np.lexsort((s, t))
            t, s, z = t[order], s[order], z[order]
            one = np.concatenate([[True], (t[1:] != t[:-1]) | (s[1:] != s[:-1])])
            t, s, z = t[one], s[one], z[one]
            new = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            many = np.diff(np.append(new, len(t)))
            hit = (many > 1) | np.isin(t[new], common)
            give = np.repeat(hit, many)
            if not last:
                common = np.union1d(common, t[new][hit])
            tok, sig, size = ([x[~give]] for x in (t, s, z))
            held = len(tok[0])
            if give.any():
                yield entries(t[give], s[give], z[give])
            if last:
                tok, sig, size, held, common = [], [], [], 0, np.zeros(0, np.uint64)

        for batch in batches:
            col = {k: batch.column(batch.schema.get_field_index(k)) for k in ("bucket", "n", "sig", "docs", "sizes", "many", "tok")}
            docs = np.flatnonzero(col["tok"].is_null().to_numpy(zero_copy_only=False))
            if len(docs):
                m = len(docs)
                yield batch, docs, {"kind": pa.array(np.zeros(m, np.int32)), "toks": [None] * m, "c": col["sig"].take(pa.array(docs)), "n": col["n"].take(pa.array(docs))}
            bucket = col["bucket"].to_numpy()
            for k in np.flatnonzero(~col["tok"].is_null().to_numpy(zero_copy_only=False)):
                b = int(bucket[k])
                many = col["many"][k].values.to_numpy()
                s, z = np.repeat(col["docs"][k].values.to_numpy(), many), np.repeat(col["sizes"][k].values.to_numpy(), many)
                if b < 0:
                    yield entries(_unpacked((-1 - b) & ((1 << bits) - 1), col["tok"][k].as_py(), bits), s, z)
                    continue
                if b != now:
                    yield from resolve(True)
                    now = b
                tok.append(_unpacked(b, col["tok"][k].as_py(), bits))
                sig.append(s)
                size.append(z)
                held += len(s)
                if held >= HELD:
                    yield from resolve(False)
                    held = min(held, HELD // 2)
        yield from resolve(True)

    def with_ids(batches):
        kept = None
        for batch, take, cols in run(remember(batches)):
            if batch is None:
                m = len(cols["n"])
                batch = pa.RecordBatch.from_arrays([pa.nulls(m, f.type) for f in remembered[0]], schema=remembered[0])
            yield batch, take, cols

    remembered: list = []

    def remember(batches):
        for b in batches:
            remembered[:] = [b.schema]
            yield b

    return with_ids


def _parity(batches: Iterator[pa.RecordBatch]):
    """A bit for each of PARITY hash classes: whether a set holds an odd number of its shared shingles."""
    for batch in batches:
        out = []
        for k in range(batch.num_rows):
            v = mix(batch.column(2)[k].values.to_numpy().view(np.uint64))
            out.append(np.packbits(np.bincount((v & U(PARITY - 1)).astype(np.int64), minlength=PARITY).astype(np.uint8) & 1).tobytes())
        yield batch, None, {"bits": out}


def _blocks(percent: int):
    """Pairs of documents of each two blocks that may be linked: (x, y), and whether a hub's answers prove it.

    x and y are of different components. They are skipped where their sizes, their
    places in the list's order, what both have in common with one hub, or the
    parities of their sets (two shingles at most cancel out in one class) leave no
    room for the overlap needed.
    """

    def solve(g: dict) -> tuple:
        left = np.flatnonzero(g["role"] != 1)
        same = g["role"][left[0]] == 2 if len(left) else False
        right = left if same else np.flatnonzero(g["role"] == 1)
        a, b = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
        keep = g["comp"][a] != g["comp"][b]
        if same:
            keep &= a < b
        a, b = a[keep], b[keep]
        nx, ny = g["n"][a], g["n"][b]
        need = -(-percent * (nx + ny) // (100 + percent))
        keep = (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & (np.minimum(nx - g["i"][a], ny - g["i"][b]) >= need)
        a, b, nx, ny, need = a[keep], b[keep], nx[keep], ny[keep], need[keep]
        ox, oy = g["o"][a], g["o"][b]
        known = (g["hub"][a] == g["hub"][b]) & (ox >= 0) & (oy >= 0)
        answered = (g["hub"][a] == g["c"][b]) & (ox >= 0) | (g["hub"][b] == g["c"][a]) & (oy >= 0)  # compared already, and not linked
        keep = ~answered & ~(known & (np.minimum(ox, oy) + np.minimum(nx - ox, ny - oy) < need))
        apart = np.bitwise_count(g["bits"][a[keep]] ^ g["bits"][b[keep]]).sum(axis=1).astype(np.int64)
        # shingles that one set alone holds are no part of the parities
        apart += g["alone"][a[keep]] + g["alone"][b[keep]]
        keep = np.flatnonzero(keep)[nx[keep] + ny[keep] - apart >= 2 * need[keep]]
        proven = known[keep] & (ox[keep] + oy[keep] - g["hub_n"][a[keep]] >= need[keep])
        return g["c"][a[keep]], g["c"][b[keep]], proven

    def run(batches: Iterator[pa.RecordBatch]):
        now, parts = None, []
        names = ("c", "n", "i", "comp", "hub", "hub_n", "o", "alone", "role")

        def solved():
            g = {k: np.concatenate([p[k] for p in parts]) for k in (*names, "bits")}
            x, y, p = solve(g)
            if len(x):
                yield None, None, {"x": pa.array(np.minimum(x, y)), "y": pa.array(np.maximum(x, y)), "proven": pa.array(p)}

        for batch in batches:
            col = {k: batch.column(batch.schema.get_field_index(k)).to_numpy() for k in (*names, "tok", "block")}
            col["bits"] = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("bits")).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            new = np.concatenate([[True], (col["tok"][1:] != col["tok"][:-1]) | (col["block"][1:] != col["block"][:-1])])
            cut = [*np.flatnonzero(new), batch.num_rows]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                at = col["tok"][a], col["block"][a]
                if at != now and parts:
                    yield from solved()
                    parts = []
                now = at
                parts.append({k: col[k][a:b] for k in (*names, "bits")})
        if parts:
            yield from solved()

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Link documents whose sets of n-word shingles have a Jaccard similarity of ``percent`` / 100 or more.

    Words are runs of what is not white space, A-Z lower-cased; a text with fewer
    than n words has one shingle. Equal sets are one set.

    Which shingles are shared: one scan sends every shingle with its set to a bucket
    by its hash, many in one row; a bucket gives out the entries of shingles of two
    or more sets. A set needs ``percent`` of its shingles shared to be linked at all,
    which leaves few: they are counted exactly, once more among themselves, and each
    is ordered by frequency, the rarest first. Its first ``1 - percent`` share is its
    prefix, of which shingles that no other set holds take the first places.

    Posting lists are cut into blocks by size band. Round one compares each posting
    with the hub of its list and band. Round two meets the blocks of lists that still
    hold several components, members of the largest one never with each other; pairs
    are skipped by size, by their places in the order, by the answers that both have
    from one hub (which also prove some), and by parities of their sets. What is left
    is compared on whole sets, so no link between different components is lost.

    Plan: one scan of the texts and one shuffle of 48-bit shingles; all later tables
    hold only sets that can be linked. Joins are by shingle or set, with nothing
    grouped on the same key, so Spark can split hot ones. Beyond the bits kept, two
    shingles differ but for a chance of 2**-50 or less.

    Null and empty texts, and texts of white space only, have n_shingles 0 and are
    linked with nothing: component_id is their own id. Null ids take part; a
    component's id is its smallest non-null id, null if it has none. Repeated rows
    are linked with each other; ties in size or frequency are broken by hash and
    change no result. Very long texts are hashed whole; a row holds one set. An
    empty table gives no rows. Other columns, whatever their names, take no part.

    Returns ``id_col``, n_shingles, component_id.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(4, math.ceil(math.log2(max(1, BUCKETS * parts))))
    sent = map_arrow(docs, ["id"], "bucket long, n long, sig long, docs array<long>, sizes array<int>, many array<int>, tok binary", _gather(n, bits))
    sent = sent.repartition("bucket").sortWithinPartitions("bucket")
    both = scratch.save(map_arrow(sent, ["id"], "kind int, toks array<long>, c long, n long", _shared(bits), rows=64), "shared")
    rows = both.filter("kind = 0").select("id", "c", "n")

    def likely(sets: DataFrame) -> DataFrame:
        return sets.filter(100 * F.size("toks").cast("long") >= percent * F.col("n"))

    sets = likely(both.filter("kind = 1").groupBy("c").agg(F.max("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("toks"))).alias("toks")))
    sets = scratch.save(sets, "sets0")
    for k in (1, 2):
        one = sets.select("c", "n", F.explode("toks").alias("tok"))
        held = scratch.save(one.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").withColumnRenamed("tok", "t"), f"held{k}")
        one = one.join(held, F.col("tok") == F.col("t"))
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("df", "tok"))), lambda x: x["tok"])
        sets = scratch.save(likely(one.groupBy("c").agg(F.max("n").alias("n"), ordered.alias("toks"))), f"sets{k}")
        scratch.drop(f"sets{k - 1}", f"held{k}")
    alone = F.col("n") - F.size("toks")
    reach = F.col("n") - F.ceil(percent * F.col("n") / F.lit(100) - 1e-9) + 1 - alone
    posts = sets.withColumn("alone", alone.cast("long")).select("c", "n", "alone", F.posexplode(F.slice("toks", F.lit(1), reach.cast("int"))).alias("i", "tok"))
    posts = posts.withColumn("i", (F.col("i") + F.col("alone")).cast("long"))
    band = F.floor(F.log(F.col("n")) / math.log(100 / percent) + 1e-9).cast("int")
    posts = scratch.save(posts.withColumn("band", band), "postings")

    need = F.ceil(percent * (F.col("n") + F.col("ny")) / F.lit(100 + percent) - 1e-9)
    fits = (100 * F.least("n", "ny") >= percent * F.greatest("n", "ny")) & (F.col("c") != F.col("cy")) & (F.least(F.col("n") - F.col("i"), F.col("ny") - F.col("iy")) >= need)
    # a list's hub in a band: the set with the fewest shingles of its own
    hubs = scratch.save(posts.groupBy("tok", "band").agg(F.min(F.struct("i", "c", "n")).alias("hub")), "hubs")
    near = hubs.select(F.col("tok").alias("t"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("near"), F.col("hub.c").alias("cy"), F.col("hub.n").alias("ny"), F.col("hub.i").alias("iy"))
    first = posts.join(near, (F.col("tok") == F.col("t")) & (F.col("band") == F.col("near")) & fits)
    first = scratch.save(first.select(F.least("c", "cy").alias("x"), F.greatest("c", "cy").alias("y")).distinct(), "pairs1")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """(x, y, o, linked): the overlap of the whole sets; shingles that are not shared overlap nowhere."""
        side = lambda k: sets.select(F.col("c").alias(f"c{k}"), F.col("n").alias(f"n{k}"), F.col("toks").alias(f"t{k}"))
        met = pairs.join(side("x"), F.col("x") == F.col("cx")).join(side("y"), F.col("y") == F.col("cy"))
        met = met.select("x", "y", "nx", "ny", F.size(F.array_intersect("tx", "ty")).cast("long").alias("o"))
        return scratch.save(met.select("x", "y", "o", (F.col("o") * (100 + percent) >= percent * (F.col("nx") + F.col("ny"))).alias("linked")), name)

    edge = lambda v: v.filter("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))
    done = verified(first, "overlaps1")
    comp = scratch.save(components(edge(done), scratch, "cc1"), "components1")

    member = comp.withColumnsRenamed({"v": "w", "component": "comp"})
    placed = posts.join(member, F.col("c") == F.col("w"), "left").withColumn("comp", F.coalesce("comp", "c")).drop("w")
    placed = scratch.save(placed, "placed")
    # a list's components: how many postings in all, and which component has the most
    kinds = placed.groupBy("tok", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("tok").agg(F.count(F.lit(1)).alias("comps"), F.sum("k").alias("all"), F.max(F.struct("k", "comp")).alias("most"))
    kinds = scratch.save(kinds.filter("comps > 1").select(F.col("tok").alias("t"), "all", F.col("most.k").alias("most"), F.col("most.comp").alias("main")), "open")
    lists_ = placed.join(kinds, F.col("tok") == F.col("t")).drop("t")
    of = hubs.select(F.col("tok").alias("t"), F.col("band").alias("b"), F.col("hub.c").alias("hub"), F.col("hub.n").alias("hub_n"))
    lists_ = lists_.join(of, (F.col("tok") == F.col("t")) & (F.col("band") == F.col("b"))).drop("t", "b")
    known = done.select(F.col("x").alias("p"), F.col("y").alias("q"), "o")
    lists_ = lists_.join(known, (F.least("c", "hub") == F.col("p")) & (F.greatest("c", "hub") == F.col("q")), "left").drop("p", "q")
    lists_ = lists_.withColumn("o", F.when(F.col("c") == F.col("hub"), F.col("n")).otherwise(F.coalesce("o", F.lit(-1))))
    bits_of = map_arrow(sets.select("c", "n", "toks"), ["c"], "bits binary", _parity).withColumnRenamed("c", "w")
    lists_ = lists_.join(bits_of, F.col("c") == F.col("w")).drop("w")
    blocks = lambda k: F.ceil(k / F.lit(BLOCK)).cast("int")
    rest, main = blocks(F.col("all") - F.col("most")), blocks(F.col("most"))
    salt = lambda m: F.pmod(F.xxhash64("c", "tok"), m).cast("int")
    one = lambda a, b, kind, role: F.struct((a.cast("long") * 2_000_000 + b * 2 + kind).alias("block"), F.lit(role).cast("int").alias("role") if isinstance(role, int) else role.alias("role"))
    mine = F.col("salt")
    to = lambda m: F.sequence(F.lit(0), m - 1)
    role = lambda b: F.when(b == mine, 2).when(mine < b, 0).otherwise(1).cast("int")
    places = F.when(F.col("comp") == F.col("main"), F.transform(to(rest), lambda a: one(a, mine, 1, 1))).otherwise(
        F.concat(F.transform(to(rest), lambda b: one(F.least(mine, b), F.greatest(mine, b), 0, role(b))), F.transform(to(main), lambda b: one(mine, b, 1, 0)))
    )
    lists_ = lists_.withColumn("salt", salt(F.when(F.col("comp") == F.col("main"), main).otherwise(rest)))
    lists_ = lists_.select("tok", "c", "n", "i", "comp", "hub", "hub_n", "o", "alone", "bits", F.inline(places))
    met = lists_.repartition("tok", "block").sortWithinPartitions("tok", "block")
    second = map_arrow(met, [], "x long, y long, proven boolean", _blocks(percent), rows=4096)
    second = scratch.save(second.groupBy("x", "y").agg(F.max("proven").alias("proven")), "pairs2")
    edges = edge(done).unionByName(second.filter("proven").select(F.col("x").alias("a"), F.col("y").alias("b")))
    edges = edges.unionByName(edge(verified(second.filter("NOT proven").select("x", "y"), "overlaps2")))
    comp = scratch.save(components(edges, scratch, "cc2"), "components2")

    # the smallest id of each component; joined to the rows by set, in tables of their own
    by_set = scratch.save(rows.filter("n > 0").groupBy("c", "n").agg(F.min("id").alias("least")), "by_set")
    by_set = by_set.join(comp.withColumnRenamed("v", "w"), F.col("c") == F.col("w"), "left").select("c", "n", "least", F.coalesce("component", "c").alias("comp"))
    least = scratch.save(by_set.groupBy("comp").agg(F.min("least").alias("component_id")), "least")
    by_set = scratch.save(by_set.join(least.withColumnRenamed("comp", "w"), F.col("comp") == F.col("w")).select(F.col("c").alias("s"), F.col("n").alias("z"), "component_id"), "labels")
    out = rows.filter("n > 0").join(by_set, (F.col("c") == F.col("s")) & (F.col("n") == F.col("z"))).select("id", "n", "component_id")
    out = out.unionByName(rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    scratch.drop("postings", "placed", "open", "hubs", "pairs1", "pairs2", "sets2", "by_set", "least")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


QUERIES = {"op9_jaccard_join": op9_jaccard_join}

SQL = {
    "op9_jaccard_join": """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
o AS (SELECT a.r AS x, b.r AS y, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT x, y FROM o JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * o >= 85 * (nx.n + ny.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(v, r) AS (SELECT r, r FROM d UNION SELECT e.y, reach.r FROM reach JOIN e ON reach.v = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(q.doc_id) AS component_id
FROM d LEFT JOIN n ON n.r = d.r JOIN reach ON reach.v = d.r JOIN d q ON q.r = reach.r GROUP BY d.r, d.doc_id, n.n
""",
}
