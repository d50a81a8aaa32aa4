"""Near-duplicates by an LSH forest of MinHash signatures (free style)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .components import components
from .kernels import LOWER, U64, column, mix, passes, shingles
from .native import narrow
from .repeats import _pack, unpack
from .store import cut, in_batches, tidy

SHINGLE = 5
#: Percent of the union that two sets of shingles must share.
PERCENT = 85
#: Sorted orders of the forest, values in each, and the least common prefix of neighbours.
TREES, DEPTH, LEAST = 16, 8, 4
#: Tables of at most so many rows of a few hashes are broadcast.
BROADCAST_KEYS = 200_000
#: What one task compares pair by pair: at most so many sets, of so many shingles in all.
MEMBERS, BLOCK = 1000, 300_000
#: Members of a linked group that stand for it in the next round.
SPEAKERS = 3
#: Columns of a block's matrix of shingles that are held at a time.
WIDE = 1024
_rng = np.random.RandomState(11)
_XOR = _rng.randint(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)
_MUL = (_rng.randint(0, 1 << 31, TREES * DEPTH, dtype=np.uint64) * 2 + 1).astype(np.uint32)


def lowered(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first row, past the last, distinct shingle hashes and their offsets, pass by pass."""
    buf, off = column(batch.column("text"))
    for a, z in passes(off):
        yield a, z, *shingles(LOWER[buf[off[a] : off[z]]], off[a : z + 1] - off[a], SHINGLE)


def set_digest(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits of each non-empty set, whatever its order: (sets, 2)."""
    return np.stack([np.add.reduceat(mix(v ^ U64(c)), first) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)], axis=1)


def signatures(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(sets, TREES * DEPTH) MinHash values of non-empty sets."""
    low = (v >> U64(32)).astype(np.uint32)
    out = np.empty((len(first), TREES * DEPTH), np.uint32)
    for i in range(TREES * DEPTH):
        out[:, i] = np.minimum.reduceat((low ^ _XOR[i]) * _MUL[i], first)
    return out


SIGNED = "doc_id long, _text_hash long, n_shingles long, node binary, keys array<long>, lead binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row its set's digest, the hash of the prefix of LEAST values in each sorted order, and all values of the first order."""
    salt = (np.arange(TREES, dtype=np.uint64) + U64(1)) * U64(0x9E3779B97F4A7C15)
    for batch in batches:
        for a, z, v, o in lowered(batch):
            n = np.diff(o)
            node, keys, lead = [None] * (z - a), [None] * (z - a), [None] * (z - a)
            have = np.flatnonzero(n)
            if len(have):
                first = o[have]
                values = signatures(v, first)
                trees = values.reshape(len(have), TREES, DEPTH)[:, :, :LEAST].astype(np.uint64)
                key = salt
                for d in range(LEAST):
                    key = mix(key ^ trees[:, :, d])
                for i, d, k, s in zip(have.tolist(), set_digest(v, first).astype(">u8"), key.view(np.int64), values[:, :DEPTH].astype(">u4"), strict=True):
                    node[i], keys[i], lead[i] = d.tobytes(), k, s.tobytes()
            part = batch.slice(a, z - a)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("_text_hash"), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(lead, pa.binary())], ["doc_id", "_text_hash", "n_shingles", "node", "keys", "lead"])


def packed(df: DataFrame) -> DataFrame:
    """The same rows with `text` compressed: less to shuffle and keep on disk where whole texts must move."""
    return in_batches(df, _pack, StructType([StructField(f.name, BinaryType()) if f.name == "text" else f for f in df.schema.fields]))


def unpacked(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                at = batch.schema.get_field_index("text")
                texts = pa.array([None if x is None else unpack(x).decode() for x in batch.column(at).to_pylist()], pa.string())
                yield pa.record_batch([texts if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return in_batches(df, run, StructType([StructField(f.name, StringType()) if f.name == "text" else f for f in df.schema.fields]))


def few(df: DataFrame, n: int, limit: int = BROADCAST_KEYS) -> DataFrame:
    """df, broadcast if it has few rows (of a few hashes each)."""
    return F.broadcast(df) if n <= limit else df


def sets_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Row and shingles of each packed text."""
    own = pa.record_batch([pa.array([unpack(x) for x in batch.column("text").to_pylist()], pa.binary())], ["text"])
    for a, z, v, o in lowered(own):
        for i in range(a, z):
            yield i, v[o[i - a] : o[i - a + 1]]


def crowds(nodes: DataFrame) -> DataFrame:
    """node, n_shingles, lead, _h, crowd, large: the nodes that share a region of any sorted order with others.

    A region is what has one prefix of LEAST values; regions with a common node are one crowd, which is large if one task can't
    compare it whole."""
    rows = nodes.select("node", F.explode("keys").alias("_key"))
    hubs = rows.groupBy("_key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.xxhash64("_key").alias("_d"), F.col("_key").alias("_k"), "a")
    # dealt anew, so that both sides of the join have a shuffle of their own and Spark may split a hot region
    stars = rows.join(hubs.repartition(F.col("_d")).drop("_d"), F.col("_key") == F.col("_k")).select("a", F.col("node").alias("b")).filter(F.col("a") != F.col("b")).distinct()
    label = nodes.select("node", F.struct(F.lit(0).alias("id"), "node").alias("label"))
    of = components(stars, label).select("node", F.col("label.node").alias("crowd"))
    of = cut(of.join(nodes.select("node", "n_shingles", "lead", "_h"), "node"))
    sizes = cut(of.groupBy("crowd").agg(too_many().alias("large")).filter("large").select(F.col("crowd").alias("_c"), "large"))
    return of.join(few(sizes, sizes.count()), F.col("crowd") == F.col("_c"), "left").drop("_c").withColumn("large", F.coalesce("large", F.lit(False)))


def too_many() -> Column:
    return (F.count(F.lit(1)) > MEMBERS) | (F.sum("n_shingles") > BLOCK)


def parts() -> Column:
    """How many tasks' worth the rows of a group are."""
    return F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(MEMBERS), F.sum("n_shingles") / F.lit(BLOCK))).cast("int")


def blocks(members: DataFrame) -> DataFrame:
    """node, block: the members of large crowds, each twice: dealt by hash, so that it meets many others, and in a sorted
    order told apart by prefixes that grow until what shares one is small, so that it meets those most like it.  What still isn't
    small with all values of the order is dealt by hash."""
    rows, depth = members.select("node", "n_shingles", "crowd", "lead"), 0
    sizes = cut(rows.groupBy(F.col("crowd").alias("_c")).agg(parts().alias("_k")))
    many = sizes.count()
    spread = rows.join(few(sizes, many), F.col("crowd") == F.col("_c")).select("node", F.xxhash64("crowd", F.pmod(F.xxhash64("node", F.lit(2)), F.col("_k"))).alias("block"))
    out = spread
    while True:
        depth += 2
        rows = rows.withColumn("block", F.xxhash64("crowd", F.substring("lead", 1, 4 * depth), F.lit(4)))
        hot = cut(rows.groupBy("block").agg(too_many().alias("_hot"), parts().alias("_k")).filter("_hot").select("block", "_k"))
        many = hot.count()
        out = out.unionByName((rows.join(few(hot, many), "block", "left_anti") if many else rows).select("node", "block"))
        if not many:
            return out
        rows = rows.join(few(hot, many), "block")
        if depth >= DEPTH:
            return out.unionByName(rows.select("node", F.xxhash64("block", F.pmod(F.xxhash64("node", F.lit(2)), F.col("_k"))).alias("block")))
        rows = rows.drop("block", "_k")


def alike(values: np.ndarray, off: np.ndarray, percent: int) -> np.ndarray:
    """Which of n sets (values[off[i] : off[i + 1]]) are alike enough: (n, n)."""
    n, size = len(off) - 1, np.diff(off)
    owner = np.repeat(np.arange(n), size)
    _, token, count = np.unique(values, return_inverse=True, return_counts=True)
    several = count > 1
    use = several[token]
    row, place = owner[use], (np.cumsum(several) - 1)[token[use]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    both = np.zeros((n, n), np.float32)  # exact: no set has 2 ** 24 shingles in common with another here
    for c in range(0, int(several.sum()), WIDE):
        lo, hi = np.searchsorted(place, (c, c + WIDE))
        dense = np.zeros((n, WIDE), np.float32)
        dense[row[lo:hi], place[lo:hi] - c] = 1
        both += dense @ dense.T
    size, out = size.astype(np.float64), np.empty((n, n), bool)
    for a in range(0, n, 100):  # some rows at a time
        part = both[a : a + 100].astype(np.float64)
        out[a : a + 100] = 100 * part >= percent * (size[a : a + 100, None] + size[None, :] - part)
    np.fill_diagonal(out, False)
    return out


def groups_of(linked: np.ndarray) -> np.ndarray:
    """For each member the first of its connected group."""
    out = np.full(len(linked), -1)
    for root in range(len(linked)):
        if out[root] < 0:
            out[root], stack = root, [root]
            while stack:
                new = np.flatnonzero(linked[stack.pop()] & (out < 0))
                out[new] = root
                stack += new.tolist()
    return out


LINKS = "a binary, b binary, speaks boolean"
_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("speaks", pa.bool_())])


def compared(rows: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """(node, block) and (node, text) -> a, b, speaks: each member b of a group linked within its block with the group's first member a.

    All pairs of a block meet, on full sets; a row for each member, so rows don't grow with the number of links.  The members
    with most links speak for a group."""

    def links(node: list[bytes], held: list[np.ndarray]) -> list[tuple]:
        linked = alike(np.concatenate(held), np.append(0, np.cumsum([len(x) for x in held])), percent)
        first, degree = groups_of(linked), linked.sum(1)
        order = np.lexsort((-degree, first))
        rank = np.arange(len(order)) - np.searchsorted(first[order], first[order])
        return [(node[first[i]], node[i], bool(r < SPEAKERS)) for i, r in zip(order.tolist(), rank.tolist(), strict=True) if degree[i]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, block, out = [], [], None, []
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                names, of = batch.column("node").to_pylist(), batch.column("block").to_pylist()
                for i, shingles_ in sets_of(batch):
                    if of[i] != block:
                        if len(node) > 1:
                            out += links(node, held)
                        node, held, block = [], [], of[i]
                    node.append(names[i])
                    held.append(shingles_.copy())  # not the whole pass
                if len(out) > 2000:
                    yield pa.record_batch([list(c) for c in zip(*out, strict=True)], schema=_LINKS)
                    out = []
        if len(node) > 1:
            out += links(node, held)
        if out:
            yield pa.record_batch([list(c) for c in zip(*out, strict=True)], schema=_LINKS)

    # a number of its own: a comparison costs far more than its bytes tell, so small partitions must not be merged
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = bodies.select("node", "text").join(rows, "node").repartition(tasks, "block").sortWithinPartitions("block")
    return in_batches(dealt, run, LINKS)


def crowd_links(members: DataFrame, bodies: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: links that connect all members of large crowds that are connected within blocks, and blocks by those who speak for their groups.

    Each round deals the speakers of the last anew, and ends when they fit one block or don't get fewer."""
    heads, before = cut(compared(cut(blocks(members)), bodies, percent)), None
    out = heads.select("a", "b")
    large = members.select("node", "crowd", "n_shingles")
    while True:
        rows = large.join(heads.filter("speaks").select(F.col("b").alias("node")).distinct(), "node")
        k = cut(rows.groupBy(F.col("crowd").alias("_c")).agg(parts().alias("_k"), F.count(F.lit(1)).alias("_n")))
        now = k.agg(F.sum("_n"), F.max("_k"), F.count(F.lit(1))).first()
        if not now[0] or (before is not None and 2 * now[0] > before):
            return out
        dealt = rows.join(few(k, now[2]), F.col("crowd") == F.col("_c")).select("node", F.xxhash64("crowd", F.pmod(F.xxhash64("node", F.lit(3)), F.col("_k"))).alias("block"))
        heads = cut(compared(dealt, bodies, percent))
        out = out.union(heads.select("a", "b"))
        if now[1] == 1:
            return out
        before = now[0]


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets of each crowd have each shingle, summed for some rows at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch, held = whole.slice(at, 2000), {}
            crowd = batch.column("crowd").to_pylist()
            for i, v in sets_of(batch):
                held.setdefault(crowd[i], []).append(v)
            for c, sets in held.items():
                value, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.record_batch([pa.array([c] * len(value), pa.int64()), pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], ["crowd", "g", "n"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            held = list(sets_of(batch))
            i, n = [i for i, _ in held], [len(v) for _, v in held]
            rows = pa.array(np.repeat(i, n).astype(np.int64))
            yield pa.record_batch([batch.column("crowd").take(rows), pa.array(np.concatenate([v for _, v in held]).view(np.int64)), batch.column("node").take(rows)], ["crowd", "g", "node"])


def rest_pairs(members: DataFrame, bodies: DataFrame, percent: int = PERCENT) -> DataFrame:
    """members (node, crowd, n_shingles, label) of large crowds and (node, text) -> a, b: the pairs of different labels that may yet be linked.

    Exact: two sets that are alike share one of their rarest shingles in the crowd, as many as may be missing plus one.  A set's
    shingles that no other has are among its rarest and make no pairs; nor do those of one label, so a connected group
    makes none, however large."""
    own = cut(bodies.select("node", "text").join(members.select("node", F.xxhash64("crowd").alias("crowd")), "node"))
    often = in_batches(own.select("crowd", "text"), _tallies, "crowd long, g long, n long").groupBy("crowd", "g").agg(F.sum("n").alias("n")).filter("n > 1")
    shared = in_batches(own, _shingles, "crowd long, g long, node binary").join(often.repartition(F.xxhash64("crowd", "g")), ["crowd", "g"])
    ranked = shared.groupBy("node").agg(F.first("crowd").alias("crowd"), F.sort_array(F.collect_list(F.struct("n", "g"))).alias("_t"))
    ranked = ranked.join(members.select("node", "n_shingles", "label"), "node")
    # the first of all its shingles are those of its own
    alone = F.col("n_shingles").cast("int") - F.size("_t")
    left = F.floor(F.col("n_shingles") * (100 - percent) / 100).cast("int") + 1 - alone
    some = F.transform(F.slice("_t", F.lit(1), F.greatest(left, F.lit(0))), lambda x, i: F.struct(x["g"].alias("g"), (i + alone).alias("i")))
    rare = cut(ranked.select("node", "crowd", "n_shingles", "label", F.explode(some).alias("_s")).select("node", "crowd", "n_shingles", "label", "_s.g", "_s.i"))
    live = rare.groupBy("crowd", "g").agg(F.min("label").alias("_x"), F.max("label").alias("_y")).filter("_x < _y").select("crowd", "g")
    rare = rare.join(live.repartition(F.xxhash64("crowd", "g")), ["crowd", "g"], "left_semi").repartition(F.xxhash64("node"))
    x = rare.select("crowd", "g", F.col("node").alias("a"), F.col("n_shingles").alias("_m"), F.col("label").alias("_x"), F.col("i").alias("_i"))
    y = rare.select(F.col("crowd").alias("_c"), F.col("g").alias("_g"), F.col("node").alias("b"), F.col("n_shingles").alias("_o"), F.col("label").alias("_y"), F.col("i").alias("_j"))
    # what is shared lies behind the first shingle that is
    enough = (100 + percent) * F.least(F.col("_m") - F.col("_i"), F.col("_o") - F.col("_j")) >= percent * (F.col("_m") + F.col("_o"))
    pairs = x.join(y, (F.col("crowd") == F.col("_c")) & (F.col("g") == F.col("_g")) & (F.col("a") < F.col("b")) & (F.col("_x") != F.col("_y")) & enough)
    return pairs.select("a", "b").distinct()


def confirmed(pairs: DataFrame, bodies: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                left, right = (dict(sets_of(pa.record_batch([batch.column(c)], ["text"]))) for c in ("_p", "_q"))
                both = [len(np.intersect1d(left[i], right[i], assume_unique=True)) for i in range(batch.num_rows)]
                good = [100 * n >= percent * (len(left[i]) + len(right[i]) - n) for i, n in enumerate(both)]
                yield pa.record_batch([batch.column(c).filter(pa.array(good, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    body = bodies.repartition(F.xxhash64("node"))  # so that Spark may split a hot node
    out = pairs.join(body.select(F.col("node").alias("a"), F.col("text").alias("_p")), "a").join(body.select(F.col("node").alias("b"), F.col("text").alias("_q")), "b")
    return in_batches(out, run, "a binary, b binary")


def whole_crowds(members: DataFrame, bodies: DataFrame, label: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node, label: of crowds that one task compares, the smallest label of each linked group; a group has all its links there."""
    stars = cut(compared(members.select("node", F.xxhash64("crowd").alias("block")), bodies, percent).select("a", "b"))
    least = stars.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("label"))
    return stars.join(least, "a").select(F.col("b").alias("node"), "label")


def split_crowds(members: DataFrame, bodies: DataFrame, label: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node, label: the same of large crowds; what blocks and their speakers leave apart is compared by its rarest shingles."""
    links = cut(crowd_links(members, bodies, percent))
    tidy(members.sparkSession)
    found = components(links, label)
    tidy(members.sparkSession)
    own = F.coalesce(F.col("label.node"), F.col("node")).alias("label")
    now = cut(members.select("node", "crowd", "n_shingles").join(found, "node", "left").select("node", "crowd", "n_shingles", own))
    apart = cut(now.groupBy("crowd").agg(F.min("label").alias("_x"), F.max("label").alias("_y")).filter("_x < _y").select("crowd"))
    if n := apart.count():
        pairs = cut(rest_pairs(cut(now.join(few(apart, n), "crowd")), bodies, percent))
        tidy(members.sparkSession)
        more = cut(confirmed(pairs, bodies, percent))
        if more.limit(1).count():
            return joined(found, now.select("node", F.col("label").alias("name")), more, label)
    return found


def joined(found: DataFrame, names: DataFrame, more: DataFrame, label: DataFrame) -> DataFrame:
    """found (node, label) after `more` links: only the groups (names: node, name) that these connect are gone through again."""
    end = lambda c: names.select(F.col("node").alias(c), F.col("name").alias(f"_{c}"))
    edges = cut(more.join(end("a"), "a").join(end("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
    top = components(edges, label).select(F.col("node").alias("_t"), "label")
    moved = cut(names.join(top, F.col("name") == F.col("_t")).select("node", "label"))
    return found.join(moved.select("node"), "node", "left_anti").unionByName(moved)


def clusters(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, _text_hash, _node, _head: a row for each row of docs.

    A document's set holds the distinct 5-word shingles of its lower-cased text; rows with equal sets are one node (an
    exact copy costs nothing more), nodes are linked where `percent` of the union is shared, component_id is the smallest
    doc_id of all rows of the nodes reached.  Null, empty and blank texts have no set: they stay alone and are kept.  Rows that repeat
    an id are kept or dropped together; a null id is never the smallest unless there is no other, and then its
    component is null and kept.  _node names the set, _head the set that has the smallest id (null: its own).  An empty table
    gives an empty one; other columns of docs are not read.

    Nodes that share a region of the forest are a crowd; all pairs of a small crowd meet in one task, and large crowds are
    compared part by part and then, exactly, by the rarest shingles of what isn't linked yet."""
    own = narrow(docs, "doc_id", "text").withColumn("_text_hash", F.xxhash64("text"))
    signed = cut(in_batches(own, _sign, SIGNED))
    nodes = signed.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("_id"), F.count(F.lit(1)).alias("_copies"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("lead").alias("lead"), F.min("_text_hash").alias("_h"))
    nodes = cut(nodes)
    members = cut(crowds(nodes))
    tidy(docs.sparkSession)
    none = (1 << 63) - 1
    label = nodes.select("node", F.struct(F.coalesce("_id", F.lit(none)).alias("id"), "node").alias("label"))
    if many := members.count():
        wanted = members.select(F.col("_h").alias("_text_hash"), "node")
        # one text for each member; texts travel packed
        texts = packed(own.filter(F.length("text") > 0).select("_text_hash", "text").join(few(wanted.select("_text_hash"), many), "_text_hash", "left_semi"))
        bodies = cut(texts.dropDuplicates(["_text_hash"]).join(wanted, "_text_hash").select("node", "text"))
        found = cut(whole_crowds(members.filter("NOT large"), bodies, label, percent))
        tidy(docs.sparkSession)
        large = members.filter("large")
        if large.limit(1).count():
            found = found.unionByName(split_crowds(large, bodies, label, percent))
    else:
        found = label.limit(0)
    several = nodes.filter(F.col("_copies") > 1).select("node", F.struct(F.coalesce("_id", F.lit(none)).alias("id"), "node").alias("_own"))
    groups = several.join(found, "node", "full_outer")
    groups = groups.select(F.col("node").alias("_node"), F.coalesce("label", "_own").alias("_least"))
    out = signed.drop("keys", "lead").join(groups, F.col("node") == F.col("_node"), "left")
    least = F.coalesce(F.nullif("_least.id", F.lit(none)), F.when(F.col("_least").isNull(), F.col("doc_id")))
    out = out.withColumn("component_id", least)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "_text_hash", F.col("node").alias("_node"), F.col("_least.node").alias("_head"))


def deduplicate(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of docs for each component, and all rows without words (null, empty and blank texts).

    The row that stays has the smallest doc_id; of rows that share it, that of the smallest hash of its text; of rows alike in
    both, any one.  An empty table gives an empty one; other columns, whatever their names, go with their row."""
    names = docs.columns
    found = cut(clusters(docs, percent).filter(F.col("n_shingles") > 0).drop("n_shingles"))
    head = F.col("kept") & F.coalesce(F.col("_node") == F.col("_head"), F.lit(True))
    heads = found.filter(head)
    best = heads.groupBy("_node").agg(F.min("_text_hash").alias("_best"))
    heads = heads.join(best, "_node")
    key = [F.col("doc_id").alias("_d"), F.col("_text_hash").alias("_h")]
    lost = found.filter(~head).select(*key).union(heads.filter(F.col("_text_hash") != F.col("_best")).select(*key)).distinct()
    out = packed(narrow(docs, *names).withColumn("_text_hash", F.xxhash64("text")))
    mine = out["doc_id"].eqNullSafe(F.col("_d")) & (F.col("_text_hash") == F.col("_h"))
    out = out.join(lost, mine, "left_anti")
    twice = cut(heads.filter(F.col("_text_hash") == F.col("_best")).groupBy(*key).count().filter("count > 1").select("_d", "_h"))
    if many := twice.count():  # rows alike in id and text: only these, not all texts, are brought together
        twice = few(twice, many)
        out = out.join(twice, mine, "left_anti").unionByName(out.join(twice, mine, "left_semi").dropDuplicates(["doc_id", "_text_hash"]))
    return unpacked(out.select(*names))
