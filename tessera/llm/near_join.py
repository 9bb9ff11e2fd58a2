"""N-gram Jaccard join: documents linked by the similarity of their shingle sets.

Equal sets are one node.  Nodes meet in lists: each node is listed under the
shingles of its prefix, the first size - ceil(0.8 * size) + 1 of its set in one
order for all documents, so that any two sets of Jaccard 0.8 share a listed
shingle.  Shingles known to be frequent come last in that order, which keeps
passages that many documents share out of the prefixes; which shingles count as
frequent changes the cost alone, never the result.

Two rounds keep large groups of copies linear.  Each list has a hub, its node in
most lists.  The first round verifies each node against one hub only, that of
most of its lists, and joins what it links.  The second takes the lists that
still hold several components; those of one hub are put together, so two nodes
that meet in many of them meet once.  Such a group is cut into blocks by its
size, each pair of blocks is a task's work, and a block's nodes form signature
trees, one for each width of bitmap: a tree node holds the OR of its members'
token bitmaps, the range of their sizes and the range of their components.  A
dual traversal drops a pair of tree nodes when no two members can be similar:
sizes too far apart, the largest possible overlap (bits in common, plus the most
tokens that share a bit with another) below what the smallest sizes need, or all
in one component already.  What is left is verified on whole sets.

Components are found by the large-star and small-star method over tables in the
shared folder; no link or component reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import drop_scratch, mix, released, shared, shingle_sets, stored, stored_at, tidy

#: Most frequent shingles put last in the order; a hint, broadcast at 8 bytes each.
MAX_FREQUENT = 1 << 20
#: Occurrences in one batch of texts at which a shingle is reported, and in all reports at which it counts as frequent.
REPORT_AT, FREQUENT_AT = 4, 24
#: Members of a leaf, and children of an inner node, of a signature tree.
FAN = 8
#: Bits of a signature for each token, at least; the number of bits is a power of two.
TOKEN_BITS = 8
#: Nodes, and tokens of their sets, of a block of a group.
BLOCK_NODES, BLOCK_TOKENS = 4096, 1 << 22
#: Bytes of signatures compared at once.
AT_ONCE = 8 << 20
#: Bits of the filter of rows whose texts are wanted.
FILTER_BITS = 1 << 26


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64), pa.int64())


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _digest(sums: np.ndarray) -> np.uint64:
    """Of a set: the sum of its scrambled members, scrambled again with its size."""
    return mix(np.array([mix(sums).sum(dtype=np.uint64) + np.uint64(len(sums))], dtype=np.uint64))[0]


# --- passes over the texts ----------------------------------------------------


@tidy
def _describe(batches, n):
    """A row (row, doc_id, size, h=set id) for each document; a row (null, null, occurrences, h=shingle) for each frequent one."""
    for batch in batches:
        sizes, digests, every = [], [], []
        for _, sets in shingle_sets(batch.column(2), n):
            sizes += [len(x) for x in sets]
            digests += [_digest(x) for x in sets]
            every += sets
        yield _batch(row=batch.column(0), doc_id=batch.column(1), size=pa.array(sizes, pa.int64()), h=_long(np.array(digests, dtype=np.uint64)), listed=pa.array([False] * len(sizes), pa.bool_()))
        value, count = np.unique(np.concatenate(every) if every else np.zeros(0, dtype=np.uint64), return_counts=True)
        value, count = value[count >= REPORT_AT], count[count >= REPORT_AT]
        none = pa.nulls(len(value), pa.int64())
        yield _batch(row=none, doc_id=none, size=pa.array(count, pa.int64()), h=_long(value), listed=pa.array([True] * len(value), pa.bool_()))


@tidy
def _list(batches, frequent, n, percent):
    """A row (key, size, set_id) for each shingle of each prefix."""
    frequent = np.sort(frequent.value)
    flags = np.zeros(1 << 22, dtype=bool)
    flags[(frequent & np.uint64(len(flags) - 1)).astype(np.int64)] = True
    for batch in batches:
        for _, sets in shingle_sets(batch.column(0), n):
            keys, owners = [], []
            sets = [x for x in sets if len(x)]
            for x in sets:
                need = len(x) - -(-percent * len(x) // 100) + 1
                maybe = flags[(x & np.uint64(len(flags) - 1)).astype(np.int64)]
                if maybe.any():
                    at = np.searchsorted(frequent, x[maybe])
                    maybe[maybe] = frequent[np.minimum(at, len(frequent) - 1)] == x[maybe]
                    first = x[~maybe][:need]
                    x = np.concatenate([first, x[maybe][: need - len(first)]])
                keys.append(x[:need])
            many = [len(k) for k in keys]
            sizes = np.repeat(np.array([len(x) for x in sets], dtype=np.int32), many)
            owners = np.repeat(np.array([_digest(x) for x in sets], dtype=np.uint64), many)
            yield _batch(key=_long(np.concatenate(keys) if keys else np.zeros(0)), size=pa.array(sizes, pa.int32()), set_id=_long(owners))


def _bits(ids: np.ndarray) -> list[np.ndarray]:
    h = mix(ids.astype(np.int64).view(np.uint64))
    return [((h >> np.uint64(s)) & np.uint64(FILTER_BITS - 1)).astype(np.int64) for s in (0, 32)]


def _pass(ids: pa.Array, wanted: np.ndarray) -> pa.Array:
    ids = ids.fill_null(-1).to_numpy()
    take = np.ones(len(ids), dtype=bool)
    for at in _bits(ids):
        take &= (wanted[at >> 3] >> (at & 7) & 1).astype(bool)
    return pa.array(take)


@tidy
def _texts(batches, wanted, n):
    """(set_id, text) of the rows (row, text) that pass the filter."""
    wanted = np.frombuffer(wanted.value, dtype=np.uint8)
    for batch in batches:
        batch = batch.filter(_pass(batch.column(0), wanted))
        for low, sets in shingle_sets(batch.column(1), n):
            yield _batch(set_id=_long(np.array([_digest(x) for x in sets], dtype=np.uint64)), text=batch.column(1)[low : low + len(sets)])


def narrowed(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows whose first column, a long, may be among ids: nearly all others are dropped where they are read."""
    wanted = shared(rows.sparkSession, _filter_of(ids))
    return rows.mapInArrow(lambda it: _taken(it, wanted, 0, True), rows.schema)


@tidy
def _taken(batches, wanted, at: int, inside: bool):
    """The rows whose column `at` passes the filter, or those where it does not."""
    bits = np.frombuffer(wanted.value, dtype=np.uint8)
    for batch in batches:
        passes = _pass(batch.column(at), bits)
        yield batch.filter(passes if inside else pc.invert(passes))


def _filter_of(ids: DataFrame) -> bytes:
    """Bitmap of FILTER_BITS bits in which those of all ids are set; its size does not depend on their number."""

    def part(batches):
        flags = np.zeros(FILTER_BITS, dtype=bool)
        for batch in batches:
            for at in _bits(batch.column(0).to_numpy()):
                flags[at] = True
        slices = np.packbits(flags, bitorder="little").reshape(64, -1)
        some = np.flatnonzero(slices.any(axis=1))
        yield _batch(at=pa.array(some, pa.int32()), bits=pa.array([slices[k].tobytes() for k in some], pa.binary()))

    def merge(batches):
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bits = np.frombuffer(bits, dtype=np.uint8)
                seen[at] = bits if at not in seen else seen[at] | bits
        yield _batch(at=pa.array(list(seen), pa.int32()), bits=pa.array([v.tobytes() for v in seen.values()], pa.binary()))

    kind = "at int, bits binary"
    out = np.zeros((64, FILTER_BITS // 8 // 64), dtype=np.uint8)
    for row in ids.coalesce(8).mapInArrow(part, kind).repartition(8, "at").mapInArrow(merge, kind).collect():
        out[row["at"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out.tobytes()


# --- lists --------------------------------------------------------------------


def _runs(batches, columns: int):
    """Whole runs of equal keys of batches that are sorted by column 0: lists of numpy columns and run starts."""
    left: list[np.ndarray] | None = None
    for batch in batches:
        now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(columns)]
        if left is not None:
            now = [np.concatenate(x) for x in zip(left, now, strict=True)]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))
        left = [x[cut:] for x in now]
        if cut:
            yield [x[:cut] for x in now]
    if left is not None and len(left[0]):
        yield left


@tidy
def _several(batches):
    """The distinct rows (key, size, set_id) of keys with several sets, from sorted rows."""
    for key, size, node in _runs(batches, 3):
        once = np.ones(len(key), dtype=bool)
        once[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (size[1:] != size[:-1])
        key, size, node = key[once], size[once], node[once]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        many = np.diff(np.append(start, len(key)))
        keep = np.repeat(many > 1, many)
        yield _batch(key=pa.array(key[keep]), size=pa.array(size[keep]), set_id=pa.array(node[keep]))


def hubs_of(members: DataFrame) -> DataFrame:
    """(key, hub, other, degree): the node of each list that is in most lists, its size and how many; for copies of a text it
    is the one that they come from."""
    degree = members.groupBy("set_id").agg(F.count("*").alias("degree"))
    hubs = members.join(degree, "set_id").groupBy("key").agg(F.max(F.struct("degree", "set_id", "size")).alias("hub"))
    return hubs.select("key", F.col("hub.set_id").alias("hub"), F.col("hub.size").alias("other"), F.col("hub.degree").alias("degree"))


def centres(named: DataFrame, percent: int) -> DataFrame:
    """(a, b): for a node of named(set_id, size, hub, other, degree) the hub of which it shares most lists."""
    near = 100 * F.least("size", "other").cast("long") >= percent * F.greatest("size", "other").cast("long")
    counted = named.where((F.col("set_id") != F.col("hub")) & near).groupBy("set_id", "hub").agg(F.count("*").alias("n"), F.max("degree").alias("degree"))
    return counted.groupBy("set_id").agg(F.max(F.struct("n", "degree", "hub")).getField("hub").alias("b")).select(F.col("set_id").alias("a"), "b")


class SignatureTree:
    """Of nodes in order of size: bitmaps of one width, size ranges, spare tokens and component ranges, by level."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, components: np.ndarray):
        spare = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, sizes, sizes, spare, components, components)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, spare, first, last = self.levels[-1]
            at = np.arange(0, len(bits), FAN)
            self.levels.append(
                (np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(spare, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at))
            )

    @property
    def width(self) -> int:
        return self.levels[0][0].shape[1]

    def halved(self) -> SignatureTree:
        """The tree of the same nodes with bitmaps of half the width."""
        bits, sizes, _, _, components, _ = self.levels[0]
        return SignatureTree(sizes, bits[:, : self.width // 2] | bits[:, self.width // 2 :], components)

    def pairs(self, other: SignatureTree, percent: int) -> np.ndarray:
        """Pairs (member, member of other) in different components whose largest possible overlap is enough; each once if other is this tree."""
        deep = [len(self.levels) - 1, len(other.levels) - 1]
        at = np.zeros((1, 2), dtype=np.int64)
        while True:
            x, y = self.levels[deep[0]], other.levels[deep[1]]
            run = max(64, AT_ONCE // self.width)
            at = np.concatenate([at[k : k + run][_possible(x, y, *at[k : k + run].T, percent)] for k in range(0, len(at), run)])
            if not len(at) or not any(deep):
                break
            more = [d > 0 and d == max(deep) for d in deep]
            fan = [np.arange(FAN if m else 1) for m in more]
            grid = np.stack(np.meshgrid(*fan, indexing="ij"), axis=-1).reshape(-1, 2)
            at = (at[:, None, :] * [FAN if m else 1 for m in more] + grid[None]).reshape(-1, 2)
            deep = [d - m for d, m in zip(deep, more, strict=True)]
            at = at[(at[:, 0] < len(self.levels[deep[0]][0])) & (at[:, 1] < len(other.levels[deep[1]][0]))]
            if other is self:
                at = at[at[:, 0] <= at[:, 1]]
            if not len(at):
                break
        return at[at[:, 0] != at[:, 1]] if other is self else at


def _possible(x: tuple, y: tuple, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether nodes a of level x and b of level y may have similar members in different components."""
    (bits_a, low_a, high_a, spare_a, first_a, last_a), (bits_b, low_b, high_b, spare_b, first_b, last_b) = x, y
    ok = (100 * high_a[a] >= percent * low_b[b]) & (100 * high_b[b] >= percent * low_a[a])
    ok &= (first_a[a] != last_a[a]) | (first_b[b] != last_b[b]) | (first_a[a] != first_b[b])
    a, b = a[ok], b[ok]
    common = np.bitwise_count(bits_a[a] & bits_b[b]).sum(axis=1).astype(np.int64) + np.minimum(spare_a[a], spare_b[b])
    # Jaccard p % of sets of x and y tokens: overlap >= p / (100 + p) * (x + y)
    ok[ok] = (100 + percent) * common >= percent * (low_a[a] + low_b[b])
    return ok


def bitmap(members: np.ndarray) -> bytes:
    """One bit for each member, in TOKEN_BITS as many bits, up to the next power of two, as there are members."""
    bits = 1 << max(6, int(TOKEN_BITS * len(members) - 1).bit_length())
    flags = np.zeros(bits, dtype=bool)
    flags[(mix(members) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


class Forest:
    """The signature trees of a block, one for each width of bitmap, with the nodes they hold."""

    def __init__(self, sizes: np.ndarray, nodes: np.ndarray, components: np.ndarray, bitmaps: list[bytes]):
        widths = np.array([len(b) for b in bitmaps])
        self.trees: dict[int, tuple[SignatureTree, np.ndarray]] = {}
        for width in np.unique(widths).tolist():
            at = np.flatnonzero(widths == width)
            at = at[np.lexsort((components[at], sizes[at]))]
            bits = np.frombuffer(b"".join(bitmaps[k] for k in at), dtype=np.uint8).reshape(len(at), width)
            self.trees[width] = SignatureTree(sizes[at], bits, components[at]), nodes[at]

    def pairs(self, other: Forest, percent: int):
        """(a, b) arrays of nodes.  Sets whose sizes differ by less than half have bitmaps of one width or of the next."""
        for width, (tree, nodes) in self.trees.items():
            for factor in (1, 2) if other is self else (0.5, 1, 2):
                second = other.trees.get(int(width * factor))
                if second is None:
                    continue
                x, y = tree.halved() if factor == 0.5 else tree, second[0].halved() if factor == 2 else second[0]
                found = x.pairs(y, percent)
                yield nodes[found[:, 0]], second[1][found[:, 1]]


@tidy
def _trees(batches, percent):
    """From rows (work, cross, side, size, node, component, signature), sorted by work: pairs of nodes that the trees leave."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        work = batch.column(0).to_numpy()
        cut = [0, *(np.flatnonzero(work[1:] != work[:-1]) + 1).tolist(), len(work)]
        for a, b in zip(cut, cut[1:], strict=False):
            if held and held[-1].column(0)[0].as_py() != work[a]:
                yield _tree_pairs(held, percent)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield _tree_pairs(held, percent)


def _tree_pairs(run: list[pa.RecordBatch], percent: int) -> pa.RecordBatch:
    run = pa.Table.from_batches(run).combine_chunks()
    cross, side, size, node, component = (run.column(k).to_numpy() for k in range(1, 6))
    bitmaps = run.column(6).to_pylist()
    part = lambda some: Forest(size[some].astype(np.int64), node[some], component[some], [bitmaps[k] for k in some])
    if cross.all():  # two blocks, each compared with itself elsewhere
        found = list(part(np.flatnonzero(side == 0)).pairs(part(np.flatnonzero(side == 1)), percent))
    else:
        forest = part(np.arange(len(size)))
        found = list(forest.pairs(forest, percent))
    a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, dtype=np.int64) for k in (0, 1))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return _batch(a=pa.array(pairs[:, 0]), b=pa.array(pairs[:, 1]))


def blocked(rows: DataFrame) -> DataFrame:
    """rows(hub, set_id, size, component) with work, cross, side: the pair of blocks of its group that a row is compared in.
    A group of up to BLOCK_NODES nodes is one block; a larger one gives each row to as many tasks as it has blocks."""
    many = rows.groupBy("hub").agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("size") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    dealt = rows.join(many, "hub").withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = F.xxhash64("hub", F.least("own", "with"), F.greatest("own", "with"))
    return dealt.select(work.alias("work"), (F.col("own") != F.col("with")).alias("cross"), (F.col("own") > F.col("with")).cast("int").alias("side"), "size", "set_id", "component")


# --- links --------------------------------------------------------------------


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have a Jaccard similarity of percent or more."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    common = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
    return len(y) > 0 and 100 * common >= percent * (len(x) + len(y) - common)


@tidy
def _verify(batches, percent, n):
    for batch in batches:
        for k in range(0, len(batch), 256):
            part = batch.slice(k, 256)
            x, y = ([s for _, some in shingle_sets(part.column(c), n) for s in some] for c in (2, 3))
            good = pa.array([similar(u, v, percent) for u, v in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(list(part.filter(good).columns[:2]), ["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame, percent: int, n: int) -> DataFrame:
    """The pairs (a, b) of set ids whose whole sets are similar.  Texts travel, as they take less room than their sets."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = narrowed(texts, ids)
    x = texts.select(F.col("set_id").alias("a"), F.col("text").alias("x"))
    y = texts.select(F.col("set_id").alias("b"), F.col("text").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(lambda it: _verify(it, percent, n), "a long, b long")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) of every node of edges(a, b): the smallest node reachable.  Each round is a table in the shared folder."""
    now, path = stored_at(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = None
    for _ in range(most):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after, new_path = stored_at(small, "links")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_scratch(now.sparkSession, path)
        now, path = after, new_path
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components not settled after {most} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).distinct()


# --- the operator -------------------------------------------------------------


def _classified(documents: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): (row, doc_id, size, set_id) of every document, row being a hash of id and text; (set_id, component, component_id) of every set that is not empty."""
    spark: SparkSession = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.select(row_key().alias("row"), "doc_id", "text")
    described = stored(texts.mapInArrow(lambda it: _describe(it, n), "row long, doc_id long, size long, h long, listed boolean"), "sets")
    rows = described.where("not listed").select("row", "doc_id", "size", F.col("h").alias("set_id"))
    often = described.where("listed").groupBy("h").agg(F.sum("size").alias("n")).where(F.col("n") >= FREQUENT_AT)
    often = often.orderBy(F.desc("n"), "h").limit(MAX_FREQUENT).select("h")
    frequent = shared(spark, np.array([x for b in often.toArrow().to_batches() for x in b.column(0).to_numpy()], dtype=np.int64).view(np.uint64))
    nodes = rows.where("size > 0").groupBy("set_id").agg(F.min("doc_id").alias("node"), F.min("row").alias("row"))

    listed = texts.select("text").mapInArrow(lambda it: _list(it, frequent, n, percent), "key long, size int, set_id long")
    listed = listed.repartition("key").sortWithinPartitions("key", "size", "set_id")
    members, members_path = stored_at(listed.mapInArrow(_several, "key long, size int, set_id long"), "lists")
    released(frequent)

    met = members.select("set_id").distinct().join(nodes, "set_id").select("row")
    wanted = shared(spark, _filter_of(met))
    words, words_path = stored_at(texts.select("row", "text").mapInArrow(lambda it: _texts(it, wanted, n), "set_id long, text string"), "texts")
    released(wanted)
    again = words.groupBy("set_id").agg(F.count("*").alias("times")).where("times > 1").select("set_id")
    if not again.isEmpty():  # repeated rows, or what the filter let through: one text for each set
        first_path, repeated = words_path, shared(spark, _filter_of(again))
        some = words.mapInArrow(lambda it: _taken(it, repeated, 0, True), words.schema).groupBy("set_id").agg(F.first("text").alias("text"))
        words, words_path = stored_at(words.mapInArrow(lambda it: _taken(it, repeated, 0, False), words.schema).union(some), "texts")
        drop_scratch(spark, first_path)
        released(repeated)

    named, named_path = stored_at(members.join(hubs_of(members), "key"), "hubs")
    drop_scratch(spark, members_path)
    links, links_path = stored_at(verified(stored(centres(named, percent), "centres"), words, percent, n), "first-links")
    found = stored(components(links), "components")
    drop_scratch(spark, links_path)

    grouped = named.join(found.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    open_keys = grouped.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    rest, rest_path = stored_at(grouped.join(open_keys, "key", "left_semi").select("hub", "set_id", "size", "component").distinct(), "open")
    drop_scratch(spark, named_path)
    signed = narrowed(words, rest.select("set_id").distinct()).mapInArrow(lambda it: _sign(it, n), "set_id long, signature binary")
    trees = blocked(rest).join(signed, "set_id").select("work", "cross", "side", "size", F.col("set_id").alias("node"), "component", "signature")
    trees = trees.repartition("work").sortWithinPartitions("work")
    pairs, pairs_path = stored_at(trees.mapInArrow(lambda it: _trees(it, percent), "a long, b long").distinct(), "pairs")
    more, more_path = stored_at(verified(pairs, words, percent, n), "more-links")
    drop_scratch(spark, words_path, rest_path, pairs_path)
    # only links across components are left, so the components themselves are the nodes now
    name = found.select(F.col("node").alias("a"), F.col("component").alias("x"))
    across = more.join(name, "a", "left").select(F.coalesce("x", "a").alias("a"), "b")
    across = across.join(name.select(F.col("a").alias("b"), F.col("x").alias("y")), "b", "left").select("a", F.coalesce("y", "b").alias("b"))
    merged = stored(components(across).select(F.col("node").alias("component"), F.col("component").alias("whole")), "merged")
    drop_scratch(spark, more_path)
    linked = found.join(merged, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    alone = merged.select(F.col("component").alias("node"), F.col("whole").alias("component")).join(found, "node", "left_anti")
    linked = linked.union(alone).select(F.col("node").alias("set_id"), "component")

    # equal sets, then components, by the smallest document of each
    classes = nodes.join(linked, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    least = classes.groupBy("component").agg(F.min("node").alias("component_id"))
    return rows, stored(classes.join(least, "component").select("set_id", "component", "component_id"), "classes")


def row_key():
    """A hash of doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def near_duplicates(documents: DataFrame, *, n: int = 5, percent: int = 80) -> DataFrame:
    """Per row of documents(doc_id, text): doc_id, n_shingles, component_id.

    Rows link when 100 * |A & B| >= percent * |A | B| for their sets of n-word
    shingles (A-Z lower-cased; 1 to n-1 words: the whole sequence).
    component_id is the smallest doc_id reachable by links, the row's own
    included.  Null, empty and wordless texts have no shingle and link with
    nothing; equal texts always share a component; repeated rows and ids are
    kept; rows with a null id link like any other and get the component of their
    group, or null where no row of it has an id.  Other columns are ignored and
    an empty table gives no rows.
    """
    rows, classes = _classified(documents, n, percent)
    joined = rows.join(classes, "set_id", "left")
    return joined.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


@tidy
def _sign(batches, n):
    for batch in batches:
        for low, sets in shingle_sets(batch.column(1), n):
            yield _batch(set_id=batch.column(0)[low : low + len(sets)], signature=pa.array([bitmap(x) for x in sets], pa.binary()))


def one_of_each(documents: DataFrame, *, n: int = 5, percent: int = 80) -> DataFrame:
    """documents with one row of each component of near_duplicates(): that of the smallest doc_id, null after all others, and
    of rows that share it one by a hash of the text, and one of rows that agree in id and text.

    Rows without shingles stay, repeated or not.  Columns are unchanged, also
    where their names are those used here.  An empty table gives no rows.  Rows
    are dropped by id and text together, so a repeated id takes no other row
    along.  A filter of fixed size tells where a row is read whether it may have
    to go; only such rows are moved.
    """
    spark, columns = documents.sparkSession, documents.columns
    rows, classes = _classified(documents, n, percent)
    rank = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")
    sized = rows.where("size > 0").join(classes, "set_id").withColumn("rank", rank)
    first = sized.groupBy("component").agg(F.min("rank").alias("kept"))
    judged = sized.join(first, "component").select("row", "doc_id", "set_id", (F.col("rank") == F.col("kept")).alias("stays"))
    # one line for each (id, text): whether it stays, and whether more than one row has it
    judged = judged.groupBy("row", "doc_id", "set_id").agg(F.first("stays").alias("stays"), F.count("*").alias("times")).where("not stays or times > 1")
    judged = stored(judged.select("row", "doc_id", "stays"), "judged")
    wanted = shared(spark, _filter_of(judged.select("row")))
    plain = [f"c{k}" for k in range(len(columns))]
    keyed = documents.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("id"), *(F.col(f"`{c}`").alias(p) for c, p in zip(columns, plain, strict=True)))
    clear = keyed.mapInArrow(lambda it: _taken(it, wanted, 0, False), keyed.schema)
    unsure = keyed.mapInArrow(lambda it: _taken(it, wanted, 0, True), keyed.schema)
    told = judged.select(F.col("row").alias("judged_row"), F.col("doc_id").alias("judged_id"), "stays")
    unsure = unsure.join(told, (F.col("row") == F.col("judged_row")) & F.col("id").eqNullSafe(F.col("judged_id")), "left")
    once = unsure.where("stays").dropDuplicates(["row", "id"])
    kept = clear.select(*plain).unionByName(unsure.where("stays is null").select(*plain)).unionByName(once.select(*plain))
    return kept.select(*(F.col(p).alias(c) for c, p in zip(columns, plain, strict=True)))


__all__ = ["Forest", "SignatureTree", "bitmap", "components", "near_duplicates", "one_of_each", "verified"]
