"""N-gram Jaccard join by chosen paths.

A document is its set of shingles of five words.  Documents with the same set
are one class from the start.  In each run every class walks down a tree: a node
picks one or two of SAMPLES random orders of all shingles, and a class goes to
the child named by its first shingle in that order, a shingle that it shares
with whatever else goes there.  After LEVELS levels nodes are looked at:

* Nodes of up to SMALL classes are compared by brute force: all pairs whose
  samples agree in a share of ALIKE at least are tied.
* In larger nodes a class is heavy if its samples agree with those of the node's
  classes in a share of HEAVY on average, from its part of the node of about PART
  classes.  Heavy classes are done: they are tied with all that are NEAR the node
  on average, and whoever is similar to a heavy class is near.  The others split
  again, LEVELS levels at a time, as deep as it takes.

The number of runs follows from the wanted recall of a pair that is just similar
enough, for each depth by itself: classes that split walk further runs from the
root, as many as their new depth needs.

What is tied together is then compared exactly, in blocks of bounded size that
are shipped whole; only counts and spanning links leave a pair of blocks.

Contract.  Words are runs of anything but ASCII white space, unchanged.  Texts
of one to four words have one shingle, all their words; texts without words
(null, empty) have no links and are classes of their own.  class_id is the
smallest doc_id of the connected documents, nulls last; n_links counts the other
documents of similarity MIN or more, copies and repeated rows included.  Extra
columns are not read, or kept by one_of_each() whatever their names.  An empty
table gives no rows.  Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, matched, written
from ._text import P1, Words, mix, slices, span_hash

SHINGLE = 5
#: Similarity as a fraction, so that comparisons are of whole numbers.
NUMERATOR, DENOMINATOR = 4, 5
SAMPLES = 128
#: Levels between two looks at nodes; nodes of up to SMALL classes are compared by brute force.
LEVELS, SMALL = 3, 256
#: Chance that a node picks a second order; the expected similar children of a just similar pair are then 1.
SECOND = DENOMINATOR / NUMERATOR - 1
RECALL = 0.9999
#: Share of equal samples from which two classes are tied: 5.7 deviations below that of a just similar pair.
ALIKE = 0.6
#: Mean shares of heavy and of near classes; a set similar to a heavy one is 0.2 less heavy at most.
HEAVY, NEAR, PART = 0.7, 0.4, 4096
#: Shingles and sets of a block of exact comparison.
BLOCK_SHINGLES, BLOCK_SETS = 250_000, 512

_ORDERS = np.random.default_rng(5).integers(1, 1 << 63, (2, SAMPLES), dtype=np.uint64) | np.uint64(1)


def runs_for(depth: int = LEVELS, recall: float | None = None) -> int:
    """Runs after which a pair of least similarity shares a node at depth with this chance.

    All runs pick from the same SAMPLES orders, so they are independent only given the number of orders
    in which the pair agrees; the loss is the mean over that number.  The k-th depth may lose 1 / (k (k + 1))
    of what RECALL lets go, so that all of them together lose no more.
    """
    if recall is None:
        look = depth // LEVELS
        recall = 1 - (1 - RECALL) / (look * (look + 1))
    s, k = NUMERATOR / DENOMINATOR, np.arange(SAMPLES + 1)
    chance = np.array([math.comb(SAMPLES, int(x)) * s**x * (1 - s) ** (SAMPLES - x) for x in k])
    second, lost = SECOND * (1 - 1 / SAMPLES), np.zeros(SAMPLES + 1)
    for _ in range(depth):
        one = 1 - k / SAMPLES * (1 - lost)
        other = SAMPLES - k
        two = (other * (other - 1) + 2 * k * other * lost + k * (k - 1) * lost * lost) / (SAMPLES * (SAMPLES - 1))
        lost = (1 - second) * one + second * two
    runs = 1
    while chance @ lost**runs > 1 - recall:
        runs += 1
    return runs


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of a slice of texts in order, and where each text's begin."""
    counts = w.counts()
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(sizes)])
    starts = np.arange(int(at[-1])) - np.repeat(at[:-1] - w.first[:-1], sizes)
    ends = np.minimum(starts + SHINGLE, np.repeat(w.first[1:], sizes))
    return span_hash(w.hashes(P1), starts, ends), at


def unique_sets(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(at)))


def samples(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """16 bits of the first shingle in each order, of those that vary most, for texts that have any."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(full), SAMPLES), np.uint16)
    if len(full):
        for k in range(SAMPLES):
            x = h * _ORDERS[0, k] + _ORDERS[1, k]
            out[:, k] = np.minimum.reduceat(x, at[full]) >> np.uint64(32) & np.uint64(0xFFFF)
    return out


SETS = "doc_id long, id_a long, id_b long, set_id long, n long, sample binary"


def _sets(docs: DataFrame) -> DataFrame:
    """A row per document: its ids, the hash and size of its set, and its sampled shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(3)):
                part = batch.slice(a, b - a)
                h, at = unique_sets(*shingles(Words(part.column(3))))
                full = np.diff(at) > 0
                blob = samples(h, at).astype("<u2").tobytes()
                size = SAMPLES * 2
                place = np.cumsum(full) - 1
                sample = [blob[p * size : (p + 1) * size] if f else None for p, f in zip(place.tolist(), full.tolist(), strict=True)]
                name = span_hash(h, at[:-1], at[1:]).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(name, mask=~full), pa.array(np.diff(at)), pa.array(sample, pa.binary())], names=["doc_id", "id_a", "id_b", "set_id", "n", "sample"])

    return docs.select("doc_id", "id_a", "id_b", "text").mapInArrow(run, SETS)


def descend(node: np.ndarray, sample: np.ndarray, row: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that rows reach from their nodes after some levels: (row numbers, nodes)."""
    for _ in range(levels):
        z = mix(node)
        one = (z >> np.uint64(8)) % np.uint64(SAMPLES)
        two = (z >> np.uint64(24)) % np.uint64(SAMPLES)
        more = ((z >> np.uint64(40)).astype(np.float64) / 2.0**24 < SECOND) & (one != two)
        row_2 = np.concatenate([row, row[more]])
        order = np.concatenate([one, two[more]]).astype(np.int64)
        before = np.concatenate([node, node[more]])
        node = mix(before ^ mix(sample[row_2, order].astype(np.uint64) + (order.astype(np.uint64) << np.uint64(33))))
        row = row_2
    return row, node


def _paths(classes: DataFrame, levels: int, runs: range | None) -> DataFrame:
    """(node, set_id) after levels more levels; from the roots of these runs, or from classes' own node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 4096):
                part = batch.slice(a, 4096)
                sample = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(-1, SAMPLES)
                if runs is None:
                    row, node = np.arange(len(part)), part.column(2).to_numpy().view(np.uint64)
                else:
                    row = np.tile(np.arange(len(part)), len(runs))
                    node = np.repeat(mix(np.arange(runs.start + 1, runs.stop + 1, dtype=np.uint64)), len(part))
                row, node = descend(node, sample, row, levels)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), part.column(0).take(pa.array(row))], names=["node", "set_id"])

    columns = ["set_id", "sample"] + (["node"] if runs is None else [])
    return classes.select(*columns).mapInArrow(run, "node long, set_id long").dropDuplicates(["node", "set_id"])


def forest(n: int, edges) -> list[tuple[int, int]]:
    """Edges that join what earlier ones have not joined: at most n - 1, with the same components."""
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in edges:
        p, q = top(x), top(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of rows with equal values in the first columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(len(batch), bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        new[0] = bool(held) and any(c[0] != held[-1].column(k)[len(held[-1]) - 1].as_py() for k, c in enumerate(columns))
        at = np.flatnonzero(new)
        bounds = [0, *at.tolist(), len(batch)]
        for j, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if j:
                if held:
                    yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def alike(sample: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of rows that agree in a share of ALIKE of their samples."""
    for i in range(len(sample) - 1):
        for j in np.flatnonzero((sample[i + 1 :] == sample[i]).sum(axis=1) >= ALIKE * sample.shape[1]):
            yield i, i + 1 + int(j)


def mean_share(sample: np.ndarray) -> np.ndarray:
    """For each row the mean share of samples in which it agrees with the other rows."""
    total = np.zeros(len(sample))
    for column in sample.T:
        _, place, count = np.unique(column, return_inverse=True, return_counts=True)
        total += count[place] - 1
    return total / (sample.shape[1] * max(1, len(sample) - 1))


def _looked_at(rows: DataFrame) -> DataFrame:
    """(node, a, b, kind) of rows (node, part, set_id, size, sample): ties of small nodes have no kind.

    In large nodes a is a class, b what it is tied to if the node has a heavy class, kind 2 for heavy, 1 for near, 0 else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 2):
            ids = group.column("set_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            sample = np.frombuffer(b"".join(group.column("sample").to_pylist()), "<u2").reshape(-1, SAMPLES)[order]
            node = group.column("node")[0].as_py()
            if group.column("size")[0].as_py() <= SMALL:
                ties = np.array(forest(len(ids), alike(sample)), np.int64).reshape(-1, 2)
                a, b, kind = pa.array(ids[ties[:, 0]]), pa.array(ids[ties[:, 1]]), pa.nulls(len(ties), pa.int32())
            else:
                share = mean_share(sample)
                kinds = (share >= NEAR).astype(np.int32) + (share >= HEAVY)
                near = np.flatnonzero(kinds)
                # Near classes hang on the first of their part, and that on the node itself.
                to = np.full(len(ids), ids[near[0]] if len(near) else 0)
                if len(near):
                    to[near[0]] = mix(np.array([node], np.int64).view(np.uint64)).view(np.int64)[0]
                a, b, kind = pa.array(ids), pa.array(to, mask=kinds == 0), pa.array(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), node)), a, b, kind], names=["node", "a", "b", "kind"])

    # A shuffle by both keys: no more than about PART rows share them.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("node", "part", "set_id", "size", "sample")
    return rows.repartition(n, "node", "part").sortWithinPartitions("node", "part").mapInArrow(run, "node long, a long, b long, kind int")


def _ties(classes: DataFrame) -> DataFrame:
    """(a, b): edges that join classes (set_id, sample) which meet in a node and look alike; ends may be nodes as well."""
    samples_of = classes.select("set_id", "sample")
    out, own, begun, depth, again = None, None, 0, 0, samples_of
    while True:
        depth += LEVELS
        runs = runs_for(depth)
        paths = _paths(again, depth, range(begun, runs))
        found = written(paths if own is None else paths.unionByName(_paths(own, LEVELS, None)))
        begun = runs
        sizes = written(found.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
        rows = matched(found, sizes, ["node"], "size").join(samples_of, "set_id")
        part = F.when(F.col("size") <= SMALL, F.lit(0)).otherwise(F.pmod(F.xxhash64("set_id", "node"), F.ceil(F.col("size") / PART)))
        looked = written(_looked_at(rows.withColumn("part", part.cast("long"))))
        small = looked.where("kind IS NULL").select("a", "b")
        heavy = written(looked.where("kind > 0").groupBy("node").agg(F.count(F.lit(1)).alias("near"), F.max("kind").alias("most")).where("most = 2").select("node", "near"))
        hung = matched(looked.where("kind > 0").select("node", "a", "b"), heavy, ["node"], "near").select("a", "b")
        ties = written(small.unionByName(hung).distinct())
        out = ties if out is None else out.unionByName(ties)
        split = written(looked.where("kind < 2").select("node", F.col("a").alias("set_id")))
        discard(found, sizes, looked, heavy)
        if split.isEmpty():
            return out
        own = split.join(samples_of, "set_id")
        # A pair that meets in split nodes alone needs the runs of the next depth.
        again = samples_of.join(split.select("set_id").distinct(), "set_id", "left_semi")


def _pairs(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct edges between different ends, the smaller first."""
    ends = edges.selectExpr(f"least({a}, {b}) AS a", f"greatest({a}, {b}) AS b")
    return written(ends.where("a < b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each connected component of edges (a, b).

    In each round every vertex goes to its smallest neighbour, if that is smaller than itself,
    and then to where that one goes; edges are renamed and made distinct, so they get few soon.
    """
    pairs = _pairs(edges, "a", "b")
    label = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("root"))
    while not pairs.isEmpty():
        up = pairs.groupBy("b").agg(F.min("a").alias("to"))
        up = written(up.withColumnRenamed("b", "from"))
        over = up.select(F.col("from").alias("to"), F.col("to").alias("further"))
        up = written(up.join(over, "to", "left").select("from", F.coalesce("further", "to").alias("to")))
        label = written(label.join(up, label["root"] == up["from"], "left").select("id", F.coalesce("to", "root").alias("root")))
        ends = pairs.join(up, pairs["a"] == up["from"], "left").select(F.coalesce("to", "a").alias("a"), "b")
        ends = ends.join(up, ends["b"] == up["from"], "left").select("a", F.coalesce("to", "b").alias("b"))
        pairs = _pairs(ends, "a", "b")
    return label


def similar_pairs(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of whether two sets are similar enough, exactly."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    row = np.cumsum(new) - 1
    shared = np.bincount(row)[row] > 1  # hashes of one set alone add nothing
    row, owner = row[shared], owner[shared]
    common = np.zeros((len(sets), len(sets)), np.float64)
    step = 4096
    if len(row):
        row = np.cumsum(np.concatenate([[0], np.diff(row) != 0])).astype(np.int64)
        bounds = np.searchsorted(row, np.arange(0, int(row[-1]) + step, step))
        for a, b in zip(bounds, np.append(bounds[1:], len(row)), strict=True):
            if b > a:
                m = np.zeros((step, len(sets)), np.float32)
                m[row[a:b] - row[a] // step * step, owner[a:b]] = 1
                common += m.T @ m
    # common / (n + m - common) >= NUMERATOR / DENOMINATOR
    return (NUMERATOR + DENOMINATOR) * common >= NUMERATOR * (sizes[:, None] + sizes[None, :])


FOUND = "a long, b long, links long"
BLOCKS = "root long, blocks int, block int, ids array<long>, copies array<long>, shingles array<binary>"


def _links(ids: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], own: np.ndarray | None) -> list[pa.Array]:
    """Columns a, b, links of the sets of a block, or of two blocks (own tells which): links between those only."""
    same = similar_pairs(sets)
    np.fill_diagonal(same, False)
    if own is not None:
        same &= own[:, None] != own[None, :]
    links = same @ copies
    spanning = np.array(forest(len(ids), zip(*(x.tolist() for x in np.nonzero(np.triu(same))), strict=True)), np.int64).reshape(-1, 2)
    some = np.flatnonzero(links)
    a = np.concatenate([ids[some], ids[spanning[:, 0]]])
    b = np.concatenate([np.zeros(len(some), np.int64), ids[spanning[:, 1]]])
    counted = np.arange(len(a)) < len(some)
    return [pa.array(a), pa.array(b, mask=counted), pa.array(np.concatenate([links[some], np.zeros(len(spanning), np.int64)]))]


def _verified(rows: DataFrame) -> DataFrame:
    """(a, b, links): with b null, links of class a counted in one block; with b, a link of a spanning forest.

    rows has root, blocks, set_id, copies and shingles (sorted 64-bit hashes).  What is tied together and fits a
    block is compared where its rows meet.  Of larger groups every block becomes one row, and these rows are paired.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("set_id", F.lit(1)), F.col("blocks")).cast("int")).select("root", "block", "blocks", "set_id", "copies", "shingles")

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "links", "root", "blocks", "block", "ids", "copies", "shingles"]
        types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.binary())]
        for group in _groups(batches, 2):
            ids, copies, blobs = group.column("set_id").to_numpy(), group.column("copies").to_numpy(), group.column("shingles").to_pylist()
            if group.column("blocks")[0].as_py() == 1:
                columns = _links(ids, copies, [np.frombuffer(x, "<u8") for x in blobs], None)
                columns += [pa.nulls(len(columns[0]), t) for t in types[3:]]
            else:
                columns = [pa.nulls(1, t) for t in types[:3]]
                columns += [pa.array([x], t) for x, t in zip([*(group.column(c)[0].as_py() for c in ("root", "blocks", "block")), ids, copies, blobs], types[3:], strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    first = written(dealt.repartition(n, "root", "block").sortWithinPartitions("root", "block").mapInArrow(gathered, f"{FOUND}, {BLOCKS}"))
    blocks = first.where("ids IS NOT NULL").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "ids", "copies", "shingles")

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            ids, copies = (group.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "copies"))
            sets = [np.frombuffer(x, "<u8") for blobs in group.column("shingles").to_pylist() for x in blobs]
            own = np.repeat(np.arange(len(group)), [len(x) for x in group.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays(_links(ids, copies, sets, own if len(group) > 1 else None), names=["a", "b", "links"])

    between = blocks.repartition(n, "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(paired, FOUND)
    return first.where("a IS NOT NULL").select("a", "b", "links").unionByName(between)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"id_a": F.xxhash64("doc_id", text), "id_b": F.xxhash64(text, F.lit(7), "doc_id")})


def _classed(keyed: DataFrame) -> DataFrame:
    """keyed (doc_id, id_a, id_b, text) as doc_id, id_a, id_b, set_id, root, links: its set's component and links."""
    sets = written(_sets(keyed))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "id_a", "id_b")).alias("one")
    classes = written(sets.where("set_id IS NOT NULL").groupBy("set_id").agg(F.count(F.lit(1)).alias("copies"), one, F.first("sample").alias("sample"), F.first("n").alias("n")))
    ties = written(_ties(classes))
    near = components(ties)
    members = written(near.withColumnRenamed("id", "set_id").join(classes.select("set_id", "n", "copies", "one.id_a", "one.id_b"), "set_id"))
    blocks = F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count(F.lit(1)) / BLOCK_SETS)).cast("int")
    groups = written(members.groupBy("root").agg(F.count(F.lit(1)).alias("size"), blocks.alias("blocks")).where("size > 1"))
    members = matched(members, groups, ["root"], "size").select("root", "blocks", "set_id", "copies", "id_a", "id_b")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(4)):
                part = batch.slice(a, b - a)
                h, at = unique_sets(*shingles(Words(part.column(4))))
                blob = h.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([blob[8 * x : 8 * y] for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["root", "blocks", "set_id", "copies", "shingles"])

    own = keyed.select("id_a", "id_b", "text").join(members, ["id_a", "id_b"]).select("root", "blocks", "set_id", "copies", "text")
    rows = own.mapInArrow(shingled, "root long, blocks int, set_id long, copies long, shingles binary")
    # A repeated row of the same doc_id and text stands once for its class.
    several = not sets.groupBy("id_a", "id_b").count().where("count > 1").isEmpty()
    rows = rows.dropDuplicates(["set_id"]) if several else rows
    found = written(_verified(rows))
    links = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "set_id")
    joined = components(found.where("b IS NOT NULL").select("a", "b")).withColumnsRenamed({"id": "set_id", "root": "joined"})
    info = classes.select("set_id", "copies", "one").join(links, "set_id", "left").join(joined, "set_id", "left")
    info = written(info.select("set_id", F.coalesce("joined", "set_id").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "one"))
    heads = info.groupBy("root").agg(F.min("one").alias("head"), F.count(F.lit(1)).alias("sets"))
    info = written(info.join(heads, "root").select("set_id", "links", "head", "sets"))
    return sets.drop("sample", "n").join(info, "set_id", "left")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, class_id, n_links."""
    found = _classed(_keyed(docs.select(F.col("doc_id").cast("long"), "text")))
    return found.select("doc_id", F.coalesce("head.doc_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each class: the one of the smallest doc_id; documents without words all stay.

    Columns of any name are kept as they are.
    """
    columns = docs.columns
    keyed = _keyed(docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = _classed(keyed.select("doc_id", "id_a", "id_b", "text"))
    stays = F.col("set_id").isNull() | ((F.col("head.id_a") == F.col("id_a")) & (F.col("head.id_b") == F.col("id_b")))
    kept = written(found.where(stays).groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("set_id").isNull()).alias("empty")))
    out = keyed.join(kept, ["id_a", "id_b"])
    if not kept.where("rows > 1 AND NOT empty").isEmpty():
        again = F.when(F.col("empty") | (F.col("rows") == 1), F.monotonically_increasing_id()).otherwise(F.lit(-1))
        out = out.withColumn("again", again).dropDuplicates(["id_a", "id_b", "again"])
    return out.select(*(F.col("row")[c].alias(c) for c in columns))
