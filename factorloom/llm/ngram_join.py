"""Similarity join on sets of word n-grams, by partitions of the universe of n-grams.

Two sets of sizes a and b with a Jaccard similarity of p % differ in at most H = (a + b)(100 - p) / (100 + p) elements.
Sizes are cut into bands. For each band the universe is hashed into an even number of segments greater than its H, and a
set is posted under its subset in each segment; so is a set of the next band that may have a partner in this one. Segments
come in pairs. As all differences together are fewer than two for each pair of segments, there is a pair of
segments in which two similar sets differ in at most one element: they agree on the one segment and on the other
one but for one deletion. So they meet in a list, and a list may at any time be cut into those of its members that also
agree on the other segment's one-deletion neighbourhood, without losing a link.

Which way a list goes is decided by cost. Members are first compared with one pivot of each list, which costs as much as the
list is long. Lists whose members are then still in several components are compared in blocks, each with each
across components, or, where that is dearer than posting one-deletion neighbourhoods, are cut by these first. Only what
is compared in blocks has a sketch, of as many counters as its size asks for.
All links are verified on full sets; sets that are equal are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import give_back, materialize, row_groups, text_of
from factorloom.llm.near_dedup import BLOCK, FIRST, KEY, PAIR, SLICE_BYTES, _across, _block_pairs, _confirmed, _key, _mix, components, relabelled, shingle_sets

WIDTH = 3
PERCENT = 90
#: Counters of a sketch at least.
COUNTERS = 128
#: What cutting a list costs for each member, in comparisons of two sketches: a segment has about nine elements, so ten
#: posts, and a post takes as long as some fifty comparisons.
NEIGHBOURS = 500
#: Shingles of a block's texts, about.
BLOCK_SHINGLES = 400_000

_C = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6D018F5A05F2B1F, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _u(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def most_different(a: int, b: int, percent: int = PERCENT) -> int:
    """How many elements two similar sets of these sizes may differ in."""
    return (a + b) * (100 - percent) // (100 + percent)


def counters(size: int, percent: int = PERCENT) -> int:
    """Of a sketch: a power of two, and twice what the set and one as large may differ in, so that few differences cancel out."""
    return max(COUNTERS, 1 << (2 * most_different(size, size, percent) - 1).bit_length())


def bands(largest: int, percent: int = PERCENT) -> list[int]:
    """The least size of each band, up to the first that is above ``largest``; a band spans two steps of similarity."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(max(starts[-1] + 1, -(-starts[-1] * 10_000 // percent**2)))
    return starts


def segments(starts: list[int], band: int, percent: int = PERCENT) -> int:
    """An even number of segments above what a set of the band and one as large or larger may differ in; 0 if only equal sets are similar."""
    a = starts[band + 1] - 1
    least = most_different(a, a * 100 // percent, percent)
    return least + 2 - least % 2 if least else 0


def plan(sizes: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(index, band, segments): under which partitions each of the sets is posted."""
    starts = bands(int(sizes.max(initial=0)) + 1, percent)
    own = np.searchsorted(starts, sizes, "right") - 1
    out = []
    for i, (size, band) in enumerate(zip(sizes.tolist(), own.tolist(), strict=True)):
        if size:
            lower = [band - 1] if band and -(-size * percent // 100) < starts[band] else []
            out += [(i, b, m) for b in [band, *lower] if (m := segments(starts, b, percent))]
    return out


def _subsets(elements: np.ndarray, band: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one set: each element's segment, and the sum of the elements' hashes in each segment."""
    mixed = _mix(elements ^ _u(band * int(_C[1])))
    where = (mixed % np.uint64(count)).astype(np.int64)
    sums = np.zeros(count, np.uint64)
    np.add.at(sums, where, _mix(elements + _C[2]))
    return where, sums


def _names(sums: np.ndarray, band: int, at: np.ndarray) -> np.ndarray:
    """The key of a subset: what it holds, and where."""
    return _mix(sums ^ _mix(at.astype(np.uint64) * _C[0] + _u(band * int(_C[3])))).astype(np.int64)


def posts_of(elements: np.ndarray, band: int, count: int) -> np.ndarray:
    """The keys of a set under one partition."""
    return _names(_subsets(elements, band, count)[1], band, np.arange(count))


def neighbourhoods(elements: np.ndarray, band: int, count: int, wanted: set[int]) -> list[int]:
    """For each wanted key of the set: a key for it with the other segment's subset, and with each one-deletion subset of it."""
    where, sums = _subsets(elements, band, count)
    keys, hashes, out = _names(sums, band, np.arange(count)).tolist(), _mix(elements + _C[2]), []
    for segment, key in enumerate(keys):
        if key in wanted:
            other = segment ^ 1
            subsets = np.concatenate([sums[other : other + 1], sums[other] - hashes[where == other]])
            out += _mix(_mix(subsets + _C[0]) ^ _u(key)).astype(np.int64).tolist()
    return out


def _posted(percent: int, width: int):
    """The row's key, n_shingles, node (the set's digest), posts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = [batch.column(c) for c in KEY], batch.column("text")
            lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, last in row_groups(lengths, SLICE_BYTES):
                sets, sizes = shingle_sets(texts.slice(first, last - first), width)
                parts = np.split(sets, np.cumsum(sizes)[:-1]) if len(sizes) else []
                posts: list[list[np.ndarray]] = [[] for _ in parts]
                for i, band, count in plan(sizes, percent):
                    posts[i].append(posts_of(parts[i], band, count))
                flat = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in posts]
                nodes = []
                for x in parts:
                    nodes.append(np.array([np.add.reduce(_mix(x + _C[0])), np.bitwise_xor.reduce(_mix(x ^ _C[1])) + np.uint64(len(x))], np.uint64).tobytes())
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in flat])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(k.slice(first, last - first) for k in keys),
                        pa.array(sizes, pa.int64()),
                        pa.array(nodes, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64))),
                    ],
                    names=[*KEY, "n_shingles", "node", "posts"],
                )
            give_back()

    return run


def _refined(percent: int, width: int):
    """Posts of nodes in lists that are cut: key, node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, last in row_groups(lengths, SLICE_BYTES):
                part = batch.slice(first, last - first)
                sets, sizes = shingle_sets(part.column("text"), width)
                parts, wanted, nodes = np.split(sets, np.cumsum(sizes)[:-1]), [set(k) for k in part.column("keys").to_pylist()], part.column("node").to_pylist()
                keys, owners = [], []
                for i, band, count in plan(sizes, percent):
                    made = neighbourhoods(parts[i], band, count, wanted[i])
                    keys += made
                    owners += [nodes[i]] * len(made)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(owners, pa.binary())], names=["key", "node"])

    return run


def sketch_of(elements: np.ndarray, count: int) -> np.ndarray:
    """Counters of elements, a byte each, that run over."""
    return np.bincount((_mix(elements + _C[3]) % np.uint64(count)).astype(np.int64), minlength=count).astype(np.uint8)


def _sketched(percent: int, width: int):
    """node, n_shingles, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, last in row_groups(lengths, SLICE_BYTES):
                part = batch.slice(first, last - first)
                sets, sizes = shingle_sets(part.column("text"), width)
                made = [sketch_of(x, counters(len(x), percent)).tobytes() for x in np.split(sets, np.cumsum(sizes)[:-1])]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sizes, pa.int64()), pa.array(made, pa.binary())], names=["node", "n_shingles", "sketch"])
            give_back()

    return run


class _Sketches:
    """A block's sketches, which may be had with fewer counters: those of a power of two add up to those of a smaller one."""

    def __init__(self, packed: list[bytes]) -> None:
        self.whole = [np.frombuffer(s, np.uint8) for s in packed]
        self.counts = np.array([len(s) for s in self.whole])
        self.made: dict[int, np.ndarray] = {}

    def of(self, count: int) -> np.ndarray:
        """A row for each sketch that has so many counters or more; of zeros for the others."""
        if count not in self.made:
            made = np.zeros((len(self.whole), count), np.uint8)
            for i, s in enumerate(self.whole):
                if len(s) >= count:
                    made[i] = s.reshape(-1, count).sum(0, dtype=np.uint8)
            self.made[count] = made
        return self.made[count]


def _differences(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    gap = others - one  # wraps around
    return np.minimum(gap, np.uint8(0) - gap).sum(1, dtype=np.int64)


def _apart(percent: int):
    """Of two blocks of a list: pairs of different components whose sketches are near enough.

    Pairs that are near by the fewest counters are looked at again by all that both have. Counters that differ by d hold at least d elements that differ, also where they have run over. Pairs that are no more
    than the nodes are told one by one, so that those of several lists are compared once (task is null); of more pairs only
    the nodes are told, under a task for the two blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):  # one row at a time, as its members may be many
                one, two = (batch.column(f"{k}_members")[r].values for k in "ab")
                labels = [side.field("label").to_pylist() for side in (one, two)]
                nodes = [side.field("node").to_pylist() for side in (one, two)]
                names = {label: i for i, label in enumerate(dict.fromkeys([*labels[0], *labels[1]]))}
                (label_a, size_a, sketch_a), (label_b, size_b, sketch_b) = (
                    (np.array([names[x] for x in labels[k]]), side.field("n_shingles").to_numpy(zero_copy_only=False), _Sketches(side.field("sketch").to_pylist())) for k, side in enumerate((one, two))
                )
                pairs: list[tuple[int, int]] = []
                for i in range(len(one)):
                    most = (size_b + size_a[i]) * (100 - percent)
                    near = np.flatnonzero((label_b != label_a[i]) & (_differences(sketch_a.of(COUNTERS)[i], sketch_b.of(COUNTERS)) * (100 + percent) <= most))
                    both = np.minimum(sketch_a.counts[i], sketch_b.counts[near])
                    for count in np.unique(both).tolist():
                        at = near[both == count]
                        at = at[_differences(sketch_a.of(count)[i], sketch_b.of(count)[at]) * (100 + percent) <= most[at]]
                        pairs += [(i, j) for j in at.tolist()]
                if len(pairs) <= len(one) + len(two):
                    found = [sorted(((nodes[0][i], labels[0][i]), (nodes[1][j], labels[1][j]))) for i, j in pairs]
                    rows = [(None, None, *a, *b) for a, b in found]
                else:
                    task = "/".join(str(batch.column(c)[r].as_py()) for c in ("key", "a_name", "b_name"))
                    chosen = (("a", 0, {i for i, _ in pairs}), ("b", 1, {j for _, j in pairs}))
                    rows = [(task, name, nodes[k][i], labels[k][i], None, None) for name, k, these in chosen for i in sorted(these)]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (pa.string(), pa.string(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["task", "side", "node", "label", "other", "other_label"])
            give_back()

    return run


def _several(told: DataFrame) -> DataFrame:
    """Lists (key, node, label) with several components; of lists with the same members one is enough, as they are compared whole."""
    lists = told.groupBy("key").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("all"), F.bit_xor(F.xxhash64("node")).alias("h0"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("h1")
    )
    one = lists.where("low != high").groupBy("all", "h0", "h1").agg(F.min("key").alias("key"))
    return told.join(one.select("key"), "key").select("key", "node", "label")


def _mixed_posts(told: DataFrame, percent: int, width: int, texts: DataFrame, neighbours: int) -> DataFrame:
    """key, node, label, n_shingles, sketch of the lists to be compared in blocks, the dearest ones cut before."""
    mixed = told.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    lists = materialize(told.join(mixed.select("key"), "key"), "mixed-lists")
    counts = lists.groupBy("key", "label").count().groupBy("key").agg(F.sum("count").alias("all"), F.sum(F.col("count").cast("double") * F.col("count")).alias("within"))
    across = (F.col("all").cast("double") * F.col("all") - F.col("within")) / 2
    dear = materialize(counts.where(across > neighbours * F.col("all")).select("key"), "dear-lists")
    asked = lists.join(dear, "key").groupBy("node").agg(F.collect_set("key").alias("keys"), F.first("label").alias("label"))
    cut = asked.select("node", "keys").join(texts, "node").select("node", "keys", "text").mapInArrow(_refined(percent, width), "key bigint, node binary")
    cut = materialize(cut.distinct().join(asked.select("node", "label"), "node").select("key", "node", "label"), "neighbourhoods")
    left = lists.join(dear, "key", "left_anti").select("key", "node", "label").unionByName(cut)
    left = materialize(_several(materialize(left, "lists-to-compare")), "lists-of-several")
    sketches = left.select("node").distinct().join(texts, "node").select("node", "text").mapInArrow(_sketched(percent, width), "node binary, n_shingles bigint, sketch binary")
    return materialize(left.join(sketches, "node"), "lists")


def _joined(docs: DataFrame, percent: int, width: int, neighbours: int) -> tuple[DataFrame, DataFrame]:
    """id, n_shingles, node of each row; and for each node the least row key of its component."""
    rows = docs.select(*_key(), text_of().alias("text"))
    shape = "id bigint, text_hash bigint, text_hash_2 bigint, n_shingles bigint, node binary, posts array<bigint>"
    signed = materialize(rows.mapInArrow(_posted(percent, width), shape), "sets")
    # equal sets first: copies are one node, however many they are
    nodes = signed.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct(*KEY)).alias("row"), *[F.first(c).alias(c) for c in ("posts", "n_shingles")])
    nodes = materialize(nodes, "set-nodes")
    posted = nodes.select(F.explode("posts").alias("key"), "node")
    often = posted.groupBy("key").agg(F.count("*").alias("often")).where("often > 1")
    shared = materialize(posted.join(often, "key"), "shared-posts")
    central = shared.groupBy("node").agg(F.sum("often").alias("central"))
    posts = materialize(shared.join(central, "node").select("key", "node", "central"), "posts")

    pivots = posts.groupBy("key").agg(F.max(F.struct("central", "node")).alias("p")).select("key", F.col("p.node").alias("a"))
    met = posts.select("key", F.col("node").alias("b")).join(pivots, "key").where("a != b").groupBy("a", "b").agg(F.count("*").alias("agreed"))
    best = materialize(met.groupBy("b").agg(F.max(F.struct("agreed", "a")).alias("m")).select(F.col("m.a").alias("a"), "b"), "first-pairs")
    wanted = nodes.join(central.select("node"), "node").select("row.*", "node")
    texts = materialize(rows.join(wanted, list(KEY)).groupBy("node").agg(F.first("text").alias("text")), "node-texts")

    def confirm(pairs: DataFrame) -> DataFrame:
        b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        return pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(_confirmed(percent, width), PAIR)

    labels = components(materialize(confirm(best), "first-links"), "first")

    label = F.coalesce("label", "node").alias("label")
    told = materialize(posts.join(labels, "node", "left").select("key", "node", label), "labelled-posts")
    lists = _mixed_posts(told, percent, width, texts, neighbours)
    # the largest component of a list, or one of them, is its main one; blocks are bounded by rows and by text
    sizes = lists.groupBy("key", "label").agg(F.count("*").alias("count"), F.sum("n_shingles").alias("shingles"))
    main = sizes.groupBy("key").agg(F.max(F.struct("count", "label", "shingles")).alias("m"), F.sum("count").alias("all"), F.sum("shingles").alias("shingles"))
    parts = lambda count, shingles: F.greatest(F.ceil(count / BLOCK), F.ceil(shingles / BLOCK_SHINGLES))
    main = main.select("key", F.col("m.label").alias("main"), parts(F.col("m.count"), F.col("m.shingles")).alias("main_parts"), parts(F.col("all") - F.col("m.count"), F.col("shingles") - F.col("m.shingles")).alias("other_parts"))
    main = materialize(main, "list-sizes")
    is_main = F.col("label") == F.col("main")
    block = F.pmod(F.xxhash64("node"), F.when(is_main, F.col("main_parts")).otherwise(F.col("other_parts")))
    member = F.struct("node", "sketch", "label", "n_shingles")
    dealt = lists.join(main, "key").select("key", is_main.alias("is_main"), block.alias("block"), member.alias("member"))
    blocks = materialize(dealt.groupBy("key", "is_main", "block").agg(F.collect_list("member").alias("members")), "list-blocks")
    crossed = _block_pairs(blocks.join(main.select("key", (F.col("main_parts") * BLOCK).alias("in_main"), (F.col("other_parts") * BLOCK).alias("others")), "key"))
    tasks = materialize(crossed.mapInArrow(_apart(percent), "task string, side string, node binary, label binary, other binary, other_label binary"), "block-tasks")
    few = tasks.where("task is null").groupBy(F.col("node").alias("a"), F.col("other").alias("b")).agg(F.first("label").alias("label_a"), F.first("other_label").alias("label_b"))
    few = materialize(few, "rest-pairs")
    linked = confirm(few).join(few, ["a", "b"]).select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    many = tasks.where("task is not null").select("task", "side", "node", "label").join(texts, "node").groupBy("task").applyInArrow(_across(percent, width), PAIR)
    second = materialize(linked.unionByName(many), "rest-links")
    merged = components(second, "rest")
    alone = merged.join(labels.select("node"), "node", "left_anti")
    labels = relabelled(labels, merged).unionByName(alone)

    placed = nodes.select("node", "row").join(labels, "node", "left").select("node", "row", label)
    least = placed.groupBy("label").agg(F.min("row").alias("least"))
    return signed.select("id", "n_shingles", "node"), materialize(placed.join(least, "label").select("node", "least"), "node-components")


def ngram_join(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, neighbours: int = NEIGHBOURS) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, the smallest doc_id reachable by links.

    Null, empty and white texts have no shingles and stay alone; texts of fewer than ``width`` words are one shingle. A
    null id comes before all others and is returned as null; rows that share an id count as documents of their own under
    one id; repeated rows are equal sets; an empty table gives an empty result; other columns are not carried. Ids
    are whole numbers; others raise. ``neighbours`` is the cost of cutting a list, in comparisons for each member.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed, named = _joined(docs, percent, width, neighbours)
    found = signed.join(named.select("node", F.col("least.id").alias("component")), "node", "left")
    whole = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id"))
    out = lambda c: F.when(c != FIRST, c).cast(id_type)
    return found.select(out(F.col("id")).alias("doc_id"), "n_shingles", out(whole).alias("component_id"))
