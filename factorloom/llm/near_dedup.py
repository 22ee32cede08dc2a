"""Near-duplicates by MinHash and an inverted index over signature coordinates.

Documents are linked if their sets of word shingles have a Jaccard similarity of at least a threshold.
Documents of equal sets become one node first. Each node is posted under its coordinate-value pairs,
rarest first, and the ``POSTED_MATCHES - 1`` most frequent pairs are skipped: two nodes that agree in
``POSTED_MATCHES`` coordinates still meet under one of the others. Nodes that meet count the collisions
of their whole signatures, and those above a match threshold are compared on their full sets.

No list is expanded into all its pairs. First each node is compared with the one pivot, among those of
its lists, that it agrees with most; a list's pivot is the node whose coordinate-value pairs are the
most frequent, so the text that the others were edited from if it is there. After the components of
these links only nodes of different components remain. They are compared in blocks, each pair in one
list only, and within a list one large component is never paired with itself. What leaves a block is
one link for each two components, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import WORD, give_back, materialize, row_groups, text_of

#: Coordinates of a signature, and how many of them are posted.
COORDINATES = 64
POSTED = 32
#: A pair of similarity 0.75 has fewer than 12 of 32 matches, or 31 of 64, once in a million.
POSTED_MATCHES = 12
MATCHES = 31
SHINGLE = 5
#: Nodes of a block of a list, and blocks that one task takes from either side.
BLOCK = 256
STRIPE = 16
SLICE_BYTES = 1_000_000
FIRST = -(2**63)
#: A row's key: its id and 128 bits of hash of its text, as rows may share an id.
KEY = ("id", "text_hash", "text_hash_2")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
_ODD = (np.random.default_rng(20240229).integers(0, 2**63, COORDINATES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C[1]
    x = (x ^ (x >> np.uint64(27))) * _C[2]
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of texts that lie one after another, and the number of words of each."""
    data = _LOWER[data]
    gap = np.concatenate([[True], _WHITE[data], [True]])
    inside = ~gap[1:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[edges] = True
    start = np.flatnonzero(inside & (gap[:-2] | edge[:-1]))
    end = np.flatnonzero(inside & (gap[2:] | edge[1:])) + 1
    eights = np.zeros(len(data) + 8, np.uint64)
    eights[: len(data)] = data
    for step in (1, 2, 4):
        eights[:-step] |= eights[step:] << np.uint64(8 * step)
    size = end - start
    out = _mix(size.astype(np.uint64) * _C[0])
    active, step = np.arange(len(start)), 0
    while len(active):
        left = size[active] - step
        word = eights[start[active] + step] & _MASK[np.minimum(left, 8)]
        out[active] = _mix((out[active] ^ word) * _C[0] + _C[3])
        step += 8
        active = active[left > 8]
    return out, np.diff(np.searchsorted(start, edges))


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles' hashes of each text, sorted, one text after another; and their numbers.

    A shingle has ``width`` words, at most five. A text of fewer words than a shingle has is one shingle; one without words has none.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    words, counts = _word_hashes(data, edges - edges[0])
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    combined = np.zeros(len(words), np.uint64)
    for j in range(width):
        combined += _mix(padded[j : j + len(words)] + _C[j + 1]) * _C[j]
    combined = _mix(combined)
    sets, sizes, at = [], np.zeros(len(counts), np.int64), 0
    for i, n in enumerate(counts.tolist()):
        if n >= width:
            sets.append(np.unique(combined[at : at + n - width + 1]))
        elif n:
            few = np.uint64(n)
            for j in range(n):
                few = _mix(np.array([few + words[at + j] if j == 0 else few ^ words[at + j]], np.uint64) * _C[4] + _C[5])[0]
            sets.append(np.array([few], np.uint64))
        at += n
        sizes[i] = len(sets[-1]) if n else 0
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), sizes


def signatures(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The least hash under each coordinate's function, of sets that are not empty."""
    first = np.cumsum(sizes) - sizes
    return np.stack([np.minimum.reduceat(sets * odd, first) for odd in _ODD], 1) if len(sizes) else np.zeros((0, COORDINATES), np.uint64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The row's key, n_shingles, node (the set's digest), posts (coordinate-value pairs), sketch (a byte each)."""
    for batch in batches:
        keys, texts = [batch.column(c) for c in KEY], batch.column("text")
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for first, last in row_groups(lengths, SLICE_BYTES):
            sets, sizes = shingle_sets(texts.slice(first, last - first))
            some = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[some]
            signs = signatures(sets, sizes[some])
            digest = np.zeros((len(sizes), 2), np.uint64)
            if len(some):
                digest[some, 0] = np.add.reduceat(_mix(sets + _C[4]), starts)
                digest[some, 1] = np.bitwise_xor.reduceat(_mix(sets ^ _C[5]), starts) + sizes[some].astype(np.uint64) * _C[0]
            posts = np.zeros((len(sizes), POSTED), np.uint64)
            sketch = np.zeros((len(sizes), COORDINATES), np.uint8)
            mixed = _mix(signs + np.arange(COORDINATES, dtype=np.uint64) * _C[3])
            posts[some], sketch[some] = mixed[:, :POSTED], (mixed >> np.uint64(56)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    *(k.slice(first, last - first) for k in keys),
                    pa.array(sizes, pa.int64()),
                    pa.array([d.tobytes() for d in digest], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * POSTED), pa.array(posts.ravel().astype(np.int64))),
                    pa.array([s.tobytes() for s in sketch], pa.binary()),
                ],
                names=[*KEY, "n_shingles", "node", "posts", "sketch"],
            )


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def _collisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with enough collisions of their signatures, and how many."""
    for batch in batches:
        if batch.num_rows:
            count = (_sketches(batch.column("sketch_a")) == _sketches(batch.column("sketch_b"))).sum(1)
            enough = pa.array(count >= MATCHES)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(count.astype(np.int32))], names=["a", "b", "matches"])
            yield out.filter(enough)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of two blocks of a list: the nodes that have a partner of another component across.

    Partners have enough collisions, and no common key that is less than the list's: so each pair is
    met in one of its lists only.
    """
    for batch in batches:
        for row in batch.to_pylist():
            sides = []
            for k in "ab":
                members = row[f"{k}_members"]
                sketch = np.frombuffer(b"".join(m["sketch"] for m in members), np.uint8).reshape(-1, COORDINATES)
                below = [{x for x in m["keys"] if x < row["key"]} for m in members]
                sides.append((members, sketch, below))
            (one, sketch_a, below_a), (two, sketch_b, below_b) = sides
            names = {label: i for i, label in enumerate(dict.fromkeys(m["label"] for m in [*one, *two]))}
            label_a, label_b = (np.array([names[m["label"]] for m in side]) for side in (one, two))
            with_partner: tuple[set[int], set[int]] = (set(), set())
            for i in range(len(one)):
                near = np.flatnonzero((label_b != label_a[i]) & ((sketch_b == sketch_a[i]).sum(1) >= MATCHES))
                mine = [j for j in near.tolist() if below_a[i].isdisjoint(below_b[j])]
                if mine:
                    with_partner[0].add(i)
                    with_partner[1].update(mine)
            rows = [(f"{row['key']}/{row['a_name']}/{row['b_name']}", k, side[i]["node"], side[i]["label"]) for k, side, chosen in (("a", one, with_partner[0]), ("b", two, with_partner[1])) for i in sorted(chosen)]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], names=["task", "side", "node", "label"])


def _shared(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of the one side shares with each of the other."""
    flat_a, flat_b = np.concatenate(one), np.concatenate(two)
    both = np.intersect1d(flat_a, flat_b)
    rows_a, rows_b = (np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (one, two))
    out = np.zeros((len(one), len(two)), np.float32)
    for at in range(0, len(both), 4096):  # dense strips of bounded width
        strip = both[at : at + 4096]
        dense = []
        for flat, rows, n in ((flat_a, rows_a, len(one)), (flat_b, rows_b, len(two))):
            where = np.minimum(np.searchsorted(strip, flat), len(strip) - 1)
            hit = strip[where] == flat
            m = np.zeros((n, len(strip)), np.float32)
            m[rows[hit], where[hit]] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)


def _across(percent: int, width: int = SHINGLE):
    """Links between the two sides of a task by their full sets: the labels of each two linked components."""

    def run(group: pa.Table) -> pa.Table:
        sides = []
        for k in "ab":
            rows = group.filter(pc.equal(group.column("side"), k)).sort_by("node")
            nodes, labels = rows.column("node").to_pylist(), rows.column("label").to_pylist()
            sets, sizes = shingle_sets(rows.column("text").combine_chunks() if len(nodes) else pa.array([], pa.string()), width)
            sides.append((nodes, labels, np.split(sets, np.cumsum(sizes)[:-1]) if len(nodes) else [], sizes))
        (a, label_a, sets_a, size_a), (b, label_b, sets_b, size_b) = sides
        found: set[tuple[bytes, bytes]] = set()
        if a and b:
            shared = _shared(sets_a, sets_b)
            linked = np.argwhere(100 * shared >= percent * (size_a[:, None] + size_b[None, :] - shared))
            for i, j in linked.tolist():
                if label_a[i] != label_b[j]:
                    found.add((label_a[i], label_b[j]))
        pairs = sorted(found)
        if group.nbytes > SLICE_BYTES:
            give_back()
        return pa.table([pa.array([x for x, _ in pairs], pa.binary()), pa.array([y for _, y in pairs], pa.binary())], names=["a", "b"])

    return run


def _confirmed(percent: int, width: int = SHINGLE):
    """Pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = (pc.binary_length(batch.column("text_a")).to_numpy(zero_copy_only=False).astype(np.int64)) + pc.binary_length(batch.column("text_b")).to_numpy(zero_copy_only=False)
            for first, last in row_groups(lengths, 2 * SLICE_BYTES):
                part = batch.slice(first, last - first)
                sides, index = {}, {}
                for k in "ab":  # a pivot comes in many pairs; its set is made once
                    coded = part.column(k).dictionary_encode()
                    index[k] = coded.indices.to_numpy(zero_copy_only=False)
                    _, where = np.unique(index[k], return_index=True)
                    sets, sizes = shingle_sets(part.column(f"text_{k}").take(pa.array(where)), width)
                    sides[k] = np.split(sets, np.cumsum(sizes)[:-1])
                keep = []
                for i, j in zip(index["a"].tolist(), index["b"].tolist(), strict=True):
                    x, y = sides["a"][i], sides["b"][j]
                    at = np.searchsorted(y, x)
                    shared = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                    keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
            give_back()

    return run


PAIR = "a binary, b binary"


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, label: the least node that is reachable, for all nodes with a link.

    Each round every node points to its least neighbour, if that is less than itself, and from there one
    step further; links then run between what their ends point to, and those within one are gone. On labels in no
    order, as digests are, a round leaves a fraction of the graph (a chain of 2,000 takes about eight rounds); a chain in
    order of its labels would lose two nodes a round, so labels that may be in order must be hashed by the caller.
    Rounds go on until no link is left. Pointers are written to shared storage; nothing but whether links are
    left comes to the driver.
    """
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges, pointers = materialize(both.where("a != b").distinct(), f"{name}-edges-0"), []
    while edges.limit(1).count():
        step = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("up"))
        far = step.select(F.col("node").alias("up"), F.col("up").alias("label"))
        pointers.append(materialize(step.join(far, "up").select("node", "label"), f"{name}-{len(pointers)}"))
        end = lambda c: pointers[-1].select(F.col("node").alias(c), F.col("label").alias(f"to_{c}"))
        moved = edges.join(end("a"), "a").join(end("b"), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        edges = materialize(moved.where("a != b").distinct(), f"{name}-edges-{len(pointers)}")
    if not pointers:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = pointers.pop()
    while pointers:  # from the small graphs back to the large one
        labels = materialize(relabelled(pointers.pop(), labels), f"{name}-back-{len(pointers)}")
    return labels


def relabelled(labels: DataFrame, further: DataFrame) -> DataFrame:
    """``labels`` (node, label), where labels that have one of their own in ``further`` are replaced by it."""
    on = further.select(F.col("node").alias("label"), F.col("label").alias("__further"))
    return labels.join(on, "label", "left").select("node", F.coalesce("__further", "label").alias("label"))


def _key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST)).alias(KEY[0]), F.xxhash64(text_of()).alias(KEY[1]), F.xxhash64(F.lit(1), text_of()).alias(KEY[2])]


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """The pairs of blocks of a list: no block of the main component with another of it.

    A long list is cut into stripes of blocks, and each two stripes meet under a key of their own, so its
    pairs spread over tasks of one size, and a block is sent as often as the list has stripes.
    """
    count = lambda c: F.ceil(F.ceil(F.col(c) / BLOCK) / STRIPE).cast("int")
    name = F.concat(F.when(F.col("is_main"), "m").otherwise("o"), F.col("block").cast("string"))
    cut = blocks.select("key", "is_main", "block", "members", name.alias("name"), F.floor(F.col("block") / STRIPE).cast("int").alias("stripe"), count("in_main").alias("of_main"), count("others").alias("of_others"))
    partner = lambda is_main, stripes: F.transform(stripes, lambda j: F.struct(F.lit(is_main).alias("is_main"), j.alias("stripe")))
    partners = F.concat(partner(False, F.sequence("stripe", F.col("of_others") - 1)), partner(True, F.sequence(F.lit(0), F.col("of_main") - 1)))
    one = cut.where("not is_main").select("key", "stripe", F.explode(partners).alias("partner"), F.col("block").alias("a_block"), F.col("name").alias("a_name"), F.col("members").alias("a_members"))
    upto = F.when(F.col("is_main"), F.col("of_others") - 1).otherwise(F.col("stripe"))
    two = cut.select("key", F.explode(F.sequence(F.lit(0), upto)).alias("with"), F.struct("is_main", "stripe").alias("partner"), F.col("block").alias("b_block"), F.col("name").alias("b_name"), F.col("members").alias("b_members"))
    pairs = one.join(two.withColumnRenamed("with", "stripe"), ["key", "stripe", "partner"]).where("partner.is_main or a_block <= b_block")
    return pairs.select("key", "a_name", "a_members", "b_name", "b_members")


def _components(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """id, n_shingles, node of each row; and for each node the least row key of its component."""
    rows = docs.select(*_key(), text_of().alias("text"))
    signed = materialize(rows.mapInArrow(_signed, "id bigint, text_hash bigint, text_hash_2 bigint, n_shingles bigint, node binary, posts array<bigint>, sketch binary"), "signatures")
    # equal sets first: copies are one node, however many they are
    nodes = signed.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct(*KEY)).alias("row"), F.first("posts").alias("posts"), F.first("sketch").alias("sketch"))
    nodes = materialize(nodes, "nodes")
    posted = nodes.select(F.explode("posts").alias("key"), "node")
    often = materialize(posted.groupBy("key").agg(F.count("*").alias("often")).where("often > 1"), "frequent-keys")
    held = posted.join(often, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("keys"))
    # the most frequent pairs are skipped; pairs that no other node has were dropped above
    few = F.greatest(F.size("keys") - (POSTED_MATCHES - 1), F.lit(0))
    central = F.aggregate("keys", F.lit(0).cast("bigint"), lambda total, k: total + k["often"])
    rare = held.select("node", central.alias("central"), F.transform(F.slice("keys", F.lit(1), few), lambda k: k["key"]).alias("keys")).where("size(keys) > 0")
    rare = materialize(rare.join(nodes.select("node", "sketch"), "node"), "node-keys")
    posts = rare.select(F.explode("keys").alias("key"), "node", "central", "sketch")

    pivots = posts.groupBy("key").agg(F.max(F.struct("central", "node", "sketch")).alias("p"))
    pivots = materialize(pivots.select("key", F.col("p.node").alias("a"), F.col("p.sketch").alias("sketch_a")), "pivots")
    with_pivot = posts.select("key", F.col("node").alias("b"), F.col("sketch").alias("sketch_b")).join(pivots, "key").where("a != b")
    tried = with_pivot.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_collisions, f"{PAIR}, matches int")
    best = materialize(tried.groupBy("b").agg(F.max(F.struct("matches", "a")).alias("m")).select(F.col("m.a").alias("a"), "b"), "first-pairs")

    wanted = nodes.join(rare.select("node"), "node").select("row.*", "node")
    # repeated rows have one key and one text: a node gets one text
    texts = materialize(rows.join(wanted, list(KEY)).groupBy("node").agg(F.first("text").alias("text")), "node-texts")

    def confirm(pairs: DataFrame) -> DataFrame:
        b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(_confirmed(percent), PAIR)

    first = materialize(confirm(best), "first-links")
    labels = components(first, "first")
    # what is left: lists with nodes of several components
    label = F.coalesce("label", "node").alias("label")
    told = materialize(posts.join(labels, "node", "left").select("key", "node", label), "labelled-posts")
    mixed = told.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    # the largest component of a list, or one of them, is its main one
    sizes = materialize(told.groupBy("key", "label").count(), "list-components")
    main = sizes.groupBy("key").agg(F.max(F.struct("count", "label")).alias("m"), F.sum("count").alias("all"))
    main = main.join(mixed.select("key"), "key").select("key", F.col("m.label").alias("main"), F.col("m.count").alias("in_main"), (F.col("all") - F.col("m.count")).alias("others"))
    main = materialize(main, "mixed-lists")
    is_main = F.col("label") == F.col("main")
    block = F.pmod(F.xxhash64("node"), F.ceil(F.when(is_main, F.col("in_main")).otherwise(F.col("others")) / BLOCK))
    dealt = told.join(main, "key").select("key", is_main.alias("is_main"), block.alias("block"), "node", "label").join(rare.select("node", "sketch", "keys"), "node")
    member = F.struct("node", "sketch", "label", "keys")
    blocks = materialize(dealt.groupBy("key", "is_main", "block").agg(F.collect_list(member).alias("members")), "list-blocks")
    crossed = _block_pairs(blocks.join(main.select("key", "in_main", "others"), "key"))
    tasks = materialize(crossed.mapInArrow(_blocks, "task string, side string, node binary, label binary"), "block-tasks")
    second = materialize(tasks.join(texts, "node").groupBy("task").applyInArrow(_across(percent), PAIR), "rest-links")
    # nodes that only the second pass links are labels of their own
    merged = components(second, "rest")
    alone = merged.join(labels.select("node"), "node", "left_anti")
    labels = relabelled(labels, merged).unionByName(alone)

    placed = nodes.select("node", "row").join(labels, "node", "left").select("node", "row", label)
    least = placed.groupBy("label").agg(F.min("row").alias("least"))
    return signed.select("id", "n_shingles", "node"), materialize(placed.join(least, "label").select("node", "least"), "node-components")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id reachable by links, ``kept`` tells whether it is its own.
    Null, empty and white texts have no shingles and stay alone; a null id comes before all others and
    is returned as null; rows that share an id count as documents of their own under one id; an empty
    table gives an empty result; other columns are not carried. Ids are whole numbers; others raise.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed, named = _components(docs, percent)
    found = signed.join(named.select("node", F.col("least.id").alias("component")), "node", "left")
    whole = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id"))
    out = lambda c: F.when(c != FIRST, c).cast(id_type)
    return found.select(out(F.col("id")).alias("doc_id"), "n_shingles", out(whole).alias("component_id"), (F.col("id") == whole).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of each component, all columns: the one of the smallest doc_id, null being the smallest.

    Of rows that share the id the text decides, so a document stays or goes by its own text only; of
    rows that agree in both, any one stays. Texts without words are no duplicates: all their rows stay.
    """
    _, named = _components(docs, percent)
    chosen = named.select("least.*").distinct().select(*[F.col(k).alias(f"__{k}") for k in KEY])
    wordy = text_of().rlike(WORD)
    keyed = docs.where(wordy).select(F.struct(*docs.columns).alias("__row"), *[c.alias(f"__{k}") for k, c in zip(KEY, _key(), strict=True)])
    # repeated rows become one where they are read, so no task gets them all
    single = keyed.groupBy(*[f"__{k}" for k in KEY]).agg(F.first("__row").alias("__row"))
    return single.join(chosen, [f"__{k}" for k in KEY], "left_semi").select("__row.*").unionByName(docs.where(~wordy))
