"""Best-fit packing of documents into sequences by local search.

Documents are cut into pieces of at most one sequence. Pieces are dealt into groups of bounded size by
hash, so that groups can be packed side by side; a group wastes less than one sequence. In a group,
pieces go best-fit into bins in the order they come, those over half a bin first. Then the search takes
over. The emptiest bin gives length to fuller ones, by a move or by an exchange of one piece for one,
two for one or one for two, until it is empty; where that ends, the emptiest bins and those of the most
pieces are fitted anew. Each step raises the sum of squared fills. The search ends at a proven lower
bound of the number of bins, or when no step is left.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import materialize, spread
from factorloom.llm.tokens import encoder, slices

#: Pieces shorter than a sequence that are packed together, on average.
GROUP_PIECES = 4000
#: Bins that are fitted anew at once, by turns.
REFITS = (64, 128, 256, 512)


def lower_bound(lengths: list[int], capacity: int) -> int:
    """No packing has fewer bins: by total length, and by pieces of which only so many share a bin."""
    count = np.bincount(np.asarray(lengths, np.int64), minlength=capacity + 1).astype(np.int64)
    total = count * np.arange(capacity + 1)
    below_n, below = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(total)])
    best, half = -(-int(total.sum()) // capacity), capacity // 2
    for k in range(0, half + 1):
        alone = int(below_n[-1] - below_n[capacity - k + 1])  # longer than capacity - k
        large = int(below_n[capacity - k + 1] - below_n[half + 1])  # over half, up to capacity - k
        room = large * capacity - int(below[capacity - k + 1] - below[half + 1])
        small = int(below[half + 1] - below[k])
        best = max(best, alone + large + max(0, -(-(small - room) // capacity)))
    for k in range(2, min(16, capacity) + 1):  # at most k pieces of over capacity / (k + 1) share a bin
        best = max(best, -(-int(below_n[-1] - below_n[capacity // (k + 1) + 1]) // k))
    return best


class Rooms:
    """Bins by their free room, for best fit."""

    def __init__(self) -> None:
        self.by_free: dict[int, list[int]] = defaultdict(list)
        self.mask = 0  # a bit for each free room that some bin has

    def put(self, b: int, free: int) -> None:
        self.by_free[free].append(b)
        self.mask |= 1 << free

    def take(self, length: int) -> tuple[int, int] | None:
        """The bin with the least room that is enough, and its room; it leaves the index."""
        if not (mask := self.mask >> length):
            return None
        free = (mask & -mask).bit_length() - 1 + length
        b = self.by_free[free].pop()
        if not self.by_free[free]:
            self.mask &= ~(1 << free)
        return b, free


def best_fit(lengths: list[int], order: list[int], capacity: int) -> list[list[int]]:
    """Bins of pieces; each piece goes, in ``order``, where the least room is left."""
    rooms, bins = Rooms(), []
    for p in order:
        if (found := rooms.take(lengths[p])) is None:
            found = len(bins), capacity
            bins.append([])
        bins[found[0]].append(p)
        rooms.put(found[0], found[1] - lengths[p])
    return bins


class Search:
    """Bins under local search; a bin that became empty is no longer alive."""

    def __init__(self, lengths: list[int], bins: list[list[int]], capacity: int) -> None:
        self.capacity, self.length, self.bins = capacity, np.asarray(lengths, np.int64), bins
        self.where = np.zeros(len(lengths), np.int64)
        self.free = np.full(len(bins), capacity, np.int64)
        self.least_two = np.zeros(len(bins), np.int64)  # the lengths of the two shortest pieces of a bin
        self.most_two = np.zeros(len(bins), np.int64)
        self.alive = np.ones(len(bins), bool)
        self.steps = dict.fromkeys(("move", "1:1", "2:1", "1:2", "refit"), 0)
        for b, pieces in enumerate(bins):
            self._hold(b, pieces)

    def _hold(self, b: int, pieces: list[int]) -> None:
        self.bins[b], self.where[pieces] = pieces, b
        size = np.sort(self.length[pieces])
        self.free[b] = self.capacity - size.sum()
        # a bin of one piece has no two
        self.least_two[b], self.most_two[b] = (size[:2].sum(), size[-2:].sum()) if len(size) > 1 else (self.capacity, 0)
        self.alive[b] = bool(pieces)

    def _exchange(self, kind: str, a: int, out: list[int], b: int, back: list[int]) -> None:
        self.steps[kind] += 1
        mine, theirs = self.bins[a], self.bins[b]
        self._hold(a, [p for p in mine if p not in out] + back)
        self._hold(b, [p for p in theirs if p not in back] + out)

    def give(self, a: int) -> bool:
        """One step that shifts length from bin ``a`` to one at least as full; False if there is none."""
        room = np.where(self.alive & (self.free <= self.free[a]), self.free, 0)
        room[a] = 0
        if not room.any():
            return False
        size, mine = self.length, sorted(self.bins[a], key=lambda p: (-self.length[p], p))
        for p in mine:
            if len(fits := np.flatnonzero(room >= size[p])):
                self._exchange("move", a, [p], int(fits[np.argmin(room[fits])]), [])
                return True
        # of what it holds, one piece of each length is enough, and one pair of each sum
        single = {int(size[p]): [p] for p in mine}
        # two pieces of each length make all sums; a bin has few lengths, as these add up to its capacity at most
        twice = [p for k, p in enumerate(mine) if k < 2 or size[mine[k - 2]] != size[p]]
        double = {int(size[p] + size[q]): [p, q] for i, p in enumerate(twice) for q in twice[i + 1 :]}
        others = np.flatnonzero(room[self.where])  # pieces beside which there is room
        theirs, around, best, found = size[others], room[self.where[others]], 0, None
        for kind, options in (("1:1", single), ("2:1", double)):
            for total, out in options.items():
                gain = total - theirs
                gain[gain > around] = 0
                k = int(gain.argmax())
                if gain[k] > best:
                    q = int(others[k])
                    best, found = int(gain[k]), (kind, a, out, int(self.where[q]), [q])
        if found is None:
            found = self._one_for_two(a, single, room)
        if found is None:
            return False
        self._exchange(*found)
        return True

    def _one_for_two(self, a: int, single: dict[int, list[int]], room: np.ndarray) -> tuple | None:
        best, found = 0, None
        for b in np.flatnonzero((room > 0) & (self.least_two < max(single)) & (self.most_two + room >= min(single))).tolist():
            some: dict[int, list[int]] = defaultdict(list)  # two pieces of each length are enough
            for p in self.bins[b]:
                if len(some[n := int(self.length[p])]) < 2:
                    some[n].append(p)
            theirs, space = [(n, p) for n, pieces in some.items() for p in pieces], int(room[b])
            for i, (x, p) in enumerate(theirs):
                for y, q in theirs[i + 1 :]:
                    for total, out in single.items():
                        if best < total - x - y <= space:
                            best, found = total - x - y, ("1:2", a, out, b, [p, q])
        return found

    def refit(self) -> bool:
        """Fit the emptiest bins and as many of the most pieces anew, longest first, if that raises the squares."""
        live = np.flatnonzero(self.alive)
        pieces = np.array([len(self.bins[b]) for b in live])
        for many in REFITS:
            emptiest = live[np.argsort(-self.free[live], kind="stable")][: many // 2]
            others = live[np.argsort(-np.where(np.isin(live, emptiest), 0, pieces), kind="stable")][: min(many, len(live)) - len(emptiest)]
            chosen = np.concatenate([emptiest, others])
            order = sorted((p for b in chosen for p in self.bins[b]), key=lambda p: (-self.length[p], p))
            made = best_fit(self.length.tolist(), order, self.capacity)
            squares = sum(int(self.length[ps].sum()) ** 2 for ps in made)
            if len(made) <= len(chosen) and squares > int(((self.capacity - self.free[chosen]) ** 2).sum()):
                self.steps["refit"] += 1
                for b, ps in zip(chosen.tolist(), [*made, *[[]] * (len(chosen) - len(made))], strict=True):
                    self._hold(b, list(ps))
                return True
            if many >= len(live):
                break
        return False

    def improve(self, least: int) -> None:
        """Steps until the bins are no more than ``least``, or no step is left."""
        again = True
        while again and self.alive.sum() > least:
            again, untried = False, self.alive.copy()
            while self.alive.sum() > least:
                free = np.where(untried & self.alive, self.free, 0)
                a = int(free.argmax())
                if not free[a]:
                    break
                while self.bins[a] and self.give(a):
                    again = True
                untried[a] = False
                if not self.bins[a]:  # the other bins may have steps now
                    untried = self.alive.copy()
            if self.alive.sum() > least:
                again |= self.refit()


def pack(lengths: list[int], capacity: int, search: bool = True) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; lengths are from 1 to ``capacity``. Full pieces are bins of their own."""
    part = [p for p in range(len(lengths)) if lengths[p] < capacity]
    size = [lengths[p] for p in part]
    bins = best_fit(size, sorted(range(len(size)), key=lambda i: 2 * size[i] <= capacity), capacity)
    if search:
        found = Search(size, bins, capacity)
        found.improve(lower_bound(size, capacity))
        bins = found.bins
    out, number = [(0, 0)] * len(lengths), 0
    for pieces in [*([part[i] for i in b] for b in bins if b), *([p] for p in range(len(lengths)) if lengths[p] == capacity)]:
        at = 0
        for p in pieces:
            out[p] = (number, at)
            at += lengths[p]
        number += 1
    return out


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and ``__deal`` to deal groups by.

    Texts don't leave their task. ``__deal`` is a hash of the piece, of its partition and of how many
    pieces like it the task had before, so that repeated rows or ids are dealt evenly, too.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        with encoder(vocabulary) as coder:
            for batch in batches:
                doc_ids, texts = batch.column("doc_id"), batch.column("text")
                for first, last in slices(texts):
                    ids, counts = coder.encode(texts.slice(first, last - first))
                    flat = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                    sizes = counts + 1
                    pieces = -(-sizes // capacity)
                    which = np.repeat(np.arange(len(sizes)), pieces)
                    piece = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                    start = piece * capacity
                    length = np.minimum(capacity, sizes[which] - start)
                    at = (np.cumsum(sizes) - sizes)[which] + start
                    crc = [zlib.crc32(flat[i : i + n]) for i, n in zip(at.tolist(), length.tolist(), strict=True)]
                    owner = doc_ids.take(pa.array(which + first))
                    deal = []
                    for like in zip(owner.to_pylist(), piece.tolist(), crc, strict=True):
                        deal.append(zlib.crc32(repr((like, part, seen[hash(like)])).encode()))
                        seen[hash(like)] += 1
                    columns = [owner, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(deal, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "__deal"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, __deal bigint")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone; repeated rows are packed as often as they occur; an
    empty table gives an empty result; other columns are not carried. Only light rows are shuffled. A
    group holds about ``group_pieces`` pieces that are shorter than a sequence at any corpus size, so
    its task is bounded, whatever ids are null or repeated.
    """
    pieces = materialize(cut_pieces(docs, vocabulary, capacity, end_id), "pieces")
    groups = max(1, -(-pieces.where(F.col("length") < capacity).count() // group_pieces), -(-pieces.count() // (8 * group_pieces)))
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64("__deal"), F.lit(groups))).drop("__deal")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.drop("__group").schema)

    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32")])
        placed = pack(rows.column("length").to_pylist(), capacity)
        base = rows.column("__group")[0].as_py() << 40
        out = rows.drop_columns(["__group"])
        out = out.append_column("sequence_id", pa.array([base + b for b, _ in placed], pa.int64()))
        return out.append_column("offset", pa.array([at for _, at in placed], pa.int64()))

    return spread(dealt, groups, "__group").groupBy("__group").applyInArrow(run, f"{fields}, sequence_id bigint, offset bigint")
