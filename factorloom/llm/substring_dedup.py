"""Exact removal of long passages that an earlier document already has.

Sparse suffix arrays find them. Of all suffixes those are indexed that start at the least k-mer (by
hash) of some window of ``match`` bytes; equal windows choose the same place, so every match of a window
is met at its indexed suffix. Entries of a batch are sorted by the digest of the region around the
suffix; batches go into a logarithmic family of such arrays, in which a new one is merge-scanned
against every level and levels of equal size are merged. Only equality of long stretches matters here,
hence the order by digest and not by letter.

Most matches cover the whole region of an entry. Where regions differ though their k-mers agree, as at
the ends of a passage, the windows of these entries are compared one by one in a second, equal pass.

The family can be kept in a folder. A later run then adds its batches to the levels that are there, and
only its own documents are cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import give_back, materialize, row_groups, text_of

#: Bytes of the k-mers whose hashes choose the suffixes.
K = 20
#: Bytes of text that are hashed at once, and bytes whose entries are one batch.
SLICE_BYTES = 1_000_000
BATCH_BYTES = 32_000_000
#: Bytes of text whose entries are one bucket, and of one partition of texts, on average.
BUCKET_BYTES = 48_000_000
#: Places take the low bits of a sort key, hashes the rest.
PLACE_BITS = 30
#: A null id stands before all others.
FIRST = -(2**63)

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C[1]
    x = (x ^ (x >> np.uint64(27))) * _C[2]
    return x ^ (x >> np.uint64(31))


def _eights(data: np.ndarray) -> np.ndarray:
    """At each place the eight bytes from there as one number; zeros follow the end."""
    x = np.zeros(len(data) + 8, np.uint64)
    x[: len(data)] = data
    for step in (1, 2, 4):
        x[:-step] |= x[step:] << np.uint64(8 * step)
    return x[: len(data)]


def _stretch_hashes(eights: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each stretch of 8 bytes or more, with its length."""
    acc = _mix(size.astype(np.uint64) * _C[0] + np.uint64(seed))
    last = start + size - 8
    for step in range(0, int(size.max(initial=8)), 8):
        at = start + step
        inside = at < last + 8
        word = eights[np.minimum(at, last)]
        acc = np.where(inside, _mix((acc ^ word) * _C[0] + _C[3]), acc)
    return acc


class Entries:
    """Columns of index entries: digest, kmer, doc (a row of the batch's documents), start, windows.

    ``left`` and ``right`` are check values of the k-mer with half of what a window has beside it; a
    window shares one or the other. They are 0 where no window of the entry reaches so far.
    """

    NAMES = (("digest", "<u8"), ("kmer", "<u4"), ("doc", "<u4"), ("start", "<u4"), ("windows", "u1"), ("left", "u1"), ("right", "u1"))

    def __init__(self, **columns: np.ndarray) -> None:
        self.__dict__.update(columns)

    def __len__(self) -> int:
        return len(self.digest)

    def take(self, which: np.ndarray) -> Entries:
        return Entries(**{name: getattr(self, name)[which] for name, _ in self.NAMES})

    @classmethod
    def concat(cls, parts: list[Entries]) -> Entries:
        return cls(**{name: np.concatenate([getattr(p, name) for p in parts] or [np.zeros(0, kind)]) for name, kind in cls.NAMES})


class Docs:
    """Of each document: its id, the key of its row and its partition."""

    NAMES = (("id", "<i8"), ("row", "<i8"), ("part", "<i4"))

    def __init__(self, **columns: np.ndarray) -> None:
        self.__dict__.update(columns)

    def take(self, which: np.ndarray) -> Docs:
        return Docs(**{name: getattr(self, name)[which] for name, _ in self.NAMES})


def _packed(docs: Docs, entries: Entries) -> bytes:
    """Entries with those documents that they need, as compressed columns."""
    used, doc = np.unique(entries.doc, return_inverse=True)
    docs = docs.take(used)
    steps = {"doc": np.diff(doc, prepend=0)}
    parts = [np.array([len(used), len(entries)], "<u4").tobytes()]
    parts += [np.diff(getattr(docs, name), prepend=0).astype(kind).tobytes() for name, kind in Docs.NAMES]
    parts += [steps.get(name, getattr(entries, name)).astype(kind).tobytes() for name, kind in Entries.NAMES]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpacked(data: bytes) -> tuple[Docs, Entries]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n_docs, n = np.frombuffer(raw, "<u4", 2).tolist()
    at, columns = 8, {}
    for names, count in ((Docs.NAMES, n_docs), (Entries.NAMES, n)):
        for name, kind in names:
            columns[name] = np.frombuffer(raw, kind, count, at)
            at += count * np.dtype(kind).itemsize
    columns["doc"] = np.cumsum(columns["doc"], dtype="<u4")
    docs = Docs(**{name: np.cumsum(columns[name], dtype=kind) for name, kind in Docs.NAMES})
    return docs, Entries(**{name: columns[name] for name, _ in Entries.NAMES})


def sparse_suffixes(data: np.ndarray, bounds: np.ndarray, match: int) -> Entries:
    """The entries of texts that lie one after another in ``data``; ``bounds`` are their edges."""
    width = match - K + 1
    n = len(data) - match + 1
    if n <= 0:
        return Entries.concat([])
    eights = _eights(data)
    hashes = _mix(eights * _C[0] ^ np.roll(eights, -8) * _C[3] ^ np.roll(eights, 8 - K) * _C[2])
    least = (hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(data), dtype=np.uint64)
    done = 1
    while 2 * done <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    least = np.minimum(least[: n if width == done else None][:n], least[width - done :][:n])
    place = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
    whole = np.arange(n) + match <= bounds[doc + 1]  # windows within a text
    at = np.flatnonzero(whole)
    if not len(at):
        return Entries.concat([])
    new = np.flatnonzero(np.diff(place[at], prepend=-1) | (np.diff(at, prepend=-2) != 1))
    start, windows = at[new], np.diff(np.append(new, len(at)))
    anchor = place[start]
    region = _stretch_hashes(eights, start, windows + match - 1, 1)
    region = _mix(region ^ (anchor - start).astype(np.uint64) * _C[0])
    half = (match - K + 1) // 2
    sides = {}
    for side, there, first in (("left", start <= anchor - half, anchor - half), ("right", start + windows - 1 + match >= anchor + K + half, anchor)):
        value = np.zeros(len(start), "u1")
        at = first[there]
        value[there] = _stretch_hashes(eights, at, np.full(len(at), K + half), 4) % np.uint64(255) + np.uint64(1)
        sides[side] = value
    return Entries(digest=region, kmer=(hashes[anchor] >> np.uint64(32)).astype("<u4"), doc=doc[start].astype("<u4"), start=(start - bounds[doc[start]]).astype("<u4"), windows=windows.astype("u1"), **sides)


def single_windows(data: np.ndarray, start: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window of ``match`` bytes: the digest, and one in place of the k-mer's."""
    eights, size = _eights(data), np.full(len(start), match)
    return _stretch_hashes(eights, start, size, 2), (_stretch_hashes(eights, start, size, 3) >> np.uint64(32)).astype("<u4")


def settle(entries: Entries, ids: np.ndarray) -> np.ndarray:
    """Which entries of one batch have an equal one in a document of smaller id, also in the batch."""
    if not len(entries):
        return np.zeros(0, bool)
    order = np.lexsort([entries.kmer, entries.digest])
    digest, kmer, id_ = entries.digest[order], entries.kmer[order], ids[entries.doc[order]]
    new = np.flatnonzero(np.concatenate([[True], (digest[1:] != digest[:-1]) | (kmer[1:] != kmer[:-1])]))
    least = np.repeat(np.minimum.reduceat(id_, new), np.diff(np.append(new, len(order))))
    out = np.zeros(len(order), bool)
    out[order] = id_ > least
    return out


class Level:
    """A sorted array of live entries: digest, kmer, id of the document, and the entry's number."""

    def __init__(self, digest: np.ndarray, kmer: np.ndarray, ids: np.ndarray, number: np.ndarray) -> None:
        self.digest, self.kmer, self.ids, self.number = digest, kmer, ids, number

    def __len__(self) -> int:
        return len(self.digest)


class Family:
    """The logarithmic family; ``later[i]`` tells whether a smaller document has entry i as well."""

    def __init__(self, total: int) -> None:
        self.later = np.zeros(total, bool)
        self.levels: list[Level] = []

    def hold(self, digest: np.ndarray, kmer: np.ndarray, ids: np.ndarray, first: int) -> Level:
        """A level of an earlier run, whose entries are numbered from ``first``."""
        order = np.argsort(digest, kind="stable")
        self.levels.append(Level(digest[order], kmer[order], ids[order], first + order))
        return self.levels[-1]

    def add(self, digest: np.ndarray, kmer: np.ndarray, ids: np.ndarray, first: int) -> None:
        """A batch, whose entries are numbered from ``first``, and of which equal ones share their id."""
        new = self.hold(digest, kmer, ids, first)
        for level in self.levels[:-1]:
            self._scan(new, level)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(self._merge(a, b))

    def _scan(self, new: Level, level: Level) -> None:
        left, right = np.searchsorted(level.digest, new.digest, "left"), np.searchsorted(level.digest, new.digest, "right")
        for step in range(int((right - left).max(initial=0))):  # runs of equal digests are short
            here = np.flatnonzero(left + step < right)
            there = left[here] + step
            same = level.kmer[there] == new.kmer[here]
            here, there = here[same], there[same]
            self.later[new.number[here[new.ids[here] > level.ids[there]]]] = True
            self.later[level.number[there[level.ids[there] > new.ids[here]]]] = True

    def _merge(self, a: Level, b: Level) -> Level:
        columns = [np.concatenate([getattr(a, n), getattr(b, n)]) for n in ("digest", "kmer", "ids", "number")]
        columns = [c[~self.later[columns[3]]] for c in columns]  # settled entries leave the index
        order = np.argsort(columns[0], kind="stable")  # two sorted runs: one linear merge
        return Level(*(c[order] for c in columns))


def doubtful(entries: Entries, ids: np.ndarray) -> np.ndarray:
    """Entries that may share a window with another region of another document.

    They agree with it in the k-mer and in what is beside it on the left or on the right.
    """
    out = np.zeros(len(entries), bool)
    for side in (entries.left, entries.right):
        key = entries.kmer.astype(np.int64) << 8 | side
        order = np.argsort(key, kind="stable")
        order = order[side[order] > 0]
        if not len(order):
            continue
        new = np.flatnonzero(np.diff(key[order], prepend=-1))
        varied = np.ones(len(new), bool)
        for column in (entries.digest[order], ids[order]):
            varied &= np.minimum.reduceat(column, new) != np.maximum.reduceat(column, new)
        out[order] |= np.repeat(varied, np.diff(np.append(new, len(order))))
    return out


def _by(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    for which in np.split(order, cuts) if len(order) else ():
        yield int(key[which[0]]), which


OUT = "bucket int, kind string, payload binary"


def _rows(rows: list[tuple[int, str, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary())], names=["bucket", "kind", "payload"])


def _marks(docs: Docs, entries: Entries) -> list[tuple[int, str, bytes]]:
    """Matched entries for the partitions of their documents; the digests are no longer needed."""
    bare = Entries(**{n: getattr(entries, n) if n in ("doc", "start", "windows") else np.zeros(len(entries), kind) for n, kind in Entries.NAMES})
    return [(part, "mark", _packed(docs, bare.take(which))) for part, which in _by(docs.part[entries.doc])]


def _batch(docs: Docs, entries: Entries, buckets: int) -> list[tuple[int, str, bytes]]:
    """What a batch sends: entries by bucket of their k-mer, and what it could settle by itself."""
    later = settle(entries, docs.id)
    rows = [(part, f"settled-{kind}", payload) for part, kind, payload in _marks(docs, entries.take(later))]
    live = entries.take(~later)
    bucket = (_mix(live.kmer.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    return rows + [(b, "entries", _packed(docs, live.take(which))) for b, which in _by(bucket)]


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and the edges between them."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return (data[edges[0] : edges[-1]], edges - edges[0]) if len(texts) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))


def _doc_columns(batch: pa.RecordBatch | pa.Table) -> Docs:
    def column(name: str) -> np.ndarray:
        return pa.chunked_array([batch.column(name)] if isinstance(batch, pa.RecordBatch) else batch.column(name).chunks, batch.schema.field(name).type).to_numpy()

    return Docs(id=column("__id"), row=column("__row"), part=column("__part").astype("<i4"))


def _index(match: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[Docs] = []
        entries: list[Entries] = []
        held = n_docs = 0

        def sent() -> Iterator[pa.RecordBatch]:
            joined = Docs(**{n: np.concatenate([getattr(d, n) for d in docs]) for n, _ in Docs.NAMES})
            yield from _rows(_batch(joined, Entries.concat(entries), buckets)).to_batches()

        for batch in batches:
            texts, columns = batch.column("text"), _doc_columns(batch)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, last in row_groups(sizes, SLICE_BYTES):
                data, edges = _buffer(texts.slice(first, last - first))
                found = sparse_suffixes(data, edges, match)
                found.doc = found.doc + np.uint32(n_docs)
                docs.append(columns.take(np.arange(first, last)))
                entries.append(found)
                n_docs, held = n_docs + last - first, held + len(data)
                if held >= BATCH_BYTES:
                    yield from sent()
                    docs, entries, held, n_docs = [], [], 0, 0
                    give_back()
        if docs:
            yield from sent()
        docs, entries = [], []
        give_back()

    return run


def _joined(batches: list[tuple[Docs, Entries]]) -> tuple[Docs, Entries]:
    """All batches as one, so that a bucket has one answer for each partition of documents."""
    docs = Docs(**{n: np.concatenate([getattr(d, n) for d, _ in batches] or [np.zeros(0, kind)]) for n, kind in Docs.NAMES})
    entries = Entries.concat([e for _, e in batches])
    before = np.cumsum([0, *(len(d.id) for d, _ in batches)])[:-1]
    entries.doc = entries.doc + np.repeat(before, [len(e) for _, e in batches]).astype("<u4")
    return docs, entries


def _match(ask: bool, keep: bool = False):
    """One bucket: its batches through the family. ``ask``: for the doubtful entries' windows, too.

    ``keep``: the levels go into the answer, for a later run.
    """

    def run(group: pa.Table) -> pa.Table:
        rows, levels, batches = [], [], []
        for bucket, kind, payload in zip(*(group.column(n).to_pylist() for n in ("bucket", "kind", "payload")), strict=True):
            if kind == "entries":
                batches.append(payload)
            elif kind == "level":
                levels.append(payload)
            else:
                rows.append((bucket, kind.removeprefix("settled-"), payload))
        # whatever order they came in: large levels first, then the batches
        parts = [_unpacked(p) for p in [*sorted(levels, key=lambda p: (-len(p), p)), *sorted(batches)]]
        edges = np.cumsum([0, *(len(e) for _, e in parts)])
        family = Family(int(edges[-1]))
        for k, ((docs, entries), first) in enumerate(zip(parts, edges, strict=False)):
            step = family.hold if k < len(levels) else family.add
            step(entries.digest, entries.kmer, docs.id[entries.doc], int(first))
        unsure = np.zeros(int(edges[-1]), bool)
        if ask and parts:
            live = ~family.later
            ids = np.concatenate([d.id[e.doc] for d, e in parts])
            unsure[live] = doubtful(Entries.concat([e for _, e in parts]).take(live), ids[live])
        docs, entries = _joined(parts)
        rows += _marks(docs, entries.take(family.later))
        if ask:
            rows += [(part, "ask", payload) for part, _, payload in _marks(docs, entries.take(unsure))]
        if keep and parts:
            bucket = group.column("bucket")[0].as_py()
            rows += [(bucket, "level", _packed(docs, entries.take(level.number[~family.later[level.number]]))) for level in family.levels]
        del family, parts, docs, entries, levels, batches
        give_back()  # before the next bucket
        return _rows(rows)

    return run


def _located(docs: Docs, payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the document, start and number of windows for all entries of the payloads.

    A row key that occurs in several equal rows stands for each of them.
    """
    order = np.argsort(docs.row, kind="stable")
    keys = docs.row[order]
    found = []
    for payload in payloads:
        theirs, entries = _unpacked(payload)
        left, right = np.searchsorted(keys, theirs.row, "left")[entries.doc], np.searchsorted(keys, theirs.row, "right")[entries.doc]
        for step in range(int((right - left).max(initial=0))):
            here = np.flatnonzero(left + step < right)
            found.append((order[left[here] + step], entries.start[here].astype(np.int64), entries.windows[here].astype(np.int64)))
    return tuple(np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in range(3))


def _slices(texts: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows with their bytes and edges, so that work arrays are bounded for any partition."""
    if not texts.num_rows:
        return
    column = texts.column("text").combine_chunks()
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for first, last in row_groups(sizes, SLICE_BYTES):
        yield first, last, *_buffer(column.slice(first, last - first))


def _windows(match: int, buckets: int):
    """The windows of the entries asked for, as entries of their own."""

    def run(texts: pa.Table, asked: pa.Table) -> pa.Table:
        if not texts.num_rows or not asked.num_rows:
            return _rows([])
        docs = _doc_columns(texts)
        row, start, windows = _located(docs, asked.column("payload").to_pylist())
        order = np.argsort(row, kind="stable")
        row, start, windows = row[order], start[order], windows[order]
        found = []
        for first, last, data, edges in _slices(texts):
            mine = slice(*np.searchsorted(row, [first, last]))
            count = windows[mine]
            which = np.repeat(np.arange(len(count)), count)
            at = start[mine][which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            doc = row[mine][which]
            digest, kmer = single_windows(data, edges[doc - first] + at, match)
            one, none = np.ones(len(at), "u1"), np.zeros(len(at), "u1")
            found.append(Entries(digest=digest, kmer=kmer, doc=doc.astype("<u4"), start=at.astype("<u4"), windows=one, left=none, right=none))
        return _rows(_batch(docs, Entries.concat(found), buckets))

    return run


def _cut(match: int):
    """Texts without the bytes that matched windows cover."""

    def run(texts: pa.Table, marked: pa.Table) -> pa.Table:
        docs = _doc_columns(texts)
        row, start, windows = _located(docs, marked.column("payload").to_pylist())
        order = np.argsort(row, kind="stable")
        row, start, windows = row[order], start[order], windows[order]
        sizes, spans, kept = [], [], []
        for first, last, data, edges in _slices(texts):
            mine = slice(*np.searchsorted(row, [first, last]))
            begin = edges[row[mine] - first] + start[mine]
            depth = np.bincount(begin, minlength=len(data) + 1).astype(np.int32)
            depth -= np.bincount(begin + windows[mine] - 1 + match, minlength=len(data) + 1).astype(np.int32)
            gone = np.cumsum(depth[:-1], dtype=np.int32) > 0
            sizes.append(np.diff(edges))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                mask = gone[a:b]
                turn = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).tolist() if mask.any() else []
                spans.append([{"start": x, "end": y} for x, y in zip(turn[::2], turn[1::2], strict=True)])
                kept.append(data[a:b][~mask].tobytes() if turn else data[a:b].tobytes())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        doc_id = texts.column("doc_id").combine_chunks() if texts.num_rows else pa.array([], texts.schema.field("doc_id").type)
        return pa.table([doc_id, pa.array(np.concatenate(sizes or [np.zeros(0, np.int64)]), pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return run


class PassageIndex:
    """A family of levels in a shared folder, with the texts that its entries stand for.

    The number of buckets is that of the first run. Each run writes a generation of levels of its own,
    and a generation counts once its list is written, so a run that fails leaves the one before.
    """

    LEVELS, TEXTS = "bucket int, payload binary", "text string, __id bigint, __row bigint, __part int"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        runs = spark.createDataFrame([], "generation int, buckets int") if not self._exists("runs") else spark.read.parquet(f"{self.folder}/runs")
        last = runs.orderBy(F.desc("generation")).first()
        self.generation, self.buckets = (last["generation"], last["buckets"]) if last else (0, None)

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    def _read(self, name: str, schema: str, generations: range) -> DataFrame:
        paths = [f"{self.folder}/{name}/{g}" for g in generations]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def levels(self) -> DataFrame:
        return self._read("levels", self.LEVELS, range(self.generation, self.generation + 1) if self.generation else range(0))

    def texts(self) -> DataFrame:
        return self._read("texts", self.TEXTS, range(1, self.generation + 1))

    def append(self, levels: DataFrame, texts: DataFrame, buckets: int) -> None:
        new = self.generation + 1
        levels.write.mode("overwrite").parquet(f"{self.folder}/levels/{new}")
        texts.write.mode("overwrite").parquet(f"{self.folder}/texts/{new}")
        self.spark.createDataFrame([(new, buckets)], "generation int, buckets int").coalesce(1).write.mode("append").parquet(f"{self.folder}/runs")
        self.generation, self.buckets = new, buckets


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` with a key and the part they are dealt to: the id's, or that of id and text where ids repeat.

    So null or repeated ids spread like others; only equal rows share a part. Two of n different rows that repeat
    ids have one key with a chance of about n^2 / 2^65.
    """
    repeated = rows.groupBy("__id").count().where("count > 1").limit(1).count()
    row_key = F.xxhash64("__id", "text") if repeated else F.col("__id")
    return rows.withColumn("__row", row_key).withColumn("__part", F.pmod(F.xxhash64("__row"), F.lit(parts)).cast("int"))


def remove_repeats(docs: DataFrame, match: int = 50, index: PassageIndex | None = None) -> DataFrame:
    """doc_id, n_bytes, ``spans`` removed (start, end in bytes) and the ``kept`` bytes of each row.

    A byte goes if a window of ``match`` bytes over it also starts in a document of smaller id; windows
    are those of the input texts as UTF-8. Null text counts as empty; null ids come before all others;
    rows that share an id are never removed for each other's sake, and equal rows are cut alike; texts
    shorter than a window stay; an empty table gives an empty result; other columns are not carried.
    A hot passage is one entry a batch and place, as each batch first settles what it can by itself.

    With an ``index`` the documents of earlier runs count as well, those of smaller ids; ``docs`` are added
    to it. What earlier runs returned stays as it was. Ids are whole numbers, and unique over all runs.
    """
    if match < K + 8 or match - K + 1 > 200:
        raise ValueError(f"match must be from {K + 8} to {K + 199}")
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("__id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST)))
    # the share of a task does not grow with the table
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    parts = index.buckets if index is not None and index.buckets else parts
    rows = _dealt(rows, parts)
    own = texts = rows.select("text", "__id", "__row", "__part")
    indexed = own.mapInArrow(_index(match, parts), OUT)
    if index is not None:
        indexed = indexed.unionByName(index.levels().select("bucket", F.lit("level").alias("kind"), "payload"))
        texts = texts.unionByName(index.texts())
    first = materialize(indexed.groupBy("bucket").applyInArrow(_match(True, index is not None), OUT), "repeats")
    asked = texts.groupBy("__part").cogroup(first.where("kind = 'ask'").groupBy("bucket")).applyInArrow(_windows(match, parts), OUT)
    second = materialize(asked.groupBy("bucket").applyInArrow(_match(False), OUT), "repeated-windows")
    if index is not None:
        index.append(first.where("kind = 'level'").select("bucket", "payload"), own, parts)
    marks = first.where("kind = 'mark'").unionByName(second.where("kind = 'mark'"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {id_type}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    return rows.groupBy("__part").cogroup(marks.groupBy("bucket")).applyInArrow(_cut(match), out)
