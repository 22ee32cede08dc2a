"""Quality scores from compression: how much better does a dictionary of good text compress a text?

Two zstandard dictionaries are built, from text labelled good and from text labelled bad. A text is
cut into blocks of equal size, each block is compressed with either dictionary, and the normalised
difference of the two totals ``(bad - good) / (bad + good)`` goes through a logistic calibration
fitted on labelled rows that neither dictionary has seen.

Fitting takes bounded samples: of labelled rows, and of the blocks of those rows, each by hash and
without regard to the length of a text. Only blocks and differences come to the driver, no texts.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.llm.common import materialize, text_of

#: At most so many labelled rows of each class build the dictionaries, and as many more calibrate.
MAX_TRAINING_ROWS = 2000
#: At most so many blocks of the rows of a class build its dictionary: 8 MiB of text.
MAX_TRAINING_BLOCKS = 8192
DICTIONARY_BYTES = 112_640
BLOCK_BYTES = 1024
LEVEL = 3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def scorer(self) -> Scorer:
        return Scorer(self)


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if data is not None:
        data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL if data is None else 0, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


class Scorer:
    """Compresses with both dictionaries; one of these lives in each task."""

    def __init__(self, model: QualityModel) -> None:
        self.model = model
        self.pair = _compressor(model.bad), _compressor(model.good)

    def difference(self, text: bytes) -> float:
        """Over the whole text; positive if the good dictionary fits better, 0 for an empty one."""
        bad = good = 0
        for block in blocks_of(text):
            bad += len(self.pair[0].compress(block))
            good += len(self.pair[1].compress(block))
        return (bad - good) / (bad + good) if bad + good else 0.0

    def score(self, text: bytes) -> float:
        z = self.model.slope * self.difference(text) + self.model.intercept
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def blocks_of(text: bytes) -> list[bytes]:
    return [text[at : at + BLOCK_BYTES] for at in range(0, len(text), BLOCK_BYTES)]


def _dictionary(blocks: list[bytes]) -> bytes:
    """Trained on the blocks; where they are too few for that, they are the dictionary themselves.

    In that case the first blocks that fit are taken; their order is that of hashes, not of the text.
    """
    if not blocks:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[:DICTIONARY_BYTES]


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one variable by Newton steps, with a weak pull to zero."""
    if not len(x):
        return 0.0, 0.0
    scale = float(np.std(x)) or 1.0
    weight = weight * (len(x) / weight.sum())  # the pull stays in proportion to the sample
    a = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + 0.01 * w
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(2), gradient)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def _sampled_blocks(most: int):
    """Of each class the blocks with the least hashes of (row, place), at most ``most`` of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {0: [], 1: []}  # heaps with the greatest hash first
        for batch in batches:
            for y, row, text in zip(*(batch.column(c).to_pylist() for c in ("__y", "__h", "__t")), strict=True):
                for place, block in enumerate(blocks_of(text.encode())):
                    entry = (-(xxhash.xxh64_intdigest(place.to_bytes(8), seed=row % 2**64) >> 1), block)
                    if len(held[y]) < most:
                        heapq.heappush(held[y], entry)
                    elif entry > held[y][0]:
                        heapq.heapreplace(held[y], entry)
        rows = [(y, -order, block) for y, heap in held.items() for order, block in heap]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["y", "order", "block"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", use: Column | None = None, max_rows: int = MAX_TRAINING_ROWS, max_blocks: int = MAX_TRAINING_BLOCKS) -> QualityModel:
    """Fit on a bounded sample: the labelled rows with the smallest hashes of ``doc_id``.

    Of each class at most ``2 * max_rows`` rows are taken, however long; even hashes build the
    dictionary, odd ones calibrate. Of the text of those that build, at most ``max_blocks`` blocks of a
    class are taken by hash of row and place, so any part of any text may be among them; those that
    calibrate are compressed whole, in tasks. A row that calibrates weighs as many eligible rows
    as it stands for, so the share of the classes that the scores rest on is that of all eligible rows
    and does not depend on ``max_rows``. ``use`` says which label rows may be learned
    from. Null ids and labels are skipped, so are empty texts; repeated rows count once, a document
    labelled both ways counts in both classes. Without labels every score is 0.5.
    """
    rows = labels if use is None else labels.where(use)
    rows = rows.select("doc_id", F.col(label).cast("int").alias("__y")).where("doc_id is not null and __y in (0, 1)").distinct()
    rows = rows.withColumn("__h", F.xxhash64("doc_id"))
    texts = docs.select("doc_id", text_of().alias("__t")).where(F.octet_length("__t") > 0)
    known = rows.join(docs.where(F.octet_length(text_of()) > 0).select("doc_id").distinct(), "doc_id")
    eligible = {(r["__y"], r["half"]): r["count"] for r in known.groupBy("__y", F.expr("pmod(__h, 2)").alias("half")).count().collect()}
    picked = [known.where(f"__y = {y} and pmod(__h, 2) = {half}").orderBy("__h", "doc_id").limit(max_rows) for y in (0, 1) for half in (0, 1)]
    # at most 4 * max_rows ids, so the broadcast is bounded; the sample is written, as it is read twice
    wanted = F.broadcast(picked[0].unionByName(picked[1]).unionByName(picked[2]).unionByName(picked[3]))
    sample = materialize(texts.join(wanted, "doc_id").select("__y", "__h", "doc_id", "__t").distinct(), "labelled-sample")
    sampled = sample.where("pmod(__h, 2) = 0").mapInArrow(_sampled_blocks(max_blocks), "y int, order bigint, block binary")
    build = {y: [bytes(r["block"]) for r in sampled.where(f"y = {y}").orderBy("order", "block").limit(max_blocks).collect()] for y in (0, 1)}
    unscaled = QualityModel(_dictionary(build[1]), _dictionary(build[0]), 0.0, 0.0)
    held = sample.where("pmod(__h, 2) = 1")
    if held.select("__y").distinct().count() < 2:
        held = sample
    measured = _scored(held.select("__y", F.expr("pmod(__h, 2)").alias("half"), F.col("__t").alias("text")), unscaled, "x", Scorer.difference)
    # at most 4 * max_rows rows of three numbers, in an order of their own
    found = sorted((r["x"], r["__y"], r["half"]) for r in measured.select("x", "__y", "half").collect())
    stands_for = {k: n / min(n, max_rows) for k, n in eligible.items()}
    weight = np.array([stands_for[y, half] for _, y, half in found])
    slope, intercept = _calibrate(np.array([x for x, _, _ in found]), np.array([y for _, y, _ in found], float), weight)
    return QualityModel(unscaled.good, unscaled.bad, slope, intercept)


def _scored(docs: DataFrame, model: QualityModel, out: str, measure: Callable[[Scorer, bytes], float]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != out]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            texts = batch.column("text")
            scores = [measure(scorer, texts[i].as_py().encode() if texts[i].is_valid else b"") for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores, pa.float64())], names=[*kept, out])

    return docs.mapInArrow(run, schema)


def score_quality(docs: DataFrame, model: QualityModel, out: str = "score") -> DataFrame:
    """Add ``out``, a double from 0 to 1, to every row; other columns pass through.

    Null and empty texts get the calibrated score of a difference of 0. A column named ``out`` is
    replaced. Texts of any length are scored whole.
    """
    return _scored(docs, model, out, Scorer.score)


def held_out(column: str = "doc_id") -> Column:
    """Every fifth document by the checksum of its id; a null id is not among them."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))
