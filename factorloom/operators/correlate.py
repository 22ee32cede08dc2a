"""Rank correlations of many factors at once.

The rows are cut into blocks. A block's values of a factor go, packed, to the ranges in which they lie, and come back as ranks: a value's
rank is the number of rows in the ranges before, of those before it in its range, and half of its own. So no task sorts a
factor's whole history, and what moves is a row for each block, factor and range. All pairs then come from one product of a block's
matrix of ranks with itself; no row is repeated for a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.expressions import centred_rank, safe_div
from factorloom.sources.scratch import written

SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
#: Values of a range, about: what is sorted at a time.
RANGE = 250_000
#: Ranges of a group and factor at most; beyond that they grow.
RANGES = 1000
#: Rows of a block, about: what is multiplied at a time.
BLOCK = 65_536


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _cells(block: pa.Table, names: list[str], keys: list[str], groups: list[tuple]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each group and factor of a block: the numbers of both, its rows, its values."""
    number = {key: g for g, key in enumerate(groups)}
    group = np.array([number[key] for key in zip(*(block.column(k).to_pylist() for k in keys), strict=True)]) if keys else np.zeros(block.num_rows, int)
    there = np.unique(group)
    for i, name in enumerate(names):
        column = block.column(name)
        known, x = column.is_valid().to_numpy(), column.to_numpy()
        for g in there.tolist():
            rows = np.flatnonzero(known & (group == g))
            if len(rows):
                yield g, i, rows, x[rows]


def _ranges(values: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """2k below split k, 2k + 1 on it."""
    return np.searchsorted(splits, values) + np.searchsorted(splits, values, "right")


def _summaries(parts: int, *how):
    """Of a block's values of a group and factor, in order, those at even steps, four for each range, and the step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            for g, i, _, values in _cells(block, *how):
                n = min(len(values), 4 * parts)
                points = np.sort(values)[((np.arange(n) + 0.5) * len(values) / n).astype(int)]
                yield pa.RecordBatch.from_pydict({"g": pa.array([g], pa.int32()), "i": pa.array([i], pa.int32()), "points": pa.array([points.astype(np.float32).tobytes()], pa.binary()), "step": pa.array([len(values) / n])})

    return run


def _split(parts: int):
    """Where a factor's ranges meet. A range has its share of the group's values, and up to half a share more; or it is one value."""

    def run(key: tuple, summaries: pa.Table) -> pa.Table:
        packed = summaries.column("points").to_pylist()
        points = np.frombuffer(b"".join(packed), np.float32)
        steps = np.repeat(summaries.column("step").to_numpy(), [len(p) // 4 for p in packed])
        order = np.argsort(points)
        upto = np.cumsum(steps[order])
        at = np.minimum(np.searchsorted(upto, np.arange(1, parts) / parts * upto[-1]), len(order) - 1)
        splits = np.unique(points[order][at])
        return pa.table({"g": pa.array([key[0].as_py()], pa.int32()), "i": pa.array([key[1].as_py()], pa.int32()), "splits": pa.array([splits.tolist()], pa.list_(pa.float32()))})

    return run


def _counted(splits: dict[tuple[int, int], np.ndarray], *how):
    """How many values of a group and factor a block has in each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            for g, i, _, values in _cells(block, *how):
                counts = np.bincount(_ranges(values, splits[g, i]))
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_pydict({"g": pa.array([g] * len(some), pa.int32()), "i": pa.array([i] * len(some), pa.int32()), "range": pa.array(some, pa.int64()), "count": pa.array(counts[some], pa.int64())})

    return run


def _pieces(splits: dict[tuple[int, int], np.ndarray], *how):
    """A block's values of a group and factor that are in one range, and their rows. Those on a split need no sorting, so each block's are a part of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in enumerate(_blocks(batches)):
            name = (TaskContext.get().partitionId() << 32) + number
            for g, i, rows, values in _cells(block, *how):
                ranges = _ranges(values, splits[g, i])
                order = np.argsort(ranges, kind="stable")
                found, starts = np.unique(ranges[order], return_index=True)
                cut = lambda x: pa.array([part.tobytes() for part in np.split(x[order], starts[1:])], pa.binary())  # noqa: E731, B023
                same = lambda x, kind: pa.array([x] * len(found), kind)  # noqa: E731, B023
                yield pa.RecordBatch.from_pydict({"g": same(g, pa.int32()), "i": same(i, pa.int32()), "range": pa.array(found, pa.int64()), "part": pa.array(np.where(found % 2, name, -1), pa.int64()), "block": same(name, pa.int64()), "rows": cut(rows.astype(np.int32)), "cells": cut(values.astype(np.float32))})

    return run


def _ranked(counts: dict[tuple[int, int], np.ndarray]):
    """The pieces of one range with ranks for values: twice the average rank among the group's values of the factor, less its mean."""

    def run(key: tuple, pieces: pa.Table) -> pa.Table:
        g, i, here, _ = (k.as_py() for k in key)
        count = counts[g, i]
        before = 2 * int(count[:here].sum()) - int(count.sum())
        packed = pieces.column("cells").to_pylist()
        values = np.frombuffer(b"".join(packed), np.float32)
        if here % 2:
            ranks = np.full(len(values), before + count[here], np.int64)
        else:
            _, place, own = np.unique(values, return_inverse=True, return_counts=True)
            ranks = (before + 2 * (np.cumsum(own) - own) + own).astype(np.int64)[place]
        parts = np.split(ranks, np.cumsum([len(p) // 4 for p in packed])[:-1])
        return pieces.select(["block", "g", "i", "rows"]).append_column("ranks", pa.array([p.tobytes() for p in parts], pa.binary()))

    return run


def _sums(a: np.ndarray, m: np.ndarray) -> dict[str, pa.Array]:
    """Partial sums of each two factors that share rows, of ranks (0 where unknown) and of which are known."""
    first, second = np.triu_indices(a.shape[1], 1)
    n, s, q, p = m.T @ m, a.T @ m, (a * a).T @ m, a.T @ a
    some = n[first, second] > 0
    i, j = first[some], second[some]
    return {"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), **{k: pa.array(v[0][v[1], v[2]]) for k, v in {"n": (n, i, j), "sx": (s, i, j), "sy": (s, j, i), "sxx": (q, i, j), "syy": (q, j, i), "sxy": (p, i, j)}.items()}}


def _block_products(names: list[str]):
    """Partial sums of each pair of factors over a block, for each group in it."""

    def run(pieces: pa.Table) -> pa.Table:
        at = [np.frombuffer(b, np.int32) for b in pieces.column("rows").to_pylist()]
        size = 1 + max(int(r.max()) for r in at)
        x, there, group = np.zeros((size, len(names))), np.zeros((size, len(names))), np.full(size, -1)
        for rows, ranks, g, i in zip(at, *(pieces.column(c).to_pylist() for c in ("ranks", "g", "i")), strict=True):
            x[rows, i], there[rows, i], group[rows] = np.frombuffer(ranks, np.int64), 1, g
        tables = []
        for g in np.unique(group[group >= 0]).tolist():
            columns = _sums(x[group == g], there[group == g])
            tables.append(pa.table({"g": pa.array([g] * len(columns["i"]), pa.int32()), **columns}))
        return pa.concat_tables(tables)

    return run


def _products(names: list[str], keys: list[str]):
    """Partial sums of each pair of factors over the rows of a batch, for each key in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            named = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            number = {g: i for i, g in enumerate(dict.fromkeys(named))}
            group = np.array([number[g] for g in named])
            lists = batch.column("ranks")
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            cells = lists.flatten()
            x, there = np.zeros((batch.num_rows, len(names))), np.zeros((batch.num_rows, len(names)))
            column = cells.field("i").to_numpy(zero_copy_only=False)
            x[row, column], there[row, column] = cells.field("rank").to_numpy(zero_copy_only=False), 1
            for called, g in number.items():
                columns = _sums(x[group == g], there[group == g])
                columns |= {k: pa.array([v] * len(columns["i"]), batch.schema.field(k).type) for k, v in zip(keys, called, strict=True)}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _sums_by_date(values: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """A cross-section is one date's, so a window ranks it."""
    index = F.create_map(*[F.lit(v) for i, n in enumerate(names) for v in (n, i)])[F.col("factor_name")].alias("i")
    ids = list(dict.fromkeys(["trade_date", "code", *keys]))
    long = values.unpivot(ids, names, "factor_name", "factor").where("factor is not null").select(*ids, index, F.col("factor").cast("float").alias("factor"))
    ranked = long.withColumn("rank", centred_rank(F.col("factor"), *keys, "i"))
    rows = ranked.groupBy(*ids).agg(F.collect_list(F.struct("i", F.col("rank").cast("double").alias("rank"))).alias("ranks")).select(*keys, "ranks")
    kinds = {f.name: f.dataType.simpleString() for f in values.schema}
    shape = ", ".join(["i int", "j int", *[f"{s} double" for s in SUMS], *[f"{k} {kinds[k]}" for k in keys]])
    return rows.mapInArrow(_products(names, keys), shape)


def _sums_by_range(values: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """The driver gets the splits between ranges and how many values are in each: of a group and factor one for some ``RANGE`` rows."""
    wide = written(values.select(*keys, *[F.col(n).cast("float").alias(n) for n in names]), "factor-values")
    found = wide.groupBy(*keys).count().collect()
    groups = [tuple(r[k] for k in keys) for r in found]
    parts = max(2, min(RANGES, -(-max([r["count"] for r in found], default=0) // RANGE)))
    how = (names, keys, groups)
    points = wide.mapInArrow(_summaries(parts, *how), "g int, i int, points binary, step double")
    splits = {(r.g, r.i): np.array(r.splits, np.float32) for r in points.groupBy("g", "i").applyInArrow(_split(parts), "g int, i int, splits array<float>").collect()}
    counts = {at: np.zeros(2 * len(s) + 1, np.int64) for at, s in splits.items()}
    for r in wide.mapInArrow(_counted(splits, *how), "g int, i int, range bigint, count bigint").groupBy("g", "i", "range").agg(F.sum("count").alias("count")).collect():
        counts[r.g, r.i][r.range] = r["count"]
    pieces = wide.mapInArrow(_pieces(splits, *how), "g int, i int, range bigint, part bigint, block bigint, rows binary, cells binary")
    ranks = pieces.groupBy("g", "i", "range", "part").applyInArrow(_ranked(counts), "block bigint, g int, i int, rows binary, ranks binary")
    sums = ranks.groupBy("block").applyInArrow(_block_products(names), ", ".join(["g int", "i int", "j int", *[f"{s} double" for s in SUMS]]))
    if not keys:
        return sums
    named = values.sparkSession.createDataFrame([(g, *key) for g, key in enumerate(groups)], "g int, " + ", ".join(f"{k} {values.schema[k].dataType.simpleString()}" for k in keys))
    return sums.join(F.broadcast(named), "g")


def rank_correlations(values: DataFrame, names: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, first, second, rho, n for each two factors that share rows; pooled, or within ``keys``: of few groups, or with trade_date.

    ``values`` has trade_date, code and a column for each factor. A factor is ranked among all its own values; a pair
    is correlated over the rows that have both. Null where either is constant there. Values are ranked in single precision: what is
    equal but for the last digits of a sum taken in another order shares its rank.
    """
    parts = (_sums_by_date if "trade_date" in keys else _sums_by_range)(values, names, list(keys))
    sums = parts.groupBy(*keys, "i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])
    c = F.col
    spread = lambda s, q: F.sqrt(F.greatest(c("n") * c(q) - c(s) * c(s), F.lit(0.0)))
    rho = safe_div(c("n") * c("sxy") - c("sx") * c("sy"), spread("sx", "sxx") * spread("sy", "syy"))
    called = F.array(*map(F.lit, names))
    return sums.select(*keys, called[c("i")].alias("first"), called[c("j")].alias("second"), rho.alias("rho"), c("n").cast("bigint").alias("n"))
