"""Cross-sections of many factors: cleaning, information coefficients, layers and members of each date and factor in one pass.

A date's names are dealt to tasks in chunks of factors, so a name is repeated once for a chunk, not for each factor, and no table of
all names, dates and factors is sorted again for each statistic. What leaves a task is one row for each date and factor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.operators.evaluate import MIN_NAMES
from factorloom.operators.factors import Factor

GROUPS = 5


def _quantiles(ordered: np.ndarray, shares: list[float]) -> list[float]:
    """As Spark's ``percentile`` has them."""
    out = []
    for share in shares:
        at = (len(ordered) - 1) * share
        low, high = int(np.floor(at)), int(np.ceil(at))
        a, b = float(ordered[low]), float(ordered[high])
        out.append(a if a == b else (high - at) * a + (at - low) * b)
    return out


def _group(x: np.ndarray, groups: int) -> np.ndarray:
    """Equal-frequency groups from 1, closed at the right; 0 where x is unknown, and for all if edges coincide."""
    known = ~np.isnan(x)
    if not known.any():
        return np.zeros(len(x), int)
    edges = _quantiles(np.sort(x[known]), [i / groups for i in range(groups + 1)])
    if not all(a < b for a, b in zip(edges, edges[1:])):
        return np.zeros(len(x), int)
    return np.where(known, 1 + sum((x > e).astype(int) for e in edges[1:-1]), 0)


def _centred(x: np.ndarray) -> np.ndarray:
    """Twice the average rank, less its mean: whole numbers."""
    _, place, count = np.unique(x, return_inverse=True, return_counts=True)
    return (2 * (np.cumsum(count) - count) + count - len(x))[place]


def _ic(x: np.ndarray, y: np.ndarray) -> float | None:
    """Rank correlation from whole sums; None where either is constant."""
    a, b = _centred(x), _centred(y)
    total = lambda p, q: float(sum(int(p[i : i + 65536] @ q[i : i + 65536]) for i in range(0, len(p), 65536)))
    spread = np.sqrt(total(a, a)) * np.sqrt(total(b, b))
    return round(total(a, b) / spread, 12) + 0.0 if spread else None


def _cleaned(x: np.ndarray, industry: np.ndarray, size: np.ndarray, how: tuple[str, ...] | None) -> np.ndarray:
    """``clean`` of one cross-section; NaN is null. Rounded to nine digits."""
    known = np.sort(x[~np.isnan(x)])
    if not len(known):
        return x
    low, high = _quantiles(known, [0.025, 0.975])
    x = np.where(np.isnan(x), np.nan, np.maximum(low, np.minimum(high, x)))
    if how:
        x = np.where((industry < 0) if "industry" in how else False, np.nan, x)
        x = np.where(np.isnan(size), np.nan, x) if "market_cap" in how else x
        used = np.flatnonzero(~np.isnan(x))
        part = industry[used] if "industry" in how else np.zeros(len(used), int)
        counts = np.maximum(np.bincount(part), 1)
        demeaned = lambda v: v - (np.bincount(part, v) / counts)[part]
        if len(used):
            y = demeaned(x[used])
            if "market_cap" in how:
                z = demeaned(size[used])
                squares = float((z * z).sum())
                y = y - (float((y * z).sum()) / squares if squares else 0.0) * z
            x = np.full(len(x), np.nan)
            x[used] = y
    known = x[~np.isnan(x)]
    spread = known.std(ddof=1) if len(known) > 1 else 0.0
    return np.rint((x - known.mean()) / spread * 1e9) / 1e9 + 0.0 if spread else np.full(len(x), np.nan)


def _parts(x: np.ndarray, y: np.ndarray, part: np.ndarray, above: int) -> list[dict]:
    """ICs within each part of more than ``above`` names; parts below 0 are none."""
    order = np.argsort(part, kind="stable")
    values, starts = np.unique(part[order], return_index=True)
    cut = zip(values.tolist(), np.split(order, starts[1:]))
    return [{"part": v, "ic": _ic(x[at], y[at])} for v, at in cut if v >= 0 and len(at) > above]


def _sections(chunks: list[list[tuple[str, tuple[str, ...] | None]]], code_type: pa.DataType):
    rets = pa.list_(pa.float64())
    parts = pa.list_(pa.struct([("part", pa.int64()), ("ic", pa.float64())]))
    shape = pa.schema([("trade_date", pa.date32()), ("factor_name", pa.string()), ("n", pa.int64()), ("ic", pa.float64()), ("sizes", parts), ("industries", parts), ("up", rets), ("down", rets), ("up_members", pa.list_(code_type)), ("down_members", pa.list_(code_type))])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        number = lambda c: table.column(c).cast(pa.float64()).to_numpy()
        code, label, size = table.column("code").combine_chunks(), number("fwd"), number("market_cap")
        industry = table.column("industry").cast(pa.int64()).fill_null(-1).to_numpy()
        names = chunks[key[1].as_py()]
        values = table.column("xs").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names))
        size_group = _group(size, 3) - 1
        rows = []
        for k, (name, how) in enumerate(names):
            x = _cleaned(values[:, k], industry, size, how)
            kept = np.flatnonzero(~np.isnan(x) & ~np.isnan(label))
            if not len(kept):
                continue
            x, y = x[kept], label[kept]
            row = {"trade_date": key[0].as_py(), "factor_name": name, "n": len(kept), "ic": _ic(x, y)}
            row |= {"sizes": _parts(x, y, size_group[kept], 5), "industries": _parts(x, y, industry[kept], 2)}
            for side, sign in (("up", 1.0), ("down", -1.0)):
                group = _group(sign * x, GROUPS)
                row[side] = [float(y[group == g].mean()) if (group == g).any() else None for g in range(1, GROUPS + 1)]
                row[f"{side}_members"] = code.take(pa.array(kept[group == GROUPS]))
            rows.append(row)

        def column(field: pa.Field) -> pa.Array:
            held = [r[field.name] for r in rows]
            if not rows or not field.name.endswith("members"):
                return pa.array(held, field.type)
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, held)]), pa.int32()), pa.concat_arrays(held))

        return pa.Table.from_arrays([column(f) for f in shape], schema=shape)

    return run


def sections(values: DataFrame, factors: list[Factor], chunk: int = 9) -> DataFrame:
    """A row for each date and factor that has names with a value and a label.

    trade_date, factor_name, n, ic (null where constant), sizes and industries (ICs of a date's three size groups and its
    industries, of those with more than 5 and 2 names), up and down (mean labels of the layers of the factor, and of it with the other sign), up_members and
    down_members (codes of the top layers). ``values`` has trade_date, code, fwd, industry, market_cap and a column for each factor. A
    factor is cleaned first, neutral to what it declares. One date's names for ``chunk`` factors are one group.
    """
    chunks = [[(f.name, f.neutralize) for f in factors[i : i + chunk]] for i in range(0, len(factors), chunk)]
    dealt = F.array(*[F.struct(F.lit(i).alias("chunk"), F.array(*[F.col(n).cast("double") for n, _ in part]).alias("xs")) for i, part in enumerate(chunks)])
    rows = values.select("trade_date", "code", "fwd", "industry", "market_cap", F.inline(dealt))
    kind = values.schema["code"].dataType.simpleString()
    part = "array<struct<part: bigint, ic: double>>"
    shape = f"trade_date date, factor_name string, n bigint, ic double, sizes {part}, industries {part}, up array<double>, down array<double>, up_members array<{kind}>, down_members array<{kind}>"
    from pyspark.sql.pandas.types import to_arrow_type

    return rows.groupBy("trade_date", "chunk").applyInArrow(_sections(chunks, to_arrow_type(values.schema["code"].dataType)), shape)


def section_ics(made: DataFrame) -> DataFrame:
    """trade_date, factor_name, ic, n of the sections with enough names."""
    return made.where(F.col("n") > MIN_NAMES).select("trade_date", "factor_name", "ic", "n")
