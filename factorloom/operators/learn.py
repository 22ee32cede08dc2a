"""Composites that are learned: trees fitted year by year on the past, and a search over weights."""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.expressions import centred_rank, rank_correlation, safe_div
from factorloom.operators.evaluate import MIN_NAMES


def ranked_features(values: DataFrame, names: list[str], label: str = "fwd") -> DataFrame:
    """trade_date, code, each of ``names`` as its share rank of the date, less one half (0 where unknown), and the label's rank likewise, null where unknown.

    Columns are ranked as rows of their own, one sort of narrow rows for all, so a task never sorts a date's wide rows once for each
    column. A date and code are one row of ``values``.
    """
    columns = F.array(*[F.col(n).cast("double") for n in (*names, label)])
    long = values.select("trade_date", "code", F.posexplode(columns).alias("i", "x")).withColumn("some", F.col("x").isNotNull())
    w = Window.partitionBy("trade_date", "i", "some")
    peers = F.count(F.lit(1)).over(w.orderBy("x").rangeBetween(Window.currentRow, Window.currentRow))
    share = F.when(F.col("some"), safe_div(F.rank().over(w.orderBy("x")) + (peers - 1) / 2.0, F.count(F.lit(1)).over(w)) - 0.5)
    # dealt by row first, so that no map of partial rows is held before the shuffle
    ranked = long.select("trade_date", "code", "i", share.alias("share")).repartition("trade_date", "code")
    of = lambda i: F.max(F.when(F.col("i") == i, F.col("share")))
    return ranked.groupBy("trade_date", "code").agg(*[F.coalesce(of(i), F.lit(0.0)).alias(n) for i, n in enumerate(names)], of(len(names)).alias("label"))


def walk_forward(rows: DataFrame, names: list[str], least_years: int = 2, trees: int = 20, depth: int = 4, seed: int = 7) -> DataFrame:
    """trade_date, code, score: each year's rows by a forest that is fitted on the years before.

    A date's label is known a date later, so of the years before all labels are known when the year's first date is scored.
    ``rows`` is ``ranked_features``'; there is one fit for each year, each over all its rows by Spark. The first
    ``least_years`` have no scores.
    """
    data = VectorAssembler(inputCols=list(names), outputCol="features").transform(rows.withColumn("year", F.year("trade_date")))
    years = sorted(r["year"] for r in data.select("year").distinct().collect())  # as many as the calendar has
    out = data.where("false").select("trade_date", "code", F.lit(0.0).alias("score"))
    for year in years[least_years:]:
        past = data.where((F.col("year") < year) & F.col("label").isNotNull()).select("features", "label")
        if not past.limit(1).count():
            continue
        forest = RandomForestRegressor(numTrees=trees, maxDepth=depth, minInstancesPerNode=10, seed=seed, predictionCol="score").fit(past)
        out = out.unionByName(forest.transform(data.where(F.col("year") == year)).select("trade_date", "code", "score"))
    return out


def moments_by_date(rows: DataFrame, names: list[str]) -> DataFrame:
    """trade_date, c (covariances of each feature with the label), s (of the features, flat), v (the label's variance): all that a linear composite's ICs need.

    A row is repeated for each line of the matrix, as one aggregation of all pairs is too long for the JVM to compile.
    """
    size = len(names)
    columns = [*names, "label"]
    long = rows.where("label is not null").select("trade_date", *columns, F.posexplode(F.array(*map(F.col, columns))).alias("i", "x"))
    lines = long.groupBy("trade_date", "i").agg(F.array(*[F.covar_pop("x", n) for n in columns]).alias("line"), F.count("*").alias("n"))
    dates = lines.groupBy("trade_date").agg(F.array_sort(F.collect_list(F.struct("i", "line")))["line"].alias("m"), F.max("n").alias("n"))
    features = F.slice("m", 1, size)
    c = F.transform(features, lambda line: line[size]).alias("c")
    s = F.flatten(F.transform(features, lambda line: F.slice(line, 1, size))).alias("s")
    return dates.select("trade_date", c, s, F.col("m")[size][size].alias("v"), "n")


def composite_ic(weights: Column, size: int) -> Column:
    """The correlation of a composite's score with the label's rank on a date, from its moments."""
    total = lambda parts: F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)
    with_label = total(F.transform("c", lambda c, k: weights[k] * c))
    own = total(F.transform("s", lambda s, k: weights[F.floor(k / size).cast("int")] * weights[k % size] * s))
    return safe_div(with_label, F.sqrt(F.greatest(own, F.lit(0.0)) * F.col("v")))


def _draw(*key: object) -> int:
    """A number that depends on the key only, so reruns agree on any machine."""
    return int.from_bytes(sha256(repr(key).encode()).digest()[:6], "big")


def fitness(moments: DataFrame, population: list[tuple[int, ...]]) -> dict[tuple[int, ...], float]:
    """The ratio of mean to deviation of each candidate's ICs: one plan for all, keyed by candidate."""
    return {w: found for (_, w), found in fitness_before(moments, {None: population}).items()}


def fitness_before(moments: DataFrame, populations: dict[int | None, list[tuple[int, ...]]]) -> dict[tuple[int | None, tuple[int, ...]], float]:
    """The same of each year's candidates over the dates before that year (over all for None): one plan for all, keyed by year and candidate.

    Where there is no ratio, it is minus infinity.
    """
    wanted = [(year, w) for year, population in populations.items() for w in population]
    candidates = F.broadcast(moments.sparkSession.createDataFrame([(y, list(w)) for y, w in wanted], "year int, w array<int>"))
    past = F.col("year").isNull() | (F.year("trade_date") < F.col("year"))
    ics = moments.join(candidates, past).select("year", "w", composite_ic(F.col("w"), len(wanted[0][1])).alias("ic"))
    found = ics.groupBy("year", "w").agg(safe_div(F.avg("ic"), F.stddev_samp("ic")).alias("icir")).where("icir is not null").collect()  # a row for each candidate
    return dict.fromkeys(wanted, float("-inf")) | {(r["year"], tuple(r["w"])): round(r["icir"], 12) for r in found}


def search_weights(moments: DataFrame, names: list[str], start: list[tuple[int, ...]], generations: int = 6, size: int = 12, seed: int = 7, most: int = 3) -> list[tuple[int, tuple[int, ...], float]]:
    """(generation, weights, fitness) of the best candidate of each generation; whole weights from -``most`` to ``most``.

    The better half stays, so no generation is worse than the one before, nor than the start; the rest are
    crossings of two of it with one weight drawn anew. ``moments`` must be those of the past only. Generations are bounded, and what
    comes to the driver is a number for each candidate.
    """
    return [(generation, *found) for _, generation, *found in search_by_year(moments, names, start, [None], generations, size, seed, most)]


def search_by_year(moments: DataFrame, names: list[str], start: list[tuple[int, ...]], years: list[int | None], generations: int = 6, size: int = 12, seed: int = 7, most: int = 3) -> list[tuple[int | None, int, tuple[int, ...], float]]:
    """(year, generation, weights, fitness): ``search_weights`` for each year, over the dates before it; a generation of all years is one plan."""
    genes = len(names)
    population = list(dict.fromkeys(start))
    while len(population) < size:
        population.append(tuple(_draw(seed, "start", len(population), g) % (2 * most + 1) - most for g in range(genes)))
    populations = dict.fromkeys(years, population)
    known: dict[tuple[int | None, tuple[int, ...]], float] = {}
    best = []
    for generation in range(generations):
        new = {year: [w for w in dict.fromkeys(population) if (year, w) not in known and any(w)] for year, population in populations.items()}
        known |= fitness_before(moments, new) if any(new.values()) else {}
        for year, population in populations.items():
            ordered = sorted({w for w in population if any(w)}, key=lambda w, y=year: (-known[y, w], w))
            best.append((year, generation, ordered[0], known[year, ordered[0]]))
            populations[year] = _next_generation(ordered[: max(2, size // 2)], generation, size, seed, most)
    return best


def _next_generation(parents: list[tuple[int, ...]], generation: int, size: int, seed: int, most: int) -> list[tuple[int, ...]]:
    population = list(parents)
    genes = range(len(parents[0]))
    for child in range(size - len(parents)):
        draw = lambda *key, c=child: _draw(seed, generation, c, *key)
        a, b = parents[draw("a") % len(parents)], parents[draw("b") % len(parents)]
        mixed = [a[k] if draw("x", k) % 2 else b[k] for k in genes]
        mixed[draw("at") % len(genes)] = draw("to") % (2 * most + 1) - most
        population.append(tuple(mixed))
    return population


def composite_rank_ics(rows: DataFrame, names: list[str], candidates: DataFrame) -> DataFrame:
    """trade_date, id, ic, n: ``rank_ic`` of each composite of ``candidates`` (id, weights, since: the first year that is wanted).

    ``rows`` is ``ranked_features``', so each name with a label has a score, and its label's rank is the same in all composites: only
    scores are sorted. A row is a date, a name and a composite, so candidates must be few.
    """
    known = rows.where("label is not null")
    sizes = known.groupBy("trade_date").agg(F.count("*").alias("size"))
    score = reduce(lambda a, b: a + b, [F.col(n) * F.col("weights")[k] for k, n in enumerate(names)])
    label = (F.rint(F.col("label") * F.col("size") * 2) - 1).cast("bigint")  # the share as centred_rank
    each = known.join(F.broadcast(sizes), "trade_date").join(F.broadcast(candidates), F.year("trade_date") >= F.col("since"))
    ranked = each.select("trade_date", "id", label.alias("label"), score.alias("score")).withColumn("score", centred_rank(F.col("score"), "trade_date", "id"))
    ic = F.round(rank_correlation(F.col("score"), F.col("label")), 12) + 0.0
    return ranked.groupBy("trade_date", "id").agg(ic.alias("ic"), F.count("*").alias("n")).where(F.col("n") > MIN_NAMES)


def linear_score(rows: DataFrame, names: list[str], weights: tuple[int, ...]) -> DataFrame:
    """trade_date, code, score of a composite."""
    parts = [F.col(n) * w for n, w in zip(names, weights, strict=True)]
    return rows.select("trade_date", "code", reduce(lambda a, b: a + b, parts).alias("score"))


def with_label(scores: DataFrame, rows: DataFrame) -> DataFrame:
    return scores.join(rows.select("trade_date", "code", "label"), ["trade_date", "code"])
