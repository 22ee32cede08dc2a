"""Mixing sources to target weights by balanced sampling with the cube method.

A source whose target is m times its size takes floor(m) copies of each document, and of the rest a
sample in which each document has the inclusion probability m - floor(m). The flight moves these
probabilities, three documents at a time, along the direction that keeps both the expected tokens and
the expected number of documents, until one of the three is settled at 0 or 1. A dozen documents are
left open, which the landing settles so that the tokens are nearest.
"""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import WORD, materialize, spread, text_of

#: Documents of a block, which one task flies at a time.
BLOCK_DOCS = 5_000
#: Equal rows that one task numbers; more of them are numbered in several tasks.
EQUAL_ROWS = 100_000
#: Blocks whose open documents meet in one block of the next level.
FAN_IN = 4096
#: Documents of a source that the landing settles at once.
LANDING_DOCS = 12
#: Probabilities nearer than this to 0 or 1 are settled.
EPS = 1e-9


def flight(sizes: list[int], chance: list[float], seed: int, leave: int = 2) -> list[float]:
    """Chances moved until at most ``leave`` (2 or more) are between 0 and 1; both totals are kept."""
    draw, moved = random.Random(seed), list(chance)
    waiting = [i for i in range(len(moved)) if EPS < moved[i] < 1 - EPS][::-1]
    live: list[int] = []
    while True:
        while len(live) < 3 and waiting:
            live.append(waiting.pop())
        if len(live) < 3 or len(live) + len(waiting) <= leave:
            break
        i, j, k = live
        a, b, c = sizes[i], sizes[j], sizes[k]
        step = (float(b - c), float(c - a), float(a - b)) if not a == b == c else (1.0, -1.0, 0.0)
        up = down = float("inf")
        for at, u in zip(live, step, strict=True):
            if u:
                room, back = ((1 - moved[at]) / abs(u), moved[at] / abs(u)) if u > 0 else (moved[at] / abs(u), (1 - moved[at]) / abs(u))
                up, down = min(up, room), min(down, back)
        way = up if draw.random() * (up + down) < down else -down
        for at, u in zip(live, step, strict=True):
            moved[at] = min(1.0, max(0.0, moved[at] + way * u))
            if moved[at] < EPS or moved[at] > 1 - EPS:
                moved[at] = round(moved[at])
        live = [at for at in live if EPS < moved[at] < 1 - EPS]
    return moved


def landing(sizes: list[int], chance: list[float]) -> list[float]:
    """Open chances, few as they are, settled so that the tokens, then the count, are nearest."""
    is_open = [i for i, p in enumerate(chance) if EPS < p < 1 - EPS]
    if not is_open:
        return chance
    size, p = np.array([sizes[i] for i in is_open], float), np.array([chance[i] for i in is_open])
    choices = (np.arange(1 << len(is_open))[:, None] >> np.arange(len(is_open))) & 1
    off = np.abs(choices @ size - size @ p)
    best = choices[np.lexsort([np.abs(choices.sum(1) - p.sum()), np.round(off, 6)])[0]]
    out = list(chance)
    for i, taken in zip(is_open, best.tolist(), strict=True):
        out[i] = float(taken)
    return out


def _seed(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little")


def water_level(weighed: DataFrame, total: float, parts: int) -> float:
    """The level per weight at which the targets, each no more than its source's ``most``, add up to ``total``.

    Sources fill up in the order of most / weight. These ratios are sorted in ranges, of which sums and
    the last ratio come to the driver; one task goes through the one range in which the level is.
    """
    ratio = F.col("most") / F.col("weight")
    steps = weighed.groupBy(ratio.alias("ratio")).agg(F.sum("most").alias("most"), F.sum("weight").alias("weight"))
    ranged = materialize(steps.repartitionByRange(parts, "ratio").withColumn("range", F.spark_partition_id()), "level-ranges")
    sums = ranged.groupBy("range").agg(F.sum("most").alias("most"), F.sum("weight").alias("weight"), F.max("ratio").alias("last"))
    full, still_open = 0.0, None
    rows = sorted(sums.collect(), key=lambda r: r["last"])
    still_open = sum(r["weight"] for r in rows)
    for r in rows:
        if full + r["most"] + r["last"] * (still_open - r["weight"]) >= total:
            break
        full, still_open = full + r["most"], still_open - r["weight"]
    else:
        return rows[-1]["last"] if rows else 0.0

    def search(group: pa.Table) -> pa.Table:
        group = group.sort_by("ratio")
        done, left = full, still_open
        for x, most, weight in zip(*(group.column(c).to_pylist() for c in ("ratio", "most", "weight")), strict=True):
            if done + x * left >= total:
                break
            done, left = done + most, left - weight
        return pa.table({"level": [(total - done) / left]})

    return ranged.where(F.col("range") == r["range"]).groupBy("range").applyInArrow(search, "level double").first()["level"]


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """source, docs, source_size, target. Sources by code point, null last, take the weights in turn.

    ``sized`` has source, size and ``n``, how many rows are like this. Targets stop at ``cap`` times the
    source's size, and what is over goes to the others by weight, up to one level for all.
    """
    spark = sized.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    totals = materialize(sized.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("size") * F.col("n")).alias("source_size")), "sources")

    def number(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("__last", "ascending"), ("__key", "ascending")])
        return rows.append_column("__place", pa.array(range(rows.num_rows), pa.int64()))

    # places within ranges, then the count of the ranges before: no task sees all sources
    keyed = totals.select(F.coalesce("source", F.lit("")).cast("binary").alias("__key"), F.col("source").isNull().alias("__last"), "source", "docs", "source_size")
    ranged = materialize(keyed.repartitionByRange(parts, "__last", "__key").withColumn("__range", F.spark_partition_id()), "source-ranges")
    counts = sorted((r["__range"], r["count"]) for r in ranged.groupBy("__range").count().collect())
    before, seen = {}, 0
    for k, n in counts:
        before[k], seen = seen, seen + n
    if not before:
        return totals.withColumn("target", F.lit(0.0)).select("source", "docs", "source_size", "target")
    fields = "__key binary, __last boolean, source string, docs bigint, source_size bigint, __range int, __place bigint"
    placed = ranged.groupBy("__range").applyInArrow(number, fields)
    start = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("__range"))
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("__place") + start, F.lit(len(weights))) + 1).cast("int"))
    most = (F.col("source_size") * cap).cast("double").alias("most")
    weighed = materialize(placed.select("source", "docs", "source_size", turn.cast("double").alias("weight"), most), "weighed-sources")
    level = water_level(weighed, share * (weighed.agg(F.sum("source_size")).first()[0] or 0), parts)
    return weighed.select("source", "docs", "source_size", F.least(F.col("most"), F.col("weight") * level).alias("target"))


def numbered(counted: DataFrame, equal_rows: int = EQUAL_ROWS) -> DataFrame:
    """A row for each of the ``n`` equal ones, told apart by ``copy``, from 0.

    Rows that are more than a task should make are cut into shares first, and the shares dealt out.
    """
    few = counted.where(F.col("n") <= equal_rows).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    share = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / equal_rows)))
    many = counted.where(F.col("n") > equal_rows).withColumn("share", share).repartition(*counted.columns, "share")
    first = F.col("share") * equal_rows
    many = many.withColumn("copy", F.explode(F.sequence(first, F.least(first + equal_rows, F.col("n")) - 1))).drop("share")
    return few.unionByName(many).drop("n")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, copies, taken.

    Null and empty texts have size 0, and are taken like others of their source, with no words; null
    is a source of its own; repeated rows are documents of their own; an empty table gives an empty
    result. No document has more than ``ceil(cap)`` copies, and a source's words miss its target by at
    most one of its documents. Blocks are chosen by a hash of the id, the text and the number among equal
    rows, so null or repeated ids and rows spread as others do; blocks are seeded by their own names, so
    reruns agree.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("bigint")
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(text_of()).alias("text_hash"))
    # equal rows are counted where they are read, and come apart again by number
    counted = materialize(sized.groupBy(*sized.columns).agg(F.count("*").alias("n")), "sized-documents")
    targets = materialize(source_targets(counted, weights, share, cap), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    blocks = F.ceil(F.col("docs") / block_docs).cast("bigint")
    many = targets.select(F.col("source").alias("__source"), "source_size", "target", ratio.alias("__ratio"), blocks.alias("__blocks"))
    rows = numbered(counted).join(many, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    whole = F.floor(F.col("__ratio") + EPS).cast("int")
    rows = rows.withColumn("copies", whole).withColumn("chance", F.greatest(F.lit(0.0), F.col("__ratio") - whole))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_hash", "copy"), F.col("__blocks"))).drop("__ratio")
    fields = f"doc_id {id_type}, source string, size bigint, text_hash bigint, copy bigint, source_size bigint, target double, __blocks bigint, copies int, chance double, block bigint"

    def fly(level: int, last: bool):
        def run(group: pa.Table) -> pa.Table:
            group = group.sort_by([(c, "ascending") for c in ("doc_id", "text_hash", "copy")])
            name = (group.column("source")[0].as_py(), level, group.column("block")[0].as_py())
            sizes, order = group.column("size").to_pylist(), list(range(group.num_rows))
            random.Random(_seed("order", *name)).shuffle(order)
            part = [sizes[i] for i in order]
            moved = flight(part, [group.column("chance")[i].as_py() for i in order], _seed("flight", *name), LANDING_DOCS if last else 2)
            moved = landing(part, moved) if last else moved
            chance = [0.0] * len(order)
            for i, p in zip(order, moved, strict=True):
                chance[i] = p
            copies = [c + (p > 1 - EPS) for c, p in zip(group.column("copies").to_pylist(), chance, strict=True)]
            left = [p if EPS < p < 1 - EPS else 0.0 for p in chance]
            group = group.set_column(group.schema.get_field_index("copies"), "copies", pa.array(copies, pa.int32()))
            return group.set_column(group.schema.get_field_index("chance"), "chance", pa.array(left, pa.float64()))

        return run

    widest, groups = targets.agg(F.max(blocks), F.sum(blocks)).first()
    widest, groups = widest or 1, groups or 1
    done, level = None, 0
    while True:
        last = widest <= 1
        flown = materialize(spread(rows, groups, "source", "block").groupBy("source", "block").applyInArrow(fly(level, last), fields), f"flown-{level}")
        settled = flown if last else flown.where("chance = 0")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        rows = flown.where("chance > 0").withColumn("block", F.floor(F.col("block") / FAN_IN).cast("bigint"))
        level, widest, groups = level + 1, -(-widest // FAN_IN), -(-groups // FAN_IN) + 1
    return done.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
