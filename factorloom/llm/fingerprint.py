"""Exact fingerprints of canonical text, with column expressions only.

Canonical is a text after compatibility composition (NFKC), full case folding and white-space folding.
Its digest is four xxhash64 of different seeds. Texts with equal digests are compared byte by byte;
should two different texts ever meet in one digest, a SHA-256 of each tells their fingerprints apart.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import materialize, text_of

#: Hashes in a digest, 64 bits each.
WIDTH = 4
#: Up to so many digests that occur twice or more are broadcast (32 bytes each); more are joined.
MAX_BROADCAST_DIGESTS = 500_000
#: A null id stands before all others.
FIRST = -(2**63)


def canonical(text: Column) -> Column:
    """NFKC, case folding, NFKC again; runs of white space become one space, none at the ends.

    Spark has no function for normalisation; the ICU library that Spark's collations use does it by
    ``java_method``. ASCII text needs only lower case.
    """
    compose = lambda x: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    fold = lambda x: F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), x, F.lit(True))
    folded = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(compose(fold(compose(text))))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x1C-\x1F\x85]+", " "))


def digest(text: Column) -> Column:
    """The hashes of a text as they are; each seed is the hash of a number."""
    return F.array(*[F.xxhash64(F.lit(seed), text) for seed in range(WIDTH)])


def _hex(hashes: Column) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(hashes[i]), 16, "0") for i in range(WIDTH)]))


def fingerprints(docs: DataFrame, columns: Mapping[str, str], name: str = "fingerprints") -> DataFrame:
    """Replace text columns by fingerprints: ``columns`` maps the text column to the new one's name.

    Equal texts get equal fingerprints, in whichever row and column they are; null counts as empty;
    repeated rows are kept; an empty table gives an empty result. All other columns pass through, but
    for names in ``columns``'s values, which are replaced. ``docs`` is evaluated twice, the second
    time for those texts only whose digest occurs more than once.
    """
    kept = [c for c in docs.columns if c not in columns and c not in columns.values()]
    made = docs.select(*kept, *[canonical(text_of(c)).alias(f"__canonical_{i}") for i, c in enumerate(columns)])
    light = materialize(made.select(*kept, *[digest(F.col(f"__canonical_{i}")).alias(f"__digest_{i}") for i in range(len(columns))]), name)
    every = reduce(DataFrame.unionAll, [light.select(F.col(f"__digest_{i}").alias("__digest")) for i in range(len(columns))])
    several = materialize(every.groupBy("__digest").count().where("count > 1").select("__digest"), f"{name}-several")
    if not (many := several.count()):
        return light.select(*kept, *[_hex(F.col(f"__digest_{i}")).alias(out) for i, out in enumerate(columns.values())])
    seen = F.broadcast(several) if many <= MAX_BROADCAST_DIGESTS else several
    pairs = F.array(*[F.struct(digest(F.col(f"__canonical_{i}")).alias("__digest"), F.col(f"__canonical_{i}").alias("__canonical")) for i in range(len(columns))])
    texts = made.select(F.inline(pairs)).join(seen, "__digest")
    # equal texts of a digest become one before anything is shuffled, so a group of any size is small
    different = texts.groupBy("__digest").agg(F.size(F.collect_set("__canonical")).alias("__texts")).where("__texts > 1")
    different = materialize(different.select("__digest"), f"{name}-different")
    if not different.count():
        return light.select(*kept, *[_hex(F.col(f"__digest_{i}")).alias(out) for i, out in enumerate(columns.values())])
    told = made
    for i, out in enumerate(columns.values()):
        hashes = digest(F.col(f"__canonical_{i}"))
        told = told.withColumn("__digest", hashes).join(different.withColumn("__clash", F.lit(True)), "__digest", "left")
        told = told.withColumn(out, F.when(F.col("__clash"), F.concat_ws("-", _hex(F.col("__digest")), F.sha2(f"__canonical_{i}", 256))).otherwise(_hex(F.col("__digest"))))
        told = told.drop("__digest", "__clash")
    return told.select(*kept, *columns.values())


def _following(ids: DataFrame) -> DataFrame:
    """``__key`` and ``__next``, the next greater key; after the greatest comes the least.

    Keys are sorted in ranges of their own; only the least key of each range comes to the driver.
    """
    parts = max(1, int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialize(ids.repartitionByRange(parts, "__key").withColumn("__range", F.spark_partition_id()), "key-ranges")
    least = sorted((r["__range"], r["least"]) for r in ranged.groupBy("__range").agg(F.min("__key").alias("least")).collect())
    if not least:
        return ranged.select("*", F.col("__key").alias("__next")).drop("__range")
    after = {here[0]: there[1] for here, there in zip(least, [*least[1:], least[0]], strict=True)}
    within = F.lead("__key").over(Window.partitionBy("__range").orderBy("__key"))
    over = F.element_at(F.create_map(*[F.lit(x) for pair in after.items() for x in pair]), F.col("__range"))
    return ranged.withColumn("__next", F.coalesce(within, over)).drop("__range")


def with_edits(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (__key, text, edited), and a light table (__key, __next).

    In ``edited`` the last half of the code points is replaced by the first as many, or all, of the
    document with the next id; after the last comes the first. Of repeated ids the row with the least
    text is the one that others are edited with. Ids are whole numbers; a null id stands first.
    """
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST)).alias("__key")
    lite = docs.select(key, F.length(text_of()).alias("__n")).groupBy("__key").agg(F.max("__n").alias("__n"))
    following = materialize(_following(lite), "following")
    # both uses have the same columns, so that one exchange serves both
    rows = docs.select(key, text_of().alias("text"))
    # a lag, as a row number would be limited before the exchange, which then could not be shared
    first = rows.withColumn("__before", F.lag(F.lit(1)).over(Window.partitionBy("__key").orderBy("text"))).where("__before is null")
    first = first.select(F.col("__key").alias("__next"), F.col("text").alias("__text"))
    wanted = following.join(first, "__next").select("__key", F.left("__text", F.floor(F.col("__n") / 2).cast("int")).alias("__start"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("__start", half))
    return rows.join(wanted, "__key").select("__key", "text", edited.alias("edited")), following.select("__key", "__next")


def likeness(a: Column, b: Column) -> Column:
    """Of exact fingerprints: 1 if the canonical texts are the same, else 0."""
    return F.when(a == b, 1.0).otherwise(0.0)
