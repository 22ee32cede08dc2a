"""What was known on a date: published figures, and memberships that begin and end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(rows: DataFrame, published: DataFrame, when: str) -> DataFrame:
    """``rows`` (trade_date, code, ...) with the columns of the last figures of the code published by the date.

    Both are ordered together within a code, so no row meets another's range. Figures published on the
    date itself are known; of several on one date any one counts; before the first all are null.
    """
    figures = [c for c in published.columns if c not in ("code", when)]
    both = rows.withColumn("__own", F.lit(1)).withColumn("__at", F.col("trade_date"))
    both = both.unionByName(published.select("code", F.col(when).alias("__at"), F.struct(when, *figures).alias("__figures"), F.lit(0).alias("__own")), allowMissingColumns=True)
    past = Window.partitionBy("code").orderBy("__at", "__own").rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("__known", F.last("__figures", ignorenulls=True).over(past)).where("__own = 1")
    return known.select(*rows.columns, *[F.col(f"__known.{c}").alias(c) for c in (when, *figures)])


def known_figures(rows: DataFrame, figures: DataFrame) -> DataFrame:
    """``rows`` (trade_date, code, ...) with the figures that were the latest known on the date: bitemporal.

    ``figures`` has code, valid (the period they are of), published (when they came out) and the figures; a period has
    a row for each publication. Of what was published by the date the latest period counts, and of that the latest
    publication. So a restatement changes what is known from its own day on, and one of an older period changes nothing. Both are
    ordered together within a code and the greatest pair so far is kept, so no row meets another's range. Before the first
    publication all are null.
    """
    names = [c for c in figures.columns if c not in ("code", "valid", "published")]
    both = rows.withColumn("__own", F.lit(1)).withColumn("__at", F.col("trade_date"))
    said = figures.select("code", F.col("published").alias("__at"), F.struct("valid", "published", *names).alias("__figures"), F.lit(0).alias("__own"))
    past = Window.partitionBy("code").orderBy("__at", "__own").rowsBetween(Window.unboundedPreceding, 0)
    known = both.unionByName(said, allowMissingColumns=True).withColumn("__known", F.max("__figures").over(past)).where("__own = 1")
    kept = [c for c in rows.columns if c not in (*names, "valid", "published")]
    return known.select(*kept, *[F.col(f"__known.{c}").alias(c) for c in ("valid", "published", *names)])


def members_at(rows: DataFrame, membership: DataFrame) -> DataFrame:
    """The rows whose code is a member on their date: ``membership`` is code, from, to, both inclusive.

    Beginnings count 1, before a date's rows, and ends -1, after them; a row is in if the sum so far is positive. So no row
    meets another membership than by order, and memberships may overlap. Rows without a code are left out.
    """
    both = rows.where("code is not null").withColumns({"__own": F.lit(1), "__at": F.col("trade_date"), "__step": F.lit(0)})
    steps = membership.select("code", F.inline(F.array(F.struct(F.col("from").alias("__at"), F.lit(1).alias("__step"), F.lit(0).alias("__own")), F.struct(F.col("to").alias("__at"), F.lit(-1).alias("__step"), F.lit(2).alias("__own")))))
    past = Window.partitionBy("code").orderBy("__at", "__own").rowsBetween(Window.unboundedPreceding, 0)
    counted = both.unionByName(steps, allowMissingColumns=True).withColumn("__in", F.sum("__step").over(past))
    return counted.where("__own = 1 and __in > 0").select(*rows.columns)
