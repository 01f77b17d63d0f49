"""Places of rows in an order, without one task for all rows or for all rows of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acervo.functions.scratch import kept


def numbered(rows: DataFrame, order: list[str], name: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """Adds `name`, a row's place from 0 in its group by `order`; nulls come first, rows equal in both follow in any order.

    Rows are sorted in ranges of (group, order); a place is that in the range, behind the group's rows in the ranges before.
    A group may span many ranges. The running sums meet one row for each group and range.
    """
    by = [*groups, *order]
    placed = kept(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id()))
    placed = placed.withColumn("_p", F.shiftright("_m", 33))
    ranges = placed.groupBy("_p", *groups).agg(F.min("_m").alias("_first"), F.count("*").alias("_c"))
    earlier = Window.partitionBy(*groups).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("_p").alias("_q"), *[F.col(g).alias(f"_g_{g}") for g in groups], (F.coalesce(F.sum("_c").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    same = F.col("_p") == F.col("_q")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return placed.join(ranges if groups else F.broadcast(ranges), same).withColumn(name, F.col("_m") + F.col("_shift")).select(*rows.columns, name)


def collector_pages(projects: DataFrame, key: str, columns: dict[str, str], page: int = 500) -> DataFrame:
    """(kind, code, page, place, key): the distinct keys of each state, sector and type in order, in pages of `page` keys.

    A null code or key is left out. No list of a group's keys is ever one row, so a group may hold most keys.
    """
    codes = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("code")) for k, c in columns.items()]))
    rows = projects.select(key, codes.alias("_c")).select("_c.kind", "_c.code", key).dropna().distinct()
    return numbered(rows, [key], "place", ("kind", "code")).select("kind", "code", F.floor(F.col("place") / page).alias("page"), "place", key)
