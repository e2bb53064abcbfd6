"""Running figures over ordered series, of which none is kept to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def earlier(rows: DataFrame, by: list[str], order: str, figures: dict[str, tuple[str, Column]]) -> DataFrame:
    """The rows with figures (name: "sum" or "max", value) over all earlier rows of the same series; null where there are none.

    The order is cut into as many ranges as the session has partitions, at quantiles, so a series that has
    most of the rows is worked on in as many tasks. A range's rows are run through by themselves; what the
    ranges before hold, a row for each series and range, is added.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else None
    edges = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    ranged = rows.withColumn("in_range", F.size(F.filter(edges, lambda e: e <= F.col(order))))
    for name, (_, value) in figures.items():
        ranged = ranged.withColumn(name, value)
    merge = {"sum": F.sum, "max": F.max}
    totals = ranged.groupBy(*by, "in_range").agg(*(merge[kind](name).alias(name) for name, (kind, _) in figures.items()))
    before = Window.partitionBy(*by).orderBy("in_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(*(F.col(c).alias(f"shift_{c}") for c in (*by, "in_range")), *(merge[kind](name).over(before).alias(f"shift_{name}") for name, (kind, _) in figures.items()))
    inside = Window.partitionBy(*by, "in_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    run = ranged.select(*rows.columns, "in_range", *(merge[kind](name).over(inside).alias(name) for name, (kind, _) in figures.items()))
    same = F.col("in_range") == F.col("shift_in_range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"shift_{c}"))

    def both(name: str, kind: str) -> Column:
        own, shift = F.col(name), F.col(f"shift_{name}")
        return F.coalesce(own + shift, own, shift) if kind == "sum" else F.greatest(own, shift)

    return run.join(shifts, same, "left").select(*rows.columns, *(both(name, kind).alias(name) for name, (kind, _) in figures.items()))
