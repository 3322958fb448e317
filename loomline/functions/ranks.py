"""Exact order statistics without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many low bits of a value's order each round leaves open: 64 bits are settled in steps of 20, 22 and 22.
STEPS = (44, 22, 0)


def ordered_bits(v: str) -> Column:
    """A long that is ordered as the doubles in column `v` are: exponent and mantissa of the absolute value, with its sign. NaN is above all, as elsewhere in Spark."""
    c = F.col(v)
    size = F.abs(c)
    near = F.floor(F.log2(size))  # one off where the logarithm is rounded
    power = F.when(F.pow(F.lit(2.0), near) > size, near - 1).when(F.pow(F.lit(2.0), near + 1) <= size, near + 1).otherwise(near)
    mantissa = ((size / F.pow(F.lit(2.0), power) - 1) * 2.0**52).cast("long")
    tiny = ((size * 2.0**537) * 2.0**537).cast("long")  # below the smallest normal number the bits are those of a whole number
    infinite = F.lit(2047 << 52)
    bits = F.when(F.isnan(c), infinite + 1).when(size == float("inf"), infinite).when(size < 2.0**-1022, tiny).otherwise((power + 1023).cast("long") * F.lit(1 << 52) + mantissa)
    return F.when(c < 0, -bits).otherwise(bits)


def with_ranks(df: DataFrame, keys: list[str], value: str, facts: list[Column], ranks: dict[str, tuple[float, str]]) -> DataFrame:
    """One row per group: `facts`, and for each name in `ranks` the value at (share, rule), the rule being "between" (interpolated), "nearest" (half to even) or "floor".

    Radix selection over the bits of the values. Equal values are counted together first. Then values are counted by
    their leading bits; the running counts tell which cells hold the wanted places, and only these are split by the next
    bits, until a cell is one value. A round orders at most 2^22 cells of a group, however many values there are and
    however close they lie, and for each rank two cells at most go on.
    Groups are those of rows with non-null keys; null values count in the facts only. Without facts, groups that have no value are left out.
    """
    by = keys or ["_all"]
    own = df if keys else df.withColumn("_all", F.lit(0))
    held = own.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    each = held.groupBy(*by, "_v").agg(F.count("*").alias("_n")).withColumn("_bits", ordered_bits("_v"))

    def places(share: float, rule: str) -> list[Column]:
        at = F.lit(share) * (F.col("_total") - 1)
        return {"between": [F.floor(at), F.ceil(at)], "nearest": [F.rint(at)], "floor": [F.floor(at)]}[rule]

    wanted = F.array(*[p.cast("long") for r in ranks.values() for p in places(*r)])
    hit = F.exists(wanted, lambda p: (p >= F.col("_before")) & (p < F.col("_before") + F.col("_n")))
    known, upper = None, 64
    for step in STEPS:
        cell = F.shiftright("_bits", step).alias("_cell")
        if known is None:
            counted = each.groupBy(*by, cell).agg(F.sum("_n").alias("_n"), F.max("_v").alias("_v")).withColumns({"_start": F.lit(0).cast("long"), "_total": F.sum("_n").over(Window.partitionBy(*by)), "_above": F.lit(0).cast("long")})
        else:
            inside = each.withColumn("_above", F.shiftright("_bits", upper)).join(known, [*by, "_above"])
            counted = inside.groupBy(*by, "_above", "_start", "_total", cell).agg(F.sum("_n").alias("_n"), F.max("_v").alias("_v"))
        sooner = Window.partitionBy(*by, "_above").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        found = counted.withColumn("_before", F.col("_start") + F.coalesce(F.sum("_n").over(sooner), F.lit(0))).where(hit)
        known, upper = found.select(*by, F.col("_cell").alias("_above"), F.col("_before").alias("_start"), "_total"), step

    def value_at(p: Column) -> Column:
        return F.max(F.when((p >= F.col("_before")) & (p < F.col("_before") + F.col("_n")), F.col("_v")))

    named = []
    for name, (share, rule) in ranks.items():
        ends = [value_at(p) for p in places(share, rule)]
        part = F.max(F.lit(share) * (F.col("_total") - 1) - F.floor(F.lit(share) * (F.col("_total") - 1)))
        named.append((ends[0] + (ends[1] - ends[0]) * part if rule == "between" else ends[0]).alias(name))
    out = found.groupBy(*by).agg(*named)
    if facts:
        out = own.groupBy(*by).agg(*facts).join(out, by, "left")
    return out if keys else out.drop("_all")
