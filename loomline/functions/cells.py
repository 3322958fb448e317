"""Order within a group (a case, an actor) that may be too large for one task.

A group of more than `ROWS` rows is cut into cells, ranges of its order with about equal numbers of rows. What needs an
order is then found within (group, cell), and what cells hand to each other, a count or a first row, comes from a table
of one row a cell. Rows of other groups are all in cell 0. A table without a column _cell has only groups that fit a task.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .joins import measured

#: Rows of one group that a task orders; a larger group is cut into cells of about a quarter of this.
ROWS = 50_000
CELL = "_cell"


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, a local session gets a temporary folder and a cluster an error."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="spark-shared-")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from the files."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def in_cells(df: DataFrame, key: str, order: list[str], rows: int = ROWS) -> DataFrame:
    """`df` with a column _cell if any group of `key` has more than `rows` rows, else as it is. Rows without a key are no group.

    Counts by group are combined before their shuffle; only rows of large groups are dealt anew, by ranges of (key, order).
    """
    if CELL in df.columns:
        return df
    large = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > rows)
    total = large.agg(F.sum("_rows")).first()[0]
    if not total:
        return df
    keys = measured(cut(large.select(key)))
    dealt = df.join(keys, key, "left_semi").repartitionByRange(max(2, -(-4 * total // rows)), key, *order)
    cells = cut(dealt.withColumn(CELL, (F.spark_partition_id() + 1).cast("int")))
    return df.join(keys, key, "left_anti").withColumn(CELL, F.lit(0)).unionByName(cells)


def cell(df: DataFrame) -> list[str]:
    return [CELL] if CELL in df.columns else []


def numbered(df: DataFrame, by: list[str], order: list[str | Column], name: str) -> DataFrame:
    """Add the number of each row in the order of its group, from 1: its number in its cell and the counts of the cells before."""
    own = df.withColumn(name, F.row_number().over(Window.partitionBy(*by, *cell(df)).orderBy(*order)).cast("long"))
    if not cell(df):
        return own
    sizes = df.where(F.col(CELL) > 0).groupBy(*by, CELL).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1))
    carried = measured(cut(sizes.select(*by, CELL, F.coalesce(before, F.lit(0)).alias("_before"))))
    return own.join(carried, [*by, CELL], "left").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before")


def following(df: DataFrame, by: list[str], order: list[str], new: dict[str, str]) -> DataFrame:
    """Add values of the next row of the group (new name: column); after the last row of a cell comes the first one of the next cell that has rows."""
    w = Window.partitionBy(*by, *cell(df)).orderBy(*order)
    own = df.withColumns({n: F.lead(c).over(w) for n, c in new.items()} | ({"_end": F.lead(F.lit(True)).over(w).isNull()} if cell(df) else {}))
    if not cell(df):
        return own
    firsts = df.where(F.col(CELL) > 0).groupBy(*by, CELL).agg(F.min_by(F.struct(*[F.col(c).alias(n) for n, c in new.items()]), F.struct(*order)).alias("_first"))
    nexts = measured(cut(firsts.withColumn("_first", F.lead("_first").over(Window.partitionBy(*by).orderBy(CELL)))))
    joined = own.join(nexts, [*by, CELL], "left")
    return joined.withColumns({n: F.when(F.col("_end"), F.col("_first")[n]).otherwise(F.col(n)) for n in new}).drop("_end", "_first")


def with_facts(df: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Inner join with a table of one row a group; rows of groups in cells meet theirs by a broadcast and stay where they are."""
    if not cell(df):
        return df.join(facts, key)
    large = df.where(F.col(CELL) > 0)
    few = measured(facts.join(measured(cut(large.select(key).distinct())), key, "left_semi"))
    return df.where(F.col(CELL) == 0).join(facts, key).unionByName(large.join(few, key))
