"""Landing and rewriting of payloads and derived tables: keyed merges as joins, windows and overwrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .keyed_log import KeyedLog

ENVELOPE = "source string, entity_type string, entity_id string, fetched_at timestamp, body string"
RAW_KEY = ["source", "entity_type", "entity_id"]


def raw_log(spark: SparkSession, path: str) -> KeyedLog:
    """The log of landed payloads at `path`: the last fetch of each entity counts."""
    return KeyedLog(spark, path, keys=("entity_id",), kinds=("source", "entity_type"), newest=("fetched_at",), ties=("body",))


def raw(spark: SparkSession, path: str, source: str, entity_type: str) -> DataFrame:
    """Landed payloads of one kind; files of other kinds are not opened. An unwritten log is empty."""
    found = raw_log(spark, path).read(source=source, entity_type=entity_type)
    return spark.createDataFrame([], ENVELOPE) if found is None else found


def write_raw(df: DataFrame, path: str) -> None:
    """Land payloads; the kinds in `df` are replaced at once, others stay as they are."""
    raw_log(df.sparkSession, path).replace(df)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert_raw(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Payloads by key, the last fetch wins; on equal times the new one. For two tables at hand; `raw_log(...).upsert` adds to a landed one."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, RAW_KEY, [F.col("fetched_at").desc_nulls_last(), F.col("_new").desc(), F.col("body")]).drop("_new")


def changed_only(new: DataFrame, landed: DataFrame, key: str = "key", stamp: str = "updated") -> DataFrame:
    """S3: records whose stamp differs from the landed one; a null stamp always counts as changed."""
    return new.join(landed.select(key, stamp), [key, stamp], "left_anti")


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """A commit log as text, one row per commit (`value`): the files are split at the header mark by the reader itself."""
    return spark.read.option("lineSep", "@@@").text(path).where(F.trim("value") != "")


def parse_commits(records: DataFrame) -> DataFrame:
    """Header and numstat lines of a commit as columns: sha, times (UTC), email, name, parents, subject, files, additions, deletions.

    A renamed file counts under its new name, binary files count no lines. Other columns of `records` are kept.
    """
    lines = F.split("value", "\n")
    head = F.split(lines[0], r"\|", 7)
    stats = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.size(F.split(x, "\t")) >= 3)

    def path(line: Column) -> Column:
        name = F.split(line, "\t")[2]
        braced = F.regexp_replace(name, r"\{(.*?) => (.*?)\}", "$2")
        return F.trim(F.when(name.rlike(r"\{.*? => .*?\}"), braced).otherwise(F.regexp_replace(name, "^.* => ", "")))

    def lines_of(i: int) -> Column:
        numbers = F.transform(stats, lambda x: F.when(F.split(x, "\t")[i].rlike("^[0-9]+$"), F.split(x, "\t")[i].cast("long")).otherwise(0))
        return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, b: a + b)

    parents = F.filter(F.split(head[5], " "), lambda x: x != "")
    rest = [c for c in records.columns if c != "value"]
    return records.select(*rest, head[0].alias("sha"), head[1].cast("timestamp").alias("authored_at"), head[2].cast("timestamp").alias("committed_at"), head[3].alias("email"), head[4].alias("name"), parents.alias("parents"), head[6].alias("subject"), F.transform(stats, path).alias("files"), lines_of(0).alias("additions"), lines_of(1).alias("deletions"))


RUN_SCHEMA = "id long, repo string, head_sha string, run_started_at string, updated_at string, conclusion string, run_attempt int"


def ci_runs(payloads: DataFrame, attempt_in_key: bool = False) -> DataFrame:
    """Workflow runs with wall-clock minutes (never negative, three digits); the attempt can be part of the key."""
    b = payloads.select(F.from_json("body", RUN_SCHEMA).alias("b")).select("b.*")
    start = F.coalesce(F.try_to_timestamp("run_started_at"), F.try_to_timestamp("updated_at"))
    seconds = (F.unix_micros(F.try_to_timestamp("updated_at")) - F.unix_micros(start)) / 1e6
    attempt = F.coalesce("run_attempt", F.lit(1))
    key = F.concat_ws(":", "repo", F.col("id").cast("string"), attempt.cast("string")) if attempt_in_key else F.col("id").cast("string")
    return b.select(key.alias("run_id"), "repo", "head_sha", start.alias("ts"), F.round(F.greatest(F.lit(0.0), F.coalesce(seconds, F.lit(0.0))) / 60, 3).alias("runner_minutes"), "conclusion", attempt.alias("attempt"))


def derived_log(spark: SparkSession, path: str, keys: tuple[str, ...], partition: str | None = None) -> KeyedLog:
    """The log of a derived table, whose keys are computed from its rows' facts."""
    return KeyedLog(spark, path, keys=keys, kinds=(partition,) if partition else ())


def write_table(df: DataFrame, path: str, keys: tuple[str, ...], partition: str | None = None) -> None:
    """Write a derived table so that a rerun leaves the same rows: keys are derived, partitions (or the table) replaced whole and at once."""
    derived_log(df.sparkSession, path, keys, partition).replace(df)


def upsert_table(df: DataFrame, path: str, keys: tuple[str, ...], partition: str | None = None) -> None:
    """Write some rows of a derived table; only these are written, whatever the table's size."""
    derived_log(df.sparkSession, path, keys, partition).upsert(df)


def replace_where(existing: DataFrame, new: DataFrame, column: str, value: str) -> DataFrame:
    """All rows with the value are taken out before the new ones go in."""
    return existing.where(~F.col(column).eqNullSafe(F.lit(value))).unionByName(new)


def upsert_cases(existing: DataFrame, new: DataFrame, fill_only: tuple[str, ...] = ("component", "epic"), fixed: tuple[str, ...] = ("repo", "case_source"), key: str = "work_item_id", order: str = "source_ref") -> DataFrame:
    """Cases merged by key: within the batch the last non-null value wins (by `order`), opened is the first and closed the last time;
    against what is there: new values win, but fill-only columns are only filled, fixed ones stay, and opened is the earlier one.
    """
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in new.columns if c not in (key, "opened_at", "closed_at")]
    times = [F.min("opened_at").alias("opened_at"), F.max("closed_at").alias("closed_at")]
    batch = new.groupBy(key).agg(*last, *times).alias("n")
    joined = existing.alias("o").join(batch, key, "full_outer")
    out = []
    for c in existing.columns:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == key:
            out.append(F.col(key))
        elif c == "opened_at":
            out.append(F.least(o, n).alias(c))
        else:
            out.append((F.coalesce(o, n) if c in (*fill_only, *fixed) else F.coalesce(n, o)).alias(c))
    return joined.select(*out)
