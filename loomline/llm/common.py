"""What the operators of this package share: reading tables, cutting lineage, size checks, names set aside."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructType

#: A side with at most this many rows and bytes is broadcast (both are measured); a larger one is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset, a local session (tests, a laptop) gets a temporary folder and a cluster an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return str(context.getCheckpointDir())


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the cluster's checkpoint folder and go on from the files, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def scratch(df: DataFrame) -> tuple[DataFrame, str]:
    """Write `df` as Parquet to the cluster's checkpoint folder; the rows read again, and where they are."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete what `scratch` has written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def extended(schema: StructType, ddl: str) -> StructType:
    """`schema` with the fields of a DDL string after its own."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark `df` for broadcasting if it is measured to have at most `rows` rows and `size` bytes, else leave the join to a shuffle."""
    wide = [F.octet_length(F.col(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, (StringType, BinaryType))]
    held = [F.coalesce(F.sum(w), F.lit(0)) for w in wide]
    found = df.agg(F.count("*"), *[h.alias(f"b{i}") for i, h in enumerate(held)]).first()
    return F.broadcast(df) if found[0] <= rows and 16 * len(df.columns) * found[0] + sum(found[1:]) <= size else df


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """`names`, each with as many underscores in front as it takes to differ from all that are taken (in any case)."""
    held = {t.lower() for t in taken}
    out = []
    for n in names:
        while n.lower() in held:
            n = "_" + n
        out.append(n)
    return out


def aside(df: DataFrame, reserved: Iterable[str]) -> tuple[DataFrame, list[Column]]:
    """`df` with the columns whose names are reserved (in any case) under names of their own, and what gives all its columns back."""
    taken = {c.lower() for c in (*df.columns, *reserved)}
    names: dict[str, str] = {}
    for c in df.columns:
        if c.lower() in {r.lower() for r in reserved}:
            i = 0
            while (fresh := f"_kept{i}_{c}").lower() in taken:
                i += 1
            taken.add(fresh.lower())
            names[c] = fresh
    return df.withColumnsRenamed(names), [F.col(f"`{names.get(c, c)}`").alias(c) for c in df.columns]
