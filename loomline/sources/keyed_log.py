"""A table of keyed rows as a log: batches add files, a manifest says which files count, reading takes the newest row of each key.

    path/data/<one folder a write>/_cell=<kind>/<bucket>/*.parquet      never changed once written
    path/manifests/<version>.json                                       which folders each cell consists of

A cell is a bucket of keys of one kind. A batch writes only its own rows, whatever is there already, and becomes visible
by the rename of its manifest; a crash before that leaves the version before it as it was. A cell that has come to
consist of many pieces is merged into one. The file system must rename without overwriting (HDFS and local disks do).
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has committed the version that was to be written."""


@dataclass(frozen=True)
class KeyedLog:
    """`kinds` are columns by which whole parts of the table are read and replaced, `keys` (with them) identify a row, `newest` columns say which row of a key wins; of equals, the one of the later write, then the first by `ties`."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    kinds: tuple[str, ...] = ()
    newest: tuple[str, ...] = ()
    ties: tuple[str, ...] = ()
    buckets: int = 16
    most_pieces: int = 8

    # files

    def _place(self, name: str = "") -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self) -> Any:
        return self._place().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """All versions whose manifests are there, ascending."""
        fs, place = self._fs(), self._place("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        """The given or the newest manifest; version 0 is the empty table."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version == 0:
            return {"version": 0, "schema": None, "batches": {}, "cells": {}}
        stream = self._fs().open(self._place(f"manifests/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict[str, Any]) -> None:
        """Make a manifest the next version, unless there is one of that number."""
        fs, jvm = self._fs(), self.spark._jvm
        staged, final = self._place(f"manifests/.{uuid.uuid4().hex}"), self._place(f"manifests/{manifest['version']:012d}.json")
        out = fs.create(staged)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        nothing = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(staged), fs.makeQualified(final), nothing)
        except Py4JJavaError as e:
            fs.delete(staged, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {manifest['version']} is there already") from e
            raise

    def _change(self, change: Callable[[dict[str, Any]], dict[str, Any] | None], tries: int = 8) -> bool:
        """Commit what `change` makes of the newest manifest, again if another writer was faster; False if it makes nothing of it."""
        for left in reversed(range(tries)):
            now = self.manifest()
            then = change(now)
            if then is None:
                return False
            try:
                self._commit(now | then | {"version": now["version"] + 1})
                return True
            except Conflict:
                if not left:
                    raise
        return False

    # rows

    def _cell(self) -> Any:
        bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("string")
        return F.concat_ws("/", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in self.kinds], bucket)

    def _kind(self, cell: str) -> str:
        """The kind that a cell's name begins with."""
        return cell.rsplit("/", 1)[0] if self.kinds else ""

    def _latest(self, df: DataFrame) -> DataFrame:
        order = [*[F.col(f"`{c}`").desc_nulls_last() for c in self.newest], F.col("_seq").desc(), *[F.col(f"`{c}`") for c in self.ties]]
        return df.withColumn("_n", F.row_number().over(Window.partitionBy(*[f"`{c}`" for c in (*self.kinds, *self.keys)]).orderBy(*order))).where("_n = 1").drop("_n")

    def _write(self, df: DataFrame) -> dict[str, str]:
        """Write rows (with _seq) as a new folder; where each cell's rows are, relative to `path`. Large cells are several files, small ones are one."""
        folder = f"data/{uuid.uuid4().hex}"
        df.withColumn("_cell", self._cell()).hint("rebalance", "_cell").write.partitionBy("_cell").parquet(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in self._fs().listStatus(self._place(folder)) if s.isDirectory()]
        return {unquote(n.split("=", 1)[1]): f"{folder}/{n}" for n in names if n.startswith("_cell=")}

    def _pieces(self, manifest: dict[str, Any], folders: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schema"])).add("_seq", "long")
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, version: int | None = None, **kind: str) -> DataFrame | None:
        """The newest row of each key, of one kind if that is given; None as long as nothing was written. Files of other kinds are not opened, and cells of one piece need no merge."""
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            return None
        whole = set(kind) == set(self.kinds)
        cells = [c for name, c in manifest["cells"].items() if not whole or self._kind(name) == "/".join(kind[k] for k in self.kinds)]
        wanted = [F.col(f"`{k}`") == F.lit(v) for k, v in kind.items()]
        single, several = [f for c in cells if len(c) == 1 for f in c], [f for c in cells if len(c) > 1 for f in c]
        parts = [self._pieces(manifest, single)] if single else []
        parts += [self._latest(self._pieces(manifest, several))] if several else []
        if not parts:
            return self.spark.createDataFrame([], StructType.fromJson(json.loads(manifest["schema"])))
        return reduce(lambda a, w: a.where(w), wanted, reduce(DataFrame.unionByName, parts)).drop("_seq")

    def upsert(self, df: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Add rows, which replace older rows of their keys; False if nothing changed. A batch (writer, number) that was taken before changes nothing, so a replay is harmless."""

        def taken(manifest: dict[str, Any]) -> bool:
            return batch is not None and manifest["batches"].get(batch[0], -1) >= batch[1]

        before = self.manifest()
        if taken(before) or df.isEmpty():
            return False
        added = self._write(self._latest(df.withColumn("_seq", F.lit(before["version"] + 1).cast("long"))))

        def change(now: dict[str, Any]) -> dict[str, Any] | None:
            if taken(now):
                return None
            cells = now["cells"] | {c: [*now["cells"].get(c, []), f] for c, f in added.items()}
            return {"schema": now["schema"] or df.schema.json(), "cells": cells, "batches": now["batches"] | ({batch[0]: batch[1]} if batch else {})}

        done = self._change(change)
        self.compact()
        return done

    def replace(self, df: DataFrame) -> None:
        """Replace all rows of the kinds that `df` brings (without kinds: the whole table) at once; readers see either all old or all new rows."""
        added = self._write(self._latest(df.withColumn("_seq", F.lit(self.manifest()["version"] + 1).cast("long"))))
        gone = {self._kind(c) for c in added} if self.kinds else {""}

        def change(now: dict[str, Any]) -> dict[str, Any]:
            stay = {c: f for c, f in now["cells"].items() if self._kind(c) not in gone}
            return {"schema": now["schema"] or df.schema.json(), "cells": stay | {c: [f] for c, f in added.items()}}

        self._change(change)

    def compact(self, pieces: int | None = None) -> int:
        """Merge each cell of more than `pieces` (default: most_pieces) pieces into one; how many there were. Other cells are not touched."""
        before = self.manifest()
        full = {c: f for c, f in before["cells"].items() if len(f) > (self.most_pieces if pieces is None else pieces)}
        if not full:
            return 0
        merged = self._write(self._latest(self._pieces(before, [f for c in full.values() for f in c])))

        def change(now: dict[str, Any]) -> dict[str, Any] | None:
            cells = dict(now["cells"])
            for c, old in full.items():
                if cells.get(c, [])[: len(old)] == old:  # else it was replaced meanwhile
                    cells[c] = [merged[c], *cells[c][len(old) :]]
            return {"cells": cells} if cells != now["cells"] else None

        self._change(change)
        return len(full)

    def vacuum(self, keep: int = 2) -> int:
        """Delete manifests but for the newest `keep`, and folders that none of these names; how many cells' folders went. No writer or older reader may be active."""
        fs, known = self._fs(), self.versions()
        held: dict[str, set[str]] = defaultdict(set)
        for v in known[-keep:]:
            for f in (f for c in self.manifest(v)["cells"].values() for f in c):
                held[f.split("/")[1]].add(f.split("/")[2])
        gone = 0
        for folder in fs.listStatus(self._place("data")) if known else []:
            name = folder.getPath().getName()
            for cell in fs.listStatus(folder.getPath()):
                if cell.isDirectory() and cell.getPath().getName() not in held.get(name, set()):
                    gone += bool(fs.delete(cell.getPath(), True))
            if name not in held:
                fs.delete(folder.getPath(), True)
        for v in known[:-keep]:
            fs.delete(self._place(f"manifests/{v:012d}.json"), False)
        return gone
