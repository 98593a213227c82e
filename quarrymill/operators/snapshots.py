"""Tables with versions: staged Parquet files, a manifest a version, and one atomic rename that commits them all.

A version names each table's files. A commit stages new files beside the old ones, which never change, then renames its manifest to the next version's name, which fails
if there is one: that is the commit. Readers list a version's files, so later commits don't touch what they read. Rows go by copy on write of
the files that hold them. A commit has an id; one that is done already isn't done again, so a retried job or a replayed batch is safe.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another commit took the version; nothing of this one is visible. Read the new version and try again."""


class Store:
    """Versioned tables under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path, self._fs = jvm.Path, jvm.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def version(self) -> int:
        """The last committed version; 0 without one."""
        return max((int(f.getPath().getName()) for f in self._fs.listStatus(self._path(f"{self.root}/manifests")) if f.getPath().getName().isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "done": {}, "tables": {}}
        stream = self._fs.open(self._path(f"{self.root}/manifests/{version:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def done(self, commit_id: str) -> int | None:
        """The version that a commit made, if it is done."""
        return self.manifest()["done"].get(commit_id)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of a version, the last one unless told; the rows stay those of that version whatever is committed later."""
        known = self.manifest(version)["tables"][table]
        schema = StructType.fromJson(known["schema"])
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in known["files"])) if known["files"] else self.spark.createDataFrame([], schema)

    def has(self, table: str) -> bool:
        return table in self.manifest()["tables"]

    def begin(self, commit_id: str) -> Commit:
        return Commit(self, commit_id)


class Commit:
    """Changes of several tables that become visible together, or not at all."""

    def __init__(self, store: Store, commit_id: str):
        self.store, self.id, self.base = store, commit_id, store.manifest()
        self.tables = {name: {"files": list(t["files"]), "schema": t["schema"]} for name, t in self.base["tables"].items()}

    def _staged(self, table: str, rows: DataFrame) -> list[str]:
        folder = f"data/{table}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.store.root}/{folder}")
        files = self.store._fs.listStatus(self.store._path(f"{self.store.root}/{folder}"))
        return [f"{folder}/{f.getPath().getName()}" for f in files if f.getPath().getName().endswith(".parquet")]

    def rows(self, table: str) -> DataFrame:
        """A table as this commit has it so far."""
        known = self.tables[table]
        schema = StructType.fromJson(known["schema"])
        return self.store.spark.read.schema(schema).parquet(*(f"{self.store.root}/{f}" for f in known["files"])) if known["files"] else self.store.spark.createDataFrame([], schema)

    def append(self, table: str, rows: DataFrame) -> DataFrame:
        """Add rows to a table, which begins with them if it is new; returns the rows as they were staged."""
        known = self.tables.setdefault(table, {"files": [], "schema": json.loads(rows.schema.json())})
        names = StructType.fromJson(known["schema"]).names
        files = self._staged(table, rows.select(names))
        known["files"] += files
        schema = StructType.fromJson(known["schema"])
        return self.store.spark.read.schema(schema).parquet(*(f"{self.store.root}/{f}" for f in files)) if files else self.store.spark.createDataFrame([], schema)

    def delete(self, table: str, gone: DataFrame, keys: list[str]) -> int:
        """Take out the rows whose keys are among gone; only files that hold such a row are written again. Returns how many files were."""
        if table not in self.tables or not self.tables[table]["files"]:
            return 0
        gone = gone.select(keys).distinct()
        rows = self.rows(table)
        held = rows.withColumn("_file", F.input_file_name()).join(gone, keys, "left_semi").select("_file").distinct().collect()  # names of files, as a manifest has them
        names = {r["_file"].rsplit("/data/", 1)[1] for r in held}
        known = self.tables[table]
        hit = [f for f in known["files"] if f.removeprefix("data/") in names]
        if hit:
            left = self.store.spark.read.schema(rows.schema).parquet(*(f"{self.store.root}/{f}" for f in hit)).join(gone, keys, "left_anti").select(rows.columns)
            known["files"] = [f for f in known["files"] if f not in hit] + self._staged(table, left)
        return len(hit)

    def publish(self) -> int:
        """Commit; the new version. A commit whose id is done returns its version and changes nothing."""
        store, version = self.store, self.base["version"] + 1
        if (before := store.done(self.id)) is not None:
            return before
        body = {"version": version, "done": self.base["done"] | {self.id: version}, "tables": self.tables}
        staged = f"{store.root}/manifests/_{uuid.uuid4().hex}"
        out = store._fs.create(store._path(staged), False)
        try:
            out.write(bytearray(json.dumps(body).encode()))
        finally:
            out.close()
        target = f"{store.root}/manifests/{version:012d}"
        jvm = store.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store._path(target).toUri(), store.spark._jsc.hadoopConfiguration())
        options = store.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # never over another version
        try:
            context.rename(store._path(staged), store._path(target), options)
        except Exception as e:
            if store._fs.exists(store._path(target)):
                if (before := store.done(self.id)) is not None:
                    return before
                raise Conflict(f"version {version} is taken") from e
            raise
        return version
