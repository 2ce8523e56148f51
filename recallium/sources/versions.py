"""A table in versions: rows in buckets of Parquet, each version a small manifest that names the folders it consists of.

A writer puts its data files beside the others, then the next manifest under a name that must not exist yet. Where another writer was
first, the change is laid over the newer version, or made anew if that one changed a bucket that this writer had read. So no write is lost,
readers see whole versions only, and any version that is still there can be read or restored.

* append adds folders; it never conflicts.
* delete adds delete vectors (keys); they hide rows of earlier versions, so it never conflicts either.
* update rewrites the buckets that hold changed keys, and only these.
* replace hides keys and adds rows in one version.

Manifests list folders, not rows: bucket by bucket, each with the version that added it. compact() folds a bucket's folders and delete
vectors into one; vacuum() removes folders that no kept version names. A null key cannot be updated or deleted; the keys of changes are
distinct."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallium.sources.memories import updated


class ConcurrentWrite(Exception):
    """Other writers kept changing what this one had read."""


class Files:
    """The few operations on the shared file system that versions need."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf, self.gateway = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def path(self, name: str):
        p = self.jvm.org.apache.hadoop.fs.Path(name)
        return p, p.getFileSystem(self.conf)

    def children(self, folder: str) -> list[str]:
        p, fs = self.path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, name: str) -> str:
        p, fs = self.path(name)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        p, fs = self.path(name)
        fs.delete(p, True)

    def put_if_absent(self, name: str, text: str) -> bool:
        """Whether the file is now there with this text; false where the name was taken. The text appears as a whole."""
        p, fs = self.path(name)
        made, _ = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        fs.mkdirs(p.getParent())
        out = fs.create(made, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":  # a link is made or refused in one step
                nio, uri = self.jvm.java.nio.file, lambda x: self.jvm.java.nio.file.Paths.get(x.toUri().getPath(), self.gateway.new_array(self.jvm.java.lang.String, 0))
                nio.Files.createLink(uri(p), uri(made))
            else:
                rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf).rename(made, p, self.gateway.new_array(rename, 0))
            return True
        except Exception as e:
            if "AlreadyExists" not in str(e):
                raise
            return False
        finally:
            fs.delete(made, False)


@dataclass
class Change:
    """What a writer wants to do to whatever version is newest when it gets its turn."""

    operation: str
    #: Buckets whose rows it has read; newer versions must not have changed them.
    reads: set[int] = field(default_factory=set)
    #: Folders of rows and of delete vectors to add, by bucket, and buckets whose former folders go.
    rows: dict[int, str] = field(default_factory=dict)
    deletes: dict[int, str] = field(default_factory=dict)
    replaced: set[int] = field(default_factory=set)
    #: (stream, batch) that this change writes; a version remembers the last batch of each stream.
    once: tuple[str, int] | None = None


class Log:
    """Numbered manifests below root, each published under a name that did not exist."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def _name(self, version: int) -> str:
        return f"{self.root}/versions/{version:020d}.json"

    def history(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.children(f"{self.root}/versions") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        return json.loads(self.files.read(self._name(max(self.history()) if version is None else version)))

    def publish(self, version: int, manifest: dict) -> bool:
        return self.files.put_if_absent(self._name(version), json.dumps(manifest))


class Versions(Log):
    """The table below root. key: the column that identifies a row."""

    def __init__(self, spark: SparkSession, root: str, key: str = "doc_id"):
        super().__init__(spark, root)
        self.key = key

    # reading

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version (the newest unless told otherwise), of some buckets or all."""
        m = self.manifest(version)
        schema = T.StructType.fromJson(m["schema"])
        chosen = {int(b): f for b, f in m["buckets"].items() if buckets is None or int(b) in buckets}
        rows = self._folders(chosen, "rows", schema)
        if any(f["deletes"] for f in chosen.values()):
            gone = self._folders(chosen, "deletes", T.StructType([schema[self.key]])).groupBy(self.key).agg(F.max("_version").alias("_gone"))
            rows = rows.join(gone, self.key, "left").where("_gone IS NULL OR _version >= _gone")
        return rows.select(*schema.names)

    def _folders(self, buckets: dict, kind: str, schema: T.StructType) -> DataFrame:
        """Rows of all folders with the version that added them; a writer's folders carry its number in _commit."""
        paths = [f"{self.root}/{kind}/{commit}/bucket={b}" for b, f in buckets.items() for commit, _ in f[kind]]
        added = {commit: version for f in buckets.values() for commit, version in f[kind]}
        if not paths:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("_version", T.LongType())]))
        versions = self.spark.createDataFrame(list(added.items()), "_commit string, _version long")  # one row a folder, as in the manifest
        stored = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("_commit", T.StringType())])).parquet(*paths)
        return stored.join(F.broadcast(versions), "_commit").drop("_commit")

    # writing

    def _bucket(self, n: int):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(n)).cast("int")

    def _write(self, df: DataFrame, kind: str, n: int) -> dict[int, str]:
        """Bucket -> number of this write, for the buckets that got rows. Rows are rebalanced by bucket, so small buckets share tasks and large ones
        are cut into several files."""
        commit = uuid.uuid4().hex
        dealt = df.withColumns({"_commit": F.lit(commit), "bucket": self._bucket(n)}).hint("rebalance", "bucket")
        dealt.write.partitionBy("bucket").parquet(f"{self.root}/{kind}/{commit}")
        return {int(c.split("=")[1]): commit for c in self.files.children(f"{self.root}/{kind}/{commit}") if c.startswith("bucket=")}

    def create(self, df: DataFrame, buckets: int = 16) -> int:
        """The first version; fails where there is one."""
        rows = self._write(df, "rows", buckets)
        m = {"version": 1, "operation": "create", "changed": sorted(rows), "n": buckets, "schema": df.schema.jsonValue(), "buckets": {str(b): {"rows": [[rows[b], 1]] if b in rows else [], "deletes": []} for b in range(buckets)}}
        if not self.publish(1, m):
            raise ConcurrentWrite("the table exists")
        return 1

    def _commit(self, prepare: Callable[[dict], Change | None], attempts: int = 20) -> int | None:
        for _ in range(attempts):
            base = self.manifest()
            change = prepare(base)
            if change is None:
                return None
            while True:
                version = base["version"] + 1
                if self.publish(version, self._over(base, change, version)):
                    return version
                base = self.manifest(version)
                if change.reads & set(base["changed"]) or (change.once and base.get("batches", {}).get(change.once[0], -1) >= change.once[1]):
                    break
            for kind, folders in (("rows", change.rows), ("deletes", change.deletes)):
                for commit in set(folders.values()):
                    self.files.remove(f"{self.root}/{kind}/{commit}")
        raise ConcurrentWrite(f"{attempts} attempts")

    @staticmethod
    def _over(base: dict, change: Change, version: int) -> dict:
        buckets = {b: {"rows": list(f["rows"]), "deletes": list(f["deletes"])} for b, f in base["buckets"].items()}
        for b in change.replaced:
            buckets[str(b)] = {"rows": [], "deletes": []}
        for kind, folders in (("rows", change.rows), ("deletes", change.deletes)):
            for b, commit in folders.items():
                buckets[str(b)][kind].append([commit, version])
        batches = base.get("batches", {}) | ({change.once[0]: change.once[1]} if change.once else {})
        return base | {"batches": batches, "version": version, "operation": change.operation, "changed": sorted({*change.rows, *change.deletes, *change.replaced}), "buckets": buckets}

    def append(self, df: DataFrame) -> int:
        return self._commit(lambda m: Change("append", rows=self._write(df.select(*T.StructType.fromJson(m["schema"]).names), "rows", m["n"])))

    def delete(self, keys: DataFrame) -> int:
        """Hides the rows with these keys."""
        return self._commit(lambda m: Change("delete", deletes=self._write(keys.select(self.key).where(F.col(self.key).isNotNull()).distinct(), "deletes", m["n"])))

    def replace(self, keys: DataFrame, rows: DataFrame) -> int:
        """Hides the rows with these keys and adds others, in one version; the added ones may have the same keys."""

        def prepare(m: dict) -> Change:
            gone = self._write(keys.select(self.key).where(F.col(self.key).isNotNull()).distinct(), "deletes", m["n"])
            return Change("replace", deletes=gone, rows=self._write(rows.select(*T.StructType.fromJson(m["schema"]).names), "rows", m["n"]))

        return self._commit(prepare)

    def transact(self, operation: str, make: Callable[[DataFrame], tuple[DataFrame, DataFrame] | None]) -> int | None:
        """make(rows) -> (keys, new rows), or None: hides the keys and adds the rows in one version. Where another writer meanwhile changed a
        bucket that holds one of the keys, it is made anew from the newer rows."""

        def prepare(m: dict) -> Change | None:
            made = make(self.read(m["version"]))
            if made is None:
                return None
            keys, rows = made
            gone = self._write(keys.select(self.key).where(F.col(self.key).isNotNull()).distinct(), "deletes", m["n"])
            return Change(operation, reads=set(gone), deletes=gone, rows=self._write(rows.select(*T.StructType.fromJson(m["schema"]).names), "rows", m["n"]))

        return self._commit(prepare)

    def _rewrite(self, operation: str, touched: set[int], change: Callable[[DataFrame], DataFrame], m: dict) -> Change:
        rows = self._write(change(self.read(m["version"], touched)), "rows", m["n"]) if touched else {}
        return Change(operation, reads=touched, rows=rows, replaced=touched)

    def update(self, changes: DataFrame) -> int:
        """Non-null values of changes (key and some columns) take the place of the old ones; keys that are not there change nothing."""

        def prepare(m: dict) -> Change:
            touched = {r["b"] for r in changes.where(F.col(self.key).isNotNull()).select(self._bucket(m["n"]).alias("b")).distinct().collect()}  # at most n
            return self._rewrite("update", touched, lambda old: updated(old, changes, self.key), m)

        return self._commit(prepare)

    def merge(self, changes: DataFrame, values: Callable, once: tuple[str, int] | None = None) -> int | None:
        """Columns of the rows with the keys of changes get new values: values(old, new) -> {column: value}, where old and new give a column
        of the row and of the change. once: (stream, batch); a batch of a stream that is not above the last one written changes nothing,
        and the answer is None."""

        def laid(old: DataFrame) -> DataFrame:
            joined = old.join(changes.select(F.col(self.key).alias("_key"), F.struct(*changes.columns).alias("_new")), F.col(self.key) == F.col("_key"), "left")
            made = values(lambda c: F.col(c), lambda c: F.col(f"_new.{c}"))
            kept = {c: F.when(F.col("_key").isNotNull(), v.cast(old.schema[c].dataType)).otherwise(F.col(c)) for c, v in made.items()}
            return joined.select(*(kept[c].alias(c) if c in kept else F.col(c) for c in old.columns))

        def prepare(m: dict) -> Change | None:
            if once and m.get("batches", {}).get(once[0], -1) >= once[1]:
                return None
            touched = {r["b"] for r in changes.where(F.col(self.key).isNotNull()).select(self._bucket(m["n"]).alias("b")).distinct().collect()}  # at most n
            change = self._rewrite("merge", touched, laid, m)
            change.once = once
            return change

        return self._commit(prepare)

    def compact(self, most: int = 8) -> int:
        """Rewrites the buckets of more than `most` folders."""

        def prepare(m: dict) -> Change:
            return self._rewrite("compact", {int(b) for b, f in m["buckets"].items() if len(f["rows"]) + len(f["deletes"]) > most}, lambda old: old, m)

        return self._commit(prepare)

    def restore(self, version: int) -> int:
        """A new version with the rows of an old one; refused by whatever was written meanwhile."""
        old = self.manifest(version)
        for _ in range(20):
            now = max(self.history()) + 1
            if self.publish(now, old | {"version": now, "operation": "restore", "batches": self.manifest().get("batches", {}), "changed": list(range(old["n"]))}):
                return now
        raise ConcurrentWrite("20 attempts")

    def vacuum(self, keep: int = 10) -> int:
        """Only the newest `keep` versions stay readable; the number of folders removed. Not beside running writers."""
        versions = self.history()
        used = {(kind, commit) for v in versions[-keep:] for f in self.manifest(v)["buckets"].values() for kind in ("rows", "deletes") for commit, _ in f[kind]}
        for v in versions[:-keep]:
            self.files.remove(self._name(v))
        gone = [(kind, c) for kind in ("rows", "deletes") for c in self.files.children(f"{self.root}/{kind}") if (kind, c) not in used]
        for kind, c in gone:
            self.files.remove(f"{self.root}/{kind}/{c}")
        return len(gone)
