"""A stored table dealt into buckets by a hash of its key, changed bucket by bucket.

The rows of a change are written to a folder of their own, a subfolder for each bucket. What the table
consists of is said by its newest manifest, a small file with the folders of every bucket; a change ends
with the next manifest, put in place in one step. Until then readers see the table as it was, so a write
that dies half way leaves nothing behind but folders that no manifest names (``vacuum`` removes them).
A read for given keys, and a change to them, touch only the buckets that hold them.

Buckets and folders are counted by hundreds: the driver sees their names, never rows. A key that holds
most of the rows makes its bucket large; its rows are written and read by many tasks all the same.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_BUCKET = "_bucket"
#: So many different keys, of one or two short columns, are sent to all tasks instead of rows to the keys.
FEW_KEYS = 1_000_000


class ConcurrentChange(RuntimeError):
    """Another change was put in place first; this one has changed nothing."""


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: list[str], buckets: int = 64, compact_at: int = 8):
        """``key`` deals rows into ``buckets``; both must be the same for all users of a path. A bucket that
        consists of ``compact_at`` folders is written anew as one."""
        self.spark, self.path, self.key, self.buckets, self.compact_at = spark, path.rstrip("/"), key, buckets, compact_at
        self.schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
        self._jvm = spark._jvm
        self._files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    # --- manifests

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _listed(self, name: str) -> list[str]:
        if not self._files.exists(self._at(name)):
            return []
        return [s.getPath().getName() for s in self._files.listStatus(self._at(name))]

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._listed("_manifests") if n.endswith(".json"))

    def _manifest(self, version: int | None = None) -> tuple[int, dict]:
        """Number and contents of the newest manifest; before the first change 0 and nothing."""
        versions = self._versions()
        version = version if version is not None else (versions[-1] if versions else 0)
        if not version:
            return 0, {"buckets": {}, "marks": {}}
        stream = self._files.open(self._at(f"_manifests/{version:010d}.json"))
        try:
            return version, json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, contents: dict) -> None:
        """Puts the manifest after ``version`` in place, unless there is one already."""
        self._files.mkdirs(self._at("_manifests"))
        draft, final = self._at(f"_manifests/{uuid.uuid4().hex}.draft"), self._at(f"_manifests/{version + 1:010d}.json")
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps(contents).encode()))
        out.close()
        if self._files.exists(final) or not self._files.rename(draft, final):
            self._files.delete(draft, False)
            raise ConcurrentChange(f"version {version + 1} of {self.path} is already there")

    def marks(self) -> dict[str, int]:
        """The last number that each writer has put in place, for writers that may repeat a change."""
        return self._manifest()[1]["marks"]

    # --- reading

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _buckets_of(self, keys: DataFrame) -> set[str]:
        return set(self._keys_in(keys))

    def _keys_in(self, keys: DataFrame) -> dict[str, int]:
        """How many of the different ``keys`` each bucket has."""
        return {str(r[0]): r[1] for r in keys.select(*self.key).distinct().groupBy(self.bucket_of()).count().collect()}

    def _matched(self, rows: DataFrame, keys: DataFrame, on: list[str], how: str, few: bool) -> DataFrame:
        """``rows`` with (``left_semi``) or without (``left_anti``) the ``keys``, null equal to null. A
        ``few`` keys go to the rows, so that these are not dealt out anew."""
        keys = keys.select(*[F.col(c).alias(f"_gone_{c}") for c in on]).distinct()
        same = F.lit(True)
        for c in on:
            same = same & F.col(c).eqNullSafe(F.col(f"_gone_{c}"))
        return rows.join(keys.hint("broadcast") if few else keys, same, how)

    def _read(self, contents: dict, buckets: set[str] | None = None) -> DataFrame:
        folders = [f"{self.path}/data/{part}/{_BUCKET}={b}" for b, parts in contents["buckets"].items()
                   if buckets is None or b in buckets for part in parts]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """The rows as of now; with ``keys`` (a frame with the key columns) those of their buckets only."""
        contents = self._manifest()[1]
        return self._read(contents, None if keys is None else self._buckets_of(keys))

    def read_keys(self, keys: DataFrame) -> DataFrame:
        """The rows of the ``keys`` as of now."""
        contents, found = self._manifest()[1], self._keys_in(keys)
        return self._matched(self._read(contents, set(found)), keys, self.key, "left_semi", sum(found.values()) <= FEW_KEYS)

    def read_added(self, added: dict[str, list[str]]) -> DataFrame:
        """The rows that an ``append`` has added, as they were written."""
        return self._read({"buckets": added})

    # --- changes

    def _dealt(self, rows: DataFrame, laid: bool = False) -> DataFrame:
        """The rows with their bucket, to be written. Rows that are ``laid`` out in partitions of some size stay
        there, a file for each partition and bucket: an exchange would put all of them on disk once more."""
        rows = rows.select(*self.schema.names).withColumn(_BUCKET, self.bucket_of())
        return rows if laid else rows.hint("rebalance", _BUCKET)

    def _write(self, dealt: DataFrame) -> tuple[str, list[str]]:
        """A new folder with the rows, and the buckets that have any."""
        part = uuid.uuid4().hex
        dealt.sortWithinPartitions(_BUCKET, *self.key).write.partitionBy(_BUCKET).parquet(f"{self.path}/data/{part}")
        return part, [n.partition("=")[2] for n in self._listed(f"data/{part}") if n.startswith(f"{_BUCKET}=")]

    def _put(self, version: int, contents: dict, mark: tuple[str, int] | None) -> None:
        if mark:
            contents["marks"][mark[0]] = mark[1]
        full = [b for b, parts in contents["buckets"].items() if len(parts) >= self.compact_at]
        if full:
            part, _ = self._write(self._dealt(self._read(contents, set(full))))
            contents["buckets"] |= {b: [part] for b in full}
        self._commit(version, contents)

    def append(self, rows: DataFrame, mark: tuple[str, int] | None = None, laid: bool = False) -> dict[str, list[str]]:
        """Adds rows, and gives their folder by bucket, for ``read_added``. A ``mark`` (writer, number) is kept
        with the change."""
        version, contents = self._manifest()
        part, found = self._write(self._dealt(rows, laid))
        for bucket in found:
            contents["buckets"].setdefault(bucket, []).append(part)
        self._put(version, contents, mark)
        return {bucket: [part] for bucket in found}

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], mark: tuple[str, int] | None = None) -> None:
        """Replaces all rows of the buckets that hold the ``keys`` by what ``change`` makes of them, which must
        leave the rows of other keys as they are and those of a key in their bucket. Nothing is sorted out by key."""
        version, contents = self._manifest()
        touched = self._buckets_of(keys)
        part, found = self._write(self._dealt(change(self._read(contents, touched)), laid=True))
        contents["buckets"] = {b: parts for b, parts in contents["buckets"].items() if b not in touched} | {b: [part] for b in found}
        self._put(version, contents, mark)

    def replace(self, keys: DataFrame, rows: DataFrame, on: list[str] | None = None, mark: tuple[str, int] | None = None, laid: bool = False) -> None:
        """Takes out the rows of all ``keys`` and puts ``rows`` in. ``on`` are the columns that tell which
        rows go (by default the key); they include the key."""
        on = on or self.key
        version, contents = self._manifest()
        keys = keys.select(*on).distinct()
        in_bucket = self._keys_in(keys)
        touched, few = set(in_bucket), sum(in_bucket.values()) <= FEW_KEYS
        held = self._read(contents, touched)
        if few and on != self.key:  # only rows of the keys are dealt out, to be compared by all columns
            own = self._matched(held, keys, self.key, "left_semi", few)
            kept = self._matched(held, keys, self.key, "left_anti", few).unionByName(self._matched(own, keys, on, "left_anti", False))
        else:
            kept = self._matched(held, keys, on, "left_anti", few)
        part, found = self._write(self._dealt(kept.unionByName(rows.select(*self.schema.names)), laid))
        for bucket in touched - set(found):
            contents["buckets"].pop(bucket, None)
        for bucket in found:
            contents["buckets"][bucket] = [part] if bucket in touched else contents["buckets"].get(bucket, []) + [part]
        self._put(version, contents, mark)

    def update(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], mark: tuple[str, int] | None = None) -> None:
        """Replaces the rows of the ``keys`` by what ``change`` makes of them."""
        keys = keys.select(*self.key).distinct()
        self.replace(keys, change(self.read(keys).join(keys, self.key, "left_semi")), mark=mark)

    def vacuum(self, keep: int = 2) -> None:
        """Removes folders that none of the last ``keep`` manifests names, and older manifests. Not while
        another change is being written."""
        versions = self._versions()
        named = {part for v in versions[-keep:] for parts in self._manifest(v)[1]["buckets"].values() for part in parts}
        for part in set(self._listed("data")) - named:
            self._files.delete(self._at(f"data/{part}"), True)
        for version in versions[:-keep]:
            self._files.delete(self._at(f"_manifests/{version:010d}.json"), False)
