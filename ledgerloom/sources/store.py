"""Versioned tables: each publish writes a new directory of Parquet tables, then swaps one manifest file by an atomic rename.

A reader resolves the manifest once and takes every table of an answer from that version, so that all of it is of one
snapshot. A failed publish leaves the old version in place. Files go through Spark's file system API, so that any store
that Spark reaches will do.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Iterable
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Busy(RuntimeError):
    """Another writer holds the lock."""


class CoverageError(RuntimeError):
    """A derived table does not cover the indexed tip."""


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, in local mode only, a temporary folder of this session."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_ledger_dir", None)
    if found is None:
        if not conf.get("spark.master", "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark.sparkContext._ledger_dir = "file://" + tempfile.mkdtemp(prefix="ledger-")
    return found


@dataclass(frozen=True)
class Version:
    spark: SparkSession
    path: str
    manifest: dict

    @property
    def generation(self) -> int:
        return self.manifest["generation"]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.manifest['tables'][name]}")

    def has(self, name: str) -> bool:
        return name in self.manifest["tables"]


class Store:
    EMPTY = {"generation": 0, "schema_version": 1, "indexed_height": -1, "indexed_block_hash": None, "tables": {}}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark._jvm.org.apache.hadoop
        self._fs = self._hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self._hadoop.fs.Path(f"{self.path}/{name}")

    def _write(self, name: str, text: str) -> None:
        out = self._fs.create(self._p(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def current(self) -> Version:
        """The published version; before any, an empty one with the checkpoint (-1, null)."""
        at = self._p("manifest.json")
        manifest = dict(self.EMPTY)
        if self._fs.exists(at):
            lines = self.spark.read.text(f"{self.path}/manifest.json", wholetext=True).first()
            manifest = json.loads(lines.value)
        return Version(self.spark, self.path, manifest)

    @contextmanager
    def writing(self, job: str = "writer"):
        """Single flight: a lock file that only one can create."""
        lock = self._p(f"{job}.lock")
        self._fs.mkdirs(self._hadoop.fs.Path(self.path))
        if not self._fs.createNewFile(lock):
            raise Busy(f"{job} is locked at {self.path}")
        try:
            yield
        finally:
            self._fs.delete(lock, False)

    def stage(self, name: str, df: DataFrame | Iterable[DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
        """Write a table that nobody reads yet, so that checks and later tables start from files and not from its whole plan.
        Several frames are taken and written one after another into one table, in a folder for each value of
        ``by``; what a write has shuffled goes when it ends."""
        path = f"staged-{uuid.uuid4().hex[:12]}/{name}"
        with self._cleaning():
            for one in [df] if isinstance(df, DataFrame) else df:
                one.write.mode("append").partitionBy(*by).option("compression", "zstd").parquet(f"{self.path}/{path}")  # identifiers are hexadecimal, which takes half
        out = self.spark.read.schema(one.schema).parquet(f"{self.path}/{path}")  # by parts of no rows no files are written
        out._staged = path
        return out

    @contextmanager
    def _cleaning(self):
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, None)
        self.spark.conf.set(key, "true")
        try:
            yield
        finally:
            self.spark.conf.unset(key) if before is None else self.spark.conf.set(key, before)

    def unstage(self, df: DataFrame, folder: str = "") -> None:
        """Delete a staged table, or a folder of it, that is no longer read and was never published."""
        self._fs.delete(self._p(f"{df._staged}/{folder}" if folder else df._staged), True)

    def publish(self, tables: dict[str, DataFrame], **manifest) -> Version:
        """Replace the given tables (staged or not) and manifest fields; other tables stay those of the version before. The
        manifest is last. Jobs of any kind that publish at once do so one after another, each on what the one before left."""
        staged = {name: getattr(df, "_staged", None) or self.stage(name, df)._staged for name, df in tables.items()}
        with self._alone("publish"):
            return self._replaced(staged, manifest)

    @contextmanager
    def _alone(self, job: str, seconds: float = 120):
        """``writing``, but waits for its turn."""
        end = time.monotonic() + seconds
        with ExitStack() as held:
            while True:
                try:
                    held.enter_context(self.writing(job))
                    break
                except Busy:
                    if time.monotonic() > end:
                        raise
                    time.sleep(0.1)
            yield

    def _replaced(self, staged: dict[str, str], manifest: dict) -> Version:
        old = self.current()
        generation = old.generation + 1
        names = {**old.manifest["tables"], **staged}
        new = {**old.manifest, **manifest, "generation": generation, "tables": names}
        self._write(f"manifest-{generation}.tmp", json.dumps(new))
        context = self._hadoop.fs.FileContext.getFileContext(self._p("x").toUri() if "://" in self.path else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(self._p(f"manifest-{generation}.tmp"), self._p("manifest.json"), options)
        return Version(self.spark, self.path, new)

    def require_schema(self, version: int) -> None:
        found = self.current().manifest["schema_version"]
        if found != version:
            raise CoverageError(f"the store has schema version {found}, not {version}")


def require_coverage(version: Version, field: str) -> None:
    """A derived table's anchor must be the indexed tip."""
    if version.manifest.get(field) != version.manifest["indexed_block_hash"]:
        raise CoverageError(f"{field} is {version.manifest.get(field)}, the tip is {version.manifest['indexed_block_hash']}")
