"""Versions of tables that become visible all at once.

Data is written to folders of its own first. One small file, written last, then says which folders make up a version:
``_manifests/<version>.json`` below the base folder. Readers take the highest version, so what a killed writer left
behind is never read. The file is moved to its name without replacing another, so of two writers that started from one
version only one succeeds; the other gets :class:`PublishConflict` and may try again from the new one. (That needs a
file system whose rename is atomic and refuses an existing name, such as HDFS. An object store needs one writer.)
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from fieldledger.schemas import SCHEMAS
from fieldledger.sources.parquet import store
from fieldledger.sources.tables import Tables

#: The last so many versions stay readable; folders that only older ones need are deleted.
KEPT = 20


class PublishConflict(RuntimeError):
    """Somebody else published the version that was about to be published."""


class ManifestLog:
    """The manifests below one base folder."""

    def __init__(self, spark: SparkSession, base: str):
        self.base = base.rstrip("/")
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def versions(self) -> list[int]:
        folder = self._path("_manifests")
        if not self._fs.exists(folder):
            return []
        names = (status.getPath().getName() for status in self._fs.listStatus(folder))
        return sorted(int(m[1]) for m in (re.fullmatch(r"(\d+)\.json", n) for n in names) if m)

    def read(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"_manifests/{version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """The current version and what it holds; version 0 holds nothing."""
        versions = self.versions()
        return (versions[-1], self.read(versions[-1])) if versions else (0, {})

    def commit(self, version: int, content: Mapping[str, Any], retired: Iterable[str] = ()) -> None:
        """Makes ``content`` the given version; ``retired`` are the folders that it no longer needs."""
        waiting = [*content.get("retired", []), *([folder, version] for folder in retired)]
        # What version 5 retired, version 4 still reads.
        old = [folder for folder, since in waiting if since <= version - KEPT + 1]
        content = {**content, "retired": [w for w in waiting if w[0] not in old]}
        staged = self._path(f"_manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(staged, False)
        out.write(json.dumps(content).encode())
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), self._conf)
        options = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(staged, self._path(f"_manifests/{version}.json"), options)
        except Py4JJavaError as error:
            self._fs.delete(staged, False)
            if "FileAlreadyExistsException" in str(error.java_exception):
                raise PublishConflict(f"version {version} of {self.base} exists") from error
            raise
        for folder in old:
            self._fs.delete(self._path(folder), True)
        for passed in self.versions():
            if passed <= version - KEPT:
                self._fs.delete(self._path(f"_manifests/{passed}.json"), False)


def publish(
    spark: SparkSession,
    base: str,
    tables: Mapping[str, DataFrame],
    cluster_by: Mapping[str, Sequence[str]] | None = None,
    expected: int | None = None,
) -> int:
    """Write new contents of several tables and make them visible as one version, whose number is returned.

    Tables that are not given stay as they are in the version before. ``expected`` is the version that the new contents
    were made from; if it is not the current one any more, nothing is published.
    """
    log = ManifestLog(spark, base)
    version, content = log.latest()
    if expected is not None and version != expected:
        raise PublishConflict(f"{base} is at version {version}, not {expected}")
    before = content.get("tables", {})
    folders = {name: f"{name}/stage={uuid.uuid4().hex}" for name in tables}
    for name, df in tables.items():
        store(df, f"{log.base}/{folders[name]}", (cluster_by or {}).get(name, ()))
    log.commit(version + 1, {**content, "tables": before | folders}, [before[n] for n in folders if n in before])
    return version + 1


def published_version(spark: SparkSession, base: str) -> int:
    return ManifestLog(spark, base).latest()[0]


def published_tables(spark: SparkSession, base: str, version: int | None = None) -> Tables:
    """The tables of the current version, or of another of the last :data:`KEPT`. All come from one version, however
    much is published while they are read."""
    log = ManifestLog(spark, base)
    content = log.latest()[1] if version is None else log.read(version)

    def opener(name: str, folder: str):
        return lambda: spark.read.schema(SCHEMAS[name]).parquet(f"{log.base}/{folder}")

    return Tables({name: opener(name, folder) for name, folder in content.get("tables", {}).items()})
