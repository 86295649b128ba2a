"""Versions of a set of tables that become visible together.

Every attempt of a run writes to folders of its own (``<table>/run=<attempt>``, with ``day=``
folders below where a table is kept by day). A manifest lists the folders that make up each table,
as parts: one of each run, or one of each day for tables that are replaced by day. The next manifest
is written aside and renamed to its number, which fails if that number is taken; this single step
makes tables, rollups and exports of a run visible. A run that dies before it leaves folders that
no manifest names; ``sweep`` removes them.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .tables import _file_system, exists, remove

Parts = dict[str, dict[str, str]]


class Conflict(RuntimeError):
    """Another run has published since this one began."""


def _names(spark: SparkSession, folder: str) -> list[str]:
    target, files = _file_system(spark, folder)
    return [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []


@dataclass
class Version:
    """The tables below ``root`` as of a manifest, with what this attempt has put since."""

    spark: SparkSession
    root: str
    run: str = ""
    number: int = 0
    parts: Parts = field(default_factory=dict)
    attempt: str = ""

    @classmethod
    def open(cls, spark: SparkSession, root: str, run: str = "") -> Version:
        """The newest version; ``run`` names the run that will put tables."""
        root = root.rstrip("/")
        numbers = _numbers(spark, root)
        number = max(numbers, default=0)
        parts = _manifest(spark, root, number) if number else {}
        return cls(spark, root, run, number, parts, f"{run or 'read'}~{uuid.uuid4().hex[:12]}")

    def paths(self, name: str, but: str | None = None) -> list[str]:
        return [f"{self.root}/{folder}" for part, folder in sorted(self.parts.get(name, {}).items()) if part != but]

    def read(self, name: str, schema: T.StructType, earlier_only: bool = False) -> DataFrame:
        """The rows of a table, in the columns of ``schema``; those of other runs for ``earlier_only``."""
        paths = self.paths(name, self.run if earlier_only else None)
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths)
        return rows.select(*schema.fieldNames())

    def days(self, name: str) -> list[dt.date]:
        """Days that this run holds of a table kept by run and day."""
        folder = self.parts.get(name, {}).get(self.run)
        found = _names(self.spark, f"{self.root}/{folder}") if folder else []
        return [dt.date.fromisoformat(n[4:]) for n in found if n.startswith("day=")]

    def put(self, name: str, df: DataFrame, by_day: bool = False) -> None:
        """Rows of this run; they take the place of those it put before under this name."""
        folder = f"{name}/run={self.attempt}"
        if by_day:
            # one place per day, large days split by the adaptive planner: few, even files
            df.hint("rebalance", "day").write.partitionBy("day").parquet(f"{self.root}/{folder}")
        else:
            df.write.parquet(f"{self.root}/{folder}")
        self.parts.setdefault(name, {})[self.run] = folder

    def put_whole(self, name: str, df: DataFrame) -> None:
        """All rows of a small table."""
        folder = f"{name}/run={self.attempt}"
        df.write.parquet(f"{self.root}/{folder}")
        self.parts[name] = {"all": folder}

    def put_days(
        self, name: str, write: Callable[[str], None], requested: Iterable[dt.date] | None
    ) -> None:
        """Replace days of a table: ``write`` partitions by one day column below the path it is given.
        A requested day without rows goes; None stands for every day."""
        folder = f"{name}/run={self.attempt}"
        write(f"{self.root}/{folder}")
        made = {n.split("=")[1]: f"{folder}/{n}" for n in _names(self.spark, f"{self.root}/{folder}") if "=" in n}
        kept = {} if requested is None else dict(self.parts.get(name, {}))
        for day in requested or ():
            kept.pop(day.isoformat(), None)
        self.parts[name] = kept | made

    def publish(self) -> int:
        """Make all that was put visible, in one step."""
        folder = f"{self.root}/_manifests"
        aside, final = f"{folder}/.{self.attempt}", f"{folder}/{self.number + 1:09d}.json"
        jvm, target = self.spark._jvm, None
        target, files = _file_system(self.spark, aside)
        files.mkdirs(target.getParent())
        out = files.create(target, True)
        try:
            out.write(bytearray(json.dumps(self.parts, sort_keys=True).encode()))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), files.getConf())
        option = jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(option, 1)
        none[0] = option.NONE
        try:
            context.rename(files.makeQualified(target), files.makeQualified(jvm.org.apache.hadoop.fs.Path(final)), none)
        except Exception as problem:
            remove(self.spark, aside)
            if exists(self.spark, final):
                raise Conflict(f"version {self.number + 1} was published by another run") from problem
            raise
        self.number += 1
        return self.number


def _numbers(spark: SparkSession, root: str) -> list[int]:
    return [int(n[:9]) for n in _names(spark, f"{root}/_manifests") if n.endswith(".json") and n[:9].isdigit()]


def _manifest(spark: SparkSession, root: str, number: int) -> Parts:
    text = spark.read.text(f"{root}/_manifests/{number:09d}.json", wholetext=True).first()[0]
    return json.loads(text)


def sweep(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove what the last ``keep`` manifests do not name: folders of attempts that failed or were
    replaced, and older manifests. Only while no run is at work."""
    root = root.rstrip("/")
    numbers = sorted(_numbers(spark, root))
    named = set()
    for number in numbers[-keep:]:
        for parts in _manifest(spark, root, number).values():
            named |= {"/".join(folder.split("/")[:2]) for folder in parts.values()}
    gone = []
    for name in _names(spark, root):
        if not name.startswith("_"):
            gone += [f"{name}/{n}" for n in _names(spark, f"{root}/{name}") if n.startswith("run=") and f"{name}/{n}" not in named]
    gone += [f"_manifests/{number:09d}.json" for number in numbers[:-keep]]
    for folder in gone:
        remove(spark, f"{root}/{folder}")
    return gone


def of_version(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """A table of the newest version, for readers."""
    return Version.open(spark, root).read(name, schema)

