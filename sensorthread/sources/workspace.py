"""A workspace: the tables of an event log as Parquet folders.

A run writes new rows, the cells it fills and tables that changed to folders of its own with random names, then one
manifest that names the folders of every table. A reader follows the newest manifest, so it sees all of a run or nothing
of it, and no run overwrites what it reads. The manifest's number is one more than that of the log the run has read, and
its file is put where none is in one step, so of two runs that read the same log one fails and can be run again. A run
that fails removes its folders; one that is killed leaves folders that no manifest names.

Adding rows or filling cells costs their own size, not that of the table: a reader puts filled cells in where the table
has none. `compact` makes one folder of many.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorthread.functions.folders import key_folder
from sensorthread.operators.combine import combine
from sensorthread.operators.log import EventLog
from sensorthread.operators.persist import with_cells
from sensorthread.schema import KEY_FOLDER, LINK_KEYS, WORK_TABLES
from sensorthread.session import remove


class Conflict(RuntimeError):
    """Another run has changed the workspace meanwhile."""


def _hadoop_path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _hadoop_path(spark, path)
    return files.exists(target)


def read_ocel(spark: SparkSession, path: str) -> EventLog:
    """An event log kept as one Parquet folder per table."""
    target, files = _hadoop_path(spark, path)
    names = sorted(s.getPath().getName() for s in files.listStatus(target) if s.isDirectory())
    return EventLog({n: spark.read.parquet(f"{path}/{n}") for n in names if not n.startswith(("_", "."))})


def _write(df: DataFrame, path: str, folder_by: str | None = None) -> None:
    # Without rows there would be no folder, and thus no file to know the columns from.
    if folder_by is None or df.isEmpty():
        df.write.option("compression", "zstd").parquet(path)
        return
    # Ranges split a key that has many of the rows among tasks.
    dealt = df.withColumn(KEY_FOLDER, key_folder(F.col(folder_by))).repartitionByRange(KEY_FOLDER, *df.columns)
    dealt.write.option("compression", "zstd").partitionBy(KEY_FOLDER).parquet(path)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with the text, unless there is one; whether it was made. Readers see the whole file or none.

    The file is written under another name. Local file systems then link it, others rename it; both refuse a name that
    is taken, in one step. Object stores do so only if their file system's rename is such a step.
    """
    target, files = _hadoop_path(spark, path)
    draft, _ = _hadoop_path(spark, f"{path}-{uuid.uuid4().hex}.draft")
    out = files.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        if files.getUri().getScheme() != "file":
            return not files.exists(target) and files.rename(draft, target)
        file = spark._jvm.java.io.File
        link, whole = (file(files.makeQualified(p).toUri().getPath()).toPath() for p in (target, draft))
        spark._jvm.java.nio.file.Files.createLink(link, whole)
        return True
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    finally:
        files.delete(draft, False)


class Workspace:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _manifest(self) -> tuple[int, dict[str, list[str]]]:
        """Number of the newest version and its folders by table."""
        target, files = _hadoop_path(self.spark, f"{self.root}/manifest")
        if not files.exists(target):
            return 0, {}
        names = [s.getPath().getName() for s in files.listStatus(target)]
        number = max([int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()], default=0)
        if not number:
            return 0, {}
        stream = files.open(self._manifest_path(number)[1])
        try:
            return number, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _manifest_path(self, number: int):
        path = f"{self.root}/manifest/{number}.json"
        return path, _hadoop_path(self.spark, path)[0]

    def exists(self) -> bool:
        return self._manifest()[0] > 0

    def read(self) -> EventLog:
        return self._log(self._manifest()[1])

    def _table(self, folders: list[str]) -> DataFrame:
        parts = {f: self.spark.read.parquet(f"{self.root}/{f}") for f in folders}
        rows = combine([df for f, df in parts.items() if not f.startswith(_CELLS)])
        return with_cells(rows, [df for f, df in parts.items() if f.startswith(_CELLS)])

    def _log(self, paths: dict[str, list[str]]) -> EventLog:
        return EventLog({name: self._table(folders).drop(KEY_FOLDER) for name, folders in paths.items()})

    def begin(self, replace: bool = False) -> Change:
        """A change of the log as it is now, or of none of its tables if `replace`."""
        number, paths = self._manifest()
        return Change(self, number, {} if replace else paths)

    def commit(
        self,
        changed: dict[str, DataFrame],
        added: dict[str, DataFrame] | None = None,
        replace: bool = False,
    ) -> EventLog:
        """Save a new version: tables in `changed` get new rows only, tables in `added` keep theirs and get more,
        the others stay as they are, or go if `replace`."""
        with self.begin(replace) as change:
            for name, df in changed.items():
                change.replace(name, df)
            for name, df in (added or {}).items():
                change.add(name, df)
            return change.commit()

    def compact(self, least: int = 2) -> EventLog:
        """Write tables of `least` folders or more as one folder each; the rows stay the same."""
        with self.begin() as change:
            many = [name for name, folders in change.paths.items() if len(folders) >= least]
            for name in many:
                change.replace(name, change.log[name])
            return change.commit() if many else change.log


_CELLS = "cells/"


class Change:
    """Folders that are written beside a version of the log and become the next version at once, by `commit`.

    As a context it removes its folders if it is left without that.
    """

    def __init__(self, workspace: Workspace, number: int, paths: dict[str, list[str]]):
        self.workspace, self.number = workspace, number
        self.paths = {name: list(folders) for name, folders in paths.items()}
        self.log = workspace._log(paths)
        self._written: list[str] = []
        self._done = False

    def links(self, name: str) -> DataFrame | None:
        """A link table as it was, with the folder of each row, null in a log that was not written here; None without."""
        return self.workspace._table(self.paths[name]) if name in self.paths else None

    def _write(self, kind: str, name: str, df: DataFrame) -> str:
        folder = f"{kind}{name}/{uuid.uuid4().hex}"
        self._written.append(folder)
        _write(df, f"{self.workspace.root}/{folder}", LINK_KEYS.get(name))
        return folder

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """The table gets these rows only. Returns the rows as written."""
        folder = self._write("tables/", name, df)
        self.paths[name] = [folder]
        return self.workspace.spark.read.parquet(f"{self.workspace.root}/{folder}")

    def add(self, name: str, df: DataFrame) -> None:
        """The table gets more rows."""
        self.paths[name] = [*self.paths.get(name, []), self._write("tables/", name, df)]

    def fill(self, name: str, cells: DataFrame) -> None:
        """The table gets values where it has none: `cells` has `ocel_id` and columns, null where it has nothing to give."""
        self.paths[name] = [*self.paths[name], self._write(_CELLS, name, cells)]

    def commit(self) -> EventLog:
        path, _ = self.workspace._manifest_path(self.number + 1)
        if not put_if_absent(self.workspace.spark, path, json.dumps(self.paths)):
            raise Conflict("another run has changed the workspace meanwhile; run this one again")
        self._done = True
        return self.workspace._log(self.paths)

    def __enter__(self) -> Change:
        return self

    def __exit__(self, *_) -> None:
        if not self._done:
            for folder in self._written:
                remove(self.workspace.spark, f"{self.workspace.root}/{folder}")


def init_workspace(source: EventLog, workspace: Workspace, overwrite: bool = False) -> bool:
    """Copy a log into the workspace. An existing copy is kept unless `overwrite`; returns whether it copied."""
    if workspace.exists() and not overwrite:
        return False
    workspace.commit(dict(source), replace=True)
    return True


def export_ocel(workspace: Workspace, path: str) -> EventLog:
    """The log with everything written into it, without the tables runs keep for themselves."""
    for name, df in workspace.read().items():
        if name not in WORK_TABLES:
            _write(df, f"{path}/{name}")
    return read_ocel(workspace.spark, path)
