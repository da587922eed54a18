"""A session's stored stages: results kept once, so that later plans start from them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from threading import RLock
from weakref import WeakKeyDictionary

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"

Inputs = tuple[tuple[str, int, int], ...]


def named_folder(spark: SparkSession) -> str | None:
    """The shared folder the session names for intermediate data, if any."""
    return spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()


def input_files(df: DataFrame) -> Inputs:
    """(path, length, time of change) of every file that ``df`` starts from.

    Unlike ``df.inputFiles()``, which knows no files of a frame that Spark holds already.
    """
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    names: set[str] = set()
    for i in range(leaves.size()):
        if leaves.apply(i).getClass().getSimpleName() == "LogicalRelation":
            source = leaves.apply(i).relation()
            if source.getClass().getSimpleName() == "HadoopFsRelation":
                names.update(source.inputFiles())
    found, listed = [], {}
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        folder = path.getParent().toString()
        if folder not in listed:  # one listing for all files of a folder
            here = path.getFileSystem(conf).listStatus(path.getParent())
            listed[folder] = {s.getPath().getName(): (s.getLen(), s.getModificationTime()) for s in here}
        found.append((name, *listed[folder].get(path.getName(), (-1, -1))))
    return tuple(sorted(found))


@dataclass
class Stage:
    """A stored result: what it was computed from, and the frame that reads it."""

    plan: DataFrame
    inputs: Inputs
    stored: DataFrame
    path: str | None  # none where Spark holds the rows itself


@dataclass
class StageStore:
    """Stages of one session, each under its plan and the files it reads.

    A frame of the same meaning over unchanged files is read from its stored rows;
    where a file has changed, it is computed anew. Sources without files, such as a
    view of a database, count as unchanged until :meth:`clear`.

    Rows go to ``folder``, by default the one the session names in
    ``spark.checkpoint.dir``, as Parquet files: written at once, whole when read, and
    not lost with an executor. Where no folder is named Spark holds them in its own
    storage, memory first and local disks then: they are computed when first needed,
    and parts lost with an executor are computed again.
    """

    folder: str | None = None
    stages: dict[int, list[Stage]] = field(default_factory=dict)
    lock: RLock = field(default_factory=RLock)

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` computed once for all frames of its meaning."""
        inputs = input_files(df)
        with self.lock:
            same = self.stages.setdefault(df.semanticHash(), [])
            for stage in list(same):
                if stage.plan.sameSemantics(df):
                    if stage.inputs == inputs:
                        return stage.stored
                    same.remove(stage)
                    self._drop(stage)
            stage = self._store(df, inputs)
            same.append(stage)
            return stage.stored

    def clear(self) -> None:
        """Gives all storage back. Frames that read stored files are of no use afterwards."""
        with self.lock:
            for same in self.stages.values():
                for stage in same:
                    self._drop(stage)
            self.stages.clear()

    def _store(self, df: DataFrame, inputs: Inputs) -> Stage:
        folder = self.folder or named_folder(df.sparkSession)
        if not folder:
            return Stage(df, inputs, df.persist(StorageLevel.MEMORY_AND_DISK), None)
        path = f"{folder.rstrip('/')}/stages/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return Stage(df, inputs, df.sparkSession.read.schema(df.schema).parquet(path), path)

    @staticmethod
    def _drop(stage: Stage) -> None:
        if stage.path is None:
            stage.stored.unpersist()
            return
        spark = stage.plan.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(stage.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_STORES: WeakKeyDictionary[SparkSession, StageStore] = WeakKeyDictionary()


def store_of(spark: SparkSession) -> StageStore:
    """The session's own store."""
    return _STORES.setdefault(spark, StageStore())


def durable(df: DataFrame) -> DataFrame:
    """``df`` kept in its session's store."""
    return store_of(df.sparkSession).keep(df)


Keep = Callable[[DataFrame], DataFrame]
