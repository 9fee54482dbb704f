"""Reading, and tables that cut lineage in the folder all executors share."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in a local session that names none."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="runlens-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def new_table(spark: SparkSession, name: str) -> str:
    """Path of a table that does not exist yet in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends there, and later reads prune columns."""
    spark = df.sparkSession
    path = new_table(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def per_worker(key: str, make):
    """The object ``make()`` builds, once per Python worker: unlike a module's globals it outlives a task."""
    store = sys.modules.setdefault("runlens_worker_objects", types.ModuleType("runlens_worker_objects")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Remembered:
    """What is known of words, in two generations of at most ``size`` words (and those of one call): when the younger one is
    full the older one goes, so frequent words stay."""

    def __init__(self, size: int) -> None:
        self.size, self.young, self.old = size, {}, {}

    def unknown(self, words: set[str]) -> list[str]:
        """The words to find out; all others are then in ``young``."""
        if len(self.young) + len(words) > self.size:
            self.young, self.old = {}, self.young
        young, old, new = self.young, self.old, []
        for w in words.difference(young):
            found = old.get(w)
            if found is None:
                new.append(w)
            else:
                young[w] = found
        return new
