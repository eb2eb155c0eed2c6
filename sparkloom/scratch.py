"""Shared scratch tables: lineage is cut by writing Parquet into the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only on local masters (tests, a laptop) may it be unset: a local one is chosen then and stored in the session."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors share (master {master})")
        found = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables of one job. ``put`` writes and rereads a frame, ``drop`` deletes a superseded one; what is left goes when the application ends."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/sparkloom-{job}-{uuid.uuid4().hex}"
        self.made: list[str] = []
        where, store = self._at(self.root)
        store.mkdirs(where)
        store.deleteOnExit(where)

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def put(self, df: DataFrame, name: str, replace: bool = False) -> DataFrame:
        """The frame, written and reread; with replace, earlier tables of the name are deleted, which the frame may still have read."""
        path = f"{self.root}/{len(self.made):03d}-{name}"
        df.write.parquet(path)
        if replace:
            self.drop(name)
        self.made.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete every table of these names; frames that read them must not be used any more."""
        for path in [p for p in self.made if p.rsplit("-", 1)[1] in names]:
            where, store = self._at(path)
            store.delete(where, True)
            self.made[self.made.index(path)] = f"{path}-gone"
