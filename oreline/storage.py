"""Written tables in the folder that the cluster shares.

Iterative and multi-pass operators cut their lineage here: a lost executor
then costs a re-read of files, not a recomputation of every pass so far.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder: the session's setting, else the context's checkpoint folder.

    Without either a local master (tests, one machine) gets a folder of its own;
    any other master is refused, since its executors would each write to a disk
    that the others can't read.
    """
    root = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="oreline-shared-")
        spark.conf.set(_SETTING, root)
    return root.rstrip("/")


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of the files.

    The files stay, as a result may read them at any later time.
    """
    return _write(df, f"{shared_root(df.sparkSession)}/{tag}-{uuid.uuid4().hex}")


class Passes:
    """Tables between the passes of one run, deleted once a later pass has read them."""

    def __init__(self, spark: SparkSession, tag: str):
        self._spark, self._paths, self._number = spark, {}, itertools.count()
        self._root = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self._paths[name] = f"{self._root}/{name}-{next(self._number)}"
        return _write(df, self._paths[name])

    def drop(self, *names: str) -> None:
        """Delete tables that nothing still to be computed reads."""
        for name in names:
            path = self._spark._jvm.org.apache.hadoop.fs.Path(self._paths.pop(name))
            path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop_all(self) -> None:
        """Delete all tables written so far."""
        self.drop(*list(self._paths))
