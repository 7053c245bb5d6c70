"""Session defaults and lineage cuts.

Intermediate results that several jobs read are written as parquet under the
cluster's shared ``spark.checkpoint.dir``; they outlive lost executors and keep
column pruning, which an RDD checkpoint would not.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators rely on; a cluster's own values win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "*", partitions: int = 8, app: str = "colloquy") -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(partitions))
               .config("spark.driver.memory", "12g")
               .config("spark.ui.enabled", "false")
               # Rows here cost work, not bytes: a few hundred kilobytes are worth a task.
               .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
               .config("spark.sql.streaming.stateStore.providerClass",
                       "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"))
    for name, value in DEFAULTS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Temporary folders of local sessions that name none, by application; and the folders written since each open ``scratch``.
_OWN: dict[str, str] = {}
_WRITTEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. A local session that names none gets a temporary one; a cluster has to name it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _OWN[app]


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: one lineage cut."""
    path = f"{shared_dir(df.sparkSession)}/colloquy-{uuid.uuid4().hex}"
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is materialised inside is removed at the end, so that a job leaves nothing behind. Results have to be written inside."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        for path in _WRITTEN.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
