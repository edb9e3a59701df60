"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the jobs rely on; the cluster's own sizing (executors, memory, shuffle
# partitions) is left alone.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cpus: str = "8", memory: str = "16g", partitions: str | None = None) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("inkwitness")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", partitions or str(2 * int(cpus) if cpus.isdigit() else 16))
        # small files would otherwise be read by one task
        .config("spark.sql.files.openCostInBytes", "131072")
        .config("spark.sql.files.maxPartitionBytes", "8m")
    )
    for key, value in RUNTIME.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor shares, as the cluster names it in ``spark.checkpoint.dir``.

    Only a single-machine session may do without that setting: driver and executors are one process there, so a
    temporary folder of its own serves. On a cluster a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors share (master: {master})")
        key = spark.sparkContext.applicationId
        if key not in _own_folder:
            _own_folder[key] = tempfile.mkdtemp(prefix="spark-")
        folder = f"file://{_own_folder[key]}"
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For results that several branches of a job read: they are computed once, later scans stay
    columnar (pruning and pushdown still work), and a lost executor costs a re-read, not a re-run.
    The table is removed when the application ends, or earlier by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/inkwitness/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables made by ``materialise`` that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        for path in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
