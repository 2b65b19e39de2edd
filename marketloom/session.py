"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "marketloom", master: str | None = None, **conf: object) -> SparkSession:
    """Session for jobs and tests; on a cluster spark-submit supplies master and memory."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): str(v) for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that every executor can reach, below one folder of this application.

    It lies under ``spark.checkpoint.dir``, which the cluster sets to shared
    storage. Only a single-machine session may do without: there a local
    temporary folder takes its place, elsewhere a missing setting is an error,
    because executors would each write to a disk of their own.
    """
    root = _shared_root(spark)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="marketloom-")
    return f"{root.rstrip('/')}/marketloom/{spark.sparkContext.applicationId}/{purpose}-{uuid.uuid4().hex}"


def drop_shared(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; call it once their results are written."""
    root = _shared_root(spark)
    if root:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/marketloom/{spark.sparkContext.applicationId}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _shared_root(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Cut lineage with a table written to the shared folder; it outlives lost executors."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows evenly over the session's full width, before a step that computes much per row.

    A small file is one task, and a small shuffle is coalesced, however long a row takes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def sized_broadcast(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 64_000_000) -> DataFrame:
    """Broadcast hint for a dimension whose rows and bytes have been counted.

    Above either bound the frame comes back unhinted: the join then shuffles both
    sides and adaptive execution splits skewed partitions.
    """
    lengths = [F.octet_length(c) for c, kind in df.dtypes if kind in ("string", "binary")]
    nested = [F.octet_length(F.to_json(F.struct(c))) for c, kind in df.dtypes if kind.startswith(("array", "map", "struct"))]
    row = sum((F.coalesce(x, F.lit(0)) for x in [*lengths, *nested]), F.lit(16 * len(df.columns)))
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(row)).first()
    if rows <= max_rows and (size or 0) <= max_bytes:
        return F.broadcast(df)
    return df
