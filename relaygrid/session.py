"""Session settings and the shared work folder.

Two rules hold everywhere in the package:

* no broadcast hints.  A side is broadcast only when Spark itself sees that it
  is under ``spark.sql.autoBroadcastJoinThreshold``; beyond it the same plan
  runs as a shuffled join whose hot keys adaptive execution splits.
* lineage is cut only by writing to the shared folder the cluster names in
  ``spark.checkpoint.dir`` (see :func:`settle`), never to executor-local disk.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a skewed join is split even where that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the operators rely on."""
    for key, value in _RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Single-JVM session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("relaygrid")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    Taken from ``spark.checkpoint.dir``.  A local-mode session without the
    setting gets one folder below its warehouse, which is on the same machine
    anyway; a cluster without it is an error, because a machine-local path
    would lose data with the machine.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    context.setCheckpointDir(f"{warehouse}/relaygrid-work")
    return context.getCheckpointDir()


def work_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/relaygrid/{name}-{uuid.uuid4().hex}"


def config_table(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """A few configured rows as part of the plan.

    Spark knows their size, so a join with them never shuffles the other side.
    """
    row = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, schema.fields, strict=True)])
        for values in rows
    ]
    return spark.range(1).select(F.inline(F.array(*row)))


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used for registers (deletions, inserts, consumers, ...): the plan that
    probes them then knows their real size, so Spark broadcasts a small one and
    shuffles a large one, and nothing upstream is computed twice.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
