"""Session settings and the scratch tables that cut lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "framesift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if "spark.sql.shuffle.partitions" not in conf and not spark.sparkContext.master.startswith("local"):
        # adaptive execution merges what is too small; it cannot split what is too large
        wanted = max(200, 3 * spark.sparkContext.defaultParallelism)
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers of this application the package, once; it runs inside UDFs."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    bundle = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="framesift-ship-"), "framesift"), "zip", os.path.dirname(home), "framesift"
    )
    spark.sparkContext.addPyFile(bundle)  # Spark hands the file to every executor
    _shipped.add(app)


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own. On a
    cluster a folder of one machine would be lost with that machine, so there we refuse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="framesift-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def save_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the scratch root and return a scan of it.

    Unlike cached blocks the files survive the loss of an executor; later plans start at
    the scan, so iterative operators do not grow their lineage. The caller owns the clean-up
    of the scratch root, as with any checkpoint folder.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/framesift-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
