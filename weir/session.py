"""A session with the settings that the dialect's semantics rest on."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events".split()
#: UTC everywhere, ANSI errors, exact decimal scales, adaptive plans.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.decimalOperations.allowPrecisionLoss": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName("weir")
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **more}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset, a temporary one on a local master, or one in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    made = tempfile.mkdtemp(prefix="weir-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"file://{made}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with 32-bit integers widened, as the dialect has one integer type."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def views(spark: SparkSession, sf_dir: str, names: list[str] | None = None, spread: bool = False) -> None:
    """Temporary views of the tables; ``spread`` deals their rows to all cores, for queries whose rows cost far more than to move them."""
    for name in names or TABLES:
        df = table(spark, sf_dir, name)
        (df.repartition(spark.sparkContext.defaultParallelism) if spread else df).createOrReplaceTempView(name)
