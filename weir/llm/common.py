"""What the corpus operators share: staging in shared storage, byte texts, components.

Texts cross to Python as Arrow binary, so ``bytes.lower`` and ``bytes.split``
give the ASCII lower-casing and the ASCII-white-space words that the
operators are defined by, without decoding.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch of whole texts; Spark also bounds a batch by its bytes.
TEXT_BATCH = 2000
_LOCAL: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The whole ``documents`` table, pruned to ``columns`` when given."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share for intermediate tables.

    ``spark.checkpoint.dir`` where it is set; else, on a local master, a
    temporary folder removed at exit; else a folder of the warehouse, which a
    cluster shares as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="weir-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
    return f"file://{_LOCAL['dir']}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*staged: DataFrame) -> None:
    """Remove the files of staged tables that nothing will read again."""
    for df in staged:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_batches(spark: SparkSession, rows: int = TEXT_BATCH) -> None:
    """Bound the Arrow batches of what runs next in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def fold(df: DataFrame, modulus: int, remainder: int, key: str = "doc_id") -> "F.Column":
    """Whether crc32 of the key's text leaves ``remainder``; a null key is in no fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small(spark: SparkSession, rows: list[tuple], schema: str, most: int = 100_000) -> DataFrame:
    """A table of the driver's rows, broadcast while there are at most ``most`` of them and joined by a shuffle beyond."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= most else df


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): rows (node, root), root the smallest node.

    Every round each node takes the smallest label among its neighbours and
    then the label of that label, which halves the distance to the root. Both
    steps are joins and partial aggregations, so a hub of any degree is met by
    map-side minima and by AQE's skew splitting. Only the count of changed
    labels reaches the driver. No edges: no rows.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    both = stage(both.distinct(), "edges")
    for _ in range(rounds):
        near = (
            both.join(labels.select(F.col("node").alias("a"), "root"), "a")
            .groupBy(F.col("b").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        hooked = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = hooked.join(up, "root").select("node", "old", F.least("root", "above").alias("root"))
        new = stage(jumped, "labels")
        labels = new.select("node", "root")
        if new.where("old <> root").limit(1).count() == 0:
            return labels
    raise RuntimeError("components did not settle")
