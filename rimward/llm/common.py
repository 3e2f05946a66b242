"""What the operators of this subpackage share: table access, staged tables, byte-level words."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of one word: a maximal run without space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: bytes.translate table that lower-cases A-Z and leaves all other bytes.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    A folder of this machine is used only if the setting is absent and Spark runs on this machine alone, as in tests.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(spark, "_rimward_shared", None)
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
            found = spark._rimward_shared = tempfile.mkdtemp(prefix="rimward-")
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; it is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/rimward/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of a batch that goes to a Python worker while a table is staged. A task holds a few batches on both sides.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def stage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    This cuts the lineage, fixes what later passes see, and survives the loss of executors.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(_BATCH)
    try:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    read = spark.read.schema(df.schema).parquet(path)
    read._staged_at = path
    return read


def release(spark: SparkSession, *staged: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more, and lets Spark's cleaner drop the shuffle files of
    finished queries (it does so when the JVM collects the garbage, otherwise only now and then)."""
    for df in staged:
        _drop(spark, df._staged_at)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lower_words(text: bytes | None) -> list[bytes]:
    """The words of UTF-8 text with A-Z lower-cased; bytes.split() splits at exactly the six ASCII blanks."""
    return text.translate(LOWER).split() if text else []


def text_bytes(column: str = "text"):
    """The text's UTF-8 bytes, a null text being empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named _0, _1, ..., which leaves all other names free, and the new name of each column."""
    names = {c: f"_{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names
