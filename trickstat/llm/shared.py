"""Session helpers: the shared folder, written intermediate tables, column guards."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); where none is set and all runs in one process, as in tests, a new local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir isn't set: executors need a folder that they share")
        folder = "file://" + tempfile.mkdtemp(prefix="trickstat-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/trickstat/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a stored() table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/trickstat/" in path:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(spark: SparkSession) -> int:
    """How many groups packed rows are dealt out to: some for each shuffle partition, as a task holds one group at a time."""
    return 4 * partitions(spark)


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only key (as long) and text, so that further columns of any name do no harm."""
    return df.select(df[key].cast("long").alias("doc_id"), df[text].cast("string").alias("text"))


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and mark: a hash of the text if some doc_id occurs again, so that texts of one id stay apart; else 0."""
    rows = texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    again = rows.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return rows.withColumn("mark", F.xxhash64("text") if again else F.lit(0).cast("long"))
