"""Translations that arrive as files, checked and turned into tokenised verses as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pericope.functions.text import computed
from pericope.operators.index import with_tokens
from pericope.operators.verses import TRANSLATION, flatten
from pericope.sources.validate import all_faults


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha, value, faults): every file that comes into a folder, with all constraints that it breaks."""
    raw = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").load(path)
    named = raw.select(F.col("_metadata.file_path").alias("file"), F.sha1("value").alias("sha"), "value", all_faults("value").alias("faults_"))
    return computed(named, faults=F.col("faults_")).drop("faults_")


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """Tokenised verses of every translation file without a fault; stateless, so no watermark is needed."""
    sound = _files(spark, path).where("size(faults) = 0")
    return with_tokens(flatten(sound.select("sha", F.from_json("value", TRANSLATION).alias("t")).select("sha", "t.*")))


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha, rule, place): one row per constraint that a file breaks; such a file gives no verse."""
    return _files(spark, path).select("file", "sha", F.inline("faults"))


def _keep(d: DataFrame, out: str, checkpoint: str, *by: str) -> StreamingQuery:
    w = d.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (w.partitionBy(*by) if by else w).start()


def keep_indexed(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends arriving() to a Parquet folder by translation, exactly once per file."""
    return _keep(arriving(spark, path), out, checkpoint, "abbreviation")


def keep_rejected(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends rejected() to a Parquet folder, exactly once per file."""
    return _keep(rejected(spark, path), out, checkpoint)
