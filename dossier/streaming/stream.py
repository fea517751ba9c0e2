"""The same extraction on a stream of files: records are per document, so no state is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dossier.config import Config
from dossier.operators.chunk import Count
from dossier.plans.pipeline import TaggerFactory, parse
from dossier.sources.documents import extract

BINARY = "path string, modificationTime timestamp, length long, content binary"


def stream_documents(spark: SparkSession, folder: str, pattern: str = "*", **options) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", pattern).load(folder)
    return extract(files.select(F.col("path").alias("input"), "content"), **options)


def stream_records(docs: DataFrame, config: Config, tagger: TaggerFactory | None = None, count: Count | None = None, as_of: Column | None = None) -> DataFrame:
    """Records of a streaming DataFrame of documents; rows with an error have empty texts' records."""
    return parse(docs.withColumn("raw_text", F.coalesce("raw_text", F.lit(""))), config, tagger, count, as_of)


def write_records(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, each file once; ends when what is there has been read."""
    return records.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
