"""Documents as they come into a folder: a stateless stream of files to markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.markdown import Options
from ..sources.documents import markdown

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def markdown_stream(spark: SparkSession, folder: str, options: Options = Options(), files_per_trigger: int = 1000) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").load(folder)
    return markdown(files.select(F.col("path").alias("doc_id"), "content", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("format")), options)
