"""Plain text files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error) of the files below a folder: .txt files (in any case) whole, one row each; all else comes with the error cv_unreadable and is not read.

    Empty files have no row, since Spark's listing leaves them out. Files are dealt to tasks by size; a file is one value, so it must fit in a task.
    """
    files = spark.read.option("recursiveFileLookup", True)
    texts = files.option("pathGlobFilter", "*.[tT][xX][tT]").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.lit(None).cast("string").alias("error"))
    others = files.option("pathGlobFilter", "*").format("binaryFile").load(path).select("path").filter(~F.lower("path").endswith(".txt"))
    return texts.unionByName(others.select("path", F.lit(None).cast("string").alias("text"), F.lit("cv_unreadable").alias("error")))
