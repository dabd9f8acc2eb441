"""Text files and byte columns: read, drop the byte order mark, decode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.options import FILE_ACCESS_MODES, InvalidChunkingOptions

#: Byte order marks, the longest first, and their charsets.
MARKS = (("FFFE0000", "UTF-32LE"), ("0000FEFF", "UTF-32BE"), ("EFBBBF", "UTF-8"), ("FFFE", "UTF-16LE"), ("FEFF", "UTF-16BE"))


def decoded(content: Column, charset: str = "UTF-8", detect_bom: bool = True) -> Column:
    """The text of bytes. A byte order mark decides the charset, if wanted, and is no part of the text."""
    out = F.decode(content, charset)
    if detect_bom:
        for mark, own in reversed(MARKS):
            n = len(mark) // 2
            out = F.when(F.hex(F.substring(content, 1, n)) == mark, F.decode(F.substring(content, n + 1, 1 << 30), own)).otherwise(out)
    return out


def read_files(spark: SparkSession, path: str | list[str], charset: str = "UTF-8", detect_bom: bool = True, access_mode: str = "SharedRead") -> DataFrame:
    """path, modified, n_bytes, text of whole files, on any file system that Spark reads.

    access_mode is checked and has no further meaning: executors read immutable snapshots and lock nothing.
    """
    if access_mode not in FILE_ACCESS_MODES:
        raise InvalidChunkingOptions(f"{access_mode!r} is no access mode")
    if not path or (isinstance(path, str) and not path.strip()):
        raise InvalidChunkingOptions("a file needs a name")
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("n_bytes"), decoded(F.col("content"), charset, detect_bom).alias("text"))


def decode_column(df: DataFrame, content: str = "content", text: str = "text", charset: str = "UTF-8") -> DataFrame:
    """*df* with the text of a column of bytes instead of the bytes."""
    return df.withColumn(text, decoded(F.col(content), charset)).drop(content)
