"""Ingestion documents: element rows to markdown, and chunks to (content, context, metadata) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions import native


def element_markdown():
    """Markdown of one element row (kind, level, text, alt, cells)."""
    text = F.coalesce("text", F.lit(""))
    cells = F.coalesce("cells", F.array().cast("array<array<string>>"))
    table = F.when(F.size(cells) > 0, native.markdown_table(F.try_element_at(cells, F.lit(1)), F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))))).otherwise("")
    table = F.regexp_replace(table, r"\n\z", "")
    return (
        F.when((F.col("kind") == "header") & (text != ""), F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(1))))), F.lit(" "), F.regexp_replace(text, r"\A[# ]+", "")))
        .when(F.col("kind") == "table", table)
        .when((F.col("kind") == "image") & (native.trim(F.coalesce("alt", F.lit(""))) != ""), native.trim(F.col("alt")))
        .otherwise(text)
    )


def to_markdown(elements: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text: blocks in order, blank ones dropped, joined by a blank line, without line ends at the end."""
    made = elements.select(key, "ord", element_markdown().alias("_m")).where(native.trim(F.col("_m")) != "")
    blocks = made.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", "_m"))).alias("_b"))
    return blocks.select(key, F.regexp_replace(F.array_join(F.transform("_b", lambda x: x["_m"]), "\n\n"), r"[\r\n]+\z", "").alias("text"))


def ingestion_chunks(chunks: DataFrame, key: str = "doc_id", prefix: str = "chunk") -> DataFrame:
    """key, position, content, context (breadcrumb or empty) and a map of seven values, named ``prefix.name``."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    names = {"position": "position", "tokenCount": "token_count", "characterCount": "character_count", "startOffset": "start_offset", "endOffset": "end_offset", "strategy": "strategy", "tokenizer": "tokenizer_model"}
    pairs = [x for k, c in names.items() for x in (F.lit(f"{prefix}.{k}"), value(c))]
    return chunks.select(key, "position", F.col("text").alias("content"), F.coalesce("header_context", F.lit("")).alias("context"), F.create_map(*pairs).alias("metadata"))
