"""Span integrity of a chunk table, as counts per document that must be zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.tokenizers import WHITE, Spec
from loomspark.operators.chunk import searched
from loomspark.options import ChunkingOptions


def violations(docs: DataFrame, chunks: DataFrame, budget: int, key: str = "doc_id", text: str = "text", coverage: bool = True) -> DataFrame:
    """key, over_budget, bad_span, contained and uncovered for every document.

    over_budget: chunks with more tokens than *budget* (a lone code point may have more). bad_span: chunks with offsets
    that aren't the source there. contained: chunks that don't start and end after the one before. uncovered: source
    characters, white space aside, in no chunk.
    """
    # the source meets one row of its chunks, however many they are
    one = F.struct("position", "start_offset", "end_offset", "token_count", "text")
    rows = chunks.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("_chunks"))
    met = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_source")).join(rows.hint("merge"), key, "left")  # chunks are as large as the texts: never broadcast
    return _counted(met.select(key, "_source", F.coalesce(F.col("_chunks"), F.array().cast(rows.schema["_chunks"].dataType)).alias("_chunks")), budget, key, coverage)


def document_violations(docs: DataFrame, options: ChunkingOptions, tokenizer: Spec | None = None, key: str = "doc_id", text: str = "text", coverage: bool = True) -> DataFrame:
    """The same for the chunks of *docs* under *options*, without a shuffle or join: they are counted in the row that holds the source."""
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_source"))
    return _counted(rows.withColumn("_chunks", searched(F.col("_source"), options, tokenizer)), options.max_tokens, key, coverage)


def _counted(met: DataFrame, budget: int, key: str, coverage: bool) -> DataFrame:
    """The counts of rows (key, _source, _chunks: in order of position)."""
    source, found = F.col("_source"), F.col("_chunks")
    solid = lambda c: F.length(F.regexp_replace(c, f"[{WHITE}]+", "")).cast("long")
    flag = lambda c: F.when(c, 1).otherwise(0).cast("long")
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(0).alias("reach"), F.lit(-1).alias("s0"), F.lit(-1).alias("e0"), zero.alias("over_budget"), zero.alias("bad_span"), zero.alias("contained"), zero.alias("uncovered"))

    def step(x: Column, c: Column) -> Column:
        begin, end = c["start_offset"], c["end_offset"]
        has = begin >= 0
        gap = F.when(has, solid(F.substring(source, x["reach"] + 1, F.greatest(F.lit(0), begin - x["reach"])))).otherwise(zero)
        return F.struct(
            F.greatest(x["reach"], end).alias("reach"),
            begin.alias("s0"),
            end.alias("e0"),
            (x["over_budget"] + flag((c["token_count"] > budget) & (F.length(c["text"]) > 1))).alias("over_budget"),
            (x["bad_span"] + flag(has & (F.substring(source, begin + 1, end - begin) != c["text"]))).alias("bad_span"),
            (x["contained"] + flag(has & (x["s0"] >= 0) & ((begin <= x["s0"]) | (end <= x["e0"])))).alias("contained"),
            (x["uncovered"] + gap).alias("uncovered"),
        )

    sums = met.select(key, source, F.aggregate(found, start, step).alias("_x"), (F.try_element_at(found, F.lit(-1))["start_offset"] < 0).alias("_no_offsets"))
    rest = F.when(F.col("_no_offsets"), zero).otherwise(solid(F.substring(source, F.col("_x.reach") + 1, F.length(source))))
    return sums.select(key, *[F.col(f"_x.{c}").alias(c) for c in ("over_budget", "bad_span", "contained")], (F.col("_x.uncovered") + F.coalesce(rest, zero) if coverage else zero).alias("uncovered"))
