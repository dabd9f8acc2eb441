"""Structured Streaming: chunking is stateless, so a stream of documents is chunked in append mode as a batch is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loomspark.functions.tokenizers import Spec
from loomspark.operators.chunk import chunk_text
from loomspark.options import ChunkingOptions


def chunk_stream(docs: DataFrame, options: ChunkingOptions | None = None, tokenizer: Spec | None = None, **more) -> DataFrame:
    """Chunks of a streaming DataFrame. Ids follow from the content, so a batch that runs again writes the same ids."""
    if not docs.isStreaming:
        raise ValueError("not a stream; use chunk_text")
    return chunk_text(docs, options, tokenizer=tokenizer, **more)


def write_chunks(chunks: DataFrame, path: str, checkpoint: str, available_now: bool = False, fmt: str = "parquet") -> StreamingQuery:
    """Appends chunks to files, exactly once."""
    writer = chunks.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
