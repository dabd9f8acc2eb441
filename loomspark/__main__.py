"""``python -m loomspark FILE... [--strategy S] [--max-tokens N] [--overlap N] [--words] [--json DIR]``: chunks of text files."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import functions as F

from loomspark.functions import tokenizers
from loomspark.operators import chunk
from loomspark.options import STRATEGIES, ChunkingOptions
from loomspark.plans import contract
from loomspark.session import local_session
from loomspark.sources import files


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="loomspark", description=__doc__)
    args.add_argument("files", nargs="+")
    args.add_argument("--strategy", choices=STRATEGIES, default="FixedTokenCount")
    args.add_argument("--max-tokens", type=int, default=512)
    args.add_argument("--overlap", type=int, default=0)
    args.add_argument("--words", action="store_true", help="count words instead of byte pairs")
    args.add_argument("--json", help="a folder for the chunks as JSON lines")
    own = args.parse_args(argv)
    spark = local_session("*")
    began = time.perf_counter()
    docs = files.read_files(spark, own.files).select("path", "text")
    options = ChunkingOptions(strategy=own.strategy, max_tokens=own.max_tokens, overlap_count=own.overlap)
    chunks = chunk.chunk_text(docs, options, tokenizer=tokenizers.WORD if own.words else tokenizers.public_bpe(), keys=["path"])
    if own.json:
        chunks.select(contract.to_json(chunks).alias("value")).write.mode("overwrite").text(own.json)
    chunk.preview(chunks, "path").withColumn("path", F.element_at(F.split("path", "/"), -1)).show(40, truncate=False)
    chunk.summary(chunks).withColumn("elapsed_s", F.lit(round(time.perf_counter() - began, 2))).show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
