"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` is the folder of tables (default ``/root/testdata/sf0.1``), ``BENCH_CPUS`` the cores (default 8). The
documents are one row group, which is one task whatever the split size, so they are first written again in files of equal
rows, four for each core; ``tasks`` states how many and their rows. A query's time is that of writing all its columns to
Spark's no-op sink, once cold and once warm; ``queries`` has the warm times, ``cold`` the first ones, ``rates`` documents,
megabytes and chunks a second, and megabytes a second for each core. ``one_thread`` has seconds of the published
single-thread cases: windows with overlap over 622 KB, and an unbroken run of 800 KB.
"""

from __future__ import annotations

import base64
import json
import os
import random
import shutil
import tempfile
import time

from pyspark.sql import functions as F

from loomspark import catalogue
from loomspark.functions import tokenizers
from loomspark.operators.spans import Chunker
from loomspark.options import ChunkingOptions
from loomspark.session import local_session

HEADLINE = (
    "fixed_window_words",
    "fixed_window_native",
    "fixed_window_wide_overlap",
    "sentence_split",
    "sentence_pack",
    "regex_split",
    "bpe_windows",
    "wordpiece_counts",
    "integrity_bpe_fixed",
    "integrity_bpe_recursive",
    "integrity_wordpiece_fixed",
    "list_entries",
    "table_row_with_headers",
    "chunk_diagnostics",
    "span_evaluation",
    "hierarchy_sections",
)
RATED = ("fixed_window_words", "fixed_window_native", "sentence_pack", "bpe_windows")


def spread(spark, sf_dir: str, into: str, files: int) -> dict[str, int]:
    """The tables of *sf_dir* in *into*, the documents written again in *files* files of about equal bytes."""
    for name in os.listdir(sf_dir):
        if name != "documents.parquet":
            os.symlink(os.path.join(sf_dir, name), os.path.join(into, name))
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(files).write.parquet(f"{into}/documents.parquet")
    own = spark.read.parquet(f"{into}/documents.parquet").groupBy(F.input_file_name()).count().agg(F.count("*"), F.min("count"), F.max("count")).first()
    return {"files": own[0], "least_rows": own[1], "most_rows": own[2]}


def one_thread(text: str) -> dict[str, float]:
    """Seconds on one thread, tokenizers loaded before."""
    out = {}
    whole = (text * (1 + 622_000 // max(1, len(text))))[:622_000]
    run = base64.b64encode(random.Random(1).randbytes(600_000)).decode()
    for name, spec in (("bpe", tokenizers.public_bpe()), ("wordpiece", catalogue.word_pieces())):
        tok = spec.build()
        tok.count("warm")
        for case, s, o in (("windows_622kb", whole, ChunkingOptions(max_tokens=256, overlap_count=32)), ("run_800kb", run, ChunkingOptions(max_tokens=256))):
            began = time.perf_counter()
            Chunker(s, tok, o).chunk(0, len(s), o.max_tokens)
            out[f"{name}_{case}"] = round(time.perf_counter() - began, 3)
    return out


def main() -> None:
    source = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, max(cores, 8), "12g")
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")  # a task for each file
    sf_dir = tempfile.mkdtemp(prefix="loomspark-bench-")
    try:
        tasks = spread(spark, source, sf_dir, 4 * cores)
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        n_docs, n_bytes = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
        cold, warm, rates = {}, {}, {}
        for name in HEADLINE:
            for into in (cold, warm):
                began = time.perf_counter()
                catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                into[name] = round(time.perf_counter() - began, 3)
            if name in RATED:
                chunks = catalogue.QUERIES[name](spark, sf_dir).count()
                mb = n_bytes / 1e6 / warm[name]
                rates[name] = {"docs_per_s": round(n_docs / warm[name]), "mb_per_s": round(mb, 2), "mb_per_s_core": round(mb / cores, 3), "chunks_per_s": round(chunks / warm[name])}
        sample = "\n".join(r.text or "" for r in docs.select("text").limit(400).collect())
        print(json.dumps({"metric": "total warm time of the headline queries", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold, "rates": rates, "one_thread": one_thread(sample), "tasks": tasks, "sf": os.path.basename(source.rstrip("/")), "cpus": cores}))
    finally:
        shutil.rmtree(sf_dir, ignore_errors=True)


if __name__ == "__main__":
    main()
