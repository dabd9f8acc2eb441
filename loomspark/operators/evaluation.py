"""Retrieval quality of chunkings: overlap join, interval algebra, scores and a sweep over configurations."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import native
from loomspark.operators.chunk import searched_under
from loomspark.options import ChunkingOptions


def overlaps(spans: DataFrame, chunks: DataFrame, key: str | list[str] = "doc_id") -> DataFrame:
    """Chunks with offsets that overlap each span (key, label, start, length); spans without any stay, with nulls.

    An equi-join on the document with a range condition, so a span meets the chunks of its own document only.
    """
    keys = {k: f"_k{i}" for i, k in enumerate([key] if isinstance(key, str) else key)}
    c = chunks.where("start_offset >= 0").select(*[F.col(k).alias(own) for k, own in keys.items()], "position", "start_offset", "end_offset", "token_count")
    end, same = F.col("start") + F.col("length"), reduce(and_, [F.col(k) == F.col(own) for k, own in keys.items()])
    return spans.join(c, same & (F.col("end_offset") > F.col("start")) & (F.col("start_offset") < end), "left").drop(*keys.values())


def span_scores(spans: DataFrame, chunks: DataFrame, key: str | list[str] = "doc_id") -> DataFrame:
    """recall, precision and iou of each span; 0 where a denominator is 0."""
    met = overlaps(spans, chunks, key)
    ids = [*([key] if isinstance(key, str) else key), "label", "start", "length"]
    whole = native.islands(met.where("start_offset is not null").select(*ids, F.col("start_offset").alias("_s"), F.col("end_offset").alias("_e")), ids, "_s", "_e").withColumnRenamed("union_length", "retrieved")
    end = F.col("start") + F.col("length")
    inside = native.islands(met.where("start_offset is not null").select(*ids, F.greatest("start_offset", "start").alias("_s"), F.least("end_offset", end).alias("_e")), ids, "_s", "_e").withColumnRenamed("union_length", "hit")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = spans.join(whole, ids, "left").join(inside, ids, "left").select(*ids, zero("retrieved").alias("retrieved"), zero("hit").alias("hit"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    union = F.col("retrieved") + F.col("length") - F.col("hit")
    return out.select(*ids, ratio(F.col("hit"), F.col("length")).alias("recall"), ratio(F.col("hit"), F.col("retrieved")).alias("precision"), ratio(F.col("hit"), union).alias("iou"))


def score(docs: DataFrame, spans: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: mean recall, precision and iou over spans, chunks for each document, tokens for each chunk."""
    s = span_scores(spans, chunks, key).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("recall", "precision", "iou")])
    n = docs.agg(F.count("*").alias("n_docs"))
    c = chunks.agg(F.count("*").alias("n_chunks"), F.coalesce(F.avg("token_count"), F.lit(0.0)).alias("tokens_per_chunk"))
    per_doc = F.when(F.col("n_docs") > 0, F.col("n_chunks") / F.col("n_docs")).otherwise(0.0)
    return s.join(n, how="cross").join(c, how="cross").select("recall", "precision", "iou", per_doc.alias("chunks_per_doc"), "tokens_per_chunk")


def sweep(docs: DataFrame, spans: DataFrame, configs: dict[str, ChunkingOptions], key: str = "doc_id", text: str = "text", tokenizer=None) -> DataFrame:
    """The score of each configuration, best iou first (ties: as given).

    Each text is read and chunked once, under all of them. Pieces and spans of a document then meet in one row, which holds
    its sums for each configuration; spans that share a key with several texts meet the pieces of all.
    """
    found = searched_under(F.col(text), list(configs.values()), tokenizer)
    span = F.struct(F.col("start").cast("long").alias("start"), (F.col("start") + F.col("length")).cast("long").alias("end"), F.col("length").cast("long").alias("length"))
    rows = docs.select(key, found.alias("_c")).unionByName(spans.select(key, span.alias("_s")), allowMissingColumns=True)
    met = rows.groupBy(key).agg(F.collect_list("_c").alias("_c"), F.collect_list("_s").alias("_s"))
    under = lambda i: F.sort_array(F.flatten(F.transform("_c", lambda c: c[i])))
    each = met.select(F.size("_c").alias("n_docs"), F.when(F.col(key).isNotNull(), F.lit(True)).alias("_keyed"), "_s", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(len(configs) - 1)), under)).alias("ord", "_p"))
    sums = each.select("ord", "n_docs", F.size("_s").alias("n_spans"), F.size("_p").alias("n_chunks"), F.aggregate("_p", F.lit(0).cast("long"), lambda n, p: n + p["token_count"]).alias("tokens"), _score_sums(F.col("_s"), F.when(F.col("_keyed"), F.col("_p")).otherwise(F.slice("_p", 1, 0))).alias("_sums"))
    total = sums.select("*", "_sums.*").groupBy("ord").agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_spans", "n_chunks", "tokens", *_RATIOS)])
    names = docs.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(n) for n in configs])).alias("ord", "config"))
    mean = lambda a, b: F.coalesce(F.when(F.col(b) > 0, F.col(a) / F.col(b)), F.lit(0.0))
    return names.join(total, "ord", "left").select(*[mean(c, "n_spans").alias(c) for c in _RATIOS], mean("n_chunks", "n_docs").alias("chunks_per_doc"), mean("tokens", "n_chunks").alias("tokens_per_chunk"), "config", "ord").orderBy(F.desc("iou"), "ord")


_RATIOS = ("recall", "precision", "iou")


def _score_sums(spans: Column, pieces: Column) -> Column:
    """Sums of the scores of a document's spans over its pieces, which are in the order of their starts."""
    zero, ratio = F.lit(0).cast("long"), lambda a, b: F.when(b > 0, a / b).otherwise(0.0)

    def scored(sums: Column, s: Column) -> Column:
        near = F.filter(pieces, lambda p: (p["start_offset"] >= 0) & (p["end_offset"] > s["start"]) & (p["start_offset"] < s["end"]))

        def covered(acc: Column, p: Column) -> Column:
            new, end = F.greatest(p["start_offset"].cast("long"), acc["reach"]), p["end_offset"].cast("long")
            return F.struct(
                F.greatest(acc["reach"], end).alias("reach"),
                (acc["retrieved"] + F.greatest(zero, end - new)).alias("retrieved"),
                (acc["hit"] + F.greatest(zero, F.least(end, s["end"]) - F.greatest(new, s["start"]))).alias("hit"),
            )

        def added(acc: Column) -> Column:
            hit, retrieved, length = acc["hit"], acc["retrieved"], s["length"]
            values = (ratio(hit, length), ratio(hit, retrieved), ratio(hit, length + retrieved - hit))
            return F.struct(*[(sums[c] + F.coalesce(v, F.lit(0.0))).alias(c) for c, v in zip(_RATIOS, values, strict=True)])

        return F.aggregate(near, F.struct(zero.alias("reach"), zero.alias("retrieved"), zero.alias("hit")), covered, added)

    return F.aggregate(spans, F.struct(*[F.lit(0.0).alias(c) for c in _RATIOS]), scored)


def best(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.desc("iou"), "ord").limit(1)


#: The nine configurations of the standard sweep.
SWEEP = {
    "fixed-128": ChunkingOptions(max_tokens=128),
    "fixed-128-overlap-32": ChunkingOptions(max_tokens=128, overlap_count=32),
    "fixed-256": ChunkingOptions(max_tokens=256),
    "sentence-128": ChunkingOptions(strategy="SentenceBased", max_tokens=128),
    "sentence-64": ChunkingOptions(strategy="SentenceBased", max_tokens=64),
    "paragraph-256": ChunkingOptions(strategy="ParagraphBased", max_tokens=256),
    "recursive-128": ChunkingOptions(strategy="Recursive", max_tokens=128),
    "recursive-64": ChunkingOptions(strategy="Recursive", max_tokens=64),
    "recursive-128-overlap-16": ChunkingOptions(strategy="Recursive", max_tokens=128, overlap_count=16),
}


def locate(docs: DataFrame, answers: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans (key, label, start, length) of answers (key, label, answer) at their first place in the document."""
    at = F.instr(F.col(text), F.col("answer"))
    return docs.join(answers, key).where(at > 0).select(key, "label", (at - 1).alias("start"), F.length("answer").alias("length"))


#: Three short documents with three answers each, to try a sweep on.
SAMPLE = {
    "orchard": (
        "An orchard is pruned in late winter, before the sap rises. Dead and crossing branches go first, so that light reaches the middle of the tree.\n\n"
        "Codling moths are caught in traps hung at the height of the lowest fruit. A trap serves four trees for six weeks.\n\n"
        "Pears are picked hard and ripen in a cool room. Apples keep until spring if they don't touch each other.",
        ("Dead and crossing branches go first", "A trap serves four trees for six weeks", "Pears are picked hard and ripen in a cool room"),
    ),
    "harbour": (
        "# Harbour rules\n\nBoats over twelve metres call the harbour office on channel nine before they enter.\n\n## Moorings\n\n"
        "Visitors tie up at the yellow buoys. A night costs eleven coins, and the third night is free.\n\n## Tides\n\nThe sill opens two hours before high water and closes two hours after it.",
        ("call the harbour office on channel nine", "the third night is free", "The sill opens two hours before high water"),
    ),
    "loom": (
        "A floor loom holds the warp under tension between two beams. Treadles lift the shafts in the order of the pattern. "
        "The weft is beaten against the cloth after each pass of the shuttle. Uneven selvages come from a weft that is pulled too tight.\n"
        "Wool is washed before weaving and pressed after it; linen is woven damp.",
        ("Treadles lift the shafts in the order of the pattern", "Uneven selvages come from a weft that is pulled too tight", "linen is woven damp"),
    ),
}


def sample_corpus(spark) -> tuple[DataFrame, DataFrame]:
    """(documents, spans) of :data:`SAMPLE`."""
    docs = spark.createDataFrame([(k, t) for k, (t, _) in SAMPLE.items()], "doc_id string, text string")
    answers = spark.createDataFrame([(k, f"{k}-{i}", a) for k, (_, found) in SAMPLE.items() for i, a in enumerate(found)], "doc_id string, label string, answer string")
    return docs, locate(docs, answers)
