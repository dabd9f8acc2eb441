"""Mixing sources to target weights by Sainte-Lague apportionment.

The size of a document is its number of words. Sources, in code-point order with null last, get the weights in
turn and share ``share`` of all words by weight; a target stops at ``most`` times its source's size, and
what it leaves is shared again by weight among the others until no target is above its stop.

Documents of a source are dealt by a seeded hash of their id and text into shards of about ``SHARD_WORDS`` words. The words of a
shard, in document order, are cut into blocks of ``BLOCK_WORDS`` words (evened out, so that blocks of a shard differ
by one word at most). Blocks are the seats of the apportionment. Sources compete for all seats of the mix by the
highest quotients of ``weight / (2 s + 1)``, a source's weight being its target in blocks of its own; its seats go to its groups
of shards, and in each group to its shards, by the quotients of ``blocks / (2 s + 1)``; nothing gets more than ``most`` times
its blocks. In a shard every block is taken as often as all can be, and a seeded choice of blocks once more. A document gets
the words of its blocks, so none is taken more than ``most`` times.

What the driver sees is a row for each source and up to ``GROUPS`` rows for a source's groups: it holds no document and
no shard. Shards bound the work of a task, whatever the size of a source; rows that repeat in source, id and text are numbered
(within each partition, then by the partitions' counts) and dealt one by one, so they don't meet in one shard either.

Defined cases: a null or empty text, or one without words, has size 0, is taken 0 times and isn't dealt; a null source is
a source of its own; a source without words has target 0; repeated rows and rows with equal ids are documents of their own,
in the order of their texts' hashes; a null id comes last in its shard; a very long text is a run of blocks like any other;
an empty table gives an empty result; extra columns, whatever their names, are kept by :func:`mix` and ignored by :func:`takes`.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import WORD_RE, mix64, text_or_empty, written

BLOCK_WORDS = 32
SHARD_WORDS = 1 << 16
#: Shards of a group, at least, and groups of a source, at most.
GROUP_SHARDS = 1024
GROUPS = 4096


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    seed: int = 20240607


def targets(sizes: dict[str | None, int], mix: Mix) -> dict[str | None, float]:
    """Words to take of each source."""
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: mix.weights[i % len(mix.weights)] for i, s in enumerate(order)}
    left, open_, out = mix.share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > mix.most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = float(mix.most * sizes[s])
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def apportion(weights: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Sainte-Lague: seats by the highest quotients weight / (2 s + 1), none above its cap; ties to the first.

    Starts from a divisor that gives too few seats and deals out the rest one by one.
    """
    weights, caps = np.asarray(weights, dtype=np.float64), np.asarray(caps, dtype=np.int64)
    seats = int(min(seats, caps.sum()))
    if seats <= 0:
        return np.zeros(len(weights), dtype=np.int64)
    at = lambda d: np.minimum(np.floor(weights / d + 0.5), caps).astype(np.int64)
    low, high = 0.0, 2.0 * weights.max() + 1.0  # high gives no seat
    for _ in range(200):
        mid = (low + high) / 2
        if at(mid).sum() <= seats:
            high = mid
        else:
            low = mid
        if high - low <= 1e-12 * high:
            break
    got = at(high)
    heap = [(-weights[i] / (2 * got[i] + 1), i) for i in range(len(weights)) if got[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def block_bounds(words: int, blocks: int) -> np.ndarray:
    return np.arange(blocks + 1, dtype=np.int64) * words // max(blocks, 1)


def block_takes(words: int, blocks: int, quota: int, seed: int) -> np.ndarray:
    """How often each block of a shard is taken."""
    out = np.full(blocks, quota // max(blocks, 1), dtype=np.int64)
    rest = quota - int(out.sum())
    rank = np.argsort(mix64(np.arange(blocks, dtype=np.uint64) + np.uint64(seed & (2**64 - 1))), kind="stable")
    out[rank[:rest]] += 1
    return out


def seats(goal: dict[str | None, float], sizes: dict[str | None, int], blocks: dict[str | None, int], mix: Mix) -> dict[str | None, int]:
    """Blocks to take of each source: all seats of the mix go by the highest quotients of the sources' targets."""
    order = sorted(blocks, key=lambda s: (s is None, s or ""))
    weights = np.array([goal[s] / sizes[s] * blocks[s] if sizes[s] else 0.0 for s in order])
    caps = np.array([mix.most * blocks[s] for s in order], dtype=np.int64)
    return dict(zip(order, apportion(weights, round(float(weights.sum())), caps).tolist(), strict=True)) if order else {}


_ROW = "__mix_row"
_KEY = ["source", "doc_id", "text_hash"]
_DOC = "row long, doc_id long, no_id boolean, source string, size long, source_size long, target double, taken long, spans array<struct<begin:long,end:long,times:long>>"


def _same(one: DataFrame, two: DataFrame, columns: list[str]) -> Column:
    return reduce(and_, [one[c].eqNullSafe(two[c]) for c in columns])


def _copies(sized: DataFrame) -> DataFrame:
    """row, copy: the number of each row among those that repeat in source, id and text (0, 1, ...).

    Rows are numbered inside their partition (the upper bits of the row number), then the partitions' counts are added up.
    """
    often = written(sized.groupBy(*_KEY).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "mix-often")
    rows = written(sized.join(often, _same(sized, often, _KEY), "left_semi").select("row", *_KEY, F.shiftright("row", 33).alias("part")), "mix-repeated")
    counts = rows.groupBy("part", *_KEY).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*_KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = written(counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "mix-first")
    own = rows.withColumn("own", F.row_number().over(Window.partitionBy("part", *_KEY).orderBy("row")) - 1)
    return written(own.join(first, _same(own, first, ["part", *_KEY])).select("row", (F.col("first") + F.col("own")).alias("copy")), "mix-copies")


def _taken(df: DataFrame, mix: Mix, text: str, key: str, source: str, row: Column) -> DataFrame:
    """:data:`_DOC` of every row of *df*, with nulls where there is no id."""
    spark = df.sparkSession
    size = F.regexp_count(text_or_empty(f"`{text}`"), F.lit(WORD_RE)).cast("long")
    sized = df.select(row.alias("row"), F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), size.alias("size"), F.xxhash64(text_or_empty(f"`{text}`")).alias("text_hash"))
    sized = written(sized, "mix-sizes")
    # one row a source: far fewer than documents
    sizes = {r["source"]: int(r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    goal = targets(sizes, mix)
    count = {s: max(1, -(-n // SHARD_WORDS)) for s, n in sizes.items()}
    schema = "source string, source_size long, target double, shards long, group_shards long"
    plan = spark.createDataFrame([(s, n, goal[s], count[s], max(GROUP_SHARDS, -(-count[s] // GROUPS))) for s, n in sizes.items()] or [], schema)
    known = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    with_words = known.where("size > 0")
    copies = _copies(sized.where("size > 0"))
    shard = F.pmod(F.xxhash64("doc_id", "text_hash", "copy", F.lit(mix.seed)), F.col("shards"))
    dealt = with_words.join(copies, "row", "left").withColumn("copy", F.coalesce("copy", F.lit(0).cast("long"))).withColumn("shard", shard)
    dealt = written(dealt.withColumn("grp", F.floor(F.col("shard") / F.col("group_shards"))).drop("shards", "group_shards"), "mix-dealt")
    shards = dealt.groupBy("source", "grp", "shard").agg(F.sum("size").alias("words"))
    shards = written(shards.withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("words") / BLOCK_WORDS)).cast("long")), "mix-shards")

    groups: dict[str | None, list] = {}
    for r in shards.groupBy("source", "grp").agg(F.sum("blocks").alias("blocks")).collect():
        groups.setdefault(r["source"], []).append((r["grp"], r["blocks"]))
    own = seats(goal, sizes, {s: sum(b for _, b in found) for s, found in groups.items()}, mix)
    rows = []
    for s, found in groups.items():
        found.sort()
        blocks = np.array([b for _, b in found], dtype=np.int64)
        rows += [(s, int(g), int(q)) for (g, _), q in zip(found, apportion(blocks, own[s], mix.most * blocks), strict=True)]
    quotas = spark.createDataFrame(rows, "source string, grp long, seats long")

    def within(key, pdf):
        pdf = pdf.sort_values("shard")
        pdf["quota"] = apportion(pdf["blocks"].to_numpy(), int(pdf["seats"].iloc[0]), mix.most * pdf["blocks"].to_numpy())
        return pdf[["source", "shard", "words", "blocks", "quota"]]

    per_group = shards.join(quotas, _same(shards, quotas, ["source", "grp"])).drop(quotas["source"], quotas["grp"])
    per_shard = written(per_group.groupBy("source", "grp").applyInPandas(within, "source string, shard long, words long, blocks long, quota long"), "mix-quotas")

    def choose(key, pdf):
        pdf = pdf.sort_values(["no_id", "doc_id", "text_hash", "copy"], kind="stable")
        words, blocks, quota = (int(pdf[c].iloc[0]) for c in ("words", "blocks", "quota"))
        source, number = key
        salt = int.from_bytes(hashlib.sha256(repr((mix.seed, source, int(number))).encode()).digest()[:8], "little")
        bounds, times = block_bounds(words, blocks), block_takes(words, blocks, quota, salt)
        total = np.concatenate([[0], np.cumsum(times * np.diff(bounds))])
        ends = np.cumsum(pdf["size"].to_numpy())
        begins = ends - pdf["size"].to_numpy()

        def upto(x):  # words taken before the shard's word x
            b = np.clip(np.searchsorted(bounds, x, side="right") - 1, 0, blocks - 1)
            return total[b] + (x - bounds[b]) * times[b]

        pdf["taken"] = upto(ends) - upto(begins)
        pdf["spans"] = [_spans(b, e, bounds, times) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
        return pdf[[x.split()[0] for x in _DOC.split(", ")]]

    # null ids go through pandas as 0 and a flag: a column with nulls would become floats
    cut = dealt.withColumns({"no_id": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0).cast("long"))})
    rows = cut.join(per_shard, _same(cut, per_shard, ["source", "shard"])).drop(per_shard["source"], per_shard["shard"])
    chosen = rows.groupBy("source", "shard").applyInPandas(choose, _DOC)
    wordless = known.where("size = 0").select("row", F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.array().cast("array<struct<begin:long,end:long,times:long>>").alias("spans"))
    return chosen.unionByName(wordless).withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def _spans(begin: int, end: int, bounds: np.ndarray, times: np.ndarray) -> list[dict]:
    """Word ranges of a document (the shard's words from *begin* to *end*) and how often they are taken."""
    out = []
    for i in range(int(np.searchsorted(bounds, begin, side="right")) - 1, int(np.searchsorted(bounds, end))):
        lo, hi, n = max(begin, int(bounds[i])) - begin, min(end, int(bounds[i + 1])) - begin, int(times[i])
        if n and out and out[-1]["end"] == lo and out[-1]["times"] == n:
            out[-1]["end"] = hi
        elif n:
            out.append({"begin": lo, "end": hi, "times": n})
    return out


def takes(df: DataFrame, mix: Mix = Mix(), text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and spans (word ranges of the document and how often they are taken)."""
    return _taken(df, mix, text, key, source, F.monotonically_increasing_id()).drop("row")


def mix(df: DataFrame, mix: Mix = Mix(), text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The mixture: one row for each pass over a document, with the words that the pass takes.

    Rows get numbers and are written first, so that each meets its own quota. A document of which all words are taken
    keeps its text as it is; of any other, the spans taken are joined by a line end. Columns are those of *df*.
    """
    numbered = written(df.withColumn(_ROW, F.monotonically_increasing_id()), "mix-rows")
    chosen = _taken(numbered, mix, text, key, source, F.col(_ROW)).where("taken > 0").select(F.col("row").alias(_ROW), F.col("size").alias("__mix_size"), F.col("spans").alias("__mix_spans"))
    met = numbered.join(written(chosen, "mix-takes"), _ROW)
    passes = met.withColumn("__mix_pass", F.explode(F.sequence(F.lit(1), F.array_max(F.col("__mix_spans.times")).cast("int"))))
    passes = passes.withColumn("__mix_spans", F.filter("__mix_spans", lambda s: s["times"] >= F.col("__mix_pass")))

    @F.pandas_udf("string")
    def cut(texts, spans, sizes):
        import pandas as pd

        word, out = re.compile(WORD_RE), []
        for t, own, n in zip(texts, spans, sizes, strict=True):
            if len(own) == 1 and own[0]["begin"] == 0 and own[0]["end"] == n:
                out.append(t)
                continue
            at = [m.span() for m in word.finditer(t)]
            out.append("\n".join(t[at[s["begin"]][0] : at[s["end"] - 1][1]] for s in own))
        return pd.Series(out, dtype=object)

    return passes.withColumn(text, cut(f"`{text}`", "__mix_spans", "__mix_size")).select(*[f"`{c}`" for c in df.columns])
