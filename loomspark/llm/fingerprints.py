"""Document fingerprints: digests of improbable features.

Every window of 64 bytes of a text has an entropy (0 to 1000). How rare an entropy is in the corpus ranks the
window: the rarer, the better. In each run of 64 neighbouring windows the best one (ties: the first) wins, and windows with
16 wins or more are the text's features. Features are hashed and put into a chain of Bloom filters of 256
bytes, 160 features in each. Two fingerprints are alike as far as the bits of their filters overlap beyond chance: for
each filter of the shorter chain the best match in the other, weighted by features.

Ranks come from the entropies of all windows of all texts (:func:`fit_ranks`, one row for each of 1001 values), and may be
kept and used again, so that fingerprints of different corpora can be compared.

Defined cases: a null or empty text has an empty fingerprint; a text of less than 64 bytes has one feature, the whole
text; one with few features takes all windows that
won, or its best one. Two empty fingerprints are alike (1), an empty and another are
not (0). A very long text has a longer chain. Equal texts have equal fingerprints. Null ids come last and ties are ordered by a hash of the text; a
single document is its own next one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import slices, string_buffer, text_or_empty, word_hashes, written

WINDOW = RUN = 64
WINS = 16
#: Texts with fewer features than this take every window that won at all.
FEW = 4
FILTER_BITS, FEATURES = 2048, 160
LEAST_ENTROPY = 100
_UNIT = 1 << 20
_G = np.array([0, *[round(c * np.log2(c) * _UNIT) for c in range(1, WINDOW + 1)]], dtype=np.int64)
_STEP = np.diff(_G)
_BLOCK = 1 << 17


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy, scaled to 0 .. 1000, of each window of 64 bytes.

    A window's entropy follows from the one before it by the counts of the byte that leaves and the byte that comes.
    """
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, dtype=np.int64)
    ahead, behind = np.empty(n, dtype=np.uint8), np.empty(n, dtype=np.uint8)
    for b in range(0, n, _BLOCK):
        lo, hi = max(0, b - WINDOW), min(n, b + _BLOCK + WINDOW)
        part = data[lo:hi]
        a, z = np.zeros(hi - lo, dtype=np.uint8), np.zeros(hi - lo, dtype=np.uint8)
        for k in range(1, min(WINDOW, hi - lo)):
            same = (part[k:] == part[:-k]).view(np.uint8)
            a[:-k] += same
            z[k:] += same
        e = min(n, b + _BLOCK)
        ahead[b:e], behind[b:e] = a[b - lo : e - lo], z[b - lo : e - lo]
    total = np.empty(n - WINDOW + 1, dtype=np.int64)
    total[0] = _G[np.bincount(data[:WINDOW], minlength=256)].sum()
    np.cumsum(_STEP[behind[WINDOW:]] - _STEP[ahead[: n - WINDOW]], out=total[1:])
    total[1:] += total[0]
    most = 6 * WINDOW * _UNIT
    return np.clip((most - total) * 1000 // most, 0, 1000)


def _inside(offsets: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n - width + 1 windows lie in one text."""
    ok = np.ones(max(0, n - width + 1), dtype=bool)
    for cut in np.unique(offsets[1:-1]).tolist():
        ok[max(0, cut - width + 1) : cut] = False
    return ok


def fit_ranks(df: DataFrame, text: str = "text") -> np.ndarray:
    """Rank of each entropy, the rarest in the corpus first, from all windows of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1001, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = string_buffer(part.column("text"))
                if len(data) >= WINDOW:
                    total += np.bincount(entropies(data)[_inside(offsets, WINDOW, len(data))], minlength=1001)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["e", "n"])

    counts = np.zeros(1001, dtype=np.int64)
    for r in df.select(text_or_empty(text).alias("text")).mapInArrow(run, "e long, n long").groupBy("e").agg(F.sum("n").alias("n")).collect():
        counts[r["e"]] = r["n"]
    return ranks_of(counts)


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Entropies below LEAST_ENTROPY make weak features and come last."""
    order = np.lexsort((np.arange(1001), counts, np.arange(1001) < LEAST_ENTROPY))
    ranks = np.empty(1001, dtype=np.int64)
    ranks[order] = np.arange(1001)
    return ranks


def _feature_places(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the features of all texts, in order."""
    n, lengths = len(data), np.diff(offsets)
    begin = np.zeros(0, dtype=np.int64)
    if n >= WINDOW:
        key = (ranks[entropies(data)] << 32) | np.arange(n - WINDOW + 1)
        ok, wins = _inside(offsets, WINDOW + RUN - 1, n), np.zeros(n, dtype=np.int64)
        if len(ok):
            best, width = key, 1
            while width < RUN:
                best = np.minimum(best[:-width], best[width:])
                width *= 2
            wins = np.bincount(best[ok] & 0xFFFFFFFF, minlength=n)
        good = np.flatnonzero(wins >= WINS)
        poor = np.flatnonzero((np.diff(np.searchsorted(good, offsets)) < FEW) & (lengths >= WINDOW))
        more = [good]
        for i in poor.tolist():  # all winners, and at least the best window
            lo, hi = offsets[i], offsets[i + 1] - WINDOW + 1
            won = lo + np.flatnonzero(wins[lo:hi])
            more.append(won if len(won) else np.array([key[lo:hi].min() & 0xFFFFFFFF]))
        begin = np.unique(np.concatenate(more))
    short = offsets[:-1][(lengths > 0) & (lengths < WINDOW)]
    begin = np.sort(np.concatenate([begin, short]))
    text = np.searchsorted(offsets, begin, side="right") - 1
    return begin, np.minimum(begin + WINDOW, offsets[text + 1])


def fingerprint(column: pa.Array, ranks: np.ndarray) -> list[tuple[np.ndarray, list[int]]]:
    """For each text its filters (rows of bits) and the features in each."""
    data, offsets = string_buffer(column)
    begin, end = _feature_places(data, offsets, ranks)
    hashes = word_hashes(data, begin, end, seed=11)
    bounds = np.searchsorted(begin, offsets)
    out = []
    for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        h = hashes[b:e]
        if len(h) > 1:
            _, at = np.unique(h, return_index=True)
            h = h[np.sort(at)]
        rows = -(-len(h) // FEATURES)
        bits = np.zeros((rows, FILTER_BITS), dtype=bool)
        row = np.arange(len(h)) // FEATURES
        for k in range(5):
            bits[row, ((h >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
        out.append((bits, [min(FEATURES, len(h) - i * FEATURES) for i in range(rows)]))
    return out


def to_text(print_: tuple[np.ndarray, list[int]]) -> str:
    bits, counts = print_
    if not counts:
        return ""
    return f"{','.join(map(str, counts))}:{base64.b64encode(np.packbits(bits).tobytes()).decode()}"


def from_text(text: str) -> tuple[np.ndarray, list[int]]:
    if not text:
        return np.zeros((0, FILTER_BITS), dtype=bool), []
    counts, _, packed = text.partition(":")
    return np.unpackbits(np.frombuffer(base64.b64decode(packed), np.uint8)).astype(bool).reshape(-1, FILTER_BITS), [int(c) for c in counts.split(",")]


def likeness(one: tuple[np.ndarray, list[int]], two: tuple[np.ndarray, list[int]]) -> float:
    """0 (no more overlap than by chance) to 1."""
    if not one[1] or not two[1]:
        return float(len(one[1]) == len(two[1]))
    if (len(one[1]), one[1]) > (len(two[1]), two[1]):
        one, two = two, one
    a, b = one[0].astype(np.float32), two[0].astype(np.float32)
    na, nb = a.sum(axis=1)[:, None], b.sum(axis=1)[None, :]
    chance, most = na * nb / FILTER_BITS, np.minimum(na, nb)
    score = np.clip((a @ b.T - chance) / np.maximum(most - chance, 1e-9), 0, 1).max(axis=1)
    return float(np.dot(score.astype(np.float64), one[1]) / sum(one[1]))


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.strip().split(" ")[0] for x in _RESULT.split(",")]


def _compared(ids: list, texts: list[str], prints: list, following: list[tuple[str, tuple]], ranks: np.ndarray) -> list[tuple]:
    """Result rows of documents, given the text and fingerprint of the document after each."""
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, (n, _) in zip(texts, following, strict=True)]
    changed = fingerprint(pa.array(edited, pa.large_string()), ranks) if edited else []
    return [
        (i, len(t), hashlib.sha256(e.encode()).hexdigest(), to_text(p), to_text(c), likeness(p, c), likeness(p, q))
        for i, t, e, p, c, (_, q) in zip(ids, texts, edited, prints, changed, following, strict=True)
    ]


def _columns(rows: list[tuple]) -> list[pa.Array]:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, types, strict=True)]


def compare_neighbours(df: DataFrame, ranks: np.ndarray | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each document's fingerprint, and its likeness to its edited text and to the next document, by descending id.

    Documents are ranged by id once; each task compares neighbours as they come. Only the first and the last
    document of a task are set aside, and the last ones meet the first ones of the next task in a second, small step.
    """
    spark = df.sparkSession
    ranks = fit_ranks(df, text) if ranks is None else ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = None, None
        extra = lambda n, kind: [pa.array([kind] * n, pa.string()), pa.array([part] * n, pa.int32())]

        def aside(kind: str, row: tuple) -> pa.RecordBatch:
            blank = [pa.array([row[0]], pa.int64()), *[pa.nulls(1, c.type) for c in _columns([])[1:]]]
            return pa.RecordBatch.from_arrays([*extra(1, kind), pa.array([row[1]], pa.string()), *blank], names=["kind", "part", "text", *_NAMES])

        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                ids, texts = piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()
                prints = fingerprint(piece.column("text"), ranks)
                part = piece.column("part")[0].as_py()
                if held is None:
                    yield aside("head", (ids[0], texts[0]))
                else:
                    ids, texts, prints = [held[0], *ids], [held[1], *texts], [held[2], *prints]
                held = ids.pop(), texts.pop(), prints.pop()
                after = [*zip(texts, prints, strict=True), (held[1], held[2])][1:]
                rows = _compared(ids, texts, prints, after, ranks)
                yield pa.RecordBatch.from_arrays([*extra(len(rows), "row"), pa.nulls(len(rows), pa.string()), *_columns(rows)], names=["kind", "part", "text", *_NAMES])
        if held is not None:
            yield aside("tail", held)

    order = F.col("doc_id").desc_nulls_last()
    rows = df.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order, F.xxhash64("text")).withColumn("part", F.spark_partition_id())
    found = written(ranged.select("part", "doc_id", "text").mapInArrow(run, f"kind string, part int, text string, {_RESULT}"), "fp-rows")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                own, after = fingerprint(piece.column("text"), ranks), fingerprint(piece.column("next_text"), ranks)
                texts, following = (piece.column(c).to_pylist() for c in ("text", "next_text"))
                yield pa.RecordBatch.from_arrays(_columns(_compared(piece.column("doc_id").to_pylist(), texts, own, list(zip(following, after, strict=True)), ranks)), names=_NAMES)

    parts = sorted(r["part"] for r in found.where("kind = 'head'").select("part").collect())
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, after int")
    heads = found.where("kind = 'head'").select(F.col("part").alias("after"), F.col("text").alias("next_text"))
    tails = found.where("kind = 'tail'").select("part", "doc_id", "text").join(follows, "part").join(heads, "after")
    return found.where("kind = 'row'").select(*_NAMES).unionByName(tails.select("doc_id", "text", "next_text").mapInArrow(finish, _RESULT))
