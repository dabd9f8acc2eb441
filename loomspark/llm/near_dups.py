"""MinHash near-duplicates by a signature-coordinate inverted join.

Each text is lower-cased (A-Z) and cut into words; its set holds the distinct runs of ``width`` words (a
shorter text is one run). Texts with ``100 * |A & B| >= percent * |A | B|`` are linked, and groups are the
connected components of the links.

1. One scan gives every row a 128-bit hash of its set and ``K`` MinHash coordinates. Rows with equal sets form a
   class, which gets a number; from here on only classes are compared, by their numbers.
2. Every class is posted under each coordinate-value pair. A linked pair agrees on at least ``MATCHES`` of ``K``
   coordinates but for a chance of 2e-8 at the threshold itself, and far less above it. So each
   class keeps only its ``K - MATCHES + 1`` rarest coordinates (the prefix); frequent values are skipped, and a
   class with too few values that any other class has is done.
3. In each posting list the smallest class is the pivot and meets every other one: a pair for each posting, not for
   each two members. Collisions of a pair are counted; a pair that has ``MATCHES`` of them by then is retained, of any
   other the skipped coordinates are merged, too, and those below ``MATCHES`` of all ``K`` are dropped. What is retained is
   confirmed on the full sets, and components are joined.
4. A candidate pair without the pivot lies in the pivot's neighbourhood, the classes of its lists. A neighbourhood whose
   members are in one component needs no more links. Those of the others, which a common passage can make large, are posted again, now under the
   runs of their full sets: of ``n`` runs, the ``n - ceil(n * percent / 100) + 1`` that the fewest members have, in one order
   for all. Two linked sets have at least one of these in common, whatever passage many share. Again each list's smallest
   class meets every other one, pairs between components go the way of step 3, and components are joined.
5. What is left are neighbourhoods of like texts in several components. Members outside the neighbourhood's main component,
   that of most members, are compared with all others of the neighbourhood in blocks of ``BLOCK``, inside a function: collisions
   of all coordinates are counted, pairs of ``MATCHES`` or more that no link connects yet are confirmed on their full sets, and
   only links that join components come out. A block is one row, so there is a row for two blocks that meet, none for a pair
   or for a member, and two blocks of the main component never meet. No candidate is capped or dropped.

Joins that a large group of copies or of like texts makes uneven (rows to classes, postings to their counts, pairs to
pivots) have a written table on the other side, so that Spark can split the large partitions of both. Every step
is written to the shared folder. What grows faster than the input is step 5's work on members of a large neighbourhood that
share a rare run with its pivot but are outside its main component: each meets the neighbourhood once.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing; a row with
a null id is linked with nothing, and has a null component and is kept; rows with one id and different
texts are one document, which links the classes that it is in, and each row has its own set size; repeated rows get equal
results; a very long text is one set like any other, hashed in segments; an empty table gives an empty result; extra
columns, whatever their names, are ignored (:func:`components`) or kept (:func:`keep`, which drops an id with all its rows).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import dropped, mix64, settle, slices, string_buffer, tidy, window_hashes, word_hashes, word_spans, written

K = 64
MATCHES = 32
BLOCK = 256
_STEP = 0x9FB21C651E98DF25
_SALTS = mix64(np.arange(1, 2 * K + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)).astype(np.uint32) | np.uint32(1)


def shingle_hashes(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of all texts of *column*, repeats included, and the n + 1 offsets of each text's."""
    data, offsets = string_buffer(column)
    starts, ends, at = word_spans(data, offsets)
    words = word_hashes(data, starts, ends, seed=7, lower=True)
    runs = window_hashes(words, width, _STEP)
    counts = np.diff(at)
    n = np.maximum(counts - width + 1, np.minimum(counts, 1))
    out_at = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(out_at[-1], dtype=np.uint64)
    position = np.arange(out_at[-1]) - np.repeat(out_at[:-1] - at[:-1], n)  # each run's first word
    long = np.repeat(counts >= width, n)
    out[long] = runs[position[long]]
    for i in np.flatnonzero((counts > 0) & (counts < width)).tolist():  # the whole text, with its length
        h = words[at[i] : at[i + 1]]
        out[out_at[i]] = mix64(window_hashes(h, len(h), _STEP) + np.uint64(len(h) * 0xA24BAED4963EE407 & (1 << 64) - 1))[0]
    return out, out_at


def signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """K coordinates for each text that has runs (others: all zero)."""
    out = np.zeros((len(at) - 1, K), dtype=np.int32)
    some = np.flatnonzero(np.diff(at) > 0)
    if len(some):
        x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
        begin, h = at[some], np.empty_like(x)
        for k in range(K):
            np.multiply(x, _SALTS[2 * k], out=h)
            h ^= h >> np.uint32(15)
            h *= _SALTS[2 * k + 1]
            h ^= h >> np.uint32(16)
            out[some, k] = np.minimum.reduceat(h, begin).view(np.int32)
    return out


def signed(df: DataFrame, width: int, text: str, key: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, two halves of the set's hash, and sig (K 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, at = shingle_hashes(part.column("text"), width)
                sizes, high, low = (np.zeros(part.num_rows, dtype=np.int64) for _ in range(3))
                for i, (b, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    if e > b:
                        own = np.unique(hashes[b:e])
                        sizes[i], high[i] = len(own), np.bitwise_xor.reduce(own).view(np.int64)
                        low[i] = mix64(own + np.uint64(0x8CB92BA72F3D8DD7)).sum().view(np.int64)
                sig = signatures(hashes, at)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * K), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(sizes), pa.array(high), pa.array(low), lists], names=["doc_id", "text_hash", "n_shingles", "high", "low", "sig"])

    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text_hash"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, text_hash long, n_shingles long, high long, low long, sig array<int>")


def postings(classes: DataFrame) -> DataFrame:
    """key, doc: the prefix of each class, without values that only one class has."""
    every = classes.select("doc", F.posexplode("sig")).select("doc", (F.shiftleft(F.col("pos").cast("long"), 32) + F.col("col").cast("long")).alias("key"))
    shared = written(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "nd-keys")
    own = every.join(shared, "key").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("own"))
    # values of one class only come first in the prefix, and meet nobody
    room = F.greatest(F.size("own") - F.lit(MATCHES - 1), F.lit(0))
    return own.where(F.size("own") >= MATCHES).select("doc", F.explode(F.slice("own", F.lit(1), room)).alias("p")).select("p.key", "doc")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of *pairs* (a, b) whose full sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_b"):
                h, at = shingle_hashes(part.column("text_b"), width)
                last, a_set, keep = None, None, []
                ids = part.column("a").to_pylist()
                for i, a in enumerate(ids):
                    if a != last:
                        last, a_set = a, np.unique(shingle_hashes(part.column("text_a").slice(i, 1), width)[0])
                    keep.append(_alike(a_set, np.unique(h[at[i] : at[i + 1]]), percent))
                found = part.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays([found.column("a"), found.column("b")], names=["a", "b"])

    one = texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b").mapInArrow(tidy(run), "a long, b long")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (doc, comp) after joining the components that *links* (a, b: documents) connect.

    Each step maps a component to the smallest one next to it, follows the map once more, and contracts the
    links; it ends when no link is left between two components.
    """
    a, b = (labels.select(F.col("doc").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    edges = written(links.join(a, "a").join(b, "b").where("ca != cb").select(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).distinct(), "nd-edges")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        hook = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("to"))
        again = hook.select(F.col("x").alias("to"), F.col("to").alias("further"))
        jump = written(hook.join(again, "to").select("x", F.col("further").alias("to")), "nd-jump")
        new = written(labels.join(jump, labels.comp == jump.x, "left").select("doc", F.coalesce("to", "comp").alias("comp")), "nd-labels")
        ends = edges.join(jump.toDF("x", "tx"), "x", "left").join(jump.toDF("y", "ty"), "y", "left").select(F.coalesce("tx", "x").alias("x"), F.coalesce("ty", "y").alias("y"))
        left = written(ends.where("x != y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "nd-edges")
        for old in (edges, jump, labels):
            dropped(old)
        edges, labels = left, new
    dropped(edges)
    return labels


def _block_links(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join components, of tasks p, i, j with a row for each of their blocks (b; doc, comp, text; sig: of all members)."""

    def run(key, pdf):
        import pandas as pd

        _, i, j = key
        at = {b: k for k, b in enumerate(pdf["b"].tolist())}
        own = [at[b] for b in dict.fromkeys((i, j)) if b in at]  # a block dealt no member has no row
        if i not in at or j not in at:
            return pd.DataFrame([], columns=["a", "b"], dtype="int64")
        sig = np.concatenate([np.asarray(pdf["sig"].iat[k], dtype=np.int32).reshape(-1, K) for k in own])
        doc, comp, texts = ([x for k in own for x in pdf[c].iat[k]] for c in ("doc", "comp", "text"))
        n = len(pdf["doc"].iat[own[0]])
        left, right = np.arange(n), np.arange(len(doc)) if i == j else np.arange(n, len(doc))
        collisions = np.zeros((len(left), len(right)), dtype=np.uint8)
        for k in range(K):
            collisions += sig[left, k][:, None] == sig[right, k][None, :]
        root, sets = {c: c for c in comp}, {}

        def top(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        def set_of(x):
            if x not in sets:
                sets[x] = np.unique(shingle_hashes(pa.array([texts[x]], pa.large_string()), width)[0])
            return sets[x]

        out = []
        for x, y in zip(*np.nonzero(collisions >= MATCHES), strict=True):
            x, y = int(left[x]), int(right[y])
            cx, cy = top(comp[x]), top(comp[y])
            if cx != cy and _alike(set_of(x), set_of(y), percent):
                root[max(cx, cy)] = min(cx, cy)
                out.append((doc[x], doc[y]))
        settle()
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.groupBy("p", "i", "j").applyInPandas(run, "a long, b long")


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets, as sorted arrays, have a similarity of *percent* or more."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)


def _stars(lists: DataFrame) -> DataFrame:
    """p, doc, collisions: every class of the lists (key, doc) with the smallest class of each of its lists."""
    heads = written(lists.groupBy("key").agg(F.min("doc").alias("p"), F.count("*").alias("n")).where("n > 1").drop("n"), "nd-heads")
    star = written(lists.join(heads, "key").where("doc != p").groupBy("p", "doc").agg(F.count("*").alias("collisions")), "nd-star")
    dropped(heads)
    return star


def _retained(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Those of *pairs* (a, b) that agree on enough coordinates."""
    sa, sb = (sigs.select(F.col("doc").alias(x), F.col("sig").alias(f"s{x}")) for x in "ab")
    matches = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    return pairs.join(sa, "a").join(sb, "b").where(matches >= MATCHES).select("a", "b")


def _unsettled(star: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(p, doc, comp) of all neighbourhoods; (p, main: the component of most members, u: members outside it, m: members) of those not settled."""
    members = written(star.select("p", "doc").join(labels, "doc").select("p", "doc", "comp"), "nd-members")
    each = members.groupBy("p", "comp").agg(F.count("*").alias("n")).groupBy("p").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("m"))
    return members, written(each.where("m > most.n").select("p", F.col("most.comp").alias("main"), (F.col("m") - F.col("most.n")).alias("u"), "m"), "nd-open")


def _rare_runs(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """key, doc: the runs of each set (doc, text) of which it shares one with any set it is linked to, without those of one set only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, at = shingle_hashes(part.column("text"), width)
                own = [np.unique(hashes[b:e]) for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                sizes = np.array([len(x) for x in own], dtype=np.int64)
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(own).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(sizes), keys], names=["doc", "size", "keys"])

    sets = written(texts.select("doc", "text").mapInArrow(tidy(run), "doc long, size long, keys array<long>"), "nd-sets")
    every = sets.select("doc", "size", F.explode("keys").alias("key"))
    shared = written(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "nd-runs")
    own = every.join(shared, "key").groupBy("doc", "size").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("own"))
    # runs of one set only come first in the order
    room = F.size("own") - F.ceil(F.col("size") * percent / 100).cast("int") + 1
    return own.where(room > 0).select("doc", F.explode(F.slice("own", F.lit(1), room)).alias("p")).select("p.key", "doc")


def _tasks(members: DataFrame, open_: DataFrame, sigs: DataFrame, texts: DataFrame) -> DataFrame:
    """p, i, j, b, doc, comp, text, sig: the blocks of each task of the neighbourhoods that aren't settled, a row each."""
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sized = open_.select("p", "main", blocks(F.col("u")).alias("n1"), blocks(F.col("m") - F.col("u")).alias("n0"))
    deal = F.xxhash64("doc")
    block = F.when(F.col("comp") != F.col("main"), F.pmod(deal, F.col("n1"))).otherwise(F.col("n1") + F.pmod(deal, F.greatest("n0", F.lit(1)))).cast("int")
    dealt = members.join(sized, "p").select("p", block.alias("b"), "doc", "comp").join(sigs.select("doc", "sig"), "doc").join(texts, "doc")
    packed = dealt.groupBy("p", "b").agg(F.sort_array(F.collect_list(F.struct("doc", "comp", "text", "sig"))).alias("x"))
    packed = written(packed.select("p", "b", "x.doc", "x.comp", "x.text", F.flatten("x.sig").alias("sig")), "nd-blocks")
    # blocks from n1 on are of the main component and meet only those before
    own = packed.select("p", "b").join(sized, "p")
    others = F.when(F.col("b") < F.col("n1"), F.sequence(F.lit(0), F.col("n1") + F.col("n0") - 1)).otherwise(F.sequence(F.lit(0), F.col("n1") - 1))
    tasks = own.withColumn("other", F.explode(others)).select("p", "b", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"))
    return tasks.join(packed, ["p", "b"])


def _classes(signs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc: number, doc_id: smallest id, text_hash, set hash, sig) of classes; (doc_id, n_shingles, doc) of their rows."""
    some, same_set = signs.where("n_shingles > 0 and doc_id is not null"), ["high", "low", "n_shingles"]
    least = some.groupBy(*same_set).agg(F.min(F.struct("doc_id", "text_hash", "sig")).alias("m"))
    classes = written(least.select(F.monotonically_increasing_id().alias("doc"), *same_set, "m.*"), "nd-classes")
    return classes, written(some.select("doc_id", *same_set).join(classes.select(*same_set, "doc"), same_set).select("doc_id", "n_shingles", "doc"), "nd-rows")


def _links_of_ids(rows: DataFrame) -> DataFrame:
    """Links (a, b) of the classes that one id is in."""
    ids = rows.groupBy("doc_id").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).where("a != z").select("doc_id", "a")
    return rows.select("doc_id", F.col("doc").alias("b")).join(written(ids, "nd-ids"), "doc_id").where("a != b").select("a", "b").distinct()


def components(df: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable, itself included) and kept, for every row of *df*."""
    signs = written(signed(df, width, text, key), "nd-signs")
    classes, rows = _classes(signs)
    lone = written(signs.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles"), "nd-lone")
    dropped(signs)
    lists = written(postings(classes), "nd-lists")
    star = _stars(lists)
    dropped(lists)
    met = star.select("doc").union(star.select("p")).distinct()
    sigs = written(classes.select("doc", "doc_id", "text_hash", "sig").join(met, "doc", "left_semi"), "nd-sigs")
    own = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    # repeated rows are equal here, so any of them will do
    texts = written(own.join(sigs.select("doc_id", "text_hash", "doc"), ["doc_id", "text_hash"]).select("doc", "text").dropDuplicates(["doc"]), "nd-texts")
    pairs = star.select(F.col("p").alias("a"), F.col("doc").alias("b"), "collisions")
    near = _retained(pairs.where(F.col("collisions") < MATCHES), sigs).union(pairs.where(F.col("collisions") >= MATCHES).select("a", "b"))
    links = written(_confirmed(near, texts, width, percent).union(_links_of_ids(rows)), "nd-links")
    labels = merged(written(classes.select("doc", F.col("doc").alias("comp")), "nd-labels"), links)
    dropped(links)
    members, open_ = _unsettled(star, labels)
    dropped(star)
    if not open_.isEmpty():
        left = members.join(open_, "p", "left_semi").select("doc").distinct()
        lists = written(_rare_runs(texts.join(left, "doc", "left_semi"), width, percent), "nd-lists")
        for old in (members, open_):
            dropped(old)
        star = _stars(lists)
        dropped(lists)
        members, open_ = _unsettled(star, labels)
        heads = labels.select(F.col("doc").alias("p"), F.col("comp").alias("other"))
        apart = members.join(heads, "p").where("comp != other").select(F.col("p").alias("a"), F.col("doc").alias("b"))
        links = written(_confirmed(_retained(apart, sigs), texts, width, percent), "nd-links")
        labels = merged(labels, links)
        for old in (links, members, open_):
            dropped(old)
        members, open_ = _unsettled(star, labels)
        dropped(star)
    if not open_.isEmpty():
        links = written(_block_links(_tasks(members, open_, sigs, texts), width, percent), "nd-links")
        labels = merged(labels, links)
        dropped(links)
    named = labels.join(classes.select("doc", "doc_id"), "doc")
    least = written(named.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "nd-least")
    by_class = written(labels.join(least, "comp").select("doc", "component_id"), "nd-components")
    for old in (members, open_, sigs, texts, labels, least, classes):
        dropped(old)
    out = rows.join(by_class, "doc").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(lone.withColumn("component_id", F.col("doc_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep(df: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of *df* whose id is the smallest of its group, with the columns of *df*."""
    gone = components(df, width, percent, text, key).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return df.join(gone, F.col(f"`{key}`") == F.col("__gone"), "left_anti")
