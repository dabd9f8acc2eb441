"""Chunk operators: DataFrames of texts, lists, tables and requests in, DataFrames of chunks out.

Boundaries are searched in an Arrow function that returns an array of structs; everything that can be derived from a
chunk's text (ids, hashes, lengths) is a projection after the explode, so Catalyst prunes what isn't asked for and
pushes filters on document columns down to the scan. No step shuffles.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark import budget
from loomspark.functions import native, tokenizers
from loomspark.functions.tokenizers import WHITE, Spec
from loomspark.operators.spans import Chunker, pack_strings
from loomspark.options import TABLE_STRATEGIES, ChunkingOptions

PIECE = "array<struct<text:string,header_context:string,start_offset:int,end_offset:int,token_count:int>>"
_PIECES = f"struct<pieces:{PIECE},suppressed:int>"
_FIELDS = ("text", "header_context", "start_offset", "end_offset", "token_count")
#: Columns of a chunk. A column of the input that has one of these names is carried along as source_<name>.
CHUNK_COLUMNS = ("chunk_id", "parent_id", "position", "text", "token_count", "character_count", "start_offset", "end_offset", "strategy", "tokenizer_model", "header_context", "labels", "tags", "embeddings", "md5_hash", "sha1_hash", "sha256_hash")
#: Input columns that mean the same for a chunk: a document's parent, labels and tags.
_PASSED_ON = ("parent_id", "labels", "tags")
_VALUE, _FOUND, _PIECE, _GONE = "__loom_value", "__loom_found", "__loom_piece", "__loom_gone"
Piece = tuple[str, str | None, int, int]
#: Texts that a worker holds the pieces of as Python objects at once.
SLICE_ROWS = 256


# inside the worker --------------------------------------------------------------------------------------------


def text_pieces(text: str, ch: Chunker, budget_: int) -> tuple[list[Piece], int]:
    """Pieces of a text, and the least budget that a section has."""
    o = ch.options
    if not o.hierarchy_aware:
        return [(text[a:b], None, a, b) for a, b in ch.chunk(0, len(text), budget_)], budget_
    out, least = [], budget_
    for crumb, a, b in _sections(text, o.header_context_separator):
        own = budget_
        if o.contextualize_headers and crumb:
            own = max(1, budget_ - ch.count_text(crumb + "\n\n"))
            least = min(least, own)
        out += [(text[x:y], crumb, x, y) for x, y in ch.chunk(a, b, own)]
    return out, least


def _sections(text: str, separator: str):
    """(breadcrumb, start, end) of sections with content; header lines belong to none."""
    import re

    header = re.compile(rf"(#{{1,6}})[{WHITE}]+(.+?)[{WHITE}]*#*[{WHITE}]*")
    stack: list[tuple[int, str]] = []
    crumb, first, at, out = None, 0, 0, []

    def close(end: int) -> None:
        body = text[first:end]
        left = len(body) - len(body.lstrip(WHITE))
        kept = body.strip(WHITE)
        if kept:
            out.append((crumb, first + left, first + left + len(kept)))

    for line in text.split("\n"):
        m = header.fullmatch(line.removesuffix("\r"))
        if m:
            close(at)
            stack = [x for x in stack if x[0] < len(m[1])] + [(len(m[1]), m[2])]
            crumb = separator.join(t for _, t in stack if t.strip(WHITE)) or None
            first = at + len(line) + 1
        at += len(line) + 1
    close(len(text))
    return out


def list_pieces(items: list[str | None], ordered: bool, ch_of: Callable[[str], Chunker], o: ChunkingOptions, budget_: int, count) -> list[str]:
    if not items:
        return []
    window = lambda s: _window_texts(ch_of(s), budget_)
    texts = [x or "" for x in items]
    if o.strategy == "ListEntry":
        return [y for x in texts if x.strip(WHITE) for y in ([x] if count(x) <= budget_ else window(x))]
    rows = [f"{i}. {x}" if ordered else f"- {x}" for i, x in enumerate(texts, 1)]
    whole = "\n".join(rows)
    if o.strategy == "WholeList":
        return [whole] if count(whole) <= budget_ else pack_strings(rows, "\n", budget_, count, window)
    ch = ch_of(whole)
    return [whole[a:b] for a, b in ch.chunk(0, len(whole), budget_)]


def _window_texts(ch: Chunker, limit: int) -> list[str]:
    return [ch.text[a:b] for a, b in ch.window(0, len(ch.text), limit)]


def table_pieces(rows: list[list[str | None]], ch_of: Callable[[str], Chunker], o: ChunkingOptions, budget_: int, count) -> list[str]:
    grid = [[c or "" for c in r or []] for r in rows or []]
    if o.strategy not in TABLE_STRATEGIES:
        whole = "\n".join(" | ".join(r) for r in grid)
        ch = ch_of(whole)
        return [whole[a:b] for a, b in ch.chunk(0, len(whole), budget_)]
    if len(grid) <= 1:
        return []
    head, data = grid[0], grid[1:]
    window = lambda s: _window_texts(ch_of(s), budget_)
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|") for c in r) + " |"
    table = lambda some: "\n".join([line(head), "|" + "|".join("---" for _ in head) + "|", *map(line, some)])
    pairs = lambda r: [f"{h}: {v}" for h, v in zip(head, r, strict=False)]
    cells = lambda items, sep: pack_strings(items, sep, budget_, count, window)
    fits = lambda s: count(s) <= budget_

    def with_headers(r: list[str]) -> list[str]:
        s = table([r])
        return [s] if fits(s) else cells(pairs(r), ", ")

    def grouped() -> list[str]:
        out = []
        for i in range(0, len(data), o.row_group_size):
            group = data[i : i + o.row_group_size]
            s = table(group)
            out += [s] if fits(s) else [x for r in group for x in with_headers(r)]
        return out

    match o.strategy:
        case "Row":
            return [x for r in data for x in ([" ".join(r)] if fits(" ".join(r)) else cells(r, " "))]
        case "RowWithHeaders":
            return [x for r in data for x in with_headers(r)]
        case "KeyValuePairs":
            return [x for r in data for x in ([", ".join(pairs(r))] if fits(", ".join(pairs(r))) else cells(pairs(r), ", "))]
        case "WholeTable" if fits(table(data)):
            return [table(data)]
    return grouped()


def finished(pieces: list[Piece], o: ChunkingOptions, count, budget_: int, source: str | None) -> tuple[list[Piece], int]:
    """Trims, drops pieces inside the one before, then drops or merges small ones. Also the number dropped as contained."""
    if o.trim_whitespace:
        trimmed = []
        for text, head, a, b in pieces:
            s = text.strip(WHITE)
            if not s:
                continue
            if len(s) != len(text) and count(s) > count(text):
                s = text  # a leading space can be part of one token
            elif a >= 0:
                a += len(text) - len(text.lstrip(WHITE))
                b = a + len(s)
            trimmed.append((s, head, a, b))
        pieces = trimmed
    kept: list[Piece] = []
    for p in pieces:
        if kept and p[2] >= 0 and kept[-1][2] >= 0 and kept[-1][2] <= p[2] and p[3] <= kept[-1][3]:
            continue
        kept.append(p)
    gone = len(pieces) - len(kept)
    if not kept or not o.min_chunk_tokens or o.small_chunk_mode == "Keep":
        return kept, gone
    small = lambda p: count(p[0]) < o.min_chunk_tokens
    if o.small_chunk_mode == "Drop":
        return [p for p in kept if not small(p)], gone

    def joined(x: Piece, y: Piece) -> Piece | None:
        both = _bridged(x, y, source) or (f"{x[0]}\n{y[0]}", x[1], -1, -1)
        return both if count(both[0]) <= budget_ else None

    return _folded(kept, small, joined), gone


def _bridged(x: Piece, y: Piece, source: str | None) -> Piece | None:
    """The source from *x* to the end of *y*, if only white space lies between two pieces of one section."""
    (_, crumb, a, b), (_, other, c, d) = x, y
    if source is None or crumb != other or a < 0 or not (a <= c and b <= d) or source[b:c].strip(WHITE):
        return None
    return source[a:d], crumb, a, d


def _folded(pieces: list[Piece], small: Callable[[Piece], bool], joined: Callable[[Piece, Piece], Piece | None]) -> list[Piece]:
    """The open piece takes in the next one while it is small and both fit; one left small at the end joins the last closed."""
    closed, open_ = [], pieces[0]
    for p in pieces[1:]:
        both = joined(open_, p) if small(open_) else None
        if both is None:
            closed.append(open_)
        open_ = both or p
    if closed and small(open_) and (both := joined(closed[-1], open_)):
        return [*closed[:-1], both]
    return [*closed, open_]


@lru_cache(maxsize=8)
def _memo(spec: Spec) -> dict[str, int]:
    """Counts of short strings, which all options under a tokenizer share."""
    return {}


@lru_cache(maxsize=32)
def _worker(spec: Spec, o: ChunkingOptions, working: int, kind: str):
    """A function of one value (text, (items, ordered) or rows) to its pieces and the number suppressed, as a dictionary.

    Its attribute ``rows`` gives tuples of the fields of PIECE instead. Kept in the Python worker, so the memo of
    counts serves all batches and tasks that it runs.
    """
    tok, memo = spec.build(), _memo(spec)
    ch_of = lambda s: Chunker(s, tok, o, memo)
    count = ch_of("").count_text
    prefix = o.context_prefix or ""

    def rows(value, ordered=False):
        if value is None or (kind == "text" and not value):
            return [], 0
        source, least, ch = None, working, None
        if kind == "text":
            source, ch = value, ch_of(value)
            pieces, least = text_pieces(value, ch, working)
        elif kind == "list":
            pieces = [(s, None, -1, -1) for s in list_pieces(list(value), bool(ordered), ch_of, o, working, count)]
        else:
            pieces = [(s, None, -1, -1) for s in table_pieces([list(r) if r is not None else [] for r in value], ch_of, o, working, count)]
        pieces, gone = finished(pieces, o, count, least, source)
        out = []
        for text, head, a, b in pieces:
            final = text
            if o.contextualize_headers and head:
                final = head + "\n\n" + final
            if prefix:
                final = prefix + final
            n = 0
            if o.compute_token_counts:
                n = ch.count(a, b) if ch and final is text and a >= 0 else count(final)
            if final is not text or not o.compute_offsets:
                a = b = -1
            out.append((final, head, a, b, n))
        return out, gone

    def run(value, ordered=False):
        found, gone = rows(value, ordered)
        return {"pieces": [dict(zip(_FIELDS, p, strict=True)) for p in found], "suppressed": gone}

    run.rows = rows
    return run


def _arrow(found: list[tuple[list[tuple], int]]):
    """The rows of *_worker(...).rows* as an Arrow array of type _PIECES, built from flat columns."""
    flat = [p for pieces, _ in found for p in pieces]
    columns = zip(*flat, strict=True) if flat else [()] * len(_FIELDS)
    piece = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=list(_FIELDS))
    offsets = pa.array([0, *accumulate(len(pieces) for pieces, _ in found)], pa.int32())
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, piece), pa.array([gone for _, gone in found], pa.int32())], names=["pieces", "suppressed"])


# DataFrame operators ------------------------------------------------------------------------------------------


def _resolved(o: ChunkingOptions, spec: Spec | None, registry, probe) -> tuple[budget.Profile, Spec, int]:
    """Profile, tokenizer and working budget, on the driver, once."""
    o = o or ChunkingOptions()
    probe_tok = spec.build() if spec and probe else None
    profile = budget.resolve(o, registry, probe, probe_tok)
    spec = spec or tokenizers.for_profile(profile.kind)
    return profile, spec, budget.working_budget(o, profile, spec.build().count)


def guarded(c: Column, size: Column, o: ChunkingOptions) -> Column:
    """*c*, or an error for an input over the size limit."""
    if not o.max_input_characters:
        return c
    return F.when(size > o.max_input_characters, F.raise_error(F.concat(F.lit("InvalidChunkingOptions: the input has "), size.cast("string"), F.lit(f" characters; the limit is {o.max_input_characters}")))).otherwise(c)


def over_limit_skipped(c: Column, size: Column, o: ChunkingOptions) -> Column:
    """*c*, or null for an input over the size limit."""
    return F.when(size <= o.max_input_characters, c) if o.max_input_characters else c


def over_limit(df: DataFrame, options: ChunkingOptions | None = None, text: str = "text") -> DataFrame:
    """The report to oversize="skip": rows of *df* whose text is over the size limit, with its size."""
    o, size = options or ChunkingOptions(), F.length(text)
    kept = df.drop(text).columns
    return df.where(size > o.max_input_characters if o.max_input_characters else F.lit(False)).select(*[f"`{c}`" for c in kept], size.alias("input_character_count"))


def _carried(df: DataFrame, value: str) -> DataFrame:
    """*df* with the column to chunk under an inner name, and columns with names of the chunk schema as source_<name>."""
    taken = {*df.columns, *CHUNK_COLUMNS}
    renamed = {value: _VALUE}
    for c in df.columns:
        if c in CHUNK_COLUMNS and c not in _PASSED_ON and c != value:
            new = f"source_{c}"
            while new in taken:
                new = f"source_{new}"
            taken.add(new)
            renamed[c] = new
    return df.withColumnsRenamed(renamed)


def _chunks(df: DataFrame, found: Column, o: ChunkingOptions, profile: budget.Profile, keys: list[str], observe: str | None) -> DataFrame:
    """One row a chunk, with the columns of the chunk schema after the document's own."""
    parents = [F.lit(o.parent_id)] if o.parent_id else []
    parents += [F.col("parent_id")] if "parent_id" in df.columns else []
    carried = [f"`{c}`" for c in df.columns if c not in (*_PASSED_ON, _VALUE)]
    rows = df.withColumn(_FOUND, found)
    passed = [c for c in _PASSED_ON if c in df.columns]
    exploded = rows.select(*carried, *passed, F.col(f"{_FOUND}.suppressed").alias(_GONE), F.posexplode(f"{_FOUND}.pieces").alias("position", _PIECE))
    tokens, text = F.col(f"{_PIECE}.token_count"), F.col(f"{_PIECE}.text")
    if observe:
        exploded = exploded.observe(observe, F.count("*").alias("chunks_produced"), F.sum(tokens).alias("chunk_tokens"), F.sum(F.when(F.col("position") == 0, F.col(_GONE))).alias("chunks_suppressed"), *_histogram(tokens))
    return exploded.select(
        *carried,
        native.chunk_id(*[F.col(f"`{k}`") for k in keys], F.col("position"), text).alias("chunk_id"),
        (F.coalesce(*parents) if parents else F.lit(None)).cast("string").alias("parent_id"),
        "position",
        text.alias("text"),
        tokens.alias("token_count"),
        F.length(text).alias("character_count"),
        F.col(f"{_PIECE}.start_offset").alias("start_offset"),
        F.col(f"{_PIECE}.end_offset").alias("end_offset"),
        F.lit(o.strategy).alias("strategy"),
        F.lit(profile.model).alias("tokenizer_model"),
        F.col(f"{_PIECE}.header_context").alias("header_context"),
        *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in (("labels", "array<string>"), ("tags", "map<string,string>"))],
        F.array().cast("array<float>").alias("embeddings"),
        *[(h if o.compute_hashes else F.lit(None).cast("binary")).alias(n) for n, h in native.hashes(text).items()],
    )


#: Upper bounds of the buckets of token counts; one more bucket is open.
HISTOGRAM = (16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192)


def _histogram(tokens: Column) -> list[Column]:
    """Chunks in each bucket of token counts, as aggregates tokens_le_16, ..., tokens_more."""
    bounds = list(zip((None, *HISTOGRAM), (*HISTOGRAM, None), strict=True))
    inside = lambda lo, hi: F.lit(True) & (F.lit(True) if lo is None else tokens > lo) & (F.lit(True) if hi is None else tokens <= hi)
    return [F.count(F.when(inside(lo, hi), 1)).alias(f"tokens_le_{hi}" if hi else "tokens_more") for lo, hi in bounds]


def token_histogram(chunks: DataFrame) -> DataFrame:
    """upper_bound (null for the open bucket) and n_chunks of every bucket of token counts, empty ones too."""
    row = chunks.agg(*_histogram(F.col("token_count")))
    return row.select(F.explode(F.array(*[F.struct(F.lit(hi).cast("int").alias("upper_bound"), F.col(f"tokens_le_{hi}" if hi else "tokens_more").alias("n_chunks")) for hi in (*HISTOGRAM, None)])).alias("b")).select("b.*")


def _search(value: Column, ordered: Column | None, kind: str, o: ChunkingOptions, spec: Spec, working: int) -> Column:
    """The pieces of each value and the number suppressed, by an Arrow function."""
    if ordered is None:

        @F.arrow_udf(_PIECES)
        def search(values: pa.Array) -> pa.Array:
            rows = _worker(spec, o, working, kind).rows
            # in slices, so that a batch of large texts never stands as Python objects at once
            return pa.concat_arrays([_arrow([rows(v) for v in values.slice(i, SLICE_ROWS).to_pylist()]) for i in range(0, max(1, len(values)), SLICE_ROWS)])

        return search(value)

    @F.arrow_udf(_PIECES)
    def search_ordered(values: pa.Array, flags: pa.Array) -> pa.Array:
        rows = _worker(spec, o, working, kind).rows
        return _arrow([rows(v, f) for v, f in zip(values.to_pylist(), flags.to_pylist(), strict=True)])

    return search_ordered(value, ordered)


def _run(df: DataFrame, source: str, size: Callable[[Column], Column], kind: str, o: ChunkingOptions, spec, registry, probe, keys, observe, ordered: bool | str | None = None, oversize: str = "raise"):
    """Chunks of the column *source*. *size* gives the characters of a value, for the size guard."""
    profile, spec, working = _resolved(o, spec, registry, probe)
    keys = keys or [c for c in df.columns if c != source][:1]
    inner = _carried(df, source)
    names = dict(zip(df.columns, inner.columns, strict=True))
    value = F.col(_VALUE)
    value = over_limit_skipped(value, size(value), o) if oversize == "skip" else guarded(value, size(value), o)
    flag = F.col(f"`{names[ordered]}`") if isinstance(ordered, str) else None if ordered is None else F.lit(ordered)
    return _chunks(inner, _search(value, flag, kind, o, spec, working), o, profile, [names[k] for k in keys], observe)


def searched(text: Column, options: ChunkingOptions, tokenizer: Spec | None = None, registry=budget.KNOWN_MODELS) -> Column:
    """The pieces of a text column under *options*, as an array of structs, for plans that chunk a row in several ways."""
    o = options.but(input_type="Text")
    _, spec, working = _resolved(o, tokenizer, registry, None)
    return _search(guarded(text, F.length(text), o), None, "text", o, spec, working)["pieces"]


def searched_under(text: Column, options: list[ChunkingOptions], tokenizer: Spec | None = None, registry=budget.KNOWN_MODELS) -> Column:
    """Places and counts of the pieces of a text column under each of *options*, as an array of arrays, by one function.

    A text over the least of the size limits is an error.
    """
    options = [o.but(input_type="Text") for o in options]
    resolved = [_resolved(o, tokenizer, registry, None)[1:] for o in options]

    @F.arrow_udf("array<array<struct<start_offset:int,end_offset:int,token_count:int>>>")
    def search(values: pa.Array) -> pa.Array:
        runs = [_worker(spec, o, working, "text").rows for o, (spec, working) in zip(options, resolved, strict=True)]
        edges, columns = array("i", [0]), (array("i"), array("i"), array("i"))
        for value in values:
            v = value.as_py()  # one object, so its cut serves all options
            for run in runs:
                for p in run(v)[0]:
                    for column, x in zip(columns, p[2:], strict=True):
                        column.append(x)
                edges.append(len(columns[0]))
        piece = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], names=list(_FIELDS[2:]))
        lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), piece)
        return pa.ListArray.from_arrays(pa.array(range(0, len(values) * len(runs) + 1, len(runs)), pa.int32()), lists)

    limited = [o for o in options if o.max_input_characters]
    # one guard: nested ones would repeat the column in each other
    return search(guarded(text, F.length(text), min(limited, key=lambda o: o.max_input_characters)) if limited else text)


_ITEMS = lambda c: F.aggregate(F.coalesce(c, F.array().cast("array<string>")), F.lit(0), lambda a, x: a + F.length(F.coalesce(x, F.lit(""))))
_CELLS = lambda c: _ITEMS(F.flatten(F.transform(F.coalesce(c, F.array().cast("array<array<string>>")), lambda r: F.coalesce(r, F.array().cast("array<string>")))))


def chunk_text(df: DataFrame, options: ChunkingOptions | None = None, text: str = "text", tokenizer: Spec | None = None, keys: list[str] | None = None, registry=budget.KNOWN_MODELS, probe=None, observe: str | None = None, oversize: str = "raise") -> DataFrame:
    """Chunks of a text column. A null or empty text has none. Other columns are carried along; *text* becomes the chunk's.

    Columns whose names a chunk has itself come out as source_<name>, but parent_id, labels and tags are passed on.
    A text over the size limit is an error, or with oversize="skip" has no chunks; :func:`over_limit` reports those.
    """
    return _run(df, text, F.length, "text", (options or ChunkingOptions()).but(input_type="Text"), tokenizer, registry, probe, keys, observe, None, oversize)


def chunk_list(df: DataFrame, options: ChunkingOptions | None = None, items: str = "items", ordered: bool | str = False, tokenizer: Spec | None = None, keys: list[str] | None = None, registry=budget.KNOWN_MODELS, probe=None, observe: str | None = None, oversize: str = "raise") -> DataFrame:
    """Chunks of a list column. *ordered* is a flag or the name of a column of flags."""
    return _run(df, items, _ITEMS, "list", (options or ChunkingOptions()).but(input_type="List"), tokenizer, registry, probe, keys, observe, ordered, oversize)


def chunk_table(df: DataFrame, options: ChunkingOptions | None = None, rows: str = "rows", tokenizer: Spec | None = None, keys: list[str] | None = None, registry=budget.KNOWN_MODELS, probe=None, observe: str | None = None, coerce: bool = True, oversize: str = "raise") -> DataFrame:
    """Chunks of a column of tables (array of rows, the first being the header). Strategies that aren't for tables become RowWithHeaders."""
    o = (options or ChunkingOptions()).but(input_type="Table")
    if coerce and o.strategy not in TABLE_STRATEGIES:
        o = o.but(strategy="RowWithHeaders")
    return _run(df, rows, _CELLS, "table", o, tokenizer, registry, probe, keys, observe, None, oversize)


def chunk_requests(df: DataFrame, options: ChunkingOptions | None = None, tokenizer: Spec | None = None, registry=budget.KNOWN_MODELS, probe=None) -> DataFrame:
    """Chunks of request nodes: request_id, parent_id, path, type, text, items, ordered, rows, labels, tags.

    Positions restart for each node; order by path and position for the depth-first order of a tree. Lists and tables
    keep their strategy if it suits them, and are run as text if not; labels and tags are the node's own.
    """
    o = options or ChunkingOptions()
    cols = ["request_id", "parent_id", "path", "labels", "tags"]
    kind = F.when((F.col("type") == "List") & F.col("items").isNotNull(), "list").when((F.col("type") == "Table") & F.col("rows").isNotNull(), "table").otherwise("text")
    typed = df.withColumn("_kind", kind)
    drop_kind = lambda x: x.drop("_kind")
    texts = chunk_text(typed.where("_kind = 'text'").select(*cols, "text"), o, "text", tokenizer, ["request_id"], registry, probe)
    lists = chunk_list(drop_kind(typed.where("_kind = 'list'").select(*cols, "items", F.coalesce("ordered", F.lit(False)).alias("ordered"))), o, "items", "ordered", tokenizer, ["request_id"], registry, probe).drop("ordered")
    tables = chunk_table(typed.where("_kind = 'table'").select(*cols, "rows"), o, "rows", tokenizer, ["request_id"], registry, probe, coerce=False)
    return texts.unionByName(lists).unionByName(tables)


def chunk_to_list(df: DataFrame, options: ChunkingOptions | None = None, **more) -> list:
    """The chunks of a (small) DataFrame of texts, in order, as rows on the driver."""
    first = [c for c in df.columns if c != more.get("text", "text")][:1]
    return chunk_text(df, options, **more).orderBy(*first, "position").collect()


def _reported(rows: DataFrame, key: str, options: ChunkingOptions, registry) -> DataFrame:
    profile = budget.resolve(options, registry)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.select(
        key,
        F.lit(profile.kind).alias("tokenizer_kind"),
        F.lit(profile.model).alias("tokenizer_model"),
        F.lit(profile.source).alias("profile_source"),
        F.lit(budget.chunk_budget(options, profile)).alias("effective_token_budget"),
        F.lit(options.strategy).alias("strategy"),
        zero("chunk_count"),
        zero("total_tokens"),
        zero("max_chunk_tokens"),
        "input_character_count",
    )


def diagnostics(df: DataFrame, chunks: DataFrame, options: ChunkingOptions, key: str = "doc_id", text: str = "text", registry=budget.KNOWN_MODELS) -> DataFrame:
    """One row a document, from a table of chunks that exists: counts and sums beside the resolved profile."""
    sums = chunks.groupBy(key).agg(F.count("*").alias("chunk_count"), F.sum("token_count").alias("total_tokens"), F.max("token_count").alias("max_chunk_tokens"))
    joined = df.select(key, F.length(F.coalesce(F.col(text), F.lit(""))).alias("input_character_count")).join(sums, key, "left")
    return _reported(joined, key, options, registry)


def document_diagnostics(df: DataFrame, options: ChunkingOptions | None = None, key: str = "doc_id", text: str = "text", tokenizer: Spec | None = None, registry=budget.KNOWN_MODELS) -> DataFrame:
    """The same without a shuffle: a document's chunks are counted in the row that holds them. Without chunks, zeros."""
    o = options or ChunkingOptions()
    rows = df.select(key, F.col(text).alias(_VALUE))
    found = rows.withColumn(_FOUND, searched(F.col(_VALUE), o, tokenizer, registry))
    counts = F.col(f"{_FOUND}.token_count")
    sums = found.select(key, F.length(F.coalesce(F.col(_VALUE), F.lit(""))).alias("input_character_count"), F.size(counts).alias("chunk_count"), F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x).alias("total_tokens"), F.array_max(counts).alias("max_chunk_tokens"))
    return _reported(sums, key, o, registry)


def chunk_to_result(df: DataFrame, options: ChunkingOptions | None = None, key: str = "doc_id", **more) -> tuple[DataFrame, DataFrame]:
    """(chunks, diagnostics), neither with a shuffle."""
    o = options or ChunkingOptions()
    return chunk_text(df, o, keys=[key], **more), document_diagnostics(df, o, key, **more)


def summary(chunks: DataFrame) -> DataFrame:
    """count, total, mean and maximum of tokens over all chunks."""
    return chunks.agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_tokens"), F.coalesce(F.avg("token_count"), F.lit(0.0)).alias("mean_tokens"), F.coalesce(F.max("token_count"), F.lit(0)).alias("max_tokens"))


def token_counts(text: Column, tokenizer: Spec) -> Column:
    """Tokens of each text (0 for null)."""

    @F.arrow_udf("int")
    def counted(values: pa.Array) -> pa.Array:
        count = tokenizer.build().count
        return pa.array([count(v) for v in values.to_pylist()], pa.int32())

    return counted(text)


def preview(chunks: DataFrame, key: str = "doc_id", width: int = 56) -> DataFrame:
    """key, position, tokens, offsets and the first characters of each chunk on one line, in order."""
    line = F.regexp_replace("text", r"\s+", " ")
    short = F.when(F.length(line) > width, F.concat(F.substring(line, 1, width - 1), F.lit("…"))).otherwise(line)
    return chunks.select(key, "position", "token_count", "start_offset", "end_offset", short.alias("preview")).orderBy(key, "position")
