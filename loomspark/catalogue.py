"""The registered queries of the chunking engine and their SQL equivalents.

Where SQL can't find boundaries (byte-pair tokenizers, recursion), a query returns the integrity counts of the chunks of
every document, which must be zero: its SQL states that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark import budget
from loomspark.functions import native, tokenizers
from loomspark.operators import chunk, evaluation, integrity, requests
from loomspark.options import ChunkingOptions
from loomspark.plans import contract
from loomspark.plans import sql as sql_plans
from loomspark.sources import ingestion

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
WORD = tokenizers.WORD
_LATIN_SPACE = r"[ \t\n\r\f\x0B]+"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each conversation, its turns being paragraphs."""
    c = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return c.select(F.col("conv_id").alias("doc_id"), F.array_join(F.transform("t", lambda x: F.concat_ws(": ", x["role"], x["text"])), "\n\n").alias("text"))


_CONV_SQL = "SELECT conv_id AS doc_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id"


# fixed windows ------------------------------------------------------------------------------------------------

_WORDS_SQL = r"SELECT doc_id, regexp_extract_all(text, '[^\s]+') AS w FROM documents"


def _window_sql(size: int, overlap: int) -> str:
    stride = max(1, size - overlap)
    return f"""WITH d AS ({_WORDS_SQL}), p AS (SELECT doc_id, w, unnest(range(0, 1 + ceil(greatest(0, len(w) - {size}) / {stride})::BIGINT)) AS p FROM d WHERE len(w) > 0)
SELECT doc_id, p::INT AS position, array_to_string(w[p * {stride} + 1 : p * {stride} + {size}], ' ') AS text, len(w[p * {stride} + 1 : p * {stride} + {size}])::INT AS token_count FROM p"""


def _flat(c: DataFrame) -> DataFrame:
    return c.select("doc_id", "position", F.regexp_replace("text", _LATIN_SPACE, " ").alias("text"), "token_count")


def _fixed(size: int, **overlap):
    return lambda spark, sf_dir: _flat(chunk.chunk_text(_docs(spark, sf_dir), ChunkingOptions(max_tokens=size, **overlap), tokenizer=WORD))


for _name, _size, _over, _n in (("fixed_window_words", 64, {"overlap_count": 16}, 16), ("fixed_window_no_overlap", 64, {}, 0), ("fixed_window_percentage", 100, {"overlap_percentage": 0.25}, 25), ("fixed_window_wide_overlap", 256, {"overlap_count": 32}, 32)):
    QUERIES[_name] = _fixed(_size, **_over)
    ORACLE_SQL[_name] = _window_sql(_size, _n)


@query(_window_sql(64, 16))
def fixed_window_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows without Python: closed form in Catalyst."""
    w = native.word_windows(_docs(spark, sf_dir), 64, 16)
    return w.select("doc_id", "position", F.array_join("words", " ").alias("text"), F.size("words").alias("token_count"))


@query(_window_sql(64, 16))
def sql_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows by the SQL table function."""
    sql_plans.register(spark)
    _docs(spark, sf_dir).createOrReplaceTempView("loom_docs")
    options = '{"maxTokens": 64, "overlapCount": 16}'
    return spark.sql(f"SELECT doc_id, position, regexp_replace(c.text, '[ \\\\t\\\\n\\\\r]+', ' ') AS text, token_count FROM loom_docs d, LATERAL chunk_text(d.text, '{options}') c")


@query(
    f"""WITH d AS ({_WORDS_SQL}), s AS (SELECT doc_id, text FROM documents), p AS (SELECT doc_id, w, unnest(range(0, 1 + ceil(greatest(0, len(w) - 64) / 64)::BIGINT)) AS p FROM d WHERE len(w) > 0),
o AS (SELECT doc_id, w, p, s.text, regexp_extract_all(s.text, '\\s+|[^\\s]+') AS parts FROM p JOIN s USING (doc_id))
SELECT doc_id, p::INT AS position, true AS exact FROM o"""
)
def exact_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk is the source at its offsets."""
    docs = _docs(spark, sf_dir)
    c = chunk.chunk_text(docs.withColumn("src", F.col("text")), ChunkingOptions(max_tokens=64), tokenizer=WORD, keys=["doc_id"])
    return c.select("doc_id", "position", (F.substring(F.col("src"), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset")) == F.col("text")).alias("exact"))


# splits -------------------------------------------------------------------------------------------------------

_SENT = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


@query(rf"WITH s AS (SELECT doc_id, list_filter(list_transform({_SENT}, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents) SELECT doc_id, unnest(s) AS text, unnest(range(0, len(s)))::INT AS position FROM s")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(native.sentences(F.col("text"))).alias("position", "text"))


@query(rf"WITH d AS ({_CONV_SQL}), s AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM d) SELECT doc_id, unnest(s) AS text, unnest(range(0, len(s)))::INT AS position FROM s")
def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("doc_id", F.posexplode(native.paragraphs(F.col("text"))).alias("position", "text"))


@query(r"WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents) SELECT doc_id, unnest(s) AS text, unnest(range(0, len(s)))::INT AS position FROM s")
def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(native.lines(F.col("text"))).alias("position", "text"))


@query(r"WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[,;] |\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents) SELECT doc_id, unnest(s) AS text, unnest(range(0, len(s)))::INT AS position FROM s")
def regex_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each segment between matches; the budget is wide enough for every segment."""
    o = ChunkingOptions(strategy="RegexBased", regex_pattern=r"[,;] |\n", max_tokens=1_000_000, effective_input_budget=1_000_000, model_id="wide")
    wide = budget.with_known_model("wide", budget.Entry("Cl100kBase", "wide", 1_000_000))
    return chunk.chunk_text(_docs(spark, sf_dir), o, tokenizer=WORD, registry=wide).select("doc_id", "position", "text")


def _pack_sql(unit_rows: str, limit: int) -> str:
    """Greedy packing of units (doc_id, pos, n words) and evening out of the last two chunks."""
    return f"""WITH RECURSIVE u AS ({unit_rows}),
g(doc_id, pos, n, acc, ch) AS (SELECT doc_id, pos, n, n, 0 FROM u WHERE pos = 0
  UNION ALL SELECT u.doc_id, u.pos, u.n, CASE WHEN g.acc + u.n <= {limit} THEN g.acc + u.n ELSE u.n END, CASE WHEN g.acc + u.n <= {limit} THEN g.ch ELSE g.ch + 1 END FROM g JOIN u ON u.doc_id = g.doc_id AND u.pos = g.pos + 1),
m AS (SELECT doc_id, max(ch) AS mx FROM g GROUP BY doc_id),
t AS (SELECT g.doc_id, g.pos, g.n, g.ch, m.mx, sum(CASE WHEN g.ch = m.mx THEN g.n END) OVER w AS tail, sum(CASE WHEN g.ch = m.mx - 1 THEN g.n END) OVER w AS prev,
  min(CASE WHEN g.ch = m.mx - 1 THEN g.pos END) OVER w AS first, min(CASE WHEN g.ch = m.mx THEN g.pos END) OVER w AS cut FROM g JOIN m USING (doc_id) WINDOW w AS (PARTITION BY g.doc_id)),
c AS (SELECT t.doc_id, t.pos AS p, sum(x.n) FILTER (x.pos < t.pos) AS l, sum(x.n) FILTER (x.pos >= t.pos) AS r, any_value(greatest(t.prev, t.tail)) AS now
  FROM t JOIN t x ON x.doc_id = t.doc_id AND x.ch >= x.mx - 1 WHERE t.mx >= 1 AND t.tail * 4 < {limit} AND t.ch >= t.mx - 1 AND t.pos > t.first AND t.pos <= t.cut GROUP BY t.doc_id, t.pos),
b AS (SELECT doc_id, arg_min(p, (greatest(l, r), -p)) AS p FROM c WHERE l <= {limit} AND r <= {limit} AND greatest(l, r) < now GROUP BY doc_id),
f AS (SELECT t.doc_id, t.n, CASE WHEN b.p IS NULL OR t.ch < t.mx - 1 THEN t.ch WHEN t.pos < b.p THEN t.mx - 1 ELSE t.mx END AS position FROM t LEFT JOIN b USING (doc_id))
SELECT doc_id, position::INT AS position, sum(n)::INT AS token_count FROM f GROUP BY doc_id, position"""


_SENT_UNITS = rf"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, len(regexp_extract_all(s, '[^\s]+'))::INT AS n FROM (SELECT doc_id, unnest({_SENT}) AS s, unnest(range(0, len({_SENT}))) AS i FROM documents) WHERE regexp_matches(s, '[^\s]')"


def _stretched_sql(units: str, limit: int) -> str:
    """Packing of units (doc_id, grp, pos, n): neighbours of one group that fit make a stretch, packed by itself; longer ones become windows."""
    return f"""WITH un AS ({units}), b AS (SELECT *, n > {limit} AS long, lag(n > {limit}) OVER w AS before, lag(grp) OVER w AS grp0 FROM un WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
k AS (SELECT *, sum(CASE WHEN long OR before OR grp <> grp0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS st FROM b),
sh AS (SELECT struct_pack(d := doc_id, s := st) AS doc_id, (row_number() OVER (PARTITION BY doc_id, st ORDER BY pos) - 1)::INT AS pos, n FROM k WHERE NOT long),
pk AS ({_pack_sql("SELECT * FROM sh", limit)}),
wi AS (SELECT doc_id, st, n // {limit} AS f, n % {limit} AS r FROM k WHERE long),
wl AS (SELECT doc_id, st, CASE WHEN r = 0 THEN list_transform(range(0, f), lambda i: {limit})
  WHEN r * 4 < {limit} THEN list_concat(list_transform(range(0, f - 1), lambda i: {limit}), [({limit} + r + 1) // 2, ({limit} + r) // 2])
  ELSE list_append(list_transform(range(0, f), lambda i: {limit}), r) END AS l FROM wi),
al AS (SELECT doc_id.d AS doc_id, doc_id.s AS st, position AS ch, token_count FROM pk UNION ALL SELECT doc_id, st, unnest(range(0, len(l)))::INT, unnest(l)::INT FROM wl)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY st, ch) - 1)::INT AS position, token_count FROM al"""


_N_WORDS = r"len(regexp_extract_all({}, '[^\s]+'))::INT"
_LINE_UNITS = f"SELECT doc_id, 0 AS grp, i AS pos, {_N_WORDS.format('x')} AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents) WHERE regexp_matches(x, '[^\\s]')"


@query(_stretched_sql(f"SELECT doc_id, 0 AS grp, pos, n FROM ({_SENT_UNITS})", 64))
def sentence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences packed into chunks of up to 64 words; longer sentences are cut into windows."""
    o = ChunkingOptions(strategy="SentenceBased", max_tokens=64)
    return chunk.chunk_text(_docs(spark, sf_dir), o, tokenizer=WORD).select("doc_id", "position", "token_count")


@query(_stretched_sql(_LINE_UNITS, 48))
def line_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed into chunks of up to 48 words; longer lines are cut into windows."""
    return chunk.chunk_text(_docs(spark, sf_dir), ChunkingOptions(strategy="ListEntry", max_tokens=48), tokenizer=WORD).select("doc_id", "position", "token_count")


def _two_levels_sql(limit: int) -> str:
    """Lines that fit are units; of longer ones, the parts between '. ' are, each line being a group of its own."""
    return f"""SELECT doc_id, grp, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS pos, {_N_WORDS.format("s")} AS n FROM (
SELECT doc_id, i, CASE WHEN {_N_WORDS.format("x")} > {limit} THEN i ELSE -1 END AS grp, unnest(p) AS s, unnest(range(0, len(p))) AS j FROM (
SELECT doc_id, i, x, CASE WHEN {_N_WORDS.format("x")} > {limit} THEN string_split(replace(x, '. ', '.' || chr(1)), chr(1)) ELSE [x] END AS p FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)))
WHERE regexp_matches(s, '[^\\s]') OR j < 0"""


@query(_stretched_sql(_two_levels_sql(50), 50))
def recursive_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain ladder: lines, then parts of long lines, then windows. The documents have no blank lines."""
    return chunk.chunk_text(_docs(spark, sf_dir), ChunkingOptions(strategy="Recursive", max_tokens=50), tokenizer=WORD).select("doc_id", "position", "token_count")


_AWARE_SQL = rf"""WITH RECURSIVE d AS ({_WORDS_SQL}), r(doc_id, p, b) AS (SELECT doc_id, 0, 0 FROM d WHERE len(w) > 0 UNION ALL
SELECT r.doc_id, p + 1, coalesce(list_sort(list_transform(list_filter(range(b + 1, b + 65), lambda c: regexp_matches(w[c], '[.!?。！？]["'')\]}}”’»]*$')), lambda c: [abs((b + 64 - c) - 24), c]))[1][2], greatest(b + 1, b + 64 - 24))
FROM r JOIN d USING (doc_id) WHERE b + 64 < len(w))
SELECT doc_id, p::INT AS position, array_to_string(w[b + 1 : least(b + 64, len(w))], ' ') AS text, (least(b + 64, len(w)) - b)::INT AS token_count FROM r JOIN d USING (doc_id)"""


@query(_AWARE_SQL)
def fixed_window_sentence_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows whose overlap of about 24 words begins after the end of a sentence, if there is one in the window."""
    o = ChunkingOptions(max_tokens=64, overlap_count=24, overlap_strategy="SentenceBoundaryAware")
    return _flat(chunk.chunk_text(_docs(spark, sf_dir), o, tokenizer=WORD))


_PARA_UNITS = rf"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, len(regexp_extract_all(s, '[^\s]+'))::INT AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS s, unnest(range(0, len(string_split(text, chr(10) || chr(10))))) AS i FROM ({_CONV_SQL})) WHERE regexp_matches(s, '[^\s]')"


@query("SELECT * FROM (" + _pack_sql(_PARA_UNITS, 512) + ")")
def paragraph_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation packed into chunks of up to 512 words, which no turn exceeds."""
    o = ChunkingOptions(strategy="ParagraphBased", max_tokens=512)
    return chunk.chunk_text(_conversations(spark, sf_dir), o, tokenizer=WORD).select("doc_id", "position", "token_count")


@query("SELECT * FROM (" + _pack_sql(_PARA_UNITS, 400) + ")")
def recursive_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first step of the plain ladder alone: turns, which all fit."""
    o = ChunkingOptions(strategy="Recursive", max_tokens=400)
    return chunk.chunk_text(_conversations(spark, sf_dir), o, tokenizer=WORD).select("doc_id", "position", "token_count")


# lists and tables ---------------------------------------------------------------------------------------------


def _brand_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))).alias("x"))
    return p.select("p_brand", F.transform("x", lambda i: i["p_name"]).alias("items"))


_WIDE = {"max_tokens": 1_000_000, "model_id": "wide", "effective_input_budget": 1_000_000}
_WIDE_REGISTRY = budget.with_known_model("wide", budget.Entry("Cl100kBase", "wide", 1_000_000))


@query("SELECT p_brand, string_agg('- ' || p_name, chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY p_brand")
def list_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brand_lists(spark, sf_dir).select("p_brand", native.list_text(F.col("items")).alias("text"))


@query("SELECT p_brand, 0 AS position, string_agg(i || '. ' || p_name, chr(10) ORDER BY i) AS text FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, p_name) AS i FROM part) GROUP BY p_brand")
def list_whole_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ChunkingOptions(strategy="WholeList", **_WIDE)
    return chunk.chunk_list(_brand_lists(spark, sf_dir), o, ordered=True, tokenizer=WORD, registry=_WIDE_REGISTRY).select("p_brand", "position", "text")


@query("SELECT p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, p_name) - 1)::INT AS position, p_name AS text FROM part")
def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ChunkingOptions(strategy="ListEntry", **_WIDE)
    return chunk.chunk_list(_brand_lists(spark, sf_dir), o, tokenizer=WORD, registry=_WIDE_REGISTRY).select("p_brand", "position", "text")


_GREEDY_LIST = f"""WITH RECURSIVE u AS (SELECT p_brand, '- ' || p_name AS t, 1 + {_N_WORDS.format("p_name")} AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, p_name) AS i FROM part),
g(p_brand, i, t, acc, ch) AS (SELECT p_brand, i, t, n, 0 FROM u WHERE i = 1 UNION ALL
SELECT u.p_brand, u.i, u.t, CASE WHEN acc + n <= 20 THEN acc + n ELSE n END, CASE WHEN acc + n <= 20 THEN ch ELSE ch + 1 END FROM g JOIN u ON u.p_brand = g.p_brand AND u.i = g.i + 1)
SELECT p_brand, ch::INT AS position, string_agg(t, chr(10) ORDER BY i) AS text FROM g GROUP BY p_brand, ch"""


@query(_GREEDY_LIST)
def list_whole_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole list over its budget: entries are packed while they fit."""
    o = ChunkingOptions(strategy="WholeList", max_tokens=20)
    return chunk.chunk_list(_brand_lists(spark, sf_dir), o, tokenizer=WORD).select("p_brand", "position", "text")


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation").withColumn("n_name", F.concat("n_name", F.lit("|"), F.col("n_nationkey").cast("string")))
    return native.rows_of(n, ["n_nationkey", "n_name"], ["n_regionkey"], ["n_nationkey"])


_NATION = "SELECT *, n_name || '|' || n_nationkey AS nm FROM nation"
_MD = r"'| n_nationkey | n_name |' || chr(10) || '|---|---|' || chr(10)"
_ROW_SQL = r"'| ' || n_nationkey || ' | ' || replace(nm, '|', '\|') || ' |'"
_TABLE_SQL = {
    "Row": f"SELECT n_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS position, n_nationkey || ' ' || nm AS text FROM ({_NATION})",
    "RowWithHeaders": f"SELECT n_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS position, {_MD} || {_ROW_SQL} AS text FROM ({_NATION})",
    "RowGroupWithHeaders": f"SELECT n_regionkey, g::INT AS position, {_MD} || string_agg({_ROW_SQL}, chr(10) ORDER BY n_nationkey) AS text FROM (SELECT *, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) // 2 AS g FROM ({_NATION})) GROUP BY n_regionkey, g",
    "KeyValuePairs": f"SELECT n_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS position, 'n_nationkey: ' || n_nationkey || ', n_name: ' || nm AS text FROM ({_NATION})",
    "WholeTable": f"SELECT n_regionkey, 0 AS position, {_MD} || string_agg({_ROW_SQL}, chr(10) ORDER BY n_nationkey) AS text FROM ({_NATION}) GROUP BY n_regionkey",
}


def _table_query(strategy: str, as_native: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = _nations(spark, sf_dir)
        if as_native:
            return t.select("n_regionkey", F.posexplode(native.table_chunks(F.col("rows"), strategy, 2)).alias("position", "text"))
        o = ChunkingOptions(strategy=strategy, row_group_size=2, max_tokens=4096)
        return chunk.chunk_table(t, o, tokenizer=WORD).select("n_regionkey", "position", "text")

    return run


for _strategy, _text in _TABLE_SQL.items():
    _snake = "".join("_" + c.lower() if c.isupper() else c for c in _strategy)
    QUERIES[f"table{_snake}"] = _table_query(_strategy, False)
    QUERIES[f"table{_snake}_native"] = _table_query(_strategy, True)
    ORACLE_SQL[f"table{_snake}"] = ORACLE_SQL[f"table{_snake}_native"] = _text


_NARROW_SQL = f"SELECT n_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, c) - 1)::INT AS position, CASE c WHEN 0 THEN 'n_nationkey: ' || n_nationkey ELSE 'n_name: ' || nm END AS text FROM ({_NATION}), (VALUES (0), (1)) v(c)"


def _narrow(strategy: str, limit: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = ChunkingOptions(strategy=strategy, row_group_size=2, max_tokens=limit)
        return chunk.chunk_table(_nations(spark, sf_dir), o, tokenizer=WORD).select("n_regionkey", "position", "text")

    return run


# tables over their budget: a group falls back to rows, a row to its pairs, pairs to packs of those that fit
QUERIES["table_pairs_split"], ORACLE_SQL["table_pairs_split"] = _narrow("KeyValuePairs", 3), _NARROW_SQL
QUERIES["table_whole_split"], ORACLE_SQL["table_whole_split"] = _narrow("WholeTable", 12), _TABLE_SQL["RowWithHeaders"]
QUERIES["table_rows_to_pairs"], ORACLE_SQL["table_rows_to_pairs"] = _narrow("RowWithHeaders", 6), _TABLE_SQL["KeyValuePairs"]


@query(f"SELECT n_regionkey, 'n_nationkey | n_name' || chr(10) || string_agg(n_nationkey || ' | ' || nm, chr(10) ORDER BY n_nationkey) AS text FROM ({_NATION}) GROUP BY n_regionkey")
def table_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).select("n_regionkey", native.table_text(F.col("rows")).alias("text"))


# requests, hierarchy, ingestion -------------------------------------------------------------------------------

_TREE_SQL = """SELECT 'r' || r_regionkey AS id, NULL AS parent, r_regionkey AS ord, r_name AS text FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, n_name FROM nation
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_suppkey, s_name FROM supplier"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: _table(spark, sf_dir, n) for n in ("region", "nation", "supplier")}
    cat = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = t["region"].select(cat("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("int").alias("ord"), F.col("r_name").alias("text"))
    n = t["nation"].select(cat("n", "n_nationkey"), cat("r", "n_regionkey"), F.col("n_nationkey").cast("int"), "n_name")
    s = t["supplier"].select(cat("s", "s_suppkey"), cat("n", "s_nationkey"), F.col("s_suppkey").cast("int"), "s_name")
    return r.union(n).union(s)


@query(f"""WITH RECURSIVE t AS ({_TREE_SQL}), w AS (SELECT id, text, parent, [ord] AS path, 0 AS depth FROM t WHERE parent IS NULL
UNION ALL SELECT t.id, t.text, t.parent, list_append(w.path, t.ord), w.depth + 1 FROM w JOIN t ON t.parent = w.id)
SELECT id AS request_id, parent AS parent_id, array_to_string(path, '/') AS path, 0 AS position, text FROM w""")
def request_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of region, nation and supplier requests, flattened and chunked node by node."""
    nodes = requests.paths(_tree(spark, sf_dir)).select(F.col("id").alias("request_id"), F.col("parent").alias("parent_id"), "path", F.lit("Text").alias("type"), "text")
    for name, kind in (("items", "array<string>"), ("ordered", "boolean"), ("rows", "array<array<string>>"), ("labels", "array<string>"), ("tags", "map<string,string>")):
        nodes = nodes.withColumn(name, F.lit(None).cast(kind))
    c = chunk.chunk_requests(nodes, ChunkingOptions(max_tokens=64), WORD)
    return c.select("request_id", "parent_id", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), "position", "text")


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("s"))
    body = F.array_join(F.transform("s", lambda x: F.concat(F.lit("### "), x["s_name"], F.lit("\nSupplier number "), x["s_suppkey"].cast("string"), F.lit("."))), "\n\n")
    n = _table(spark, sf_dir, "nation").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    n = n.select("n_regionkey", F.struct("n_nationkey", F.concat(F.lit("## "), F.col("n_name"), F.lit(" ##\nNation "), F.col("n_nationkey").cast("string"), F.lit(" text.\n\n"), F.coalesce(body, F.lit(""))).alias("t")).alias("n"))
    g = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n")).alias("n")).join(_table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return g.select(F.col("r_regionkey").alias("doc_id"), F.concat(F.lit("# "), F.col("r_name"), F.lit("\n"), F.array_join(F.transform("n", lambda x: x["t"]), "\n\n")).alias("text"))


_CRUMBS = """SELECT r_regionkey AS doc_id, 'Nation ' || n_nationkey || ' text.' AS body, r_name || ' > ' || n_name AS breadcrumb FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT r_regionkey, 'Supplier number ' || s_suppkey || '.', r_name || ' > ' || n_name || ' > ' || s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey"""


@query(_CRUMBS)
def hierarchy_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of markdown with their breadcrumbs, by array expressions."""
    return native.sections(_markdown(spark, sf_dir)).select("doc_id", "body", "breadcrumb")


@query(f"SELECT doc_id, breadcrumb AS header_context, breadcrumb || chr(10) || chr(10) || body AS text FROM ({_CRUMBS})")
def hierarchy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ChunkingOptions(hierarchy_aware=True, contextualize_headers=True, max_tokens=64)
    return chunk.chunk_text(_markdown(spark, sf_dir), o, tokenizer=WORD).select("doc_id", "header_context", "text")


_MD_UNITS = f"""SELECT doc_id, CASE WHEN total > 30 THEN nk ELSE -1 END AS grp, row_number() OVER (PARTITION BY doc_id ORDER BY nk, k, sk) AS pos, n FROM (
SELECT *, sum(n) OVER (PARTITION BY doc_id, nk) AS total FROM (
SELECT r_regionkey AS doc_id, -1 AS nk, 0 AS k, 0 AS sk, 1 + {_N_WORDS.format("r_name")} AS n FROM region
UNION ALL SELECT n_regionkey, n_nationkey, 0, 0, 5 + {_N_WORDS.format("n_name")} FROM nation
UNION ALL SELECT n_regionkey, n_nationkey, 1, s_suppkey, 4 + {_N_WORDS.format("s_name")} FROM supplier JOIN nation ON n_nationkey = s_nationkey))"""
#: Sections of nations that fit are one unit each.
_MD_SQL = _stretched_sql(f"SELECT doc_id, grp, min(pos) AS pos, sum(n)::INT AS n FROM (SELECT *, CASE WHEN grp = -1 THEN nk ELSE pos + 1000 END AS own FROM ({_MD_UNITS.replace('SELECT doc_id, CASE', 'SELECT doc_id, nk, CASE', 1)})) GROUP BY doc_id, grp, own", 30)


@query(_MD_SQL)
def recursive_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Markdown ladder: sections of nations, and of longer ones those of their suppliers."""
    o = ChunkingOptions(strategy="Recursive", format="Markdown", max_tokens=30)
    return chunk.chunk_text(_markdown(spark, sf_dir), o, tokenizer=WORD).select("doc_id", "position", "token_count")


@query("""SELECT r_regionkey AS doc_id, '# ' || any_value(r_name) || chr(10) || chr(10) || string_agg('## ' || n_name || chr(10) || chr(10) || 'Key ' || n_nationkey, chr(10) || chr(10) ORDER BY n_nationkey) AS text
FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey""")
def ingestion_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = lambda k: F.lit(None).cast(k)
    cells = "array<array<string>>"
    r = _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("doc_id"), F.lit(-1).alias("ord"), F.lit("header").alias("kind"), F.lit(1).alias("level"), F.col("r_name").alias("text"), none("string").alias("alt"), none(cells).alias("cells"))
    n = _table(spark, sf_dir, "nation")
    h = n.select("n_regionkey", (F.col("n_nationkey") * 2).cast("int"), F.lit("header"), F.lit(2), "n_name", none("string"), none(cells))
    t = n.select("n_regionkey", (F.col("n_nationkey") * 2 + 1).cast("int"), F.lit("paragraph"), none("int"), F.concat(F.lit("Key "), F.col("n_nationkey").cast("string")), none("string"), none(cells))
    return ingestion.to_markdown(r.union(h).union(t))


@query(f"SELECT doc_id, position, text AS content, '' AS context, position::VARCHAR || '/' || token_count::VARCHAR AS meta FROM ({_window_sql(64, 0)})")
def ingestion_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ingestion.ingestion_chunks(chunk.chunk_text(_docs(spark, sf_dir), ChunkingOptions(max_tokens=64), tokenizer=WORD))
    return c.select("doc_id", "position", F.regexp_replace("content", _LATIN_SPACE, " ").alias("content"), "context", F.concat_ws("/", F.col("metadata")["chunk.position"], F.col("metadata")["chunk.tokenCount"]).alias("meta"))


# enrichment and aggregates ------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, length(text)::INT AS character_count FROM documents WHERE length(trim(text)) > 0")
def chunk_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of chunks that hold a whole document."""
    o = ChunkingOptions(strategy="WholeList", compute_hashes=True, trim_whitespace=False, **_WIDE)
    c = chunk.chunk_text(_docs(spark, sf_dir), o, tokenizer=WORD, registry=_WIDE_REGISTRY)
    return c.select("doc_id", *[F.lower(F.hex(f"{h}_hash")).alias(h) for h in ("md5", "sha1", "sha256")], "character_count")


@query("SELECT doc_id, (length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')))::INT AS n FROM documents")
def utf16_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", native.utf16_length(F.col("text")).alias("n"))


@query(f"SELECT d.doc_id, coalesce(n, 0)::BIGINT AS chunk_count, coalesce(t, 0)::BIGINT AS total_tokens, coalesce(m, 0)::BIGINT AS max_chunk_tokens, length(text)::INT AS input_character_count FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, sum(token_count) AS t, max(token_count) AS m FROM ({_window_sql(64, 16)}) GROUP BY doc_id) USING (doc_id)")
def chunk_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, d = chunk.chunk_to_result(_docs(spark, sf_dir), ChunkingOptions(max_tokens=64, overlap_count=16), tokenizer=WORD)
    return d.select("doc_id", "chunk_count", "total_tokens", "max_chunk_tokens", "input_character_count")


@query(f"SELECT b AS upper_bound, count(token_count) AS n_chunks FROM (SELECT unnest([16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192, NULL])::INT AS b, unnest([0, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192]) AS a) LEFT JOIN ({_window_sql(64, 16)}) ON token_count > a AND (b IS NULL OR token_count <= b) GROUP BY b")
def chunk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.token_histogram(chunk.chunk_text(_docs(spark, sf_dir), ChunkingOptions(max_tokens=64, overlap_count=16), tokenizer=WORD))


@query("SELECT doc_id, length(text)::INT AS input_character_count FROM documents WHERE length(text) > 4000")
def over_limit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.over_limit(_docs(spark, sf_dir), ChunkingOptions(max_input_characters=4000))


@query(f"SELECT doc_id, position, text, token_count FROM ({_window_sql(64, 0)}) JOIN (SELECT doc_id FROM documents WHERE length(text) <= 4000) USING (doc_id)")
def over_limit_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents within the size limit are chunked; longer ones have no chunks, and don't stop the job."""
    return _flat(chunk.chunk_text(_docs(spark, sf_dir), ChunkingOptions(max_tokens=64, max_input_characters=4000), tokenizer=WORD, oversize="skip"))


#: Word pieces of a small vocabulary: each stands at the start of a word and after others.
_PIECE_LIST = sorted("tion sion ment ing ent the and est lich ción men er an in on th re or ti es le de la un".split(), key=lambda x: (-len(x), x))
_PIECE_MARKS = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]


def word_pieces() -> tokenizers.Spec:
    """WordPiece over :data:`_PIECE_LIST` without accents, single letters, digits and marks."""
    plain = [p for p in _PIECE_LIST if p.isascii()] + [chr(c) for c in (*range(97, 123), *range(48, 58))]
    return tokenizers.Spec("wordpiece", (("[PAD]", "[UNK]", *plain, *(f"##{p}" for p in plain), *_PIECE_MARKS),))


_MARK_SET = r"!-/:-@\[-`{-~"
_WP_SQL = rf"""WITH t AS (SELECT doc_id, strip_accents(lower(coalesce(text, ''))) AS t FROM documents), w AS (SELECT doc_id, regexp_extract_all(t, '[^\s{_MARK_SET}]+|[{_MARK_SET}]') AS w FROM t)
SELECT doc_id, coalesce(list_sum(list_transform(w, lambda x: CASE WHEN regexp_full_match(x, '[a-z0-9]+') THEN len(regexp_extract_all(x, '{"|".join(p for p in _PIECE_LIST if p.isascii())}|[a-z0-9]')) ELSE 1 END)), 0)::BIGINT AS n FROM w"""


@query(_WP_SQL)
def wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word pieces of each document by greedy longest match; words with other letters are one unknown token."""
    counts = chunk.token_counts(F.col("text"), word_pieces())
    return _docs(spark, sf_dir).select("doc_id", counts.cast("long").alias("n"))


@query(f"SELECT count(*) AS n_chunks, sum(token_count)::BIGINT AS total_tokens, avg(token_count) AS mean_tokens, max(token_count) AS max_tokens FROM ({_window_sql(64, 16)})")
def chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.summary(chunk.chunk_text(_docs(spark, sf_dir), ChunkingOptions(max_tokens=64, overlap_count=16), tokenizer=WORD))


@query(f"SELECT lang, quality, count(*) AS n_chunks, sum(token_count)::BIGINT AS tokens FROM ({_window_sql(64, 0)}) JOIN documents USING (doc_id) JOIN labels USING (doc_id) GROUP BY lang, quality")
def chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and tokens by language and label; the other columns of documents come along through the chunking."""
    c = chunk.chunk_text(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), ChunkingOptions(max_tokens=64), tokenizer=WORD)
    return c.join(_table(spark, sf_dir, "labels"), "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n_chunks"), F.sum("token_count").alias("tokens"))


@query(f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY position) - 1)::INT AS position, text, token_count FROM ({_window_sql(64, 0)}) WHERE token_count >= 20")
def small_chunks_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(chunk.chunk_text(_docs(spark, sf_dir), ChunkingOptions(max_tokens=64, small_chunk_mode="Drop", min_chunk_tokens=20), tokenizer=WORD))


@query(
    f"""WITH RECURSIVE u AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, n FROM ({_LINE_UNITS})),
g(doc_id, i, acc, ch) AS (SELECT doc_id, i, n, 0 FROM u WHERE i = 1 UNION ALL SELECT u.doc_id, u.i, CASE WHEN acc < 40 THEN acc + n ELSE n END, CASE WHEN acc < 40 THEN ch ELSE ch + 1 END FROM g JOIN u ON u.doc_id = g.doc_id AND u.i = g.i + 1),
c AS (SELECT doc_id, ch, max(acc) AS n, max(ch) OVER (PARTITION BY doc_id) AS last FROM g GROUP BY doc_id, ch),
m AS (SELECT doc_id, CASE WHEN ch = last AND ch > 0 AND n < 40 THEN ch - 1 ELSE ch END AS position, n FROM c)
SELECT doc_id, position::INT AS position, sum(n)::INT AS token_count FROM m GROUP BY doc_id, position"""
)
def small_chunks_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of less than 40 words take in the next ones; a small last one joins the one before."""
    o = ChunkingOptions(strategy="RegexBased", regex_pattern=r"\n", small_chunk_mode="MergeForward", min_chunk_tokens=40, **_WIDE)
    return chunk.chunk_text(_docs(spark, sf_dir), o, tokenizer=WORD, registry=_WIDE_REGISTRY).select("doc_id", "position", "token_count")


@query(f"SELECT doc_id, position, 'Context: ' || text AS text, -1 AS start_offset FROM ({_window_sql(62, 0)})")
def context_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunk.chunk_text(_docs(spark, sf_dir), ChunkingOptions(max_tokens=63, context_prefix="Context: "), tokenizer=WORD)
    return c.select("doc_id", "position", F.regexp_replace("text", _LATIN_SPACE, " ").alias("text"), "start_offset")


@query(f"SELECT doc_id, position, text, token_count FROM ({_window_sql(64, 16)})")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunk.chunk_text(_docs(spark, sf_dir), ChunkingOptions(max_tokens=64, overlap_count=16), tokenizer=WORD)
    return _flat(contract.from_json(c.select("doc_id", contract.to_json(c).alias("json"))))


# budgets ------------------------------------------------------------------------------------------------------

_IDS = ("openai/text-embedding-3-small", "nomic-embed-text:latest", "sentence-transformers/all-MiniLM-L6-v2", "BAAI/bge-m3", "intfloat/multilingual-e5-large", "gte-small", "all-mpnet-base-v2", "gpt-4o", "mxbai-embed-large", "unknown", "", "bge-small-en-v1.5")
_REGISTRY_SQL = ", ".join(f"('{k}', {i}, '{e.kind}', {e.max_input_tokens}, {e.reserved})" for i, (k, e) in enumerate(budget.KNOWN_MODELS.items()))


@query(f"""WITH ids(model_id) AS (VALUES {", ".join(f"('{x}')" for x in _IDS)}), r(key, ord, kind, mx, rs) AS (VALUES {_REGISTRY_SQL}),
n AS (SELECT model_id, string_split(regexp_extract(lower(trim(model_id)), '([^/]*)$', 1), ':')[1] AS name FROM ids),
b AS (SELECT model_id, arg_max(struct_pack(key := key, kind := kind, mx := mx, rs := rs), (length(key), -ord)) AS b FROM n JOIN r ON name <> '' AND contains(name, key) GROUP BY model_id)
SELECT model_id, b.key AS key, b.kind AS kind, b.mx AS max_input_tokens, b.mx - b.rs AS effective_budget FROM ids LEFT JOIN b USING (model_id)""")
def known_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame([(x,) for x in _IDS], "model_id string")
    return budget.resolve_models(ids, budget.registry_frame(spark))


@query("""SELECT o.max_tokens, o.margin, o.pct, greatest(1, least(o.max_tokens, greatest(1, 254 - (o.margin + ceil(254 * o.pct)))))::INT AS budget
FROM (SELECT unnest([1, 100, 256, 512]) AS max_tokens) m, LATERAL (SELECT m.max_tokens, unnest([0, 0, 10, 300]) AS margin, unnest([0.0, 0.04, 0.0, 0.5])::DOUBLE AS pct) o""")
def budget_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for n in (1, 100, 256, 512):
        for margin, pct in ((0, 0.0), (0, 0.04), (10, 0.0), (300, 0.5)):
            o = ChunkingOptions(max_tokens=n, safety_margin_tokens=margin, safety_margin_percentage=pct, model_id="all-minilm")
            rows.append((n, margin, pct, budget.chunk_budget(o, budget.resolve(o))))
    return spark.createDataFrame(rows, "max_tokens int, margin int, pct double, budget int")


# integrity ----------------------------------------------------------------------------------------------------

_ZERO = "SELECT doc_id, 0::BIGINT AS over_budget, 0::BIGINT AS bad_span, 0::BIGINT AS contained, 0::BIGINT AS uncovered FROM {}"


def _integrity(o: ChunkingOptions, spec: Callable[[], tokenizers.Spec], docs=_docs, coverage: bool = True):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return integrity.document_violations(docs(spark, sf_dir), o, spec(), coverage=coverage)

    return run


_word, _bpe = (lambda: WORD), tokenizers.public_bpe
for _name, _options, _spec, _src in (
    ("integrity_bpe_fixed", ChunkingOptions(max_tokens=128), _bpe, "documents"),
    ("integrity_bpe_overlap", ChunkingOptions(max_tokens=64, overlap_count=16), _bpe, "documents"),
    ("integrity_bpe_sentence_aware", ChunkingOptions(max_tokens=64, overlap_count=24, overlap_strategy="SentenceBoundaryAware"), _bpe, "documents"),
    ("integrity_bpe_sentence", ChunkingOptions(strategy="SentenceBased", max_tokens=128), _bpe, "documents"),
    ("integrity_bpe_recursive", ChunkingOptions(strategy="Recursive", max_tokens=96), _bpe, "documents"),
    ("integrity_bpe_lines", ChunkingOptions(strategy="ListEntry", max_tokens=96), _bpe, "documents"),
    ("integrity_words_recursive", ChunkingOptions(strategy="Recursive", max_tokens=50), _word, "documents"),
    ("integrity_bpe_paragraph", ChunkingOptions(strategy="ParagraphBased", max_tokens=128), _bpe, "conversations"),
    ("integrity_wordpiece_fixed", ChunkingOptions(max_tokens=96, overlap_count=12), word_pieces, "documents"),
    ("integrity_wordpiece_sentence", ChunkingOptions(strategy="SentenceBased", max_tokens=96), word_pieces, "documents"),
    ("integrity_bpe_merge_forward", ChunkingOptions(strategy="SentenceBased", max_tokens=96, small_chunk_mode="MergeForward", min_chunk_tokens=24), _bpe, "documents"),
):
    QUERIES[_name] = _integrity(_options, _spec, _docs if _src == "documents" else _conversations)
    ORACLE_SQL[_name] = _ZERO.format("documents" if _src == "documents" else "(SELECT DISTINCT conv_id AS doc_id FROM conversations)")


# evaluation ---------------------------------------------------------------------------------------------------


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spans for each document: its second quarter and its last tenth, in code points."""
    n = F.length("text")
    d = _docs(spark, sf_dir).where("length(text) >= 40").select("doc_id", n.alias("n"))
    one = lambda label, start, length: d.select("doc_id", F.lit(label).alias("label"), start.cast("int").alias("start"), length.cast("int").alias("length"))
    return one("quarter", F.floor(F.col("n") / 4), F.floor(F.col("n") / 4)).union(one("tail", F.col("n") - F.floor(F.col("n") / 10), F.floor(F.col("n") / 10)))


_SPANS_SQL = "SELECT doc_id, 'quarter' AS label, length(text) // 4 AS start, length(text) // 4 AS length FROM documents WHERE length(text) >= 40 UNION ALL SELECT doc_id, 'tail', length(text) - length(text) // 10, length(text) // 10 FROM documents WHERE length(text) >= 40"
#: Chunks with offsets in SQL: lines of a document that are not blank.
_LINES_SQL = r"""SELECT doc_id, a + lead AS s, a + lead + n AS e FROM (SELECT doc_id, coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a,
length(x) - length(regexp_replace(x, '^\s+', '')) AS lead, length(regexp_replace(x, '^\s+|\s+$', '', 'g')) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)) WHERE n > 0"""


def _line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ChunkingOptions(strategy="RegexBased", regex_pattern=r"\n", **_WIDE)
    return chunk.chunk_text(_docs(spark, sf_dir), o, tokenizer=WORD, registry=_WIDE_REGISTRY)


_SCORES_SQL = f"""WITH s AS ({_SPANS_SQL}), c AS ({_LINES_SQL}), m AS (SELECT s.*, c.s AS cs, c.e AS ce FROM s JOIN c ON c.doc_id = s.doc_id AND c.e > s.start AND c.s < s.start + s.length),
a AS (SELECT doc_id, label, sum(ce - cs) AS retrieved, sum(least(ce, start + length) - greatest(cs, start)) AS hit FROM m GROUP BY doc_id, label),
j AS (SELECT s.*, coalesce(retrieved, 0) AS r, coalesce(hit, 0) AS h FROM s LEFT JOIN a USING (doc_id, label)),
q AS (SELECT doc_id, label, CASE WHEN length > 0 THEN h / length ELSE 0.0 END AS recall, CASE WHEN r > 0 THEN h / r ELSE 0.0 END AS precision, CASE WHEN r + length - h > 0 THEN h / (r + length - h) ELSE 0.0 END AS iou FROM j)"""


@query(f"{_SCORES_SQL} SELECT doc_id, label, recall::DOUBLE AS recall, precision::DOUBLE AS precision, iou::DOUBLE AS iou FROM q")
def span_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluation.span_scores(_spans(spark, sf_dir), _line_chunks(spark, sf_dir))
    return s.select("doc_id", "label", F.col("recall").cast("double"), F.col("precision").cast("double"), F.col("iou").cast("double"))


@query(f"WITH c AS (SELECT doc_id, position * 48 AS s, position * 48 + token_count AS e FROM ({_window_sql(64, 16)})) SELECT c.doc_id, max(len(w))::BIGINT AS union_length FROM c JOIN ({_WORDS_SQL}) d USING (doc_id) GROUP BY c.doc_id")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of overlapping windows, in words, is the whole document."""
    w = native.word_windows(_docs(spark, sf_dir), 64, 16).select("doc_id", F.col("start_word").alias("start"), (F.col("start_word") + F.size("words")).alias("end"))
    return native.islands(w, ["doc_id"]).select("doc_id", F.col("union_length").cast("long").alias("union_length"))


@query()
def evaluation_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine standard configurations under the public byte-pair tokenizer, best first."""
    docs = _docs(spark, sf_dir)
    return evaluation.sweep(docs, _spans(spark, sf_dir), evaluation.SWEEP, tokenizer=tokenizers.public_bpe())


@query()
def bpe_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_text(_docs(spark, sf_dir), ChunkingOptions.for_rag(), tokenizer=tokenizers.public_bpe()).drop("embeddings", "labels", "tags")
