"""Catalyst forms of what needs no boundary search: splits, additive windows, serialisers, hierarchy, hashes, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.tokenizers import CJK, WHITE

_W = f"[{WHITE}]"
_TRIM = rf"\A{_W}+|{_W}+\z"
_UNIT = f"[{CJK}]|[^{WHITE}{CJK}]+"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, _TRIM, "")


def words(c: Column) -> Column:
    """The additive tokenizer's tokens: words, each ideograph being one."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_UNIT), F.lit(0))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def _split(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), pattern), trim), lambda x: x != "")


def sentences(c: Column) -> Column:
    return _split(c, rf"(?<=[.!?]){_W}+")


def paragraphs(c: Column) -> Column:
    return _split(c, "\r\n\r\n|\n\n")


def lines(c: Column) -> Column:
    return _split(c, "\n")


def word_windows(df: DataFrame, size: int, overlap: int = 0, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, position, words, start_word: windows of the additive tokenizer, in closed form."""
    stride = max(1, size - overlap)
    cut = df.select(*keys, words(F.col(text)).alias("w")).where(F.size("w") > 0)
    last = F.ceil(F.greatest(F.lit(0), F.size("w") - size) / stride).cast("int")
    at = cut.withColumn("position", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("position") * stride
    return at.select(*keys, "position", start.alias("start_word"), F.slice("w", start + 1, F.lit(size)).alias("words"))


# lists and tables ---------------------------------------------------------------------------------------------


def list_text(items: Column, ordered: bool | Column = False) -> Column:
    """``- x`` or ``n. x`` lines."""
    flag = ordered if isinstance(ordered, Column) else F.lit(ordered)
    value = lambda x: F.coalesce(x, F.lit(""))
    return F.array_join(F.transform(items, lambda x, i: F.when(flag, F.concat((i + 1).cast("string"), F.lit(". "), value(x))).otherwise(F.concat(F.lit("- "), value(x)))), "\n")


def list_entries(items: Column) -> Column:
    return F.filter(items, lambda x: trim(F.coalesce(x, F.lit(""))) != "")


def _cells(row: Column) -> Column:
    return F.transform(row, lambda c: F.coalesce(c, F.lit("")))


def escape_cell(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))


def markdown_row(row: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(row, escape_cell), " | "), F.lit(" |"))


def markdown_rule(header: Column) -> Column:
    return F.concat(F.lit("|"), F.array_join(F.transform(header, lambda _: F.lit("---")), "|"), F.lit("|"))


def markdown_table(header: Column, rows: Column) -> Column:
    return F.concat_ws("\n", markdown_row(header), markdown_rule(header), F.array_join(F.transform(rows, markdown_row), "\n"))


def plain_row(row: Column) -> Column:
    return F.array_join(_cells(row), " ")


def pairs(header: Column, row: Column) -> Column:
    """``h: v`` strings, as many as the shorter of the two has."""
    n = F.least(F.size(header), F.size(row))
    return F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.coalesce(F.try_element_at(header, i), F.lit("")), F.lit(": "), F.coalesce(F.try_element_at(row, i), F.lit(""))))


def key_values(header: Column, row: Column) -> Column:
    n = F.least(F.size(header), F.size(row))
    return F.when(n > 0, F.array_join(pairs(header, row), ", ")).otherwise("")


def table_text(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(_cells(r), " | ")), "\n")


def row_groups(rows: Column, size: int) -> Column:
    """Data rows (all but the header) in groups of *size*."""
    n = F.ceil((F.size(rows) - 1) / size).cast("int")
    empty = F.slice(F.transform(rows, lambda r: F.array(r)), 1, 0)
    return F.when(F.size(rows) > 1, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda g: F.slice(rows, g * size + 2, F.lit(size)))).otherwise(empty)


def table_chunks(rows: Column, strategy: str, row_group_size: int = 5) -> Column:
    """The chunks of a table of which every one fits; header-only and empty tables have none."""
    header, data = rows[0], F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    one = {
        "Row": lambda: F.transform(data, plain_row),
        "RowWithHeaders": lambda: F.transform(data, lambda r: markdown_table(header, F.array(r))),
        "RowGroupWithHeaders": lambda: F.transform(row_groups(rows, row_group_size), lambda g: markdown_table(header, g)),
        "KeyValuePairs": lambda: F.transform(data, lambda r: key_values(header, r)),
        "WholeTable": lambda: F.array(markdown_table(header, data)),
    }[strategy]()
    return F.when(F.size(rows) > 1, one).otherwise(F.array().cast("array<string>"))


def rows_of(df: DataFrame, columns: list[str], keys: list[str], order: list[str], name: str = "rows") -> DataFrame:
    """A table of strings for each key, its first row being the header."""
    row = F.struct(*order, F.array(*[F.col(c).cast("string") for c in columns]).alias("_r"))
    grouped = df.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    return grouped.select(*keys, F.concat(F.array(F.array(*[F.lit(c) for c in columns])), F.transform("_rows", lambda x: x["_r"])).alias(name))


# markdown hierarchy -------------------------------------------------------------------------------------------

_HEADER = rf"^(#{{1,6}}){_W}+(.+?){_W}*#*{_W}*$"


def sections(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), separator: str = " > ") -> DataFrame:
    """keys, section, level, title, breadcrumb, start_offset, end_offset, body: sections that have content, in order.

    Lines, offsets, the stack of open headers and section bodies are all array expressions of the row, so a
    document never leaves its row and nothing is shuffled.
    """
    src = F.coalesce(F.col(text), F.lit(""))
    line = lambda x: F.regexp_replace(x, "\r$", "")
    cut = df.select(*keys, src.alias("_t"), F.split(src, "\n").alias("_lines"))
    # offsets by one running sum
    begin = F.aggregate("_lines", F.struct(F.array().cast("array<int>").alias("o"), F.lit(0).alias("n")), lambda a, x: F.struct(F.concat(a["o"], F.array(a["n"])).alias("o"), (a["n"] + F.length(x) + 1).alias("n")))["o"]
    info = F.zip_with(
        "_lines",
        begin,
        lambda x, o: F.struct(o.alias("at"), F.length(x).alias("n"), F.length(F.regexp_extract(line(x), _HEADER, 1)).alias("level"), F.regexp_extract(line(x), _HEADER, 2).alias("title")),
    )
    rows = cut.select(*keys, "_t", info.alias("_i"))
    heads = F.concat(F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("level"), F.lit("").alias("title"))), F.filter("_i", lambda x: x["level"] > 0))
    rows = rows.select(*keys, "_t", heads.alias("_h"))
    stack_type = "array<struct<level:int,title:string>>"
    crumbs = F.aggregate(
        F.slice("_h", F.lit(2), F.size("_h")),
        F.struct(F.array().cast(stack_type).alias("stack"), F.array(F.lit(None).cast("string")).alias("out")),
        lambda a, x: F.struct(
            F.concat(F.filter(a["stack"], lambda y: y["level"] < x["level"]), F.array(F.struct(x["level"].alias("level"), x["title"].alias("title")))).alias("stack"),
            F.concat(
                a["out"],
                F.array(F.array_join(F.transform(F.filter(F.concat(F.filter(a["stack"], lambda y: y["level"] < x["level"]), F.array(F.struct(x["level"].alias("level"), x["title"].alias("title")))), lambda y: trim(y["title"]) != ""), lambda y: y["title"]), separator)),
            ).alias("out"),
        ),
    )["out"]
    out = rows.select(*keys, "_t", "_h", F.posexplode(crumbs).alias("section", "breadcrumb"))
    head = F.element_at("_h", F.col("section") + 1)
    first = F.when(F.col("section") == 0, F.lit(0)).otherwise(head["at"] + head["n"] + 1)
    after = F.when(F.col("section") + 2 <= F.size("_h"), F.try_element_at("_h", F.col("section") + 2)["at"]).otherwise(F.length("_t"))
    raw = F.substring(F.col("_t"), first + 1, F.greatest(after - first, F.lit(0)))
    lead = F.length(raw) - F.length(F.regexp_replace(raw, rf"\A{_W}+", ""))
    body = trim(raw)
    return out.select(*keys, "section", head["level"].alias("level"), head["title"].alias("title"), "breadcrumb", (first + lead).alias("start_offset"), (first + lead + F.length(body)).alias("end_offset"), body.alias("body")).where("body != ''")


def contextualised(breadcrumb: Column, body: Column) -> Column:
    return F.when(breadcrumb.isNull() | (breadcrumb == ""), body).otherwise(F.concat(breadcrumb, F.lit("\n\n"), body))


# scalar pieces ------------------------------------------------------------------------------------------------


def hashes(c: Column) -> dict[str, Column]:
    return {"md5_hash": F.unhex(F.md5(c)), "sha1_hash": F.unhex(F.sha1(c)), "sha256_hash": F.unhex(F.sha2(c, 256))}


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def chunk_id(*parts: Column) -> Column:
    """An id that follows from what the chunk is, so that retries and restarts agree."""
    return F.substring(F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256), 1, 32)


def islands(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, union_length: the length of the union of each key's intervals."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = df.withColumn("_m", F.coalesce(F.max(end).over(before), F.col(start)))
    return reach.groupBy(*keys).agg(F.sum(F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.col("_m")))).alias("union_length"))
