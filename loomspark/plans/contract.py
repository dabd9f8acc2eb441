"""The JSON contract: camelCase names out, strict enum names in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.options import ChunkingOptions, InvalidChunkingOptions, STRATEGIES, _DOMAINS

#: Column -> name in JSON.
NAMES = {
    "chunk_id": "guid",
    "parent_id": "parentGUID",
    "position": "position",
    "text": "text",
    "token_count": "tokenCount",
    "character_count": "characterCount",
    "start_offset": "startOffset",
    "end_offset": "endOffset",
    "strategy": "strategy",
    "tokenizer_model": "tokenizerModel",
    "header_context": "headerContext",
    "labels": "labels",
    "tags": "tags",
    "embeddings": "embeddings",
    "md5_hash": "md5Hash",
    "sha1_hash": "sha1Hash",
    "sha256_hash": "sha256Hash",
}
_TYPES = {"position": "int", "tokenCount": "int", "characterCount": "int", "startOffset": "int", "endOffset": "int", "labels": "array<string>", "tags": "map<string,string>", "embeddings": "array<float>"}
_BINARY = ("md5_hash", "sha1_hash", "sha256_hash")


def to_json(chunks: DataFrame, pretty: bool = False) -> Column:
    """A chunk row as JSON; hashes are base64."""
    cols = [(F.base64(F.col(c)) if c in _BINARY else F.col(c)).alias(n) for c, n in NAMES.items() if c in chunks.columns]
    return F.to_json(F.struct(*cols), {"pretty": str(pretty).lower(), "ignoreNullFields": "false"})


def strict(value: Column, allowed: tuple[str, ...], name: str) -> Column:
    """The allowed name that *value* is, whatever its case (or its number); an error otherwise."""
    table = F.create_map(*[F.lit(x) for i, a in enumerate(allowed) for x in (a.lower(), a)] + [F.lit(x) for i, a in enumerate(allowed) for x in (str(i), a)])
    found = table[F.lower(F.trim(value))]
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit(f"{name}: no such value: "), F.coalesce(value, F.lit("null")))))


def from_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Chunk rows of a column of JSON. Names are read in any case; the strategy must be one."""
    schema = "map<string,string>"
    m = F.from_json(F.col(column), schema)
    m = F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    rows = df.select(*[c for c in df.columns if c != column], m.alias("_m"))
    out = []
    for c, n in NAMES.items():
        v = F.col("_m")[n.lower()]
        kind = _TYPES.get(n, "string")
        if c in _BINARY:
            v = F.unbase64(v)
        elif c == "strategy":
            v = strict(v, STRATEGIES, "strategy")
        elif kind.startswith(("array", "map")):
            v = F.from_json(v, kind)
        else:
            v = v.cast(kind)
        out.append(v.alias(c))
    return rows.select(*[c for c in rows.columns if c != "_m"], *out)


_CAMEL = {"".join(w if i == 0 else w.capitalize() for i, w in enumerate(name.split("_"))).lower(): name for name in ChunkingOptions.names()}


def options_from(values: dict) -> ChunkingOptions:
    """Options from a JSON object: camelCase or snake_case names in any case, enums by name in any case."""
    found = {}
    for name, value in values.items():
        own = _CAMEL.get(name.replace("_", "").lower())
        if own is None:
            raise InvalidChunkingOptions(f"there is no option {name!r}")
        if own in _DOMAINS:
            hits = [a for a in _DOMAINS[own] if isinstance(value, str) and a.lower() == value.strip().lower()]
            if not hits:
                raise InvalidChunkingOptions(f"{name}: {value!r} is none of {', '.join(_DOMAINS[own])}")
            value = hits[0]
        found[own] = value
    return ChunkingOptions(**found)
