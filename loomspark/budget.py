"""Which tokenizer and how many tokens: a registry of models, provider rules and budget arithmetic.

Everything here runs on the driver, once for a query. :func:`resolve_models` is the same lookup for a column of ids.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from types import MappingProxyType

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.options import ChunkingOptions, TokenizerResolution


@dataclass(frozen=True)
class Entry:
    kind: str
    model: str
    max_input_tokens: int
    reserved: int = 0

    def __post_init__(self):
        if self.max_input_tokens < 1 or self.reserved < 0 or self.kind == "Auto":
            raise ValueError(f"not a model's limits: {self}")


@dataclass(frozen=True)
class Profile:
    kind: str
    model: str
    max_input_tokens: int
    reserved: int
    effective_input_budget: int
    source: str
    used_fallback: bool = False
    metadata: Mapping[str, str] = field(default_factory=dict)


_CL, _O2, _WP = ("Cl100kBase", "cl100k_base"), ("O200kBase", "o200k_base"), ("BertWordPiece", "bert-base-uncased")
#: Model key -> (tokenizer, most input tokens, tokens kept for markers).
_SEED = {
    "text-embedding-3-large": (_CL, 8191, 0),
    "text-embedding-3-small": (_CL, 8191, 0),
    "text-embedding-ada-002": (_CL, 8191, 0),
    "nomic-embed-text": (_WP, 2048, 2),
    "nomic-embed": (_WP, 2048, 2),
    "all-minilm-l6-v2": (_WP, 256, 2),
    "all-minilm-l12-v2": (_WP, 256, 2),
    "paraphrase-minilm": (_WP, 128, 2),
    "all-minilm": (_WP, 256, 2),
    "minilm": (_WP, 256, 2),
    "all-mpnet-base-v2": (_WP, 384, 2),
    "multi-qa-mpnet-base": (_WP, 512, 2),
    "mpnet": (_WP, 384, 2),
    "mxbai-embed-large": (_WP, 512, 2),
    "mxbai-embed": (_WP, 512, 2),
    "bge-m3": (_WP, 8192, 2),
    "bge-large": (_WP, 512, 2),
    "bge-base": (_WP, 512, 2),
    "bge-small": (_WP, 512, 2),
    "bge": (_WP, 512, 2),
    "gte-large": (_WP, 512, 2),
    "gte-base": (_WP, 512, 2),
    "gte-small": (_WP, 512, 2),
    "gte": (_WP, 512, 2),
    "multilingual-e5": (_WP, 512, 2),
    "e5-large": (_WP, 512, 2),
    "e5-base": (_WP, 512, 2),
    "e5-small": (_WP, 512, 2),
}
#: Name parts and prefixes that give a tokenizer away.
BERT_PARTS = ("bert", "minilm", "mpnet", "nomic", "mxbai", "e5", "gte", "bge")
O200K_PREFIXES = ("gpt-4o", "gpt-4.1", "gpt-5", "chatgpt-4o", "o1", "o3", "o4")
PROVIDER_LIMIT, GEMINI_LIMIT, BERT_LIMIT, BERT_RESERVED = 8192, 2048, 512, 2

KNOWN_MODELS: Mapping[str, Entry] = MappingProxyType({k: Entry(*t, n, r) for k, (t, n, r) in _SEED.items()})
_BERT = Entry(*_WP, BERT_LIMIT, BERT_RESERVED)
_FALLBACK = Entry(*_CL, PROVIDER_LIMIT)
_KIND_MODEL = {kind: model for kind, model in (_CL, _O2, _WP)}


def with_known_model(key: str, entry: Entry, registry: Mapping[str, Entry] = KNOWN_MODELS) -> dict[str, Entry]:
    """A registry with one more model; registries are values that are passed on, not state of the process."""
    key = (key or "").strip().lower()
    if not key:
        raise ValueError("a model needs a key")
    return {**registry, key: entry}


def normalise_model_id(model: str | None) -> str:
    value = (model or "").strip().lower()
    head, slash, tail = value.rpartition("/")
    return (tail if slash and tail else value).split(":", 1)[0]


def is_bert_like(model: str | None) -> bool:
    return any(part in (model or "").lower() for part in BERT_PARTS)


def is_o200k(model: str | None) -> bool:
    value = (model or "").strip().lower()
    return "o200k" in value or value.startswith(O200K_PREFIXES)


def known_model(model: str | None, registry: Mapping[str, Entry] = KNOWN_MODELS) -> Entry | None:
    """The entry with the longest key inside the normalised id; the first one on ties."""
    name = normalise_model_id(model)
    hits = [key for key in registry if name and key in name]
    return registry[max(hits, key=len)] if hits else None


def provider_default(api_format: str, model: str | None) -> Entry | None:
    if api_format in ("OpenAI", "VLLM"):
        return Entry(*(_O2 if is_o200k(model) else _CL), PROVIDER_LIMIT)
    if api_format == "Gemini":
        return Entry(*_CL, GEMINI_LIMIT)
    if is_bert_like(model):
        return _BERT
    if api_format == "Ollama":
        return _FALLBACK
    return Entry(*_O2, PROVIDER_LIMIT) if is_o200k(model) else None


def resolve(options: ChunkingOptions, registry: Mapping[str, Entry] = KNOWN_MODELS, probe: Callable | None = None, tokenizer=None) -> Profile:
    """Fallback, then known model or provider rule, then the kind asked for, then the budget asked for, then the probe."""
    found, source = known_model(options.model_id, registry), "KnownModel"
    if found is None:
        found, source = provider_default(options.api_format, options.model_id), "ProviderDefault"
    entry = found or _FALLBACK
    source = source if found else "GlobalFallback"
    reserved = entry.reserved
    if options.tokenizer_kind != "Auto":
        kind = options.tokenizer_kind
        reserved = BERT_RESERVED if kind == "BertWordPiece" else 0
        most = found.max_input_tokens if found else (BERT_LIMIT if kind == "BertWordPiece" else PROVIDER_LIMIT)
        entry, source = Entry(kind, _KIND_MODEL[kind], most, reserved), "Override"
    budget = max(1, entry.max_input_tokens - entry.reserved)
    if options.effective_input_budget is not None:
        budget, source = min(max(1, options.effective_input_budget), entry.max_input_tokens), "Override"
        reserved = entry.max_input_tokens - budget
    # a provider's rule is a guess at the model, too
    profile = Profile(entry.kind, entry.model, entry.max_input_tokens, reserved, budget, source, source in ("GlobalFallback", "ProviderDefault"))
    if probe is not None and options.allow_calibration and options.effective_input_budget is None:
        try:
            measured = probe(profile, tokenizer)
        except (KeyboardInterrupt, SystemExit):
            raise
        except Exception as e:
            raise TokenizerResolution("the calibration probe failed") from e
        if measured is not None:
            most = max(1, min(int(measured), entry.max_input_tokens))
            profile = replace(profile, effective_input_budget=most, reserved=entry.max_input_tokens - most, source="Calibration", used_fallback=False)
    return profile


def chunk_budget(options: ChunkingOptions, profile: Profile) -> int:
    """Tokens that a chunk may have, the prefix included."""
    eff = profile.effective_input_budget
    margin = options.safety_margin_tokens + math.ceil(eff * options.safety_margin_percentage)
    return max(1, min(options.max_tokens, max(1, eff - margin)))


def working_budget(options: ChunkingOptions, profile: Profile, count: Callable[[str], int]) -> int:
    """What the prefix leaves of the budget."""
    return max(1, chunk_budget(options, profile) - (count(options.context_prefix) if options.context_prefix else 0))


def registry_frame(spark, registry: Mapping[str, Entry] = KNOWN_MODELS) -> DataFrame:
    rows = [(k, i, e.kind, e.model, e.max_input_tokens, e.reserved) for i, (k, e) in enumerate(registry.items())]
    return spark.createDataFrame(rows, "key string, ord int, kind string, tokenizer_model string, max_input_tokens int, reserved int")


def resolve_models(df: DataFrame, registry: DataFrame, model: str = "model_id") -> DataFrame:
    """*df* with the known model of each id: key, kind, max_input_tokens and budget (null if there is none).

    Distinct ids only meet the registry, which is broadcast by Spark's own size rule.
    """
    value = F.lower(F.trim(F.coalesce(F.col(model), F.lit(""))))
    tail = F.regexp_extract(value, r"([^/]+)$", 1)
    name = F.split(F.when(value.contains("/") & (tail != ""), tail).otherwise(value), ":")[0]
    ids = df.select(model).distinct().withColumn("_name", name)
    hits = ids.join(registry, F.col("_name").contains(F.col("key")) & (F.col("_name") != ""))
    best = hits.groupBy(model).agg(F.max_by(F.struct("key", "kind", "max_input_tokens", "reserved"), F.struct(F.length("key"), -F.col("ord"))).alias("_b"))
    out = df.join(best.withColumnRenamed(model, "_id"), F.col(model).eqNullSafe(F.col("_id")), "left")
    return out.select(*df.columns, F.col("_b.key").alias("key"), F.col("_b.kind").alias("kind"), F.col("_b.max_input_tokens").alias("max_input_tokens"), (F.col("_b.max_input_tokens") - F.col("_b.reserved")).alias("effective_budget"))
