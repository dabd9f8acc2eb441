"""Chunking options, their domains and presets, and the package's errors."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


class InvalidChunkingOptions(ValueError):
    """An option, or a combination of options and input, isn't allowed."""


class TokenizerResolution(RuntimeError):
    """A tokenizer or a token budget can't be resolved."""


class ChunkingError(RuntimeError):
    """Chunking failed for a reason that isn't the options'."""


STRATEGIES = ("FixedTokenCount", "SentenceBased", "ParagraphBased", "RegexBased", "Recursive", "WholeList", "ListEntry", "Row", "RowWithHeaders", "RowGroupWithHeaders", "KeyValuePairs", "WholeTable")
TABLE_STRATEGIES = STRATEGIES[7:]
CONTENT_TYPES = ("Text", "List", "Binary", "Table", "Unknown", "Image", "Hyperlink", "Code", "Meta", "Summary")
OVERLAP_STRATEGIES = ("SlidingWindow", "SentenceBoundaryAware", "SemanticBoundaryAware")
TOKENIZER_KINDS = ("Auto", "Cl100kBase", "O200kBase", "BertWordPiece")
API_FORMATS = ("Unknown", "OpenAI", "VLLM", "Gemini", "Ollama")
SMALL_CHUNK_MODES = ("Keep", "MergeForward", "Drop")
FILE_ACCESS_MODES = ("Exclusive", "SharedRead", "SharedReadWrite")
PROFILE_SOURCES = ("Override", "Calibration", "KnownModel", "ProviderDefault", "GlobalFallback")

#: Separators from coarse to fine; the empty one means a token window.
SEPARATORS = {
    "Plain": ("\n\n", "\n", ". ", " ", ""),
    "Markdown": ("\n# ", "\n## ", "\n### ", "\n#### ", "\n##### ", "\n###### ", "\n```", "\n\n", "\n", ". ", " ", ""),
    "CSharp": ("\nnamespace ", "\nclass ", "\ninterface ", "\nstruct ", "\nenum ", "\nrecord ", "\npublic ", "\nprivate ", "\nprotected ", "\ninternal ", "\nstatic ", "\n\n", "\n", " ", ""),
    "Python": ("\nclass ", "\ndef ", "\n\tdef ", "\n    def ", "\n\n", "\n", " ", ""),
    "JavaScript": ("\nfunction ", "\nexport ", "\nconst ", "\nlet ", "\nvar ", "\nclass ", "\nif ", "\nfor ", "\nwhile ", "\n\n", "\n", " ", ""),
    "Java": ("\nclass ", "\ninterface ", "\nenum ", "\nrecord ", "\npublic ", "\nprivate ", "\nprotected ", "\nstatic ", "\n\n", "\n", " ", ""),
}
FORMATS = tuple(SEPARATORS)
_DOMAINS = {
    "strategy": STRATEGIES,
    "input_type": CONTENT_TYPES,
    "overlap_strategy": OVERLAP_STRATEGIES,
    "tokenizer_kind": TOKENIZER_KINDS,
    "api_format": API_FORMATS,
    "format": FORMATS,
    "small_chunk_mode": SMALL_CHUNK_MODES,
}
_RANGES = {
    "max_tokens": (1, None),
    "overlap_count": (0, None),
    "overlap_percentage": (0, 1),
    "overlap_characters": (0, None),
    "row_group_size": (1, None),
    "safety_margin_tokens": (0, None),
    "safety_margin_percentage": (0, 0.5),
    "min_chunk_tokens": (0, None),
    "max_input_characters": (0, None),
    "regex_timeout_ms": (1, None),
}


@dataclass(frozen=True)
class ChunkingOptions:
    """Settings of one chunking operation. Frozen: change a copy with :meth:`but`."""

    strategy: str = "FixedTokenCount"
    input_type: str = "Text"
    max_tokens: int = 512
    overlap_count: int = 0
    overlap_percentage: float | None = None
    overlap_characters: int | None = None
    overlap_strategy: str = "SlidingWindow"
    row_group_size: int = 5
    regex_pattern: str | None = None
    context_prefix: str | None = None
    tokenizer_kind: str = "Auto"
    model_id: str | None = None
    api_format: str = "Unknown"
    effective_input_budget: int | None = None
    safety_margin_tokens: int = 0
    safety_margin_percentage: float = 0.0
    allow_calibration: bool = True
    compute_token_counts: bool = True
    compute_offsets: bool = True
    compute_hashes: bool = False
    separators: tuple[str, ...] | None = None
    format: str = "Plain"
    contextualize_headers: bool = False
    hierarchy_aware: bool = False
    header_context_separator: str = " > "
    small_chunk_mode: str = "Keep"
    min_chunk_tokens: int = 0
    trim_whitespace: bool = True
    max_input_characters: int = 4_000_000
    regex_timeout_ms: int = 5000
    parent_id: str | None = None

    def __post_init__(self):
        for name, allowed in _DOMAINS.items():
            if getattr(self, name) not in allowed:
                raise InvalidChunkingOptions(f"{name}: {getattr(self, name)!r} is none of {', '.join(allowed)}")
        for name, (least, most) in _RANGES.items():
            value = getattr(self, name)
            if value is None and name in ("overlap_percentage", "overlap_characters"):
                continue
            if value is None or not (value >= least and (most is None or value <= most)):
                raise InvalidChunkingOptions(f"{name}: {value!r} isn't {f'from {least} to {most}' if most is not None else f'at least {least}'}")
        if self.header_context_separator is None:
            raise InvalidChunkingOptions("header_context_separator is null")
        if self.separators is not None:
            object.__setattr__(self, "separators", tuple(self.separators))

    def but(self, **changes) -> ChunkingOptions:
        return replace(self, **changes)

    @property
    def ladder(self) -> tuple[str, ...]:
        """The separators in use: explicit ones win over the format's."""
        return self.separators or SEPARATORS[self.format]

    @classmethod
    def for_rag(cls) -> ChunkingOptions:
        return cls(max_tokens=512, overlap_count=64)

    @classmethod
    def for_summarization(cls) -> ChunkingOptions:
        return cls(strategy="ParagraphBased", max_tokens=1024)

    @classmethod
    def for_large_context(cls) -> ChunkingOptions:
        return cls(max_tokens=2048)

    @classmethod
    def names(cls) -> list[str]:
        return [f.name for f in fields(cls)]
