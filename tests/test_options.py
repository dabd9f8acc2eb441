import pytest

from loomspark import budget
from loomspark.options import ChunkingOptions, InvalidChunkingOptions, TokenizerResolution
from loomspark.plans.contract import options_from


@pytest.mark.parametrize("bad", [{"max_tokens": 0}, {"overlap_count": -1}, {"overlap_percentage": 1.1}, {"overlap_characters": -1}, {"row_group_size": 0}, {"safety_margin_percentage": 0.6}, {"strategy": "Nope"}, {"regex_timeout_ms": 0}, {"header_context_separator": None}, {"min_chunk_tokens": -1}, {"max_input_characters": -1}])
def test_bad_options(bad):
    with pytest.raises(InvalidChunkingOptions):
        ChunkingOptions(**bad)


def test_presets_and_copies():
    assert (ChunkingOptions.for_rag().max_tokens, ChunkingOptions.for_rag().overlap_count) == (512, 64)
    assert ChunkingOptions.for_summarization().strategy == "ParagraphBased"
    assert ChunkingOptions.for_large_context().max_tokens == 2048
    assert ChunkingOptions().but(max_tokens=3).max_tokens == 3
    assert ChunkingOptions(separators=("x",), format="Markdown").ladder == ("x",)


@pytest.mark.parametrize(
    "options, kind, most, eff, source",
    [
        ({}, "Cl100kBase", 8192, 8192, "GlobalFallback"),
        ({"model_id": "all-minilm"}, "BertWordPiece", 256, 254, "KnownModel"),
        ({"model_id": "sentence-transformers/all-MiniLM-L6-v2:latest"}, "BertWordPiece", 256, 254, "KnownModel"),
        ({"model_id": "text-embedding-3-small"}, "Cl100kBase", 8191, 8191, "KnownModel"),
        ({"model_id": "gpt-4o", "api_format": "OpenAI"}, "O200kBase", 8192, 8192, "ProviderDefault"),
        ({"model_id": "openai/gpt-4o"}, "Cl100kBase", 8192, 8192, "GlobalFallback"),
        ({"api_format": "Gemini"}, "Cl100kBase", 2048, 2048, "ProviderDefault"),
        ({"api_format": "Ollama", "model_id": "my-bert"}, "BertWordPiece", 512, 510, "ProviderDefault"),
        ({"tokenizer_kind": "Cl100kBase", "model_id": "all-minilm"}, "Cl100kBase", 256, 256, "Override"),
        ({"model_id": "all-minilm", "effective_input_budget": 9999}, "BertWordPiece", 256, 256, "Override"),
    ],
)
def test_resolution(options, kind, most, eff, source):
    p = budget.resolve(ChunkingOptions(**options))
    assert (p.kind, p.max_input_tokens, p.effective_input_budget, p.source) == (kind, most, eff, source)


@pytest.mark.parametrize("options, expected", [({}, 254), ({"safety_margin_percentage": 0.04}, 243), ({"safety_margin_tokens": 15}, 239), ({"max_tokens": 100}, 100), ({"safety_margin_tokens": 5000}, 1)])
def test_margins(options, expected):
    o = ChunkingOptions(model_id="all-minilm", **options)
    assert budget.chunk_budget(o, budget.resolve(o)) == expected


def test_probe():
    o = ChunkingOptions(model_id="all-minilm")
    p = budget.resolve(o, probe=lambda profile, tok: 100)
    assert (p.effective_input_budget, p.source) == (100, "Calibration")
    assert budget.resolve(o.but(allow_calibration=False), probe=lambda *_: 100).source == "KnownModel"
    with pytest.raises(TokenizerResolution):
        budget.resolve(o, probe=lambda *_: 1 // 0)


def test_registry_is_a_value():
    mine = budget.with_known_model("My-Model", budget.Entry("O200kBase", "x", 77))
    assert budget.known_model("org/my-model-v2", mine).max_input_tokens == 77
    assert budget.known_model("org/my-model-v2") is None


def test_options_from_json():
    o = options_from({"maxTokens": 9, "strategy": "recursive", "OverlapCount": 2})
    assert (o.max_tokens, o.strategy, o.overlap_count) == (9, "Recursive", 2)
    for bad in ({"strategy": ""}, {"strategy": 3}, {"strategy": "x"}, {"nope": 1}):
        with pytest.raises(InvalidChunkingOptions):
            options_from(bad)


def test_fallback_flag_and_reserved_tokens():
    from loomspark.budget import resolve

    assert resolve(ChunkingOptions(api_format="OpenAI", model_id="x")).used_fallback and resolve(ChunkingOptions()).used_fallback
    assert not resolve(ChunkingOptions(model_id="all-minilm")).used_fallback and not resolve(ChunkingOptions(tokenizer_kind="O200kBase")).used_fallback
    fixed = resolve(ChunkingOptions(model_id="all-minilm", effective_input_budget=100))
    assert (fixed.reserved, fixed.effective_input_budget, fixed.used_fallback) == (156, 100, False)
