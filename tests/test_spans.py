import random

import pytest

from loomspark.functions.tokenizers import WHITE, WordTokenizer, public_bpe
from loomspark.operators.chunk import _worker
from loomspark.operators.spans import Chunker, pack_strings
from loomspark.functions.tokenizers import Spec
from loomspark.options import ChunkingOptions, InvalidChunkingOptions

PROSE = (
    "The quick brown fox jumps over the lazy dog. The dog was not amused by the fox. It had been sleeping soundly for hours before the interruption occurred.\n\n"
    "Meanwhile, a second paragraph describes an entirely different scene. Rain fell on the quiet town. Streets emptied as people retreated indoors to wait out the storm.\n\n"
    "A final paragraph closes the sample. Chunking must preserve every meaningful word. Determinism matters more than anything else in this pipeline."
)


def pieces(text, spec=None, **options):
    o = ChunkingOptions(**options)
    return _worker(spec or Spec(), o, o.max_tokens, "text")(text)["pieces"]


def texts(text, **options):
    return [p["text"] for p in pieces(text, **options)]


def test_windows():
    words = " ".join(f"word{i}" for i in range(10))
    assert texts(words, max_tokens=4) == ["word0 word1 word2 word3", "word4 word5 word6 word7", "word8 word9"]
    assert texts(words, max_tokens=4, overlap_count=2)[1] == "word2 word3 word4 word5"
    assert texts(words, max_tokens=4, overlap_count=9)[1] == "word1 word2 word3 word4"
    assert texts(words, max_tokens=4, overlap_count=2, overlap_percentage=0.0) == texts(words, max_tokens=4)
    assert texts("", max_tokens=4) == texts(" \n", max_tokens=4) == []


def test_boundary_aware_overlap():
    text = "a b. c d e f. g h i j k l"
    assert texts(text, max_tokens=6, overlap_count=3, overlap_strategy="SentenceBoundaryAware")[1].startswith("c d e f.")
    text = "a b c\n\nd e f g h i j"
    assert texts(text, max_tokens=5, overlap_count=1, overlap_strategy="SemanticBoundaryAware")[1].startswith("d e f")


def test_sentences_and_paragraphs():
    assert texts("One two. Three four! Five?", strategy="SentenceBased", max_tokens=2) == ["One two.", "Three four!", "Five?"]
    assert texts(PROSE, strategy="ParagraphBased", max_tokens=40)[0].startswith("The quick")
    assert len(texts(PROSE, strategy="ParagraphBased", max_tokens=40)) == 3
    # a tail of less than a quarter of the limit is evened out
    assert texts("a b c. d e f. g h i. j.", strategy="SentenceBased", max_tokens=9) == ["a b c. d e f.", "g h i. j."]


def test_recursive():
    from_bpe = [p["text"] for p in pieces(PROSE, public_bpe(), strategy="Recursive", max_tokens=24)]
    assert from_bpe[0] == "The quick brown fox jumps over the lazy dog. The dog was not amused by the fox."
    assert len(from_bpe) == 6
    code = "import x\nclass A:\n  pass\nclass B:\n  pass"
    assert texts(code, strategy="Recursive", format="Python", max_tokens=3) == ["import x", "class A:\n  pass", "class B:\n  pass"]


def test_regex():
    assert texts("alpha;;beta;;gamma;;delta", strategy="RegexBased", regex_pattern=";;") == ["alpha", "beta", "gamma", "delta"]
    assert texts("a1b2c", strategy="RegexBased", regex_pattern=r"(\d)") == ["a", "1", "b", "2", "c"]
    for bad in (None, "("):
        with pytest.raises(InvalidChunkingOptions):
            texts("abc", strategy="RegexBased", regex_pattern=bad)
    with pytest.raises(TimeoutError):
        texts("a" * 60 + "b", strategy="RegexBased", regex_pattern="(a|aa)+$", regex_timeout_ms=200)


def test_hierarchy():
    md = "# Guide\r\nIntro.\r\n## Setup\r\nDo it.\r\n## Use ##\r\nGo."
    found = pieces(md, hierarchy_aware=True, max_tokens=64)
    assert [(p["header_context"], p["text"]) for p in found] == [("Guide", "Intro."), ("Guide > Setup", "Do it."), ("Guide > Use", "Go.")]
    both = pieces(md, hierarchy_aware=True, contextualize_headers=True, max_tokens=64)
    assert both[1]["text"] == "Guide > Setup\n\nDo it." and both[1]["start_offset"] == -1


def test_small_chunks_and_trim():
    text = "Tiny.\n\nAlso tiny."
    assert texts(text, strategy="RegexBased", regex_pattern="\n\n", small_chunk_mode="MergeForward", min_chunk_tokens=2, max_tokens=9) == [text]
    assert texts("a b. c. d e.", strategy="SentenceBased", max_tokens=2, small_chunk_mode="Drop", min_chunk_tokens=2) == ["a b.", "d e."]
    p = pieces("  padded text  ", strategy="WholeList")[0]
    assert (p["text"], p["start_offset"], p["end_offset"]) == ("padded text", 2, 13)


def test_long_words_and_graphemes():
    family = "👨‍👩‍👧é🇫🇷"
    spec = public_bpe()
    found = pieces(family * 30, spec, max_tokens=16)
    assert "".join(p["text"] for p in found) == family * 30
    assert all(p["token_count"] <= 16 for p in found)
    assert all(not p["text"].startswith(("‍", "́")) for p in found)


def test_pack_strings():
    t = WordTokenizer()
    assert pack_strings(["a b", " ", "c", "d e f g", "h"], ", ", 3, t.count, lambda s: s.split()) == ["a b, c", "d", "e", "f", "g", "h"]


ALPHABET = "ab cd. efg! h\n\t é ñ 中 ,?"
STRATEGIES = ("FixedTokenCount", "SentenceBased", "ParagraphBased", "Recursive", "WholeList", "ListEntry")


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_invariants_on_random_text(strategy):
    rng = random.Random(20260921)
    spec = public_bpe()
    for _ in range(40):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1500)))
        limit, overlap = rng.randrange(8, 80), rng.choice((0, 0, 1, 5))
        found = pieces(text, spec, strategy=strategy, max_tokens=limit, overlap_count=overlap)
        covered, last = set(), (-1, -1)
        for p in found:
            a, b = p["start_offset"], p["end_offset"]
            assert text[a:b] == p["text"]
            assert p["token_count"] <= limit or len(p["text"]) == 1
            assert a > last[0] and b > last[1]
            last = a, b
            covered.update(range(a, b))
        assert all(i in covered for i, c in enumerate(text) if c not in WHITE)


def test_counting_is_memoised():
    class Counting(WordTokenizer):
        calls = 0

        def count(self, text):
            Counting.calls += 1
            return super().count(text)

    ch = Chunker("a b a b a b", Counting(), ChunkingOptions(max_tokens=2))
    ch.window(0, 11, 2)
    calls = Counting.calls
    ch.window(0, 11, 2)
    assert Counting.calls == calls


def test_bpe_windows_against_brute_force():
    """Each window takes words while the text from its first to its last word fits."""
    from loomspark.functions.tokenizers import UNIT

    tok = public_bpe().build()
    for overlap in (0, 12):
        words = [m.span() for m in UNIT.finditer(PROSE)]
        costs = [tok.count(PROSE[(words[i - 1][1] if i else 0) : words[i][1]]) for i in range(len(words))]
        want, at = [], 0
        while True:
            to = max(e for e in range(at + 1, len(words) + 1) if e == at + 1 or tok.count(PROSE[words[at][0] : words[e - 1][1]]) <= 24)
            want.append(PROSE[words[at][0] : words[to - 1][1]])
            if to == len(words):
                break
            back = to
            while back - 1 > at and sum(costs[back - 1 : to]) <= overlap:
                back -= 1
            at = back
        assert [p["text"] for p in pieces(PROSE, public_bpe(), max_tokens=24, overlap_count=overlap)] == want
