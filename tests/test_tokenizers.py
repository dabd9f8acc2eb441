import pytest

from loomspark.functions import tokenizers
from loomspark.functions.tokenizers import PassThrough, Spec, WordPieceOptions, WordPieceTokenizer, WordTokenizer, public_bpe
from loomspark.options import ChunkingOptions, TokenizerResolution

VOCABULARY = ["[PAD]", "[UNK]", "hello", "Hello", "world", "##s", "!"]


def test_words():
    t = WordTokenizer()
    assert t.count("") == t.count(None) == 0
    assert t.encode("a 漢字b　c") == ["a", "漢", "字", "b", "c"]
    assert t.slice_tokens("one  two three", 1, 2) == "two three"
    assert t.slice_tokens("one", 5, 1) == t.slice_tokens("one", 0, 0) == ""
    with pytest.raises(ValueError):
        t.slice_tokens("one", -1, 1)


def test_bpe():
    t = public_bpe().build()
    assert (t.count("hello world"), t.count("The quick brown fox")) == (2, 4)
    text = "naïve 😀 café <|endoftext|>"
    assert t.decode(t.encode(text)) == text
    n = t.count(text)
    assert "".join(t.slice_tokens(text, i, 1) for i in range(n)) == text


def test_wordpiece():
    t = WordPieceTokenizer(VOCABULARY)
    assert t.encode("Hello worlds!") == [2, 4, 5, 6]
    assert t.decode(t.encode("Hello worlds!")) == "hello worlds !"
    assert t.encode("héllo\x0bworld\x85world") == [2, 4, 4]
    assert t.encode("zzz") == [1]
    assert t.slice_tokens("Hello  worlds!", 1, 2) == "worlds"
    assert WordPieceTokenizer(VOCABULARY, WordPieceOptions(lower_case=False)).encode("Hello") == [3]
    assert t.count("he\u200bllo \0") == 1
    with pytest.raises(ValueError):
        t.decode([99])
    for bad in ([], ["a"]):
        with pytest.raises(TokenizerResolution):
            WordPieceTokenizer(bad)


def test_pass_through_and_specs():
    class Inner:
        def encode(self, text):
            return [ord(c) for c in text]

        def decode(self, ids):
            return "".join(map(chr, ids))

    t = PassThrough(Inner())
    assert t.count("abc") == 3 and t.slice_tokens("abc", 1, 5) == "bc"
    assert Spec().build() is Spec().build()
    with pytest.raises(TokenizerResolution):
        Spec("nope").build()


def test_compatibility_ideographs_are_normalised_first():
    from loomspark.functions.tokenizers import WordPieceTokenizer

    t = WordPieceTokenizer(["[UNK]", "豈", "a"])
    assert t.encode("a豈a") == [2, 1, 2]


def test_ascii_words_are_cut_as_character_by_character(monkeypatch):
    import random

    from loomspark.functions import tokenizers

    t = tokenizers.WordPieceTokenizer(["[UNK]", "ab", "a", "##b", "##a", "b", "!", "-", "0", "##0"])
    rng = random.Random(4)
    texts = ["".join(rng.choice("abAB0 !-\t\n") for _ in range(rng.randrange(60))) for _ in range(300)]
    fast = [t.tokenize(x) for x in texts]
    monkeypatch.setattr(tokenizers, "_UNUSUAL", tokenizers.re.compile(""))
    assert [t.tokenize(x) for x in texts] == fast


def _odd_texts():
    import random

    rng = random.Random(5)
    parts = ["a", "The", " ", "  ", "\n\n", ". ", "'s", "'re ", "12", "é", "中文", "。", "\u3000", "\xa0", "\x1c", "😀", "don't ", "x" * 30, "\t"]
    return ["".join(rng.choice(parts) for _ in range(n)) for n in (1, 9, 40, 40, 40)] + ["it's   \n\n\n x y z and so on", "  lead and trail  \n"]


def test_cut_counts_every_slice_as_it_is(monkeypatch):
    tok = public_bpe().build()
    for stretch in (1 << 20, 7):
        monkeypatch.setattr(tokenizers, "_STRETCH", stretch)
        monkeypatch.setattr(tokenizers, "SHORT", 2)
        for text in _odd_texts():
            count = tokenizers.BpeCut(text, tok._costs).counter()
            assert all(count(a, b) == tok.count(text[a:b]) for a in range(len(text)) for b in range(a, len(text) + 1)), text


def test_chunks_of_a_cut_text_are_those_of_counting(monkeypatch):
    from loomspark.operators.spans import Chunker

    tok = public_bpe().build()
    texts = [*_odd_texts(), *("One two three. " * n + " four  five\n\n" * 9 for n in (5, 40))]
    options = [ChunkingOptions(strategy=s, max_tokens=n, overlap_count=k) for s in ("FixedTokenCount", "SentenceBased", "ParagraphBased", "Recursive") for n, k in ((3, 0), (7, 2), (40, 12), (128, 0))]
    run = lambda: [Chunker(t, tok, o).chunk(0, len(t), o.max_tokens) for t in texts for o in options]
    cut = run()
    monkeypatch.setattr(tokenizers.BpeTokenizer, "cut", lambda self, text: None)
    assert run() == cut
