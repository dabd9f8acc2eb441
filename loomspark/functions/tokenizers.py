"""Tokenizers behind one small protocol: count, encode, decode and slice_tokens.

Executors get a picklable factory (:class:`Spec`) and build the tokenizer once in a worker. ``word`` is additive: the
tokens of a text are its words, each CJK ideograph being one, so its windows have a closed form that Catalyst
can compute; the others decide boundaries only by counting real text.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from loomspark.options import TokenizerResolution

#: The white space that trimming and splitting know.
WHITE = "\t\n\v\f\r \x85\xa0                　"
#: Ranges of ideographs, each of which is a word.
CJK = "一-鿿㐀-䶿\U00020000-\U0002a6df\U0002a700-\U0002ceaf豈-﫿\U0002f800-\U0002fa1f"
UNIT = re.compile(f"[{CJK}]|[^{WHITE}{CJK}]+")


class WordTokenizer:
    """Each word or ideograph is a token; ids are places in the text's own list of distinct words."""

    additive = True

    def count(self, text: str | None) -> int:
        return len(UNIT.findall(text)) if text else 0

    def encode(self, text: str | None) -> list[str]:
        return UNIT.findall(text) if text else []

    def decode(self, tokens: Sequence[str]) -> str:
        return " ".join(tokens)

    def slice_tokens(self, text: str | None, start: int, n: int) -> str:
        return _slice([m.span() for m in UNIT.finditer(text or "")], text, start, n)


def _slice(spans: Sequence[tuple[int, int]], text: str | None, start: int, n: int) -> str:
    """The text from the first to the last of n tokens."""
    if start < 0:
        raise ValueError("a slice starts at token 0 or later")
    own = spans[start : start + n] if n > 0 else []
    return text[own[0][0] : own[-1][1]] if own else ""


#: The pattern of the public byte-pair vocabulary. Its \\s is WHITE.
_PUBLIC_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space by code point; the last entry stands for all later ones.
_IS_WHITE = np.isin(np.arange(0x3002), [ord(c) for c in WHITE])
_WORD_END, _IDEOGRAPH = re.compile(f"[^{WHITE}](?=[{WHITE}])"), re.compile(f"[{CJK}]")
_GAP_AND_WORD = re.compile(f"[{WHITE}]*[^{WHITE}]+")
#: Characters that are cut at a time, up to the next end of a word; slices of up to so many are counted by themselves.
_STRETCH, SHORT = 1 << 20, 16
#: Entries that a table of counts has at most.
_HELD = 200_000


class _Counts(dict):
    """Tokens of strings, counted once each; long ones and those that the table has no room for aren't kept."""

    def __init__(self, count: Callable[[str], int]):
        self._count = count

    def __missing__(self, s: str) -> int:
        n = self._count(s)
        if len(s) <= 64 and len(self) < _HELD:
            self[s] = n
        return n


class BpeCut:
    """Token counts of slices of a text from the counts of its words, for the public pattern.

    The pattern looks back at nothing, and ahead only past white space; a piece has white space at its start at most, or is
    nothing else. So the end of a word (here: all up to white space) is an edge of pieces in the text and in every slice that
    goes past it, and between two such ends a slice has the text's own tokens. What is before the first and after the last
    is counted by itself, by *costs*. *memo* and *found* hold counts and
    parts that the options of a text share.
    """

    def __init__(self, text: str, costs: _Counts):
        self.text, self.starts, self.ends, self.total = text, array("i"), array("i"), array("i")
        self.costs, self.memo, self.found = costs, {}, {}
        self.plain = text.isascii() or not _IDEOGRAPH.search(text)
        at, before = 0, 0
        while at < len(text):
            m = _WORD_END.search(text, at + _STRETCH)
            to = m.end() if m else len(text)
            part = text[at:to]
            edges, total = _word_edges(part), np.cumsum(list(map(costs.__getitem__, _GAP_AND_WORD.findall(part))), dtype=np.int64)
            for column, more in ((self.starts, edges[::2] + at), (self.ends, edges[1::2] + at), (self.total, total + before)):
                column.frombytes(more.astype(np.intc).tobytes())
            at, before = to, self.total[-1] if self.total else 0

    def counter(self) -> Callable[[int, int], int]:
        """A function of the start and end of a slice to its tokens."""
        text, ends, total, costs, memo = self.text, self.ends, self.total, self.costs, self.memo
        n_words = len(ends)

        def count(a: int, b: int) -> int:
            if b - a <= SHORT:
                return costs[text[a:b]]
            n = memo.get((a, b))
            if n is not None:
                return n
            i = bisect_right(ends, a)
            if i == n_words or b <= ends[i]:
                return costs[text[a:b]]
            j = bisect_right(ends, b, i) - 1
            n = total[j] - total[i - 1] if i and ends[i - 1] == a else costs[text[a : ends[i]]] + total[j] - total[i]
            if b != ends[j]:
                n += costs[text[ends[j] : b]]
            if len(memo) < _HELD:
                memo[a, b] = n
            return n

        return count

    def words(self, start: int, end: int, limit: int, first: Callable[[int, int], int]) -> tuple[int, int, int] | None:
        """Range of the words of a slice and their tokens, *first* counting the first; None if some have to be cut."""
        i, j = bisect_right(self.ends, start), bisect_left(self.starts, end)
        if i >= j:
            return i, i, 0
        if not self.plain or self.starts[i] < start or self.ends[j - 1] > end:
            return None
        n, total = first(start, self.ends[i]), np.frombuffer(self.total, np.intc)[i:j]
        return None if n > limit or (j - i > 1 and np.diff(total).max() > limit) else (i, j, n + int(total[-1] - total[0]))


def _word_edges(part: str) -> np.ndarray:
    """Start and end of each word, by turns."""
    points = np.frombuffer(part.encode(), np.uint8) if part.isascii() else np.minimum(np.frombuffer(part.encode("utf-32-le"), np.uint32), len(_IS_WHITE) - 1)
    return np.flatnonzero(np.diff(_IS_WHITE[points], prepend=True, append=True))


class BpeTokenizer:
    """Byte-pair encoding from a rank file. Special strings in a text are ordinary text."""

    additive = False

    def __init__(self, ranks_path: str, pattern: str, name: str = "own"):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._enc = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._costs = _Counts(self.count) if pattern == _PUBLIC_PATTERN else None
        self._cut: BpeCut | None = None

    def count(self, text: str | None) -> int:
        return len(self._enc.encode_ordinary(text)) if text else 0

    def cut(self, text: str) -> BpeCut | None:
        """The cut of a text, kept for the next call with the same object; None for another pattern than the public one."""
        if self._costs is None:
            return None
        if self._cut is None or self._cut.text is not text:
            self._cut = BpeCut(text, self._costs)
        return self._cut

    def encode(self, text: str | None) -> list[int]:
        return self._enc.encode_ordinary(text) if text else []

    def decode(self, tokens: Sequence[int]) -> str:
        return self._enc.decode(list(tokens))

    def slice_tokens(self, text: str | None, start: int, n: int) -> str:
        """A token's characters are those that begin in its bytes, so slices side by side give back the text."""
        if not text:
            return _slice([], text, start, n)
        sizes, at, edges = [len(self._enc.decode_single_token_bytes(t)) for t in self.encode(text)], 0, [0]
        char_at = []
        for i, c in enumerate(text):
            char_at += [i] + [i + 1] * (len(c.encode()) - 1)
        char_at.append(len(text))
        for size in sizes:
            at += size
            edges.append(char_at[at])
        return _slice(list(zip(edges, edges[1:], strict=False)), text, start, n)


class PassThrough:
    """Any object with encode(text) -> ids (or an object with .ids) and decode(ids)."""

    additive = False

    def __init__(self, inner):
        self._inner = inner

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        found = self._inner.encode(text)
        return list(getattr(found, "ids", found))

    def count(self, text: str | None) -> int:
        return len(self.encode(text))

    def decode(self, tokens: Sequence[int]) -> str:
        return self._inner.decode(list(tokens))

    def slice_tokens(self, text: str | None, start: int, n: int) -> str:
        if start < 0:
            raise ValueError("a slice starts at token 0 or later")
        ids = self.encode(text)[start : start + n] if n > 0 else []
        return self.decode(ids).replace("�", "") if ids else ""


@dataclass(frozen=True)
class WordPieceOptions:
    lower_case: bool = True
    strip_accents: bool = True
    tokenize_cjk: bool = True
    max_word_characters: int = 0
    unknown_token: str = "[UNK]"


#: Ideographs for WordPiece, two more ranges than for words.
_WP_CJK = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))
_BREAK, _ALONE = 1, 2
#: Words and marks of printable ASCII; characters that are neither that nor ASCII white space.
_SIMPLE, _UNUSUAL = re.compile(r"[A-Za-z0-9]+|[!-/:-@\[-`{-~]"), re.compile(r"[^\t-\r -~]")


class WordPieceTokenizer:
    """Greedy longest-match word pieces.

    Text is cleaned code point by code point (cached): white space ends a word, control characters vanish,
    punctuation and ideographs stand alone, letters are lower-cased and lose their accents. Offsets of the pieces are
    those of the source.
    """

    additive = False

    def __init__(self, vocabulary: Sequence[str], options: WordPieceOptions = WordPieceOptions()):
        tokens = list(vocabulary)
        while tokens and not tokens[-1].strip():
            tokens.pop()
        if not tokens:
            raise TokenizerResolution("the vocabulary is empty")
        self.tokens, self.options, self.ids = tokens, options, {}
        for i, t in enumerate(tokens):
            self.ids.setdefault(t, i)
        if options.unknown_token not in self.ids:
            raise TokenizerResolution(f"the vocabulary has no {options.unknown_token}")
        self._longest = max(len(t) for t in tokens)
        self._clean = lru_cache(maxsize=1 << 16)(self._clean_one)
        self._pieces = lru_cache(maxsize=1 << 16)(self._split_word)

    @classmethod
    def from_file(cls, path: str, options: WordPieceOptions = WordPieceOptions()) -> WordPieceTokenizer:
        with open(path, encoding="utf-8") as f:
            return cls(f.read().splitlines(), options)

    def _clean_one(self, c: str) -> tuple[tuple[str, int], ...]:
        """(text, flag) parts that a character turns into."""
        if c in WHITE:
            return (("", _BREAK),)
        if c in "\0�" or unicodedata.category(c) in ("Cc", "Cf", "Cs", "Co", "Cn"):
            return ()
        o = self.options
        if c.isascii():
            return ((c.lower() if o.lower_case else c, 0 if c.isalnum() else _ALONE),)
        text = c.lower() if o.lower_case else c
        if o.strip_accents:
            text = "".join(x for x in unicodedata.normalize("NFD", text) if unicodedata.category(x) != "Mn")
        alone = o.tokenize_cjk and any(a <= ord(c) <= b for a, b in _WP_CJK)  # by the character itself, before it is normalised
        return tuple((x, _ALONE if alone or unicodedata.category(x)[0] == "P" else 0) for x in text)

    def _words(self, text: str):
        """(word, source start of each of its characters, source end of each)."""
        if not _UNUSUAL.search(text):  # cut at once: the same words, and their places as ranges
            for m in _SIMPLE.finditer(text):
                a, b = m.span()
                yield m[0].lower() if self.options.lower_case else m[0], range(a, b), range(a + 1, b + 1)
            return
        word, starts, ends = [], [], []
        for i, c in enumerate(text):
            for part, flag in self._clean(c):
                if flag and word:
                    yield "".join(word), starts, ends
                    word, starts, ends = [], [], []
                if flag == _ALONE:
                    yield part, [i], [i + 1]
                elif not flag:
                    word.append(part)
                    starts.append(i)
                    ends.append(i + 1)
        if word:
            yield "".join(word), starts, ends

    def _split_word(self, word: str) -> tuple[tuple[int, int, int], ...]:
        """(id, start, end) of the pieces of a word; one unknown token if any part has no piece."""
        unknown = ((self.ids[self.options.unknown_token], 0, len(word)),)
        if self.options.max_word_characters and len(word) > self.options.max_word_characters:
            return unknown
        out, at = [], 0
        while at < len(word):
            mark = "##" if at else ""
            for end in range(min(len(word), at + self._longest), at, -1):
                found = self.ids.get(mark + word[at:end])
                if found is not None:
                    out.append((found, at, end))
                    at = end
                    break
            else:
                return unknown
        return tuple(out)

    def tokenize(self, text: str | None) -> list[tuple[int, int, int]]:
        """(id, source start, source end) of every piece."""
        return [(i, starts[a], ends[b - 1]) for word, starts, ends in self._words(text or "") for i, a, b in self._pieces(word)]

    def count(self, text: str | None) -> int:
        return sum(len(self._pieces(word)) for word, _, _ in self._words(text or ""))

    def encode(self, text: str | None) -> list[int]:
        return [t[0] for t in self.tokenize(text)]

    def decode(self, tokens: Sequence[int]) -> str:
        out = ""
        for i in tokens:
            if not 0 <= i < len(self.tokens):
                raise ValueError(f"{i} is no token id")
            t = self.tokens[i]
            out += t[2:] if t.startswith("##") and out else (" " if out else "") + t
        return out

    def slice_tokens(self, text: str | None, start: int, n: int) -> str:
        return _slice([t[1:] for t in self.tokenize(text)], text, start, n)


@dataclass(frozen=True)
class Spec:
    """A picklable recipe for a tokenizer: word, bpe, wordpiece, json or sentencepiece, with its arguments."""

    kind: str = "word"
    args: tuple = field(default_factory=tuple)

    def build(self):
        return _built(self)


@lru_cache(maxsize=16)
def _built(spec: Spec):
    if spec.kind == "word":
        return WordTokenizer()
    if spec.kind == "bpe":
        return BpeTokenizer(*spec.args)
    if spec.kind == "wordpiece":
        return WordPieceTokenizer(*spec.args) if not isinstance(spec.args[0], str) else WordPieceTokenizer.from_file(*spec.args)
    if spec.kind == "json":
        from tokenizers import Tokenizer

        inner = Tokenizer.from_file(*spec.args)
        return PassThrough(type("Plain", (), {"encode": staticmethod(lambda t: inner.encode(t, add_special_tokens=False)), "decode": staticmethod(inner.decode)}))
    if spec.kind == "sentencepiece":
        import sentencepiece

        return PassThrough(sentencepiece.SentencePieceProcessor(model_file=spec.args[0]))
    if spec.kind == "custom":
        return spec.args[0]()
    raise TokenizerResolution(f"{spec.kind!r} is no kind of tokenizer")


WORD = Spec()


def public_bpe() -> Spec:
    """The byte-level BPE of the installed public vocabulary files, a stand-in where a model asks for BPE."""
    import public_tokenizers

    return Spec("bpe", (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def for_profile(kind: str, files: dict[str, Spec] | None = None) -> Spec:
    """The tokenizer of a profile's kind. Vocabularies are supplied, not shipped; BPE has a public stand-in."""
    if files and kind in files:
        return files[kind]
    if kind in ("Cl100kBase", "O200kBase"):
        return public_bpe()
    raise TokenizerResolution(f"no vocabulary was given for {kind}")
