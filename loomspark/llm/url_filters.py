"""URL filters: pattern rules in an index keyed by each rule's rarest literal token.

Two kinds of rule share the index:

* host rules, written ``host/path`` (``net/``, ``example.net/en/``): fit that host and all its subdomains
  when the url's path starts with the rule's; of those that fit, the longest decides;
* pattern rules, text with ``*`` (anything) and ``^`` (a separator or an end): looked at only where no host
  rule fits; an allow pattern beats a block pattern.

A literal token is a run of ``[a-z0-9]`` with a separator on both sides in the rule's literal text, so any
url that the rule fits has that token whole. Each rule is filed under its token that the fewest rules have
(ties: the longer, then the smaller). A url's own tokens fetch candidate rules, and only those run their regular
expression. Rules without such a token are candidates for every url.

The index goes to executors in the function's closure, so its size is bounded: :data:`MOST_INDEX_BYTES` of rule
text. Longer lists are joined instead: distinct urls' tokens with the rules filed under them (:func:`judge_joined`). Both find the
same candidates and give the same verdicts; :func:`judge` picks by the list's size. :func:`parse_rules` reads lists.

Defined cases: a null url, or one without ``://``, has an empty host and path and no rule, and is allowed; a very long url is
judged whole; repeated rows are judged one by one; of rules that repeat one counts, and of host rules of equal length that fit the
greater text decides; without rules everything is allowed; an empty table gives an empty result; only the two columns asked for
are read, whatever the names of others.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_INDEX_BYTES = 8 << 20
_TOKEN = re.compile(r"[a-z0-9]+")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    text: str
    is_host: bool = True

    @property
    def regex(self) -> str:
        """Matches at the start of ``host + path`` (host rules) or anywhere in it (patterns)."""
        if self.is_host:
            return r"(?s)\A(?:[^/?#]*\.)?" + _escaped(self.text) + ("" if "/" in self.text else r"(?![^/])")
        parts = {"*": ".*", "^": r"(?:[^a-zA-Z0-9]|\A|\z)"}
        return "(?s)" + "".join(parts.get(c) or _escaped(c) for c in self.text)

    def tokens(self) -> list[str]:
        """Tokens that stand whole in every url the rule fits."""
        text, found = self.text.lower(), []
        for m in _TOKEN.finditer(text):
            left = self.is_host if m.start() == 0 else text[m.start() - 1] != "*"
            right = m.end() < len(text) and text[m.end()] != "*" or self.is_host and "/" not in text
            if left and right:
                found.append(m[0])
        return found


def _escaped(text: str) -> str:
    """For Python's and Java's regular expressions alike."""
    return re.sub(r"([^A-Za-z0-9_/\x80-\U0010ffff])", r"\\\1", text)


#: Production rules. The patterns name spam, gambling, adult and tracking hosts.
RULES = (
    Rule("block", "net/"),
    Rule("allow", "example.net/en/"),
    Rule("block", "example.com/de/"),
    Rule("allow", "org/fr/"),
    Rule("block", "^cheap-pills^", False),
    Rule("block", "^spam-farm^", False),
    Rule("block", "^free-bets^", False),
    Rule("block", "^casino-win^", False),
    Rule("block", "^adult-x^", False),
    Rule("block", "^ads-track^", False),
)


def parse_rules(lines: Iterable[str]) -> list[Rule]:
    """Rules from a list: one on a line; blank lines and those that start with ``!`` or ``#`` are skipped.

    ``@@`` before a rule allows what it fits, others block. ``||host/path`` is a host rule (``||host`` and ``||host^`` fit any
    path); all else is a pattern with ``*`` and ``^``. Options after ``$`` and element rules (``##``) aren't rules for
    urls and raise ValueError, as does an empty pattern.
    """
    found = []
    for number, line in enumerate(lines, 1):
        text = line.strip()
        if not text or text[0] in "!#":
            continue
        verdict, text = ("allow", text[2:]) if text.startswith("@@") else ("block", text)
        is_host, text = (True, text[2:]) if text.startswith("||") else (False, text)
        if not text.strip("*^") or "$" in text or "##" in text:
            raise ValueError(f"line {number} isn't a rule for urls: {line!r}")
        if is_host and ("*" in text or "^" in text.rstrip("^")):  # a host anchor before a pattern
            is_host, text = False, f"^{text}"
        elif is_host:
            host, _, path = text.rstrip("^").partition("/")
            text = f"{host.lower()}/{path}" if "/" in text else host.lower()
        found.append(Rule(verdict, text, is_host))
    return found


class Index:
    """token -> rules filed under it, each with its compiled expression."""

    def __init__(self, rules: Iterable[Rule]):
        self.rules = tuple(dict.fromkeys(rules))
        self.by_token: dict[str, list[tuple[Rule, re.Pattern]]] = defaultdict(list)
        for rule, token in filed(self.rules):
            self.by_token[token].append((rule, re.compile(rule.regex.replace(r"\z", r"\Z"))))

    def candidates(self, url: str) -> Iterator[tuple[Rule, re.Pattern]]:
        for token in {"", *_TOKEN.findall(url.lower())}:
            yield from self.by_token.get(token, ())

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        at, host_rules, patterns = host + path, [], []
        if at:
            for rule, regex in self.candidates(at):
                if regex.search(at):
                    (host_rules if rule.is_host else patterns).append(rule)
        if host_rules:
            best = max(host_rules, key=lambda r: (len(r.text), r.text))
            return best.text, best.verdict
        return None, "block" if patterns and all(r.verdict == "block" for r in patterns) else "allow"


def filed(rules: Iterable[Rule]) -> list[tuple[Rule, str]]:
    """Each rule with its rarest token; the empty token stands for none."""
    rules = list(rules)
    count = Counter(t for r in rules for t in set(r.tokens()))
    return [(r, min(r.tokens(), key=lambda t: (count[t], -len(t), t), default="")) for r in rules]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://(.*)\z", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)\A[^/?#]*", 0), _UPPER, _UPPER.lower())
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    # a '?' or '#' right after the host ends the path before it begins
    return host, F.when(path.startswith("/"), path).otherwise("")


def judge(df: DataFrame, rules: Iterable[Rule] = RULES, url: str = "url", key: str = "page_id") -> DataFrame:
    """key, host, path, rule and verdict for every row of *df*."""
    rules = tuple(dict.fromkeys(rules))
    if sum(len(r.text.encode()) for r in rules) > MOST_INDEX_BYTES:
        return judge_joined(df, rules_table(df.sparkSession, rules), url, key)
    index = Index(rules)
    host, path = split_url(F.col(f"`{url}`"))

    @F.pandas_udf("struct<rule string, verdict string>")
    def verdicts(hosts, paths):
        import pandas as pd

        return pd.DataFrame([index.judge(h, p) for h, p in zip(hosts, paths, strict=True)], columns=["rule", "verdict"])

    cut = df.select(F.col(f"`{key}`"), host.alias("host"), path.alias("path"))
    return cut.withColumn("_v", verdicts("host", "path")).select(key, "host", "path", "_v.rule", "_v.verdict")


def judge_joined(df: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id") -> DataFrame:
    """:func:`judge` for rule lists of any length: *rules* has text, verdict, is_host, regex and token.

    Distinct urls only are tokenised, so a url that many rows share meets its candidates once. A join on
    tokens finds candidates; Spark broadcasts the rules if they are small and splits hot tokens if not.
    """
    host, path = split_url(F.col(url))
    cut = df.select(key, host.alias("host"), path.alias("path"))
    urls = cut.select("host", "path").distinct().withColumn("at", F.concat("host", "path"))
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(F.lower("at"), F.lit("[a-z0-9]+"), F.lit(0))))
    hits = urls.where("at != ''").withColumn("token", F.explode(tokens)).join(rules, "token").where(F.expr("regexp_like(at, regex)"))
    best = hits.groupBy("host", "path").agg(
        F.max(F.when(F.col("is_host"), F.struct(F.length("text").alias("n"), F.col("text"), F.col("verdict")))).alias("b"),
        F.bool_and(F.when(~F.col("is_host"), F.col("verdict") == "block")).alias("p"),
    )
    out = cut.join(best, ["host", "path"], "left")
    return out.select(key, "host", "path", F.col("b.text").alias("rule"), F.coalesce(F.col("b.verdict"), F.when(F.col("p"), "block"), F.lit("allow")).alias("verdict"))


def rules_table(spark, rules: Iterable[Rule] = RULES) -> DataFrame:
    """The table form that :func:`judge_joined` reads."""
    rows = [(r.text, r.verdict, r.is_host, r.regex, t) for r, t in filed(rules)]
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(("text", "verdict", "is_host", "regex", "token"), x, strict=True)) for x in rows]))
