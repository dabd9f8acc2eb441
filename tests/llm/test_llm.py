"""The ten operators against brute force, exact round trips, and their defined edge cases."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspark.llm import fingerprints, mixing, near_dups, pieces, quality_rules, queries, substring_dups, token_counts, token_files, url_filters, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
_PART = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def make_docs(spark, texts, ids=None, sources=None):
    rows = [(ids[i] if ids else i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def prose(rng, n):
    return " ".join(rng.choice(_PART) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, repeats, short, empty and null texts."""
    rng = random.Random(7)
    base = [prose(rng, rng.randrange(30, 200)) for _ in range(30)]
    passage = prose(rng, 45)
    out = list(base) + base[:6] + [None, "", "  \n ", "one", "one two three", "É漢 😀 \x1c\x85 ▁ <|endoftext|> ."]
    for t in base[6:16]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [prose(rng, 10) + "\n" + passage + "\t" + prose(rng, 12) for _ in range(5)]
    out += [passage + " " + passage, "ab " * 90, " ".join(["x y"] * 40)]
    rng.shuffle(out)
    return out


def edge_tables(spark):
    clash = make_docs(spark, ["a b c", None]).withColumn("sig", F.lit(1)).withColumn("ord", F.lit(2)).withColumn("starts", F.lit("x")).withColumn("size", F.lit(3)).withColumn("part", F.lit(4)).withColumn("hash", F.lit(5))
    null_ids = make_docs(spark, ["a b c d e f", "a b c d e f", None], ids=[None, None, 3], sources=[None, None, "s"])
    repeated = make_docs(spark, ["same words in here", "same words in here"], ids=[1, 1])
    return {"empty": make_docs(spark, []), "clash": clash, "null_ids": null_ids, "repeated": repeated}


WORDS = lambda t: [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")]


def test_url_filters(spark):
    urls = ["http://A.Example.NET/en/x", "http://example.net/de/", "x://b.example.com/de/1?q", "https://w.org/fr/", "https://w.org/FR/", "ftp://net/", "net/", None, "http://net", "http://cheap-pills.example.com/x", "http://notnet/", "http://h.net?x/y", "http://a\nb.net/x#f"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(df).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1][2:] == ("net/", "block") and got[2][2:] == ("example.com/de/", "block") and got[3][2:] == ("org/fr/", "allow")
    assert got[4][2:] == (None, "allow") and got[5] == ("net", "/", "net/", "block")
    assert got[6] == got[7] == ("", "", None, "allow") and got[8] == ("net", "", None, "allow")
    assert got[9][2:] == (None, "block") and got[10][2:] == (None, "allow") and got[11][:3] == ("h.net", "", None) and got[12][2] == "net/"
    joined = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_joined(df, url_filters.rules_table(spark)).collect()}
    assert joined == got
    index = url_filters.Index(url_filters.RULES)
    brute = lambda h, p: max((r for r in index.rules if r.is_host and __import__("re").match(r.regex, h + p)), key=lambda r: len(r.text), default=None)
    for host, path, rule, _ in got.values():
        assert (brute(host, path).text if host and brute(host, path) else None) == rule
    assert url_filters.judge(df.where("1 = 0")).count() == 0


def test_warc(spark):
    big = "é<p>" * 500
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (2, "u", big), (None, "u", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder, index = warc.archive(df)
    got = sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_bundles(spark, folder, index).collect()), key=repr)
    sha = hashlib.sha1(big.encode()).hexdigest()
    assert (1, len(big.encode()), sha, "revisit", 2) in got and got.count((2, len(big.encode()), sha, "response", None)) == 2
    assert (None, len(big.encode()), sha, "revisit", 2) in got and [g[3] for g in got if g[0] in (3, 4, 5)] == ["response"] * 3
    found = warc.lookup(spark, folder, index, spark.createDataFrame([(3,), (1,)], "id long")).collect()
    assert sorted((r.id, bytes(r.payload) if r.payload is not None else None) for r in found) == [(1, None), (3, b"small")]
    urls = {r.id: r.url for r in warc.read_bundles(spark, folder, index).collect()}
    assert urls[1] == "http://a/%20b" and urls[5] == "u"
    assert {r.url for r in warc.read_bundles(spark, folder, index).collect() if r.id == 2} == {None, "u"}
    w = warc.BundleWriter("2024-05-06T07:08:09Z", 64)
    for i in range(5):
        rid = warc.record_id("page", i, i)
        w.add(i, rid, warc.encode_record(rid, "2024-05-06T07:08:09Z", "u", b"p" * i, hashlib.sha1(b"p" * i).hexdigest(), i))
    data = w.finish()
    table = warc.seek_table(data)
    assert len(table) == 6 and [next(warc.decode_records(warc.read_frame(data[a : a + n], m)))["payload"] for a, n, m in table[1:]] == [b"p" * i for i in range(5)]
    assert list(warc.decode_records(warc.read_frame(data[: table[0][1]], table[0][2]))) == []
    assert warc.read_bundles(spark, *warc.archive(df.where("1 = 0"))).count() == 0


def test_warc_headers_that_readers_require(spark):
    from loomspark.llm.common import get_file

    big = "x" * 3000
    rows = [(1, "http://a/", big), (2, "http://b/", big), (2, "http://b/", big), (3, None, "t"), (3, None, "t"), (None, "", big)]
    clash = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("row", "id", "body", "digest", "size", "keeper", "may")})
    folder, index = warc.archive(clash, date="2024-05-06T07:08:09Z")
    heads = []
    for name in {r.bundle for r in index.collect()}:
        data = get_file(folder, name)
        for a, n, m in warc.seek_table(data):
            raw = warc.read_frame(data[a : a + n], m)
            while raw:
                head, _, rest = raw.partition(b"\r\n\r\n")
                version, *lines = head.decode().split("\r\n")
                own = dict(x.split(": ", 1) for x in lines)
                assert version == "WARC/1.1" and len(own) == len(lines)
                raw = rest[int(own["Content-Length"]) :]
                assert raw[:4] == b"\r\n\r\n"
                raw = raw[4:]
                heads.append(own)
    assert all({"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "Content-Type"} <= set(h) and h["WARC-Date"] == "2024-05-06T07:08:09Z" for h in heads)
    records = [h for h in heads if h["WARC-Type"] != "warcinfo"]
    assert len({h["WARC-Record-ID"] for h in heads}) == len(heads) and len(records) == 6 and len(heads) > 6
    assert all(h["WARC-Target-URI"] for h in records)
    by_id = {h["WARC-Record-ID"]: h for h in records}
    revisits = [h for h in records if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 2 and all(by_id[h["WARC-Refers-To"]]["WARC-Type"] == "response" and "WARC-Profile" in h for h in revisits)


def test_warc_filter_rules_nothing_wrong_in(spark, monkeypatch):
    rng = random.Random(41)
    pages = ["y" * 1000 + str(rng.randrange(60)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumn("url", F.lit("u"))
    last = {t: i for i, t in enumerate(pages)}
    for bits in (64, warc.FILTER_BITS):  # a filter that lets everything through, and one that doesn't
        monkeypatch.setattr(warc, "FILTER_BITS", bits)
        got = {r.id: r.refers_to for r in warc.read_bundles(spark, *warc.archive(df)).collect()}
        assert got == {i: None if last[t] == i else last[t] for i, t in enumerate(pages)}


def test_rule_lists(spark):
    rules = url_filters.parse_rules(["! comment", "", "||Bad.example^", "||x.org/a/", "@@||ok.bad.example", "^spam^", "@@^ham^", "||h.net/*/z"])
    assert [(r.verdict, r.text, r.is_host) for r in rules] == [("block", "bad.example", True), ("block", "x.org/a/", True), ("allow", "ok.bad.example", True), ("block", "^spam^", False), ("allow", "^ham^", False), ("block", "^h.net/*/z", False)]
    for bad in ("||a$third-party", "x##div", "@@", "*"):
        with pytest.raises(ValueError):
            url_filters.parse_rules([bad])
    urls = ["http://bad.example", "http://w.bad.example/p", "http://bad.example.com/", "http://ok.bad.example/", "http://notbad.example/", "http://x.org/a/b", "http://q/spam", "http://q/spam/ham/", "http://h.net/1/z", "http://" + "q" * 70_000 + "/spam/", "http://bad.example"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit("x"), "rule": F.lit("y"), "token": F.lit("z")})
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge(df, rules).collect()}
    want = [("bad.example", "block"), ("bad.example", "block"), (None, "allow"), ("ok.bad.example", "allow"), (None, "allow"), ("x.org/a/", "block"), (None, "block"), (None, "allow"), (None, "block"), (None, "block"), ("bad.example", "block")]
    assert [got[i] for i in range(len(urls))] == want


def test_long_rule_lists_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([(1, "http://a.net/x"), (2, None), (3, "http://cheap-pills.com/"), (4, "http://example.net/en/")], "page_id long, url string")
    short = sorted(url_filters.judge(df).collect())
    monkeypatch.setattr(url_filters, "MOST_INDEX_BYTES", 10)
    joined = url_filters.judge(df)
    assert "Join" in joined._jdf.queryExecution().executedPlan().toString() and sorted(joined.collect()) == short


def test_mixing(spark, corpus):
    docs = make_docs(spark, corpus, sources=[None if i % 7 == 0 else f"s{i % 5}" for i in range(len(corpus))])
    rows = mixing.takes(docs).collect()
    again = {(r.doc_id, r.taken) for r in mixing.takes(docs.repartition(3)).collect()}
    assert {(r.doc_id, r.taken) for r in rows} == again and len(rows) == len(corpus)
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r.size == len(WORDS(corpus[r.doc_id])) and 0 <= r.taken <= 2 * r.size
        assert r.taken == sum((s.end - s.begin) * s.times for s in r.spans)
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(r.source_size == size[r.source] for r in rows)
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    assert all(abs(taken[s] - target[s]) <= mixing.BLOCK_WORDS for s in size)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORDS(r.text)) for r in mixed.collect()) == sum(taken.values())
    for name, t in edge_tables(spark).items():
        assert mixing.takes(t).count() == t.count(), name


def test_apportionment():
    def brute(weights, seats, caps):
        got = [0] * len(weights)
        for _ in range(min(seats, sum(caps))):
            i = max((i for i in range(len(weights)) if got[i] < caps[i]), key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
            got[i] += 1
        return got

    rng = random.Random(3)
    for _ in range(200):
        w = [rng.randrange(0, 50) for _ in range(rng.randrange(1, 9))]
        caps = [2 * x for x in w]
        seats = rng.randrange(0, 90)
        assert mixing.apportion(np.array(w), seats, np.array(caps)).tolist() == brute(w, seats, caps)
    t = mixing.targets({"a": 10, "b": 1000, None: 5, "c": 0}, mixing.Mix())
    assert t["a"] == 20 and t["c"] == 0 and t[None] == 10 and abs(sum(t.values()) - 1522.5) < 1e-9


def test_rans_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 31, 33, token_files.BLOCK, 2 * token_files.BLOCK + 77):
        ids = np.minimum(rng.zipf(1.4, n), 999).astype(np.uint32)
        table = token_files.Table.of_counts(np.bincount(ids, minlength=1000))
        data = token_files.encode_file(ids, [(None, n // 2), (5, n - n // 2)], table, "t")
        reader = token_files.Reader(data, token_files.Table.from_bytes(table.to_bytes()))
        assert (reader.ids() == ids).all() and reader.docs == [None, 5]
        if n > token_files.BLOCK:
            assert (reader.ids_from(1 if n > 2 * token_files.BLOCK else 0, 300)[-5:] == ids[: token_files.BLOCK * (2 if n > 2 * token_files.BLOCK else 1)][-5:]).all()
            broken = bytearray(data)
            broken[40] ^= 1
            with pytest.raises(ValueError):
                token_files.Reader(bytes(broken), table).ids()


def test_token_files(spark, corpus):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = make_docs(spark, corpus)
    folder, manifest = token_files.store(docs, path, 2)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_files(spark, folder, manifest).collect()}
    at = 0
    for i, t in enumerate(corpus):
        ids = np.array([*token_counts.load_tokenizer(path).encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    for name, t in edge_tables(spark).items():
        assert token_files.read_files(spark, *token_files.store(t, path, 2)).count() == t.count(), name


def odd_texts(n=1500):
    rng = random.Random(5)
    alphabet = "abB é.'!,;:?▁ \n\t 漢😀<|>1\x1c\x85\u200bΣσİ̸"
    return ["", " ", "<|endoftext|>a <|endoftext|> b", "<|startoftext|> x", "<s> </s> <unk>", "a" * 3000, *("".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n))]


def test_tokenizers_on_odd_texts():
    texts = odd_texts()
    p = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.safe_to_cut(p)
    assert token_counts.count_texts(texts, p, True) == [len(e.ids) for e in token_counts.load_tokenizer(p).encode_batch(texts, add_special_tokens=False)]
    p = public_tokenizers.path("word_bpe_49k.json")
    assert token_files.safe_to_cut(p) and not token_counts.safe_to_cut(p)
    texts += ["É À×÷ ÿ Ÿ ß ẞ İ é̸ ÀB", "it's don't 'twas we'll", "a<|endoftext|>b", "ab12c3 x_y -- !!! 10.5 1\n2", "x" * 70_000]
    want = [e.ids for e in token_counts.load_tokenizer(p).encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from a table of which a generation has gone
        ids, at = token_files.encode_column(pa.array(texts, pa.large_string()), p, True, 2)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [[*w, 2] for w in want]
        token_files._unit_tables[p]._most = 20_000
    p = public_tokenizers.path("piece_bpe_32k.model")
    model = pieces.load_model(p)
    ids = model.encode(texts, add_bos=True, add_eos=True)
    assert pieces.chunkable(p)
    found, at, back = pieces.encode_column(pa.array([*texts, None], pa.large_string()), p, True)
    want = [*ids, [model.bos_id(), model.eos_id()]]
    assert [found[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want and back == [model.decode(i).encode() for i in want]
    packed = pieces.segment([b" a", b" ", b"  x", " é漢".encode()], p)
    assert all((x == y).all() if isinstance(x, np.ndarray) else x == y for x, y in zip(packed, pieces.unpack(pieces.pack(*packed)), strict=True))


def test_token_counts_and_pieces(spark, corpus):
    docs = make_docs(spark, corpus)
    p = public_tokenizers.path("byte_bpe_50k.json")
    for r in token_counts.count_tokens(docs, p, limit=100).collect():
        n = len(token_counts.load_tokenizer(p).encode(corpus[r.doc_id] or "", add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((corpus[r.doc_id] or "").encode()), n, n > 100)
    p = public_tokenizers.path("piece_bpe_32k.model")
    model = pieces.load_model(p)
    for r in pieces.encode(docs, p).collect():
        ids = model.encode(corpus[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()
    back = pieces.decode(pieces.with_ids(docs, p), p).collect()
    assert all(r.decoded == model.decode(r.piece_ids) for r in back)
    for name, t in edge_tables(spark).items():
        assert pieces.encode(t, p).count() == token_counts.count_tokens(t, public_tokenizers.path("byte_bpe_50k.json")).count() == t.count(), name


def test_distinct_chunks_are_segmented_once(spark, monkeypatch):
    rng = random.Random(31)
    texts = [prose(rng, 40) + "  two  " for _ in range(40)] + ["x" * 200_000, "漢" * 3000, None, "", " ", "▁▁a ▁b"] * 2
    df = make_docs(spark, texts).repartition(5)
    p = public_tokenizers.path("piece_bpe_32k.model")
    monkeypatch.setattr(pieces, "BLOCK_BYTES", 2000)
    rows = pieces._distinct(df, "text").collect()
    assert len({r.block for r in rows}) > 5
    assert {c for r in rows for c in zlib.decompress(r.chunks).split(b"\xff")} == {bytes(c) for c in pieces.chunks_of(pa.array(texts, pa.large_string()))[0].to_pylist()}
    model = pieces.load_model(p)
    for r in pieces.encode(df, p).collect():
        ids = model.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_fingerprints(spark, corpus):
    texts = [t for t in corpus]
    docs = make_docs(spark, texts)
    ranks = fingerprints.fit_ranks(docs)
    got = {r.doc_id: r for r in fingerprints.compare_neighbours(docs, ranks).collect()}
    order = list(range(len(texts)))[::-1]
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        t, n = texts[i] or "", texts[j] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        own, other, nxt = fingerprints.fingerprint(pa.array([t, edited, n], pa.large_string()), ranks)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.to_text(own), fingerprints.to_text(other))
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(own, other), fingerprints.likeness(own, nxt))
        assert fingerprints.to_text(fingerprints.from_text(r.fingerprint)) == r.fingerprint
    assert len({(texts[i] or "", r.fingerprint) for i, r in got.items()}) == len({t or "" for t in texts})
    alone = fingerprints.compare_neighbours(docs.where("doc_id = 0")).first()
    assert alone.near_next == 1.0
    for name, t in edge_tables(spark).items():
        assert fingerprints.compare_neighbours(t).count() == t.count(), name
    data = np.frombuffer((corpus[0] or "x" * 99).encode() * 3, dtype=np.uint8)
    for i in range(0, len(data) - 64, 17):
        c = np.array(list(Counter(data[i : i + 64].tolist()).values())) / 64
        assert abs(fingerprints.entropies(data)[i] - -(c * np.log2(c)).sum() / 6 * 1000) <= 1.01


def brute_fingerprint(text, ranks):
    """Features as (filter, bits) of a text, window by window."""
    data = text.encode()
    if len(data) < 64:
        begins = [0] if data else []
    else:
        g = [0, *(round(c * np.log2(c) * (1 << 20)) for c in range(1, 65))]
        most = 6 * 64 * (1 << 20)
        entropy = [min(1000, max(0, (most - sum(g[c] for c in Counter(data[i : i + 64]).values())) * 1000 // most)) for i in range(len(data) - 63)]
        rank = [int(ranks[e]) for e in entropy]
        wins = Counter(min(range(b, b + 64), key=lambda i: (rank[i], i)) for b in range(len(rank) - 63))
        begins = sorted(i for i, n in wins.items() if n >= 16)
        if len(begins) < 4:
            begins = sorted(wins) or [min(range(len(rank)), key=lambda i: (rank[i], i))]
    features = list(dict.fromkeys(data[i : i + 64] for i in begins))
    raw = np.frombuffer(b"".join(features), np.uint8)
    ends = np.cumsum([len(f) for f in features])
    hashes = fingerprints.word_hashes(raw, ends - [len(f) for f in features], ends, seed=11).tolist() if features else []
    return [{(h >> 11 * k) % 2048 for h in hashes[i : i + 160] for k in range(5)} for i in range(0, len(hashes), 160)], [len(hashes[i : i + 160]) for i in range(0, len(hashes), 160)]


def brute_likeness(one, two):
    if not one[1] or not two[1]:
        return float(len(one[1]) == len(two[1]))
    (a, na), (b, _) = sorted((one, two), key=lambda x: (len(x[1]), x[1]))
    score = lambda x, y: max(0.0, (len(x & y) - len(x) * len(y) / 2048) / max(min(len(x), len(y)) - len(x) * len(y) / 2048, 1e-9))
    return sum(max(min(1.0, score(x, y)) for y in b) * n for x, n in zip(a, na, strict=True)) / sum(na)


def test_fingerprints_against_brute_force(spark, corpus):
    texts = [*(t or "" for t in corpus[:25]), "", "short", "é" * 40, "q" * 500, prose(random.Random(3), 3000)]
    counts = np.zeros(1001, dtype=np.int64)
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        for i in range(len(data) - 63):
            c = np.bincount(data[i : i + 64])
            counts[min(1000, max(0, int((6 * 64 * (1 << 20) - int(fingerprints._G[c].sum())) * 1000 // (6 * 64 * (1 << 20)))))] += 1
    order = sorted(range(1001), key=lambda e: (e < 100, counts[e], e))
    ranks = np.empty(1001, dtype=np.int64)
    ranks[order] = np.arange(1001)
    docs = make_docs(spark, texts)
    assert (fingerprints.fit_ranks(docs) == ranks).all()
    prints = [brute_fingerprint(t, ranks) for t in texts]
    got = {r.doc_id: r for r in fingerprints.compare_neighbours(docs).collect()}
    for i in range(len(texts)):
        j = i - 1 if i else len(texts) - 1
        bits, n = fingerprints.from_text(got[i].fingerprint)
        assert ([set(np.flatnonzero(row).tolist()) for row in bits], n) == prints[i], i
        edited = texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[j][: len(texts[i]) // 2]
        assert abs(got[i].near_next - brute_likeness(prints[i], prints[j])) < 1e-5
        assert abs(got[i].near_edited - brute_likeness(prints[i], brute_fingerprint(edited, ranks))) < 1e-5


def test_quality_rules(spark, corpus):
    good = "the quick fox of the hill and " + " ".join(f"word{i} in the" for i in range(40))
    texts = [*corpus, good, good + "\n" + good, "# $ " * 60, "x " * 80]
    docs = make_docs(spark, texts)
    rows = {r.doc_id: r for r in quality_rules.measure(docs).collect()}
    for i, t in enumerate(texts):
        w = WORDS(t)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {p + k for p in range(len(w) - 2) if windows[tuple(w[p : p + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if WORDS(x)]
        want = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert rows[len(corpus)].kept and not rows[len(texts) - 2].kept
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.kept}
    for name, t in edge_tables(spark).items():
        assert quality_rules.measure(t).count() == t.count() and quality_rules.keep(t).columns == t.columns, name


def brute_substrings(texts, width=20):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        w = WORDS(t)
        gone = set()
        for p in range(len(w) - width + 1):
            g = tuple(w[p : p + width])
            if g in seen:
                gone.update(range(p, p + width))
            seen.add(g)
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest())
    return out


def test_substring_dups(spark, corpus):
    docs = make_docs(spark, corpus)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dups.digest(docs).collect()}
    assert got == brute_substrings(corpus)
    left = substring_dups.remove(docs)
    assert left.columns == docs.columns
    assert Counter(w for r in left.collect() for w in WORDS(r.text)).total() == sum(n - k for n, k, _ in got.values())
    for name, t in edge_tables(spark).items():
        assert substring_dups.digest(t).count() == t.count() and substring_dups.remove(t).columns == t.columns, name
    both = substring_dups.digest(make_docs(spark, ["a b c " * 20] * 2, ids=[4, 4])).collect()
    assert len({(r.n_removed, r.kept_sha256) for r in both}) == 1 and len(both) == 2


def test_symbols_inside_equal_substrings_agree():
    rng = np.random.default_rng(4)
    core = rng.integers(1, 6, 60).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    found = []
    for _ in range(20):
        a, b = (rng.integers(1, 6, rng.integers(0, 30)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
        words = np.concatenate([a, core, b])
        symbols, inside = substring_dups.Symbols.of_words(words, np.array([0, len(words)])), []
        for level in range(1, 6):
            symbols = symbols.raised(level, 20)
            own = symbols.only((symbols.left >= len(a)) & (symbols.right <= len(a) + 60))
            inside.append(list(zip(own.name.tolist(), (own.left - len(a)).tolist(), (own.right - len(a)).tolist(), strict=True)))
        found.append(inside)
    assert all(f == found[0] for f in found) and all(found[0][:3])


def brute_components(texts, width, percent):
    sets = []
    for t in texts:
        w = WORDS((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    top = lambda i: i if root[i] == i else top(root[i])
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("width", [4, 5])
def test_near_dups(spark, corpus, width):
    rng = random.Random(11)
    family = prose(rng, 120).split()
    texts = list(corpus)
    for k in range(60):  # a family whose members are linked, chained or just not linked
        w = list(family)
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(w).upper() if k % 9 == 0 else " ".join(w))
    docs = make_docs(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.components(docs, width).collect()}
    assert got == brute_components(texts, width, 80)
    kept = near_dups.keep(docs, width)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in got.items() if i == c}


def test_near_dup_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 7)
    rng = random.Random(12)
    family = prose(rng, 100).split()
    texts = []
    for _ in range(50):
        w = list(family)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.components(make_docs(spark, texts), 4).collect()}
    assert got == brute_components(texts, 4, 80)


def test_near_dup_neighbourhood_rows(spark, monkeypatch):
    """Many texts with a common passage, and like texts that are seldom linked, make no row for a member and a block."""
    monkeypatch.setattr(near_dups, "BLOCK", 16)
    met, block_links = [], near_dups._block_links
    monkeypatch.setattr(near_dups, "_block_links", lambda rows, *a: met.append(rows.count()) or block_links(rows, *a))
    rng = random.Random(13)
    passage, family = prose(rng, 60), prose(rng, 100).split()
    texts = [passage + " " + " ".join(f"own{rng.randrange(10**9)}" for _ in range(30)) for _ in range(150)]
    for _ in range(60):
        w = list(family)
        for _ in range(rng.randrange(2, 7)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.components(make_docs(spark, texts), 5).collect()}
    assert got == brute_components(texts, 5, 80)
    assert sum(met) <= len(texts)


def test_near_dup_edges(spark):
    for name, t in edge_tables(spark).items():
        rows = near_dups.components(t).collect()
        assert len(rows) == t.count() and all(r.kept for r in rows), name
        assert near_dups.keep(t).columns == t.columns


def test_every_query_is_registered(spark):
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def brute_rows(rows, width=20):
    """[(id, text)] -> (words, words removed) of each row: a window goes if a smaller id, or its own row before, has it."""
    key = lambda i: (1 << 63) - 1 if i is None else i
    first = {}
    for i, t in rows:
        w = WORDS(t)
        for p in range(len(w) - width + 1):
            g = tuple(w[p : p + width])
            first[g] = min(first.get(g, key(i)), key(i))
    out = []
    for i, t in rows:
        w, gone, seen = WORDS(t), set(), set()
        for p in range(len(w) - width + 1):
            g = tuple(w[p : p + width])
            if first[g] < key(i) or g in seen:
                gone.update(range(p, p + width))
            seen.add(g)
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def awkward_rows():
    """Null and repeated ids, one id with several texts, the largest id, ties, and long, empty and null texts."""
    rng = random.Random(21)
    a, b, c, d = (prose(rng, 40) for _ in range(4))
    near = lambda t: t.replace(t.split()[20], "other")
    return [
        (None, f"{a} x {a}"), (None, f"{b} y {b}"), (None, f"{a} x {a}"), (None, None), (None, ""),
        (7, f"{c} {prose(rng, 25)} {c}"), (7, f"{d} {prose(rng, 25)} {d}"), (7, None),
        ((1 << 63) - 1, f"{a} z"), ((1 << 60) + 1, d), ((1 << 60) + 3, d), (-5, near(d)), (9, b), (9, b), (9, b),
        (20, prose(rng, 120) + " " + a), (21, ""), (22, "  \n\t "), (23, "one"), (24, "x" * 70_000 + " y"),
    ]


def test_substring_dups_on_awkward_rows(spark):
    rows = awkward_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dups.digest(df).collect()), key=repr)
    assert got == brute_rows(rows)
    clash = df.withColumns({c: F.lit(1) for c in ("ord", "hash", "starts", "anchors", "__x")})
    left = substring_dups.remove(clash)
    assert left.columns == clash.columns
    kept = sorted(((r.doc_id, hashlib.sha256(" ".join(WORDS(r.text)).encode()).hexdigest()) for r in left.collect() if WORDS(r.text)), key=repr)
    assert kept == sorted(((i, h) for i, n, k, h in brute_rows(rows) if n > k), key=repr)


def test_one_id_with_several_texts_links_them(spark):
    rng = random.Random(22)
    a, b = prose(rng, 100), prose(rng, 100)
    near = lambda t: t.replace(t.split()[50], "other", 1)
    rows = [(1, a), (1, b), (5, near(a)), (6, near(b)), (8, a), (9, prose(rng, 100)), (None, a), (1, None), (12, ""), (3, b), (9, "w")]
    got = sorted(((r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in near_dups.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(1, True, 1, True), (1, True, 1, True), (5, True, 1, False), (6, True, 1, False), (8, True, 1, False), (9, True, 9, True), (None, True, None, True), (1, False, 1, True), (12, False, 12, True), (3, True, 1, False), (9, True, 9, True)], key=repr)
    kept = near_dups.keep(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"doc": F.lit(1), "sig": F.lit(2), "comp": F.lit(3)}))
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 1, 1, 9, 9, 12, None], key=repr)


def test_word_kernels_in_segments(monkeypatch):
    from loomspark.llm import common

    texts = [t or "" for _, t in awkward_rows()] + ["a  b\n" * 40, "z" * 300]
    data, offsets = common.string_buffer(pa.array(texts, pa.large_string()))
    whole = common.word_spans(data, offsets)
    want = common.word_hashes(data, whole[0], whole[1])
    assert [[bytes(data[b:e]).decode() for b, e in zip(whole[0][x:y], whole[1][x:y], strict=True)] for x, y in zip(whole[2][:-1], whole[2][1:], strict=True)] == [WORDS(t) for t in texts]
    monkeypatch.setattr(common, "SEGMENT_BYTES", 64)
    parts = common.word_spans(data, offsets)
    assert all((x == y).all() for x, y in zip(whole, parts, strict=True)) and (common.word_hashes(data, parts[0], parts[1]) == want).all()


def test_mixing_against_brute_force(spark):
    rng = random.Random(23)
    rows = [(i, prose(rng, rng.randrange(1, 90)), rng.choice(["a", "b", "é", None, "z"])) for i in range(60)]
    rows += [((1 << 60) + 1, prose(rng, 50), "a"), ((1 << 60) + 3, prose(rng, 50), "a"), (None, prose(rng, 70), "a"), (None, prose(rng, 30), "a"), (70, "", "a"), (71, None, "b"), (None, " ", None), (72, "", "wordless")]
    rows += [(80, rows[3][1], "a"), (80, rows[3][1], "b")] + [(90, rows[5][1], "b")] * 5 + [(95, prose(rng, 1), "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORDS(t))
    goal = mixing.targets(dict(size), mixing.Mix())
    blocks = {s: max(1, round(n / mixing.BLOCK_WORDS)) for s, n in size.items() if n}
    weight = {s: goal[s] / size[s] * blocks[s] for s in blocks}
    got = dict.fromkeys(blocks, 0)
    for _ in range(round(sum(weight.values()))):  # the highest quotient takes each seat
        s = min((s for s in blocks if got[s] < 2 * blocks[s]), key=lambda s: (-weight[s] / (2 * got[s] + 1), s is None, s or ""))
        got[s] += 1
    want, hashes = [], {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    for s in size:
        own = sorted(((i, t) for i, t, x in rows if x == s and WORDS(t)), key=lambda x: (x[0] is None, x[0] or 0, hashes[x]))
        words = [k for k, (_, t) in enumerate(own) for _ in WORDS(t)]
        salt = int.from_bytes(hashlib.sha256(repr((mixing.Mix().seed, s, 0)).encode()).digest()[:8], "little")
        taken = Counter()
        if own:
            bounds, times = mixing.block_bounds(len(words), blocks[s]), mixing.block_takes(len(words), blocks[s], got[s], salt)
            assert times.sum() == got[s] and times.max() - times.min() <= 1
            for b in range(blocks[s]):
                for w in range(bounds[b], bounds[b + 1]):
                    taken[words[w]] += int(times[b])
        want += [(i, s, len(WORDS(t)), size[s], goal[s], taken[k]) for k, (i, t) in enumerate(own)]
        want += [(i, s, 0, size[s], goal[s], 0) for i, t, x in rows if x == s and not WORDS(t)]
    found = [(r.doc_id, r.source, r.size, r.source_size, r.target, r.taken) for r in mixing.takes(df).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    mixed = Counter()
    for r in mixing.mix(df.withColumns({"row": F.lit(1), "size": F.lit("x"), "shard": F.lit(2)})).collect():
        mixed[r.doc_id, r.source] += len(WORDS(r.text))
    total = Counter()
    for r in found:
        total[r[0], r[1]] += r[5]
    assert mixed == +total


def test_piece_tables_are_bounded():
    calls = []
    table = token_counts.PieceTable(lambda p: calls.append(list(p)) or [len(x) for x in p], most_bytes=4000, batch_chars=20)
    for i in range(60):
        own = {f"piece{j}" for j in range(i, i + 5)} | {"always"}
        got = table.prepare(own)
        assert all(got[p] == len(p) for p in own)
    assert len(table.young) + len(table._old) < 60 and sum("always" in c for c in calls) == 1 and all(sum(map(len, c)) <= 20 for c in calls)
    assert max(Counter(p for c in calls for p in c).values()) == 1
