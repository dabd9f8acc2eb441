import os

import pytest
from pyspark.sql import functions as F

from loomspark import api
from loomspark.functions import native, tokenizers
from loomspark.operators import evaluation, integrity, requests
from loomspark.options import ChunkingOptions, InvalidChunkingOptions
from loomspark.plans import contract
from loomspark.sources import files, ingestion

WORD = tokenizers.WORD


def test_schema_ids_and_metadata(spark):
    df = spark.createDataFrame([(1, "a b c d", ["x"], {"k": "v"}), (2, None, None, None), (3, "", None, None)], "doc_id long, text string, labels array<string>, tags map<string,string>")
    c = api.chunk_text(df, ChunkingOptions(max_tokens=2, compute_hashes=True, parent_id="p"), tokenizer=WORD)
    rows = c.orderBy("doc_id", "position").collect()
    assert [(r.doc_id, r.position, r.text, r.start_offset, r.end_offset, r.token_count, r.character_count) for r in rows] == [(1, 0, "a b", 0, 3, 2, 3), (1, 1, "c d", 4, 7, 2, 3)]
    assert rows[0].labels == ["x"] and rows[0].tags == {"k": "v"} and rows[0].parent_id == "p"
    assert len(rows[0].md5_hash) == 16 and len(rows[0].sha1_hash) == 20 and len(rows[0].sha256_hash) == 32
    again = api.chunk_text(df, ChunkingOptions(max_tokens=2), tokenizer=WORD).orderBy("doc_id", "position").collect()
    assert [r.chunk_id for r in rows] == [r.chunk_id for r in again] and rows[0].chunk_id != rows[1].chunk_id
    off = api.chunk_text(df, ChunkingOptions(max_tokens=2, compute_token_counts=False, compute_offsets=False), tokenizer=WORD).first()
    assert (off.token_count, off.start_offset, off.md5_hash) == (0, -1, None)


def test_size_guard(spark):
    df = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    with pytest.raises(Exception, match="InvalidChunkingOptions"):
        api.chunk_text(df, ChunkingOptions(max_input_characters=5), tokenizer=WORD).collect()
    assert api.chunk_text(df, ChunkingOptions(max_input_characters=0), tokenizer=WORD).count() == 1


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(i, f"word {i}", "x") for i in range(10)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "d"))
    c = api.chunk_text(spark.read.parquet(str(tmp_path / "d")), ChunkingOptions(max_tokens=4), tokenizer=WORD)
    plan = c.where("doc_id = 5").select("doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,5)" in plan and "lang" not in plan.split("ReadSchema")[1] and "md5" not in plan


def test_lists_and_tables(spark):
    lists = spark.createDataFrame([(1, ["alpha", " ", "beta gamma", None]), (2, []), (3, None)], "list_id long, items array<string>")
    o = ChunkingOptions(strategy="ListEntry", max_tokens=8)
    assert [(r.list_id, r.text) for r in api.chunk_list(lists, o, tokenizer=WORD).orderBy("list_id", "position").collect()] == [(1, "alpha"), (1, "beta gamma")]
    whole = api.chunk_list(lists.where("list_id = 1"), ChunkingOptions(strategy="WholeList"), ordered=True, tokenizer=WORD).first()
    assert whole.text == "1. alpha\n2.  \n3. beta gamma\n4." and whole.start_offset == -1
    small = api.chunk_list(lists.where("list_id = 1"), ChunkingOptions(strategy="WholeList", max_tokens=3), tokenizer=WORD).orderBy("position").collect()
    assert [r.text for r in small] == ["- alpha\n-", "- beta gamma\n-"] or [r.text for r in small][0] == "- alpha\n-"
    rows = spark.createDataFrame([(1, [["Name", "Role"], ["Ada", "Engineer"], ["Bob|x", None]]), (2, [["Name"]]), (3, [])], "table_id long, rows array<array<string>>")
    got = api.chunk_table(rows, ChunkingOptions(max_tokens=64), tokenizer=WORD).orderBy("table_id", "position").collect()
    assert [r.text for r in got] == ["| Name | Role |\n|---|---|\n| Ada | Engineer |", "| Name | Role |\n|---|---|\n| Bob\\|x |  |"]
    assert got[0].strategy == "RowWithHeaders"
    pairs = api.chunk_table(rows, ChunkingOptions(strategy="KeyValuePairs"), tokenizer=WORD).orderBy("position").collect()
    assert pairs[0].text == "Name: Ada, Role: Engineer"
    tight = api.chunk_table(rows.where("table_id = 1"), ChunkingOptions(strategy="WholeTable", max_tokens=4), tokenizer=WORD).collect()
    assert all(r.token_count <= 4 for r in tight) and "Name: Ada, Role: Engineer" in [r.text for r in tight]
    for strategy in ("Row", "RowWithHeaders", "RowGroupWithHeaders", "KeyValuePairs", "WholeTable"):
        plain = [r.c for r in rows.select(F.explode(native.table_chunks(F.col("rows"), strategy)).alias("c")).collect()]
        wide = [r.text for r in api.chunk_table(rows, ChunkingOptions(strategy=strategy, trim_whitespace=False), tokenizer=WORD).orderBy("table_id", "position").collect()]
        assert plain == wide


def test_request_tree(spark):
    trees = [{"id": "root", "text": "root text", "labels": ["l"], "children": [{"id": "a", "text": "child one"}, {"id": "b", "type": "List", "ordered": ["x", "y"]}, {"id": "t", "type": "Table", "table": [["h"], ["v"]]}]}]
    nodes = requests.flatten(spark, trees)
    got = requests.ordered(api.chunk_requests(nodes, ChunkingOptions(max_tokens=16), WORD)).collect()
    assert [(r.request_id, r.position, r.text) for r in got] == [("root", 0, "root text"), ("a", 0, "child one"), ("b", 0, "1. x\n2. y"), ("t", 0, "h\nv")]
    assert got[0].labels == ["l"] and got[1].labels is None
    with pytest.raises(InvalidChunkingOptions):
        requests.flatten(spark, [{"type": "Nope"}])


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é plain".encode())
    (tmp_path / "b.txt").write_bytes(b"\xef\xbb\xbf" + "é mark".encode())
    (tmp_path / "c.txt").write_bytes("é wide".encode("utf-16"))
    got = {os.path.basename(r.path): r.text for r in files.read_files(spark, str(tmp_path / "*.txt")).collect()}
    assert got == {"a.txt": "é plain", "b.txt": "é mark", "c.txt": "é wide"}
    kept = {os.path.basename(r.path): r.text for r in files.read_files(spark, str(tmp_path / "b.txt"), detect_bom=False).collect()}
    assert kept["b.txt"] == "﻿é mark"
    for bad in ("", "  "):
        with pytest.raises(InvalidChunkingOptions):
            files.read_files(spark, bad)
    with pytest.raises(InvalidChunkingOptions):
        files.read_files(spark, "x", access_mode="Never")


def test_native_sections_match_the_worker(spark):
    md = "intro\n# A\ntext a\n## B ##\n\n  text b  \n#### C\n# D\nlast"
    df = spark.createDataFrame([(1, md)], "doc_id long, text string")
    rows = [(r.breadcrumb, r.start_offset, r.end_offset, r.body) for r in native.sections(df).orderBy("section").collect()]
    assert rows == [(None, 0, 5, "intro"), ("A", 10, 16, "text a"), ("A > B", 28, 34, "text b"), ("D", 48, 52, "last")]
    assert all(md[a:b] == t for _, a, b, t in rows)
    c = api.chunk_text(df, ChunkingOptions(hierarchy_aware=True, max_tokens=64), tokenizer=WORD).orderBy("position").collect()
    assert [(r.header_context, r.start_offset, r.end_offset, r.text) for r in c] == rows


def test_json(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    c = api.chunk_text(df, ChunkingOptions(max_tokens=2, compute_hashes=True), tokenizer=WORD)
    j = c.select("doc_id", contract.to_json(c).alias("json"))
    assert '"tokenCount":2' in j.orderBy("json").collect()[0].json or '"tokenCount":2' in j.collect()[1].json
    back = contract.from_json(j).orderBy("position").collect()
    want = c.orderBy("position").collect()
    assert [(r.text, r.position, r.sha256_hash, r.strategy) for r in back] == [(r.text, r.position, r.sha256_hash, r.strategy) for r in want]
    broken = j.withColumn("json", F.regexp_replace("json", "FixedTokenCount", "Other"))
    with pytest.raises(Exception, match="no such value"):
        contract.from_json(broken).collect()


def test_ingestion(spark):
    rows = [("d", 1, "header", 9, "# Title", None, None), ("d", 2, "table", None, None, None, [["a", "b"], ["1", "|"]]), ("d", 3, "image", None, "fallback", " alt ", None), ("d", 4, "footer", None, "end\n", None, None), ("d", 5, "paragraph", None, None, None, None)]
    e = spark.createDataFrame(rows, "doc_id string, ord int, kind string, level int, text string, alt string, cells array<array<string>>")
    md = ingestion.to_markdown(e)
    assert md.first().text == "###### Title\n\n| a | b |\n|---|---|\n| 1 | \\| |\n\nalt\n\nend"
    c = ingestion.ingestion_chunks(api.chunk_text(md, ChunkingOptions(max_tokens=64), tokenizer=WORD)).first()
    assert c.context == "" and c.metadata["chunk.strategy"] == "FixedTokenCount" and len(c.metadata) == 7


def test_evaluation(spark):
    docs = spark.createDataFrame([("a", "one two three four five six"), ("b", "x y")], "doc_id string, text string")
    spans = evaluation.locate(docs, spark.createDataFrame([("a", "s", "two three"), ("b", "t", "zzz")], "doc_id string, label string, answer string"))
    assert [tuple(r) for r in spans.collect()] == [("a", "s", 4, 9)]
    c = api.chunk_text(docs, ChunkingOptions(max_tokens=2), tokenizer=WORD)
    r = evaluation.span_scores(spans, c).first()
    assert (r.recall, r.precision) == (8 / 9, 8 / 17)
    s = evaluation.sweep(docs, spans, {"big": ChunkingOptions(max_tokens=64), "small": ChunkingOptions(max_tokens=2)}, tokenizer=WORD)
    assert evaluation.best(s).first().config == "small" and s.count() == 2
    iv = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 8, 9), (1, 20, 22), (2, 1, 1)], "k int, start int, end int")
    assert {r.k: r.union_length for r in native.islands(iv, ["k"]).collect()} == {1: 11, 2: 0}


def test_integrity_query_counts_in_the_row(spark, sf_dir):
    """Chunks with overlap outgrow the texts, so they must not be joined to them by a broadcast, nor be shuffled."""
    from loomspark import catalogue

    plan = catalogue.QUERIES["integrity_bpe_sentence_aware"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    docs = spark.createDataFrame([(1, "One two. Three four five. Six."), (2, ""), (3, None)], "doc_id long, text string")
    o = ChunkingOptions(max_tokens=4, overlap_count=2)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(integrity.document_violations(docs, o, WORD)) == rows(integrity.violations(docs, api.chunk_text(docs, o, tokenizer=WORD), 4)) == [(i, 0, 0, 0, 0) for i in (1, 2, 3)]


def test_integrity_finds_faults(spark):
    docs = spark.createDataFrame([(1, "aa bb cc"), (2, "lost")], "doc_id long, text string")
    bad = spark.createDataFrame([(1, 0, "aa", 1, 0, 2), (1, 1, "XX", 9, 3, 5), (1, 2, "b", 1, 3, 4)], "doc_id long, position int, text string, token_count int, start_offset int, end_offset int")
    got = {r.doc_id: (r.over_budget, r.bad_span, r.contained, r.uncovered) for r in integrity.violations(docs, bad, 2).collect()}
    assert got == {1: (1, 1, 1, 2), 2: (0, 0, 0, 4)}


def test_sql_and_udfs(spark):
    api.register(spark, WORD)
    assert spark.sql("SELECT token_count('a b  c') AS n, token_slice('a b  c', 1, 2) AS s, utf16_length('😀a') AS u").first().asDict() == {"n": 3, "s": "b  c", "u": 3}
    got = spark.sql("SELECT c.text FROM VALUES (array('x', 'y')) AS t(i), LATERAL chunk_list(t.i, '{\"strategy\": \"ListEntry\"}') c").collect()
    assert [r.text for r in got] == ["x", "y"]


def test_streaming(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs = spark.createDataFrame([(i, f"w{i} a b c d") for i in range(6)], "doc_id long, text string")
    docs.write.parquet(src)
    o = ChunkingOptions(max_tokens=2)
    stream = api.chunk_stream(spark.readStream.schema(docs.schema).parquet(src), o, WORD).drop("tags")
    api.write_chunks(stream, out, str(tmp_path / "cp"), available_now=True).awaitTermination(60)
    got = sorted((r.doc_id, r.position, r.text, r.chunk_id) for r in spark.read.parquet(out).collect())
    assert got == sorted((r.doc_id, r.position, r.text, r.chunk_id) for r in api.chunk_text(docs, o, tokenizer=WORD).collect())
    with pytest.raises(ValueError):
        api.chunk_stream(docs, o, WORD)


def test_diagnostics(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "")], "doc_id long, text string")
    _, d = api.chunk_to_result(df, ChunkingOptions(max_tokens=2, model_id="all-minilm"), tokenizer=WORD)
    rows = {r.doc_id: r for r in d.collect()}
    assert (rows[1].chunk_count, rows[1].total_tokens, rows[1].max_chunk_tokens, rows[1].input_character_count, rows[1].profile_source) == (2, 3, 2, 5, "KnownModel")
    assert (rows[2].chunk_count, rows[2].total_tokens, rows[2].max_chunk_tokens) == (0, 0, 0)


def test_sample_sweep_and_preview(spark):
    docs, spans = evaluation.sample_corpus(spark)
    assert spans.count() == 9
    configs = {k: evaluation.SWEEP[k] for k in ("fixed-128", "sentence-64")}
    scores = evaluation.sweep(docs, spans, configs, tokenizer=tokenizers.public_bpe()).collect()
    assert len(scores) == 2 and all(0 < r.iou <= r.recall <= 1 for r in scores) and len(evaluation.SWEEP) == 9
    from loomspark.operators.chunk import preview

    lines = preview(api.chunk_text(docs, ChunkingOptions(max_tokens=64), tokenizer=WORD)).collect()
    assert all(len(r.preview) <= 56 and "\n" not in r.preview for r in lines)


def test_command_line(spark, tmp_path, capsys):
    from loomspark.__main__ import main

    (tmp_path / "a.txt").write_text("one two three four five")
    assert main([str(tmp_path / "a.txt"), "--words", "--max-tokens", "2", "--json", str(tmp_path / "out")]) == 0
    assert "three four" in capsys.readouterr().out and spark.read.json(str(tmp_path / "out")).count() == 3


def test_clashing_columns_are_carried_under_other_names(spark):
    df = spark.createDataFrame([(1, "a b c", 7, "x", "y", 3)], "doc_id long, text string, position int, chunk_id string, source_position string, token_count int")
    rows = api.chunk_text(df, ChunkingOptions(max_tokens=2), tokenizer=WORD).orderBy("position").collect()
    assert [(r.position, r.text, r.token_count, r.source_source_position, r.source_chunk_id, r.source_position, r.source_token_count) for r in rows] == [(0, "a b", 2, 7, "x", "y", 3), (1, "c", 1, 7, "x", "y", 3)]
    again = api.chunk_text(api.chunk_text(df, ChunkingOptions(max_tokens=2), tokenizer=WORD), ChunkingOptions(max_tokens=1), tokenizer=WORD, keys=["doc_id", "position"])
    assert sorted((r.source_position if "source_position" in r else None) is not None for r in again.collect()) == [True] * 3
    body = spark.createDataFrame([(1, "a b c", "keep")], "doc_id long, body string, text string")
    assert {(r.text, r.source_text) for r in api.chunk_text(body, ChunkingOptions(max_tokens=2), text="body", tokenizer=WORD).collect()} == {("a b", "keep"), ("c", "keep")}
    flagged = spark.createDataFrame([(1, ["x", "y"], True)], "list_id long, items array<string>, position boolean")
    assert api.chunk_list(flagged, ChunkingOptions(strategy="WholeList"), ordered="position", tokenizer=WORD).first().text == "1. x\n2. y"


def test_size_guard_that_skips_and_reports(spark):
    from loomspark.operators.chunk import over_limit

    df = spark.createDataFrame([(1, "abcdef"), (2, "abc"), (3, None)], "doc_id long, text string")
    o = ChunkingOptions(max_input_characters=5)
    assert [r.doc_id for r in api.chunk_text(df, o, tokenizer=WORD, oversize="skip").collect()] == [2]
    assert [tuple(r) for r in over_limit(df, o).collect()] == [(1, 6)] and over_limit(df, ChunkingOptions(max_input_characters=0)).count() == 0


def test_histogram_and_observed_counts(spark):
    from pyspark.sql import Observation

    from loomspark.operators.chunk import token_histogram

    df = spark.createDataFrame([(1, "a b c " * 30), (2, "x")], "doc_id long, text string")
    c = api.chunk_text(df, ChunkingOptions(max_tokens=64), tokenizer=WORD)
    assert {r.upper_bound: r.n_chunks for r in token_histogram(c).collect() if r.n_chunks} == {16: 1, 32: 1, 64: 1}
    seen = Observation("seen")
    api.chunk_text(df, ChunkingOptions(max_tokens=64), tokenizer=WORD, observe=seen).collect()
    assert (seen.get["chunks_produced"], seen.get["chunk_tokens"], seen.get["tokens_le_16"], seen.get["tokens_more"]) == (3, 91, 1, 0)


def test_sweep_against_brute_force(spark):
    docs, spans = evaluation.sample_corpus(spark)
    configs = {k: evaluation.SWEEP[k] for k in ("fixed-128-overlap-32", "recursive-64", "sentence-64")}
    spec = tokenizers.public_bpe()
    got = {r.config: (r.recall, r.precision, r.iou, r.chunks_per_doc, r.tokens_per_chunk) for r in evaluation.sweep(docs, spans, configs, tokenizer=spec).collect()}
    texts, wanted = {r.doc_id: r.text for r in docs.collect()}, spans.collect()
    from loomspark.operators.chunk import _worker

    for name, o in configs.items():
        found = {d: _worker(spec, o, o.max_tokens, "text")(t)["pieces"] for d, t in texts.items()}
        scores = []
        for s in wanted:
            span = set(range(s.start, s.start + s.length))
            hit = [set(range(p["start_offset"], p["end_offset"])) for p in found[s.doc_id]]
            retrieved = set().union(*(h for h in hit if h & span))
            scores.append((len(span & retrieved) / len(span), len(span & retrieved) / len(retrieved), len(span & retrieved) / len(span | retrieved)))
        tokens = [p["token_count"] for ps in found.values() for p in ps]
        want = [*(sum(x) / len(x) for x in zip(*scores, strict=True)), len(tokens) / len(texts), sum(tokens) / len(tokens)]
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[name], want, strict=True)), name


def test_sweep_chunks_each_text_once(spark, sf_dir):
    from loomspark import catalogue

    plan = catalogue.QUERIES["evaluation_sweep"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    first = plan.split("== Initial Plan ==")[-1]
    assert first.count("ArrowEvalPython") == 1 and first.count("pythonUDF") < 20 and "Window" not in first


def test_sweep_agrees_with_scores_of_chunk_tables(spark):
    """Also where texts share a key or have none, spans are repeated, have no text or no length, or a text has no chunks."""
    docs = spark.createDataFrame([(1, "One two. Three four five. Six."), (1, "seven eight nine ten eleven twelve thirteen"), (2, ""), (3, None), (None, "no key at all"), (4, "left alone")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, "a", 4, 9), (1, "b", 0, 40), (1, "b", 0, 40), (1, "c", 5, 0), (1, "far", 900, 5), (2, "a", 0, 3), (None, "a", 0, 5), (9, "a", 0, 5), (4, "d", 2, None)], "doc_id long, label string, start int, length int")
    configs = {"two": ChunkingOptions(max_tokens=2), "lapped": ChunkingOptions(max_tokens=4, overlap_count=2), "sentence": ChunkingOptions(strategy="SentenceBased", max_tokens=5), "as two": ChunkingOptions(max_tokens=2)}
    rows = evaluation.sweep(docs, spans, configs, tokenizer=WORD).collect()
    for r in rows:
        want = evaluation.score(docs, spans, api.chunk_text(docs, configs[r.config], tokenizer=WORD)).first()
        assert all(abs(r[c] - want[c]) < 1e-12 for c in ("recall", "precision", "iou", "chunks_per_doc", "tokens_per_chunk")), r.config
    order = [r.config for r in rows]
    assert order.index("as two") == order.index("two") + 1 and {r.config: r.ord for r in rows} == {c: i for i, c in enumerate(configs)}
    assert [tuple(r)[:5] for r in evaluation.sweep(docs.limit(0), spans.limit(0), configs, tokenizer=WORD).collect()] == [(0.0,) * 5] * 4
