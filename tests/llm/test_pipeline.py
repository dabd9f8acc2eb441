"""The pipeline against a brute-force version of each stage on its own input."""

import hashlib

import corpus_pipeline
import numpy as np
import pytest

from loomspark.llm import mixing, pieces, quality_rules, queries
from loomspark.llm.common import table, written
from tests.llm.test_llm import WORDS, brute_components


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), "test-stage")
        out.append(docs)
    return out


def test_names_and_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality(stages):
    want = {r.doc_id for r in quality_rules.measure(stages[0]).collect() if r.kept}
    assert {r.doc_id for r in stages[1].collect()} == want


def test_near(stages):
    rows = sorted(stages[1].collect(), key=lambda r: r.doc_id)
    found = brute_components([r.text for r in rows], 5, 80)
    assert {r.doc_id for r in stages[2].collect()} == {rows[i].doc_id for i, (_, c) in found.items() if i == c}


def test_substrings(stages):
    rows, seen, want = sorted(stages[2].collect(), key=lambda r: r.doc_id), set(), {}
    for r in rows:
        w, gone = WORDS(r.text), set()
        for p in range(len(w) - 19):
            if (g := tuple(w[p : p + 20])) in seen:
                gone.update(range(p, p + 20))
            seen.add(g)
        want[r.doc_id] = [x for p, x in enumerate(w) if p not in gone]
    assert {r.doc_id: WORDS(r.text) for r in stages[3].collect()} == {k: v for k, v in want.items() if v}


def test_mix(stages):
    taken = {r.doc_id: r.taken for r in mixing.takes(stages[3]).collect()}
    got = dict.fromkeys(taken, 0)
    for r in stages[4].collect():
        got[r.doc_id] += len(WORDS(r.text))
    assert got == taken


def test_encode(stages):
    model = pieces.load_model(queries.vocabulary("piece_bpe_32k.model"))
    want = []
    for r in stages[4].collect():
        ids = model.encode(r.text, add_bos=True, add_eos=True)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    assert sorted(tuple(r) for r in stages[5].collect()) == sorted(want)
