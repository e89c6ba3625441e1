"""The pipeline stage by stage against brute force, on the smallest tables."""

import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from test_dedup import brute_components
from test_mix_pages_vectors import brute_targets

import corpus_pipeline
from harvestlens.llm import byte_bpe, common, quality
from harvestlens.session import cut, tune

public_tokenizers = pytest.importorskip("public_tokenizers")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")


@pytest.fixture(scope="module")
def stages(spark):
    docs = common.table(tune(spark), FOLDER, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], FOLDER)))
    return out


def rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "MinHash near-dedup", "mixing sources", "byte-level BPE"]
    assert all(s.columns == stages[0].columns for s in stages[1:5])


def test_quality_stage(spark, stages):
    verdict = {r.doc_id: r.kept for r in quality.classify(stages[0], common.table(spark, FOLDER, "labels")).collect()}
    assert {r[0] for r in rows(stages[1])} == {k for k, kept in verdict.items() if kept}
    labels = {r.doc_id: r.quality for r in common.table(spark, FOLDER, "labels").collect()}
    assert np.mean([verdict[k] for k, q in labels.items() if q == 1 and k in verdict]) > 0.98
    assert np.mean([verdict[k] for k, q in labels.items() if q == 0 and k in verdict]) < 0.5


def test_exact_stage(stages):
    best = {}
    for k, t, _ in rows(stages[1]):
        best[t or ""] = max(best.get(t or "", k), k)
    assert sorted(r[0] for r in rows(stages[2])) == sorted(best.values())


def test_near_stage(stages):
    groups = brute_components(rows(stages[2]))
    assert sorted(r[0] for r in rows(stages[3])) == sorted(k for k, (_, c) in groups.items() if k == c)


def test_mixing_stage(stages):
    size = {k: len((t or "").encode().split()) for k, t, _ in rows(stages[3])}
    source = {k: s for k, _, s in rows(stages[3])}
    copies = Counter(k for k, _, _ in rows(stages[4]))
    assert set(copies) <= set(size) and max(copies.values()) <= 3
    whole, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for k, n in size.items():
        whole[source[k]] += n
        taken[source[k]] += copies[k] * n
        longest[source[k]] = max(longest[source[k]], n)
    for s, target in brute_targets(whole).items():
        assert abs(taken[s] - target) <= longest[s] / 2 + 1e-6


def test_encoding_stage(spark, stages):
    import tiktoken

    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, special_tokens={},
                              mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY)))
    expected = Counter()
    for k, t, _ in rows(stages[4]):
        ids = coder.encode_ordinary(t or "")
        expected[k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in stages[5].collect()) == expected
