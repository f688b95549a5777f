"""Hard negatives, whitening and token counts against plain versions, on given data and on odd cases."""

from __future__ import annotations

import math
import os
import random
import sys
from fractions import Fraction

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))

import brute  # noqa: E402
from test_operators import SF, odd_documents  # noqa: E402
from traceworks.llm import negatives, tokens, whitening  # noqa: E402
from traceworks.llm.queries import LLM_ORACLES, LLM_QUERIES  # noqa: E402

ROWS = "vec_id long, embedding array<float>, label int, x string, tag string, block int, chunk int, rank int, n int"


def odd_vectors():
    """Nulls, NaN, shorter and empty vectors, ties, one common vector, repeated rows, rows without an id."""
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)], rng.randrange(3)) for i in range(220)]
    rows += [(i, [0.5, 0.25, 0.0, -1.0, 0.125], i % 2) for i in range(220, 330)]
    rows += [(400, None, 1), (401, [0.5, None, 0.1, 0.2, 0.3], 1), (450, [math.nan, 0.0, 0.0, 0.0, 0.0], 1),
             (451, [math.inf, 0.0, 0.0, 0.0, 0.0], 1), (500, [0.9, 0.9, 0.9, 0.9, 0.9], None), (550, [0.7, 0.1], 2),
             (551, [], 0), (600, [0.0] * 5, 1), (None, [0.6, 0.2, 0.0, -0.9, 0.1], 1), (650, [-1.0, 0.5, 0.0, 1.0, 0.0], 7)]
    return rows + [rows[50], rows[50], rows[221]]


@pytest.fixture(scope="module", params=["given", "odd"])
def vectors(request, spark, tmp_path_factory):
    if request.param == "given":
        if not os.path.isdir(SF):
            pytest.skip("test data not present")
        return SF
    folder = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame([(*r, "x", "t", 1, 2, 3, 4) for r in odd_vectors()], ROWS).repartition(3).write.parquet(
        f"{folder}/embeddings.parquet")
    return folder


def rows_of(spark, folder):
    return [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]


def test_hard_negatives(spark, vectors):
    got = LLM_QUERIES["op11_hard_negatives"](spark, vectors).collect()
    order = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted((tuple(r[c] for c in order) for r in got), key=str) == sorted(
        brute.hard_negatives(rows_of(spark, vectors)), key=str)


def test_hard_negatives_do_not_depend_on_the_blocks(spark, vectors, monkeypatch):
    rows = negatives.prepared(spark.read.parquet(f"{vectors}/embeddings.parquet"))
    want = sorted(map(str, negatives.mine(rows).collect()))
    monkeypatch.setattr(negatives, "BLOCK", 400)
    monkeypatch.setattr(negatives, "CHUNK", 60)
    monkeypatch.setattr(negatives, "STEPS", 3)
    assert sorted(map(str, negatives.mine(rows).collect())) == want and want


def test_scan_shrinks_the_bitmap_and_loses_nothing():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (400, 12)) * np.array([40, 1, 1, 20, 1, 1, 1, 9, 1, 1, 1, 1])
    table = pa.table({"vec_id": pa.array(range(400)), "label": pa.array([0] * 400), "tag": pa.array([0] * 400),
                      "x": pa.array(x.tolist(), pa.list_(pa.int64()))})
    cell = negatives.Block(negatives._pack_block([pa.scalar(0)], table), negatives._pack_chunk([pa.scalar(0)], table))
    for a in range(0, 400, 40):
        exact, looked_at = x @ x[a], []

        def keep(low, high, plain=negatives.best(7)):
            looked_at.append(len(low))
            return plain(low, high)

        alive = np.ones(400, bool)
        rows, score = cell.scan(a, alive, keep)
        assert (score == exact[rows]).all() and np.flatnonzero(alive).tolist() == rows.tolist()
        assert rows[cell.first(rows, score, 7)].tolist() == np.lexsort((np.arange(400), -exact))[:7].tolist()
        assert looked_at[0] == 400 and looked_at[-1] < 100


def test_hard_negatives_of_a_label_with_most_rows(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], 0 if rng.random() < 0.9 else 1 + i % 4) for i in range(1500)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = LLM_QUERIES["op11_hard_negatives"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in brute.hard_negatives(rows_of(spark, str(tmp_path)))} and got


def test_whitening(spark, vectors):
    got = LLM_QUERIES["op13_embedding_whitening"](spark, vectors).collect()
    kept = [(i, [float(c) for c in v]) for i, v, _ in rows_of(spark, vectors)
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims, n = max(len(v) for _, v in kept), len(kept)
    x = [[math.floor(1024 * c) + 100000 for c in v] + [100000] * (dims - len(v)) for _, v in kept]
    sums = [sum(col) for col in zip(*x)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(r, sums)] for r in x])
    values, turned = np.linalg.eigh(centred.T @ centred / n)
    values, turned, width = values[::-1], turned[:, ::-1], min(8, dims)
    want = centred @ turned[:, :width] / np.sqrt(values[:width])
    rows = {}
    for r in got:
        rows.setdefault((r.vec_id, r.component), []).append(r)
    assert len(got) == n * width and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-9
    sign = {}
    for (i, _), row, w in zip(kept, x, want):
        deviation = sum((n * a - s) ** 2 for a, s in zip(row, sums))
        for k in range(width):
            found = [r for r in rows[i, k + 1] if r.deviation == deviation]
            assert found and found[0].explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
            if abs(w[k]) > 1e-3:
                s = sign.setdefault(k, math.copysign(1, found[0].whitened * w[k]))
                assert found[0].whitened == pytest.approx(s * w[k], rel=1e-6)


def test_whitening_of_badly_conditioned_and_dependent_rows(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(500, 4)) * [1e5, 1.0, 1e3, 0.05]
    a = np.round(np.column_stack([a, a[:, 0], np.full(500, 3.0)]) * 1024) / 1024
    rows = [(i, v) for i, v in enumerate(a.tolist())]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(out) == 500 * 6 and out[0].identity_error < 1e-4
    by = {k: [r.whitened for r in sorted(out, key=lambda r: r.vec_id) if r.component == k] for k in range(1, 7)}
    assert all(v is None for k in (5, 6) for v in by[k]) and all(v is not None for k in (1, 2, 3, 4) for v in by[k])
    x = np.floor(a[:, [0, 1, 2, 3]] * 1024)
    x = np.column_stack([x, x[:, 0]])
    x -= x.mean(axis=0)
    sigma = np.linalg.svd(x, compute_uv=False)[:4]
    share = [next(r.explained for r in out if r.component == k) for k in (1, 2, 3, 4)]
    assert share == pytest.approx((sigma ** 2 / (sigma ** 2).sum()).tolist(), rel=1e-4)


def test_whitening_of_few_rows(spark):
    kind = "vec_id long, embedding array<float>"
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25])], kind)).collect()
    assert [(r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one] == [
        (1, 1, 0, None, 0.0, None), (2, 1, 0, None, 0.0, None)]
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [math.nan])], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, [])], kind)).count() == 0
    two = whitening.whiten(spark.createDataFrame([(None, [3e38, 0.0]), (1, [-3e38, 0.5])], kind)).collect()
    assert sorted(abs(r.whitened) for r in two if r.component == 1) == pytest.approx([1.0, 1.0])


def library(texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(tokens.tokenizer_path()).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("given", [True, False])
def test_token_counts(spark, tmp_path, given):
    if given and not os.path.isdir(SF):
        pytest.skip("test data not present")
    folder = SF
    if not given:
        folder = str(tmp_path)
        texts = [*odd_documents().values(), "a<|endoftext|>b  <|endoftext|>", "<|endoftext|>", "<|endoftext|> 's", "x" * 3000]
        rows = [(i, t, "k") for i, t in enumerate(texts)] + [(None, "no id", "k"), (3, "one", "k")]
        spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").write.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = [(i, len(t.encode()), n, n > 512) for (i, t), n in zip(rows, library([t for _, t in rows]))]
    got = [tuple(r) for r in LLM_QUERIES["op12_token_counts"](spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("rounds", [0, 1, 3, 48])
def test_token_merging_on_random_text(rounds, monkeypatch):
    monkeypatch.setattr(tokens, "ROUNDS", rounds)
    monkeypatch.setattr(tokens, "MEMORY", 500)
    monkeypatch.setattr(tokens, "SHORT", 5)
    rng = random.Random(rounds)
    letters = "aaabbé日한՘࢏😀\x1c\x85\xa0​01² '''sdtmrvl.!?\n\t  "
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 16))) for _ in range(3000)]
    texts += ["".join(rng.choices("abcdefghij", k=4000)), "a" * 5001, "".join(map(chr, rng.choices(range(0x4e00, 0x9fa5), k=3000)))]
    counter = tokens.Counter(tokens.tokenizer_path())
    got = [n for k in range(0, len(texts), 500) for n in counter.count(texts[k : k + 500])]
    assert got == library(texts)


def test_token_counts_where_unicode_versions_differ():
    counter = tokens.Counter(tokens.tokenizer_path())
    texts = [f"ab{chr(c)}cd {chr(c)}12{chr(c)}.{chr(c)} " for c in range(0x80, 0x32000, 7) if not 0xD800 <= c < 0xE000]
    assert counter.count(texts) == library(texts) and counter.disputed


def test_long_texts_are_cut_where_tokens_begin(monkeypatch):
    monkeypatch.setattr(tokens, "GROUP", 50)
    rng = random.Random(5)
    counter = tokens.Counter(tokens.tokenizer_path())
    for _ in range(200):
        text = "".join(rng.choices("ab1.' \n\té日", k=rng.randint(0, 600)))
        parts = list(counter.stretches(text))
        assert "".join(parts) == text and sum(counter.count(parts)) == library([text])[0]


def test_check_sql_is_given():
    assert "op11_hard_negatives" in LLM_ORACLES
