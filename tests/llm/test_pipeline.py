"""The pipeline's stages, one after the other, against plain versions on what each was given."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from test_operators import DOCS, SF, odd_documents  # noqa: E402
from traceworks.llm.common import written  # noqa: E402


@pytest.mark.parametrize("given", [True, False])
def test_stages(spark, given):
    if given and not os.path.isdir(SF):
        pytest.skip("test data not present")
    if given:
        docs = spark.read.parquet(f"{SF}/documents.parquet")
    else:
        rows = [(i, t, None, [None, "a", "b"][i % 3], 7, "t", "r", "k") for i, t in odd_documents().items()]
        docs = spark.createDataFrame(rows + [rows[6]], DOCS).repartition(3)
    names, sets = [n for n, _ in corpus_pipeline.STAGES], []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = written(stage(spark, docs, SF), "stage")
        if k < 4:
            assert sorted(out.columns) == sorted(docs.columns)
        sets.append(({r.doc_id: r.text for r in docs.collect()}, out.collect()))
        docs = out
    assert len(names) == 5
    before, after = sets[0]
    kept = {r.doc_id: r.text for r in after}
    assert kept.items() <= before.items()
    assert all(not brute.quality_counts(t)[5] for t in kept.values())
    before, after = sets[1]
    want = brute.lines(before)
    for r in after:
        n_lines, n_removed, digest = want.pop(r.doc_id) if r.doc_id in want else brute.lines(before)[r.doc_id]
        assert brute.sha(r.text) == digest and (n_removed == 0 or r.n_chars == len(r.text))
    for i, (_, n_removed, _) in want.items():
        assert n_removed == sum(bool(x.strip(" \t\n\r\x0b\x0c")) for x in before[i].split("\n")) > 0
    before, after = sets[2]
    assert {r.doc_id for r in after} == {i for i, v in brute.components(before, k=5).items() if v[2]}
    before, after = sets[3]
    assert {r.doc_id: r.text for r in after} == before
    before, after = sets[4]
    assert {r.doc_id for r in after} == set(before) and all(len(r.ids) == r.n_pieces for r in after)


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
