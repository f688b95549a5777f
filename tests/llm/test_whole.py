"""Cases the small data does not hold: results that are wrong only at size, or were cut short."""

from __future__ import annotations

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from test_operators import SF  # noqa: E402
from traceworks.llm import grams, lines, mixing, substring, warc  # noqa: E402
from traceworks.llm.common import written  # noqa: E402


def test_substring_blocks_of_one_anchor_do_not_meet_by_chance(spark):
    # The run with the lowest hash of many is the anchor of every window that holds it.
    rng = random.Random(5)
    runs = [" ".join(f"r{rng.randrange(10**6)}" for _ in range(5)) for _ in range(200_000)]
    w = grams.words([r.encode() for r in runs])
    run = runs[int(np.argmin(grams.runs(w.hashes, 5)[w.first[:-1]]))]
    rows = [(i, " ".join([f"a{i}x{j}" for j in range(8)] + [run] + [f"b{i}x{j}" for j in range(7)]), i) for i in range(20_000)]
    rows.append((20_000, rows[77][1], 0))
    out = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(8))
    assert [(r.doc_id, r.n_removed) for r in out.where("n_removed > 0").collect()] == [(20_000, 20)]


def test_documents_keep_their_short_lines(spark):
    footer = "This text may be copied under the terms of its licence."
    verse = [f"verse {i} of it" for i in range(300)]
    texts = [footer, "\n".join([*verse, footer]), footer + "\n \t\n", " \n", "\n" + footer + "\nend"]
    rows = [(i, t, len(t)) for i, t in enumerate(texts)]
    out = lines.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"))
    left = "\n".join(verse)
    assert sorted(map(tuple, out.collect())) == [
        (0, footer, len(footer)), (1, left, len(left)), (3, " \n", 2), (4, "\nend", 4)]


@pytest.mark.parametrize("n", [4, 10, 60])
def test_mixing_holds_the_given_weights_over_many_stretches(spark, n):
    # Weights that are no multiples of anything: half for one source, the rest uneven.
    weight = [0.5] + [0.5 * (k + 2 ** 0.5) / sum(j + 2 ** 0.5 for j in range(1, n)) for k in range(1, n)]
    weights = spark.createDataFrame([(f"s{k}", w) for k, w in enumerate(weight)], "source string, weight double")
    rows = [(f"s{k}", int(w * 9000)) for k, w in enumerate(weight)]
    docs = spark.createDataFrame(rows, "source string, n int").selectExpr(
        "source", "explode(sequence(1, n)) i").selectExpr("source", "i doc_id", "string(i) text")
    out = mixing.schedule(docs, weights, block=1).select("source", "block", "slot").collect()
    assert len(out) == sum(k for _, k in rows)
    slots = {r.slot: int(r.source[1:]) for r in out}
    assert len(slots) == len(out)
    done = [0] * n
    for t in range(8900):
        if t in slots:
            done[slots[t]] += 1
        assert all(abs(d - (t + 1) * w) < 1 for d, w in zip(done, weight))


def test_positions_of_the_result_give_the_slots_of_the_mix(spark, tmp_path, monkeypatch):
    # Files of uneven sizes, which a reader takes largest first.
    docs = spark.range(600).selectExpr("id doc_id", "concat('text ', repeat(string(id), int(pow(id % 24, 2)))) text",
                                       "concat('s', id % 3) source", "id n_chars")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    slot = {r.doc_id: (r.slot, r.place) for r in mixing.schedule(docs).collect()}
    stages = dict(corpus_pipeline.STAGES)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, stages[n]) for n in ("source mixing", "sentencepiece")])
    rows = corpus_pipeline.run(spark, str(tmp_path)).orderBy("position").collect()
    assert len({r.position for r in rows}) == 600
    assert [slot[r.doc_id] for r in rows] == sorted(slot.values())
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 7)
    try:
        mixed = written(mixing.in_mixed_order(docs), "mixed")
        rows = corpus_pipeline.sentencepiece(spark, mixed, "").orderBy("position").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert [slot[r.doc_id] for r in rows] == sorted(slot.values())


def test_equal_short_lines_are_repeats(spark):
    texts = ["All rights reserved.\none\n\nfirst", "two\nAll rights reserved.\n\n \n 見出し", "見出し\n 見出し\nAll rights reserved!\none", "x\nx"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in lines.dedup_lines(docs).collect()}
    assert out == {0: (4, 0, texts[0]), 1: (5, 1, "two\n\n \n 見出し"), 2: (4, 2, "見出し\nAll rights reserved!"), 3: (2, 1, "x")}


def test_short_lines_of_the_given_documents(spark):
    if not os.path.isdir(SF):
        pytest.skip("test data not present")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    seen, again = set(), dict.fromkeys(texts, 0)
    for i, t in sorted(texts.items()):
        for x in t.split("\n"):
            if len(x) < 32 and x.strip(" \t\n\r\x0b\x0c"):
                again[i] += x in seen
                seen.add(x)
    alone = brute.lines({i: "\n".join(x for x in t.split("\n") if len(x) >= 32) for i, t in texts.items()})
    want = {i: n + again[i] for i, (_, n, _) in alone.items()}
    assert sum(again.values()) > 0 and {r.doc_id: r.n_removed for r in lines.dedup_lines(docs).collect()} == want


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    pages = spark.range(400).selectExpr("id page_id", "'u' url", "repeat(sha2(string(id), 512), 8) html").repartition(2)
    files = warc.write_archives(pages, str(tmp_path))
    rows = warc.read_archives(spark, str(tmp_path), files, split_bytes=20_000)
    assert rows.count() == 400
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 5


def test_many_rows_of_one_id_are_documents_of_their_own(spark):
    line = "a line that is long enough to be compared with others "
    rows = [(None, f"{line}{i}{i}{i}{i} " + " ".join(f"w{i}x{k}" for k in range(40))) for i in range(20_000)]
    rows += [(7, f"{line}{i}-{i}-{i} " + " ".join(f"v{i}x{k}" for k in range(40))) for i in range(2_000)] + rows[:1]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    out = substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed")
    assert out.count() == len(rows) and out.where("n_removed > 0").count() == 0
    out = lines.dedup_lines(docs).select("doc_id", "n_removed")
    assert out.count() == len(rows) and out.where("doc_id is null").count() == 20_001
