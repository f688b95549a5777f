"""Every operator's query against a plain version, on the smallest data and on a table of odd cases."""

from __future__ import annotations

import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import brute  # noqa: E402
from traceworks.llm import (chat, components, fingerprints, lines, minhash, mixing, pieces, quality,  # noqa: E402
                            substring, suffixdedup, suffixes, warc)
from traceworks.llm.queries import LLM_QUERIES  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, tag string, row string, kept string"


def odd_documents():
    """Nulls, empty and short texts, copies, shared passages, near lines, a very long text, repeated rows."""
    random.seed(4)
    vocabulary = ["".join(random.choice("abcdeé") for _ in range(random.randint(2, 8))) for _ in range(300)]

    def prose(n):
        return " ".join(random.choice(vocabulary) for _ in range(n))

    passage, base = prose(90), prose(150)
    line = "a line that is long enough to be compared " + prose(4)
    texts = [None, "", "   \n\t", "one", "one two three", prose(25), base, base, base + " x",
             " ".join(base.split()[:140] + ["new"] * 3), prose(30) + " " + passage + " " + prose(30),
             passage + "\n" + prose(40), prose(10) + " " + passage, "again and again " * 200, prose(20_000),
             line + "\n" + prose(30), line + "x\n" + prose(30), line[1:] + "\n" + line + "\n" + prose(5),
             "\x1c  ## ** $$ || <> " * 10, "ÀÉ 日本 😀 tab\tnew\nline\r\n\x0bend  double ▁", "WORD!! " * 40,
             base.upper(), base.replace(" ", "  ")]
    return {i: t for i, t in enumerate(texts)}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder like the given ones, with extra columns whose names clash with the operators' own."""
    folder = str(tmp_path_factory.mktemp("odd"))
    docs = odd_documents()
    rows = [(i, t, None, [None, "a", "b"][i % 3], None, "t", "r", "k") for i, t in docs.items()]
    rows.append(rows[6])  # a repeated row
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "<turn>x\n### \ny</turn>\n\\</turn>\\\\"), (1, 1, "assistant", None),
             (2, 0, None, "\\"), (2, 1, "assistant", "\n### "), (3, None, "a\nb\\n<turn>", "</turn>\n"), (None, 0, "user", "")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(
        f"{folder}/conversations.parquet")
    pages = [(1, "u 1\n2", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "ü", "é" * 70_000), (0, "u", "other"),
             (9, "u", "same")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.fixture(scope="module", params=["given", "odd"])
def folder(request, odd):
    if request.param == "given" and not os.path.isdir(SF):
        pytest.skip("test data not present")
    return SF if request.param == "given" else odd


def documents(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


def answers(spark, folder, name, *columns):
    """Result rows by id; repeated rows have to agree."""
    rows = LLM_QUERIES[name](spark, folder).collect()
    out = {}
    for r in rows:
        key, value = r[0], tuple(r[c] for c in columns)
        assert out.setdefault(key, value) == value
    source = {"op4": "conversations", "op5": "pages"}.get(name[:3], "documents")
    if source == "documents":
        assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    return out


def test_substring_dedup(spark, folder):
    assert answers(spark, folder, "op3_substring_dedup", "n_words", "n_removed", "kept_sha256") == brute.repeats(
        documents(spark, folder))


@pytest.mark.parametrize("salt", [2, 256])
def test_suffix_dedup(spark, folder, salt, monkeypatch):
    monkeypatch.setattr(suffixdedup, "SALT_ROWS", salt)
    assert answers(spark, folder, "op9_suffix_dedup", "n_bytes", "n_removed", "n_spans", "kept_sha256") == \
        brute.byte_repeats(documents(spark, folder))


def test_suffix_dedup_of_planted_passages(spark, tmp_path):
    """Passages of over 50 words in three documents each: from 400 bytes on they go, shorter ones stay."""
    random.seed(9)

    def words(n):
        return " ".join("".join(random.choice("abcdefgh") for _ in range(random.randint(2, 5))) for _ in range(n))

    docs, expected = {}, {}
    for size in (0, 271, 394, 399, 400, 700):
        passage = words(250)[:size]
        assert size == 0 or len(passage.split()) > 50
        for edges in ("AU", "BV", "CW"):  # other bytes on both sides in each document
            before, after = words(80) + edges[0], edges[1] + words(80)
            text = before + passage + after
            out = size if size >= 400 else 0
            docs[len(docs)] = text
            expected[len(expected)] = (len(text), out, int(out > 0), brute.sha(before + after if out else text))
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert answers(spark, str(tmp_path), "op9_suffix_dedup", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected


def test_suffix_array_and_common_prefixes():
    import numpy as np

    random.seed(2)
    for _ in range(200):
        raw = bytes(random.choice(b"aaab\0") for _ in range(random.randint(0, 50)))
        a = np.frombuffer(raw, np.uint8)
        sa, tied = suffixes.suffix_array(a, 8)
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        found = suffixes.common_prefixes(a, sa, tied, 8, 12, lane=4)
        for k in range(1, len(raw)):
            shared = len(os.path.commonprefix([raw[sa[k - 1]:], raw[sa[k]:]]))
            assert found[k] == (min(12, shared) if tied[k] else 0) and (tied[k] or shared < 8)


@pytest.mark.parametrize("block", [2, 256])
def test_near_duplicates(spark, folder, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    assert answers(spark, folder, "op2_minhash_near_dedup", "n_shingles", "component_id", "kept") == brute.components(
        documents(spark, folder))


def test_near_duplicates_without_ids(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "x y z u v w")]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in out if r.doc_id is None) == [(-1, None, True)] * 2
    assert [(r.component_id, r.kept) for r in out if r.doc_id == 3] == [(3, True)] * 2


def test_near_duplicates_of_several_texts_of_one_id(spark):
    a, b = [" ".join(f"{c}{i}" for i in range(60)) for c in "xy"]
    rows = [(3, a), (3, b), (5, b + " new"), (2, a + " other"), (9, "z " * 9), (9, None), (4, "q r s t u")]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out) == [
        (2, 2, True), (3, 2, False), (3, 2, False), (4, 4, True), (5, 2, False), (9, 9, True), (9, 9, True)]


def test_near_duplicates_with_very_many_texts_of_one_id(spark):
    rows = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat_ws(
        " ", *[F.concat(F.lit(w), F.col("id")) for w in "abcdef"]).alias("text"))
    more = spark.createDataFrame([(8, "a5 b5 c5 d5 e5 f5"), (6, "a9 b9 c9 d9 e9 f9")], "doc_id long, text string")
    out = minhash.near_duplicates(rows.union(more), 4)
    assert [tuple(r) for r in out.groupBy("doc_id", "component_id").count().orderBy("doc_id").collect()] == [
        (6, 6, 1), (7, 6, 20_000), (8, 6, 1)]


def test_components_of_chains_stars_and_loops(spark):
    random.seed(7)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(5, 5), (200, 201), (201, 200)]
    random.shuffle(edges)
    got = {r.node: r.component for r in components.connected_components(
        spark.createDataFrame(edges + edges[:9], "u long, v long")).collect()}
    want = {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_quality_counts(spark, folder):
    got = answers(spark, folder, "op8_quality_rules", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                  "base_failed", "kept")
    docs = documents(spark, folder)
    assert {i: v[:6] for i, v in got.items()} == {i: brute.quality_counts(t) for i, t in docs.items()}
    assert not any(v[6] for v in got.values() if v[5])


def test_quality_verdicts_agree_with_labels(spark):
    folder = SF.replace("sf0.001", "sf0.01")
    if not os.path.isdir(folder):
        pytest.skip("test data not present")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in LLM_QUERIES["op8_quality_rules"](spark, folder).collect() if r.doc_id in labels]
    judged = [r for r in rows if not r.base_failed]
    good = [r.kept for r in judged if labels[r.doc_id] == 1]
    bad = [r.kept for r in judged if labels[r.doc_id] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_line_dedup(spark, folder):
    assert answers(spark, folder, "op7_line_dedup", "n_lines", "n_removed", "kept_sha256") == brute.lines(
        documents(spark, folder))


def test_banded_distance(spark):
    random.seed(1)
    pairs = []
    while len(pairs) < 300:
        a = [random.choice("abé😀") for _ in range(random.randint(5, 14))]
        b = list(a)
        for _ in range(random.randint(0, 4)):
            k = random.randrange(len(b) + 1)
            b[k : k + random.randint(0, 1)] = [random.choice("abé😀")] * random.randint(0, 1)
        if len(b) > 2 and abs(len(a) - len(b)) <= 2:
            pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", lines.banded_distance(F.col("a"), F.col("b"), 2).alias("d")).collect():
        assert min(r.d, 3) == min(brute.distance(r.a, r.b), 3)


def test_fingerprints(spark, folder):
    import xxhash

    docs = documents(spark, folder)
    order = sorted(docs, reverse=True)
    rows = {r.doc_id: r for r in LLM_QUERIES["op10_fingerprints"](spark, folder).collect()}

    def sketch(text):
        w, out = brute.words(text), set()
        for p in range(max(1, len(w) - fingerprints.SHINGLE + 1) if w else 0):
            seed = 42
            for x in w[p : p + fingerprints.SHINGLE]:
                seed = xxhash.xxh64_intdigest(x.encode(), seed)
            signed = seed - (1 << 64) if seed >> 63 else seed
            if signed < -(1 << 63) + (1 << 64) // fingerprints.SCALE:
                out.add(signed)
        return sorted(out)

    def near(a, b, same):
        if same:
            return 1.0
        least = min(len(a), len(b))
        return len(set(a) & set(b)) / least if least else 0.0

    for k, i in enumerate(order):
        text, after = docs[i] or "", docs[order[(k + 1) % len(order)]] or ""
        if folder != SF and i == 7:
            continue  # the next row is the repeated one, which reads itself
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r = rows[i]
        a, b, c = sketch(text), sketch(edited), sketch(after)
        if folder != SF and i == 6:
            continue
        assert (r.n_chars, r.edited_sha256) == (len(text), brute.sha(edited))
        assert r.fingerprint == "".join(f"{x & (1 << 64) - 1:016x}" for x in a)
        assert r.edited_fingerprint == "".join(f"{x & (1 << 64) - 1:016x}" for x in b)
        assert r.near_edited == pytest.approx(near(a, b, text == edited))
        assert r.near_next == pytest.approx(near(a, c, text == after))


def test_chat_round_trip(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    probe = "\\### Assistant: </turn> ok"
    want = brute.conversations(rows + [(-7, 0, "user", probe), (-7, 1, "assistant", probe)])
    assert answers(spark, folder, "op4_chat_formatting", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == want


def test_chat_grammar_on_random_text():
    random.seed(3)
    bits = ["<turn>", "</turn>", "### ", "\\", "\n", "x", "user", "\\\\", "", " "]
    for _ in range(3000):
        role, text = ("".join(random.choices(bits, k=random.randint(0, 6))) for _ in range(2))
        rendered, _, start, end = chat.format_turn(role, text)
        assert [t[:2] for t in chat.parse(rendered * 2)] == [(role, text)] * 2
        assert chat.unescape(rendered[start:end]) == text
    with pytest.raises(chat.Grammar):
        chat.parse("<turn>user\n### \nno end")


def test_warc_round_trip(spark, folder):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = answers(spark, folder, "op5_warc", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
    assert {i: v[:4] for i, v in got.items()} == brute.archive(pages) and all(v[4] for v in got.values())


def test_warc_ranges_own_their_records():
    import io

    random.seed(5)
    raw = b"".join(warc.record(i, "u", random.randbytes(random.randint(0, 300)) + warc.MAGIC, "X", None, False)
                   for i in range(30))
    for step in (1, 7, 500, 10**6):
        got = [r["page_id"] for s in range(0, len(raw), step) for r in warc.records_in_range(
            io.BytesIO(raw), s, min(s + step, len(raw)), len(raw), block=64)]
        assert got == list(range(30))


def test_mixing_keeps_every_source_within_a_block(spark):
    rows = [(i, f"t{i}", s) for i, s in enumerate(["a"] * 3000 + ["b"] * 900 + ["c"] * 700 + [None] * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    weights = spark.createDataFrame([("a", 0.61), ("b", 0.237), ("c", 0.1), (None, 0.053)], "source string, weight double")
    share = {r.source: (r.share, r.period) for r in mixing.shares(weights).collect()}
    assert sum(s for s, _ in share.values()) == 1000
    out = mixing.schedule(docs, weights, block=4).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(rows)))
    slots = {}
    for r in out:
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    end = min(max(r.slot for r in out if r.source == s) for s in share)
    done = dict.fromkeys(share, 0)
    for t in range(end):
        done[slots[t][0]] += 1
        for s, (part, period) in share.items():
            assert abs(done[s] - (t + 1) * part / period) < 1


def test_mixing_query_and_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = LLM_QUERIES["op6_source_mixing"](spark, folder).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    slot = {r.doc_id: (r.slot, r.place) for r in out}
    rows = mixing.in_mixed_order(docs)
    assert rows.columns == docs.columns
    ids = [r.doc_id for r in rows.collect()]
    if folder == SF:
        assert [slot[i] for i in ids] == sorted(slot.values())
    else:
        assert sorted(ids) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_pieces_decode_to_the_text(spark, folder):
    docs = documents(spark, folder)
    rows = pieces.encode_texts(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    for r in rows:
        text = docs[r.doc_id] or ""
        assert r.decoded == text.replace("▁", " ") and r.n_pieces == len(r.ids) and r.exact == ("▁" not in text)


def test_shared_search_finds_the_best_segmentation():
    vocabulary = pieces.Vocabulary(pieces.model_path())
    random.seed(8)
    words = {"".join(random.choices("▁theraiouénd日😀\x01", k=random.randint(1, 14))) for _ in range(600)}
    found = pieces.search(list(words), vocabulary)
    by_id = {i: s for s, i in vocabulary.score.values()}
    for word in words:
        total, ids = 0.0, found[word]
        unknown = [c for c in word if c not in vocabulary.score]
        total = sum(by_id[i] for i in ids if i in by_id)
        covered = sum(len(vocabulary.pieces[i]) for i in ids if i in by_id)
        total += (len(word) - covered) * vocabulary.unknown
        assert len(word) - covered <= len(unknown)
        assert total == pytest.approx(brute.best_score(word, vocabulary.score, vocabulary.unknown))


def test_merged_fingerprints_and_containment(spark):
    random.seed(10)
    text = lambda n: " ".join(f"w{random.randrange(10**6)}" for _ in range(n))
    whole = text(100_000).split()
    docs = [("big", 0, " ".join(whole))]
    true = {}
    for i, share in enumerate([0.0, 0.1, 0.5, 0.8, 1.0], 1):
        n = int(1000 * share)
        docs.append((f"s{i}", i, " ".join(whole[i * 5000 : i * 5000 + n] + text(1000 - n).split())))
        own, all_of = brute.shingles(docs[i][2], 5), brute.shingles(docs[0][2], 5)
        true[i] = len(own & all_of) / len(own)
    df = spark.createDataFrame(docs, "name string, doc_id long, text string")
    rows = {r.doc_id: r for r in fingerprints.fingerprints(df).collect()}
    pairs = spark.createDataFrame([(i, rows[i].hashes, rows[0].hashes) for i in true], "i int, a array<long>, b array<long>")
    got = {r.i: r for r in pairs.select("i", fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.containment(
        F.col("b"), F.col("a")).alias("back"), fingerprints.containment(fingerprints.coarser(F.col("a"), 8), F.col("b")).alias("eighth"),
        fingerprints.containment(F.array().cast("array<long>"), F.col("b")).alias("nothing")).collect()}
    for i, c in true.items():
        assert got[i].c == pytest.approx(c, abs=0.1) and got[i].eighth == pytest.approx(c, abs=0.15)
        assert got[i].back < 0.02 and got[i].nothing is None
    # Merged fingerprints are those of all shingles together, in any order and in several steps.
    own = fingerprints.fingerprints(df).join(df.selectExpr("doc_id", "doc_id % 2 as half", "cast(null as string) as gap"), "doc_id")
    once = fingerprints.merged(own, "gap").first()
    assert once.hashes == sorted(set().union(*[r.hashes for r in rows.values()]))
    halves = fingerprints.merged(own, "half").withColumn("gap", F.lit(None).cast("string"))
    assert fingerprints.merged(halves, "gap").first() == once
    coarse = fingerprints.merged(own, "gap", scale=64).first()
    assert coarse.hashes == [h for h in once.hashes if h < -(1 << 63) + (1 << 58)] and 0 < len(coarse.hashes)
    empty = fingerprints.fingerprints(spark.createDataFrame([(1, None), (1, "")], "doc_id long, text string"))
    assert [(r.doc_id, r.hashes, r.fingerprint) for r in fingerprints.merged(empty, "doc_id").collect()] == [(1, [], "")]


def test_long_words_are_searched_in_stretches(spark, monkeypatch):
    vocabulary = pieces.Vocabulary(pieces.model_path())
    random.seed(9)
    words = ["".join(random.choices(letters, k=n)) for letters in ("aehinorst", "日本語中文字😀", "a", "=/+0123abcXYZ")
             for n in (999, 1000, 1001, 5000, 20_007)]
    in_stretches = {w: list(i) for w, i in pieces.search(words, vocabulary).items()}
    assert all(list(pieces.search_long(w, vocabulary)) == in_stretches[w] for w in words if len(w) > pieces.LONG)
    monkeypatch.setattr(pieces, "LONG", 100_000)
    assert pieces.search(words, vocabulary) == in_stretches
    text = "".join(random.choices("日本語中文字漢かな", k=300_000))
    out = pieces.encode_texts(spark.createDataFrame([(1, text), (2, text[::-1]), (3, "a b")], "doc_id long, text string")).collect()
    assert all(r.exact and r.n_pieces == len(r.ids) for r in out)


@pytest.mark.parametrize("name", sorted(LLM_QUERIES))
def test_empty_tables(spark, tmp_path, name):
    folder = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(
        f"{folder}/conversations.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    assert LLM_QUERIES[name](spark, folder).count() == (1 if name.startswith("op4") else 0)


def test_weak_supervision_without_any_bad_vote(spark):
    text = " ".join("word" + chr(97 + i % 26) * (1 + i // 26) for i in range(60))
    rows = quality.verdicts(spark.createDataFrame([(i, text + " end" * i) for i in range(5)], "doc_id long, text string"))
    assert all(r.kept for r in rows.collect())


def test_substring_rows_that_share_an_id(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, b), (None, a), (2, b + " " + a)]
    out = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in out) == [(0, 30, 0), (1, 30, 0), (1, 30, 30), (2, 60, 60)]
