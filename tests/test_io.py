
import numpy as np
import pytest
from pyspark.sql import functions as F

from traceworks.functions import prices
from traceworks.operators.knn import nearest_neighbours
from traceworks.plans import cost, retrieval
from traceworks.sources import files, sinks, warehouse
from traceworks.streaming import budget_stream, files_stream


def test_knn_matches_brute_force_in_one_and_many_blocks(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(200, 8)).astype(np.float32)
    vectors[50] = vectors[51]
    base = spark.createDataFrame([(i, f"c{i % 3}", v.tolist()) for i, v in enumerate(vectors)],
                                 "doc_id long, collection string, vector array<float>").repartition(5)
    queries = spark.createDataFrame([(i, vectors[i * 7].tolist()) for i in range(9)], "query_id long, query_vector array<float>")
    want = {}
    for q in range(9):
        d = ((vectors.astype(float) - vectors[q * 7].astype(float)) ** 2).sum(axis=1)
        want[q] = sorted(range(200), key=lambda i: (d[i], i))[:6]
    for blocks in ({}, {"query_block": 2, "base_block": 30}):
        rows = nearest_neighbours(base, queries, 6, **blocks).orderBy("query_id", "rank").collect()
        got = {}
        for r in rows:
            got.setdefault(r["query_id"], []).append(r["doc_id"])
        assert got == want


def test_context_budget_cuts_the_last_chunk(spark):
    rows = [(1, i, "documents", f"f{i}", "u", "x" * 50) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "query_id long, rank int, collection string, filename string, source_uri string, text string")
    chunks = retrieval.context_chunks(df, max_chars=150).orderBy("rank").collect()
    assert sum(len(c["chunk"]) for c in chunks) == 150 and len(chunks) == 3


def test_file_loads(spark, tmp_path):
    (tmp_path / "My File-1.csv").write_text("id,name\n1,a\n2,b\n")
    (tmp_path / "x.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    (tmp_path / "y.log").write_text("1\tq\n")
    assert files.read_file(spark, str(tmp_path / "My File-1.csv")).dtypes == [("id", "int"), ("name", "string")]
    assert files.read_file(spark, str(tmp_path / "x.jsonl")).count() == 2
    assert files.read_file(spark, str(tmp_path / "y.log")).columns == ["_c0", "_c1"]
    assert files.table_name("/a/My File-1.csv") == "my_file_1"
    assert files.snake_case("  customerID (Main)") == "customer_id_main"


def test_mixed_encodings(spark, tmp_path):
    for name, enc in (("a", "utf-8"), ("b", "utf-16"), ("c", "latin-1")):
        (tmp_path / f"{name}.txt").write_bytes("déjà vu".encode(enc))
    got = {r["path"][-5]: r["text"] for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a": "déjà vu", "b": "déjà vu", "c": "déjà vu"}


def test_catalog_listing_is_capped(spark):
    spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").createOrReplaceTempView("cap_me")
    rows = files.catalog_columns(spark, ["default"], max_tables=50, max_columns=2).where("table_name = 'cap_me'").collect()
    assert [(r["position"], r["column_name"]) for r in rows] == [(1, "a"), (2, "b")]


def test_reader_options():
    c = warehouse.Connection("redshift", {"host": "h", "port": "5439", "database": "d"}, "u", "p")
    o = c.options("t", warehouse.ReadPlan("id", "1", "100", 8))
    assert o["url"] == "jdbc:redshift://h:5439/d" and o["numPartitions"] == "8" and o["partitionColumn"] == "id"
    assert warehouse.Connection("sqlite", {"path": "/x.db"}).options("t")["url"] == "jdbc:sqlite:/x.db"
    b = warehouse.Connection("bigquery", {"project": "p", "dataset": "d"})
    assert (b.format, b.options("t")["table"]) == ("bigquery", "p.d.t")
    with pytest.raises(ValueError):
        warehouse.Connection("other", {}).options("t")


def test_write_counts_rows_in_the_same_pass(spark, tmp_path):
    assert sinks.write_counted(spark.range(37), str(tmp_path / "w")) == 37


def test_audited_step_records_success_and_failure(spark, tmp_path):
    path = str(tmp_path / "steps")

    @sinks.audited("a", path)
    def step(spark, run_id, ok=True):
        if not ok:
            raise ValueError("broken " + "x" * 600)
        return "fine"

    assert step(spark, "r1") == "fine"
    with pytest.raises(ValueError):
        step(spark, "r1", ok=False)
    rows = {r["success"]: r for r in spark.read.parquet(path).collect()}
    assert rows[True]["result_preview"] == "fine" and len(rows[False]["error_message"]) == 500


def test_file_hash_changes_with_content(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text("{}")
    first = files.content_hash(spark, str(p))
    p.write_text("{ }")
    assert first != files.content_hash(spark, str(p))


def test_prices_and_rounding(spark):
    df = spark.createDataFrame([("gpt-4o-mini-2024", 1000, 1000), ("Claude-x", 1000, 0), ("zzz", 1_000_000, 0)],
                               "model string, i int, o int")
    cost_col = prices.usd(prices.cost_nanos(prices.prefix_rate(F.col("model")), F.col("i"), F.col("o")))
    assert [r[0] for r in df.select(cost_col).collect()] == [0.00075, 0.003, 10.0]


def _calls(spark, rows):
    return spark.createDataFrame(rows, "run_id string, model string, prompt_tokens int, completion_tokens int, call_ts string")


def test_budget_states(spark):
    rows = [("r1", "gpt-4o", 100_000, 20_000, "2024-01-01T00:00:00")] * 2
    got = {r["limit_type"]: (r["spent_usd"], r["state"]) for r in cost.budget_check(_calls(spark, rows)).collect()}
    assert got == {"per_run": (1.6, "STOP"), "per_day": (1.6, "OK"), "per_month": (1.6, "OK")}


def test_alerts_are_reported_once_over_restarts(spark, tmp_path):
    inbox, log, mark = (str(tmp_path / n) for n in ("in", "log", "ck"))
    row = ("r1", "gpt-4o", 100_000, 20_000, "2024-01-01T00:00:00")
    seen = []
    for _ in range(3):
        _calls(spark, [row]).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(_calls(spark, [row]).schema).parquet(inbox)
        q = budget_stream.alerts(stream, log, mark, cost.Budget(per_run=1.0))
        q.awaitTermination()
        rows = budget_stream.reported(spark, log).where("limit_type = 'per_run'").collect()
        seen.append(sorted(r["level"] for r in rows))
    assert seen == [["WARN"], ["STOP", "WARN"], ["STOP", "WARN"]]


def test_file_stream_reads_new_files_only(spark, tmp_path):
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    inbox.mkdir()
    counts = []
    for i in range(3):
        if i < 2:
            (inbox / f"f{i}.csv").write_text(f"id,d,n\n{i},2024-01-0{i + 1},1.5\n{i},bad,x\n")
        stream = files_stream.incoming_files(spark, str(inbox), "id int, d string, n string", "csv", header=True)
        files_stream.ingest_files(stream, files_stream.TableConfig(date_columns=["d"], numeric_columns=["n"]), out,
                                  mark).awaitTermination()
        counts.append(spark.read.parquet(out).count())
    assert counts == [2, 4, 4]
    assert spark.read.parquet(out).where("d is null and n is null").count() == 2


def test_prompt_rows_keep_turn_order(spark):
    history = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "conv_id long, turn long, role string, text string")
    asked = spark.createDataFrame([(1, "why?", "ctx")], "conv_id long, question string, context string")
    rows = retrieval.prompt_rows(history, asked, "sys").orderBy("position").collect()
    assert [r["role"] for r in rows] == ["system", "user", "assistant", "user"]
    assert rows[-1]["content"].endswith("Question: why?")




def test_percentile_ranges_split_close_values(spark):
    from pyspark.sql import functions as F

    from traceworks.operators.quantiles import exact_percentiles, ranged

    rng = np.random.default_rng(3)
    values = [float(x) for x in 100 + rng.random(20_000)]
    df = spark.createDataFrame([("k", x) for x in values] + [(None, 1.0)], "key string, value double")
    sizes = [r["n"] for r in ranged(df, ["key"], F.col("value")).groupBy("_gb").agg(F.sum("_n").alias("n")).collect()]
    assert len(sizes) > 100 and max(sizes) < 2000
    got = {r["key"]: (r["p50"], r["p95"]) for r in exact_percentiles(df, ["key"], "value", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got["k"] == pytest.approx(tuple(np.quantile(values, [0.5, 0.95]))) and got[None] == (1.0, 1.0)


def test_search_keeps_collections_apart(spark):
    kb = spark.createDataFrame([(1, "pdfs", "a.pdf", "u", "one", [0.0, 1.0]), (1, "images", "b.png", "v", "two", [1.0, 0.0])],
                               "doc_id long, collection string, filename string, source_uri string, text string, vector array<float>")
    hits = retrieval.search(kb, spark.createDataFrame([(5, [0.0, 1.0])], "query_id long, query_vector array<float>"), 1).collect()
    assert [(h["collection"], h["filename"], h["text"]) for h in hits] == [("pdfs", "a.pdf", "one")]


def test_sql_functions_agree_with_column_functions(spark):
    from pyspark.sql import functions as F

    from traceworks.functions import pii, redact, register, sqltext

    register.register(spark)
    texts = ["mail a@x.org or 123-45-6789, password=hunter2abc", "select 'x', 12.5 from `db`.Orders o join c.items on 1 = 2",
             "a  b\n\tc " + "word " * 200, "", None, "email", "user_phone", "total"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    pairs = {"redact_pii": redact.redact_pii(t)[0], "summarise": redact.summarise(t), "sql_fingerprint": redact.sql_fingerprint(t),
             "sql_tables": F.array_join(sqltext.referenced_tables(t), ","), "pii_class": pii.name_class_column(t)["pii_type"]}
    for r in df.select(*[F.expr(f"{n}(t)").alias(n) for n in pairs], *[c.alias(f"{n}_") for n, c in pairs.items()]).collect():
        for n in pairs:
            assert r[n] == r[f"{n}_"], n
