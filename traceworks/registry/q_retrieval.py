"""Knowledge base: ingest, nearest neighbours, context and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceworks import fixtures as fx
from traceworks.operators.knn import nearest_neighbours, nearest_per_collection
from traceworks.plans import filings, retrieval
from traceworks.registry.base import query, table
from traceworks.registry.q_policy import _COLUMN, _NODE
from traceworks.sources import sinks
from traceworks.sources.file_table import FileTable


def kb(spark, sf):
    return fx.knowledge_base(spark, sf)


# One query vector per label: the vector with the lowest id.
QUERY_SQL = "select label as query_id, min_by(embedding, vec_id) as query_vector from embeddings group by 1"


def query_vectors(spark, sf):
    return table(spark, sf, "embeddings").groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.min_by("embedding", "vec_id").alias("query_vector"))


KNN_SQL = f"""knn as (select * from (select *, row_number() over (partition by query_id order by distance, doc_id) as rank
  from (select q.query_id, k.doc_id, k.collection, k.filename, k.source_uri, k.text, list_sum(list_transform(
      list_zip(k.vector, q.query_vector), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))) as distance
    from ({fx.KB_SQL}) k, ({QUERY_SQL}) q)) where rank <= 5)"""
_HIT = "query_id, doc_id, collection, rank, round(distance, 6) as distance"


@query("r03_knn_search", f"with {KNN_SQL} select {_HIT} from knn")
def _(spark, sf):
    return nearest_neighbours(kb(spark, sf), query_vectors(spark, sf), 5).withColumn("distance", F.round("distance", 6))


@query("o04_top_k_per_collection", f"""select query_id, doc_id, collection, round(distance, 6) as distance from (
  select *, row_number() over (partition by query_id, collection order by distance, doc_id) as rank from (
    select q.query_id, k.doc_id, k.collection, list_sum(list_transform(
      list_zip(k.vector, q.query_vector), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))) as distance
    from ({fx.KB_SQL}) k, ({QUERY_SQL}) q)) where rank <= 5""")
def _(spark, sf):
    """Small blocks, so that several pairs of them meet."""
    return nearest_per_collection(kb(spark, sf), query_vectors(spark, sf), 5, query_block=2, base_block=100).withColumn(
        "distance", F.round("distance", 6))


@query("j09_hits_with_source", f"with {KNN_SQL} select query_id, rank, filename, source_uri, collection from knn")
def _(spark, sf):
    return retrieval.search(kb(spark, sf), query_vectors(spark, sf)).select(
        "query_id", "rank", "filename", "source_uri", "collection")


CHUNK_CTE = f"""{KNN_SQL}, sized as (select *, '[' || collection || '] ' || filename || ' - ' || source_uri || chr(10)
    || case when trim(text) = '' then '(No extracted text)' else trim(text, ' ') end || chr(10) as snippet from knn),
budget as (select *, 6000 - coalesce(sum(length(snippet)) over (partition by query_id order by rank
    rows between unbounded preceding and 1 preceding), 0)::bigint as left_over from sized),
chunks as (select query_id, rank, snippet[:left_over] as chunk from budget where left_over > 0)"""


@query("w12_context_budget", f"with {CHUNK_CTE} select query_id, rank, chunk from chunks")
def _(spark, sf):
    return retrieval.context_chunks(retrieval.search(kb(spark, sf), query_vectors(spark, sf)))


@query("r04_context_text", f"""with {CHUNK_CTE} select query_id, string_agg(chunk, chr(10) || chr(10) order by rank) as context
from chunks group by 1""")
def _(spark, sf):
    return retrieval.context_text(retrieval.context_chunks(
        retrieval.search(kb(spark, sf), query_vectors(spark, sf))))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LAST = "select conv_id, max(turn) as t, max_by(text, turn) as question from conversations group by 1"


@query("r06_prompt_rows", f"""select conv_id, 0::bigint as position, 'system' as role, {_q(retrieval.SYSTEM_TEXT)} as content from ({_LAST})
union all select conv_id, turn + 1, role, text from conversations
union all select conv_id, t + 2, 'user', 'Context from knowledge base:' || chr(10) || '{retrieval.RULE}' || chr(10) || 'No relevant documents found.'
  || chr(10) || '{retrieval.RULE}' || chr(10) || chr(10) || 'Question: ' || question from ({_LAST})""")
def _(spark, sf):
    turns = table(spark, sf, "conversations")
    asked = turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("question")).withColumn(
        "context", F.lit("No relevant documents found."))
    return retrieval.prompt_rows(turns, asked)


@query("u01_union_collections", f"select collection, filename, text from ({fx.KB_SQL}) where collection <> 'images'")
def _(spark, sf):
    records = kb(spark, sf)
    parts = {c: records.where(F.col("collection") == c).drop("collection") for c in fx.COLLECTIONS if c != "images"}
    return retrieval.union_collections(parts | {"images": None}).select("collection", "filename", "text")


@query("s24_catalog_listing", f"select collection, filename, source_uri from ({fx.KB_SQL})")
def _(spark, sf):
    return retrieval.catalog_listing(kb(spark, sf))


@query("s23_vector_sink", f"select collection, count(*) as records, sum(len(vector))::bigint as numbers from ({fx.KB_SQL}) group by 1")
def _(spark, sf):
    path = sinks.scratch_path(spark, "kb")
    sinks.append_collection(kb(spark, sf), path)
    return spark.read.parquet(path).groupBy("collection").agg(
        F.count("*").alias("records"), F.sum(F.size("vector")).alias("numbers"))


@query("s25_document_deleted", f"""select collection, filename, (select count(distinct collection) from ({fx.KB_SQL})
  where filename = 'doc_7.txt') as collections_affected from ({fx.KB_SQL}) where filename <> 'doc_7.txt'""")
def _(spark, sf):
    """Deleted in the stored collections: only files that hold the document are written anew."""
    stored = FileTable(spark, sinks.scratch_path(spark, "kb"))
    stored.append(kb(spark, sf))
    affected = retrieval.delete_document(stored, "doc_7.txt")
    return stored.read().select("collection", "filename", F.lit(affected).cast("bigint").alias("collections_affected"))


FILES = [
    ("filename", "concat('doc_', cast(doc_id as varchar(20)), case doc_id % 6 when 0 then '.txt' when 1 then '.pdf' "
                 "when 2 then '.PNG' when 3 then '.md' when 4 then '.exe' else '.jpeg' end)"),
    ("source_uri", "concat('s3://bucket/raw_data/', cast(doc_id as varchar(20)))"),
    ("text", "case when doc_id % 12 = 1 then ' ' else text end"),
]


def _files(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id", *[f"{e} as {c}" for c, e in FILES])


INGESTED_SQL = f"""select doc_id, filename, collection, length(t) as chars from (select *, case
    when collection = 'images' then 'Image file ' || filename || ' stored at ' || source_uri
    when collection = 'pdfs' and trim(text) = '' then 'PDF file ' || filename || ' stored at ' || source_uri
      || '. No readable text extracted; likely a purely image-based or unsupported document.' else text end as t
  from (select *, case when regexp_matches(lower(filename), '\\.pdf$') then 'pdfs'
      when regexp_matches(lower(filename), '\\.(png|jpg|jpeg)$') then 'images'
      when regexp_matches(lower(filename), '\\.(txt|md|csv)$') then 'documents' end as collection
    from (select doc_id, {', '.join(f'{e} as {c}' for c, e in FILES)} from documents)))
where collection is not null and trim(t) <> ''"""


@query("r01_ingest_documents", INGESTED_SQL)
def _(spark, sf):
    path = sinks.scratch_path(spark, "ingest")
    sinks.append_collection(retrieval.ingest_records(_files(spark, sf), retrieval.hash_embedder()), path)
    return spark.read.parquet(path).select("doc_id", "filename", "collection", F.length("text").alias("chars"))


@query("f46_image_captions", """select doc_id, 'Image file ' || filename || ' stored at ' || source_uri as caption
from (select doc_id, """ + ", ".join(f"{e} as {c}" for c, e in FILES) + " from documents)")
def _(spark, sf):
    return _files(spark, sf).select("doc_id", retrieval.image_caption(F.col("filename"), F.col("source_uri")).alias("caption"))


# Announcements arrive twice under one key; every ninth has no text.
INCOMING = [
    ("filename", "concat('ASX_T', cast(o_custkey % 40 as varchar(20)), '_', cast(cast(o_orderdate as date) as varchar(10)), '.pdf')"),
    ("seq", "o_orderkey"),
    ("text", "case when o_orderkey % 9 = 0 then null else o_orderpriority end"),
]
_INCOMING_SQL = "(select " + ", ".join(f"{e} as {c}" for c, e in INCOMING) + " from orders)"
_STORED_SQL = "(select concat('ASX_T', cast(c_custkey % 40 as varchar(20)), '_1995-0', cast(1 + c_custkey % 9 as varchar(20)), '-1', cast(c_custkey % 10 as varchar(20)), '.pdf') as filename from customer)"
OUTCOME_SQL = f"""select i.filename, i.seq, case when i.text is null then 'error' when i.filename in (select filename from {_STORED_SQL}) then 'skipped'
  when i.seq = (min(case when i.text is not null then i.seq end) over (partition by i.filename)) then 'ingested' else 'skipped' end as status
from {_INCOMING_SQL} i"""


def _outcomes(spark, sf):
    incoming = table(spark, sf, "orders").selectExpr(*[f"{e} as {c}" for c, e in INCOMING])
    stored = table(spark, sf, "customer").selectExpr(_STORED_SQL[len("(select "):-len(" from customer)")])
    return filings.ingest_outcome(incoming, stored, "filename", ["seq"]).select("filename", "seq", "status")


@query("j07_already_ingested", OUTCOME_SQL)
def _(spark, sf):
    return _outcomes(spark, sf)


@query("r02_ingest_counts", f"""select split_part(filename, '_', 2) as ticker, count(*) filter (where status = 'ingested') as ingested,
  count(*) filter (where status = 'skipped') as skipped, count(*) filter (where status = 'error') as errors
from ({OUTCOME_SQL}) group by 1""")
def _(spark, sf):
    rows = _outcomes(spark, sf).withColumn("ticker", F.split_part("filename", F.lit("_"), F.lit(2)))
    return filings.outcome_counts(rows, "ticker")


@query("r05_metadata_search")
def _(spark, sf):
    """Three nearest model texts for each nation's name as a question."""
    models = table(spark, sf, "supplier").selectExpr("s_suppkey as doc_id", *[f"{e} as {c}" for c, e in _NODE])
    columns = table(spark, sf, "part").selectExpr(*[f"{e} as {c}" for c, e in _COLUMN])
    texts = retrieval.model_texts(models, columns).join(models.select("doc_id", "model_name"), "model_name")
    embed = retrieval.hash_embedder()
    index = retrieval.MetadataIndex(spark, sinks.scratch_path(spark, "metadata"))
    for _ in range(2):  # the second time nothing has changed, and nothing is built
        index.refresh(texts.select("doc_id", "text"), embed)
    asked = table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("query_id"),
        retrieval.embedded(F.concat(F.lit("description: orders by nation "), F.col("n_name")), embed).alias("query_vector"))
    return index.search(asked).withColumn("distance", F.round("distance", 6))


@query("x03_embedder")
def _(spark, sf):
    vectors = table(spark, sf, "documents").select("doc_id", retrieval.embedded(F.col("text"), retrieval.hash_embedder()).alias("v"))
    return vectors.select("doc_id", F.size("v").alias("dims"),
                          F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"))
