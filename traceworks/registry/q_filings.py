"""Filings, announcements and chat-message parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceworks.functions import markup, routing
from traceworks.functions.redact import cut
from traceworks.plans import filings
from traceworks.registry.base import query, table
from traceworks.registry.q_quality import lit

# A submissions record of three filings per order, as parallel arrays.
_KEY = "cast(o_orderkey as varchar(20))"
_DATE = "cast(cast(o_orderdate as date) as varchar(10))"
SUBMISSION = {
    "accession": [f"concat('0000-24-', {_KEY}, '-{i}')" for i in range(3)],
    "form": ["case o_orderkey % 4 when 0 then '8-K' when 1 then '10-Q' when 2 then 'DEF 14A' else '4' end", "'8-K'",
             "case o_orderkey % 3 when 0 then '10-K' when 1 then 'S-1' else '8-K' end"],
    "filed_date": [_DATE] * 3,
    "report_date": [f"case when o_orderkey % 5 = 0 then '' else {_DATE} end", "''", _DATE],
    "primary_doc": [f"concat('d', {_KEY}, '.htm')"] * 3,
    "items": ["case o_orderkey % 6 when 0 then '2.02,9.01' when 1 then ' 9.01 ' when 2 then '' when 3 then '7.01, 8.01,5.02,1.01' else '3.99' end",
              "'5.03,9.01'", "case when o_orderkey % 2 = 0 then '4.02' else '8.01,9.01' end"],
}
_TICKER = "concat('TK', cast(o_custkey % 300 as varchar(20)))"


def submissions(spark, sf):
    arrays = [f"array({', '.join(v)}) as {k}" for k, v in SUBMISSION.items()]
    return table(spark, sf, "orders").selectExpr(f"{_TICKER} as ticker", "o_custkey + 1000 as cik", *arrays)


ROWS_SQL = "(" + " union all ".join(
    f"select {_TICKER} as ticker, o_custkey + 1000 as cik, " + ", ".join(f"{v[i]} as {k}" for k, v in SUBMISSION.items())
    + " from orders" for i in range(3)) + ")"
_CODES = "list_filter(list_transform(string_split(items, ','), lambda i: trim(i)), lambda i: i <> '')"


def _title(code: str, default: str) -> str:
    return f"(case {code} " + " ".join(f"when '{k}' then {lit(v)}" for k, v in filings.ITEM_TITLES.items()) + f" else {default} end)"


_FORMS = "case form " + " ".join(f"when '{k}' then {lit(v)}" for k, v in filings.FORM_HEADLINES.items()) + " else form end"
_HEADLINE = f"""case when form = '8-K' then case when len(m) = 0 then 'Current Report (8-K)' else
  array_to_string(list_transform(m[1:3], lambda i: {_title('i', "'Item ' || i")}), ' / ') end else {_FORMS} end"""
_SENSITIVE = f"form in ('10-K', '10-Q') or (form = '8-K' and len(list_intersect(codes, {filings.SENSITIVE_ITEMS!r})) > 0)"
_URL = "'https://www.sec.gov/Archives/edgar/data/' || cik || '/' || replace(accession, '-', '') || '/' || primary_doc"
PARSED_SQL = f"""(select *, list_filter(codes, lambda i: i <> '9.01') as m from (select *, {_CODES} as codes from {ROWS_SQL}))"""
FILING_SQL = f"""select ticker, cik, accession, form as form_type, filed_date, coalesce(nullif(report_date, ''), filed_date) as report_date,
  {_HEADLINE} as headline, array_to_string(codes, ',') as items,
  array_to_string(list_transform(m, lambda i: {_title('i', 'i')}), '; ') as item_labels, {_SENSITIVE} as market_sensitive,
  primary_doc, {_URL} as url from {PARSED_SQL} where form in ('8-K', '10-Q', '10-K')"""


@query("n01_filing_list", FILING_SQL)
def _(spark, sf):
    return filings.filing_list(submissions(spark, sf), count=None)


@query("p13_newest_filings", f"""select * exclude (rn) from (select *, row_number() over (partition by ticker
  order by filed_date desc, accession desc) as rn from ({FILING_SQL})) where rn <= 20""")
def _(spark, sf):
    return filings.filing_list(submissions(spark, sf))


def _coded(spark, sf):
    return filings.filing_rows(submissions(spark, sf)).withColumn("codes", filings.item_codes(F.col("items")))


@query("f33_filing_url", f"select accession, {_URL} as url from {ROWS_SQL}")
def _(spark, sf):
    return _coded(spark, sf).select("accession", filings.filing_url(F.col("cik"), F.col("accession"), F.col("primary_doc")).alias("url"))


@query("f34_item_codes", f"select accession, array_to_string(codes, ',') as codes, array_to_string(m, ',') as told from {PARSED_SQL}")
def _(spark, sf):
    return _coded(spark, sf).select("accession", F.array_join("codes", ",").alias("codes"),
                                    F.array_join(filings.without_exhibits(F.col("codes")), ",").alias("told"))


@query("f35_headlines", f"select accession, {_HEADLINE} as headline from {PARSED_SQL}")
def _(spark, sf):
    return _coded(spark, sf).select("accession", filings.headline(F.col("form"), F.col("codes")).alias("headline"))


@query("f36_market_sensitive", f"select accession, {_SENSITIVE} as market_sensitive from {PARSED_SQL}")
def _(spark, sf):
    return _coded(spark, sf).select("accession", filings.market_sensitive(F.col("form"), F.col("codes")).alias("market_sensitive"))


@query("j11_item_labels", f"select accession, array_to_string(list_transform(m, lambda i: {_title('i', 'i')}), '; ') as labels from {PARSED_SQL}")
def _(spark, sf):
    return _coded(spark, sf).select("accession", F.array_join(filings.item_labels(F.col("codes")), "; ").alias("labels"))


@query("n04_ticker_ids", """select 'TK' || c_custkey as ticker, c_custkey + 500 as cik from customer where c_custkey % 7 <> 3
union all select 'DUP' || (c_custkey % 50), max(c_custkey + 9000) from customer group by 1""")
def _(spark, sf):
    """The second entry of each record repeats a ticker; the last one counts."""
    raw = table(spark, sf, "customer").selectExpr(
        "concat('{\"', 2 * c_custkey, '\": {\"cik_str\": ', c_custkey + 500, ', \"ticker\": \"', "
        "if(c_custkey % 7 = 3, '', concat('tk', c_custkey)), '\", \"title\": \"', c_name, '\"}, \"', 2 * c_custkey + 1, "
        "'\": {\"cik_str\": ', c_custkey + 9000, ', \"ticker\": \"Dup', c_custkey % 50, '\"}}') as body")
    return filings.ticker_ids(raw, "body")


# Announcements ------------------------------------------------------------------
ANCHORS = [
    ("ticker", "concat('T', cast(o_custkey % 40 as varchar(20)))"),
    ("href", "concat(case o_orderkey % 4 when 0 then '//announcements.asx.com.au/asxpdf/' when 1 then "
             "'https://announcements.asx.com.au/asxpdf/' when 2 then '/asxpdf/' else ' HTTP://announcements.asx.com.au/asxpdf/' end, "
             "cast(o_orderkey as varchar(20)), case when o_orderkey % 11 = 0 then '.html' else '.pdf' end)"),
    ("text", "case o_orderkey % 5 when 0 then concat('Quarterly  Update - ', cast(o_custkey % 90 + 1 as varchar(20)), ' pages 1.5MB') "
             "when 1 then concat('Change of Director ', cast(o_custkey % 9 + 1 as varchar(20)), ' page 345.6 KB') when 2 then 'No size here' "
             "when 3 then ' 7 pages 12KB' else concat('Half Year – Accounts  2 pages ', cast(o_custkey % 900 as varchar(20)), 'kb ') end"),
    ("container", "case when o_orderkey % 3 = 0 then concat('on ', substring(cast(o_orderdate as varchar(40)), 9, 2), '/', "
                  "substring(cast(o_orderdate as varchar(40)), 6, 2), '/', substring(cast(o_orderdate as varchar(40)), 1, 4), ' 09:31:12 am') "
                  "when o_orderkey % 3 = 1 then concat('x ', substring(cast(o_orderdate as varchar(40)), 9, 2), '/', "
                  "substring(cast(o_orderdate as varchar(40)), 6, 2), '/', substring(cast(o_orderdate as varchar(40)), 1, 4)) else 'none' end"),
]


def anchors(spark, sf):
    return table(spark, sf, "orders").selectExpr(*[f"{e} as {c}" for c, e in ANCHORS])


_ANCHORS_SQL = "(select " + ", ".join(f"{e} as {c}" for c, e in ANCHORS) + " from orders)"
_LINK = """case when starts_with(trim(href), '//') then 'https:' || trim(href) when starts_with(trim(href), '/')
  then 'https://www.asx.com.au' || trim(href) else trim(href) end"""
_TAIL = lit(filings.SIZE_TAIL)
ANNOUNCED_SQL = f"""select ticker, url, regexp_extract(container, {lit(filings.DATE_TEXT)}, 0) as document_date,
  case when h = '' then '—' else h end as headline, case when sized then regexp_extract(line, {_TAIL}, 2)::int else 0 end as number_of_pages,
  round(case when sized then regexp_extract(line, {_TAIL}, 3)::double * case when upper(regexp_extract(line, {_TAIL}, 4)) = 'MB'
    then 1024.0 else 1.0 end else 0 end, 1) as size_kb
from (select *, case when sized then regexp_replace(regexp_extract(line, {_TAIL}, 1), '^[ \\-–—]+|[ \\-–—]+$', '', 'g') else line end as h
from (select *, regexp_matches(line, {_TAIL}) as sized from (select *, {_LINK} as url,
  trim(regexp_replace(text, '\\s+', ' ', 'g')) as line from {_ANCHORS_SQL}) where regexp_matches(url, {lit(filings.PDF_LINK)})))"""


@query("n03_announcement_list", ANNOUNCED_SQL)
def _(spark, sf):
    return filings.announcement_list(anchors(spark, sf))


@query("p14_pdf_links", f"select ticker, href, {_LINK} as url from {_ANCHORS_SQL} where regexp_matches({_LINK}, {lit(filings.PDF_LINK)})")
def _(spark, sf):
    rows = anchors(spark, sf).withColumn("url", filings.full_link(F.col("href")))
    return rows.where(F.col("url").rlike(filings.PDF_LINK)).select("ticker", "href", "url")


@query("f28_announcement_sizes", f"select url, headline, number_of_pages, size_kb from ({ANNOUNCED_SQL})")
def _(spark, sf):
    return filings.announcement_list(anchors(spark, sf)).select("url", "headline", "number_of_pages", "size_kb")


@query("f29_date_text", f"select ticker, href, regexp_extract(container, {lit(filings.DATE_TEXT)}, 0) as found from {_ANCHORS_SQL}")
def _(spark, sf):
    return anchors(spark, sf).select("ticker", "href", F.regexp_extract("container", filings.DATE_TEXT, 0).alias("found"))


@query("f30_full_links", f"select href, {_LINK} as url from {_ANCHORS_SQL}")
def _(spark, sf):
    return anchors(spark, sf).select("href", filings.full_link(F.col("href")).alias("url"))


@query("f31_announcement_keys", """select o_orderkey, 'ASX_T' || (o_custkey % 40) || '_' || cast(o_orderdate as varchar)[:10] || '_' || o_orderkey || '.pdf' as filename,
  'ASX Announcement — T' || (o_custkey % 40) || ' | ' || cast(o_orderdate as varchar)[:10] || ' | news' || chr(10) || 'Headline: ' || o_orderpriority
  || chr(10) || chr(10) || case when o_orderkey % 2 = 0 then '(No readable text — may be an image-only PDF)' else 'body' end as full_text from orders""")
def _(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "concat('T', o_custkey % 40) as t", "cast(o_orderdate as string) as d", "o_orderpriority",
        "if(o_orderkey % 2 = 0, '', 'body') as body")
    return rows.select(
        "o_orderkey", filings.announcement_key(F.col("t"), F.col("d"), F.col("o_orderkey").cast("string")).alias("filename"),
        filings.announcement_text(F.col("t"), F.col("d"), F.lit("news"), F.col("o_orderpriority"), F.col("body")).alias("full_text"))


@query("f32_cut_with_notice", f"""select doc_id, case when length(text) > 800 then text[:800] || {lit(markup.CUT_NOTICE)[:-1] + "'"} else text end as text from documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", markup.with_notice(F.col("text"), 800).alias("text"))


# Page text by pattern: hidden elements and comments out, tags to line breaks, entities back.
def _page_sql() -> str:
    text = "html"
    for tag in ("script", "style", "head", "ix:header", "ix:nonfraction", "ix:nonnumeric"):
        text = f"regexp_replace({text}, '(?is)<{tag}[ >].*?</{tag}>', chr(10), 'g')"
    text = f"regexp_replace(regexp_replace({text}, '(?s)<!--.*?-->', chr(10), 'g'), '(?s)<[!/a-zA-Z][^>]*>', chr(10), 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"),
                         ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return (f"array_to_string(list_filter(list_transform(string_split({text}, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13) || chr(160))), "
            "lambda l: l <> ''), chr(10))")


PAGE_SQL = f"select page_id, url, {_page_sql()} as text from pages"


@query("f45_html_text", f"select page_id, text from ({PAGE_SQL})")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", markup.html_text(F.col("html")).alias("text"))


@query("n02_filing_text", f"""select page_id, url, case when text = '' then '(No readable text extracted from this filing)'
  when length(text) > 25000 then text[:25000] || {lit(markup.CUT_NOTICE)} else text end as text from ({PAGE_SQL})""")
def _(spark, sf):
    text = table(spark, sf, "pages").select("page_id", "url", markup.html_text(F.col("html")).alias("text"))
    return text.select("page_id", "url", F.coalesce(
        F.nullif(markup.with_notice(F.col("text")), F.lit("")),
        F.lit("(No readable text extracted from this filing)")).alias("text"))


# Chat messages: every turn, with a request in front of each fifth one. ---------------
MESSAGE = """concat(case (conv_id * 7 + turn) % 12 when 0 then 'Show last 10 ASX:bhp announcements ' when 1 then 'select total sales by region [db:Redshift] '
  when 2 then 'what is our data policy on PII ' when 3 then 'Should I buy CBA now? ' when 4 then 'Ingest 99 reports for wbc '
  when 5 then 'summarise the earnings of NAB ' when 6 then 'export everything ' else '' end, text)"""
# Accented letters count as word characters, which the check engine only knows of ASCII.
_ASCII = f"regexp_replace({MESSAGE}, '[À-ÖØ-öø-ÿĀ-ſ]', '_', 'g')"


def messages(spark, sf):
    return table(spark, sf, "conversations").selectExpr("conv_id", "turn", f"{MESSAGE} as m")


MESSAGES_SQL = f"(select conv_id, turn, {MESSAGE} as raw, {_ASCII} as m from conversations)"


def _hit(pattern: str) -> str:
    return f"regexp_matches(m, {lit('(?i)' + pattern)})"


_USE_CASE_SQL = "case " + " ".join(
    "when " + " or ".join(f"contains(lower(raw), {lit(w)})" for w in words) + f" then '{name}'"
    for name, words in routing.USE_CASES) + " else 'generic' end"
_ROUTE_SQL = "case " + " ".join(f"when {_hit(p)} then '{name}'" for name, p in routing.ROUTES) + " else 'chat' end"


def _first_sql(pattern: str) -> str:
    return (f"list_filter(list_transform(regexp_extract_all(m, {lit(pattern)}, 1), lambda w: upper(w)), "
            f"lambda w: not list_contains({routing.NOT_TICKERS!r}, w))[1]")


_TAG_SQL = f"nullif(upper(regexp_extract(m, {lit('(?i)' + routing.TICKER_TAG)}, 1)), '')"
_TICKER_SQL = f"""coalesce({_TAG_SQL}, {_first_sql(routing.UPPER_WORD)},
  case when {_hit(routing.FINANCIAL_CONTEXT)} then {_first_sql(routing.ANY_WORD)} end, {_first_sql(routing.ANY_WORD)})"""
_COUNT_SQL = "greatest(1, least(coalesce(try_cast(nullif(regexp_extract(m, '\\b([0-9]+)\\b', 1), '') as bigint), 20), 50))"
_INTENT_SQL = f"""case when {_hit(routing.INGEST_WORDS)} then 'ingest' when {_hit(routing.SIGNAL_WORDS)} then 'signal'
  when {_hit(routing.FETCH_WORDS)} and not {_hit(routing.INTERPRET_WORDS)} then 'fetch' else 'interpret' end"""
_DB_SQL = "nullif(regexp_extract(m, '(?i)\\[db:(\\w+)\\]', 1), '')"
M = "m"


@query("f23_use_cases", f"select conv_id, turn, {_USE_CASE_SQL} as use_case from {MESSAGES_SQL}")
def _(spark, sf):
    return messages(spark, sf).select("conv_id", "turn", routing.use_case(F.col(M)).alias("use_case"))


@query("f24_routes", f"select conv_id, turn, {_ROUTE_SQL} as route from {MESSAGES_SQL}")
def _(spark, sf):
    return messages(spark, sf).select("conv_id", "turn", routing.route(F.col(M)).alias("route"))


@query("f25_tickers", f"select conv_id, turn, {_TICKER_SQL} as ticker from {MESSAGES_SQL}")
def _(spark, sf):
    return messages(spark, sf).select("conv_id", "turn", routing.ticker(F.col(M)).alias("ticker"))


@query("f27_message_parts", f"""select conv_id, turn, {_COUNT_SQL} as wanted, {_INTENT_SQL} as intent, {_DB_SQL} as db from {MESSAGES_SQL}""")
def _(spark, sf):
    return messages(spark, sf).select(
        "conv_id", "turn", routing.wanted_count(F.col(M)).alias("wanted"),
        routing.announcement_intent(F.col(M)).alias("intent"), routing.database_tag(F.col(M)).alias("db"))


@query("n05_chat_routing", f"""select route, intent, count(*) as messages, count(ticker) as with_ticker from (
  select {_ROUTE_SQL} as route, {_INTENT_SQL} as intent, {_TAG_SQL} as ticker from {MESSAGES_SQL}) group by 1, 2""")
def _(spark, sf):
    rows = messages(spark, sf).select(
        routing.route(F.col(M)).alias("route"), routing.announcement_intent(F.col(M)).alias("intent"),
        routing.tagged_ticker(F.col(M)).alias("ticker"))
    return rows.groupBy("route", "intent").agg(F.count("*").alias("messages"), F.count("ticker").alias("with_ticker"))


_SUFFIX = "case c_custkey % 8 when 0 then '.AX' when 1 then '' when 2 then '.L' when 3 then '.to' when 4 then '.HK' when 5 then '..xy' when 6 then '.SI' else '.NZ' end"
_CODE_SQL = "case x " + " ".join(f"when '{k}' then '{v}'" for k, v in routing.EXCHANGE_CODES.items()) + " else upper(ltrim(x, '.')) end"
_LABEL_SQL = "case x " + " ".join(f"when '{k}' then '{v}'" for k, v in routing.EXCHANGE_LABELS.items()) + " else 'Exchange suffix: ' || x end"


@query("j13_exchange_codes", f"select c_custkey, {_CODE_SQL} as code, {_LABEL_SQL} as label from (select c_custkey, {_SUFFIX} as x from customer)")
def _(spark, sf):
    x = F.expr(_SUFFIX)
    return table(spark, sf, "customer").select(
        "c_custkey", routing.exchange_code(x).alias("code"), routing.exchange_label(x).alias("label"))


@query("o06_watchlist_tickers", """select c_custkey, array_to_string(list_distinct_ordered, ',') as tickers from (select c_custkey,
  list_reduce(list_transform(l, lambda t: [t]), lambda a, b: case when list_contains(a, b[1]) then a else a || b end) as list_distinct_ordered
  from (select c_custkey, ['BHP', upper(c_mktsegment[:3]), 'CBA', upper(c_mktsegment[:3]), 'BHP'] as l from customer))""")
def _(spark, sf):
    raw = F.expr("concat('bhp, ', left(c_mktsegment, 3), '\\ncba,', left(c_mktsegment, 3), ' ,, BHP')")
    parts = F.transform(F.split(raw, "[,\n]"), lambda t: F.upper(F.trim(t)))
    return table(spark, sf, "customer").select(
        "c_custkey", F.array_join(F.array_distinct(F.filter(parts, lambda t: t != "")), ",").alias("tickers"))


@query("f13_short_cut", "select doc_id, case when length(text) > 80 then text[:80] || '…' else text end as head from documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", cut(F.col("text"), 80).alias("head"))
