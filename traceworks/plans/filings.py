"""Exchange announcements and company filings as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Titles of current-report items.
ITEM_TITLES = {
    "1.01": "Entry into Material Agreement",
    "1.02": "Termination of Material Agreement",
    "1.03": "Bankruptcy or Receivership",
    "1.04": "Mine Safety Reporting",
    "2.01": "Completion of Acquisition or Disposition",
    "2.02": "Results of Operations / Financial Condition",
    "2.03": "Creation of Direct Financial Obligation",
    "2.04": "Events Triggering Debt Acceleration",
    "2.05": "Costs Associated with Exit / Disposal Activities",
    "2.06": "Material Impairments",
    "3.01": "Notice of Delisting",
    "3.02": "Unregistered Sales of Equity Securities",
    "3.03": "Material Modifications to Rights of Security Holders",
    "4.01": "Change in Certifying Accountant",
    "4.02": "Non-Reliance on Previously Issued Financial Statements",
    "5.01": "Change in Control of Registrant",
    "5.02": "Departure / Election of Directors or Officers",
    "5.03": "Amendments to Articles of Incorporation or Bylaws",
    "5.04": "Temporary Suspension of Trading Under Employee Benefit Plans",
    "5.05": "Amendments to Code of Ethics",
    "5.06": "Change in Shell Company Status",
    "5.07": "Submission of Matters to Vote of Security Holders",
    "5.08": "Shareholder Director Nominations",
    "7.01": "Regulation FD Disclosure",
    "8.01": "Other Events",
    "9.01": "Financial Statements and Exhibits",
}
# Items that can move a price, forms kept by default, form headlines.
SENSITIVE_ITEMS = ["1.01", "1.02", "2.01", "2.02", "2.03", "2.04", "2.05", "2.06", "4.01", "4.02", "5.01"]
EXHIBITS_ITEM = "9.01"
DEFAULT_FORMS = ["8-K", "10-Q", "10-K"]
FORM_HEADLINES = {
    "10-Q": "Quarterly Report (10-Q)",
    "10-K": "Annual Report (10-K)",
    "DEF 14A": "Proxy Statement — Annual Meeting (DEF 14A)",
    "S-1": "IPO Registration Statement (S-1)",
}
ARCHIVE_URL = "https://www.sec.gov/Archives/edgar/data/%s/%s/%s"


def _table(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def item_codes(raw: Column) -> Column:
    return F.filter(F.transform(F.split(raw, ","), lambda i: F.trim(i)), lambda i: i != "")


def without_exhibits(items: Column) -> Column:
    return F.filter(items, lambda i: i != EXHIBITS_ITEM)


def item_labels(items: Column) -> Column:
    titles = _table(ITEM_TITLES)
    return F.transform(without_exhibits(items), lambda i: F.coalesce(F.try_element_at(titles, i), i))


def current_report_headline(items: Column) -> Column:
    titles = _table(ITEM_TITLES)
    told = F.transform(
        F.slice(without_exhibits(items), 1, 3),
        lambda i: F.coalesce(F.try_element_at(titles, i), F.concat(F.lit("Item "), i)))
    return F.when(F.size(told) == 0, "Current Report (8-K)").otherwise(F.array_join(told, " / "))


def headline(form: Column, items: Column) -> Column:
    return F.when(form == "8-K", current_report_headline(items)).otherwise(
        F.coalesce(F.try_element_at(_table(FORM_HEADLINES), form), form))


def market_sensitive(form: Column, items: Column) -> Column:
    sensitive = F.array(*map(F.lit, SENSITIVE_ITEMS))
    return form.isin("10-K", "10-Q") | ((form == "8-K") & F.arrays_overlap(items, sensitive))


def filing_url(cik: Column, accession: Column, doc: Column) -> Column:
    return F.format_string(ARCHIVE_URL, cik.cast("string"), F.replace(accession, F.lit("-"), F.lit("")), doc)


def filing_rows(submissions: DataFrame) -> DataFrame:
    """Parallel arrays of a submissions record as one row per filing."""
    zipped = F.arrays_zip("accession", "form", "filed_date", "report_date", "primary_doc", "items")
    return submissions.select("ticker", "cik", F.inline(zipped))


def filing_list(submissions: DataFrame, forms: list[str] = DEFAULT_FORMS, count: int | None = 20) -> DataFrame:
    """Filings of the wanted forms with headline, labels, sensitivity and URL;
    the newest ``count`` per ticker. The cut runs in every task before the
    shuffle, so a ticker with very many filings is never gathered whole."""
    rows = filing_rows(submissions).where(F.col("form").isin(forms)).withColumn("codes", item_codes(F.col("items")))
    if count:
        newest = Window.partitionBy("ticker").orderBy(F.desc("filed_date"), F.desc("accession"))
        rows = rows.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= count).drop("_rn")
    form, codes = F.col("form"), F.col("codes")
    return rows.select(
        "ticker", "cik", "accession", form.alias("form_type"), "filed_date",
        F.coalesce(F.nullif("report_date", F.lit("")), F.col("filed_date")).alias("report_date"),
        headline(form, codes).alias("headline"),
        F.array_join(codes, ",").alias("items"), F.array_join(item_labels(codes), "; ").alias("item_labels"),
        market_sensitive(form, codes).alias("market_sensitive"), "primary_doc",
        filing_url(F.col("cik"), F.col("accession"), F.col("primary_doc")).alias("url"))


TICKER_MAP_SCHEMA = "map<string, struct<cik_str: bigint, ticker: string, title: string>>"


def ticker_ids(raw: DataFrame, column: str) -> DataFrame:
    """(ticker, cik) of ticker-file JSON text; the last entry of a ticker wins."""
    entries = raw.select(F.explode(F.from_json(column, TICKER_MAP_SCHEMA)).alias("pos", "e"))
    named = entries.select(F.upper("e.ticker").alias("ticker"), F.col("e.cik_str").alias("cik"),
                           F.col("pos").cast("bigint").alias("pos"))
    kept = named.where((F.col("ticker") != "") & (F.col("cik") != 0))
    return kept.groupBy("ticker").agg(F.max_by("cik", "pos").alias("cik"))


# Announcements ----------------------------------------------------------------
# Link prefix, wanted links, trailing size text, date text.
LINK_HOST = "https://www.asx.com.au"
PDF_LINK = r"(?i)^https?://announcements\.asx\.com\.au/asxpdf/.*\.pdf"
SIZE_TAIL = r"(?i)^(.*?)(?:\s+)(\d+)\s+pages?\s+([\d.]+)\s*(KB|MB)\s*$"
DATE_TEXT = r"\b\d{2}/\d{2}/\d{4}\b(?:\s+\d{2}:\d{2}:\d{2})?"


def full_link(href: Column) -> Column:
    link = F.trim(href)
    return (F.when(link.startswith("//"), F.concat(F.lit("https:"), link))
            .when(link.startswith("/"), F.concat(F.lit(LINK_HOST), link)).otherwise(link))


def announcement_list(anchors: DataFrame) -> DataFrame:
    """Announcement rows of an (href, text, container, ticker) table."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = anchors.withColumns({"url": full_link(F.col("href")), "line": text}).where(F.col("url").rlike(PDF_LINK))
    line = F.col("line")
    sized = line.rlike(SIZE_TAIL)

    def part(i: int) -> Column:
        return F.regexp_extract(line, SIZE_TAIL, i)

    size = part(3).try_cast("double") * F.when(F.upper(part(4)) == "MB", 1024.0).otherwise(1.0)
    title = F.when(sized, F.regexp_replace(part(1), r"^[ \-–—]+|[ \-–—]+$", "")).otherwise(line)
    return rows.select(
        "ticker", "url",
        F.regexp_extract("container", DATE_TEXT, 0).alias("document_date"),
        F.when(title == "", "—").otherwise(title).alias("headline"),
        F.when(sized, part(2).cast("int")).otherwise(0).alias("number_of_pages"),
        F.round(F.when(sized, size).otherwise(0.0), 1).alias("size_kb"))


def announcement_key(ticker: Column, date: Column, ident: Column) -> Column:
    return F.format_string("ASX_%s_%s_%s.pdf", ticker, F.left(date, F.lit(10)), ident)


def announcement_text(ticker: Column, date: Column, doc_type: Column, title: Column, body: Column) -> Column:
    head = F.format_string("ASX Announcement — %s | %s | %s\nHeadline: %s\n\n", ticker, F.left(date, F.lit(10)),
                           doc_type, title)
    return F.concat(head, F.coalesce(F.nullif(body, F.lit("")),
                                     F.lit("(No readable text — may be an image-only PDF)")))


def ingest_outcome(incoming: DataFrame, stored: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Status per incoming row: error without text, skipped when its key is
    stored or came earlier, else ingested.

    Keys already stored meet by equality join on distinct keys; the first of
    several copies is found by a map-side combined minimum.
    """
    usable = incoming.where(F.col("text").isNotNull())
    known = stored.select(key).distinct().withColumn("_stored", F.lit(True))
    first = usable.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    rows = incoming.join(known, key, "left").join(first, key, "left")
    status = (F.when(F.col("text").isNull(), "error").when(F.col("_stored"), "skipped")
              .when(F.struct(*order) == F.col("_first"), "ingested").otherwise("skipped"))
    return rows.withColumn("status", status).drop("_stored", "_first")


def outcome_counts(outcomes: DataFrame, *keys: str) -> DataFrame:
    return outcomes.groupBy(*keys).agg(*[
        F.count_if(F.col("status") == s).alias(name)
        for s, name in (("ingested", "ingested"), ("skipped", "skipped"), ("error", "errors"))])
