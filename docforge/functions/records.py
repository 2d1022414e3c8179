"""Records of labelled contracts and the documents an index takes, all inside each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.functions import extract
from docforge.functions.names import contract_id, entity_parties
from docforge.functions.text import deal

#: The labels that are metadata, the commercial types, and the parts of a playbook.
METADATA = ("Document Name", "Parties", "Agreement Date", "Effective Date", "Expiration Date", "Renewal Term", "Notice Period To Terminate Renewal", "Governing Law")
COMMERCIAL = ("license", "services", "outsourcing", "supply", "manufacturing", "distributor", "reseller", "maintenance", "hosting")
POSITIONS, CATEGORIES = ("Preferred position", "Acceptable fallback", "Escalate if"), 10
_SOURCE = r"Source:\s*([^\n,][^\n]*?),\s*([0-9A-Z][0-9A-Z/\-. ]*?),\s*(\d{1,2})/(\d{1,2})/(\d{4})"


def source_footer(text: Column) -> Column:
    """struct(filer, form, filing_date) of the footers of a text, if all of them say the same."""
    part = lambda x, k: F.trim(F.regexp_extract(x, _SOURCE, k))
    iso = lambda x: extract.iso_date(part(x, 5), part(x, 3), part(x, 4))
    hits = F.regexp_extract_all(text, F.lit(_SOURCE), F.lit(0))
    said = F.array_distinct(F.transform(hits, lambda x: F.struct(part(x, 1).alias("filer"), part(x, 2).alias("form"), iso(x).alias("filing_date"))))
    return F.when(F.size(said) == 1, F.get(said, F.lit(0)))


def _field(raw: Column, read, none: str, many: str) -> Column:
    """struct(value, raw, status, reason): parsed where the labels hold exactly one value."""
    found = F.array_distinct(F.flatten(F.transform(raw, read)))
    n, given = F.size(found), F.size(raw) > 0
    reason = F.when(given & (n == 0), none).when(n > 1, F.concat(F.lit(f"{many} "), F.array_join(found, ", ")))
    return F.struct(F.when(n == 1, F.get(found, F.lit(0))).alias("value"), raw.alias("raw"), F.when(~given, "absent").when(n == 1, "parsed").otherwise("unparsed").alias("status"), reason.alias("reason"))


def _place(x: Column) -> Column:
    return F.filter(F.array(extract.jurisdiction_in(x)), lambda p: p.isNotNull())


def build_records(release: DataFrame) -> DataFrame:
    """One record a contract of ``release`` (title, context, qas).

    Labels whose text does not stand at its offset are ``unmapped``; the footer
    tells filer, form and day before the title does.
    """
    label = lambda q, a: F.struct(a["answer_start"].alias("start"), F.element_at(F.split(q["id"], "__", 2), -1).alias("category"), (a["answer_start"] + F.char_length(a["text"])).alias("end"), a["text"].alias("text"))
    out = release.select("title", F.col("context").alias("text"), F.flatten(F.transform("qas", lambda q: F.transform(q["answers"], lambda a: label(q, a)))).alias("given"))
    stands = lambda x: F.col("text").substr(x["start"] + 1, x["end"] - x["start"]) == x["text"]
    out = out.withColumn("mapped", F.filter("given", stands)).withColumn("unmapped", F.filter("given", lambda x: ~stands(x)))
    of = lambda c: F.transform(F.filter("mapped", lambda x: x["category"] == c), lambda x: x["text"])
    date = lambda c: _field(of(c), extract.dates_in, "no full calendar date in the label", "conflicting dates")
    span = lambda c: _field(of(c), extract.durations_in, "no duration in the label", "several durations")
    out = out.withColumn("t", extract.parse_title(F.col("title"))).withColumn("s", source_footer(F.col("text"))).withColumn("document_name", F.get(of("Document Name"), F.lit(0)))
    types = extract.contract_types(F.concat_ws(" ", "t.title_type", "document_name"))
    footer = F.col("s").isNotNull()
    return out.select(
        contract_id(F.col("title")).alias("contract_id"), "title", "text", F.char_length("text").cast("long").alias("chars"),
        F.when(footer, F.col("s.filer")).otherwise(F.col("t.filer")).alias("filer"), F.col("t.filer").alias("title_filer"),
        F.coalesce("s.filing_date", "t.filing_date").alias("filing_date"), F.when(footer, F.col("s.form")).otherwise(F.col("t.form")).alias("form"),
        F.col("t.exhibit").alias("exhibit"), F.when(footer, "source_footer").when(F.col("t.filer").isNotNull(), "title").alias("filer_from"), F.col("t.format").alias("title_format"),
        "document_name", F.get(types, F.lit(0)).alias("contract_type"), types.alias("contract_types"),
        F.struct(entity_parties(of("Parties")).alias("value"), of("Parties").alias("raw"), F.when(F.size(of("Parties")) > 0, "parsed").otherwise("absent").alias("status")).alias("parties"),
        date("Agreement Date").alias("agreement_date"), date("Effective Date").alias("effective_date"), date("Expiration Date").alias("expiration_date"),
        span("Renewal Term").alias("renewal_term"), span("Notice Period To Terminate Renewal").alias("notice_period"),
        _field(of("Governing Law"), _place, "no recognized jurisdiction", "several jurisdictions").alias("governing_law"),
        F.array_sort(F.transform("mapped", lambda x: F.struct(x["start"].alias("start"), x["category"].alias("category"), x["end"].alias("end")))).alias("spans"),
        "unmapped",
    )


def check_unique(records: DataFrame) -> DataFrame:
    """The records; the job fails where two titles gave one id."""
    twice = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("contract ids collide: "), F.col("contract_id")))).otherwise(F.lit(True))
    return records.join(records.groupBy("contract_id").agg(twice.alias("ok")).where("ok"), "contract_id", "left_semi")


def candidates(records: DataFrame, least: int = 3) -> DataFrame:
    """Commercial contracts with labels of at most few clauses left out: ``least`` categories that are no metadata."""
    clauses = F.array_distinct(F.transform(F.filter("spans", lambda x: ~x["category"].isin(*METADATA)), lambda x: x["category"]))
    return records.where(F.col("contract_type").isin(*COMMERCIAL) & (F.size(clauses) >= least))


def _year(c: Column) -> Column:
    return F.substring(c, 1, 4).try_cast("int")


def contract_docs(records: DataFrame, accounts: DataFrame) -> DataFrame:
    """Index documents of records, with the account where one was resolved; what did not parse is null."""
    own = accounts.where("cik is not null").select("contract_id", F.col("matched_name").alias("account"), "cik")
    value = lambda c: F.when(F.col(f"{c}.status") == "parsed", F.col(f"{c}.value"))
    fields = ("agreement_date", "effective_date", "expiration_date", "renewal_term", "notice_period", "governing_law")
    meta = [F.substring("title", 1, 200).alias("title"), "contract_type", "filer", "filing_date", "form", *(F.nullif(value(f), F.lit("")).alias(f) for f in fields)]
    years = [_year(value("agreement_date")).alias("agreement_year"), _year(value("expiration_date")).alias("expiration_year")]
    parties = F.nullif(F.substring(F.array_join("parties.value", "; "), 1, 500), F.lit("")).alias("parties")
    return records.join(own, "contract_id", "left").select(F.col("contract_id").alias("doc_id"), F.lit("contract").alias("doc_type"), "text", F.struct(*meta, *years, parties, "account", "cik").alias("metadata"))


def risk_docs(entries: DataFrame) -> DataFrame:
    """Index documents of risk sections (cik, accession, filing_date, form, account, text)."""
    doc = F.format_string("rf_%s_%s", F.col("cik").cast("string"), F.replace("accession", F.lit("-"), F.lit("")))
    return entries.select(doc.alias("doc_id"), F.lit("risk_factors").alias("doc_type"), "text", F.struct("cik", "account", "accession", "filing_date", "form", _year(F.col("filing_date")).alias("filing_year")).alias("metadata"))


def heading_name(heading: Column) -> Column:
    """A heading without its number, its emphasis and a closing colon."""
    bare = F.regexp_replace(heading, r"^[\s*_]+|[\s*_]+$", "")
    bare = F.regexp_replace(bare, r"^\d+[.)]\s*", "")
    return F.regexp_replace(bare, r"^[\s*_]+|[\s:*_]+$", "")


def chunk_category(doc_type: Column, text: Column) -> Column:
    """The heading of a playbook's chunk, its number kept."""
    return F.when(doc_type == "playbook", F.nullif(F.trim(F.regexp_extract(text, r"^## (.+)", 1)), F.lit("")))


def _headings(text: Column) -> Column:
    """Each heading of a playbook in order: its place, level, bare name, wording, and whether anything is written below it."""
    blocks = F.filter(F.split(text, r"(?md)(?=^#{2,3} )"), lambda b: b.startswith("## ") | b.startswith("### "))
    # the line of the heading is cut off by its length, not by further patterns
    line = F.transform(blocks, lambda b: F.struct(b.alias("block"), F.substring_index(b, "\n", 1).alias("line"), F.when(b.startswith("###"), 3).otherwise(2).alias("level")))
    cut = F.transform(line, lambda x: F.struct(x["level"].alias("level"), F.substr(x["line"], x["level"] + 2).alias("first"), F.substr(x["block"], F.char_length(x["line"]) + 1).alias("body")))
    written = lambda x: (x["first"] == "") | x["body"].rlike(r"\S")
    return F.transform(cut, lambda x, i: F.struct(i.alias("pos"), x["level"].alias("level"), heading_name(x["first"]).alias("name"), F.trim(x["first"]).alias("heading"), written(x).alias("written")))


def playbook_status(playbooks: DataFrame) -> DataFrame:
    """(doc_id, categories, expected, filled, empty, problems, complete) of each playbook, a document a row.

    A position's heading one level too high belongs to the category before it; an
    optional section ends that category and is none itself.  Texts are
    dealt by their bytes; all else is told from the headings in a text's own row,
    so no heading is shuffled.  What stands under one category's name is brought
    together by a sort: the work grows with a text's headings, not their square.
    """
    none = F.array().cast("array<string>")
    places = F.array(*map(F.lit, POSITIONS))
    ranked = F.transform("heads", lambda h: F.struct(F.array_position(places, h["name"]).alias("rank"), h.alias("h")))
    rows = deal(playbooks.select("doc_id", "text"), "doc_id").select("doc_id", F.coalesce(_headings(F.col("text")), F.array()).alias("heads")).withColumn("heads", ranked)
    opener = F.transform("heads", lambda x, i: F.when((x["h"]["level"] == 2) & (x["rank"] == 0), i))
    rows = rows.withColumn("at", F.filter(opener, lambda i: i.isNotNull()))
    head = lambda i: F.get("heads", i)["h"]
    category = lambda h: F.when(F.lower(h["heading"]).contains("filing-data"), "").otherwise(h["name"])
    under = lambda i, k: F.filter(F.slice("heads", i + 2, F.coalesce(F.get("at", k + 1), F.size("heads")) - i - 1), lambda x: x["rank"] > 0)
    parts = F.transform("at", lambda i, k: F.struct(category(head(i)).alias("category"), head(i)["pos"].alias("opens"), under(i, k).alias("own")))
    rows = rows.withColumn("parts", F.filter(parts, lambda p: p["category"] != ""))
    # of each category and position: first a row that says nothing, with the category's first heading, and last the last such heading
    said = lambda p, rank, pos, written: F.struct(p["category"].alias("category"), rank.cast("int").alias("rank"), pos.cast("int").alias("pos"), p["opens"].alias("opens"), written.alias("written"))
    blank = lambda p: F.transform(F.sequence(F.lit(1), F.lit(len(POSITIONS))), lambda r: said(p, r, F.lit(-1), F.lit(False)))
    given = lambda p: F.transform(p["own"], lambda x: said(p, x["rank"], x["h"]["pos"], x["h"]["written"]))
    rows = rows.withColumn("run", F.sort_array(F.flatten(F.transform("parts", lambda p: F.concat(blank(p), given(p))))))
    other = lambda x, i: F.coalesce((F.get("run", i)["category"] != x["category"]) | (F.get("run", i)["rank"] != x["rank"]), F.lit(True))
    first, last = F.filter("run", lambda x, i: (i == 0) | other(x, i - 1)), F.filter("run", lambda x, i: other(x, i + 1))
    rows = rows.withColumn("state", F.zip_with(first, last, lambda a, b: F.struct(a["opens"].alias("opens"), a["rank"].alias("rank"), F.concat_ws(" / ", a["category"], F.element_at(places, a["rank"])).alias("t"), b["written"].alias("written"))))
    gaps = F.transform(F.sort_array(F.filter("state", lambda x: ~x["written"])), lambda x: x["t"])
    high = lambda p: F.transform(F.filter(p["own"], lambda x: x["h"]["level"] == 2), lambda x: F.format_string("'## %s' under %s should be '### %s'", x["h"]["heading"], p["category"], x["h"]["name"]))
    expected = CATEGORIES * len(POSITIONS)
    written = F.size(F.filter("state", lambda x: x["written"])).cast("long")
    rows = rows.select("doc_id", (F.size("state") / len(POSITIONS)).cast("long").alias("categories"), written.alias("filled"), gaps.alias("empty"), F.flatten(F.transform("parts", high)).alias("misplaced"))
    number = F.when(F.col("categories") == CATEGORIES, none).otherwise(F.array(F.format_string("%d category headings, expected %d", F.col("categories"), F.lit(CATEGORIES))))
    out = rows.withColumn("problems", F.concat(number, "misplaced"))
    return out.select("doc_id", "categories", F.lit(expected).alias("expected"), "filled", "empty", "problems", ((F.size("problems") == 0) & (F.col("filled") == expected)).alias("complete"))


def playbook_docs(playbooks: DataFrame) -> DataFrame:
    """Index documents of the playbooks whose every position is written."""
    whole = playbook_status(playbooks).where("complete").select("doc_id")
    return playbooks.join(whole, "doc_id", "left_semi").select("doc_id", F.lit("playbook").alias("doc_type"), "text")
