"""Registered queries of the selection of contracts and of what is gathered with it; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docforge.functions import records
from docforge.operators import relate, selection
from docforge.plans.catalogue import _t, query

_TYPE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'license' WHEN '2-HIGH' THEN 'services' WHEN '3-MEDIUM' THEN 'supply' ELSE 'other' END"
_CATEGORY = "CASE WHEN l_linenumber % 4 = 0 THEN 'Parties' ELSE l_returnflag || l_linenumber % 3 END"
_CANDIDATES = f"""SELECT o_orderkey AS contract_id, {_TYPE} AS contract_type FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE {_TYPE} <> 'other' AND {_CATEGORY} <> 'Parties' GROUP BY ALL HAVING count(DISTINCT {_CATEGORY}) >= 3"""
_ACCOUNT = "CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END"
_TIERS = f"""c AS ({_CANDIDATES}),
a AS (SELECT o_orderkey AS contract_id, CASE WHEN o_orderkey % 6 = 0 THEN o_custkey % 97 WHEN o_orderkey % 11 = 0 THEN NULL ELSE {_ACCOUNT} END AS cik FROM orders),
r AS (SELECT DISTINCT l_suppkey AS cik FROM lineitem WHERE l_returnflag = 'R'),
t AS (SELECT c.contract_id, contract_type, CASE WHEN coalesce(a.cik, 0) = 0 THEN 2 WHEN r.cik IS NULL THEN 1 ELSE 0 END AS tier FROM c LEFT JOIN a USING (contract_id) LEFT JOIN r ON r.cik = a.cik)"""


def _candidates(s, d):
    line = F.struct(F.expr(_CATEGORY).alias("category"), F.col("l_linenumber").alias("start"))
    spans = _t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("contract_id")).agg(F.collect_list(line).alias("spans"))  # an order has few lines
    rows = _t(s, d, "orders").select(F.col("o_orderkey").alias("contract_id"), F.expr(_TYPE).alias("contract_type"))
    return records.candidates(rows.join(spans, "contract_id")).select("contract_id", "contract_type")


def _tiers(s, d):
    o = _t(s, d, "orders")
    first = o.select(F.col("o_orderkey").alias("contract_id"), F.expr(_ACCOUNT).alias("cik"), F.lit(0).alias("at"))
    later = o.where("o_orderkey % 6 = 0 or o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("contract_id"), F.expr("case when o_orderkey % 6 = 0 then o_custkey % 97 end").alias("cik"), F.lit(1).alias("at"))
    paid = _t(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("cik"))
    return selection.tiers(_candidates(s, d), first.unionByName(later), paid)


@query(_CANDIDATES)
def contract_candidates(s, d):
    """Orders of commercial kinds with three or more categories that are no metadata."""
    return _candidates(s, d)


@query(f"WITH {_TIERS} SELECT * FROM t")
def contract_tiers(s, d):
    """Every candidate with its tier, from the account written last and revenue under it."""
    return _tiers(s, d)


@query(f"""WITH {_TIERS}, k AS (SELECT *, row_number() OVER (PARTITION BY contract_type ORDER BY tier, md5(contract_id::VARCHAR)) AS r FROM t)
SELECT contract_id, contract_type, tier FROM k WHERE r <= 15 ORDER BY tier, md5(contract_id::VARCHAR) LIMIT 80""")
def contract_selection(s, d):
    """At most 80 contracts, 15 of a type, the better tiers first."""
    return relate.capped_selection(_tiers(s, d), "contract_id", "contract_type", "tier", 15, 80)


@query("SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS category FROM lineitem WHERE lower(l_returnflag || l_linestatus) = 'no'")
def spans_of_category(s, d):
    spans = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("category"))
    return selection.in_category(spans, "No")


_BOOK = "'## Clause ' || k || chr(10) || '### Preferred position' || chr(10) || n_name || chr(10) || '### Acceptable fallback' || chr(10) || 'none' || chr(10) || '### Escalate if' || chr(10) || CASE WHEN n_nationkey % 2 = 0 OR k < 10 THEN 'ever' ELSE '' END || chr(10)"


@query(
    f"""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 50 + 1 END AS cik, source || '-' || doc_id AS name FROM documents WHERE doc_id IS NOT NULL),
n AS (SELECT cik, arg_max(name, doc_id) AS name FROM a WHERE cik IS NOT NULL GROUP BY 1),
c AS (SELECT d.doc_id, text, a.cik, name FROM documents d JOIN a USING (doc_id) WHERE lang = 'en' AND n_chars >= 2000)
SELECT 'c' || doc_id AS doc_id, 'contract' AS doc_type, md5(text) AS text_md5, CASE WHEN cik IS NOT NULL THEN name END AS account, cik FROM c
UNION ALL SELECT 'rf_' || p.cik || '_p' || page_id, 'risk_factors', md5(html), n.name, p.cik FROM (SELECT *, page_id % 70 + 1 AS cik FROM pages) p LEFT JOIN n USING (cik) WHERE p.cik IN (SELECT cik FROM c)
UNION ALL SELECT 'book' || n_nationkey, 'playbook', md5(array_to_string(list_transform(range(1, 11), lambda k: {_BOOK}), '')), NULL, NULL FROM nation WHERE n_nationkey % 2 = 0"""
)
def gathered_documents(s, d):
    """Long English documents as contracts, pages as the risk sections of their companies, playbooks of nations."""
    docs = _t(s, d, "documents")
    none = F.struct(F.lit(None).cast("string").alias("value"), F.lit("absent").alias("status"))
    fields = {f: none for f in ("agreement_date", "effective_date", "expiration_date", "renewal_term", "notice_period", "governing_law")}
    key = F.concat(F.lit("c"), F.col("doc_id").cast("string"))
    rows = docs.where("lang = 'en' and n_chars >= 2000 and doc_id is not null").select(
        key.alias("contract_id"), F.col("source").alias("title"), F.lit("license").alias("contract_type"), F.lit("f").alias("filer"), F.lit("2024-01-01").alias("filing_date"),
        F.lit("10-K").alias("form"), F.array(none).alias("parties"), "text", *(v.alias(k) for k, v in fields.items()),
    )
    accounts = docs.select(key.alias("contract_id"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 50 + 1).alias("cik"), F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("matched_name"), F.col("doc_id").alias("at"))
    entries = _t(s, d, "pages").select((F.col("page_id") % 70 + 1).alias("cik"), F.concat(F.lit("p-"), F.col("page_id").cast("string")).alias("accession"), F.lit("2024-02-01").alias("filing_date"), F.lit("10-K").alias("form"), F.col("html").alias("text"))
    book = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: F.concat(F.lit("## Clause "), k.cast("string"), F.lit("\n### Preferred position\n"), F.col("n_name"), F.lit("\n### Acceptable fallback\nnone\n### Escalate if\n"), F.when((F.col("n_nationkey") % 2 == 0) | (k < 10), "ever").otherwise(""), F.lit("\n"))), "")
    books = _t(s, d, "nation").select(F.concat(F.lit("book"), F.col("n_nationkey").cast("string")).alias("doc_id"), book.alias("text"))
    return selection.gather(rows, accounts, entries, books).select("doc_id", "doc_type", F.md5("text").alias("text_md5"), "account", "cik")


@query("""SELECT o_orderkey AS id, CASE WHEN said THEN 'COMPANY ' || o_custkey || ', INC.' END AS filer, CASE WHEN said THEN CASE WHEN o_orderkey % 2 = 0 THEN '10-K' ELSE 'S-1/A' END END AS form,
  CASE WHEN said THEN strftime(o_orderdate::DATE, '%Y-%m-%d') END AS filing_date FROM (SELECT *, o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AS said FROM orders)""")
def source_footers(s, d):
    """What the footers of a text derived from each order say: the same twice, two companies, or nothing."""
    say = lambda who: F.concat(F.lit("Source: COMPANY "), who.cast("string"), F.lit(", INC., "), F.when(F.col("o_orderkey") % 2 == 0, "10-K").otherwise("S-1/A"), F.lit(", "), F.date_format("o_orderdate", "M/d/yyyy"))
    other = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    body = F.concat(F.lit("Page 1\n"), say(F.col("o_custkey")), F.lit("\nThe parties agree.\n\n"), say(other), F.lit("\n"))
    text = F.when(F.col("o_orderkey") % 7 == 0, "Source: none, given").otherwise(body)
    return _t(s, d, "orders").select(F.col("o_orderkey").alias("id"), records.source_footer(text).alias("f")).select("id", "f.filer", "f.form", "f.filing_date")


@query("""SELECT 'b' || c_custkey AS doc_id, CASE c_custkey % 3 WHEN 2 THEN 9 ELSE 10 END AS categories, CASE c_custkey % 3 WHEN 0 THEN 30 WHEN 1 THEN 29 ELSE 27 END AS filled,
  CASE c_custkey % 3 WHEN 1 THEN 'Clause 10 / Escalate if' ELSE '' END AS empty, CASE c_custkey % 3 WHEN 2 THEN '9 category headings, expected 10' ELSE '' END AS problems, c_custkey % 3 = 0 AS complete FROM customer""")
def playbook_states(s, d):
    """Playbooks derived from customers: whole, with a position left empty, or a category short."""
    rest = F.col("c_custkey") % 3
    last = F.lit(10) - (rest == 2).cast("int")
    part = lambda k: F.concat(F.lit("## "), k.cast("string"), F.lit(". Clause "), k.cast("string"), F.lit("\n### Preferred position\nours\n### Acceptable fallback\ntheirs\n### Escalate if\n"), F.when((rest == 1) & (k == 10), " ").otherwise("ever"), F.lit("\n"))
    text = F.array_join(F.transform(F.sequence(F.lit(1), last), part), "")
    books = _t(s, d, "customer").select(F.concat(F.lit("b"), F.col("c_custkey").cast("string")).alias("doc_id"), text.alias("text"))
    got = records.playbook_status(books)
    return got.select("doc_id", F.col("categories").cast("long").alias("categories"), F.col("filled").cast("long").alias("filled"), F.array_join("empty", "; ").alias("empty"), F.array_join("problems", "; ").alias("problems"), "complete")
