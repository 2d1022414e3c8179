"""Registered queries of reports and of rules over rows that Spark derives from the tables; each with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from docforge.functions import extract, filters
from docforge.functions import text as T
from docforge.operators import chunking, evaluate, filings, reports, resolve, windowed
from docforge.plans import answer
from docforge.plans.catalogue import _BM25, _GOLD, _TILES, _t, query
from docforge.session import forget, shared_dir
from docforge.sources import columns
from docforge.sources.progress import read_progress

_KIND = "CASE lang WHEN 'en' THEN 'contract' WHEN 'de' THEN 'risk_factors' ELSE 'playbook' END"
_OPENS = "CASE doc_id % 5 WHEN 0 THEN 'heading' WHEN 1 THEN 'paragraph' ELSE 'window' END"


def _wins(name: str, size: int, stride: int) -> str:
    return f"""w_{name} AS (SELECT doc_id, unnest(range(0, CASE WHEN n <= {size} THEN 1 ELSE 1 + ceil((n - {size}) / {stride}.0)::BIGINT END)) AS win FROM cnt),
{name} AS (SELECT doc_id, win, min(start) AS start, count(*) AS tokens FROM w_{name} JOIN tok USING (doc_id) WHERE pos >= win * {stride} AND pos < win * {stride} + {size} GROUP BY 1, 2)"""


@query(
    f"""WITH {_TILES}, cnt AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1), {_wins("fixed", 400, 320)}, {_wins("narrow", 120, 100)},
c AS (SELECT *, row_number() OVER (PARTITION BY chunker, doc_id ORDER BY start) = 1 AS opens, {_KIND} AS doc_type, {_OPENS} AS boundary
  FROM (SELECT 'fixed' AS chunker, * FROM fixed UNION ALL SELECT 'narrow', * FROM narrow) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)),
s AS (SELECT chunker, doc_type, grouping(chunker, doc_type) AS g, count(*) FILTER (WHERE opens) AS docs, count(*) AS chunks, median(tokens)::DOUBLE AS median_tokens, max(tokens) AS max_tokens,
  count(*) FILTER (WHERE tokens > 254) AS over_254, count(*) FILTER (WHERE tokens > 110) AS over_110 FROM c GROUP BY GROUPING SETS ((chunker, doc_type), (chunker), ())),
k AS (SELECT chunker, doc_type, grouping(chunker, doc_type) AS g, boundary, count(*) AS n FROM c WHERE opens GROUP BY GROUPING SETS ((chunker, doc_type, boundary), (chunker, boundary), (boundary))),
l AS (SELECT chunker, doc_type, g, string_agg(boundary || ' ' || n, ', ' ORDER BY n DESC, boundary) AS boundaries FROM k GROUP BY 1, 2, 3)
SELECT s.chunker, s.doc_type, docs, chunks, median_tokens, max_tokens, over_254, over_110, boundaries
FROM s LEFT JOIN l ON s.g = l.g AND s.chunker IS NOT DISTINCT FROM l.chunker AND s.doc_type IS NOT DISTINCT FROM l.doc_type"""
)
def chunk_report(s, d):
    """Two chunkers by document type, by chunker and in all."""
    docs = _t(s, d, "documents").select("doc_id", "text", F.expr(_KIND).alias("doc_type"), F.expr(_OPENS).alias("boundary"))
    made = chunking.windows_of(docs, {"fixed": (400, 80), "narrow": (120, 20)}, keep=("doc_type", "boundary"))
    return reports.chunk_report(made, limits=(254, 110))


def _arm_sql(name: str) -> str:
    post = _BM25.replace("FROM documents", f"FROM ch_{name}").replace("doc_id", "cid")
    for t in ("toks", "tot", "post", "raws", "terms", "q", "sc"):
        post = re.sub(rf"\b{t} AS \(", f"{name}_{t} AS (", post)
        post = re.sub(rf"(FROM|JOIN|,) {t}\b", rf"\1 {name}_{t}", post)
    return f"""ch_{name} AS (SELECT doc_id * 100000 + win AS cid, doc_id, w.start, "end", substring(text, start + 1, "end" - start) AS text FROM {name} w JOIN documents USING (doc_id)),
{post}"""


def _wins_end(name: str, size: int, stride: int) -> str:
    return _wins(name, size, stride).replace("min(start) AS start,", 'min(start) AS start, max("end") AS "end",')


_ARMS = """scored AS (SELECT 'fixed' AS arm, item_id, cid, c.doc_id, c.start, c."end", score FROM fixed_sc JOIN ch_fixed c USING (cid) UNION ALL SELECT 'narrow', item_id, cid, c.doc_id, c.start, c."end", score FROM narrow_sc JOIN ch_narrow c USING (cid)),
own AS (SELECT DISTINCT item_id, doc_id FROM gold),
marked AS (SELECT s.*, 'corpus' AS scope FROM scored s UNION ALL SELECT s.*, 'scoped' FROM scored s JOIN own USING (item_id, doc_id)),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arm, scope, item_id ORDER BY round(score, 10) DESC, cid) AS rank FROM marked) WHERE rank <= 10),
g AS (SELECT DISTINCT arm, scope, item_id, doc_id, start AS gs, "end" AS ge FROM gold, (SELECT unnest(['fixed', 'narrow']) AS arm), (SELECT unnest(['corpus', 'scoped']) AS scope)),
best AS (SELECT g.arm, g.scope, g.item_id, g.doc_id, gs, ge, min(CASE WHEN start < ge AND gs < "end" THEN rank END) AS r
  FROM g LEFT JOIN hits h ON h.arm = g.arm AND h.scope = g.scope AND h.item_id = g.item_id AND h.doc_id = g.doc_id GROUP BY ALL),
per AS (SELECT arm, scope, item_id, round(avg(CASE WHEN r <= 3 THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall_3, round(avg(CASE WHEN r <= 5 THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall_5,
  round(avg(CASE WHEN r <= 10 THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall_10, round(coalesce(1.0::DOUBLE / min(r), 0), 4) AS mrr FROM best GROUP BY 1, 2, 3),
wr AS (SELECT arm, scope, item_id, count(*) FILTER (WHERE KIND <> 'contract') AS w FROM hits JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY 1, 2, 3)
SELECT arm, scope, count(*) AS n, round(avg(recall_3), 4) AS recall_3, round(avg(recall_5), 4) AS recall_5, round(avg(recall_10), 4) AS recall_10, round(avg(mrr), 4) AS mrr, coalesce(sum(w), 0)::BIGINT AS wrong_types
FROM per LEFT JOIN wr USING (arm, scope, item_id) GROUP BY 1, 2""".replace("KIND", _KIND)


@query(f"WITH {_TILES}, cnt AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1), {_wins_end('fixed', 400, 320)}, {_wins_end('narrow', 120, 100)}, {_arm_sql('fixed')}, {_arm_sql('narrow')}, {_GOLD}, {_ARMS}")
def scoped_arms(s, d):
    """Two chunkers by two scopes: each chunker's chunks are scored once."""
    docs, items = _t(s, d, "documents").select("doc_id", "text", F.expr(_KIND).alias("doc_type")), _t(s, d, "benchmark")
    # read several times, and a written table's size tells whether it is broadcast
    path = shared_dir(s)
    forget(s, path)
    evaluate.gold_spans(docs, items).write.parquet(path)
    return windowed.scoped_arms(docs, items, s.read.parquet(path), {"fixed": (400, 80), "narrow": (120, 20)})


_DAY_SQL = "SELECT ts::DATE AS date, strftime(ts::DATE, '%Y-%m-%d') || ': ' || count(*) || ' events, ' || count(*) FILTER (WHERE event_type = 'purchase') || ' purchases' AS text FROM events GROUP BY ts::DATE"


def _days(s, d):
    e = _t(s, d, "events").withColumn("date", F.to_date("ts"))
    said = F.concat(F.col("date").cast("string"), F.lit(": "), F.count("*").cast("string"), F.lit(" events, "), F.count_if(F.col("event_type") == "purchase").cast("string"), F.lit(" purchases"))
    return e.groupBy("date").agg(said.alias("text"))


@query(f"SELECT strftime(date_trunc('week', date), '%Y-%m-%d') AS week, count(*) AS n, string_agg(text, chr(10) ORDER BY date) AS text FROM ({_DAY_SQL}) GROUP BY 1")
def week_rollup(s, d):
    """Days of events, each a text, rolled up to weeks from Monday on."""
    return reports.week_chunks(_days(s, d)).select(F.col("week").cast("string").alias("week"), F.size("days").cast("long").alias("n"), "text")


@query(
    """WITH e AS (SELECT event_type AS item_id, ts::DATE AS day, value FROM events),
expected AS (SELECT DISTINCT item_id, day FROM e WHERE value > 60 AND day(day) % 3 = 0),
weeks AS (SELECT item_id, date_trunc('week', day) AS week, row_number() OVER (PARTITION BY item_id ORDER BY max(value) DESC, date_trunc('week', day)) AS rank FROM e GROUP BY 1, 2),
met AS (SELECT x.item_id, day, rank FROM expected x LEFT JOIN weeks w ON x.item_id = w.item_id AND date_trunc('week', day) = week)
SELECT item_id, round(count(*) FILTER (WHERE rank <= 1) / count(*), 4)::DOUBLE AS recall_1, round(count(*) FILTER (WHERE rank <= 3) / count(*), 4)::DOUBLE AS recall_3, round(coalesce(1.0::DOUBLE / min(rank), 0), 4) AS mrr FROM met GROUP BY 1"""
)
def week_coverage(s, d):
    """Expected days of each event type against weeks, best value first; a week covers its days."""
    e = _t(s, d, "events").select(F.col("event_type").alias("item_id"), F.to_date("ts").alias("day"), "value")
    expected = e.where((F.col("value") > 60) & (F.dayofmonth("day") % 3 == 0)).select("item_id", "day")
    weeks = reports.week_chunks(e.select(F.col("day").alias("date"), F.lit("").alias("text")).distinct()).select("week", "days")
    ranked = e.groupBy("item_id", F.date_trunc("week", "day").cast("date").alias("week")).agg(F.max("value").alias("top"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("top"), "week"))).join(weeks, "week")
    return reports.coverage(expected, ranked.select("item_id", "rank", "days"), (1, 3))


_RAN = "(o_orderkey % 4 <> 0 OR o_orderpriority = '1-URGENT') AND o_orderpriority <> '5-LOW'"
_TORN = "(o_orderkey % 7 = 0 AND o_orderpriority <> '1-URGENT')"


def _run(s, d):
    """Planned items of each arm, and a progress file with torn and repeated lines, read again."""
    path = shared_dir(s)
    forget(s, path)
    o = _t(s, d, "orders")
    line = F.to_json(F.struct(F.lit("row").alias("type"), F.col("o_orderpriority").alias("arm"), F.col("o_orderkey").alias("item"), F.col("o_totalprice").alias("score")))
    rows = o.where(_RAN).withColumn("line", line).select(F.when(F.expr(_TORN), F.substring("line", 1, 40)).otherwise(F.col("line")).alias("value"))
    again = o.where(f"{_RAN} AND o_orderkey % 9 = 1").select(line.alias("value"))
    head = s.range(1).select(F.lit('{"type": "meta", "seed": 1}').alias("value"))
    rows.union(again).union(head).write.text(path)
    _, progress = read_progress(s, path, "arm string, item long, score double")
    return reports.resume(o.select(F.col("o_orderpriority").alias("arm"), F.col("o_orderkey").alias("item")), progress)


_DONE = f"({_RAN}) AND (NOT {_TORN} OR o_orderkey % 9 = 1)"


@query(
    f"""SELECT o_orderpriority AS arm, count(*) AS planned, count(*) FILTER (WHERE {_DONE}) AS done,
  CASE WHEN count(*) FILTER (WHERE {_DONE}) = count(*) THEN 'finished' WHEN count(*) FILTER (WHERE {_DONE}) > 0 THEN 'partial' ELSE 'not reached' END AS status,
  round(avg(o_totalprice) FILTER (WHERE {_DONE}), 4) AS mean_score FROM orders GROUP BY 1"""
)
def resumed_arms(s, d):
    return _run(s, d)[0]


@query(f"SELECT o_orderpriority AS arm, o_orderkey AS item FROM orders WHERE NOT ({_DONE})")
def resumed_todo(s, d):
    return _run(s, d)[1]


@query(
    """WITH e AS (SELECT user_id, event_id, '[' || event_id || ']' || chr(10) || event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY r) FILTER (WHERE r <= 30)
  || CASE WHEN max(n) > 30 THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) || '(' || (max(n) - 30) || ' more matching days not shown)' ELSE '' END AS evidence, max(n) AS n FROM e GROUP BY 1"""
)
def evidence_shown(s, d):
    """The first thirty texts of each user and the number of the others."""
    return answer.evidence(_t(s, d, "events"), "user_id", F.col("event_id"), F.col("event_type"), F.col("event_id"))


# --- rules over derived rows, in place of queries that read no table


@query("SELECT event_id AS id FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN floor(value / 10) END AS num, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS flag FROM events) WHERE NOT coalesce(num <> 5, false) AND flag IS DISTINCT FROM false")
def filter_null_semantics(s, d):
    rows = _t(s, d, "events").selectExpr("event_id AS id", "CASE WHEN event_id % 3 <> 0 THEN floor(value / 10) END AS num", "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS flag")
    return rows.where(~filters.typed("num", "number", "!=", 5) & filters.typed("flag", "boolean", "!=", "no")).select("id")


@query(
    """SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'native' WHEN 1 THEN 'recovered' WHEN 2 THEN 'recovered' WHEN 3 THEN 'failed: cut off' ELSE 'failed: not JSON' END AS path,
  CASE WHEN event_id % 5 < 3 THEN regexp_extract(props, '[0-9]+') END AS k FROM events"""
)
def json_recover(s, d):
    """Properties as they came, in a fence, between words, cut off, and none."""
    kind = F.col("event_id") % 5
    raw = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit("so\n```json\n"), "props", F.lit("\n```"))).when(kind == 2, F.concat(F.lit("x "), "props", F.lit(" y"))).when(kind == 3, F.expr("left(props, 5)")).otherwise("no")
    body, path = T.recover_json(raw, F.when(kind == 3, "max_tokens").otherwise("end"))
    return _t(s, d, "events").select(F.col("event_id").alias("id"), path.alias("path"), F.get_json_object(body, "$.k").alias("k"))


_LAWS = (("under the laws of the State of New York", "New York"), ("and English law", "England"), ("in no place", None), ("governed by the laws of Germany", "Germany"))


@query(
    """SELECT o_orderkey AS id, strftime(o_orderdate::DATE, '%Y-%m-%d') AS dates, CASE WHEN n = 1 THEN '1 day' ELSE n || ' days' END AS durations,
  CASE o_orderkey % 4 WHEN 0 THEN 'New York' WHEN 1 THEN 'England' WHEN 3 THEN 'Germany' END AS place FROM (SELECT *, o_orderkey % 90 + 1 AS n FROM orders)"""
)
def extraction(s, d):
    """Date, term and place of a sentence written from each order; dates in four forms."""
    day, kind = F.to_date("o_orderdate"), F.col("o_orderkey") % 4
    date = F.when(kind == 0, F.date_format(day, "MMMM d, yyyy")).when(kind == 1, F.date_format(day, "yyyy-MM-dd")).when(kind == 2, F.date_format(day, "M/d/yyyy")).otherwise(F.date_format(day, "d MMMM yyyy"))
    place = F.element_at(F.array(*(F.lit(p) for p, _ in _LAWS)), (kind + 1).cast("int"))
    text = F.concat(F.lit("Dated "), date, F.lit(" for "), (F.col("o_orderkey") % 90 + 1).cast("string"), F.lit("\ncalendar days "), place)
    return _t(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(extract.dates_in(text), ",").alias("dates"), F.array_join(extract.durations_in(text), ",").alias("durations"), extract.jurisdiction_in(text).alias("place"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'outsourcing' WHEN p_partkey % 3 = 0 THEN 'hosting' WHEN p_partkey % 5 = 0 THEN 'distributor' WHEN p_partkey % 7 = 0 THEN 'supply' END AS type FROM part")
def type_priority(s, d):
    """The first of a title's types in their order of priority, whatever their order in the title."""
    word = lambda n, w: F.when(F.col("p_partkey") % n == 0, w).otherwise("")
    title = F.concat_ws("_", F.lit("acme"), word(7, "Supply"), word(5, "DISTRIBUTION"), word(3, "web hosting"), word(2, "Outsource"))
    return _t(s, d, "part").select("p_partkey", F.try_element_at(extract.contract_types(title), F.lit(1)).alias("type"))


@query(
    """WITH n AS (SELECT c_custkey AS id, unnest([c_custkey % 11, c_custkey % 7, c_custkey % 5]) AS k, unnest([0, 1, 2]) AS pos FROM customer),
m AS (SELECT id, pos, k, CASE WHEN k = 2 THEN 902 WHEN k = 4 THEN NULL WHEN k % 3 = 1 THEN 100 + k END AS cik FROM n)
SELECT id, min(pos) FILTER (WHERE cik IS NOT NULL) IS NOT NULL AS found, arg_min(cik, pos) FILTER (WHERE cik IS NOT NULL) AS cik, arg_min(CASE WHEN k = 2 THEN 'manual_review' ELSE 'tickers_exact' END, pos) FILTER (WHERE cik IS NOT NULL) AS method FROM m GROUP BY 1"""
)
def ordered_first_resolved(s, d):
    """The first of each customer's names that has an id: what people settled (2: an id, 4: none) before what was resolved."""
    c = _t(s, d, "customer")
    name = lambda n: F.concat(F.lit("n"), (F.col("c_custkey") % n).cast("string"))
    contracts = c.select(F.col("c_custkey").alias("contract_id"), F.array(name(11), name(7), name(5)).alias("names"))
    k = c.select((F.col("c_custkey") % 11).alias("k")).distinct()
    named = k.select(F.concat(F.lit("n"), F.col("k").cast("string")).alias("name"), "k")
    cik = F.when(F.col("k") % 3 == 1, 100 + F.col("k")).cast("long")
    resolved = named.select("name", cik.alias("cik"), F.when(cik.isNotNull(), F.col("name")).alias("matched_name"), F.when(cik.isNotNull(), "tickers_exact").otherwise("unresolved").alias("method"), F.lit(1.0).alias("score"))
    settled = named.where("k IN (2, 4)").select("name", F.when(F.col("k") == 2, 902).cast("long").alias("cik"), F.when(F.col("k") == 2, "settled").alias("matched_name"))
    review = named.where("false").select("name", F.lit(0).cast("long").alias("cik"), F.lit("").alias("matched_name"), F.lit("").alias("method"), F.lit(0.0).alias("score"))
    got = resolve.accounts(contracts, resolved, review, settled)[0]
    return got.select(F.col("contract_id").alias("id"), F.col("cik").isNotNull().alias("found"), "cik", "method")


@query("SELECT value, n, first_seen, row_number() OVER (ORDER BY n DESC, first_seen) AS rank FROM (SELECT o_orderpriority AS value, count(*) AS n, min(o_orderkey) AS first_seen FROM orders GROUP BY 1)")
def most_common(s, d):
    """Values by how often they stand, of equal counts the one seen first; a row a value, so few are ordered."""
    n = _t(s, d, "orders").groupBy(F.col("o_orderpriority").alias("value")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_seen"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first_seen")).cast("long"))


@query(
    """SELECT o_custkey AS cik, row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate::DATE, '%Y-%m-%d'), 'a' || o_orderkey) - 1 AS at, 'a' || o_orderkey AS accession,
  strftime(o_orderdate::DATE, '%Y-%m-%d') AS filing_date, CASE WHEN o_orderkey % 3 <> 0 OR o_custkey % 2 = 0 THEN o_orderstatus END AS form FROM orders WHERE o_orderkey % 3 <> 0 OR o_custkey % 5 <> 0"""
)
def filings_by_column(s, d):
    """Each customer's orders as a submission by column with an older page; odd customers' pages lack a column, every fifth's page is missing."""
    o = _t(s, d, "orders").withColumn("page", F.expr("CAST(o_orderkey % 3 = 0 AS INT)"))
    row = F.struct(F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("a"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.col("o_orderstatus").alias("f"))
    blocks = o.groupBy("o_custkey", "page").agg(F.collect_list(row).alias("r"))
    whole = (F.col("page") == 0) | (F.col("o_custkey") % 2 == 0)
    block = F.struct(F.col("r.a").alias("accessionNumber"), F.col("r.d").alias("filingDate"), F.when(whole, F.col("r.f")).alias("form"))
    name = F.concat(F.lit("older-"), F.col("o_custkey").cast("string"))
    recent = blocks.where("page = 0").select("o_custkey", block.alias("recent"))
    pages = blocks.where("page = 1 AND o_custkey % 5 <> 0").select(name.alias("name"), F.to_json(block).alias("json"))
    every = o.select("o_custkey").distinct().join(recent, "o_custkey", "left")
    body = F.to_json(F.struct(F.struct(F.col("recent"), F.array(F.struct(name.alias("name"))).alias("files")).alias("filings")))
    got = columns.filings_of(every.select(F.col("o_custkey").alias("cik"), body.alias("json")), pages)
    return got.select("cik", F.col("at").cast("long").alias("at"), "accession", "filing_date", "form")


_FORM = "CASE event_type WHEN 'click' THEN '10-K' WHEN 'view' THEN 'S-1/A' WHEN 'purchase' THEN '8-K' ELSE event_type END"
_WANT = "CASE o_orderkey % 3 WHEN 0 THEN 'S-1A' WHEN 1 THEN '10-k' END"


@query(
    f"""WITH f AS (SELECT user_id AS cik, ts::DATE AS day, {_FORM} AS form, 'e' || event_id AS accession FROM events),
c AS (SELECT o_orderkey AS contract_id, o_custkey AS cik, CASE WHEN o_orderkey % 9 <> 0 THEN DATE '2024-01-01' + (o_orderkey % 30)::INT END AS day, {_WANT} AS want FROM orders),
j AS (SELECT contract_id, c.day, accession, form, coalesce(upper(form) = upper(want) OR (want = 'S-1A' AND form = 'S-1/A'), false) AS fits FROM c LEFT JOIN f ON c.cik = f.cik AND c.day = f.day),
g AS (SELECT contract_id, day, count(accession) AS n, count(*) FILTER (WHERE fits) AS k, min(accession) AS a, min(accession) FILTER (WHERE fits) AS b FROM j GROUP BY 1, 2),
s AS (SELECT contract_id, CASE WHEN k > 0 THEN k ELSE n END AS candidates, CASE WHEN k > 0 THEN b ELSE a END AS one, day FROM g)
SELECT contract_id, candidates, CASE WHEN day IS NULL THEN 'no_date' WHEN candidates = 0 THEN 'not_found' WHEN candidates = 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
  CASE WHEN day IS NOT NULL AND candidates = 1 THEN one END AS accession FROM s"""
)
def parent_filings(s, d):
    """The filing of each order's day and form among events, amendments in either spelling."""
    own = _t(s, d, "events").select(F.col("user_id").alias("cik"), F.date_format("ts", "yyyy-MM-dd").alias("filing_date"), F.expr(_FORM).alias("form"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("accession"))
    day = F.when(F.col("o_orderkey") % 9 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 30).cast("int")).cast("string"))
    contracts = _t(s, d, "orders").select(F.col("o_orderkey").alias("contract_id"), F.col("o_custkey").alias("cik"), day.alias("filing_date"), F.expr(_WANT).alias("form"))
    return filings.parent_filing(contracts, own).select("contract_id", "candidates", "status", "accession")


_ANNUAL = "CASE l_returnflag WHEN 'R' THEN '10-K' WHEN 'A' THEN '10-K405' ELSE '8-K' END"


@query(
    f"""WITH f AS (SELECT l_suppkey AS cik, {_ANNUAL} AS form, (l_shipdate + INTERVAL 10 YEAR)::DATE AS filed, CASE WHEN l_linenumber % 2 = 0 THEN (l_shipdate + INTERVAL 10 YEAR)::DATE - 90 END AS report,
  'l' || l_orderkey || '-' || l_linenumber AS accession FROM lineitem),
k AS (SELECT cik, filed, accession, coalesce(report, filed) >= DATE '2005-12-01' AS fits FROM f WHERE form <> '8-K'),
c AS (SELECT o_orderkey AS contract_id, o_custkey % 1000 AS cik, CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderdate + INTERVAL 10 YEAR)::DATE END AS day FROM orders),
j AS (SELECT contract_id, day, accession, filed, fits, count(accession) OVER (PARTITION BY contract_id) AS n,
  row_number() OVER (PARTITION BY contract_id ORDER BY CASE WHEN fits AND day IS NOT NULL THEN 0 ELSE 1 END, abs(date_diff('day', day, filed)), filed DESC, accession) AS r FROM c LEFT JOIN k ON c.cik = k.cik)
SELECT contract_id, CASE WHEN fits AND day IS NOT NULL THEN accession END AS accession, CASE WHEN fits AND day IS NOT NULL THEN date_diff('day', day, filed) END AS gap_days,
  CASE WHEN day IS NULL THEN 'no agreement or filing date to match a 10-K to' WHEN n = 0 THEN 'no 10-K on file' WHEN NOT fits THEN 'only 10-Ks for periods before 2005-12-01, which have no Item 1A' END AS reason FROM j WHERE r = 1"""
)
def nearest_annual_report(s, d):
    """The annual report nearest to each order among the lines of a supplier, ten years on."""
    later = lambda c: F.add_months(F.to_date(c), 120)
    own = _t(s, d, "lineitem").select(
        F.col("l_suppkey").alias("cik"), F.expr(_ANNUAL).alias("form"), later("l_shipdate").cast("string").alias("filing_date"),
        F.when(F.col("l_linenumber") % 2 == 0, F.date_sub(later("l_shipdate"), 90).cast("string")).alias("report_date"), F.concat(F.lit("l"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("accession"),
    )
    contracts = _t(s, d, "orders").select(F.col("o_orderkey").alias("contract_id"), (F.col("o_custkey") % 1000).alias("cik"), F.when(F.col("o_orderkey") % 13 != 0, later("o_orderdate").cast("string")).alias("when"))
    return filings.nearest_annual(contracts, own).select("contract_id", "accession", F.col("gap_days").cast("long").alias("gap_days"), "reason")
