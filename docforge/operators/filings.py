"""Filings of a company: the one a contract was attached to, the nearest annual one, its risk section, its revenue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.operators.relate import nearest_days, priority_pick

#: Revenue concepts by priority, annual forms, and from when annual reports have a risk section.
CONCEPTS = ("Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueNet", "SalesRevenueGoodsNet", "SalesRevenueServicesNet", "RevenuesNetOfInterestExpense")
ANNUAL, TEN_K, RISK_FROM, LEAST_RISK = ("10-K", "10-K/A", "10-K405", "10-KT"), ("10-K", "10-K405"), "2005-12-01", 2000
ARCHIVE = "https://www.sec.gov/Archives/edgar/data/%d/%s/%s"


def archive_url(cik: Column, accession: Column, document: Column) -> Column:
    return F.format_string(ARCHIVE, cik, F.replace(accession, F.lit("-"), F.lit("")), document)


def parent_filing(contracts: DataFrame, filings: DataFrame) -> DataFrame:
    """(contract_id, status, accession, form, candidates): filings of the contract's company and day.

    Narrowed to the contract's form, also in the spelling of amendments (S-1A is
    S-1/A), unless that leaves none.  ``contracts`` (contract_id, cik,
    filing_date, form), ``filings`` (cik, filing_date, form, accession).
    """
    want = F.upper("form")
    amended = F.when(want.endswith("A") & ~want.contains("/"), F.concat(F.regexp_replace(F.expr("left(upper(form), length(form) - 1)"), "-+$", ""), F.lit("/A")))
    left = contracts.select("contract_id", "cik", F.col("filing_date").alias("day"), want.alias("want"), amended.alias("also"))
    right = filings.select("cik", F.col("filing_date").alias("day"), F.col("form").alias("found"), "accession")
    fits = F.coalesce(F.upper("found").isin(F.col("want")) | (F.upper("found") == F.col("also")), F.lit(False))
    one = F.struct("accession", F.col("found").alias("form"))
    got = left.join(right, ["cik", "day"], "left").withColumn("fits", fits)
    got = got.groupBy("contract_id", "day").agg(F.count("accession").alias("n"), F.count_if("fits").alias("k"), F.min(one).alias("a"), F.min(F.when(F.col("fits"), one)).alias("b"))
    n, pick = F.when(F.col("k") > 0, F.col("k")).otherwise(F.col("n")), F.when(F.col("k") > 0, F.col("b")).otherwise(F.col("a"))
    status = F.when(F.col("day").isNull(), "no_date").when(n == 0, "not_found").when(n == 1, "resolved").otherwise("ambiguous")
    only = lambda c: F.when(status == "resolved", c)
    return got.select("contract_id", status.alias("status"), only(pick["accession"]).alias("accession"), only(pick["form"]).alias("form"), n.alias("candidates"))


def nearest_annual(contracts: DataFrame, filings: DataFrame) -> DataFrame:
    """(contract_id, accession, filing_date, gap_days, reason): the annual report nearest to ``when``, the later of two as near.

    Only reports on periods that have a risk section count; ``reason`` tells why
    there is none.  ``contracts`` (contract_id, cik, when), ``filings`` (cik,
    filing_date, report_date, form, accession) with dates as ISO strings.
    """
    annual = filings.where(F.col("form").isin(*TEN_K) & F.col("filing_date").isNotNull())
    fits = F.coalesce("report_date", "filing_date") >= RISK_FROM
    listed = annual.groupBy("cik", F.col("filing_date").cast("date").alias("day")).agg(F.min(F.when(fits, F.struct("accession", "filing_date"))).alias("one"), F.count("accession").alias("k"))
    asked = contracts.select("contract_id", "cik", "when", F.col("when").cast("date").alias("day"))
    # a company's days are few however many its contracts and reports are
    near = nearest_days(asked.where("day IS NOT NULL AND cik IS NOT NULL"), listed, "cik")
    gap = F.datediff("at", "day")
    order = F.when(F.col("at").isNotNull(), F.struct(F.abs(gap).alias("g"), (-F.unix_date("at")).alias("d"), "one.accession", "one.filing_date", gap.alias("gap_days")))
    got = asked.join(near, ["cik", "day"], "left").groupBy("contract_id", "when").agg(F.min(order).alias("p"), F.sum(F.coalesce("k", F.lit(0))).alias("n"))
    why = F.when(F.col("when").isNull(), "no agreement or filing date to match a 10-K to").when(F.col("n") == 0, "no 10-K on file").when(F.col("p").isNull(), f"only 10-Ks for periods before {RISK_FROM}, which have no Item 1A")
    return got.select("contract_id", "p.accession", "p.filing_date", "p.gap_days", why.alias("reason"))


def revenue_series(facts: DataFrame) -> DataFrame:
    """One row a company and period end of ``facts`` (cik, concept, form, fp, start, end, val, filed, accession).

    Annual forms and whole years only; the concept of highest priority wins, and
    of one concept what was filed last.
    """
    rank = F.array_position(F.array(*map(F.lit, CONCEPTS)), F.col("concept"))
    days = F.datediff(F.col("end").cast("date"), F.col("start").cast("date"))
    own = facts.where(F.col("form").isin(*ANNUAL) & (F.col("fp") == "FY") & days.between(350, 380) & (rank > 0))
    best = priority_pick(own.withColumn("rank", rank), ["cik", "end"], ["rank", F.desc("filed"), "accession"])
    return best.select(F.format_string("rev_%s_%s", F.col("cik").cast("string"), F.col("end")).alias("row_id"), "cik", F.col("end").alias("fiscal_year_end"), F.col("start").alias("period_start"), F.col("val").alias("revenue_usd"), "concept", "filed", "accession", "form")


def risk_section(text: Column) -> Column:
    """struct(ok, text, start, end, reason, snippet) of the risk section: the longest between its heading and the next item's.

    Fixed values: the headings, and the wordings of a section that says nothing.
    """
    pieces = F.split(text, r"(?imd)(?=^[ \t]*item\s*(?:1a|1b|1c|2))", -1)
    lengths = F.transform(pieces, lambda p: F.char_length(p))
    here = r"(?is)^\s*item\s*1a\s*[.:\-–—]?\s*(?:risk\s+factors)?"

    def body(i: Column) -> Column:
        later = F.filter(F.sequence(i + 1, F.size(pieces)), lambda j: F.get(pieces, j).rlike(r"(?i)^\s*item\s*(?:1b|1c|2)"))
        j = F.get(later, F.lit(0))
        whole = F.array_join(F.slice(pieces, i + 1, j - i), "")
        start = F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda a, x: a + x)
        own = F.regexp_replace(F.regexp_replace(whole, here, ""), r"^\s+|\s+\z", "")
        return F.when(j.isNotNull(), F.struct(F.char_length(own).alias("n"), (-i).alias("i"), own.alias("text"), start.alias("start"), (start + F.char_length(whole)).alias("end")))

    starts = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: F.get(pieces, i).rlike(r"(?i)^\s*item\s*1a"))
    best = F.array_max(F.filter(F.transform(starts, body), lambda x: x.isNotNull()))
    own = best["text"]
    short = F.when(own.rlike(r"(?i)incorporated\s+(?:herein\s+)?by\s+reference"), "incorporated by reference").when(
        own.rlike(r"(?i)smaller\s+reporting\s+compan|not\s+applicable|not\s+required\s+to\s+(?:provide|include)|none\.?\s*$"), "not provided (smaller reporting company or not applicable)"
    ).otherwise(F.concat(F.lit("section is "), best["n"].cast("string"), F.lit(" chars")))
    ok = F.coalesce(best["n"] >= LEAST_RISK, F.lit(False))
    reason = F.when(best.isNull(), "no Item 1A heading followed by an Item 1B, 1C or 2 heading").when(~ok, short)
    kept = lambda c: F.when(ok, c)
    return F.struct(ok.alias("ok"), kept(own).alias("text"), kept(best["start"]).alias("start"), kept(best["end"]).alias("end"), reason.alias("reason"), F.when(~ok, F.substring(F.regexp_replace(own, r"\s+", " "), 1, 200)).alias("snippet"))
