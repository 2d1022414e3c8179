"""Names, accounts, reviews and filings on written cases."""

from pyspark.sql import functions as F

from docforge.functions.names import compact_key, contract_id, entity_parties
from docforge.operators import filings, resolve


def col(spark, values, make, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(make(F.col("v"))).collect()]


def test_keys(spark):
    got = col(spark, ["LIMEENERGYCO", "Lime Energy Co.", "WHITESMOKE,INC", "The Coca-Cola Company", "COCACOLACO", "Thermo", "AT&T Corp", "Inco", None, "Group Holdings Limited"], compact_key)
    assert got == ["limeenergy", "limeenergy", "whitesmoke", "cocacola", "cocacola", "thermo", "atandt", "inco", "", "groupholdings"]
    assert col(spark, [" a title\n"], contract_id) == ["c_" + __import__("hashlib").sha1(b"a title").hexdigest()[:10]]


def test_parties(spark):
    spans = ["Distributor", "Electric City Corp.", "the Company", "Electric City Corp", 'both referred to jointly as the "Parties"', "Big Blue Sky", "x" * 130 + " Inc"]
    assert col(spark, [spans], entity_parties, "array<string>") == [["Electric City Corp.", "the Company", "Big Blue Sky"]] or col(spark, [spans], entity_parties, "array<string>") == [["Electric City Corp.", "Big Blue Sky"]]


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_resolution(spark):
    tickers = spark.createDataFrame([(1, "Lime Energy Co."), (2, "Veoneer, Inc."), (7, "Acme Corp"), (8, "ACME CORP")], "cik long, name string")
    lookup = spark.createDataFrame([(3, "CENTRACK INTERNATIONAL INC"), (4, "ADAMS GOLF INC"), (5, "Consolidated Widget Makers"), (9, "HF ENTERPRISES")], "cik long, name string")
    names = spark.createDataFrame([(n,) for n in ("LIMEENERGYCO", "CENTRACKINTERNATIONALINC", "Consolidated Widgets Makers", "Nothing Like It LLC", "Acme Corporation", "SHF Enterprises", "Adams Gulf")], "name string")
    found = resolve.candidates(names, {"tickers": tickers, "edgar_name_index": lookup})
    got, review = resolve.resolve_names(found, names)
    assert rows(got.na.fill({"cik": 0}), "name", "cik", "method") == [
        ("Acme Corporation", 0, "unresolved"), ("Adams Gulf", 0, "unresolved"), ("CENTRACKINTERNATIONALINC", 3, "edgar_name_index_exact"), ("Consolidated Widgets Makers", 5, "edgar_name_index_fuzzy"),
        ("LIMEENERGYCO", 1, "tickers_exact"), ("Nothing Like It LLC", 0, "unresolved"), ("SHF Enterprises", 0, "unresolved"),
    ]
    assert rows(review, "name", "cik", "method") == [("Acme Corporation", 7, "tickers_exact_ambiguous"), ("Acme Corporation", 8, "tickers_exact_ambiguous"), ("Adams Gulf", 4, "edgar_name_index_fuzzy")]
    said = spark.createDataFrame([("c", "Acme Corporation", "7", "Acme Corp", "m", "1.0", "no"), ("c", "Acme Corporation", "8", "ACME CORP", "m", "1.0", " Yes"), ("c", "Adams Gulf", "4", "ADAMS GOLF INC", "m", "0.9", "no"), ("c", "Open", "4", "x", "m", "0.9", "")], ", ".join(f"{c} string" for c in resolve.REVIEWED))
    settled = resolve.decisions(said)
    assert rows(settled.na.fill({"cik": 0}), "name", "cik") == [("Acme Corporation", 8), ("Adams Gulf", 0)]
    contracts = spark.createDataFrame([("c1", ["Nothing Like It LLC", None, "Consolidated Widgets Makers", "LIMEENERGYCO"]), ("c2", ["Adams Gulf", "Acme Corporation"]), ("c3", ["SHF Enterprises"]), ("c4", [])], "contract_id string, names array<string>")
    account, shown = resolve.accounts(contracts, got, review, settled)
    assert rows(account.na.fill({"cik": 0, "method": "-"}), "contract_id", "cik", "method") == [("c1", 5, "edgar_name_index_fuzzy"), ("c2", 8, "manual_review"), ("c3", 0, "-"), ("c4", 0, "-")]
    assert rows(shown, "contract_id", "name", "candidate_cik", "confirmed") == [("c1", "Consolidated Widgets Makers", 5, "auto")]
    merged = resolve.merge_review(said, shown.unionByName(shown.withColumn("name", F.lit("Adams Gulf")).withColumn("candidate_cik", F.lit(4).cast("long"))))
    assert rows(merged, "name", "candidate_cik", "confirmed") == [("Acme Corporation", "7", "no"), ("Acme Corporation", "8", " Yes"), ("Adams Gulf", "4", "no"), ("Consolidated Widgets Makers", "5", "auto")]


def test_filings(spark):
    made = [(1, "2010-03-01", None, "10-K", "a1"), (1, "2010-05-10", None, "10-Q", "a2"), (1, "2010-05-10", None, "8-K", "a3"), (1, "2010-05-10", None, "S-1/A", "a9"), (1, "2011-03-02", None, "10-K", "a4"), (2, "2004-01-01", None, "10-K", "b1")]
    fl = spark.createDataFrame(made, "cik long, filing_date string, report_date string, form string, accession string")
    c = spark.createDataFrame([("x", 1, "2010-05-10", "8-K"), ("y", 1, "2010-05-10", None), ("z", 1, "2010-05-10", "S-1A"), ("u", 1, "2010-06-01", None), ("v", 1, None, None), ("w", 1, "2010-05-10", "20-F")], "contract_id string, cik long, filing_date string, form string")
    got = {r["contract_id"]: (r["status"], r["accession"], r["candidates"]) for r in filings.parent_filing(c, fl).collect()}
    assert got == {"x": ("resolved", "a3", 1), "y": ("ambiguous", None, 3), "z": ("resolved", "a9", 1), "u": ("not_found", None, 0), "v": ("no_date", None, 0), "w": ("ambiguous", None, 3)}
    c = spark.createDataFrame([("x", 1, "2010-11-01"), ("y", 1, "2010-08-31"), ("z", 2, "2004-01-01"), ("u", 3, "2004-01-01"), ("v", 1, None)], "contract_id string, cik long, when string")
    got = {r["contract_id"]: (r["accession"], r["gap_days"], r["reason"]) for r in filings.nearest_annual(c, fl).collect()}
    assert got["x"] == ("a4", 121, None) and got["y"] == ("a4", 183, None) and got["z"][2].startswith("only 10-Ks") and got["u"][2] == "no 10-K on file" and got["v"][2].startswith("no agreement")


def test_revenue(spark):
    sales, contract = "SalesRevenueNet", "RevenueFromContractWithCustomerExcludingAssessedTax"
    made = [(7, sales, "10-K", "FY", "2016-01-01", "2016-12-31", 100, "2017-02-01"), (7, sales, "10-K", "FY", "2016-01-01", "2016-12-31", 105, "2018-02-01"), (7, sales, "10-K", "FY", "2016-10-01", "2016-12-31", 30, "2017-02-01"), (7, sales, "10-Q", "FY", "2015-01-01", "2015-12-31", 90, "2016-02-01"), (7, contract, "10-K", "FY", "2018-01-01", "2018-12-31", 120, "2019-02-01"), (7, "Other", "10-K", "FY", "2014-01-01", "2014-12-31", 1, "2015-02-01"), (8, sales, "10-K", "FY", "2016-01-01", "2016-12-31", 100, "2017-02-01"), (8, contract, "10-K", "FY", "2016-01-01", "2016-12-31", 999, "2016-02-01")]
    df = spark.createDataFrame([(*r, "a") for r in made], "cik long, concept string, form string, fp string, start string, end string, val long, filed string, accession string")
    assert rows(filings.revenue_series(df), "row_id", "revenue_usd") == [("rev_7_2016-12-31", 105), ("rev_7_2018-12-31", 120), ("rev_8_2016-12-31", 999)]


def test_risk_sections(spark):
    risk = "Our business faces many risks. " * 100
    texts = [f"Contents\nItem 1A. Risk Factors 12\nItem 1B. None 20\n\n ITEM 1A. RISK FACTORS\nWe depend.\n{risk}\nITEM 1B. UNRESOLVED\nNone.", "Item 1. Business\nwidgets", "Item 1A. Risk Factors\nIncorporated herein by reference to it.\nItem 1B. None", "Item 1A\nNot applicable.\nItem 2", "Item 1A - short\nItem 1C", None]
    got = col(spark, texts, filings.risk_section)
    assert got[0]["ok"] and got[0]["text"].startswith("We depend.") and "UNRESOLVED" not in got[0]["text"] and texts[0][got[0]["end"] :].startswith("ITEM 1B. U")
    assert got[1]["reason"].startswith("no Item 1A") and [g["reason"] for g in got[2:5]] == ["incorporated by reference", "not provided (smaller reporting company or not applicable)", "section is 5 chars"]
    assert got[5]["ok"] is False
