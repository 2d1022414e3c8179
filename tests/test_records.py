"""Records, titles, dates, places and playbooks on written cases."""

from pyspark.sql import functions as F

from docforge.functions import extract, records


def col(spark, values, make, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(make(F.col("v"))).collect()]


def test_titles(spark):
    got = col(spark, ["LOHACOMPANYLTD_20191209_F-1_EX-10.16_11917878_EX-10.16_SUPPLY AGREEMENT", "LIMEENERGYCO_09_09_1999-EX-10-DISTRIBUTOR AGREEMENT", " MetLife, Inc. - Remarketing Agreement ", "odd", "A_20191350_F-1_EX-1_2_EX-1_x"], extract.parse_title)
    assert tuple(got[0]) == ("LOHACOMPANYLTD", "2019-12-09", "F-1", "EX-10.16", "SUPPLY AGREEMENT", "long")
    assert tuple(got[1]) == ("LIMEENERGYCO", "1999-09-09", None, "EX-10", "DISTRIBUTOR AGREEMENT", "short")
    assert tuple(got[2]) == ("MetLife, Inc.", None, None, None, "Remarketing Agreement", "named") and got[3]["title_type"] == "odd" and got[4]["filing_date"] is None


def test_dates(spark):
    cases = {"7th day of September, 1999.": ["1999-09-07"], "January 24, 2014": ["2014-01-24"], "October 1,1996": ["1996-10-01"], "1s t day of March, 2018": ["2018-03-01"], "12/31/2019": ["2019-12-31"], "this  day of , 2012": [], "February ____, 2017": [], "9/9/97": [], "[●]": [], "Feb. 30, 2017": [], "2018-01-02 and March 1, 2017 and 2018-01-02": ["2017-03-01", "2018-01-02"]}
    assert dict(zip(cases, col(spark, list(cases), extract.dates_in), strict=True)) == cases


def test_durations_and_types(spark):
    cases = {"renew for successive one-year terms": ["1 year"], "at least ninety (90) days prior": ["90 days"], "five (5) year initial, one (1) year": ["5 years", "1 year"], "one hundred twenty (120) calendar days": ["120 days"], "forty-five days": ["45 days"]}
    assert dict(zip(cases, col(spark, list(cases), extract.durations_in), strict=True)) == cases
    got = col(spark, ["SOFTWARE LICENSE AND MAINTENANCE AGREEMENT", "Manufacturing and Supply Agreement", "JOINT FILING AGREEMENT"], extract.contract_types)
    assert [g[0] for g in got] == ["maintenance", "supply", "joint_filing"] and got[2] == ["joint_filing"]


def test_places(spark):
    cases = {"governed by the laws of the State of New York, without regard": "New York", "THE LAWS OF THE STATE OF DELAWARE": "Delaware", "This Agreement is governed by English law": "England", "governed by the laws of the People's Republic of China": "China", "in accordance with Ohio law.": "Ohio", "the laws and judicial decisions of the State of Florida": "Florida", "the laws of [***]": None}
    assert dict(zip(cases, col(spark, list(cases), extract.jurisdiction_in), strict=True)) == cases


def test_records(spark):
    text = "AGREEMENT made January 5, 2010 between Acme Widgets, Inc. and Beta LLC. Governed by the laws of Texas.\nSource: ACME WIDGETS INC, 8-K, 1/6/2010\nSource: ACME WIDGETS INC, 8-K, 1/6/2010"
    at = text.index
    qas = [("x__Agreement Date", "q", [("January 5, 2010", at("January"))]), ("x__Parties", "q", [("Acme Widgets, Inc.", at("Acme")), ("Beta LLC", at("Beta"))]), ("x__Governing Law", "q", [("Governed by the laws of Texas.", at("Governed"))]), ("x__Cap On Liability", "q", [("not in the text", 3)])]
    kind = "title string, context string, qas array<struct<id string, question string, answers array<struct<text string, answer_start int>>>>"
    release = spark.createDataFrame([("ACME_01_07_2010-EX-10.1-SUPPLY AGREEMENT", text, qas), ("plain", "", [])], kind)
    made = records.check_unique(records.build_records(release))
    r = {x["title"]: x for x in made.collect()}["ACME_01_07_2010-EX-10.1-SUPPLY AGREEMENT"]
    assert (r["contract_type"], r["filing_date"], r["filer"], r["form"], r["filer_from"], r["title_filer"]) == ("supply", "2010-01-06", "ACME WIDGETS INC", "8-K", "source_footer", "ACME")
    assert r["agreement_date"]["value"] == "2010-01-05" and r["governing_law"]["value"] == "Texas" and r["renewal_term"]["status"] == "absent"
    assert r["parties"]["value"] == ["Acme Widgets, Inc.", "Beta LLC"] and [s["start"] for s in r["spans"]] == sorted(s["start"] for s in r["spans"])
    assert [u["category"] for u in r["unmapped"]] == ["Cap On Liability"]
    accounts = spark.createDataFrame([(r["contract_id"], 7, "Acme")], "contract_id string, cik long, matched_name string")
    docs = {d["doc_id"]: d for d in records.contract_docs(made, accounts).collect()}
    assert docs[r["contract_id"]]["metadata"]["agreement_year"] == 2010 and docs[r["contract_id"]]["metadata"]["account"] == "Acme" and len(docs) == 2
    risk = records.risk_docs(spark.createDataFrame([(7, "0001-10-2", "2010-03-01", "10-K", "Acme", "t")], "cik long, accession string, filing_date string, form string, account string, text string")).first()
    assert risk["doc_id"] == "rf_7_0001102" and risk["metadata"]["filing_year"] == 2010


def book(categories=10, empty=(), misplaced=()):
    out = ["# Playbook\n"]
    for c in range(1, categories + 1):
        out.append(f"## {c}. Category {c}\n")
        for p in records.POSITIONS:
            out.append(f"{'##' if (c, p) in misplaced else '###'} **{p}:**\n" + ("" if (c, p) in empty else "some text\n"))
    return "\n".join(out) + "\n## Optional: filing-data rules\n### Preferred position\nx\n"


def test_playbooks(spark):
    books = [(0, book()), (1, book(empty=[(2, "Escalate if")])), (2, book(9)), (3, book(misplaced=[(3, "Escalate if")])), (4, "")]
    df = spark.createDataFrame(books, "doc_id int, text string")
    got = {r["doc_id"]: r for r in records.playbook_status(df).collect()}
    assert (got[0]["filled"], got[0]["complete"], got[0]["problems"]) == (30, True, [])
    assert (got[1]["filled"], got[1]["complete"], got[1]["empty"]) == (29, False, ["Category 2 / Escalate if"])
    assert got[2]["problems"] == ["9 category headings, expected 10"] and got[4]["filled"] == 0
    assert got[3]["filled"] == 30 and got[3]["problems"] == ["'## **Escalate if:**' under Category 3 should be '### Escalate if'"] and not got[3]["complete"]
    assert [r["doc_id"] for r in records.playbook_docs(df).collect()] == [0]
    assert col(spark, ["1. Cap On Liability", "**Preferred position:**"], records.heading_name) == ["Cap On Liability", "Preferred position"]
