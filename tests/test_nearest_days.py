"""The nearest report is found among a company's days, not among pairs of contracts and reports."""

import datetime as dt
import random

from docforge.operators import filings


def test_nearest_reports_as_all_pairs_and_without_pairing(spark):
    rng, first = random.Random(4), dt.date(2004, 1, 1)
    day = lambda: (first + dt.timedelta(rng.randrange(900))).isoformat()
    reports = [(rng.randrange(4), day(), day() if rng.random() < 0.5 else None, rng.choice(["10-K", "10-K405", "8-K"]), f"a{rng.randrange(90)}") for _ in range(300)]
    reports += [(7, "2004-02-03", None, "10-K", "old"), (8, None, None, "10-K", "x")]
    asked = [(i, rng.choice([0, 1, 2, 3, 3, 7, 8, 9, None]), day() if rng.random() < 0.9 else None) for i in range(200)]
    own = spark.createDataFrame(reports, "cik int, filing_date string, report_date string, form string, accession string")
    made = filings.nearest_annual(spark.createDataFrame(asked, "contract_id int, cik int, when string"), own)
    want = {}
    for i, cik, when in asked:
        near = []
        for c, filed, report, form, accession in reports:
            if c == cik and when and form != "8-K" and filed and (report or filed) >= filings.RISK_FROM:
                gap = (dt.date.fromisoformat(filed) - dt.date.fromisoformat(when)).days
                near.append((abs(gap), -dt.date.fromisoformat(filed).toordinal(), accession, filed, gap))
        want[i] = min(near)[2:] if near else (None, None, None)
    got = made.collect()
    assert {r["contract_id"]: (r["accession"], r["filing_date"], r["gap_days"]) for r in got} == want
    assert {r["reason"] for r in got if r["contract_id"] in [i for i, c, w in asked if c in (8, 9, None) and w]} == {"no 10-K on file"}
    # before, contracts met all reports of their company by that key alone
    joins = [line for line in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and all("day" in line for line in joins)
