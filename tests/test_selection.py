"""Tiers and gathered documents: last entries, nulls, empty tables, repeated rows, clashing names."""

from docforge.operators import selection


def test_the_last_account_decides_the_tier(spark):
    contracts = spark.createDataFrame([("a", "own"), ("b", "own"), ("c", "own"), ("d", "own"), (None, "own"), ("a", "own")], "contract_id string, _paid string")
    accounts = spark.createDataFrame([("a", 1, 0), ("b", 1, 0), ("b", None, 1), ("c", 7, 0), ("c", 2, 1), ("d", 0, 0), (None, 1, 0)], "contract_id string, cik long, at int")
    revenue = spark.createDataFrame([(1,), (1,), (None,), (7,)], "cik long")
    got = selection.tiers(contracts, accounts, revenue)
    assert got.columns == ["contract_id", "_paid", "tier"]
    assert sorted((str(r[0]), r[1], r[2]) for r in got.collect()) == [("None", "own", 2), ("a", "own", 0), ("a", "own", 0), ("b", "own", 2), ("c", "own", 1), ("d", "own", 2)]
    assert {r["tier"] for r in selection.tiers(contracts, accounts.where("false"), revenue.where("false")).collect()} == {2}
    assert selection.tiers(contracts.where("false"), accounts, revenue).collect() == []


def test_a_category_in_any_case(spark):
    spans = spark.createDataFrame([("Governing Law", 1), ("GOVERNING LAW", 2), ("Law", 3), (None, 4)], "category string, start int")
    assert sorted(r["start"] for r in selection.in_category(spans, "governing law").collect()) == [1, 2]
