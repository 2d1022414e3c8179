"""Contracts chosen by tiers, and the documents that an index takes with them.

Lookups keep one row a key, the one written last, so no join multiplies rows.
A contract or entry whose key is hot lies on the side that adaptive execution
may split; the looked-up side has each key once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.functions import records


def last_written(rows: DataFrame, by: str, at: str) -> DataFrame:
    """Of each ``by`` that is not null the row with the greatest ``at``; combined before the shuffle."""
    rest = [c for c in rows.columns if c != by]
    last = F.max_by(F.struct(*(F.col(f"`{c}`") for c in rest)), at).alias("_last")
    return rows.where(F.col(by).isNotNull()).groupBy(by).agg(last).select(by, "_last.*")


def tiers(contracts: DataFrame, accounts: DataFrame, revenue: DataFrame, at: str = "at") -> DataFrame:
    """``contracts`` with ``tier``: 0 with an account and revenue, 1 with an account alone, 2 with none.

    ``accounts`` (contract_id, cik, ``at``): the last entry of a contract holds,
    even where it has no cik; no cik or 0 is no account.  ``revenue`` (cik).
    """
    own = last_written(accounts, "contract_id", at).select("contract_id", F.nullif("cik", F.lit(0)).alias("cik"))
    paid = revenue.where("cik is not null").select("cik").distinct().withColumn("paid", F.lit(True))
    rows = contracts.select("contract_id", F.struct(*(F.col(f"`{c}`") for c in contracts.columns)).alias("row"))
    tier = F.when(F.col("cik").isNull(), 2).when(F.col("paid"), 0).otherwise(1)
    return rows.join(own, "contract_id", "left").join(paid, "cik", "left").select(*(F.col(f"row.`{c}`") for c in contracts.columns), tier.alias("tier"))


def in_category(spans: DataFrame, category: str) -> DataFrame:
    """Spans of a category in any case; a null category is none."""
    return spans.where(F.lower("category") == F.lower(F.lit(category)))


def gather(chosen: DataFrame, accounts: DataFrame, entries: DataFrame, playbooks: DataFrame, at: str = "at") -> DataFrame:
    """(doc_id, doc_type, text, account, cik, metadata): contracts, their companies' risk sections, complete playbooks.

    ``chosen`` are contract records, ``accounts`` (contract_id, cik,
    matched_name, ``at``), ``entries`` risk sections (cik, accession,
    filing_date, form, text), ``playbooks`` (doc_id, text).  An entry stays if
    its cik is that of a chosen contract; its account is the name written last
    under the cik, of any contract.  ``metadata`` is JSON, as each type has
    fields of its own.  Empty inputs give the documents of the others.
    """
    held = last_written(accounts, "contract_id", at).withColumn("cik", F.nullif("cik", F.lit(0)))
    contracts = records.contract_docs(chosen, held.select("contract_id", "matched_name", "cik"))
    ciks = held.join(chosen.select("contract_id"), "contract_id", "left_semi").where("cik is not null").select("cik").distinct()
    names = last_written(held.where("cik is not null"), "cik", at).select("cik", F.col("matched_name").alias("account"))
    risks = records.risk_docs(entries.join(ciks, "cik", "left_semi").join(names, "cik", "left"))
    as_rows = lambda docs: docs.select("doc_id", "doc_type", "text", F.col("metadata.account").alias("account"), F.col("metadata.cik").alias("cik"), F.to_json("metadata").alias("metadata"))
    plain = records.playbook_docs(playbooks).withColumns({"account": F.lit(None).cast("string"), "cik": F.lit(None).cast("long"), "metadata": F.lit("{}")})
    return as_rows(contracts).unionByName(as_rows(risks)).unionByName(plain)
