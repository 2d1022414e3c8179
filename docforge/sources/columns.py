"""JSON that is laid out by column or by key: filings with their older pages, ticker maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The columns of a filings block.
FIELDS = ("accessionNumber", "filingDate", "reportDate", "form", "primaryDocument")
_BLOCK = "struct<" + ",".join(f"{f}:array<string>" for f in FIELDS) + ">"
_SUBMISSION = f"filings struct<recent:{_BLOCK},files:array<struct<name:string>>>"


def map_rows(raw: DataFrame, fields: str, json: str = "json") -> DataFrame:
    """A row for each object of a JSON map, whatever its keys; text that is no map gives none."""
    return raw.select(F.explode(F.map_values(F.from_json(json, f"map<string,struct<{fields}>>"))).alias("r")).where("r IS NOT NULL").select("r.*")


def _rows(block: Column) -> Column:
    """Rows of a block of columns: as many as it has accession numbers; a column that is missing or ends early gives nulls."""
    n = F.size(F.coalesce(block["accessionNumber"], F.array().cast("array<string>")))
    row = lambda i: F.struct(*(F.get(block[f], i).alias(f) for f in FIELDS))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), row))


def filings_of(submissions: DataFrame, pages: DataFrame) -> DataFrame:
    """(cik, at, accession, filing_date, report_date, form, document) of every filing, recent and older.

    ``submissions`` (cik, json), ``pages`` (name, json): a submission names the
    pages that continue it; a page that is not there is passed over, one that is
    named by several belongs to each.  ``at`` numbers a company's filings from 0 by
    date, then accession number, missing ones first.  Blocks are joined to their
    company by page name, so neither side has to be small.
    """
    got = submissions.select("cik", F.from_json("json", _SUBMISSION).alias("s"))
    recent = got.select("cik", F.explode(_rows(F.col("s.filings.recent"))).alias("r"))
    named = got.select("cik", F.explode("s.filings.files.name").alias("name"))
    older = named.join(pages.select("name", F.from_json("json", _BLOCK).alias("b")), "name").select("cik", F.explode(_rows(F.col("b"))).alias("r"))
    rows = recent.unionByName(older)
    order = Window.partitionBy("cik").orderBy(F.coalesce("r.filingDate", F.lit("")), F.coalesce("r.accessionNumber", F.lit("")), "r")
    names = dict(zip(FIELDS, ("accession", "filing_date", "report_date", "form", "document"), strict=True))
    return rows.select("cik", (F.row_number().over(order) - 1).alias("at"), *(F.col(f"r.{f}").alias(n) for f, n in names.items()))
