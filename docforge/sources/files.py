"""Readers and sinks: labelled releases, line files, JSON lines, versioned tables."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RELEASE = "data array<struct<title string, paragraphs array<struct<context string, qas array<struct<id string, question string, answers array<struct<text string, answer_start int>>>>>>>>"


def read_release(spark: SparkSession, path: str) -> DataFrame:
    """(title, context, qas) of a labelled release in one JSON file."""
    one = spark.read.schema(RELEASE.replace("data ", "data: ", 1)).option("multiLine", True).json(path)
    return one.select(F.explode("data").alias("d")).select("d.title", F.col("d.paragraphs")[0]["context"].alias("context"), F.col("d.paragraphs")[0]["qas"].alias("qas"))


def release_spans(release: DataFrame) -> DataFrame:
    """(title, category, start, end, mapped): answers whose text stands at its offset are mapped."""
    qa = release.select("title", "context", F.explode("qas").alias("qa"))
    an = qa.select("title", "context", F.element_at(F.split("qa.id", "__", 2), -1).alias("category"), F.explode("qa.answers").alias("a"))
    end = F.col("a.answer_start") + F.char_length("a.text")
    at = F.expr("substring(context, a.answer_start + 1, char_length(a.text))")
    return an.select("title", "category", F.col("a.answer_start").alias("start"), end.alias("end"), (at == F.col("a.text")).alias("mapped"))


def read_cik_lines(spark: SparkSession, path: str) -> DataFrame:
    """(name, cik) of latin-1 ``NAME:0123456789:`` lines; others are dropped."""
    lines = spark.read.format("binaryFile").load(path).select(F.explode(F.split(F.decode("content", "ISO-8859-1"), "\r?\n")).alias("line"))
    shape = r"^(.*):(\d{10}):$"
    return lines.where(F.col("line").rlike(shape)).select(F.regexp_extract("line", shape, 1).alias("name"), F.regexp_extract("line", shape, 2).cast("long").alias("cik"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the lines that are no JSON objects; a torn last line is one of these."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    ok = F.get_json_object("value", "$").isNotNull() & F.trim("value").startswith("{")
    return raw.where(ok).select(F.from_json("value", schema).alias("r")).select("r.*"), raw.where(~ok)


def zip_filings(blocks: DataFrame, fields: list[str]) -> DataFrame:
    """Column-oriented arrays to rows; a missing array gives nulls."""
    have = [f for f in fields if f in blocks.columns]
    rows = blocks.select("cik", F.explode(F.arrays_zip(*have)).alias("r"))
    return rows.select("cik", *(F.col(f"r.{f}") if f in have else F.lit(None).cast("string").alias(f) for f in fields))


class VersionedTable:
    """Snapshots in folders of their own, and a log whose last entry names the one that counts.

    An entry is appended when its snapshot is whole, so a writer that stops
    anywhere leaves the table as it was.  The last two snapshots are kept: a
    reader of the one before can finish.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> list[dict]:
        try:
            rows = self.spark.read.text(f"{self.path}/_log").collect()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        return sorted((json.loads(r[0]) for r in rows), key=lambda e: e["number"])

    def read(self) -> DataFrame | None:
        log = self._log()
        return self.spark.read.parquet(f"{self.path}/{log[-1]['version']}") if log else None

    def stamp(self) -> dict:
        log = self._log()
        return log[-1]["stamp"] if log else {}

    def write(self, df: DataFrame, stamp: dict) -> None:
        log, version = self._log(), uuid.uuid4().hex
        df.write.parquet(f"{self.path}/{version}")
        entry = {"number": log[-1]["number"] + 1 if log else 0, "version": version, "stamp": stamp}
        self.spark.createDataFrame([(json.dumps(entry),)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/_log")
        for old in log[:-1]:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{old['version']}")
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
