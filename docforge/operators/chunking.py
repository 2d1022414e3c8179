"""Token windows and sections as code-point ranges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from docforge.functions.text import SPACE, deal, n_tokens, parts, token_bounds, token_lengths

#: Fixed values of the chunkers.
SIZE, OVERLAP, LEAST, HEADINGS = 400, 80, 80, 3


def windows_of(df: DataFrame, sizes: dict[str, tuple[int, int]], key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), outer: bool = False) -> DataFrame:
    """(key, *keep, chunker, win, start, end, tokens): windows of each chunker's (size, overlap), one each ``size - overlap``.

    Texts become tokens once for all chunkers; windows are cut from the running
    sums of a text's own row, so neither tokens nor windows are sorted.  With
    ``outer`` a text without tokens gives one row of nulls.
    """

    @F.pandas_udf("chunker array<string>, win array<long>, start array<long>, end array<long>, tokens array<long>")
    def cut(lengths: pd.Series) -> pd.DataFrame:
        def one(x) -> tuple:
            if x is None or not len(x):
                return (None,) * 5
            (starts, ends), n, out = token_bounds(x), len(x), []
            for name, (size, overlap) in sizes.items():
                win = np.arange(1 if n <= size else 1 + -(-(n - size) // (size - overlap)))
                at = win * (size - overlap)
                to = np.minimum(at + size, n)
                out.append(([name] * len(win), win, starts[at], ends[to - 1], to - at))
            return tuple(np.concatenate(c) for c in zip(*out, strict=True))

        return pd.DataFrame([one(x) for x in lengths], columns=["chunker", "win", "start", "end", "tokens"], dtype=object)

    held = df.select(key, *keep, text).repartition(key).select(key, *keep, cut(token_lengths(F.col(text))).alias("w"))
    return held.select(key, *keep, (F.explode_outer if outer else F.explode)(F.arrays_zip("w.chunker", "w.win", "w.start", "w.end", "w.tokens")).alias("w")).select(key, *keep, "w.*")


def fixed_windows(df: DataFrame, size: int = SIZE, overlap: int = OVERLAP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, win, start, end, tokens): windows of ``size`` tokens, one each ``size - overlap``."""
    return windows_of(df, {"": (size, overlap)}, key, text).drop("chunker")


#: Line starts that open a section, by kind of document.
CONTRACT = (
    r"^[ \t]*(?:(?:ARTICLE|Article)\s+[IVXLC\d]+\b|(?:SECTION|Section)\s+\d+(?:\.\d+)*\b"
    r"|\d{1,2}(?:\.\d{1,2}){0,2}\.?[ \t]+[A-Z(\"“]|[A-Z][A-Z0-9&,'\- ]{3,60}(?:[.:]|\n?\z))"
)
PLAYBOOK = "^## "


def lines(df: DataFrame, key: str = "doc_id", n: int | None = None) -> DataFrame:
    """(key, doc_type, pos, start, line, own, lead, tokens) of every line; ``own`` is the line without blanks around it.

    Texts are dealt by key first, so no line is shuffled.
    """
    cut = deal(df.select(key, "doc_type", "text"), key, n=n).select(key, "doc_type", F.posexplode_outer(F.split("text", r"(?<=\n)", -1)).alias("pos", "line")).where("line <> ''")
    own = F.regexp_replace("line", rf"^{SPACE}+|{SPACE}+\z", "")
    own_length = F.char_length("line").cast("long")
    before = F.sum(own_length).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - own_length
    lead = F.char_length("line") - F.char_length(F.regexp_replace("line", rf"^{SPACE}+", ""))
    return cut.select(key, "doc_type", "pos", before.alias("start"), "line", own.alias("own"), lead.cast("long").alias("lead"), n_tokens(F.col("line")).alias("tokens"))


def _opens(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``opens`` (a heading of the document's kind) and ``breaks`` (a paragraph)."""
    by = Window.partitionBy(key).orderBy("pos")
    blank = F.col("own") == ""
    later = F.first(F.when(~blank, F.char_length("own")), True).over(by.rowsBetween(1, Window.unboundedFollowing))
    group = (F.upper("own") == F.col("own")) & (F.lower("own") != F.col("own")) & F.col("tokens").between(2, 15)
    sentence = F.col("own").rlike(r"^\p{Lu}") & F.col("tokens").between(6, 80) & (F.coalesce(later, F.lit(0)) > F.char_length("own"))
    risk = F.when(F.col("doc_type") == "risk_factors", ~blank & (group | sentence))
    opens = F.coalesce(risk, F.when(F.col("doc_type") == "playbook", F.col("line").rlike(PLAYBOOK)), F.col("line").rlike(CONTRACT))
    after_blank = F.lag(F.regexp_replace("line", r"[ \t]*\n$", "") == "").over(by) & (F.col("pos") > 0)
    return rows.withColumn("opens", opens).withColumn("breaks", F.coalesce(after_blank & ~blank, F.lit(False)))


@F.pandas_udf(ArrayType(IntegerType()))
def _gathered(tokens: pd.Series) -> pd.Series:
    """The group of each section: groups close at ``LEAST`` tokens, a short rest joins the one before."""

    def one(sizes) -> list[int]:
        out, group, held = [], 0, 0
        for n in sizes:
            out.append(group)
            held += n
            if held >= LEAST:
                group, held = group + 1, 0
        if held and group and out[-1] == group:
            out = [min(g, group - 1) for g in out]
        return out

    return tokens.map(one)


def sections(df: DataFrame, key: str = "doc_id", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, boundary, start, end, tokens) of the sections of ``df`` (key, doc_type, text), without blanks around them.

    Sections open at headings; a document with fewer than ``HEADINGS`` openings
    (for contracts its start is one) falls back to paragraphs.  Short sections
    join the next, long ones become windows; a playbook's stay as they are.
    """
    dealt = parts(df)
    rows = _opens(lines(df, key, dealt), key)
    whole, by = Window.partitionBy(key), Window.partitionBy(key).orderBy("pos")
    contract = ~F.col("doc_type").isin("risk_factors", "playbook")
    n = F.count_if(F.col("opens") & ~(contract & (F.col("start") == 0))).over(whole) + F.when(contract, 1).otherwise(0)
    few = (n < HEADINGS) & (F.col("doc_type") != "playbook")
    kind = F.when(few, "paragraph").when(F.col("doc_type") == "playbook", "playbook_heading").when(contract, "contract_heading").otherwise("risk_heading")
    rows = rows.withColumn("boundary", kind).withColumn("opens", F.when(few, F.col("breaks")).otherwise(F.col("opens")))
    rows = rows.where("own <> ''").withColumn("part", F.sum(F.col("opens").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    lo, hi = F.min(F.col("start") + F.col("lead")).alias("start"), F.max(F.col("start") + F.col("lead") + F.char_length("own")).alias("end")
    pieces = rows.groupBy(key, "boundary", "part").agg(lo, hi, F.sum("tokens").alias("tokens"))
    held = pieces.groupBy(key, "boundary").agg(F.array_sort(F.collect_list(F.struct("start", "end", "tokens"))).alias("p"))
    loose = F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda i: i)
    grouped = held.withColumn("g", F.when(F.col("boundary") == "playbook_heading", loose).otherwise(_gathered(F.col("p.tokens"))))
    each = grouped.select(key, "boundary", F.explode(F.arrays_zip("p", "g")).alias("z")).select(key, "boundary", "z.p.*", "z.g")
    merged = each.groupBy(key, "boundary", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("tokens").alias("tokens"))
    long = (F.col("tokens") > size) & (F.col("boundary") != "playbook_heading")
    # every section meets its document, dealt alike, and a long one takes its text: lines are made once for both kinds
    met = merged.join(deal(df.select(key, "text"), key, n=dealt), key, "left")
    text = F.when(long, F.expr("substring(text, cast(start + 1 as int), cast(end - start as int))"))
    whole = met.select(key, "boundary", F.struct("start", "end", "tokens").alias("own"), text.alias("text"))
    wins = windows_of(whole, {"": (size, overlap)}, key, keep=("boundary", "own"), outer=True)
    at = lambda name: F.coalesce(F.col("own.start") + F.col(name), F.col(f"own.{name}")).alias(name)
    return wins.select(key, "boundary", at("start"), at("end"), F.coalesce("tokens", "own.tokens").alias("tokens"))


def chunk_rows(df: DataFrame, chunker: str = "fixed", key: str = "doc_id") -> DataFrame:
    """Chunks with dense four-digit ids; an unknown chunker raises.  Without a doc_type all are contracts."""
    if chunker not in ("fixed", "section"):
        raise ValueError(f"unknown chunker {chunker!r}")
    if chunker == "fixed":
        ranges = fixed_windows(df, key=key).withColumn("boundary", F.lit("window"))
    else:
        ranges = sections(df if "doc_type" in df.columns else df.withColumn("doc_type", F.lit("contract")), key)
    joined = ranges.join(df.select(key, "text"), key).withColumn("text", F.expr("substring(text, cast(start + 1 as int), cast(end - start as int))"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("start")) - 1
    return joined.where(F.trim("text") != "").withColumn("chunk_id", F.format_string("%s:%s:%04d", F.col(key).cast("string"), F.lit(chunker), number))
