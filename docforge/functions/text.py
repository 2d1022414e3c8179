"""Tokens, phrases, numbers, names and JSON as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

#: The word class and the white space that regex engines agree on.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x0B\x1c-\x1f\x85\p{Z}]"
TOKEN = rf"(?s){SPACE}*({WORD}+|[^\p{{L}}\p{{N}}_\s\x0B\x1c-\x1f\x85\p{{Z}}])"
#: Words that a company name loses when it becomes a key.
SUFFIXES = ("incorporated", "corporation", "company", "limited", "holdings", "group", "inc", "corp", "llc", "ltd", "plc", "co", "lp", "sa", "ag", "nv", "llp", "gmbh", "bv", "ab", "as", "pty", "pte", "trust", "bank", "partners", "university")


def n_tokens(text: Column) -> Column:
    """Number of words and single marks."""
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).cast("long")


#: A task's share of the texts in bytes; what a task sorts or counts grows with this and not with the input.
SHARE_BYTES = 8 << 20


def parts(df: DataFrame, text: str = "text") -> int:
    """As many partitions as the texts of ``df`` fill, at least the session's number.

    A number of partitions that does not grow makes every partition grow with the
    input; the bytes of all texts are summed for it, which reads that column alone.
    """
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARE_BYTES))


def deal(df: DataFrame, *by: str, text: str = "text", n: int | None = None) -> DataFrame:
    """``df`` dealt by ``by`` into ``parts``, or into ``n`` that were counted before."""
    return df.repartition(n or parts(df, text), *by)


def token_lengths(text: Column) -> Column:
    """Of each token in order its length, and 2**32 times that of its tile (the gap before it and itself), as one number."""
    own = lambda t: F.char_length(F.regexp_replace(t, rf"^{SPACE}+", ""))
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.shiftleft(F.char_length(t).cast("long"), 32) + own(t))


def token_bounds(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of tokens from their ``token_lengths``."""
    ends = np.cumsum(lengths >> 32)
    return ends - (lengths & 0xFFFFFFFF), ends


@F.pandas_udf(StructType([StructField("start", ArrayType(LongType())), StructField("end", ArrayType(LongType()))]))
def _bounds(lengths: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([token_bounds(x) if x is not None else (None, None) for x in lengths], columns=["start", "end"], dtype=object)


def token_offsets(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, start, end): code-point ranges of tokens; tiles of gap and token rejoin to the text.

    A text's lengths are summed up in its own row, so no token is sorted or
    shuffled, and a task holds a batch of texts at a time.
    """
    held = df.select(key, text).repartition(key).select(key, _bounds(token_lengths(F.col(text))).alias("b"))
    rows = held.select(key, F.posexplode(F.arrays_zip("b.start", "b.end")).alias("pos", "at"))
    return rows.select(key, F.col("pos").cast("long").alias("pos"), "at.start", "at.end")


def bm25_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def normalise(text: Column) -> Column:
    """White space collapsed and trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def fold(text: Column) -> Column:
    """Letters that regex engines take for equal whatever their case become equal."""
    # translate walks over every letter, and few texts hold these two
    rare = F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u0131"))
    return F.lower(F.upper(F.when(rare, F.translate(text, "\u0130\u0131", "ii")).otherwise(text)))


def phrase_words(phrase: Column) -> Column:
    return F.filter(F.split(phrase, f"{SPACE}+"), lambda w: w != "")


def phrase_pattern(phrase: Column) -> Column:
    """The words of a phrase in any case with any run of white space between them; null without words."""
    words = F.transform(phrase_words(phrase), lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return F.when(F.size(words) > 0, F.concat(F.lit("(?iu)"), F.array_join(words, f"{SPACE}+")))


def phrase_steps(text: Column, pattern: Column) -> Column:
    """(gap, own) of every non-overlapping match in order: code points before it since the last one, and its own."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    return F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.char_length(g).cast("long").alias("gap"), F.char_length(m).cast("long").alias("own")))


def keyword_in_context(text: Column, start: Column, length: Column, around: int = 60) -> Column:
    low = F.greatest(start - around, F.lit(0))
    return F.substring(text, low + 1, (start - low + length + around).cast("int"))


def name_key(name: Column) -> Column:
    """A company name in lower case without marks, articles and suffix words."""
    low = F.replace(F.lower(F.regexp_replace(name, "[\"'“”‘’()]", " ")), F.lit("&"), F.lit(" and "))
    drop = F.array(*(F.lit(w) for w in (*SUFFIXES, "the", "a")))
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(low, "[.,]", " "), r"\s+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~F.array_contains(drop, w) & (w != "")), " ")


def numbers_in(text: Column) -> Column:
    """Distinct canonical numbers of a text, those of dates left out; a null text has none."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}(?:/\d{2,4})?\b", " ")
    found = F.regexp_extract_all(bare, F.lit(r"(?<![\p{L}\p{N}_.])[-+]?\d[\d,]*(?:\.\d+)?(?![\p{L}\p{N}_]|\.\d)"), F.lit(0))
    return F.array_distinct(F.transform(found, canonical_number))


def canonical_number(x: Column) -> Column:
    """Without thousands marks, plus sign, leading zeros and closing zeros."""
    plain = F.regexp_replace(F.regexp_replace(x, ",", ""), r"^\+", "")
    short = F.regexp_replace(F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain), r"^(-?)0+(?=\d)", "$1")
    return F.when(short == "-0", "0").otherwise(short)


def recover_json(raw: Column, stop_reason: Column) -> tuple[Column, Column]:
    """(recovered JSON text, path): native, recovered from a fence or the outer braces, or failed."""
    ok = lambda c: F.get_json_object(c, "$").isNotNull() & F.trim(c).startswith("{")
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    brace = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    body = F.when(ok(raw), raw).when(ok(fenced), F.trim(fenced)).when(ok(brace), brace)
    path = F.when(ok(raw), "native").when(ok(fenced) | ok(brace), "recovered").when(stop_reason == "max_tokens", "failed: cut off").otherwise("failed: not JSON")
    return body, path


def hash_token(token: Column) -> Column:
    """Polynomial hash of a token's code points, base 31 modulo 2**32."""
    return F.aggregate(F.split(token, ""), F.lit(0).cast("long"), lambda a, c: (a * 31 + F.ascii(c)).bitwiseAND(F.lit(4294967295)))
