"""Keys of company names, and which spans name a company."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docforge.functions.text import name_key

#: What a squashed name loses at its end (the first that fits, once), and what marks a company.
ENDINGS = ("incorporated", "corporation", "company", "holdings", "limited", "inc", "corp", "llc", "ltd", "plc", "lp", "llp", "co", "sa", "ag", "nv", "bv", "gmbh")
MARK = (
    r"\b(?:(?i:inc|incorporated|corp|corporation|company|llc|l\.l\.c|ltd|limited|llp|plc|gmbh|holdings|trust|bank|university)\b\.?"
    r"|(?:AG|AB|AS|SA|S\.A|NV|N\.V|BV|B\.V|LP|L\.P|Co|CO|PLC)\b)"
)
LEAST_KEY, LONGEST_PARTY, CAPITALS = 4, 120, 3


def compact_key(name: Column) -> Column:
    """Letters and digits only, without "the" before and one company ending behind."""
    bare = F.regexp_replace(F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("&"), F.lit("and")), "[^a-z0-9]", "")
    # of endings that end in one another the shorter goes, which is the one listed first
    return F.regexp_replace(F.regexp_replace(bare, "^the(?=.{4})", ""), rf"^(.{{{LEAST_KEY},}})(?:{'|'.join(ENDINGS)})$", "$1")


def contract_id(title: Column) -> Column:
    """Ten digits of the hash of a title without the blanks around it."""
    return F.concat(F.lit("c_"), F.substring(F.sha1(F.regexp_replace(title, r"^\s+|\s+\z", "")), 1, 10))


def entity_parties(spans: Column) -> Column:
    """The spans that name a company: with a mark, or of three capitalised words; one of each name key."""
    clean = F.transform(spans, lambda s: F.regexp_replace(F.regexp_replace(s, r"\s+", " "), "^[ \"“”,;]+|[ \"“”,;]+$", ""))
    words = lambda s: F.size(F.regexp_extract_all(s, F.lit(r"(?<![A-Za-z][\p{L}\p{N}_&.'-]{0,60})[A-Z][\p{L}\p{N}_&.'-]*"), F.lit(0)))
    named = F.filter(clean, lambda s: F.length(s).between(1, LONGEST_PARTY) & (s.rlike(MARK) | (words(s) >= CAPITALS)))
    keyed = F.filter(F.transform(named, lambda s: F.struct(name_key(s).alias("k"), s.alias("s"))), lambda x: x["k"] != "")
    keys = F.transform(keyed, lambda x: x["k"])
    return F.transform(F.filter(keyed, lambda x, i: F.array_position(keys, x["k"]) == i + 1), lambda x: x["s"])
