"""Text of a page as one chain of expressions over its markup."""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Tags that break a line where they open and where they close.
BLOCKS = ("p", "div", "br", "tr", "li", "h1", "h2", "h3", "h4", "h5", "h6", "table", "section")
#: References that are decoded in the JVM; a text with any other goes to ``unescape``.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&copy;": "©", "&middot;": "·", "&#39;": "'", "&amp;": "&"}
_OTHER = rf"&(?!(?:{'|'.join(e[1:-1] for e in ENTITIES)});)[#A-Za-z]"
#: A tag, with quoted attribute values that may hold its end.
_REST = r"(?=[\s/>])(?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+>"


@F.pandas_udf(StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    """All named and numeric references decoded; a null stays."""
    return text.map(unescape, na_action="ignore")


def html_to_text(html: Column, every: bool = True) -> Column:
    """The words of a page, a line break at each block's start and end.

    ``every`` decodes all references, also those of old names without a closing
    semicolon; else only ``ENTITIES`` as written there are decoded.

    A self-closing block breaks twice; scripts, styles, comments and
    declarations leave nothing; a page cut inside a script or a comment ends there.
    """
    out = F.regexp_replace(html, rf"(?is)<(script|style){_REST}.*?(?:</\1\s*>|\z)", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?(?:-->|\z)|<[!?][^>]*>", "")
    blocks = "|".join(BLOCKS)
    out = F.regexp_replace(out, rf"(?i)<(?:{blocks})(?:\s[^<>]*)?/>", "\n\n")
    out = F.regexp_replace(out, rf"(?i)</?(?:{blocks}){_REST}", "\n")
    out = F.regexp_replace(out, rf"</?[A-Za-z][^\s/>]*+{_REST}", "")
    # before any reference is decoded, so that none is decoded twice
    other = _unescaped(F.when(out.rlike(_OTHER), out)) if every else None
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return tidy(out if other is None else F.coalesce(other, out))


def tidy(text: Column) -> Column:
    """Blanks single, none around line breaks, at most one empty line, none at the ends."""
    out = F.regexp_replace(F.replace(text, F.lit("\xa0"), F.lit(" ")), r"[ \t\r\f\x0B]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, " *\n *", "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+\z", "")
