"""What an answer may say: evidence, checks of its citations and numbers, tables, and the route from question to answer."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.functions.text import numbers_in
from docforge.operators.reports import first_of_each
from docforge.operators.retrieve import search
from docforge.plans import resolver

#: What is shown at most, and what is said where nothing is found.
SHOWN, LISTED = 30, 100
NOTHING = {"filter": "No logged day matches those conditions.", "semantic": "Nothing in the log matches that question.", "unanswerable": "The log does not track that, so there is nothing to answer from."}


def _told(parts: Column, before: str, after: str) -> Column:
    return F.transform(parts, lambda x: F.concat(F.lit(before), x, F.lit(after)))


def violations(answer: Column, cited: Column, claims: Column, retrieved: Column, question: Column, allowed: Column, route: Column, unanswerable: Column) -> Column:
    """Ordered problems of an answer; none: it stands.

    Every cited date was retrieved; every claim has dates (but for admissions and
    tables), all retrieved and cited; every number stands in the question or in
    an ``allowed`` text.  ``claims`` is an array of struct(text, dates).
    """
    none = F.array().cast("array<string>")
    cited, retrieved, claims = F.coalesce(cited, none), F.coalesce(retrieved, none), F.coalesce(claims, F.array().cast("array<struct<text:string,dates:array<string>>>"))
    stray = _told(F.filter(cited, lambda d: ~F.array_contains(retrieved, d)), "cited date ", " was not among the retrieved days")

    def of_claim(c: Column, i: Column) -> Column:
        name = F.concat(F.lit("claim "), (i + 1).cast("string"))
        dates = F.coalesce(c["dates"], none)
        bare = F.when((F.size(dates) == 0) & ~unanswerable & (route != "aggregate"), F.array(F.concat(name, F.lit(" names no date: '"), F.substring(F.coalesce(c["text"], F.lit("")), 1, 60), F.lit("'")))).otherwise(none)
        wrong = F.transform(dates, lambda d: F.when(~F.array_contains(retrieved, d), F.concat(name, F.lit(" cites "), d, F.lit(", which was not retrieved"))).when(~F.array_contains(cited, d), F.concat(name, F.lit(" cites "), d, F.lit(", which is missing from cited_dates"))))
        return F.concat(bare, F.filter(wrong, lambda x: x.isNotNull()))

    known = F.array_union(numbers_in(question), F.flatten(F.transform(F.coalesce(allowed, none), lambda t: numbers_in(t))))
    loose = F.array_sort(F.array_except(numbers_in(answer), known))
    where = F.when(route == "aggregate", "the computed table").otherwise("any cited day")
    numbers = F.transform(loose, lambda n: F.concat(F.lit("the number "), n, F.lit(" in the answer does not appear in "), where))
    return F.concat(stray, F.flatten(F.transform(claims, of_claim)), numbers)


def evidence(rows: DataFrame, by: str, key: Column, text: Column, order: Column) -> DataFrame:
    """(by, evidence, n): the first texts of each group, and how many more there are; equal orders go by the text.

    Only the texts that are shown are gathered; the others are counted.
    """
    one = F.concat(F.lit("["), key.cast("string"), F.lit("]\n"), F.coalesce(text, F.lit("")))
    each = rows.select(by, F.struct(order.alias("o"), one.alias("t")).alias("e"))
    few = first_of_each(each, by, F.col("e"), SHOWN).groupBy(by).agg(F.array_sort(F.collect_list("e")).alias("a"))
    rule = "\n\n---\n\n"
    more = F.when(F.col("n") > SHOWN, F.concat(F.lit(f"{rule}("), (F.col("n") - SHOWN).cast("string"), F.lit(" more matching days not shown)"))).otherwise("")
    total = rows.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("n"))
    return few.join(total, F.col(by).eqNullSafe(F.col("_by"))).select(by, F.concat(F.array_join(F.col("a")["t"], rule), more).alias("evidence"), "n")


def shown(v: float | int | str | None) -> str:
    """n/a, a whole number, or one decimal."""
    if v is None:
        return "n/a"
    if isinstance(v, float):
        return str(round(v)) if abs(v - round(v)) <= 1e-9 else f"{v:.1f}"
    return str(v)


def render_table(groups: DataFrame, stat: str, metric: str | None) -> str:
    """The groups of an aggregate (name, n, value) as a table; they are few by their nature."""
    head = f"{stat} of {metric}" if metric else "count of days"
    rows = [f"| {r['name']} | {r['n']} | {shown(r['value'])} |" for r in groups.orderBy("name").collect()]
    return "\n".join([f"| group | days | {head} |", "| --- | --- | --- |", *rows])


def list_days(days: DataFrame, start: str, end: str, fields: list[str], date: str = "date") -> tuple[DataFrame, int, bool]:
    """The first days of a range, how many there are, and whether some are left out."""
    inside = days.where(F.col(date).between(start, end)).select(date, *fields)
    n = inside.count()
    return inside.orderBy(date).limit(LISTED), n, n > LISTED


def ask(question: str, decision: dict, days: DataFrame, fields: dict[str, str], today: dt.date, generate: Callable[[str, str], dict], top_k: int = 8, date: str = "date", text: str = "text") -> dict:
    """One question with its decision to a checked answer; ``generate`` (question, evidence) is called once, and once more if its answer is rejected."""
    plan = resolver.resolve(decision, fields, today)
    found, table = [], None
    if plan.kind == "aggregate":
        a = plan.aggregate
        table = render_table(resolver.gather(plan, days, fields, date), a["stat"], a["metric"])
        found = [(r[0], table) for r in days.where(resolver.predicate(plan, fields, date)).select(date).orderBy(date).collect()]
    elif plan.kind == "filter":
        got = resolver.gather(plan, days, fields, date).select(date, text)
        # all days may be cited, the texts of the first alone are shown
        shown_texts = [(r[0], r[1]) for r in got.orderBy(date).limit(SHOWN).collect()]
        found = shown_texts + [(r[0], None) for r in got.select(date).orderBy(date).collect()[len(shown_texts) :]]
    elif plan.kind == "semantic":
        own = days.where(resolver.predicate(plan, fields, date)).select(F.col(date).alias("doc_id"), F.col(text).alias("text"))
        asked = days.sparkSession.createDataFrame([(0, plan.query or question)], "item_id int, text string")
        hits = search(own, asked, top_k).join(own, "doc_id").orderBy("rank")
        found = [(r["doc_id"], r["text"]) for r in hits.select("doc_id", "text").collect()]
    out = {"route": plan.kind, "plan": plan, "retrieved": [d for d, _ in found], "table": table, "retries": 0, "violations": []}
    if plan.kind == "unanswerable" or not (found or table):
        return out | {"answer": {"answer": NOTHING.get(plan.kind, "No evidence."), "claims": [], "cited_dates": [], "unanswerable": True}}
    allowed = [table] if table else [t for _, t in found[:SHOWN]]
    more = f"\n\n---\n\n({len(found) - SHOWN} more matching days not shown)" if len(found) > SHOWN and not table else ""
    seen = table or "\n\n---\n\n".join(f"[{d}]\n{t}" for d, t in found[:SHOWN]) + more
    schema = "answer string, cited array<string>, claims array<struct<text:string,dates:array<string>>>, retrieved array<string>, question string, allowed array<string>, route string, unanswerable boolean"
    for turn in range(2):
        answer = generate(question, seen)
        row = (answer.get("answer"), answer.get("cited_dates"), [(c.get("text"), c.get("dates")) for c in answer.get("claims") or []], out["retrieved"], question, allowed, plan.kind, bool(answer.get("unanswerable")))
        checked = days.sparkSession.createDataFrame([row], schema)
        out |= {"answer": answer, "retries": turn, "violations": checked.select(violations(*(F.col(c) for c in checked.columns))).first()[0]}
        if not out["violations"]:
            break
    return out
