"""Rules for a set of questions with known answers: each line, and the set as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How many questions of each kind a set has, and what a verdict may be.
MIX = {"clause": 10, "filing": 6, "filter": 7, "aggregate": 7, "playbook_check": 5, "unanswerable": 5}
LEAST_REVENUE, LEAST_CROSS, VERDICTS = 3, 1, ("matches", "deviates", "unclear")
QUESTION = (
    "id string, kind string, question string, scope struct<contract_id:string>, gold_passages array<struct<doc_id:string,start:int,end:int,category:string>>, "
    "gold_rows array<string>, expected_contract_ids array<string>, expected_facts array<string>, expected_verdict string, notes string"
)
_NEEDED = ("id", "kind", "question", "scope", "gold_passages", "gold_rows", "expected_contract_ids", "expected_facts", "notes")


def read_lines(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions with their line, problems) of ``raw`` (line: bigint, value); blank lines are skipped."""
    own = raw.where(F.trim("value") != "").withColumn("whole", F.get_json_object("value", "$").isNotNull())
    kind = F.when(~F.col("whole"), "not JSON").when(~F.trim("value").startswith("{"), "not an object")
    bad = own.withColumn("why", kind).where("why is not null").select("line", F.format_string("line %d: %s", F.col("line"), F.col("why")).alias("problem"))
    good = own.where(F.col("whole") & F.trim("value").startswith("{")).select("line", F.from_json("value", QUESTION).alias("q"), F.json_object_keys("value").alias("given"))
    return good.select("line", "q.*", "given"), bad


def _say(bad: Column, text: Column | str) -> Column:
    return F.when(bad, text if isinstance(text, Column) else F.lit(text))


def _normal(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


#: The wording of each problem.
SAID = {
    "not_contract": "a clause passage must be in a contract",
    "no_category": "category is missing",
    "incomplete": "needs doc_id, start and end",
    "unknown_doc": " is not a selected contract, an extracted Item 1A, or the playbook",
    "not_filing": "a filing passage must be in an Item 1A extraction",
    "empty": "empty question",
    "clause": "a clause question needs gold passages",
    "filing": "a filing question needs gold passages",
    "filter": "a filter question needs expected_contract_ids",
    "aggregate": "an aggregate question needs expected_facts",
    "playbook": "a playbook_check needs gold passages (the clause and the playbook position)",
    "verdict": "only playbook_check questions carry an expected_verdict",
    "unanswerable": "an unanswerable question has no gold passages, rows or contracts",
    "fact": "' is not inside any gold passage",
    "overlap": " overlaps no labelled span of ",
}


def check_lines(questions: DataFrame, docs: DataFrame, spans: DataFrame, revenue: DataFrame) -> DataFrame:
    """(line, id, kind, problems, doc_types) of every question.

    ``docs`` (doc_id, doc_type, text) are all that may be cited, ``spans``
    (doc_id, category, start, end) the labels, ``revenue`` (row_id) the rows.
    """
    cited = questions.select("line", "kind", "expected_facts", F.posexplode("gold_passages").alias("at", "g")).select("line", "kind", "at", "g.*")
    known = cited.join(docs.select("doc_id", "doc_type", "text"), "doc_id", "left")
    labels = spans.select("doc_id", "category", F.struct(F.col("start").alias("s"), F.col("end").alias("e")).alias("l")).groupBy("doc_id", "category").agg(F.collect_list("l").alias("labels"))
    known = known.join(labels, ["doc_id", "category"], "left")
    n = F.char_length("text")
    sound = F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= n)
    touched = F.coalesce(F.exists("labels", lambda x: (x["s"] < F.col("end")) & (F.col("start") < x["e"])), F.lit(False))
    where = F.concat(F.lit("gold_passages["), F.col("at").cast("string"), F.lit("]"))
    span = F.concat(F.lit("["), F.col("start").cast("string"), F.lit(", "), F.col("end").cast("string"), F.lit(")"))
    clause = F.when(F.col("doc_type") != "contract", SAID["not_contract"]).when(F.col("category").isNull(), SAID["no_category"]).when(~touched, F.concat(span, F.lit(SAID["overlap"]), F.col("category")))
    wrong = (
        F.when(F.col("doc_id").isNull() | F.col("start").isNull() | F.col("end").isNull(), SAID["incomplete"])
        .when(F.col("doc_type").isNull(), F.concat("doc_id", F.lit(SAID["unknown_doc"])))
        .when(~sound, F.concat(F.lit("offsets "), span, F.lit(" are outside 0.."), n.cast("string"), F.lit(" or empty")))
        .when(F.col("kind") == "clause", clause)
        .when((F.col("kind") == "filing") & (F.col("doc_type") != "risk_factors"), SAID["not_filing"])
    )
    said = F.when(sound, _normal(F.expr("substring(text, start + 1, end - start)")))
    per = known.withColumn("wrong", wrong).groupBy("line").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("wrong").isNotNull(), F.struct("at", F.concat(where, F.lit(": "), F.col("wrong")).alias("t"))))), lambda x: x["t"]).alias("passages"),
        F.collect_set("doc_type").alias("doc_types"), F.collect_list(said).alias("said"),
    )
    # ids that name nothing
    ids = questions.select("line", F.explode(F.concat(F.transform("expected_contract_ids", lambda x: F.struct(F.lit("expected contract").alias("as"), x.alias("id"))), F.transform("gold_rows", lambda x: F.struct(F.lit("revenue row").alias("as"), x.alias("id"))), F.array(F.struct(F.lit("scope.contract_id").alias("as"), F.col("scope.contract_id").alias("id"))))).alias("x")).select("line", "x.*").where("id is not null")
    have = docs.where("doc_type = 'contract'").select(F.explode(F.array(F.lit("expected contract"), F.lit("scope.contract_id"))).alias("as"), F.col("doc_id").alias("id")).unionByName(revenue.select(F.lit("revenue row").alias("as"), F.col("row_id").alias("id")))
    lost = ids.join(have, ["as", "id"], "left_anti").groupBy("line").agg(F.array_sort(F.collect_set(F.concat_ws(" ", "as", "id", F.when(F.col("as") == "revenue row", "does not exist").otherwise("is not in the selection")))).alias("lost"))
    q = questions.join(per, "line", "left").join(lost, "line", "left")
    none, size = F.array().cast("array<string>"), lambda c: F.coalesce(F.size(c), F.lit(0))
    missing = F.transform(F.array_except(F.array(*map(F.lit, (*_NEEDED, "expected_verdict"))), F.coalesce("given", none)), lambda f: F.concat(F.lit("missing field "), f))
    typed = F.array(*(_say(F.array_contains("given", c) & F.col(c).isNull(), f"{c} has the wrong type") for c in _NEEDED))
    kind, verdict = F.col("kind"), F.col("expected_verdict")
    facts = F.transform(F.filter("expected_facts", lambda f: ~F.exists(F.coalesce("said", none), lambda t: F.contains(t, _normal(f)))), lambda f: F.concat(F.lit("expected fact '"), f, F.lit(SAID["fact"])))
    rules = F.array(
        _say(F.trim("question") == "", SAID["empty"]),
        _say((kind == "clause") & (size("gold_passages") == 0), SAID["clause"]),
        _say((kind == "filing") & (size("gold_passages") == 0), SAID["filing"]),
        _say((kind == "filter") & (size("expected_contract_ids") == 0), SAID["filter"]),
        _say((kind == "aggregate") & (size("expected_facts") == 0), SAID["aggregate"]),
        _say((kind == "playbook_check") & ~F.coalesce(verdict.isin(*VERDICTS), F.lit(False)), f"expected_verdict must be one of {', '.join(VERDICTS)}"),
        _say((kind == "playbook_check") & (size("gold_passages") == 0), SAID["playbook"]),
        _say((kind != "playbook_check") & verdict.isNotNull(), SAID["verdict"]),
        _say((kind == "unanswerable") & (size("gold_passages") + size("gold_rows") + size("expected_contract_ids") > 0), SAID["unanswerable"]),
    )
    shape = F.filter(F.concat(missing, typed), lambda x: x.isNotNull())
    content = F.filter(F.concat(F.coalesce("lost", none), F.coalesce("passages", none), rules, F.when(kind == "clause", facts).otherwise(none)), lambda x: x.isNotNull())
    unknown = F.array(F.concat(F.lit("unknown kind '"), kind, F.lit("'")))
    problems = F.when(F.size(shape) > 0, shape).when(~kind.isin(*MIX), unknown).otherwise(content)
    return q.select("line", "id", "kind", problems.alias("problems"), F.coalesce("doc_types", none).alias("doc_types"), (size("gold_rows") > 0).alias("cites_rows"))


def check_set(checked: DataFrame) -> DataFrame:
    """(problem) of the whole set: ids given twice, the mix of kinds, revenue and cross-document questions."""
    spark = checked.sparkSession
    twice = checked.groupBy("id").count().where("count > 1").select(F.format_string("id '%s' appears %d times", "id", "count").alias("problem"))
    want = spark.createDataFrame(list(MIX.items()), "kind string, want long")
    mix = want.join(checked.groupBy("kind").count(), "kind", "left").where("coalesce(count, 0) <> want")
    mix = mix.select(F.format_string("mix: %d %s questions, expected %d", F.coalesce("count", F.lit(0).cast("long")), "kind", "want").alias("problem"))
    rev, cross = F.count_if((F.col("kind") == "aggregate") & F.col("cites_rows")), F.count_if((F.col("kind") == "playbook_check") & (F.col("cites_rows") | F.array_contains("doc_types", "risk_factors")))
    both = checked.agg(rev.alias("rev"), cross.alias("cross"))
    few = both.select(F.explode(F.array(
        F.when(F.col("rev") < LEAST_REVENUE, F.format_string(f"mix: %d aggregate questions cite revenue rows, expected at least {LEAST_REVENUE}", "rev")),
        F.when(F.col("cross") < LEAST_CROSS, F.format_string(f"mix: %d cross-document playbook checks, expected at least {LEAST_CROSS}", "cross")),
    )).alias("problem")).where("problem is not null")
    return twice.unionByName(mix).unionByName(few)


def problems(raw: DataFrame, docs: DataFrame, spans: DataFrame, revenue: DataFrame) -> DataFrame:
    """All problems of a question file as text lines."""
    good, bad = read_lines(raw)
    checked = check_lines(good, docs, spans, revenue)
    each = checked.select("line", "id", F.explode("problems").alias("p")).select(F.format_string("line %d (%s): %s", "line", F.coalesce("id", F.lit("?")), "p").alias("problem"))
    return bad.select("problem").unionByName(each).unionByName(check_set(checked))
