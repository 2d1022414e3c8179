"""Names to company ids: exact, ambiguous and close matches, people's decisions, and accounts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docforge.functions.names import compact_key
from docforge.operators.relate import fuzzy_match

#: From where a close spelling is taken, and from where it is shown to a person.
ACCEPT, REVIEW = 0.94, 0.85
COLUMNS = ("name", "cik", "matched_name", "method", "score")
REVIEWED = ("contract_id", "name", "candidate_cik", "candidate_name", "method", "score", "confirmed")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _first(df: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def candidates(names: DataFrame, indexes: dict[str, DataFrame]) -> DataFrame:
    """Every candidate (``COLUMNS``, turn, at) of the distinct names; ``indexes`` (cik, name) come in order of trust.

    turn 0: the key has one id; 1: it has several, one row each; 2: a close key.
    Only names without an exact match are compared with close ones.
    """
    keyed = names.select("name").where("name is not null").distinct().withColumn("key", compact_key(F.col("name")))
    listed = _union([df.select("cik", "name").distinct().withColumn("key", compact_key(F.col("name"))).withColumn("at", F.lit(i)).withColumn("source", F.lit(m)) for i, (m, df) in enumerate(indexes.items())])
    ids = listed.groupBy("at", "source", "key", "cik").agg(F.min("name").alias("matched_name"))
    many = ids.groupBy("at", "key").agg(F.count("*").alias("ids"))
    met = keyed.join(ids.join(many, ["at", "key"]), "key")
    exact = met.where("ids = 1").select("name", "cik", "matched_name", F.concat("source", F.lit("_exact")).alias("method"), F.lit(1.0).alias("score"), F.lit(0).alias("turn"), "at")
    rest = keyed.join(exact.select("name").distinct(), "name", "left_anti")
    unsure = met.where("ids > 1").join(rest.select("name"), "name", "left_semi")
    unsure = unsure.select("name", "cik", "matched_name", F.concat("source", F.lit("_exact_ambiguous")).alias("method"), F.lit(1.0).alias("score"), F.lit(1).alias("turn"), "at")
    close = []
    for i, m in enumerate(indexes):
        own = ids.where(F.col("at") == i)
        near = fuzzy_match(rest.select("key").distinct(), own.select("key", "cik"), REVIEW).join(rest, "key")
        named = own.select(F.col("key").alias("other"), "cik", "matched_name")
        close.append(near.select("name", "other", "score").join(named, "other").select("name", "cik", "matched_name", F.lit(f"{m}_fuzzy").alias("method"), "score", F.lit(2).alias("turn"), F.lit(i).alias("at")))
    return _union([exact, unsure, *close])


def resolve_names(found: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, review) of ``candidates``: a row a name, and what a person should look at.

    An exact match of the first index that has one; else, unless a key was
    ambiguous, the closest spelling from ``ACCEPT`` on; else unresolved.
    """
    order = ("turn", "at", F.desc("score"), "cik")
    sure = _first(found.where("turn = 0"), ["name"], *order)
    unsure = found.where("turn = 1").select("name").distinct()
    near = _first(found.where((F.col("turn") == 2) & (F.col("score") >= ACCEPT)).join(unsure, "name", "left_anti"), ["name"], *order)
    taken = sure.unionByName(near)
    every = names.select("name").where("name is not null").distinct()
    resolved = every.join(taken, "name", "left").select("name", "cik", "matched_name", F.coalesce("method", F.lit("unresolved")).alias("method"), "score")
    # of a name with a close match, what came before it; of an unresolved one, all
    stop = near.select("name", F.col("at").alias("stop"))
    open_ = found.where("turn > 0").join(sure.select("name"), "name", "left_anti").join(stop, "name", "left").where("stop is null or turn = 1 or at < stop")
    return resolved, _first(open_, ["name", "cik"], *order).select(*COLUMNS)


def decisions(review: DataFrame) -> DataFrame:
    """(name, cik, matched_name) a person settled: a yes, or null where all candidates have a no; others are left out."""
    said = review.withColumn("said", F.lower(F.trim(F.coalesce("confirmed", F.lit("")))))
    yes = F.min(F.when(F.col("said") == "yes", F.struct(F.col("candidate_cik").cast("long").alias("cik"), F.col("candidate_name").alias("matched_name"))))
    got = said.groupBy("name").agg(yes.alias("y"), F.bool_and(F.col("said") == "no").alias("none"))
    return got.where("y is not null or none").select("name", "y.cik", "y.matched_name")


def merge_review(previous: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows decided yes or no as they are, then each new (name, candidate) that is not among them."""
    kept = previous.where(F.lower(F.trim("confirmed")).isin("yes", "no")).select(*REVIEWED)
    new = fresh.withColumn("candidate_cik", F.col("candidate_cik").cast(previous.schema["candidate_cik"].dataType)).withColumn("score", F.col("score").cast(previous.schema["score"].dataType))
    new = _first(new, ["name", "candidate_cik"], F.desc("score"), "contract_id").join(kept.select("name", "candidate_cik"), ["name", "candidate_cik"], "left_anti")
    return kept.unionByName(new.select(*REVIEWED))


def accounts(contracts: DataFrame, resolved: DataFrame, review: DataFrame, settled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accounts, review rows): the first name of each contract that has an id.

    ``contracts`` (contract_id, names: array in order); what people settled comes
    before what was resolved.  Shown are candidates of names before the deciding
    one (of all, if none decides), and a close spelling that decided, as ``auto``.
    """
    tried = contracts.select("contract_id", F.posexplode(F.array_distinct(F.filter("names", lambda n: n.isNotNull() & (n != "")))).alias("pos", "name"))
    own = settled.select("name", F.struct("cik", "matched_name", F.when(F.col("cik").isNull(), "unresolved").otherwise("manual_review").alias("method"), F.lit(None).cast("double").alias("score")).alias("s"))
    auto = resolved.select("name", F.struct("cik", "matched_name", "method", F.col("score").cast("double").alias("score")).alias("r"))
    got = tried.join(own, "name", "left").join(auto, "name", "left").withColumn("m", F.coalesce("s", "r"))
    best = F.min(F.when(F.col("m.cik").isNotNull(), F.struct("pos", "name", F.col("m.cik").alias("cik"), F.col("m.matched_name").alias("matched_name"), F.col("m.method").alias("method"), F.col("m.score").alias("score"))))
    account = contracts.select("contract_id").join(got.groupBy("contract_id").agg(best.alias("b")), "contract_id", "left").select("contract_id", "b.*")
    seen = got.where("s is null").join(account.select("contract_id", F.col("pos").alias("stop"), F.col("method").alias("how")), "contract_id")
    before = seen.where("stop is null or pos < stop or (pos = stop and how like '%fuzzy')").select("contract_id", "name").join(review, "name")
    shown = before.select("contract_id", "name", F.col("cik").alias("candidate_cik"), F.col("matched_name").alias("candidate_name"), "method", "score", F.lit("").alias("confirmed"))
    taken = account.where("method like '%fuzzy'").select("contract_id", "name", F.col("cik").alias("candidate_cik"), F.col("matched_name").alias("candidate_name"), "method", "score", F.lit("auto").alias("confirmed"))
    return account, shown.unionByName(taken)
