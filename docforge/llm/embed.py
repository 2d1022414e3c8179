"""Near-duplicate vectors by p-stable hashing and exact cosine checks.

Vectors of one label are normalised and projected on seeded Gaussian
directions; the projections, quantised to steps of ``width``, give each vector
a bucket in each of ``tables`` tables.  At cosine 0.98 (chord 0.2) a pair shares
one of 8 tables of 10 projections with probability 0.989; a pair that shares
several is counted in the first.  Identical vectors form one representative
with a multiplicity before anything is hashed; a large bucket is compared
block against block by as many tasks, so none holds it whole, and a task emits
counts and a spanning forest, never all pairs.

Defined results: null labels and vectors that are null, zero, or hold null or
non-finite components link with nothing; vectors of different lengths never
link; repeated rows are identical vectors; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm.common import Forest, components, cut
from docforge.llm.kernels import BYTE_WORD, mix64

U64 = np.uint64


def _unit(values) -> np.ndarray | None:
    """The vector divided by its length, in double precision; None if it links with nothing."""
    if values is None or not len(values):
        return None
    v = np.array([np.nan if x is None else x for x in values], np.float64)
    if not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top
    return v / np.sqrt((v * v).sum())


def _name(v: np.ndarray) -> tuple[int, int]:
    raw = BYTE_WORD[np.frombuffer((v + 0.0).astype("<f8").tobytes(), np.uint8)]
    at = np.arange(len(raw), dtype=U64) * U64(0x9E3779B97F4A7C15)
    return tuple(int(mix64(raw + at + U64(k)).sum(dtype=U64).view(np.int64)) for k in (1, 2))


def _read(vectors: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for vec, label, values in zip(pdf["vec_id"], pdf["label"], pdf["embedding"], strict=True):
                u = None if pd.isna(label) else _unit(values)
                if u is None:
                    out.append((vec, None, 0, 0, None))
                else:
                    # named by the values as given: equal vectors, not only equal directions
                    out.append((vec, str(label), *_name(np.array(values, np.float64)), u.tobytes()))
            yield pd.DataFrame(out, columns=["vec_id", "lab", "s1", "s2", "unit"])

    return vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding").mapInPandas(run, "vec_id long, lab string, s1 long, s2 long, unit binary")


def directions(dim: int, tables: int, hashes: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.normal(size=(dim, tables * hashes)), rng.uniform(0, width, tables * hashes)


def _hash(reps: DataFrame, tables: int, hashes: int, width: float, seed: int) -> DataFrame:
    """(rep, mult, unit, keys: one bucket a table) of every representative."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        mul = mix64(np.arange(1, hashes + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
        for pdf in batches:
            keys = []
            for unit, lab in zip(pdf["unit"], pdf["lab"], strict=True):
                u = np.frombuffer(unit, np.float64)
                if len(u) not in made:
                    made[len(u)] = directions(len(u), tables, hashes, width, seed)
                a, b = made[len(u)]
                cell = np.floor((u @ a + b) / width).astype(np.int64).view(U64).reshape(tables, hashes)
                raw = lab.encode()
                own = int((BYTE_WORD[np.frombuffer(raw, np.uint8)] * (np.arange(len(raw), dtype=U64) * U64(2) + U64(1))).sum(dtype=U64)) if raw else 0
                salt = mix64(np.arange(tables, dtype=U64) + U64((own + len(u)) & (1 << 64) - 1))
                keys.append(mix64((mix64(cell + mul) * mul).sum(1, dtype=U64) ^ salt).view(np.int64).tolist())
            yield pdf[["rep", "mult", "unit"]].assign(keys=keys)

    return reps.mapInPandas(run, "rep long, mult long, unit binary, keys array<long>")


def _compare(least: float):
    """Runs of rows sorted by (key, b1, b2) to (kind 0: vector, links) and (kind 1: edge)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int, int]] = []
        links: dict[int, int] = {}

        def judge(g: pd.DataFrame) -> None:
            if len(g) < 2:
                return
            x = np.stack([np.frombuffer(u, np.float64) for u in g["unit"]])
            rep, mult, blk = (g[c].to_numpy() for c in ("rep", "mult", "blk"))
            keys, table = np.stack(g["keys"].to_list()), int(g["tab"].iloc[0])
            within = g["b1"].iloc[0] == g["b2"].iloc[0]
            cos = x @ x.T
            i, j = np.nonzero(cos >= least)
            pick = (i < j) if within else (i < j) & (blk[i] != blk[j])
            i, j = i[pick], j[pick]
            if table:
                first = np.ones(len(i), bool)
                for t in range(table):
                    first &= keys[i, t] != keys[j, t]
                i, j = i[first], j[first]
            if not len(i):
                return
            for v, n in zip(rep, np.bincount(i, mult[j], len(rep)) + np.bincount(j, mult[i], len(rep)), strict=True):
                if n:
                    links[int(v)] = links.get(int(v), 0) + int(n)
            forest = Forest(len(rep))
            out.extend((1, int(rep[a]), int(rep[b])) for a, b in zip(i.tolist(), j.tolist(), strict=True) if forest.join(a, b))

        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            marks = pdf[["key", "b1", "b2"]].to_numpy()
            edge = np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1
            parts = [pdf.iloc[a:b] for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(pdf)], strict=True)]
            for k, part in enumerate(parts):
                if k == 0 and held and (held[-1][["key", "b1", "b2"]].iloc[0].to_numpy() == part[["key", "b1", "b2"]].iloc[0].to_numpy()).all():
                    held.append(part)
                    continue
                if held:
                    judge(pd.concat(held) if len(held) > 1 else held[0])
                held = [part]
            if len(out) + len(links) > 20_000:
                yield pd.DataFrame([*out, *((0, v, n) for v, n in links.items())], columns=["kind", "a", "b"])
                out, links = [], {}
        if held:
            judge(pd.concat(held) if len(held) > 1 else held[0])
        yield pd.DataFrame([*out, *((0, v, n) for v, n in links.items())], columns=["kind", "a", "b"])

    return run


def vector_links(vectors: DataFrame, least: float = 0.98, tables: int = 8, hashes: int = 10, width: float = 2.0, seed: int = 3, block: int = 1024, salts: int = 32) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``."""
    rows = cut(_read(vectors))
    good = rows.where("lab is not null").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)))
    part = good.groupBy("lab", "s1", "s2", "salt").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    whole = part.groupBy("lab", "s1", "s2").agg(F.min("low").alias("rep"), F.sum("n").alias("mult"))
    back = part.select("lab", "s1", "s2", "salt").join(whole, ["lab", "s1", "s2"])
    member = cut(good.join(back, ["lab", "s1", "s2", "salt"]).select("vec_id", "rep", "mult"))
    reps = rows.where("lab is not null").join(member.where("vec_id = rep").select("vec_id", "rep", "mult").dropDuplicates(["vec_id"]), "vec_id").select("rep", "mult", "lab", "unit").dropDuplicates(["rep"])
    hashed = cut(_hash(reps, tables, hashes, width, seed))
    placed = hashed.select("rep", F.posexplode("keys").alias("tab", "key"))
    many = placed.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / block).cast("int").alias("s"))
    put = placed.join(many, "key").withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("s")).cast("int"))
    put = put.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).select("rep", "tab", "key", "blk", F.least("blk", "o").alias("b1"), F.greatest("blk", "o").alias("b2"))
    full = put.join(hashed, "rep").repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2")
    found = cut(full.select("key", "b1", "b2", "blk", "tab", "rep", "mult", "unit", "keys").mapInPandas(_compare(least), "kind int, a long, b long"))
    count = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    comp = components(found.where("kind = 1").select("a", "b"))
    of_rep = hashed.select("rep").join(count, "rep", "left").join(comp.select(F.col("id").alias("rep"), "comp"), "rep", "left")
    of_row = member.join(of_rep, "rep").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("comp", "rep").alias("component_id"))
    alone = rows.where("lab is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return of_row.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
