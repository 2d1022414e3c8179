"""Jaccard join on word shingles by parity sketches.

A set's odd sketch XORs one bit per shingle, so the Hamming distance of two
sketches bounds their sets' symmetric difference from below.  Sets that reach
the threshold differ in at most D shingles, D fixed by the sizes; a sketch cut
into D + 1 parts therefore agrees in one part at least.  Sizes go in bands: a
set joins the band of its size and the next, so every pair that can qualify
meets in one band with one number of parts.  Parts are wide and sparse and move
as 64-bit fingerprints of their odd bits.  All candidates are verified on the
whole sets.

More parts than that make sets that qualify agree in more than one, so each may
leave out its most frequent parts: a passage that many texts share brings them
together by few parts, and these go first.

Equal sets form a class with one representative.  Of each part, every set is
first verified against the least (linear); the groups that are not yet one
component go on to blockwise comparison, where no pair that can qualify is left
out.  Verification is by a sketch of the whole set first, a bit a shingle, and
then on the whole sets, for which the texts move compressed: once for each head
and member, or once for each distinct group of sets that may link.

Defined results: null and wordless texts have no shingle and link with nothing;
a text of fewer words than ``words`` is one shingle; repeated rows are equal
sets; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docforge.llm.common import Forest, components, cut, fresh
from docforge.llm.kernels import gram_hashes, mix64, word_hashes, word_spans

U64 = np.uint64


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles (A-Z folded)."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    h = word_hashes(data, *word_spans(data), lower=True)
    if not len(h):
        return h
    return np.unique(gram_hashes(h, min(words, len(h))) ^ U64(min(words, len(h))))


def common(d: int) -> int:
    """How many of its most frequent parts a set may leave out, if sets differ in ``d`` shingles at most."""
    return 0 if d < 4 else 3 + d // 4


class Bands:
    """Upper sizes of the bands, and how many parts a sketch has in each."""

    def __init__(self, percent: int, top: int = 1 << 40):
        self.percent = percent
        his = [1]
        while his[-1] < top:
            his.append(max(his[-1] + 1, -(-his[-1] * 100 // percent)))
        self.his = np.array(his, np.int64)

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.his, size))

    def parts(self, band: int) -> tuple[int, int]:
        """(parts, spare): so many more parts than D + 1 that ``spare`` empty ones and ``common`` others may be left out."""
        d = int(2 * self.his[band]) * (100 - self.percent) // (100 + self.percent)
        spare = 0 if d < 4 else 3 + d // 50
        return d + 1 + spare + common(d), spare

    def keys(self, h: np.ndarray) -> np.ndarray:
        """The join keys of a set: one for each part in its band and the next."""
        x = mix64(h ^ U64(0xA5A5A5A5A5A5A5A5))
        bit = mix64((x & U64((1 << 24) - 1)) + U64(1))
        out = []
        own = self.of(len(h))
        for band in (own, own + 1):
            parts, spare = self.parts(band)
            place = ((x >> U64(24)) % U64(parts)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            place = place[order]
            first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            odd = np.zeros(parts, U64)
            odd[place[first]] = np.bitwise_xor.reduceat(bit[order], first)
            number = np.arange(parts, dtype=U64)
            if parts - np.count_nonzero(odd) <= spare:
                number = np.flatnonzero(odd).astype(U64)
                odd = odd[odd != 0]
            # the last bit tells a set's two bands apart
            out.append(mix64(mix64(odd + number * U64(0x9E3779B97F4A7C15)) + U64(band)) & ~U64(1) | U64(band & 1))
        return np.concatenate(out)


def reaches(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| for sorted distinct arrays."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    inter = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * inter >= percent * (len(a) + len(b) - inter)


def sketch(h: np.ndarray) -> bytes:
    """Odd sketch of a set, a bit a shingle at least: each shingle flips the bit it hashes to."""
    size = 64
    while size < len(h):
        size *= 2
    return np.packbits(np.bincount((mix64(h) & U64(size - 1)).astype(np.int64), minlength=size) & 1).tobytes()


def folded(raw: bytes, size: int) -> np.ndarray:
    """A sketch brought to ``size`` bytes: halves XOR onto each other, which keeps it an odd sketch."""
    x = np.frombuffer(raw, U64)
    return x if len(raw) == size else np.bitwise_xor.reduce(x.reshape(-1, size // 8), axis=0)


def may_reach(x: bytes, y: bytes, n: int, m: int, percent: int) -> bool:
    """Whether the distance of two sketches leaves room for the threshold."""
    size = min(len(x), len(y))
    far = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
    return far * (100 + percent) <= (n + m) * (100 - percent)


def by_group(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``keys`` as one frame a group; holds one group and one batch."""
    held = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf if held is None else pd.concat((held, pdf), ignore_index=True)
        k = pdf[keys].to_numpy()
        at = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist()]
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            yield pdf.iloc[lo:hi]
        held = pdf.iloc[at[-1] :]
    if held is not None:
        yield held


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, s1, s2, odd): size, 128-bit name and sketch of each row's set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                h = shingles(text, words) if isinstance(text, str) else np.empty(0, U64)
                one, two = (mix64(h + U64(k)).sum(dtype=U64).view(np.int64) if len(h) else 0 for k in (1, 2))
                out.append((doc, len(h), int(one), int(two), sketch(h) if len(h) else None))
            yield pd.DataFrame(out, columns=["doc_id", "n", "s1", "s2", "odd"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n long, s1 long, s2 long, odd binary")


def _keys(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, node): the parts of each set, an equal set once a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands, seen = Bands(percent), set()
        for pdf in batches:
            keys, nodes, rows = [], [], 0
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                h = shingles(text, words) if isinstance(text, str) else ()
                if not len(h):
                    continue
                name = (len(h), int(mix64(h + U64(1)).sum(dtype=U64)))
                if name in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(name)
                k = bands.keys(h)
                keys.append(k.view(np.int64))
                nodes.append(np.full(len(k), doc, np.int64))
                rows += len(k)
                if rows > 200_000:
                    yield pd.DataFrame({"key": np.concatenate(keys), "node": np.concatenate(nodes)})
                    keys, nodes, rows = [], [], 0
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys), "node": np.concatenate(nodes)})

    return docs.select("doc_id", "text").mapInPandas(run, "key long, node long")


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key, without those whose key has one row; one row is held between batches."""
    held, met = None, False
    for pdf in batches:
        if not len(pdf):
            continue
        rows = pdf if held is None else pd.concat((held, pdf), ignore_index=True)
        k = rows["key"].to_numpy()
        same = np.concatenate(([met], k[1:] == k[:-1]))
        keep = same | np.concatenate((same[1:], [False]))
        keep[-1] = False
        yield rows[keep]
        held, met = rows.iloc[-1:], bool(same[-1])
    if met:
        yield held


def _uncommon(shared: DataFrame, sizes: DataFrame, percent: int, often: int = 8) -> DataFrame:
    """(key, node) of ``shared`` but for each set's most frequent parts.

    Sets that qualify agree in ``common`` + 1 parts at least.  Each leaves out
    ``common`` of its parts at most, in one order for all (more frequent first),
    so the least frequent part in which two agree stays in both.
    """
    count = shared.groupBy("key").agg(F.count("*").alias("times")).where(F.col("times") > often)
    tagged = shared.join(count.hint("merge"), "key", "left")
    d = F.expr(f"2 * n * {100 - percent} div {100 + percent}")
    hot = tagged.where("times is not null").join(sizes.hint("merge"), "node")
    order = Window.partitionBy("node", (F.col("key").bitwiseAND(F.lit(1)))).orderBy(F.desc("times"), "key")
    hot = hot.withColumn("place", F.row_number().over(order)).where(F.col("place") > F.when(d < 4, 0).otherwise(3 + F.floor(d / 4)))
    return tagged.where("times is null").select("key", "node").union(hot.select("key", "node"))


def _meetings(small: int = 2):
    """Rows sorted by (key, node) to candidates (a, b, fam).

    Of a key with two nodes, its pair (fam 0); of a longer one, each node with
    the least, under the group's name: its other nodes are compared later.
    Held between batches: one short run, or the least node of a long one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.empty(0, np.int64)
        rest_k, rest_n, long_run = none, none, None
        for pdf in chain(batches, (None,)):
            k = rest_k if pdf is None else np.concatenate((rest_k, pdf["key"].to_numpy()))
            n = rest_n if pdf is None else np.concatenate((rest_n, pdf["node"].to_numpy()))
            rest_k, rest_n = none, none
            if not len(k):
                continue
            starts = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1))
            on = long_run is not None and k[0] == long_run[0]
            if pdf is not None and len(k) - starts[-1] <= small and not (on and len(starts) == 1):
                rest_k, rest_n = k[starts[-1] :], n[starts[-1] :]
                k, n, starts = k[: starts[-1]], n[: starts[-1]], starts[:-1]
            if not len(k):
                continue
            sizes = np.diff(np.concatenate((starts, [len(k)])))
            run_of = np.repeat(np.arange(len(starts)), sizes)
            head, big = n[starts], sizes > small
            if on:
                head[0], big[0] = long_run[1], True
            # equal groups of many keys are one family, named by their members; a group still open, by its key
            fam = np.add.reduceat(mix64(n.astype(np.int64).view(U64) + U64(7)), starts).view(np.int64) | 1
            if on:
                fam[0] = k[0] | 1
            if big[-1] and pdf is not None:
                fam[-1] = k[-1] | 1
            long_run = (k[-1], head[-1]) if big[-1] else None
            big, head, fam = big[run_of], head[run_of], fam[run_of]
            one, two, mark = [head[big]], [n[big]], [fam[big]]
            for step in range(1, small):
                i = np.flatnonzero((run_of[step:] == run_of[:-step]) & ~big[:-step])
                one.append(n[i])
                two.append(n[i + step])
                mark.append(np.zeros(len(i), np.int64))
            out = pd.DataFrame({"a": np.concatenate(one), "b": np.concatenate(two), "fam": np.concatenate(mark)})
            yield out[out["a"] != out["b"]].drop_duplicates()

    return run


def classes(sets: DataFrame, salts: int = 32) -> DataFrame:
    """(doc_id, n, rep): the least doc_id among equal sets, a hot set spread over ``salts``."""
    keyed = sets.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    part = keyed.groupBy("n", "s1", "s2", "salt").agg(F.min("doc_id").alias("low"))
    whole = part.groupBy("n", "s1", "s2").agg(F.min("low").alias("rep"))
    back = part.join(whole, ["n", "s1", "s2"]).drop("low")
    return keyed.join(back, ["n", "s1", "s2", "salt"]).select("doc_id", "n", "rep")


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, z): the compressed texts of ``nodes``, one a node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=3)
        for pdf in batches:
            yield pd.DataFrame({"node": pdf["doc_id"], "z": [press.compress(t.encode("utf-8")) for t in pdf["text"]]})

    packed = docs.where("text is not null").select("doc_id", "text").mapInPandas(run, "node long, z binary")
    # both sides grow with the input: no broadcast, whatever their size now
    return packed.join(nodes.hint("merge"), "node", "left_semi").dropDuplicates(["node"])


def _opened(z: bytes, words: int) -> np.ndarray:
    return shingles(zstandard.ZstdDecompressor().decompress(z).decode("utf-8"), words)


def _hopeful(pairs: DataFrame, odds: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches leave room for the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = [may_reach(x, y, n, m, percent) for x, y, n, m in zip(pdf["x"], pdf["y"], pdf["n"], pdf["m"], strict=True)]
            yield pdf.loc[good, ["a", "b"]]

    one = odds.select(F.col("node").alias("a"), F.col("odd").alias("x"), "n")
    two = odds.select(F.col("node").alias("b"), F.col("odd").alias("y"), F.col("n").alias("m"))
    return pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "x", "y", "n", "m").mapInPandas(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int, share: int = 256) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold.

    A head's text goes once to each ``share`` or so of its members, so that a
    hot head is spread; a task holds one head's set at a time.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / share).cast("long").alias("parts"))
    put = pairs.join(many.hint("merge"), "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
    rows = put.select("a", "part", F.col("a").alias("node"), F.lit(0).alias("side")).distinct().union(put.select("a", "part", F.col("b").alias("node"), F.lit(1).alias("side")))
    sent = rows.join(_texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("node"))).hint("merge"), "node").repartition("a", "part").sortWithinPartitions("a", "part", "side")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = None
        for pdf in batches:
            out = []
            for a, node, side, z in zip(pdf["a"], pdf["node"], pdf["side"], pdf["z"], strict=True):
                own = _opened(z, words)
                if side == 0:
                    head = own
                elif reaches(head, own, percent):
                    out.append((a, node))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return sent.select("a", "node", "side", "z").mapInPandas(run, "a long, b long")


def _families(nodes: DataFrame, odds: DataFrame, docs: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """Links inside each family (fam, node, n, comp), block against block.

    A small family is one block.  Of others, members of about one size go in
    blocks of some ``block``; a block meets itself and those of its size and
    above as far as sizes allow a link.  Members already joined in one component
    are not compared.  Sketches first part a meeting into groups that may link;
    equal groups of many meetings are one, and only these bring their texts.
    """
    count = nodes.groupBy("fam").agg(F.count("*").alias("size"))
    sized = nodes.join(count.hint("merge"), "fam").withColumn("band", F.when(F.col("size") <= block, F.lit(0)).otherwise(F.floor(F.log("n") / F.log(F.lit(1.05)))).cast("long"))
    many = sized.groupBy("fam", "band").agg(F.ceil(F.count("*") / block).cast("long").alias("parts"))
    put = sized.join(many.hint("merge"), ["fam", "band"]).withColumn("blk", F.col("band") * (1 << 32) + F.pmod(F.xxhash64("node"), F.col("parts"))).drop("band", "parts")
    large = put.where(F.col("size") > block).drop("size")
    reach = large.groupBy("fam", "blk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    later = reach.select("fam", F.col("blk").alias("blk2"), F.col("lo").alias("lo2"))
    meet = reach.join(later.hint("merge"), "fam").where((F.col("blk2") >= F.col("blk")) & (F.col("lo2") * percent <= F.col("hi") * 100)).select("fam", "blk", "blk2")
    whole = put.where(F.col("size") <= block).select("fam", F.lit(0).cast("long").alias("b1"), F.lit(0).cast("long").alias("b2"), "node", "comp", F.lit(0).alias("side"))
    one = large.join(meet.hint("merge"), ["fam", "blk"]).select("fam", F.col("blk").alias("b1"), F.col("blk2").alias("b2"), "node", "comp", F.lit(0).alias("side"))
    far = meet.where("blk <> blk2").select("fam", F.col("blk").alias("b1"), F.col("blk2").alias("blk"))
    two = large.join(far.hint("merge"), ["fam", "blk"]).select("fam", "b1", F.col("blk").alias("b2"), "node", "comp", F.lit(1).alias("side"))
    keys = ["fam", "b1", "b2"]
    rows = whole.union(one).union(two).join(odds.hint("merge"), "node").repartition(*keys).sortWithinPartitions(*keys)

    def hope(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[pd.DataFrame] = []
        held = 0
        for pdf in by_group(batches, keys):
            size = min(map(len, pdf["odd"]))
            odd = np.stack([folded(x, size) for x in pdf["odd"]])
            n, comp, side, node = (pdf[c].to_numpy() for c in ("n", "comp", "side", "node"))
            within = pdf["b1"].iloc[0] == pdf["b2"].iloc[0]
            forest, met = Forest(len(pdf)), np.zeros(len(pdf), bool)
            for i in range(len(pdf)) if within else np.flatnonzero(side == 0):
                dist = np.bitwise_count(odd ^ odd[i]).sum(1, dtype=np.int64)
                good = (dist * (100 + percent) <= (n + n[i]) * (100 - percent)) & (comp != comp[i]) & (within | (side == 1))
                for j in np.flatnonzero(good):
                    forest.join(int(i), int(j))
                    met[i] = met[j] = True
            if not met.any():
                continue
            at = np.flatnonzero(met)
            root = np.array([forest.find(int(i)) for i in at])
            name = np.zeros(len(pdf), U64)
            np.add.at(name, root, mix64(node[at].astype(np.int64).view(U64) + U64(11)))
            out.append(pd.DataFrame({"grp": name[root].view(np.int64), "node": node[at], "comp": comp[at]}))
            held += len(at)
            if held > 20_000:
                yield pd.concat(out).drop_duplicates()
                out, held = [], 0
        if out:
            yield pd.concat(out).drop_duplicates()

    hoped = cut(rows.select(*keys, "node", "comp", "side", "n", "odd").mapInPandas(hope, "grp long, node long, comp long").distinct())
    full = hoped.join(_texts(docs, hoped.select("node")).hint("merge"), "node").repartition("grp").sortWithinPartitions("grp")

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in by_group(batches, ["grp"]):
            own, node = [_opened(z, words) for z in pdf["z"]], pdf["node"].tolist()
            forest, seen = Forest(len(own)), {}
            for i, c in enumerate(pdf["comp"].tolist()):
                forest.join(i, seen.setdefault(c, i))
            size = np.array([len(x) for x in own])
            flat, owner = np.concatenate(own), np.repeat(np.arange(len(own)), size)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            out = []
            for i in range(len(own)):
                lo, hi = np.searchsorted(flat, own[i], "left"), np.searchsorted(flat, own[i], "right")
                run_len = hi - lo
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(run_len)[:-1])), run_len) + np.arange(run_len.sum())
                inter = np.bincount(owner[at], minlength=len(own))
                for j in np.flatnonzero(100 * inter >= percent * (size[i] + size - inter)):
                    if j > i and forest.join(i, int(j)):
                        out.append((node[i], node[j]))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return full.select("grp", "node", "comp", "z").mapInPandas(link, "a long, b long")


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, block: int = 256) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; links reach ``percent`` of the union."""
    sets = cut(_sets(docs, words))
    member = cut(classes(sets.drop("odd")))
    # sorted, so that a key's rows stream by
    rep = member.select("doc_id", "rep", "n").dropDuplicates(["doc_id"])
    shared = cut(_keys(docs, words, percent).repartition("key").sortWithinPartitions("key").mapInPandas(_shared, "key long, node long"))
    keys = _uncommon(shared, rep.select(F.col("doc_id").alias("node"), "n"), percent)
    near = keys.repartition("key").sortWithinPartitions("key", "node").mapInPandas(_meetings(), "a long, b long, fam long").distinct()
    near = near.join(rep.toDF("a", "ra", "na").hint("merge"), "a").join(rep.toDF("b", "rb", "nb").hint("merge"), "b").where("ra <> rb")
    near = cut(near.select(F.col("ra").alias("a"), F.col("rb").alias("b"), (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).alias("fit"), "fam").distinct())
    nodes = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    odds = cut(sets.join(nodes.hint("merge"), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "n", "odd").dropDuplicates(["node"]))
    hope = cut(_hopeful(near.where("fit").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), odds, percent))
    links = cut(_verified(hope, docs, words, percent))
    comp = components(links)
    met = near.where("fam <> 0").select("fam", F.col("b").alias("node")).distinct()
    placed = met.join(comp.select(F.col("id").alias("node"), "comp").hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_fam = placed.groupBy("fam").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("fam")
    rest = cut(placed.join(open_fam.hint("merge"), "fam", "left_semi").join(odds.select("node", "n").hint("merge"), "node"))
    more = cut(_families(rest, odds, docs, words, percent, block))
    final = components(links.union(more))
    out = member.join(final.select(F.col("id").alias("rep"), "comp"), "rep", "left")
    # a class's representative and a component's least node are least doc_ids of what they stand for
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("comp", "rep")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates stays: the least doc_id, columns as they were.

    Rows without words all stay; rows that share a doc_id stay or go together.
    """
    (own,) = fresh(docs, "stay")
    stay = jaccard_components(docs, words, percent).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")
