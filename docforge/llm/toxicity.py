"""Toxic texts by a lexicon trie met by Levenshtein automata, and its context.

The lexicon (whole words, and stems for inflecting languages) and the weights
are learnt on a bounded sample of labelled rows.  The trie of its terms is
intersected with Levenshtein automata (one error: a letter more, less, other, or
two swapped) and made deterministic, so every word of every text is judged by
table look-ups, all words side by side; a digit or mark inside a word is such a
letter too.  Errors in words of less than ``fuzzy_from`` letters, in stems and in words
under stems have weights of their own.  Two errors in one word are not met.  Each
hit is read in a window of characters around it: quotation marks or a
reporting verb mark a quotation and weaken the hit.  A logistic model over the
summed hits gives the score.

Defined results: null and empty texts are scored as texts without a hit; null
labels are never learnt from; without both labels in the sample every score is
the share of label 1 (0 without rows); repeated rows each get their row;
further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm.common import cut, least_rows
from docforge.llm.kernels import mix64

_QUOTE = re.compile(r"[\"“”„«»‘]|\b(?:said|says|wrote|quoted|called|sagte|schrieb|nannte|dit|écrit|appelé|dijo|escribió|llamó)\b", re.I)
_TOKEN = re.compile(r"[^\W\d_]+")
_WORD = re.compile(r"\w+")
#: How a term was met: as it is, a long word with an error, a stem, a word of 3 to 5 letters with an error, a stem with an error, a word under a stem with an error.
EXACT, FUZZY, STEM, SHORT, NEAR, UNDER = 1, 2, 3, 4, 5, 6
_BLANK = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


#: The letters of _TOKEN, of every script.
_LETTERS = np.array([c.isalnum() and not c.isdecimal() for c in map(chr, range(0x110000))])


class Matcher:
    """Deterministic table of (lexicon trie x Levenshtein automata)."""

    def __init__(self, words: list[str], stems: list[str], fuzzy_from: int = 6):
        chars = sorted({c for t in [*words, *stems] for c in t})
        self.cls = np.zeros(ord(chars[-1]) + 2 if chars else 1, np.uint16)  # 0: a letter of no term, as the last one is
        for i, c in enumerate(chars, 1):
            self.cls[ord(c)] = i
        n_cls = len(chars) + 1
        index = {c: i for i, c in enumerate(chars, 1)}
        # tries by root: exact terms, long words, short words, stems, words under a stem; children, and what ends at a node
        kids: list[dict[int, int]] = [{} for _ in range(5)]
        ends: list[set[int]] = [set() for _ in range(5)]

        def add(term: str, kind: int, root: int) -> None:
            at = root
            for c in term:
                k = index[c]
                if k not in kids[at]:
                    kids.append({})
                    ends.append(set())
                    kids[at][k] = len(kids) - 1
                at = kids[at][k]
            ends[at].add(kind)

        for w in words:
            if any(w.startswith(s) for s in stems):
                add(w, UNDER, 4)
            else:
                add(w, EXACT, 0)
                add(w, *((FUZZY, 1) if len(w) >= fuzzy_from else (SHORT, 2)))
        for w in stems:
            add(w, STEM, 0)
            add(w, NEAR, 3)

        root_of, todo = {k: k for k in range(5)}, [*range(5)]
        while todo:
            at = todo.pop()
            for k in kids[at].values():
                root_of[k] = root_of[at]
                todo.append(k)
        past_near = (-1, 0)  # a misspelt stem was read, whatever follows

        def close(states: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
            """A missing letter: step to a child, one error more (in a stem only before a letter that is there)."""
            out = set(states)
            for node, e in states:
                if e == 0 and node >= 0 and root_of[node] in (1, 2, 4):
                    out |= {(k, 1) for k in kids[node].values()}
            return frozenset(out)

        def step(state: frozenset[tuple[int, int]], c: int) -> frozenset[tuple[int, int]]:
            """States of (node, errors); 2 + class is the first of two swapped letters, its class still to come."""
            nxt: set[tuple[int, int]] = set()
            for node, e in state:
                if node == -1:
                    nxt.add(past_near)
                elif e >= 2:
                    if e - 2 == c:
                        nxt.add((node, 1))
                else:
                    if c in kids[node]:
                        nxt.add((kids[node][c], e))
                    if e == 0 and root_of[node]:
                        nxt.add((node, 1))
                        for a, k in kids[node].items():
                            nxt.add((k, 1))
                            if c in kids[k]:
                                if a != c:
                                    nxt.add((kids[k][c], 2 + a))
                                if root_of[node] == 3:
                                    nxt.add((kids[k][c], 1))
            if any(e < 2 and node >= 0 and NEAR in ends[node] for node, e in nxt):
                nxt = {(n, e) for n, e in nxt if n < 0 or root_of[n] != 3} | {past_near}
            return close(nxt)

        def kinds_of(state: frozenset[tuple[int, int]]) -> set[int]:
            got = {x for node, e in state if node >= 0 and e < 2 for x in ends[node] if x in (FUZZY, SHORT, UNDER) or e == 0}
            return got | ({NEAR} if past_near in state else set())

        start = close({(k, 0) for k in range(5)})
        number, rows, outs, work = {frozenset(): 0, start: 1}, {0: [0] * n_cls}, {0: 0}, [start]
        while work:
            state = work.pop()
            kinds = kinds_of(state)
            outs[number[state]] = next((k for k in (EXACT, STEM, FUZZY, UNDER, SHORT, NEAR) if k in kinds), 0)
            if STEM in kinds:  # whatever follows
                rows[number[state]] = [number[state]] * n_cls
                continue
            # all letters that no state waits for lead to the same place
            apart = {0}
            for node, e in state:
                if node >= 0:
                    apart |= {e - 2} if e >= 2 else set(kids[node])
                    if e == 0 and root_of[node]:
                        apart |= {c for k in kids[node].values() for c in kids[k]}
            row: list[int] = []
            for c in range(n_cls):
                if c and c not in apart:
                    row.append(row[0])
                    continue
                key = step(state, c)
                if key not in number:
                    number[key] = len(number)
                    work.append(key)
                row.append(number[key])
            rows[number[state]] = row
        self.table = np.array([rows[i] for i in range(len(number))], np.int32)
        self.out = np.array([outs[i] for i in range(len(number))], np.int8)

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(kind, start, end) of every word of the text that the table accepts."""
        low = text.lower()
        cp = np.frombuffer(low.encode("utf-32-le", "replace"), np.uint32)
        if not len(cp):
            return []
        letter = _LETTERS[cp]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False])).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        if not len(start):
            return []
        cls = self.cls[np.minimum(cp, len(self.cls) - 1)]
        found = self._walk(cls, start, end)
        # a word misspelt with one digit or mark inside is two runs of letters; it counts where neither run is a hit
        held = {a for _, a, _ in found}
        mark = end[:-1][start[1:] - end[:-1] == 1]
        mark = mark[~np.isin(cp[mark], _BLANK)]
        first, last = start[np.searchsorted(end, mark)], end[np.searchsorted(start, mark + 1)]
        split = [h for h in self._walk(np.where(letter, cls, 0), first, last) if h[1] not in held]
        split = [(k, a, z) for k, a, z in split if k not in (EXACT, STEM) and not any(m in held for m in (mark[(mark > a) & (mark < z)] + 1).tolist())]
        return sorted(found + split, key=lambda h: h[1])

    def _walk(self, cls: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int]]:
        """The accepted ones of the given ranges, all walked side by side."""
        found: list[tuple[int, int, int]] = []
        live, state, step = np.arange(len(start)), np.ones(len(start), np.int32), 0
        table, out = self.table, self.out
        size = end - start
        while len(live):
            state = table[state, cls[start[live] + step]]
            step += 1
            last = size[live] == step
            for i, s in zip(live[last], state[last], strict=True):
                if out[s]:
                    found.append((int(out[s]), int(start[i]), int(end[i])))
            go = ~last & (state != 0)
            live, state = live[go], state[go]
        return found


def quoted(text: str, start: int, end: int, around: int = 48) -> bool:
    """Whether the window around a hit speaks of what others said."""
    return bool(_QUOTE.search(text[max(0, start - around) : start])) and bool(_QUOTE.search(text[max(0, start - around) : end + around]))


class Model:
    def __init__(self, words: list[str], stems: list[str], base: float):
        self.words, self.stems = words, stems
        self.matcher = Matcher(words, stems)
        self.plain: frozenset[str] = frozenset()
        self.w = np.array([math.log(max(base, 1e-3) / max(1 - base, 1e-3)), *[0.0] * 8])

    def features(self, text: str) -> np.ndarray:
        """1; whether words hit, and how often; whether misspelt words do; the same of stems; misspelt short words, stems, and words under stems.

        A quoted hit counts a quarter; a word of clean texts is no misspelling.
        """
        sums = [0.0] * 6
        low = text.lower()
        for kind, a, b in self.matcher.hits(text):
            if kind in (EXACT, STEM) or low[a:b] not in self.plain:
                sums[kind - 1] += 0.25 if quoted(low, a, b) else 1.0
        exact, fuzzy, stem, short, near, under = sums
        return np.array([1.0, min(1.0, exact), min(3.0, math.log1p(exact)), min(1.0, fuzzy), min(1.0, stem), min(3.0, math.log1p(stem)), min(1.0, short), min(1.0, near), min(1.0, under)])

    def learn_plain(self, texts: list[str], y: np.ndarray) -> None:
        """Words an error away from a term that are words of their own: as frequent in clean texts as in toxic ones."""
        seen: list[Counter] = [Counter(), Counter()]
        for text, v in zip(texts, y, strict=True):
            low = text.lower()
            seen[int(v)].update({low[a:b] for kind, a, b in self.matcher.hits(text) if kind not in (EXACT, STEM)})
        n = max(1, int(sum(y))), max(1, len(y) - int(sum(y)))
        self.plain = frozenset(w for w, k in seen[0].items() if k > 1 and k / n[1] >= seen[1][w] / n[0])

    def fit(self, texts: list[str], y: np.ndarray, weight: np.ndarray) -> None:
        self.learn_plain(texts, y)
        x = np.array([self.features(t) for t in texts])
        w = self.w
        for _ in range(60):  # Newton steps of a lightly damped logistic fit
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (weight * (p - y)) + 0.02 * w
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(len(w))
            step = np.clip(np.linalg.solve(h, g), -1.0, 1.0)
            w = w - step
            if np.abs(step).max() < 1e-6:
                break
        if not x[:, 3].any():  # no misspelt term in either class: weaker than the term itself
            w[3] = 0.8 * (w[1] + w[2] * math.log(2))
        if not x[:, 6].any():  # an error is a larger part of a short word
            w[6] = 0.5 * (w[1] + w[2] * math.log(2))
        if not x[:, 7].any():
            w[7] = 0.5 * (w[4] + w[5] * math.log(2))
        if not x[:, 8].any():
            w[8] = 0.8 * (w[4] + w[5] * math.log(2))
        self.w = w

    def score(self, text: str) -> float:
        z = float(self.features(text) @ self.w)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _shingles(ids: np.ndarray) -> np.ndarray:
    """A number for each three words in a row; of a shorter text one for all of it."""
    a = np.concatenate((ids + 1, np.zeros(max(0, 3 - len(ids)), ids.dtype))).astype(np.uint64)
    return mix64(mix64(mix64(a[:-2]) + a[1:-1]) + a[2:])


def _own_words(texts: list[str], y: list[int], percent: int = 80) -> tuple[list[str], list[np.ndarray]]:
    """All words, and the numbers of those of each text, those left out that a near-copy before it in the same label already said.

    A near-copy shares ``percent`` of its whole set of word triples with an
    earlier text.  It still speaks for every word that no shared triple holds,
    so neither a common header nor a copied text hides what is new in a text.
    Two such sets share one of their rarest triples, which is where they meet.
    """
    number: dict[str, int] = {}
    ids = [np.fromiter((number.setdefault(w, len(number)) for w in _WORD.findall(t.lower())), np.uint32) for t in texts]
    names = list(number)
    del number
    out = [np.unique(x) for x in ids]
    for label in set(y):
        mine = [i for i, v in enumerate(y) if v == label and len(ids[i])]
        sets = {i: np.unique(_shingles(ids[i])) for i in mine}
        if not sets:
            continue
        every, count = np.unique(np.concatenate(list(sets.values())), return_counts=True)
        met: dict[int, list[int]] = defaultdict(list)
        for i in mine:
            own = sets[i]
            often = count[np.searchsorted(every, own)]
            rare = np.lexsort((own, often))[: len(own) - -(-percent * len(own) // 100) + 1]
            rare = own[rare[often[rare] > 1]].tolist()  # what stands in one text only meets none
            best, first = 0.0, -1
            for k in sorted({k for r in rare for k in met.get(r, ())}):
                other = sets[k]
                if 100 * min(len(own), len(other)) < percent * max(len(own), len(other)):
                    continue
                both = len(np.intersect1d(own, other, assume_unique=True))
                like = both / (len(own) + len(other) - both)
                if 100 * like >= percent and like > best:
                    best, first = like, k
            if first < 0:
                for r in rare:
                    met[r].append(i)
                continue
            said = np.isin(_shingles(ids[i]), sets[first])
            held = np.zeros(max(3, len(ids[i])), bool)
            for k in range(3):
                held[k : k + len(said)] |= said
            out[i] = np.unique(ids[i][~held[: len(ids[i])]])
    return names, out


def lexicon(texts: list[str], y: list[int], support: float = 0.006, stem_support: float = 0.03, purity: float = 0.97) -> tuple[list[str], list[str]]:
    """Words and stems that stand in toxic texts and hardly elsewhere.

    Greedy: the term that adds most texts not yet explained comes first, so
    words that only share a copied text with a term are not taken.  What copies
    and near-copies of one label repeat counts once.
    """
    has: dict[str, set[int]] = defaultdict(set)
    clean: Counter = Counter()
    toxic = [i for i, v in enumerate(y) if v]
    n_clean = max(1, len(y) - len(toxic))
    names, own = _own_words(texts, y)
    for i in range(len(texts)):
        words = {w for k in own[i].tolist() for w in _TOKEN.findall(names[k])}
        terms = {w for w in words if 3 <= len(w) <= 24} | {w[:k] + "*" for w in words for k in (4, 5) if len(w) > k}
        if y[i]:
            for t in terms:
                has[t].add(i)
        else:
            clean.update(terms)
    # by chance alone no term of so many would stand in this many toxic texts only
    least_hits = (math.log(len(has) + 1) + 2) / max(0.1, math.log(len(y) / max(1, len(toxic))))
    pure: dict[str, set[int]] = {}
    for t, at in has.items():
        least = (stem_support if t.endswith("*") else support) * len(toxic)
        hit, miss = len(at) / max(1, len(toxic)), clean[t] / n_clean
        if len(at) >= max(3, least, least_hits) and hit / (hit + miss) >= purity:
            pure[t] = at
    taken: list[str] = []
    # a stem stands for its words where it reaches many more texts than any of them
    most: Counter = Counter()
    for t, at in pure.items():
        if not t.endswith("*"):
            for k in (4, 5):
                most[t[:k] + "*"] = max(most[t[:k] + "*"], len(at))
    pure = {t: at for t, at in pure.items() if not t.endswith("*") or most[t] <= 0.8 * len(at)}
    left = {t: set(s) for t, s in pure.items()}
    open_texts = set(toxic)
    while left:
        best = max(left, key=lambda t: (len(left[t] & open_texts), len(left[t]), not t.endswith("*"), t))
        if len(left[best] & open_texts) < max(3, support * len(toxic) / 2):
            break
        taken.append(best)
        open_texts -= left.pop(best)
    # words as frequent as those taken belong to the lexicon too, though every text has another
    floor = min((len(pure[t]) for t in taken if not t.endswith("*")), default=len(toxic))
    stems = [t[:-1] for t in taken if t.endswith("*")]
    stems = [s for s in stems if not any(s != o and s.startswith(o) for o in stems)]
    # words under a stem are met by it as they are, and by their own automaton where they are misspelt
    words = [t for t in pure if not t.endswith("*") and (t in taken or len(pure[t]) >= max(floor / 2, 0.05 * len(toxic)) or any(t.startswith(s) for s in stems))]
    return sorted(words), sorted(stems)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2500) -> Model:
    """Learn from at most ``per_class`` labelled texts of each label, those with the least hash of doc_id.

    A doc_id labelled both ways counts as toxic; of rows that share one, the
    greatest text is learnt from.
    """
    rows = labels.where("toxic is not null and crc32(cast(doc_id as string)) % 5 <> 0").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    pick = least_rows(rows, "toxic", ["h", "doc_id"], per_class).select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_y"))
    pick = cut(pick)  # a bounded table of ids
    met = docs.select("doc_id", "text").join(F.broadcast(pick), F.col("doc_id") == F.col("_id"))
    # texts move through no exchange, unless some doc_id is given twice
    if not met.groupBy("doc_id").count().where("count > 1").isEmpty():
        met = met.groupBy("doc_id", "_y").agg(F.max("text").alias("text"))
    got = met.select("doc_id", "text", "_y").collect()
    share = labels.where("toxic is not null and crc32(cast(doc_id as string)) % 5 <> 0").agg(F.avg("toxic"), F.count("*")).first()
    base = float(share[0] or 0.0)
    got = sorted(((r["doc_id"], r["text"] or "", int(r["_y"])) for r in got), key=lambda r: (r[0], r[1]))
    texts, y = [r[1] for r in got], [r[2] for r in got]
    n = sum(y)
    if not n or n == len(y):
        return Model([], [], base)
    model = Model(*lexicon(texts, y), base)
    weight = np.where(np.array(y) == 1, base / n, (1 - base) / (len(y) - n)) * len(y)
    model.fit(texts, np.array(y), weight)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = [model.score(t if isinstance(t, str) else "") for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "score": s, "predicted": [int(v >= 0.5) for v in s]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, columns as they were."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("int")
    def judge(text: pd.Series) -> pd.Series:
        return pd.Series([int(model.score(t if isinstance(t, str) else "") >= 0.5) for t in text], dtype="int32")

    return docs.where(judge("text") == 0)
