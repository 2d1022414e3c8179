"""Byte-level BPE encoding and decoding over a segment tree.

A text is cut at the special tokens of the file, the rest into words by the
byte-level pattern.  A word starts as its bytes; a segment tree holds for every
adjacent pair its merge rank together with its place, so the root is the leftmost
pair of the lowest rank.  That pair is merged, and the leaves of the pair itself,
of the one before and of the one gone are updated, each along one path to the root,
until no pair of the tree can be merged.  Words of up to 64 bytes have their trees
side by side in arrays and take each step together; longer ones have one each.  A
distinct word is merged once a worker, in a cache of bounded size.

Defined results: a null or empty text has no ids and decodes to the empty text;
rows that repeat each get their row; an empty table gives an empty table; very
long texts and words are encoded whole (a word of n bytes takes n log n steps);
ids that form no whole characters decode to replacement characters; null ids
decode to null; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What Unicode has named letters or numbers after its version 16, which the
# served encoders know; to them these are neither.
_LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F),
    (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2),
    (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED),
    (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_NOT = "".join(rf"\U{a:08X}-\U{b:08X}" for a, b in _LATER)
# the byte-level pattern of the file format
_WORD = regex.compile(rf"'(?:[stmd]|re|ve|ll)| ?[\p{{L}}--[{_NOT}]]+| ?[\p{{N}}--[{_NOT}]]+| ?(?:[^\s\p{{L}}\p{{N}}]|[{_NOT}])+|\s+(?!\S)|\s+", regex.V1)
#: Below this code point the same classes are written out for the faster engine.
_LATIN = 0x250


def _latin_class(pattern: str) -> str:
    """The Latin code points of a class, as the inside of a bracket expression."""
    return "".join(f"\\u{c:04X}" for c in range(_LATIN) if regex.match(pattern, chr(c)) and not any(a <= c <= b for a, b in _LATER))


def _latin_word() -> re.Pattern:
    letter, number, space = (_latin_class(c) for c in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{letter}{number}{space}]+|[{space}]+(?![^{space}])|[{space}]+")


_LATIN_WORD, _BEYOND = _latin_word(), re.compile(f"[^\0-{chr(_LATIN - 1)}]")


def words_of(text: str) -> list[str]:
    return (_WORD if _BEYOND.search(text) else _LATIN_WORD).findall(text)


class PairTree:
    """A segment tree over adjacent pairs; each leaf is rank * length + place, or more than any where no merge applies."""

    def __init__(self, keys: list[int], none: int):
        self.none, self.width = none, 1 << max(0, len(keys) - 1).bit_length()
        self.nodes = [none] * self.width + keys + [none] * (self.width - len(keys))
        nodes = self.nodes
        for i in range(self.width - 1, 0, -1):
            a, b = nodes[2 * i], nodes[2 * i + 1]
            nodes[i] = a if a < b else b

    def root(self) -> int:
        return self.nodes[1]

    def put(self, place: int, key: int) -> None:
        nodes, i = self.nodes, self.width + place
        nodes[i] = key
        i >>= 1
        while i:
            a, b = nodes[2 * i], nodes[2 * i + 1]
            least = a if a < b else b
            if nodes[i] == least:
                break
            nodes[i] = least
            i >>= 1


class ByteModel:
    """One tokenizer file: vocabulary, merges, special tokens, and a cache of merged words."""

    def __init__(self, path: str, cache: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("not a plain byte-level BPE file")
        # each byte has a letter of its own in the file: visible ones themselves, the others from 256 on
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - shown))}
        byte = {c: b for b, c in letter.items()}
        vocab = model["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens") or ()):
            raise ValueError("special tokens that take in their surroundings are not handled")
        self.start = [vocab[letter[b]] for b in range(256)]
        self.merge: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[vocab[a] << 32 | vocab[b]] = rank, vocab[a + b]
        size = 1 + max([*vocab.values(), *added.values()])
        self.bytes_of = [b""] * size
        for piece, i in vocab.items():
            self.bytes_of[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode("utf-8")
        for piece, i in added.items():
            self.bytes_of[i] = piece.encode("utf-8")
        self.special = {text: np.array([i], "<u4").tobytes() for text, i in added.items()}
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        order = np.array(sorted(self.merge), np.int64)
        self.first, self.pairs = np.array(self.start, np.int64), order
        self.rank_at = np.array([self.merge[p][0] for p in order.tolist()], np.int64)
        self.made = np.zeros(len(order), np.int64)
        self.made[self.rank_at] = [self.merge[p][1] for p in order.tolist()]
        self.limit = cache
        self.cache: dict[str, bytes] = {}

    def merge_word(self, word: bytes) -> list[int]:
        """The word's bytes, merged lowest rank first; of equal ranks the leftmost."""
        part = [self.start[b] for b in word]
        n = len(part)
        if n < 2:
            return part
        merge = self.merge.get
        none = n * (len(self.merge) + 1)
        keys = [none if (got := merge(part[i] << 32 | part[i + 1])) is None else got[0] * n + i for i in range(n - 1)]
        tree = PairTree(keys, none)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def key(i: int) -> int:
            if after[i] >= n:
                return none
            got = merge(part[i] << 32 | part[after[i]])
            return none if got is None else got[0] * n + i

        while (top := tree.root()) < none:
            i = top % n
            j = after[i]
            part[i] = merge(part[i] << 32 | part[j])[1]
            part[j] = -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                tree.put(j, none)
            tree.put(i, key(i))
            if before[i] >= 0:
                tree.put(before[i], key(before[i]))
        return [p for p in part if p >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of ids, or -1."""
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((self.pairs[at] == pair) & (left >= 0) & (right >= 0), self.rank_at[at], -1)

    def merge_words(self, words: list[bytes], width: int) -> list[bytes]:
        """The ids of words of 1 to ``width`` bytes (a power of two), one tree a row of ``nodes``; node 1 is the root."""
        m, size = len(words), np.fromiter(map(len, words), np.int64, len(words))
        part = np.full((m, width + 1), -1, np.int64)
        part[np.arange(width + 1) < size[:, None]] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        none = np.int64((len(self.pairs) + 1) * width)
        place = np.arange(width)

        def keys(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.where(rank < 0, none, rank * width + at)

        nodes = np.full((m, 2 * width), none, np.int64)
        nodes[:, width:] = keys(self._ranks(part[:, :-1], part[:, 1:]), place)
        level = width
        while level > 1:
            nodes[:, level // 2 : level] = np.minimum(nodes[:, level : 2 * level : 2], nodes[:, level + 1 : 2 * level : 2])
            level //= 2
        after, before = np.tile(np.arange(1, width + 2), (m, 1)), np.tile(np.arange(-1, width), (m, 1))
        row = np.arange(m)
        while len(row := row[nodes[row, 1] < none]):
            rank, i = np.divmod(nodes[row, 1], width)
            j = after[row, i]
            k, h = after[row, j], before[row, i]
            part[row, i], part[row, j] = self.made[rank], -1
            after[row, i] = k
            before[row, np.minimum(k, width)] = i
            k = np.minimum(k, width)
            for leaf, key in ((j, none), (i, keys(self._ranks(part[row, i], part[row, k]), i)), (h, keys(self._ranks(part[row, h], part[row, i]), h))):
                # a first symbol has none before it: its path starts at an unused leaf of the root's own row
                node = np.where(leaf < 0, 0, width + leaf)
                nodes[row, node] = np.where(leaf < 0, none, key)
                for _ in range(width.bit_length() - 1):
                    node = node >> 1
                    nodes[row, node] = np.where(node > 0, np.minimum(nodes[row, 2 * node], nodes[row, 2 * node + 1]), none)
        keep = part >= 0
        ids = part[keep].astype("<u4").tobytes()
        ends = np.cumsum(keep.sum(1) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Merge words that the cache lacks; short ones are kept there, the others returned."""
        long: dict[str, bytes] = {}
        short: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode("utf-8")
            if len(raw) > 64:
                long[w] = np.array(self.merge_word(raw), "<u4").tobytes()
            else:
                short.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((w, raw))
        for width, rows in short.items():
            for at in range(0, len(rows), 8192):
                now = rows[at : at + 8192]
                self.cache.update(zip([w for w, _ in now], self.merge_words([b for _, b in now], width), strict=True))
        return long

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.cache) > self.limit:
            self.cache.clear()
        # at odd places of a cut text stand its special tokens
        runs = [self.cuts.split(t) if self.cuts else [t] for t in texts]
        words = [[words_of(r) for r in own[::2]] for own in runs]
        cache = self.cache
        long = self._learn({w for own in words for run in own for w in run if w not in cache})
        for own, marks in zip(words, runs, strict=True):
            out = []
            for n, run in enumerate(own):
                if n:
                    out.append(self.special[marks[2 * n - 1]])
                out.extend([cache[w] for w in run] if not long else [cache.get(w) or long[w] for w in run])
            yield np.frombuffer(b"".join(out), "<u4")

    def encode_all(self, texts: list[str], chars: int = 2_000_000) -> Iterator[np.ndarray]:
        """The ids of each whole text, as little-endian unsigned 32-bit integers; texts of some ``chars`` together share their new words."""
        run, held = [], 0
        for text in texts:
            run.append(text)
            held += len(text)
            if held >= chars:
                yield from self._encode(run)
                run, held = [], 0
        yield from self._encode(run)

    def encode(self, text: str) -> np.ndarray:
        return next(self._encode([text]))

    def decode(self, ids) -> str:
        """The text of the ids; bytes that form no character become replacement characters, ids of no token nothing."""
        ids, have = np.asarray(ids, np.int64), self.bytes_of
        ids = ids[(ids >= 0) & (ids < len(have))]
        return b"".join(map(have.__getitem__, ids.tolist())).decode("utf-8", "replace")


_models: dict[str, ByteModel] = {}


def load(path: str) -> ByteModel:
    if path not in _models:
        _models[path] = ByteModel(path)
    return _models[path]


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(path)
        for pdf in batches:
            ids = [i.astype(np.int32) for i in model.encode_all([t if isinstance(t, str) else "" for t in pdf["text"]])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [len(i) for i in ids], "ids": ids})

    return _kept_id(docs, "text").mapInPandas(run, "doc_id string, n_tokens long, ids array<int>").withColumn("doc_id", F.col("doc_id").cast("long"))


def decode_ids(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded) of every row of ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "decoded": [None if i is None else model.decode(i) for i in pdf["ids"]]})

    return _kept_id(tokens, "ids").mapInPandas(run, "doc_id string, decoded string").withColumn("doc_id", F.col("doc_id").cast("long"))


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ids and the text decoded from them, digested where they are made."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(path)
        for pdf in batches:
            rows = []
            for doc, ids in zip(pdf["doc_id"], model.encode_all([t if isinstance(t, str) else "" for t in pdf["text"]]), strict=True):
                rows.append((doc, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(model.decode(ids).encode("utf-8")).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = _kept_id(docs, "text").mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _kept_id(rows: DataFrame, column: str) -> DataFrame:
    """doc_id as text, so that a missing one does not turn the others into floats."""
    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), column)
