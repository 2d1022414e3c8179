"""SentencePiece encoding and decoding that keeps source offsets.

The normaliser walks the model's compiled character map (a double-array trie) by
longest prefix and notes for every normalised byte which source bytes it came
from.  Pieces are merged here, best score first and leftmost of equals, from
single characters; what the vocabulary lacks falls back to bytes.  Every piece is
then projected to its span of source bytes.  Where no piece holds a word mark
after another character (checked at load) a normalised text is cut before each
run of marks, and a distinct word is merged once per worker, in a cache of
bounded size.

For BPE models with byte pieces and without user-defined or unused ones; others
raise.  Defined results: a null or empty text has no ids and decodes to the empty
text; rows that repeat each get their row; an empty table gives an empty table;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: No piece; below every score.
_NONE = float("-inf")
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of one protocol-buffer message: ints, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        else:
            size = varint() if wire == 2 else 4 if wire == 5 else 8
            yield key >> 3, raw[at : at + size]
            at += size


class CharMap:
    """Longest-prefix replacement by a compiled character map; empty: identity."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        units = self.units
        node = (units[0] >> 10) << ((units[0] & 512) >> 6)
        best = None
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                best = (i + 1 - at, self.strings[start : self.strings.index(b"\0", start)])
        return best


class Alignment:
    """A normalised text, and for each of its bytes the source bytes [start, end) it stands for."""

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray):
        self.text, self.start, self.end = text, start, end


class PieceModel:
    """One model file: vocabulary, normaliser, merges, and a cache of merged words."""

    def __init__(self, path: str, cache: int = 800_000):
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces: list[str] = []
        self.score: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        self.chars, self.dummy, self.squeeze, self.escape = CharMap(b""), True, True, True
        kind = 1
        for number, value in fields(raw):
            if number == 1:
                got = dict(fields(value))
                piece, sort, n = got[1].decode("utf-8"), got.get(3, 1), len(self.pieces)
                if sort == 6:
                    self.byte_id[int(got[1][3:5], 16)] = n
                elif sort == 1:
                    self.score[piece], self.id_of[piece] = struct.unpack("<f", got[2])[0] if 2 in got else 0.0, n
                elif sort in (4, 5):
                    raise ValueError("user-defined and unused pieces are not handled")
                self.pieces.append(piece)
            elif number == 2:
                kind = dict(fields(value)).get(3, 1)
            elif number == 3:
                spec = dict(fields(value))
                self.chars = CharMap(spec.get(2, b""))
                self.dummy, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if kind != 2 or len(self.byte_id) != 256:
            raise ValueError("not a BPE model with byte pieces")
        self.mark = MARK if self.escape else " "
        self.by_word = self.escape and not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.score)
        byte_of = {i: bytes([b]) for b, i in self.byte_id.items()}
        self.bare = [byte_of.get(i, p.encode("utf-8")) for i, p in enumerate(self.pieces)]
        self.digits = [str(i) for i in range(len(self.pieces))]
        self.limit = cache
        #: word -> ids joined by commas, normalised bytes of each piece, what it decodes to (None: itself)
        self.cache: dict[str, tuple[str, bytes, str | None]] = {}
        if max(map(len, self.bare)) > 255:
            raise ValueError("a piece of more than 255 bytes")

    def normalise(self, text: str) -> Alignment:
        src = text.encode("utf-8")
        if not src:
            return Alignment("", np.empty(0, np.int64), np.empty(0, np.int64))
        if self.chars.units or self.squeeze:
            return self._mapped(src)
        data = np.frombuffer(src, np.uint8)
        head = np.flatnonzero(data & 0xC0 != 0x80)
        size = np.diff(np.concatenate((head, [len(data)])))
        start, end = np.repeat(head, size), np.repeat(head + size, size)
        mark = len(self.mark.encode())
        if mark > 1:
            times = np.where(data == 32, mark, 1)
            start, end = np.repeat(start, times), np.repeat(end, times)
        lead = np.zeros(mark if self.dummy else 0, np.int64)
        return Alignment((self.mark if self.dummy else "") + text.replace(" ", self.mark), np.concatenate((lead, start)), np.concatenate((lead, end)))

    def _mapped(self, src: bytes) -> Alignment:
        out, start, end, at = bytearray(), [], [], 0
        mark = self.mark.encode()

        def put(piece: bytes, lo: int, hi: int) -> None:
            made = piece.replace(b" ", mark)
            out.extend(made)
            start.extend([lo] * len(made))
            end.extend([hi] * len(made))

        if self.dummy and (not self.squeeze or src.strip(b" ")):
            put(b" ", 0, 0)
        space = self.squeeze
        while at < len(src):
            hit = self.chars.longest(src, at) if self.chars.units else None
            if hit is None:
                lead = src[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = (n, src[at : at + n])
            n, piece = hit
            if self.squeeze:
                while space and piece.startswith(b" "):
                    piece = piece[1:]
                if piece:
                    space = piece.endswith(b" ")
            put(piece, at, at + n)
            at += n
        if self.squeeze:
            while out.endswith(mark):
                del out[-len(mark) :], start[-len(mark) :], end[-len(mark) :]
        return Alignment(out.decode("utf-8"), np.array(start, np.int64), np.array(end, np.int64))

    def merge(self, word: str) -> list[str]:
        """The word's characters, joined best score first; of equal scores the leftmost."""
        parts, score = list(word), self.score.get
        if len(parts) > 64:
            return self._merge_long(parts)
        worth = [score(a + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while worth:
            best = max(worth)
            if best == _NONE:
                break
            i = worth.index(best)
            both = parts[i] = parts[i] + parts.pop(i + 1)
            del worth[i]
            if i < len(worth):
                worth[i] = score(both + parts[i + 1], _NONE)
            if i:
                worth[i - 1] = score(parts[i - 1] + both, _NONE)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same over a heap of neighbours, for words of any length."""
        n, score = len(parts), self.score
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                both = parts[i] + parts[j]
                got = score.get(both)
                if got is not None:
                    heapq.heappush(heap, (-got, i, j, both))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not parts[i] or not parts[j] or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p]

    def _word(self, word: str) -> tuple[str, bytes, str | None]:
        ids: list[int] = []
        for piece in self.merge(word):
            known = self.id_of.get(piece)
            if known is not None:
                ids.append(known)
            else:
                ids.extend([self.byte_id[b] for b in piece.encode("utf-8")])
        bare = [self.bare[i] for i in ids]
        back = b"".join(bare).decode("utf-8", "replace")
        made = ",".join([self.digits[i] for i in ids]), bytes(map(len, bare)), None if back == word else back.replace(MARK, " ")
        if len(self.cache) >= self.limit:
            self.cache.clear()
        self.cache[word] = made
        return made

    def encode(self, text: str) -> tuple[str, np.ndarray, np.ndarray, str]:
        """(ids joined by commas, start and end of each piece in the source's bytes, the decoded text)."""
        norm = self.normalise(text)
        if not norm.text:
            return "", norm.start, norm.end, ""
        cache, make = self.cache, self._word
        words = _WORD.findall(norm.text) if self.by_word else [norm.text]
        got = [cache.get(w) or make(w) for w in words]
        ids, sizes, backs = zip(*got, strict=True)
        stop = np.cumsum(np.frombuffer(b"".join(sizes), np.uint8), dtype=np.int64)
        back = norm.text.replace(MARK, " ") if backs.count(None) == len(backs) else "".join([w.replace(MARK, " ") if b is None else b for w, b in zip(words, backs, strict=True)])
        # bytes of one character all stand for the whole of it, so a piece spans whole characters
        return ",".join(ids), norm.start[np.concatenate(([0], stop[:-1]))], norm.end[stop - 1], back[1:] if self.dummy else back


_models: dict[str, PieceModel] = {}


def load(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_pieces(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded, starts, ends) of every whole text; spans are source bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(path)
        for pdf in batches:
            got = [model.encode(t) if isinstance(t, str) else model.encode("") for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [len(g[1]) for g in got], "ids": [g[0] for g in got], "decoded": [g[3] for g in got], "starts": [g[1] for g in got], "ends": [g[2] for g in got]})

    return _kept_id(docs).mapInPandas(run, "doc_id string, n_tokens long, ids string, decoded string, starts array<long>, ends array<long>").withColumn("doc_id", F.col("doc_id").cast("long"))


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256): the same, digested where it is made.

    ``spans_sha256`` is that of the start and the end of every piece as
    little-endian 32-bit numbers, side by side.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids, start, end, back = model.encode(text if isinstance(text, str) else "")
                spans = np.stack((start, end), 1).astype("<u4").tobytes()
                rows.append((doc, len(start), sha(ids), sha(back), hashlib.sha256(spans).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    out = _kept_id(docs).mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _kept_id(docs: DataFrame) -> DataFrame:
    """doc_id as text, so that a missing one does not turn the others into floats."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
