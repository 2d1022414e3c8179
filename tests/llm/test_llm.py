"""Each operator against a brute-force form, over nulls, empties, repeats and long texts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from docforge.llm import embed, exact, kernels, langid, ngramjoin, packing, pieces, pii, substring, suffix, toxicity

GAP = "\x20\x09-\x0d"
COUNTED = " ".join(map(str, range(60)))
TEXTS = [
    "", None, "a", "A b", "a b c d", "a B c D", "  a\tb\x0bc d ", "a" * 500, "ab" * 200, "x y " * 100, "é" * 120, "\0" * 150, "w\x1cv " * 80,
    COUNTED, COUNTED, COUNTED + " tail", "head " + COUNTED, "q " + " ".join(map(str, range(5, 50))), "😀 漢字 ▁x  y ", "long " * 30_000,
    "call +1 (017) 555-7713 or a@b.c_x@d.e, 4111 1111 1111 1111, 1.2.3.4.5.6.7.8 300.1.1.1.1 000000001.2.3.255", "x" * 30_000 + "@a.b", "a@" + "b." * 20_000 + "c", "(1" * 3000,
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "<|endoftext|> and <s>",
]


@pytest.fixture(scope="module")
def docs(spark):
    from docforge.llm.common import ship

    ship(spark)
    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r[0], r[1]) for r in some] + [(10_000 + i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(i, t, "en", 1, 2, "k", "s") for i, t in rows], "doc_id long, text string, lang string, n long, start long, key string, _t string")
    return df.repartition(5).cache(), rows


def by_id(df):
    rows = df.collect()
    out = {r["doc_id"]: r.asDict() for r in rows}
    assert len(out) == len(rows)
    return out


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, n_chars long")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def test_exact(docs):
    df, rows = docs
    got = by_id(exact.exact_groups(df))
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(f"[{GAP}]", "", t or "")].append((-len(t or ""), i))
    for key, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (keep, len(members), i == keep, sha(key))


def test_cuckoo_index_grows_and_forgets():
    index = exact.CuckooIndex(buckets=2)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        index.put(k, i)
    assert all(index.get(k) == i for i, k in enumerate(keys))
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert all((index.get(k) is None) == (i % 2 == 0) for i, k in enumerate(keys))


def test_private(docs):
    df, rows = docs
    got = by_id(pii.find_private(df))
    for i, t in rows:
        t, out = t or "", []
        out += [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)] if "@" in t else []
        out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = [int(c) for c in m[0] if c.isdigit()][::-1]
            if 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else x * 2 // 10 + x * 2 % 10 for k, x in enumerate(d)) % 10 == 0:
                out.append(("card", m))
        out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
        want = ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)
        assert got[i]["base_sha256"] == sha(want) and got[i]["spans"].startswith(want)
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(x == k for x, _ in out) for k in pii.BASE]
    assert any("secret:" in r["spans"] for r in got.values())
    red = by_id(pii.redact(df))
    assert red[10_020]["text"].startswith("call [PHONE] or [EMAIL][EMAIL]") and red[10_001]["text"] is None
    assert set(pii.redact(df).columns) == set(df.columns)


def test_suffix(docs):
    df, rows = docs
    first, raw = {}, {i: (t or "").encode() for i, t in rows}
    for i in sorted(raw):
        for s in range(len(raw[i]) - 99):
            first.setdefault(raw[i][s : s + 100], (i, s))
    got = by_id(suffix.byte_digests(df))
    for i, b in raw.items():
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if first[b[s : s + 100]] != (i, s):
                gone[s : s + 100] = b"\1" * 100
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)), i


def test_two_stage_sorts_suffixes():
    rng = np.random.default_rng(1)
    for text in (rng.integers(0, 3, 700), rng.integers(97, 100, 900), np.zeros(40, int), np.array([5]), np.array([], int)):
        raw = text.astype(np.uint8)
        assert suffix.two_stage(raw, len(raw) + 8).tolist() == sorted(range(len(raw)), key=lambda k: raw.tobytes()[k:])


def test_substring(docs):
    df, rows = docs
    words = {i: re.findall(f"[^{GAP}]+", t or "") for i, t in rows}
    count = Counter(tuple(w[s : s + 35]) for w in words.values() for s in range(len(w) - 34))
    got = by_id(substring.word_digests(df))
    for i, w in words.items():
        gone = [0] * len(w)
        for s in range(len(w) - 34):
            if count[tuple(w[s : s + 35])] > 1:
                gone[s : s + 35] = [1] * 35
        kept = " ".join(x for x, y in zip(w, gone, strict=True) if not y)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), sum(gone), sha(kept)), i


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard(docs, n, percent):
    df, rows = docs
    sets, up = {}, {}
    for i, t in rows:
        w = re.findall(f"[^{GAP}]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i], up[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set(), i

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            inter = len(sets[a] & sets[b]) if sets[a] and sets[b] else 0
            if inter and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    got = by_id(ngramjoin.jaccard_components(df, n, percent))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(s), find(i)) for i, s in sets.items()}


def test_families_do_not_miss_links(spark):
    """Variants of one base that link only through others, over several blocks."""
    rng = np.random.default_rng(4)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for at in rng.choice(120, 3, replace=False):
            w[at] = f"v{i}x{at}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.jaccard_components(df, 4, 70, block=8).collect()}
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(117)} for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 70 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in sets}


def test_pieces(docs):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    df, rows = docs
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(pieces.piece_digests(df, path))
    for i, t in rows:
        ids = library.encode(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
        # brute force: the library's own offsets; the bytes of one character all stand for the whole of it
        raw, spans = t or "", []
        proto = library.encode(raw, return_type="proto").pieces if raw else []
        source = raw.encode()
        for piece in proto:
            lo, hi = piece.begin, piece.end
            if re.fullmatch("<0x[0-9A-F]{2}>", piece.piece):
                hi = lo + 1
                while hi < len(source) and source[hi] & 0xC0 == 0x80:
                    hi += 1
            spans.append((lo, hi))
        assert got[i]["spans_sha256"] == sha(np.array(spans, "<u4").tobytes())
    out = pieces.encode_pieces(df.where("doc_id = 10003"), path).first()
    assert out["ids"] and len(out["starts"]) == out["n_tokens"]


def test_long_words_merge_as_short_ones():
    import public_tokenizers

    model = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    r = np.random.default_rng(2)
    for _ in range(40):
        word = "▁" + "".join(r.choice(list("abcdeéßthin漢"), 40))
        assert model._merge_long(list(word)) == model.merge(word)


def test_a_map_moves_spans_with_it():
    import public_tokenizers

    model = pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))

    class Mapped:
        units = (1,)

        def longest(self, src, at):
            return (2, b"fi") if src[at : at + 2] == b"\xc3\x9f" else (3, b"") if src[at : at + 3] == "漢".encode() else None

    model.chars = Mapped()
    made = model.normalise("aß 漢b")
    assert made.text == "▁afi▁b"
    assert made.start.tolist() == [0, 0, 0, 0, 1, 1, 3, 3, 3, 7] and made.end.tolist() == [0, 0, 0, 1, 3, 3, 4, 4, 4, 8]
    ids, start, end, back = model.encode("aß 漢b")
    assert back == "afi b" and start[0] == 0 and end[-1] == 8 and (start <= end).all()


def test_character_map_takes_the_longest_prefix():
    import struct

    # a double array for "a" -> "x" and "ab" -> "y"; offsets are kept small by hand
    units = [0] * 512
    place = lambda node, offset, leaf: (offset << 10) | (leaf << 8)
    units[0] = place(0, 1, 0)
    a = 1 ^ ord("a")
    units[a] = place(a, 256, 1) | ord("a")
    leaf = a ^ 256
    units[leaf] = 0x80000000
    b = leaf ^ ord("b")
    units[b] = place(b, 128, 1) | ord("b")
    units[b ^ 128] = 0x80000000 | 2
    blob = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + b"x\0y\0"
    m = pieces.CharMap(blob)
    assert m.longest(b"ab", 0) == (2, b"y") and m.longest(b"ac", 0) == (1, b"x") and m.longest(b"c", 0) is None


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    df, rows = docs
    out = packing.pack_documents(df, path).collect()
    at, seqs = defaultdict(list), defaultdict(list)
    for r in out:
        at[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        here = sorted(at[i], key=lambda r: r["start"])
        assert sum(r["length"] for r in here) == len(ids) and all(r["doc_tokens"] == len(ids) for r in here)
        pos = 0
        for r in here:
            assert r["start"] == pos and r["ids_crc32"] == zlib.crc32(np.array(ids[pos : pos + r["length"]], "<u4").tobytes())
            pos += r["length"]
    for s in seqs.values():
        pos = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == pos
            pos += r["length"]
        assert pos <= 1024


def test_differencing_balances():
    sizes = np.random.default_rng(2).integers(1, 256, 300).tolist()
    sums = [s for s, _ in packing.difference(sizes, 40)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= 32
    assert all(sum(sizes[j] for j in w) <= 1024 for w in packing.pack(sizes, 1024))


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 16))
    x = np.concatenate([base + rng.normal(scale=0.05, size=base.shape) for _ in range(6)])
    rows = [(i, v.tolist(), int(i % 30 % 3)) for i, v in enumerate(x)] + [(500 + k, x[0].tolist(), 0) for k in range(40)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] + [1.0] * 15, 1), (904, x[0].tolist(), None), (905, [], 1), (906, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embed.vector_links(df, block=16).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows if i < 900]
    want = {i: sum(j != i and lab == m and float(u @ w) >= 0.98 for j, w, m in good) for i, u, lab in good}
    found = sum(min(got[i]["n_links"], n) for i, n in want.items())
    assert found >= 0.9 * sum(want.values()) and all(got[i]["n_links"] <= n for i, n in want.items())
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(900, 907))
    assert all(got[500 + k]["component_id"] == got[0]["component_id"] for k in range(40))


def test_language(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(df, per_lang=100, steps=120)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !!", "en"), (4, "word " * 40_000, None)], "doc_id long, text string, lang string")
    got = by_id(langid.predict(odd, model))
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] != "und"
    held = df.where("crc32(cast(doc_id as string)) % 3 = 1")
    pred = by_id(langid.predict(held, model))
    truth = {r["doc_id"]: r["lang"] for r in held.collect()}
    assert np.mean([pred[i]["lang_pred"] == v for i, v in truth.items()]) > 0.95
    assert langid.train(odd.where("lang = 'xx'")) is None
    assert by_id(langid.predict(odd, None))[4]["lang_pred"] == "und"


def test_gradients():
    model = langid.ByteGru(["a", "b"], hidden=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    data, y, mask = np.array([[5, 6, 7], [8, 5, 6]], np.uint8), np.array([0, 1]), np.ones((2, 3), bool)
    _, g = model.grads(data, y, mask)
    for k, at in (("u", (0, 1, 4)), ("v", (1, 2, 0)), ("x", (1, 6, 5)), ("b", (1,))):
        old = model.p[k][at]
        model.p[k][at] = old + 1e-2
        up = model.grads(data, y, mask)[0]
        model.p[k][at] = old - 1e-2
        down = model.grads(data, y, mask)[0]
        model.p[k][at] = old
        assert abs((up - down) / 2e-2 - g[k][at]) < 2e-3


def test_toxicity(spark):
    texts = [(i, f"text number {i} " + ("you utter blockhead " if i % 4 == 0 else "good words ") + f"more{i % 7}") for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in texts] + [(401, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert "blockhead" in model.words
    assert model.score("you blockhed") > model.score("you there")
    assert model.score('he said "you blockhead" to them') < model.score("you blockhead")
    got = by_id(toxicity.score(docs.union(spark.createDataFrame([(900, None), (901, "")], docs.schema)), model))
    assert np.mean([got[i]["predicted"] == (i % 4 == 0) for i, _ in texts]) > 0.99 and got[900]["predicted"] == 0 and 0 <= got[901]["score"] <= 1
    assert toxicity.train(docs, labels.where("toxic = 0")).score("x") < 0.5


def test_matcher_is_within_one_error():
    m = toxicity.Matcher(["pathetic"], ["lowei"])
    kinds = {w: [h[0] for h in m.hits(w)] for w in ("pathetic", "pathetik", "pathtic", "patheetic", "patetik", "lowei", "loweixyz", "lowe", "Pathetic!")}
    assert kinds["pathetic"] == [1] and kinds["Pathetic!"] == [1] and kinds["pathetik"] == kinds["pathtic"] == kinds["patheetic"] == [2]
    assert kinds["patetik"] == kinds["lowe"] == [] and kinds["lowei"] == kinds["loweixyz"] == [3]


def test_anchors_follow_windows():
    rng = np.random.default_rng(3)
    sym = kernels.mix64(rng.integers(0, 4, 5000).astype(np.uint64))
    at, _, first, last = kernels.winnow(sym, 5, 20)
    g = kernels.gram_hashes(sym, 5)
    key = g & ~np.uint64((1 << 18) - 1)
    want = [int(s + np.argmin(key[s : s + 16])) for s in range(len(sym) - 19)]
    assert np.repeat(at, last - first + 1).tolist() == want


def test_empty_tables(spark):
    import public_tokenizers

    e = empty(spark)
    for df in (exact.exact_groups(e), pii.find_private(e), suffix.byte_digests(e), substring.word_digests(e), ngramjoin.jaccard_components(e), packing.pack_documents(e, public_tokenizers.path("byte_bpe_50k.json"))):
        assert df.count() == 0
    assert embed.vector_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pipeline_against_steps(spark):
    import corpus_pipeline as C

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    cur = docs
    for name, stage in C.STAGES[:-1]:
        nxt = stage(spark, cur, d)
        assert nxt.columns == docs.columns, name
        cur = nxt.cache()
    texts = [r["text"] for r in cur.collect()]
    plain = [re.sub(f"[{GAP}]", "", t) for t in texts]
    assert len(plain) == len(set(plain)) and not any(re.search(r"\+\d \(\d{3}\) \d{3}-\d{4}", t) for t in texts)
    packed = C.STAGES[-1][1](spark, cur, d)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in cur.select("doc_id").collect()}
    assert C.run(spark, d).count() == packed.count()
