"""op11 against the library, over whole tables, odd texts, ids that are no text, and rows without text or id."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docforge.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
POOL = ["<|endoftext|>", "'s", "'ll", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", " ", "a", "Z", "é", "漢", "1", "²", "😀", "́", "!", "'", "՘", "\U00012550", "\U000323b1", "<|", "\x00", "�", "the", "ation"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_random_texts_and_random_ids(library):
    rng, model = random.Random(5), bpe.ByteModel(PATH, cache=500)
    texts = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text, ids in zip(texts, model.encode_all(texts, chars=900), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    for _ in range(2000):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 9))]
        assert model.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert model.decode([-1, 60000, 64]) == "a"


@pytest.mark.parametrize("word", ["a" * 70_001, "ab" * 20_000, " " * 30_001, "".join(random.Random(2).choice("abcdefgh") for _ in range(30_000)), "漢字" * 9_000], ids=["one", "two", "blank", "mixed", "han"])
def test_very_long_words(library, word):
    assert bpe.load(PATH).encode(word).tolist() == library.encode(word, add_special_tokens=False).ids


def test_trees_side_by_side_and_alone_agree():
    rng, model = random.Random(9), bpe.load(PATH)
    for width in (2, 4, 8, 16, 32, 64):
        words = [bytes(rng.choice(b"aehinost \xc3\xa9") for _ in range(rng.randint(1, width))) for _ in range(300)]
        for word, ids in zip(words, model.merge_words(words, width), strict=True):
            assert list(memoryview(ids).cast("I")) == model.merge_word(word)


def test_the_root_is_the_leftmost_lowest_rank():
    tree = bpe.PairTree([7 * 5, 3 * 5 + 1, 3 * 5 + 2, 9 * 5 + 3], 1000)
    assert tree.root() == 16
    tree.put(1, 1000)
    assert tree.root() == 17
    tree.put(2, 1000)
    tree.put(0, 1000)
    tree.put(3, 1000)
    assert tree.root() == 1000


def test_query_over_the_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.op11_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = library.encode(d["text"] or "", add_special_tokens=False).ids
        back = library.decode(want, skip_special_tokens=False)
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in want)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_rows_without_text_or_id_and_round_trip(spark, library):
    rows = [(1, "one <|endoftext|> two", "x"), (1, "one <|endoftext|> two", "x"), (None, "kept", None), (3, None, "y"), (4, "", "z"), (1 << 60, "é 漢", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    ids = bpe.encode_texts(docs, PATH)
    assert {r["doc_id"]: r["n_tokens"] for r in ids.collect()}[1 << 60] == len(library.encode("é 漢", add_special_tokens=False).ids)
    back = sorted((r["doc_id"] or 0, r["decoded"]) for r in bpe.decode_ids(ids, PATH).collect())
    assert back == sorted((d or 0, t or "") for d, t, _ in rows)
    assert bpe.decode_ids(ids.selectExpr("doc_id", "cast(null as array<int>) ids", "'a' decoded"), PATH).where("decoded is null").count() == len(rows)
    for f in (bpe.encode_texts, bpe.bpe_digests):
        assert f(docs.where("false"), PATH).count() == 0
    assert bpe.bpe_digests(docs, PATH).count() == len(rows)


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.ByteModel(public_tokenizers.path("word_bpe_49k.json"))
