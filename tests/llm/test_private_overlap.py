"""Personal data beside, before and inside other numbers."""

import re

import pytest

from docforge.llm import pii

CASES = {
    "call 2024-01-05 555-123-4567 now": ["555-123-4567"],
    "2024-01-05 phone 555-123-4567, 192.168.1.1": ["555-123-4567"],
    "phone 192.168.1.1 555-123-4567": ["555-123-4567"],
    "555-123-4567 is no phone said": [],
    "tel 555 123 4567": ["555 123 4567"],
    "2024-01-05 2024-01-06 2024-01-07": [],
    "é😀 tel 030-1234-567 2024-01-05": ["030-1234-567"],
    "030-1234-567": [],
}


@pytest.fixture(scope="module")
def found(spark):
    rows = list(enumerate(CASES))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_private(df).collect()}
    red = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    return [(t, [x.split(":") for x in got[i].split(",") if x], red[i]) for i, t in rows]


def test_numbers_are_chosen_among_overlapping_spans(found):
    for text, spans, _ in found:
        assert [text[int(a) : int(z)] for k, a, z in spans if k == "number"] == CASES[text], (text, spans)


def test_redaction_leaves_the_date(found):
    assert found[0][2] == "call 2024-01-05 [NUMBER] now" and found[2][2] == "phone [IP] [NUMBER]"


def test_added_spans_never_overlap(found):
    for _, spans, _ in found:
        at = sorted((int(a), int(z)) for _, a, z in spans)
        assert all(a[1] <= b[0] for a, b in zip(at, at[1:]))


def test_long_texts_cross_blocks_of_matches_and_of_characters(spark):
    mails = " 😀é ".join(f"ab{i}c@mail{i % 7}.example.org" for i in range(700))
    calls = " and then ".join(f"tel 555 {i % 1000:03d} {i * 37 % 10000:04d}" for i in range(600))
    df = spark.createDataFrame([(1, mails), (2, calls), (3, "word " * 1000), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_private(df).collect()}
    red = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    want = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9.]+@[A-Za-z0-9.]+", mails)]
    assert len(want) == 700 and got[1]["spans"].split(",") == want
    assert red[1] == " 😀é ".join(["[EMAIL]"] * 700)
    spans = [x.split(":") for x in got[2]["spans"].split(",")]
    assert sum(k == "number" and calls[int(a) : int(z)] == calls[int(a) : int(a) + 12] for k, a, z in spans) > 500
    rest, at = "", 0
    for k, a, z in spans:
        rest, at = rest + calls[at : int(a)] + f"[{k.upper()}]", int(z)
    assert red[2] == rest + calls[at:]
    assert red[3] == "word " * 1000 and red[4] == ""
