"""Windows are cut in a text's own row: no token is sorted, and several chunkers need no union."""

import re

import pytest

from docforge.functions import text as T
from docforge.operators import chunking
from docforge.plans import catalogue, reports  # noqa: F401  registers chunk_report

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def texts(spark):
    rows = [(i, " ".join(f"w{j}," for j in range(n // 2)) + (" end" if n % 2 else "")) for i, n in enumerate((1, 2, 7, 8, 9, 20, 21, 63))] + [(90, None), (91, ""), (92, " \n ")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_token_offsets_of_rows_without_sorting(texts):
    rows, df = texts
    want = [(i, p, *m.span()) for i, t in rows for p, m in enumerate(re.finditer(r"\w+|[^\w\s]", t or ""))]
    made = T.token_offsets(df)
    assert sorted(map(tuple, made.collect())) == want
    assert "Window" not in plan(made) and "Sort" not in plan(made)


@pytest.mark.parametrize(("size", "overlap"), [(8, 2), (8, 0), (5, 4), (400, 80)])
def test_windows_of_rows_without_sorting(texts, size, overlap):
    rows, df = texts
    want, stride = [], size - overlap
    for i, t in rows:
        at = [m.span() for m in re.finditer(r"\w+|[^\w\s]", t or "")]
        last = 0 if len(at) <= size else -(-(len(at) - size) // stride)
        want += [(i, w, at[w * stride][0], at[w * stride : w * stride + size][-1][1], len(at[w * stride : w * stride + size])) for w in range(last + 1) if at]
    made = chunking.fixed_windows(df, size, overlap)
    assert sorted(map(tuple, made.collect())) == want
    assert "Window" not in plan(made) and "Sort" not in plan(made)


def test_chunk_report_joins_no_unions(spark):
    made = catalogue.QUERIES["chunk_report"](spark, DIR)
    assert "Union" not in plan(made) and made.count() == 9


def test_fixed_window_stats_sort_no_tokens(spark):
    made = catalogue.QUERIES["fixed_window_stats"](spark, DIR)
    assert "Window" not in plan(made)
