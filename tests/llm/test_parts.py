"""Keys across batches, and the spare parts that frequent keys may use up."""

import numpy as np
import pandas as pd
import pytest

from docforge.llm import ngramjoin


@pytest.mark.parametrize("step", [1, 2, 3, 50])
def test_shared_drops_only_single_keys(step):
    keys = [1, 2, 2, 3, 4, 4, 4, 4, 5, 6, 6]
    rows = pd.DataFrame({"key": keys, "node": range(len(keys))})
    batches = [rows.iloc[i : i + step] for i in range(0, len(rows), step)]
    got = pd.concat(ngramjoin._shared(iter([rows.iloc[:0], *batches])))
    assert got["node"].tolist() == [i for i, k in enumerate(keys) if keys.count(k) > 1]


def test_shared_of_nothing():
    assert not list(ngramjoin._shared(iter([])))


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("n", [1, 9, 40, 300, 2000])
def test_pairs_at_the_threshold_agree_in_more_parts_than_may_go(n, percent):
    rng = np.random.default_rng(n)
    d = 2 * n * (100 - percent) // (100 + percent)
    for _ in range(5):
        h = np.unique(rng.integers(0, 1 << 63, n + d // 2, dtype=np.uint64))
        one, two = np.sort(h[: n]), np.sort(h[d // 2 :])
        assert ngramjoin.reaches(one, two, percent)
        bands = ngramjoin.Bands(percent)
        both = np.intersect1d(bands.keys(one), bands.keys(two))
        most = max(np.count_nonzero((both & np.uint64(1)) == b) for b in (0, 1))
        assert most > ngramjoin.common(d)
