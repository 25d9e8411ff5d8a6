"""Windows of more symbols than the FM-index sorts by default, against plain counting."""

from collections import Counter

import numpy as np
import pytest

from lodestone.llm import substring_dedup


@pytest.mark.parametrize("window", [35, 50, 100])
def test_repeated_windows_of_any_length(window):
    rng = np.random.default_rng(window)
    # Runs of one phrase agree over far more than 8 symbols before they differ.
    phrase = rng.integers(1, 2**60, 6).astype(np.uint64)
    runs = []
    for _ in range(30):
        h = np.tile(phrase, 40)[: int(rng.integers(window, 200))].copy()
        h[rng.integers(0, len(h), 2)] = rng.integers(1, 4, 2)
        runs.append(h)
    ask = np.ones(len(runs), bool)
    seen = Counter(h[i : i + window].tobytes() for h in runs for i in range(len(h) - window + 1))
    want = [[seen[h[i : i + window].tobytes()] > 1 for i in range(len(h) - window + 1)] for h in runs]
    got = [x.tolist() for x in substring_dedup.repeated_windows(runs, ask, window)]
    assert got == want and any(map(any, want)) and not all(map(all, want))
