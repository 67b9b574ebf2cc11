"""Trigram probabilities by direct lookup against the search in sorted arrays."""

import numpy as np

from binscore.llm import quality_rules


def test_direct_lookup_equals_the_search(monkeypatch):
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(97, 107, (300, 3)) @ np.array([1 << 16, 1 << 8, 1])).astype(np.int32)
    counts = rng.integers(1, 9, len(keys))
    asked = (rng.integers(95, 110, (2000, 3)) @ np.array([1 << 16, 1 << 8, 1])).astype(np.int32)
    direct = quality_rules.KneserNey(keys, counts)
    monkeypatch.setattr(quality_rules, "DIRECT", 0)
    searched = quality_rules.KneserNey(keys, counts)
    assert direct.table is not None and searched.table is None
    assert np.array_equal(direct.log10(asked), searched.log10(asked)) and np.isin(asked, keys).any()
