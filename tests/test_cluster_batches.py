"""Runs of many components are folded in one stream, however it is cut into batches."""

import pandas as pd

from postlens.operators import clusters


def test_state_outlasts_a_batch_and_ends_with_its_component():
    rows = [("a", 1, "x", None, True, 0, "1"), ("a", 2, "y", "x", False, 0, "2"), ("a", 3, "y", None, False, 0, "3"), ("b", 4, "x", None, False, 0, "4"), ("b", 5, "x", "y", True, 0, "5"), ("b", 6, "y", None, False, 0, "6")]
    table = pd.DataFrame(rows, columns=["component", "first", "k1", "k2", "direct", "at", "name"]).astype({"k1": object, "k2": object})
    table = table.where(table.notna(), None)
    want = [("a", 1, 1), ("a", 2, 1), ("a", 3, 3), ("b", 4, 4), ("b", 5, 4), ("b", 6, 4)]
    for size in (1, 2, 4, 6):
        out = pd.concat(clusters._fold(table.iloc[k : k + size] for k in range(0, 6, size)))
        assert list(out[["component", "first", "cluster"]].itertuples(index=False, name=None)) == want
    assert list(clusters._fold(iter([]))) == []
