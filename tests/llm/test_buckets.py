"""Steps that keep the work of line dedup and collocations in proportion to their input."""

from __future__ import annotations

import numpy as np
import pytest

from encaudit.llm import collocations, line_dedup


@pytest.mark.parametrize("bucket_keys", [1, 1 << 20])
def test_shared_keys_are_those_of_several_lines(spark, monkeypatch, bucket_keys):
    """Also where a line comes twice and where buckets are small; pairs come once."""
    monkeypatch.setattr(line_dedup, "BUCKET_KEYS", bucket_keys)
    monkeypatch.setattr(line_dedup, "PACKED_KEYS", 3)
    rows = [(1, [10, 20]), (1, [10, 20]), (2, [10, -5]), (3, [30, -5]), (4, []), (5, [10, 7])]
    lines = spark.createDataFrame(rows, "line_id long, bands array<long>")
    found = line_dedup._shared_keys(lines)
    assert sorted(map(tuple, found.collect())) == [(-5, 2), (-5, 3), (10, 1), (10, 2), (10, 5)]
    assert line_dedup._shared_keys(lines.where("line_id = 4")).count() == 0


def test_tiles_of_few_entries_need_no_array_of_cells(monkeypatch):
    ids = np.array([0, 3000, 0, 3000, -1, 0, 1, 1])
    expected = [(0, [1, 1025], [1, 1]), (2, [952], [2]), (2 << 32, [952 << 10], [1])]

    def tiles() -> list[tuple]:
        return [(tile, cells.tolist(), counts.tolist()) for tile, cells, counts in collocations._dense_tiles(ids)]

    monkeypatch.setattr(collocations, "FEW", 0, raising=False)
    assert tiles() == expected
    monkeypatch.undo()
    monkeypatch.setattr(np, "bincount", None)
    assert tiles() == expected


@pytest.mark.parametrize("large", [5, 1 << 40])
def test_counted_pairs(large):
    a, b, n = collocations._pairs(np.array([1, large, 1, large, -1, 0, 1]))
    assert sorted(zip(a.tolist(), b.tolist(), n.tolist())) == [(0, 1, 1), (1, large, 2), (large, 1, 1)]
