import collections
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from spotweave.llm.packing import Bins, pack


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=200), st.integers(1, 6))
def test_bins_hold_no_more_than_they_can(sizes, limit):
    bins, fill = Bins(64, limit), collections.Counter()
    for s in sizes:
        fill[bins.add(s)] += s
        assert bins.open <= limit
    assert all(v <= 64 for v in fill.values())
    assert all(64 - fill[b] == space for b, space in bins.closed) and all(fill[b] < 64 for b in bins.still_open())


def test_best_fit_and_fullest_closes_first():
    b = Bins(10, 2)
    assert [b.add(s) for s in (6, 7, 3, 4, 8, 9)] == [0, 1, 1, 0, 2, 3]
    b = Bins(10, 2)
    assert [b.add(s) for s in (5, 8, 6)] == [0, 1, 2] and b.closed == [(1, 2)]


def containers(spark, rows, **k):
    return pack(spark.createDataFrame(rows, "id long, n long"), "id", "n", **k).collect()


def test_every_text_once_and_only_long_ones_split(spark):
    r = random.Random(4)
    rows = [(i, r.choice([0, 5, 100, 900, 2000, 4096, 4097, 9000, 20_000])) for i in range(700)] + [(1000, None)]
    got = containers(spark, rows, per_stream=100, limit=16)
    by, fill, alone = collections.defaultdict(list), collections.Counter(), collections.Counter()
    for x in got:
        by[x["id"]].append((x["piece_no"], x["start_token"], x["n_tokens"]))
        fill[x["container_id"]] += x["n_tokens"]
        alone[x["container_id"]] += 1
    assert set(by) == {i for i, n in rows if n is not None} and max(fill.values()) <= 4096
    for i, n in rows:
        if n is not None:
            pieces = sorted(by[i])
            assert sum(p[2] for p in pieces) == n and len(pieces) == max(1, -(-n // 4096))
            assert [p[1] for p in pieces] == [4096 * k for k in range(len(pieces))]
    assert sum(fill.values()) / (4096 * len(fill)) > 0.97
    assert sorted(map(tuple, got)) == sorted(map(tuple, containers(spark, rows, per_stream=100, limit=16)))


def test_repeated_ids_and_no_rows(spark):
    assert sum(x["n_tokens"] for x in containers(spark, [(1, 3000), (1, 3000), (None, 10)])) == 6010
    assert containers(spark, []) == []
