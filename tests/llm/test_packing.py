import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows
from quillmark.llm import packing


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_kernel_keeps_all_items_within_capacity(sizes):
    got = packing.pack(sizes, 50)
    assert sorted(i for b in got for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in got)


def test_near_the_least_possible():
    rng = random.Random(1)
    for capacity in (64, 256):
        sizes = [rng.randint(1, capacity // 2) for _ in range(500)]
        assert len(packing.pack(sizes, capacity)) <= -(-sum(sizes) // capacity) + 1


def test_an_emptied_container_goes():
    # Largest first leaves [6, 3], [5, 4] and [2]; moving and exchanging leaves two containers of ten.
    assert len(packing.pack([6, 5, 4, 3, 2], 10)) == 2


def test_containers(spark):
    sized = spark.createDataFrame([(i, n, "x") for i, n in enumerate([0, 5, 10, 10, 25, 3, 3, 3, 7, 1] * 30)], "id long, tokens long, fill string")
    windows = spark.createDataFrame([("w10", 10), ("w1", 1)], "window_name string, capacity_tokens int")
    got = packing.containers(sized, windows, shard_items=40).collect()
    for name, capacity in (("w10", 10), ("w1", 1)):
        mine = [r for r in got if r["window_name"] == name]
        by_doc, fill = {}, {}
        for r in mine:
            by_doc[r["id"]] = by_doc.get(r["id"], 0) + r["tokens"]
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["tokens"]
            assert r["tokens"] <= capacity
        assert by_doc == {r["id"]: r["tokens"] for r in sized.collect() if r["tokens"]}
        assert all(fill[r["container_id"]] == r["fill"] <= capacity for r in mine)
        assert len({(r["id"], r["part"]) for r in mine}) == len(mine)
        assert all(r["part"] == 0 for r in mine if by_doc[r["id"]] <= capacity)
    s = {r["window_name"]: r for r in packing.summary(packing.containers(sized, windows, shard_items=40)).collect()}
    assert s["w10"]["n_containers"] <= s["w10"]["least_possible"] * 1.05 and s["w1"]["mean_fill"] == 1.0


def test_sizes_empty_and_errors(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "two words"), (4, "many " * 30000)], "id long, text string")
    got = dict(rows(packing.sizes(df)))
    assert got[2] == 0 and got[3] == 2 and got[4] >= 30000 and 1 not in got
    windows = spark.createDataFrame([("w", 8)], "window_name string, capacity_tokens int")
    assert rows(packing.containers(packing.sizes(df.limit(0)), windows)) == []
    with pytest.raises(ValueError):
        packing.containers(packing.sizes(df), spark.createDataFrame([("w", 0)], "window_name string, capacity_tokens int"))
