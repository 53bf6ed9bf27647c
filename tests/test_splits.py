"""Group splits by runs of equal sizes against the greedy, a step a group."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.operators import order

PARTS = {"train": 0.9, "dev": 0.05, "test": 0.05}


def _greedy(sizes, fractions, mode, seed=17):
    digest = lambda g: "" if g is None else hashlib.sha256(f"{seed}:{g}".encode()).hexdigest()
    return order.greedy_group_splits(sorted(sizes.items(), key=lambda x: (-x[1], digest(x[0]), x[0] or "")), fractions, mode)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=3, max_size=3), st.integers(1, 9), st.integers(1, 400), st.sampled_from(["ratio", "deficit"]))
def test_a_run_is_counted_as_it_is_walked(have, n, m, mode):
    want = [(sum(have) + n * m) * f for f in (0.05, 0.05, 0.9)]
    run, walked, now = order._Run(want, mode), [], list(have)
    for _ in range(m):
        k = min(range(3), key=lambda k: (run.key(k, 1, n, now), k))
        walked.append(k)
        now[k] += n
    held = [np.full(m, h) for h in have]
    assert run.split_of(np.arange(m), np.full(m, n), held).tolist() == walked
    assert [int(run.taken(k, np.array([m]), n, [np.array([h]) for h in have])[0]) for k in range(3)] == [walked.count(k) for k in range(3)]


@pytest.mark.parametrize("mode", ["ratio", "deficit"])
@pytest.mark.parametrize("steps", [4_096, 5])
def test_splits_equal_the_greedy(spark, mode, steps):
    rng = random.Random(5)
    sizes = {f"g{i}": rng.choice([1, 1, 1, 2, 3, 3, 40]) for i in range(700)} | {"huge": 900, None: 7}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "document_id string")
    got = order.assign_group_splits(df, "document_id", PARTS, 17, mode, steps)
    counts = {(r["document_id"], r["split"]): r["count"] for r in got.groupBy("document_id", "split").count().collect()}
    assert counts == {(g, s): sizes[g] for g, s in _greedy(sizes, PARTS, mode).items()}


def test_too_few_groups_and_empty_fractions(spark):
    df = spark.createDataFrame([("a",), ("b",)], "document_id string")
    with pytest.raises(ValueError, match="cannot fill"):
        order.assign_group_splits(df, "document_id", PARTS)
    with pytest.raises(ValueError, match="positive"):
        order.assign_group_splits(df, "document_id", {"train": 1.0, "dev": 0.0})
