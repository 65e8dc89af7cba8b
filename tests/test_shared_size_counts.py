"""Counts of pairs of gene sets by sizes and shared genes, without making the pairs that share one gene."""

import random
from collections import Counter

import pytest

from helixframe.operators import conflicts


def sets_of(seed):
    r = random.Random(seed)
    return {f"a{i}": frozenset(r.sample([f"g{k}" for k in range(r.choice([6, 60]))], min(6, r.choice([1, 1, 2, 3, 5, 6])))) for i in range(120)} | {"w": frozenset(f"g{k}" for k in range(20)), "z": frozenset(f"g{k}" for k in range(10, 50))}


def frame(spark, sets):
    return conflicts.distinct_sets(spark.createDataFrame([(a, g) for a, s in sets.items() for g in s], "assertion string, gene string"))


@pytest.mark.parametrize("seed, most", [(0, 32), (1, 32), (2, 4), (3, 1000)])
def test_shared_size_counts_equal_pairs(spark, seed, most):
    sets = sets_of(seed)
    apart = set(sets.values())
    want = Counter((len(a), len(b), len(a & b)) for a in apart for b in apart if a & b)
    got = conflicts.shared_size_counts(frame(spark, sets), most).collect()
    assert {(r["n"], r["n_other"], r["shared"]): r["n_pairs"] for r in got} == want and len(got) == len(want)


def test_jaccard_counts_equal_pairs(spark):
    sets = sets_of(5)
    apart = sorted(map(sorted, set(sets.values())))
    want = Counter((*sorted((len(a), len(b))), k) for i, a in enumerate(apart) for b in apart[i + 1 :] if (k := len({*a} & {*b})) and k * 5 >= len({*a, *b}))
    got = conflicts.jaccard_counts(frame(spark, sets), 0.2).collect()
    assert {tuple(r)[:3]: r["n_pairs"] for r in got} == want and len(got) == len(want)
