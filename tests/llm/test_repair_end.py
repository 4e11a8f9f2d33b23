"""Re-Pair goes on until no pair occurs twice, with as many rules as that takes."""

from collections import Counter

import numpy as np

from advisorium.llm import repair


def test_no_pair_is_left_twice():
    rng = np.random.default_rng(1)
    for base in (300, 65_530, 70_000):
        sizes = rng.integers(1, 60, 40)
        ids = [rng.choice([3, 3, 5, 7, 9, 299], n).astype(np.uint32) for n in sizes]
        _, symbols, ends = repair.grammar(np.concatenate(ids), np.cumsum(sizes), base)
        counts: Counter = Counter()
        for start, end in zip([0, *ends[:-1]], ends, strict=True):
            own, i = symbols[start:end].tolist(), 0
            while i < len(own) - 1:
                counts[own[i], own[i + 1]] += 1
                i += 2 if own[i : i + 3] == [own[i]] * 3 else 1  # a run's pairs don't overlap
        assert max(counts.values()) < 2
        shard = repair.Shard(repair.packed_shard(0, 0, list(range(40)), ids, base))
        assert all(np.array_equal(a, b) for a, (_, b) in zip(ids, shard.documents(), strict=True))


def test_the_most_frequent_pair_is_first():
    ids = np.array([1, 2, 8, 1, 2, 9, 1, 2, 7, 1, 2, 3, 4, 6, 3, 4], np.uint32)
    rules, _, _ = repair.grammar(ids, np.array([len(ids)]), 10, sweeps=1)
    assert rules.tolist() == [[1, 2], [3, 4]]
    rules, _, _ = repair.grammar(np.append(ids, [5, 1, 2]).astype(np.uint32), np.array([len(ids) + 3]), 10, sweeps=1)
    assert rules.tolist() == [[1, 2]]
