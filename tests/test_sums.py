"""Scores of many queries: shared terms as matrices, rarer ones pair by pair, and only what may be among the best is rounded."""

import numpy as np
import pyarrow as pa
import pytest

from stackwise.operators import lexical


@pytest.mark.parametrize("dense,cells", [(0.0003, 4_000_000), (0.3, 7), (2, 7), (-1, 4_000_000)])
def test_sums_equal_plain_loops(monkeypatch, dense, cells):
    monkeypatch.setattr(lexical, "DENSE", dense)
    monkeypatch.setattr(lexical, "CELLS", cells)
    rng = np.random.default_rng(3)
    asks = rng.random((23, 40)) * (rng.random((23, 40)) < np.linspace(0.02, 0.9, 40))
    asks[[0, 11, 22]] = 0
    query, term = np.nonzero(asks)
    sums = lexical.Sums(np.bincount(query, minlength=23), term, asks[query, term], 40, 5)
    for n in (30, 1, 17):  # blocks of any size, the split seen from the first
        has = rng.random((40, n)) * (rng.random((40, n)) < np.linspace(0.9, 0.02, 40)[:, None])
        t, c = np.nonzero(has)
        slabs = list(sums.of(t, c, has[t, c], n))
        assert [j for j, _ in slabs] == [0, 5, 10, 15, 20]
        assert np.allclose(np.concatenate([s for _, s in slabs]), asks @ has, atol=1e-12)


def test_no_pairs_but_shared_ones_are_made(monkeypatch):
    monkeypatch.setattr(lexical, "DENSE", 2)
    made, add = [], np.add
    at = lambda a, i, v: (made.append(len(i)), add.at(a, i, v))
    monkeypatch.setattr(lexical.np, "add", type("Add", (), {"at": staticmethod(at), "reduceat": add.reduceat}))
    sums = lexical.Sums(np.ones(1000, np.int64), np.arange(1000), np.ones(1000), 1000, 100)
    slabs = list(sums.of(np.array([5, 999]), np.array([0, 1]), np.ones(2), 50))
    assert sum(made) == 2 and sum(s.sum() for _, s in slabs) == 2


def test_offered_scores_give_the_best_by_rounded_score_and_id():
    rng = np.random.default_rng(4)
    s = np.round(rng.random((6, 400)), 2) + rng.choice([0, 3e-7, -3e-7], (6, 400))
    s[rng.random(s.shape) < 0.3] = 0
    s[5, 3:] = 0
    ids = rng.permutation(400)
    best = lexical.Best(6, 7)
    for i in range(0, 400, 50):
        best.offer(0, s[:3, i : i + 50], pa.array(ids[i : i + 50]))
        best.offer(3, s[3:, i : i + 50], pa.array(ids[i : i + 50]))
        best.trim()
    q, scores, chunks = best.trim()
    got = list(zip(q.tolist(), scores.tolist(), chunks.to_pylist()))
    want = [(q, x, c) for q in range(6) for x, c in sorted(((round(v, 6), int(c)) for v, c in zip(s[q].tolist(), ids) if v > 0), key=lambda p: (-p[0], p[1]))[:7]]
    assert got == want
