"""confirming links and comparing sketches by what can be linked, with the results of comparing every pair."""

import numpy as np
import pytest

from chronoframe.llm import minhash


def _sets(rng, n, vocab, size, near):
    out = []
    for _ in range(n):
        if out and rng.random() < near:
            base = out[rng.integers(len(out))]
            lost = rng.random() * 0.35
            new = np.concatenate([base[rng.random(len(base)) > lost / 2], rng.integers(0, vocab, int(len(base) * lost / 2)).astype(np.uint64)])
        else:
            new = (rng.zipf(1.3, rng.integers(0, size)) % vocab).astype(np.uint64)
        out.append(np.unique(new))
    return out


def _all_pairs(sets, side, percent):
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for m in range(i):
            if (side[i] != side[m] or side[i] == 0) and minhash.linked(sets[i], sets[m], percent) and root[i] != root[m]:
                low, high = sorted((root[i], root[m]))
                root = [low if r == high else r for r in root]
    return root


@pytest.mark.parametrize("sides", [1, 2])
def test_ties_are_those_of_all_pairs(sides):
    rng = np.random.default_rng(7)
    for n, vocab, size, near, percent in [(1, 30, 5, 0, 80), (40, 30, 3, 0.2, 80), (60, 300, 40, 0.7, 50), (60, 3000, 200, 0.95, 80), (50, 300, 40, 0.9, 100)]:
        sets = _sets(rng, n, vocab, size, near)
        sets += [sets[0], sets[-1], sets[-1], np.zeros(0, np.uint64), np.zeros(0, np.uint64)]  # equal ones, and empty ones
        side = np.zeros(len(sets), int) if sides == 1 else rng.integers(1, 3, len(sets))
        assert minhash._ties(sets, side, percent).tolist() == _all_pairs(sets, side, percent)


def test_unrelated_sets_are_not_compared(monkeypatch):
    """All have twenty common shingles and two hundred of their own; four are near copies, many are equal."""
    rng = np.random.default_rng(8)
    common = np.arange(20, dtype=np.uint64)
    sets = [np.sort(np.concatenate([common, rng.integers(100, 1 << 60, 200).astype(np.uint64)])) for _ in range(300)]
    sets[200:203] = [np.sort(np.concatenate([sets[10][:-k], rng.integers(100, 1 << 60, k).astype(np.uint64)])) for k in (3, 9, 15)]
    sets += [sets[50]] * 300
    calls, linked = [], minhash.linked
    monkeypatch.setattr(minhash, "linked", lambda *a: calls.append(1) or linked(*a))
    root = minhash._ties(sets, np.zeros(len(sets), int), 80)
    want = np.arange(600)
    want[200:203], want[300:] = 10, 50
    assert root.tolist() == want.tolist()
    assert len(calls) < 100  # 45,000 and more before


def test_sketches_are_those_of_plain_numpy():
    rng = np.random.default_rng(9)
    n = 900
    sketch = rng.integers(0, 256, (n, minhash.SKETCH), dtype=np.uint8)
    for i in range(0, n - 3, 3):  # pairs around the limit, with the agreeing bytes anywhere
        same = rng.permutation(minhash.SKETCH)[:int(rng.integers(minhash.AGREE - 3, minhash.AGREE + 4))]
        sketch[i + 2, same] = sketch[i, same]
    begin = np.concatenate([[0], np.sort(rng.choice(n - 1, 30, replace=False) + 1)])
    group = np.searchsorted(begin, np.arange(n), "right")
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if group[i] == group[j] and (sketch[i] == sketch[j]).sum() >= minhash.AGREE}
    left, right = minhash._close(sketch, begin)
    assert set(zip(left.tolist(), right.tolist(), strict=True)) == want and len(left) == len(want) > 100
    assert [len(x) for x in minhash._close(sketch[:1], np.array([0]))] == [0, 0]


def test_second_half_only_where_it_can_count(monkeypatch):
    """Of unrelated sketches the first half alone is compared."""
    sketch = np.random.default_rng(10).integers(0, 256, (200, minhash.SKETCH), dtype=np.uint8)
    rows, agreeing = [], minhash._agreeing
    monkeypatch.setattr(minhash, "_agreeing", lambda a, b: rows.append((a.shape[1], len(a))) or agreeing(a, b))
    minhash._close(sketch, np.array([0]))
    assert sum(n for _, n in rows[1::2]) < 20 < 19_900 == sum(n for _, n in rows[::2])
    assert {w for w, _ in rows} == {minhash.SKETCH // 2}
