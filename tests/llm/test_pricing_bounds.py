import numpy as np
import pytest

from granary.llm import packing as p


def best_value(values, sizes, have, capacity):
    best = np.zeros(capacity + 1)
    for v, s, n in zip(values, sizes, have):
        for _ in range(min(int(n), capacity // int(s))):
            best[s:] = np.maximum(best[s:], best[:-s] + v)
    return best[-1]


@pytest.mark.parametrize("seed", range(40))
def test_price_is_optimal_for_long_and_short_items(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(20, 200))
    sizes = np.sort(rng.choice(np.arange(1, capacity + 1), min(30, capacity), replace=False))
    values, have = sizes * (1 + 0.2 * rng.random(len(sizes))), rng.integers(1, 5, len(sizes))
    expected = best_value(values, sizes, have, capacity)
    for known in (0.0, expected):
        got = p.price(values, sizes, have, capacity, np.arange(len(sizes)), known)
        assert all(0 < n <= have[j] for j, n in got.items()) and sum(n * sizes[j] for j, n in got.items()) <= capacity
        assert sum(n * values[j] for j, n in got.items()) == pytest.approx(expected)


def test_classes_that_cannot_be_in_the_best_are_left_out():
    sizes, have = np.arange(10, 200), np.full(190, 1000)
    values = np.where(sizes == 50, 2.0, 1.0) * sizes
    classes, most = p.contenders(values, sizes, have, 1000, np.arange(190))
    assert sizes[classes].tolist() == [50] and most.tolist() == [20]
    assert p.price(values, sizes, have, 1000, np.arange(190)) == {40: 20}


def test_only_short_items_are_in_the_dynamic_program(monkeypatch):
    sizes, have = np.arange(400, 1000), np.full(600, 5)
    values = sizes * (1 + 0.2 * np.random.default_rng(0).random(600))
    added, add = [], np.add
    monkeypatch.setattr(p.np, "add", lambda *a, **k: added.append(1) or add(*a, **k))
    got = p.price(values, sizes, have, 1000, np.arange(600))
    monkeypatch.undo()
    assert not added and sum(n * values[j] for j, n in got.items()) == pytest.approx(best_value(values, sizes, have, 1000))


def test_classes_that_are_used_up_are_not_taken():
    sizes, have = np.array([9, 4, 9, 30]), np.array([0, 1, 1, 5])
    assert p.price(sizes * 1.0, sizes, have, 25, np.arange(4)) == {1: 1, 2: 1}
    assert p.price(sizes * 1.0, sizes, have * 0, 25, np.arange(4)) == {}
