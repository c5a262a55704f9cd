import numpy as np
import pytest

from kindred.llm.pitman_yor import Restaurants


def expected(customers, base, d, s):
    """Mean number of tables of a restaurant with one dish, from the weights of all seatings."""
    ways = np.full(customers + 1, -np.inf)
    ways[1] = 0.0
    for n in range(1, customers):
        kept = np.full(customers + 1, -np.inf)
        kept[1 : n + 1] = ways[1 : n + 1] + np.log(n - d * np.arange(1, n + 1))
        kept[1:] = np.logaddexp(kept[1:], ways[:-1])
        ways = kept
    t = np.arange(1, customers + 1)
    logs = ways[1:] + np.cumsum(np.log((s + d * np.arange(customers)) * base))
    p = np.exp(logs - logs.max())
    return (p * t).sum() / p.sum()


@pytest.mark.parametrize(("customers", "base", "law"), [(6, 0.3, (0.75, 5.0)), (40, 0.05, (0.6, 10.0)), (12, 1.0, (0.5, 1.0)), (1000, 0.2, (0.75, 5.0)), (2000, 0.01, (0.5, 10.0))])
def test_sweeps_draw_the_posterior_number_of_tables(customers, base, law):
    rooms = 2000
    r = Restaurants(np.arange(rooms), np.full(rooms, customers), rooms, law, np.random.default_rng(3))
    r.start(np.full(rooms, base))
    seen = []
    for i in range(80):
        r.sweep(np.full(rooms, base))
        if i >= 40:
            seen.append(r.tables.mean())
    assert np.mean(seen) == pytest.approx(expected(customers, base, *law), rel=0.02 if customers < 129 else 0.05)


def test_a_cell_of_many_customers_follows_its_parent():
    r = Restaurants(np.zeros(1, np.int64), np.array([1_000_000]), 1, (0.5, 10.0), np.random.default_rng(5))
    r.start(np.array([1e-7]))
    few = int(r.tables[0])
    for _ in range(14):
        r.sweep(np.array([0.5]))
    assert r.tables[0] > 20 * few and r.size.sum() == 1_000_000
