"""Groups solved side by side take what they take one by one."""

import numpy as np
import pandas as pd

from stratavane.operators import matching


def test_many_matrices_as_one_by_one():
    r = np.random.default_rng(1)
    for n, m in ((1, 1), (1, 5), (3, 3), (3, 9), (8, 8)):
        cost = r.integers(-3, 6, (50, n, m)).astype(float)  # small integers: many ties
        cols = r.integers(n, m + 1, 50)
        cost[np.broadcast_to(np.arange(m) >= cols[:, None, None], cost.shape)] = np.inf
        for c, k, owner in zip(cost, cols, matching.solve_many(cost), strict=True):
            assert sorted((i, j) for j, i in enumerate(owner) if i >= 0) == matching.solve_assignment(c[:, :k])


def test_groups_are_solved_without_a_call_for_each(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(g, int(a), f"b{b}", float(r.integers(0, 9)), "x") for g in range(40) for a in range(g % 7 + 1) for b in range(g % 5 + 1) if (a + b + g) % 6]
    rows += [(99, a, f"b{b}", float((a * 7 + b * 5) % 11), "x") for a in range(10) for b in range(12)] + [(None, 1, "b0", None, "x"), (None, 1, "b1", 2.0, "x")]
    df = spark.createDataFrame(rows, "g int, a int, b string, cost double, more string")
    got = matching.optimal_assignment(df, ["g"]).collect()
    want = set()
    for g in {x[0] for x in rows}:
        f = pd.DataFrame([x for x in rows if x[0] == g], columns=["g", "a", "b", "cost", "more"]).dropna(subset="cost")
        left, right = sorted(set(f.a)), sorted(set(f.b))
        m = np.full((len(left), len(right)), 2 * (f.cost.abs().sum() + 1))
        for x in f.itertuples():
            m[left.index(x.a), right.index(x.b)] = x.cost
        pairs = {(left[i], right[j]) for i, j in matching.solve_assignment(m)}
        want |= {(g, x.a, x.b, x.cost, "x") for x in f.itertuples() if (x.a, x.b) in pairs}
    by_cost = lambda rows: {g: (sum(1 for x in rows if x[0] == g), sum(x[3] or 0 for x in rows if x[0] == g)) for g in {x[0] for x in rows}}
    assert by_cost([tuple(x) for x in got]) == by_cost(want) and all(x.more == "x" for x in got)

    calls = []
    monkeypatch.setattr(matching, "solve_assignment", lambda c: calls.append(1) or [])
    sizes, at = np.full(500, 30), np.arange(15000)
    matching._chosen(sizes, pd.Series(at % 30 // 3), pd.Series(at % 3), (at % 17).astype(float))
    assert not calls
