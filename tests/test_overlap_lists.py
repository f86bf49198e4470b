import pytest

from stratavane.operators import masks


@pytest.mark.parametrize("most", [3, 100_000])
def test_overlaps_of_masks_dealt_to_several_keys(spark, monkeypatch, most):
    """Masks with more elements than a key holds give the same sums, of one table and of two, with weights and without."""
    monkeypatch.setattr(masks, "MASK_ELEMENTS", most)
    rows = [(s, m, e) for s in "xy" for m in range(9) for e in range(60) if (e * (m + 3) + ord(s)) % 5 < 2]
    df = spark.createDataFrame(rows, "s string, inst_id long, point_id long")
    w = spark.createDataFrame([(e, e / 4 + 0.25) for e in range(60)], "point_id long, size double")
    of = {}
    for s, m, e in rows:
        of.setdefault((s, m), set()).add(e)
    pairs = {(s, m, t): v & of[s, t] for (s, m), v in of.items() for u, t in of if u == s and v & of[s, t]}
    for weights, value in ((None, len), (w, lambda x: sum(e / 4 + 0.25 for e in x))):
        one = {(r.s, r.a, r.b): r.inter for r in masks.overlaps(df, scope=["s"], weights=weights).collect()}
        two = {(r.s, r.a, r.b): r.inter for r in masks.overlaps(df, df, scope=["s"], weights=weights).collect()}
        assert one == {k: value(v) for k, v in pairs.items() if k[1] < k[2]} and two == {k: value(v) for k, v in pairs.items()}


def test_no_row_for_each_pair_and_element_is_shuffled(spark):
    rows = spark.range(2000).selectExpr("id % 40 AS a", "id DIV 40 AS _e")
    plan = masks._meeting(rows, None, [], masks.F.lit(1), False)._jdf.queryExecution().executedPlan().toString()
    # what is spread out is added up where it is, with no exchange between
    assert plan.index("Generate explode") < plan.index("Exchange hashpartitioning(a")
    assert "Exchange" not in plan[: plan.index("Generate explode")].split("Final Plan")[-1]


@pytest.mark.parametrize("elements", [3, 70])
def test_pairs_of_one_block_are_not_added_up_again(spark, elements, monkeypatch):
    """Where all elements are shared by many masks and fit in a block, pairs go straight to the result; sizes may be shuffled, too."""
    monkeypatch.setattr(masks, "BROADCAST_MASKS", 500_000 if elements == 3 else 0)
    df = spark.range(70 * elements).selectExpr(f"id DIV {elements} AS inst_id", f"id % {elements} AS point_id")
    w = spark.range(elements).selectExpr("id AS point_id", "id + 1 AS size")
    out = masks.overlaps(df, weights=w)
    assert {(r.a, r.b): r.inter for r in out.collect()} == {(a, b): elements * (elements + 1) // 2 for b in range(70) for a in range(b)}
    if elements == 3:
        assert "sum(inter" not in out._jdf.queryExecution().sparkPlan().toString()
