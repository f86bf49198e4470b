import pytest

from stratavane.operators import bitmaps, masks


@pytest.mark.parametrize("most", [0, 100_000])
def test_masks_are_not_copied_for_each_tile(spark, monkeypatch, most):
    """Tiles meet as single rows, broadcast or shuffled: the masks are spread out after the last join of blocks, so no copies of masks pass the driver."""
    monkeypatch.setattr(bitmaps, "TILE", 8)
    monkeypatch.setattr(bitmaps, "BROADCAST_PARTS", most, raising=False)
    df = spark.range(70 * 5).selectExpr("id DIV 5 AS inst_id", "id % 5 AS point_id")
    out = masks.overlaps(df, weights=spark.range(5).selectExpr("id AS point_id", "id + 1 AS size"))
    assert sorted((r.a, r.b, r.inter) for r in out.collect()) == [(a, b, 15) for a in range(70) for b in range(a + 1, 70)]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    below = plan[plan.index("Generate explode") :]
    assert below.count("Generate explode") == 2 and "Join" not in below[: below.rindex("Generate explode")]
    assert ("SortMergeJoin" in below) == (most == 0)
