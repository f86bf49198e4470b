"""A task's share of masks doesn't grow with the table."""

import re

from stratavane.operators import masks


def test_masks_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(masks, "PART_ROWS", 10)
    df = spark.createDataFrame([(m, p) for m in range(10) for p in range(0, 30) if (p * 7 + m) % 5] * 2, "inst_id long, point_id long")
    out = masks.rle_encode(df, ["inst_id"])
    dealt = re.findall(r"hashpartitioning\(inst_id#\d+L?, (\d+)\)", out._jdf.queryExecution().executedPlan().toString())
    assert dealt == [str(-(-df.count() // 10))]  # one shuffle, in parts of ten rows
    for r in out.collect():
        own = [p for p in range(30) if (p * 7 + r.inst_id) % 5]
        assert [p for s, n in zip(r.counts[::2], r.counts[1::2], strict=True) for p in range(s - 1, s - 1 + n)] == own
