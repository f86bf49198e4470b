import math
import random
import re

import pytest
from pyspark.sql import functions as F

from stratavane import bindings
from stratavane.operators import suppression

SF = "/root/testdata/sf0.001"


def _iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    i = max(w, 0.0) * max(h, 0.0)
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i
    return i / u if u else 0.0


def test_boxes_decay_by_the_dense_formula(spark):
    """Equal, null and NaN scores, empty boxes, a null frame, a frame of one box, and a column that is only passed on."""
    rng = random.Random(3)
    rows = []
    for f in [*range(5), None]:
        for i in range(1 if f == 4 else 40):
            score = [rng.choice([0.25, 0.5, 0.75]), rng.random(), None if i % 2 else math.nan][min(2, rng.randrange(12) // 5)]
            x, y = rng.random() * 4, rng.random() * 4
            rows.append((f, i, score, x, y, x + rng.choice([0.0, 1.0, 2.0]), y + rng.choice([0.0, 1.0, 2.0]), f"n{i}"))
    df = spark.createDataFrame(rows, "f int, box_id bigint, score double, x1 double, y1 double, x2 double, y2 double, note string")
    place = lambda r: (r[2] is None, 0.0 if r[2] is None else -math.inf if math.isnan(r[2]) else -r[2], r[1])
    want = {}
    for f in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == f), key=place)
        comp, iou = {}, lambda a, b: _iou(a[3:7], b[3:7])
        for k, r in enumerate(own):
            better = own[:k] if f is not None else []
            comp[r[1]] = max([iou(b, r) for b in better], default=0.0)
            least = min([1.0, *[math.exp(-2 * (iou(b, r) ** 2 - comp[b[1]] ** 2)) for b in better]])
            want[f, r[1]] = (r[7], None if r[2] is None else r[2] * least)
    out = suppression.matrix_box_nms(df, ["f"])
    assert out.columns == [*df.columns, "decayed"]
    got = {(r.f, r.box_id): (r.note, r.decayed) for r in out.collect()}
    assert got.keys() == want.keys() and out.count() == len(rows)
    for k, (note, v) in want.items():
        assert got[k][0] == note and got[k][1] == (v if v is None else pytest.approx(v, nan_ok=True)), k


def test_rows_are_shuffled_once_and_pairs_never(spark):
    """Of the lines with a key there is one exchange, by the frame; the other one is of lines without a key."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = bindings.queries()["matrix_nms"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    exchanges = re.findall(r"- Exchange (\w+\(\w+)#", plan)
    assert exchanges == ["hashpartitioning(l_orderkey"] * 2 and plan.count("SortMergeJoin") == 2
    assert len(re.findall(r"Filter isnull\(l_orderkey", plan)) == 1


def test_lines_without_an_order_or_a_price_stay(spark, tmp_path):
    l = spark.read.parquet(f"{SF}/lineitem.parquet").limit(200)
    none = F.when(F.col("l_partkey") % 5 == 0, F.lit(None)).otherwise(F.col("l_orderkey"))
    price = F.when(F.col("l_partkey") % 7 == 0, F.lit(None)).otherwise(F.col("l_extendedprice"))
    l.withColumn("l_orderkey", none).withColumn("l_extendedprice", price).write.parquet(str(tmp_path / "lineitem.parquet"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = [tuple(r) for r in bindings.queries()["matrix_nms"](spark, str(tmp_path)).collect()]
    want = con.execute(bindings.oracle_sql()["matrix_nms"]).fetchall()
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 200
