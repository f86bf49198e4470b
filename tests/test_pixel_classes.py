from stratavane.operators import labels, masks


def _tables(spark):
    # point 1 lies in two pixels of frame 0, point 2 in the same pixel as a part of it, point 3 in none of a mask
    mapping = spark.createDataFrame([("s", 0, 1, 0, 0), ("s", 0, 1, 0, 1), ("s", 0, 2, 0, 1), ("s", 0, 3, 5, 5), ("s", 1, 1, 0, 0), ("s", 1, 4, 0, 0)], "scene_id string, frame_id int, point_id long, row int, col int")
    pixels = spark.createDataFrame([("s", 0, 7, 0, 0), ("s", 0, 7, 0, 1), ("s", 0, 8, 0, 1), ("s", 1, 7, 0, 0)], "scene_id string, frame_id int, mask_id long, row int, col int")
    return mapping, pixels


def test_points_meet_masks_by_their_pixels(spark):
    mapping, pixels = _tables(spark)
    n = {(r.frame_id, r.mask_id): r.n for r in masks.member_counts(mapping, pixels).collect()}
    assert n == {(0, 7): 2, (0, 8): 2, (1, 7): 2}
    spp = spark.createDataFrame([("s", 1, 10), ("s", 2, 10), ("s", 3, 10), ("s", 4, 11)], "scene_id string, point_id long, spp long")
    cov = {(r.frame_id, r.mask_id, r.spp): (r.hit, r.total) for r in masks.coverage(mapping, pixels, spp, least=0.0).collect()}
    assert cov == {(0, 7, 10): (2, 3), (0, 8, 10): (2, 3), (1, 7, 10): (1, 1), (1, 7, 11): (1, 1)}
    feats = spark.createDataFrame([("s", 0, 7, [1.0, 0.0]), ("s", 0, 8, [0.0, 2.0]), ("s", 1, 7, [10.0, 0.0])], "scene_id string, frame_id int, mask_id long, feat array<double>")
    sums = {r.point_id: r.feat for r in labels.accumulate_features(mapping, pixels, feats).collect()}
    assert sums == {1: [12.0, 2.0], 2: [1.0, 2.0], 4: [10.0, 0.0]}  # a mask counts once for each of a point's pixels in it


def test_no_row_for_each_point_and_mask(spark):
    """Many masks over one pixel with many points: what meets the masks is the pixel."""
    mapping = spark.range(3000).selectExpr("'s' scene_id", "0 frame_id", "id point_id", "0 `row`", "0 col")
    pixels = spark.range(500).selectExpr("'s' scene_id", "0 frame_id", "id mask_id", "0 `row`", "0 col")
    met = masks.masks_over(masks.views_of_points(mapping), pixels)
    assert met.count() == 500 and met.agg({"_n": "sum"}).first()[0] == 500
