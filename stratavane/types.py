"""Schemas of the data model: long tables keyed by scene, with arrays only for vectors."""

from pyspark.sql import types as T


_DDL = {}


def __getattr__(name: str) -> T.StructType:
    """Schemas are parsed on use, because that takes a session."""
    if name in _DDL:
        return T._parse_datatype_string(_DDL[name])
    raise AttributeError(name)


_DDL["SCENES"] = ("scene_id string")
_DDL["POINTS"] = ("scene_id string, point_id bigint, x double, y double, z double, r float, g float, b float")
_DDL["GROUND_TRUTH"] = ("scene_id string, point_id bigint, sem int, inst int")
_DDL["SUPERPOINTS"] = ("scene_id string, point_id bigint, spp bigint")
_DDL["POINT_FEATURES"] = ("scene_id string, point_id bigint, feat array<float>")
_DDL["FRAMES"] = ("scene_id string, frame_id string, frame_ord int, pose array<double>, k array<double>, depth_path string, image_path string")
_DDL["DEPTH"] = ("scene_id string, frame_id string, row int, col int, d double")
_DDL["MAPPING"] = ("scene_id string, frame_id string, point_id bigint, row int, col int")
_DDL["RLE"] = ("length int, counts array<int>")
_DDL["MASKS_2D"] = ("scene_id string, frame_id string, mask_id int, rle struct<size:array<int>,counts:array<int>>, feat array<float>, conf double, label string")
_DDL["BOX_2D"] = ("x1 double, y1 double, x2 double, y2 double")
_DDL["BOX_3D"] = ("min array<double>, max array<double>")
_DDL["INSTANCE_POINTS"] = ("scene_id string, inst_id bigint, point_id bigint")
_DDL["GROUPS"] = ("scene_id string, node int, grp bigint, spp bigint, cnt int, weight double")
_DDL["INSTANCES"] = ("scene_id string, inst_id bigint, conf double, class_id int, score double, src string")
_DDL["TEXT_FEATURES"] = ("class_id int, name string, emb array<float>")
_DDL["CLASS_GROUPS"] = ("name string, grp string")
_DDL["QUERY_TABLE"] = (
    "video_id string, visit_id string, query string, rotate int, groundedSAM string, CLIP_query string, Score double, p3d int, p2d int, box_thresh double, "
    "text_thresh double, depth_thresh double, post_filter double, panoptic_filter int, num_filter int, maskwise int, size_shrink int, note string"
)
_DDL["MATCHES"] = ("scan string, label string, gt_id bigint, pred_id bigint, inter bigint, iou double")
_DDL["LABEL_PIXELS"] = ("frame_id string, row int, col int, label int, score double")
#: The sentinel of points without a label.
IGNORE = -100
