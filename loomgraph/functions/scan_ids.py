"""Scan and scene identifiers as they are written by hand: paths, subscans, upper case, lost zeros, other separators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scene, number, scan number; the separators seen are `_`, `-` and blanks.
SCAN_PATTERN = r"(?i)scene[\s_-]*(\d+)[\s_-]+(\d+)"
SCENE_PATTERN = r"(?i)scene[\s_-]*(\d+)"
SUBSCAN_PATTERN = r"(?i)frame_(\d+)_to_(\d+)"


def _number(col: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(col, pattern, group).try_cast("int")


def scene_number(col: Column) -> Column:
    """Number of the scene that the text names; null for null, blank, -1, unknown and anything else without one."""
    return _number(col, SCENE_PATTERN, 1)


def scan_number(col: Column) -> Column:
    """Number of the scan within its scene, or null."""
    return _number(col, SCAN_PATTERN, 2)


def scan_id(col: Column) -> Column:
    """`sceneNNNN_YY` of the scan that the text names, or null."""
    scene, scan = _number(col, SCAN_PATTERN, 1), _number(col, SCAN_PATTERN, 2)
    return F.when(scene.isNotNull() & scan.isNotNull(), F.format_string("scene%04d_%02d", scene, scan))


def first_scan_id(col: Column) -> Column:
    """`sceneNNNN_00` of the scene that the text names, or null."""
    scene = scene_number(col)
    return F.when(scene.isNotNull(), F.format_string("scene%04d_00", scene))


def subscan_range(col: Column) -> Column:
    """Struct (first, last) of the frames of a subscan, nulls for a whole scan."""
    return F.struct(_number(col, SUBSCAN_PATTERN, 1).alias("first"), _number(col, SUBSCAN_PATTERN, 2).alias("last"))
