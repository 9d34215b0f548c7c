"""Named predicates of the pipeline, as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Colour of the background, labels that are no objects, largest side of an object in metres.
BACKGROUND = (152, 223, 138)
NO_OBJECTS = ("floor", "wall", "ceiling", "object")
LARGEST_SIDE = 3.0


def named(name: Column) -> Column:
    """Has a name other than unknown."""
    return F.coalesce((F.trim(name) != "") & (F.lower(F.trim(name)) != "unknown"), F.lit(False))


def alike(similarity: Column, over: float) -> Column:
    """Strictly more alike; not a number never is."""
    return F.coalesce(~F.isnan(similarity) & (similarity > over), F.lit(False))


def near(distance: Column, limit: float) -> Column:
    return F.coalesce(~F.isnan(distance) & (distance < limit), F.lit(False))


def accepted(ratio: Column, iou: Column, r: float = 0.1) -> Column:
    return F.coalesce((ratio > min(0.8, 2 * r)) | (iou > r), F.lit(False))


def solid(size: Column, points: Column, least: int = 10) -> Column:
    """No side over LARGEST_SIDE, and points enough."""
    fits = (size["x"] <= LARGEST_SIDE) & (size["y"] <= LARGEST_SIDE) & (size["z"] <= LARGEST_SIDE)
    return F.coalesce(fits & (points >= least), F.lit(False))


def measured(depth: Column, most: float = 0.0) -> Column:
    """Depth that is there and, unless most is 0, not beyond it."""
    return F.coalesce((depth != 0) & ((F.lit(most) == 0) | (depth <= most)), F.lit(False))


def sampled(position: Column, n: int) -> Column:
    return position % n == 0


def in_image(u: Column, v: Column, width: int, height: int) -> Column:
    return F.coalesce((u >= 0) & (u < width) & (v >= 0) & (v < height), F.lit(False))


def an_object(label: Column, pixels: Column, least: int = 100) -> Column:
    return F.coalesce(~F.lower(label).isin(*NO_OBJECTS) & (pixels > least), F.lit(False))


def without_parts(text: Column, parts: Sequence[str]) -> Column:
    """Holds none of the parts, letter case as it is."""
    out = F.lit(True)
    for p in parts:
        out = out & ~text.contains(p)
    return F.coalesce(out, F.lit(False))


def allowed_tag(tag: Column, most_similar: Column, limit: float) -> Column:
    """Like no denied tag, and no room."""
    return F.coalesce((most_similar < limit) & ~F.lower(tag).contains("room"), F.lit(False))


def detected(confidence: Column, share: Column, class_id: Column, over: float = 0.3) -> Column:
    """Confident, not most of the image, of a known class."""
    return F.coalesce((confidence > over) & (share < 0.8) & (class_id != -1), F.lit(False))


def scenes_between(scene: Column, first: int, last: int) -> Column:
    return F.coalesce(scene.between(first, last), F.lit(False))


def is_training(scene: Column) -> Column:
    """Scene ids below 600 are for training."""
    return F.coalesce(scene < 600, F.lit(False))


def picked(score: Column, top: Column, r: float = 0.2) -> Column:
    """Score of a match that is shown."""
    return F.coalesce(score >= F.greatest(F.lit(0.2), top * 1.8 * r), F.lit(False))


def foreground(r: Column, g: Column, b: Column) -> Column:
    return ~((r == BACKGROUND[0]) & (g == BACKGROUND[1]) & (b == BACKGROUND[2]))


def points_of(points: DataFrame, valid: DataFrame, keys: Sequence[str], id_column: str, keep_background: bool = False) -> DataFrame:
    """Points whose id is valid in their scan; with keep_background also those of id 0."""
    out = points.join(valid.select(*keys, id_column).distinct(), [*keys, id_column], "left_semi")
    return out.unionByName(points.where(F.col(id_column) == 0).join(valid.where(F.col(id_column) == 0).select(*keys, id_column).distinct(), [*keys, id_column], "left_anti")) if keep_background else out


def present_enough(wanted: DataFrame, present: DataFrame, keys: Sequence[str], frame: str, share: float = 0.5) -> DataFrame:
    """keys of which at least the share of the wanted frames are present."""
    there = present.select(*keys, frame).distinct().withColumn("_there", F.lit(1.0))
    return wanted.select(*keys, frame).distinct().join(there, [*keys, frame], "left").groupBy(*keys).agg(F.avg(F.coalesce("_there", F.lit(0.0))).alias("_share")).where(F.col("_share") >= share).select(*keys)
