"""Consolidation of many tiny JSON files into few well-sized ones, each record exactly once.

Cumulative-size grouping. The manifest (one row per record) is frozen by a checkpoint, so that the files are parsed once,
and ordered by key; a window sums the bytes in that order; every interval of the target size is one group, and one file is
written per group. The running sum is taken in three levels (within a bucket of frames, over the buckets of a scan, over
the scans of a block), so no task ever holds the whole manifest. Planning is SQL only. The rewrite goes to a folder beside
the target, is read back and reconciled with the manifest, and only then takes the target's place: the number of rows and
the sum of the hashes of keys and vectors must agree, which a lost, repeated or changed record breaks.

Defined cases. A file is readable if its content is valid as a whole: one JSON value (array of records, one record, or an
object from instance id to vector), or one JSON object per line. Blank, null, `null` and empty contents hold no record;
broken files hold none either. Ids may be text or numbers of up to 64 bits; a record without a whole id is no record.
`unread_files` reports the files that are broken and those whose path names no scan and frame. The same record (scan,
frame, instance) in several files counts once: the vector comes from the file in the original place before any copy, then
from the latest one, then from the smallest file_id. Repeated file_ids count once. Empty tables give an empty target.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scan_ids import scan_id
from loomgraph.functions.strict_json import json_lines, strict_json
from loomgraph.session import cut_lineage, move_folder

#: Bytes of one output file.
TARGET_BYTES = 128 * 1024 * 1024
#: Frames of one scan that share a bucket of the running sum, and letters of a scan id that name its block of scans.
FRAMES_PER_BUCKET = 256
BLOCK_LETTERS = 7
#: Fixed value: path of a file in its original place.
ORIGINAL_PATH = r"^scene\d+_\d+/refined_instance/\d+_instance\.json$"
KEYS = ("scan_id", "frame_id", "instance_id")


def _frame(path: Column) -> Column:
    return F.regexp_extract(path, r"(\d+)_[^/]*$", 1).try_cast("bigint")


def parse_files(files: DataFrame) -> DataFrame:
    """file_id, file_path, modified_at, _docs: the JSON documents of a readable file, null for a broken one."""
    one = files.select("file_id", "file_path", "modified_at", "file_content").dropDuplicates(["file_id"])
    text = F.coalesce(F.col("file_content"), F.lit(""))
    # only a text that begins with an object and has line ends can be one object per line
    several = text.rlike(r"^\s*\{") & text.contains("\n")
    lines = F.when(several, F.filter(F.split(text, r"\r?\n"), lambda x: F.length(F.trim(x)) > 0))
    blank = F.when(text.rlike(r"^\s*$"), F.expr("cast(array() as array<variant>)"))
    whole = F.filter(F.array(strict_json(text)), lambda v: v.isNotNull())
    docs = F.coalesce(blank, F.when(F.col("_lines").isNotNull(), json_lines(F.col("_lines"))), F.when(F.size(whole) > 0, whole))
    return one.withColumn("_lines", lines).select("file_id", "file_path", "modified_at", docs.alias("_docs"))


def _whole(text: Column) -> Column:
    """Whole number of a text, of up to 64 bits."""
    exact = F.trim(text).try_cast("decimal(38,6)")
    return F.coalesce(F.trim(text).try_cast("bigint"), F.when(exact == F.floor(exact), exact.try_cast("bigint")))


def read_records(files: DataFrame) -> DataFrame:
    """Every record of every readable file, copies included: scan_id, frame_id, instance_id, feature and where it is from."""
    docs = parse_files(files).select("file_id", scan_id(F.col("file_path")).alias("scan_id"), _frame(F.col("file_path")).alias("frame_id"), F.col("file_path").rlike(ORIGINAL_PATH).alias("original"), "modified_at", F.explode_outer("_docs").alias("_doc"))  # the inner form would filter first and parse for that as well
    parts = files.sparkSession.sql("select d.file_id, d.scan_id, d.frame_id, d.original, d.modified_at, d._doc, e.key as _key, e.value as _value from {docs} d, lateral variant_explode(d._doc) e", docs=docs)
    element = F.col("_key").isNull()
    own = F.col("_key") == "instance_id"
    by_id = F.col("_key").rlike(r"^\s*-?\d+\s*$")
    raw_id = F.when(element, F.try_variant_get("_value", "$.instance_id", "string")).when(own, F.try_variant_get("_value", "$", "string")).when(by_id, F.col("_key"))
    vector = F.when(element, F.try_variant_get("_value", "$.feature", "array<float>")).when(own, F.try_variant_get("_doc", "$.feature", "array<float>")).otherwise(F.try_variant_get("_value", "$", "array<float>"))
    return parts.select("scan_id", "frame_id", _whole(raw_id).alias("instance_id"), vector.alias("feature"), "file_id", "original", "modified_at")


def distinct_records(files: DataFrame) -> DataFrame:
    """Each record once, with its vector, the number of files that hold it and its size in bytes."""
    rank = F.struct("original", "modified_at", (-F.col("file_id")).alias("f"))
    out = read_records(files).groupBy(*KEYS).agg(F.max_by("feature", rank).alias("feature"), F.countDistinct("file_id").alias("copies"))
    out = out.where("scan_id is not null and frame_id is not null and instance_id is not null")
    return out.withColumn("bytes", F.lit(32) + F.coalesce(F.size("feature"), F.lit(0)) * 4)


def unread_files(files: DataFrame) -> DataFrame:
    """file_id, reason: `broken` (its content is not valid as a whole) or `no_place` (its path names no scan and frame)."""
    reason = F.when(F.col("_docs").isNull(), "broken").when(scan_id(F.col("file_path")).isNull() | _frame(F.col("file_path")).isNull(), "no_place")
    return parse_files(files).select("file_id", reason.alias("reason")).where("reason is not null")


def plan_groups(manifest: DataFrame, order: tuple[str, ...] = KEYS, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """The manifest with `group_no`, the interval of target_bytes in which the running sum of bytes before the row falls."""
    bucketed = manifest.withColumns({"_bucket": F.floor(F.col("frame_id") / FRAMES_PER_BUCKET), "_block": F.substring("scan_id", 1, BLOCK_LETTERS)})
    keys = ", ".join(f"m.{c}" for c in order)
    return manifest.sparkSession.sql(
        f"""
        with sizes as (select _block, scan_id, _bucket, sum(bytes) as total from {{manifest}} group by _block, scan_id, _bucket),
             scans as (select _block, scan_id, sum(total) as total from sizes group by _block, scan_id),
             blocks as (select _block, sum(total) as total from scans group by _block),
             block_starts as (select _block, sum(total) over (order by _block) - total as start from blocks),
             scan_starts as (select s.scan_id, b.start + sum(s.total) over (partition by s._block order by s.scan_id) - s.total as start
                             from scans s join block_starts b on s._block = b._block),
             starts as (select s.scan_id, s._bucket, t.start + sum(s.total) over (partition by s.scan_id order by s._bucket) - s.total as start
                        from sizes s join scan_starts t on s.scan_id = t.scan_id)
        select m.*, cast(div(s.start + sum(m.bytes) over (partition by m.scan_id, m._bucket order by {keys} rows unbounded preceding) - m.bytes, {int(target_bytes)}) as bigint) as group_no
        from {{manifest}} m join starts s on m.scan_id = s.scan_id and m._bucket = s._bucket""",
        manifest=bucketed,
    ).drop("_bucket", "_block")


def compact(files: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """All records, each once, with the output file (`group_no`) that each goes to."""
    return plan_groups(cut_lineage(distinct_records(files)), target_bytes=target_bytes)


def group_report(grouped: DataFrame) -> DataFrame:
    """One row per output file: records, bytes, first and last scan."""
    return grouped.groupBy("group_no").agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes"), F.min("scan_id").alias("first_scan"), F.max("scan_id").alias("last_scan"))


def _totals(rows: DataFrame) -> tuple[int, int]:
    """Rows, and the sum of the hashes of their keys and vectors."""
    hashed = F.xxhash64(*KEYS, "feature").cast("decimal(20,0)")
    return tuple(rows.agg(F.count("*"), F.coalesce(F.sum(hashed), F.lit(0))).first())


def write_compacted(files: DataFrame, path: str, target_bytes: int = TARGET_BYTES) -> int:
    """Rewrites the records to one Parquet file per group at path, in place of what was there; returns the number of records."""
    spark = files.sparkSession
    manifest = cut_lineage(distinct_records(files))
    rows, size = manifest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    grouped = plan_groups(manifest, target_bytes=target_bytes)
    beside = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    tasks = max(1, -(-size // target_bytes))
    grouped.repartition(tasks, "group_no").sortWithinPartitions("group_no", *KEYS).write.partitionBy("group_no").parquet(beside)
    want = _totals(manifest)
    got = _totals(spark.read.schema(grouped.schema).parquet(beside))
    if want != got:
        raise RuntimeError(f"{rows} records were planned, {got[0]} other ones are in {beside}")
    move_folder(spark, beside, path)
    return rows


def read_compacted(spark, path: str) -> DataFrame:
    """The records of a target written by write_compacted, with their group_no."""
    return spark.read.schema("scan_id string, frame_id bigint, instance_id bigint, feature array<float>, copies bigint, bytes bigint, group_no bigint").parquet(path)
