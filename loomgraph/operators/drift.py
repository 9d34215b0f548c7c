"""Schema drift between files: one consistent table out of records whose fields come, go, change name or type.

Rescue-column ingestion. Every payload is parsed once to a variant. Values that fit the target column are promoted from
any approved spelling; what is unknown or does not fit is kept as JSON in the rescue column; replay then turns the
rescued forms that are approved (texts that hold arrays, flat arrays, objects) into typed columns. The ingested rows are
written to the shared folder with the shape of each record (spelling, field and kind of its keys). All reports read that
table: shapes are counted per file first, so what is compared between files is a few rows per file. Whether the whole
numbers of a vector are quantised is decided per file from the same table, and recorded.

Defined cases. Null, unreadable and non-object payloads give a row with null columns and `_readable` false; they say
nothing about a file's fields. Repeated keys count once. A key with a null is present but has no type, nor has an empty
array. A file without any readable object, or without a preceding file, is compared with nothing; one whose objects hold
no known field is compared. A fraction in a whole-number column is rescued unless it is whole, as is a number that the
column cannot hold. Columns of the input other than those named are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.strict_json import json_kind, strict_json
from loomgraph.session import cut_lineage, shared_folder

#: The target columns, their types, and every approved spelling.
MATCHER_FIELDS: dict[str, tuple[str, tuple[str, ...]]] = {
    "keypoints0": ("array<array<double>>", ("keypoints0",)),
    "bbox0": ("array<array<double>>", ("bbox0", "bbox_0", "bboxSize0", "bboxes0", "box0")),
    "text_embedding0": ("array<array<double>>", ("text_embedding0", "textEmbedding0", "text_emb0", "name_embedding0")),
    "matches0": ("array<int>", ("matches0",)),
    "frame_id": ("int", ("frame_id", "frameId", "frame", "frame_no")),
    "frame_scene": ("string", ("frame_scene", "frameScene")),
    "scene_graph_id": ("string", ("scene_graph_id", "sceneGraphId", "graph_id")),
    "overlap_ratio": ("double", ("overlap_ratio", "overlapRatio")),
    "num_frames": ("int", ("num_frames", "n_frames", "numFrames")),
}


@dataclass(frozen=True)
class DriftRules:
    """fields: name -> (Spark type, approved spellings). box_keys: order of the keys of a box that is an object.
    integer_scale: what a whole number of a quantised vector is worth; vectors: the fields it holds for."""

    fields: Mapping[str, tuple[str, Sequence[str]]] = field(default_factory=lambda: MATCHER_FIELDS)
    box_keys: Sequence[str] = ("h", "w", "l")
    integer_scale: float = 0.01
    vectors: Sequence[str] = ("text_embedding0",)

    def spelling_map(self) -> dict[str, str]:
        """Spelling, folded to lower-case letters and digits, -> field."""
        return {fold(s): name for name, (_, spellings) in self.fields.items() for s in (name, *spellings)}


def fold(spelling: str) -> str:
    return "".join(c for c in spelling.lower() if c.isalnum())


def field_of(key: Column, rules: DriftRules) -> Column:
    """Field that a key spells in any letter case and with any separators, or null."""
    pairs = [F.lit(x) for pair in rules.spelling_map().items() for x in pair]
    return F.when(key.isin(*rules.fields), key).otherwise(F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_replace(key, "[^A-Za-z0-9]", ""))))


def parse(raw: DataFrame, key: str = "raw_id", payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """Rows by distinct key with `_v`, the payload as a variant where it is a JSON object."""
    one = raw.select(key, *keep, payload).dropDuplicates([key])
    is_object = F.col(payload).rlike(r"^\s*\{")
    return one.withColumn("_v", F.when(is_object, strict_json(F.col(payload)))).drop(payload)


def _boxes(v: Column, rules: DriftRules) -> Column:
    """Rows of numbers from an array of objects."""
    kind = ",".join(f"{k}:double" for k in rules.box_keys)
    return F.transform(F.try_variant_get(v, "$", f"array<struct<{kind}>>"), lambda o: F.array(*[o[k] for k in rules.box_keys]))


def _rows(flat: Column, width: int) -> Column:
    """A flat array cut into rows of a width, if it divides."""
    whole = (F.size(flat) > 0) & (F.size(flat) % width == 0)
    return F.when(whole, F.transform(F.sequence(F.lit(0), (F.size(flat) / width - 1).cast("int")), lambda i: F.slice(flat, (i * width + 1).cast("int"), F.lit(width))))


def _text_rows(text: Column) -> Column:
    """Rows from `a,b;c,d`."""
    rows = F.transform(F.split(text, ";"), lambda r: F.transform(F.split(r, ","), lambda x: F.trim(x).try_cast("double")))
    return F.when(~F.exists(F.flatten(rows), lambda x: x.isNull()), rows)


def _by_type(target: str, rules: DriftRules, e: Column) -> tuple[Column, Column]:
    """Of an entry (value, kind, schema): (value that fits the target as it is, value replayed from a rescued form)."""
    v, kind = e["value"], e["kind"]
    text = F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
    if target == "array<array<double>>":
        fits = F.when(kind.isin("ARRAY<ARRAY<FRACTION>>", "ARRAY<ARRAY<WHOLE>>"), F.try_variant_get(v, "$", target))
        own = F.coalesce(fits, F.when(e["schema"].rlike(r"^(ARRAY<)+VOID>+$"), F.expr("array()").cast(target)))
        flat = F.when(kind.isin("ARRAY<FRACTION>", "ARRAY<WHOLE>"), F.try_variant_get(v, "$", "array<double>"))
        again = F.when(text.rlike(r"^\s*\["), F.try_variant_get(strict_json(text), "$", target)).otherwise(_text_rows(text))
        return own, F.when(kind == "STRING", again).when(kind.startswith("ARRAY<OBJECT"), _boxes(v, rules)).otherwise(_rows(flat, len(rules.box_keys)))
    if target == "int":
        number = F.when(kind == "FRACTION", F.try_variant_get(v, "$", "double"))
        return F.when(kind == "WHOLE", F.try_variant_get(v, "$", "int")), F.coalesce(F.trim(text).try_cast("int"), F.when(number == F.floor(number), number.try_cast("int")))
    if target == "double":
        return F.when(kind.isin("WHOLE", "FRACTION"), F.try_variant_get(v, "$", "double")), F.trim(text).try_cast("double")
    if target == "string":
        return text, F.when(kind.isNotNull() & (kind != "STRING"), F.to_json(v))
    none = F.when(e["schema"] == "ARRAY<VOID>", F.expr("array()").cast(target))
    return F.when(kind.isNotNull() & kind.startswith("ARRAY<"), F.try_variant_get(v, "$", target)).otherwise(none), F.lit(None).cast(target)


KEEP = ("series", "file_name", "file_no", "line_no", "written_at")


def typed_records(raw: DataFrame, rules: DriftRules = DriftRules(), keep: Sequence[str] = KEEP) -> DataFrame:
    """One row for every record: the target columns, `_readable`, `_rescued`, `_replayed`, `_shape` (spelling, field, kind of every key), `_peaks` (per field of rules.vectors the largest whole number, -1 for fractions)."""
    parsed = parse(raw, keep=list(keep))
    keyed = parsed.withColumn("_keyed", F.map_entries(F.try_variant_get("_v", "$", "map<string,variant>")))
    # one entry per key; each stage is a column of its own, so that no later one computes it again
    schemas = keyed.withColumn("_seen", F.transform("_keyed", lambda e: F.struct(e["key"].alias("spelling"), e["value"].alias("value"), F.schema_of_variant(e["value"]).alias("schema"))))
    kinds = schemas.withColumn("_e", F.transform("_seen", lambda e: F.struct(e["spelling"].alias("spelling"), e["value"].alias("value"), e["schema"].alias("schema"), field_of(e["spelling"], rules).alias("field"), json_kind(e["schema"]).alias("kind"))))

    def ranked(name: str, target: str) -> Column:
        """Of each spelling of a field: 0 fits, 1 replayed, 2 nothing fits, 3 null; the spelling, the value, its kind."""

        def rank(e: Column) -> Column:
            own, again = _by_type(target, rules, e)
            return F.transform(F.array(F.struct(own.alias("own"), F.when(own.isNull(), again).alias("again"))), lambda t: F.struct(F.when(t["own"].isNotNull(), 0).when(t["again"].isNotNull(), 1).when(e["kind"].isNotNull(), 2).otherwise(3).alias("rank"), e["spelling"].alias("spelling"), F.coalesce(t["own"], t["again"]).alias("value"), e["kind"].alias("kind")))[0]

        return F.transform(F.filter("_e", lambda e: e["field"] == name), rank)

    of = kinds.withColumns({f"_r_{n}": ranked(n, t) for n, (t, _) in rules.fields.items()})
    of = of.withColumns({f"_b_{n}": F.array_min(f"_r_{n}") for n in rules.fields})
    wrong = lambda n: F.transform(F.filter(f"_r_{n}", lambda r: r["rank"] == 2), lambda r: r["spelling"])
    bad = F.flatten(F.array(*[F.when(F.size(f"_r_{n}") > 1, wrong(n)).when(F.col(f"_b_{n}.rank") == 2, F.array(f"_b_{n}.spelling")).otherwise(F.expr("cast(array() as array<string>)")) for n in rules.fields]))
    replayed = F.array_compact(F.array(*[F.when(F.col(f"_b_{n}.rank") == 1, F.lit(n)) for n in sorted(rules.fields)]))
    out = of.withColumn("_bad", F.coalesce(bad, F.expr("cast(array() as array<string>)")))
    rest = F.filter("_e", lambda e: e["field"].isNull() | F.array_contains("_bad", e["spelling"]))
    rescued = F.when(F.size(rest) > 0, F.to_json(F.map_from_entries(F.transform(rest, lambda e: F.struct(e["spelling"], e["value"])))))
    largest = lambda m: F.aggregate(F.flatten(m), F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    peak = lambda n: F.when(F.col(f"_b_{n}.kind") == "ARRAY<ARRAY<WHOLE>>", largest(F.col(f"_b_{n}.value"))).when(F.col(f"_b_{n}.kind").contains("FRACTION"), -1.0)
    return out.select(
        "raw_id",
        *keep,
        F.col("_v").isNotNull().alias("_readable"),
        *[F.when(F.col(f"_b_{n}.rank") < 2, F.col(f"_b_{n}.value")).cast(t).alias(n) for n, (t, _) in rules.fields.items()],
        rescued.alias("_rescued"),
        replayed.alias("_replayed"),
        F.transform("_e", lambda e: F.struct(e["spelling"].alias("spelling"), e["field"].alias("field"), e["kind"].alias("kind"))).alias("_shape"),
        F.struct(F.lit(0).alias("_"), *[peak(n).alias(n) for n in rules.vectors]).alias("_peaks"),
    )


def quantised_files(records: DataFrame, rules: DriftRules = DriftRules()) -> DataFrame:
    """series, file_no, fields: the vector fields whose numbers are whole in all records of a file, and beyond -1 to 1 in one."""
    whole = [F.when((F.min(f"_peaks.{n}") >= 0) & (F.max(f"_peaks.{n}") > 1), F.lit(n)) for n in rules.vectors]
    return records.groupBy("series", "file_no").agg(F.array_compact(F.array(*whole)).alias("_quantised")).where(F.size("_quantised") > 0)


#: Files up to this number are broadcast when their quantisation is joined to the records.
BROADCAST_FILES = 100_000


def ingest(raw: DataFrame, rules: DriftRules = DriftRules(), keep: Sequence[str] = KEEP) -> DataFrame:
    """One row for every record with all target columns typed, as a table written to the shared folder.

    `_readable`: the payload is a JSON object. `_rescued`: JSON object of the keys that are unknown or whose value fits
    no column even after replay, else null. `_replayed`: the fields whose value came from a rescued form, those of
    quantised files among them. `_shape`: spelling, field and kind of every key. Where a record holds several spellings
    of one field, a value that fits comes before a replayed one, then the smaller spelling.
    """
    spark = raw.sparkSession
    target = shared_folder(spark, "ingested")
    typed = typed_records(raw, rules, keep)
    typed.write.parquet(target)
    records = spark.read.schema(typed.schema).parquet(target)
    if not rules.vectors:
        return records.drop("_peaks")
    files = cut_lineage(quantised_files(records, rules))  # at most a row per file
    small = files.count() <= BROADCAST_FILES
    joined = records.join(F.broadcast(files) if small else files, ["series", "file_no"], "left")
    quantised = lambda n: F.coalesce(F.array_contains("_quantised", n), F.lit(False)) & (F.col(f"_peaks.{n}") >= 0) & ~F.array_contains("_replayed", n)
    scaled = {n: F.when(quantised(n), F.transform(n, lambda r: F.transform(r, lambda x: x * F.lit(rules.integer_scale)))).otherwise(F.col(n)) for n in rules.vectors}
    again = F.array_sort(F.concat("_replayed", F.array_compact(F.array(*[F.when(quantised(n), F.lit(n)) for n in rules.vectors]))))
    return joined.withColumns({**scaled, "_replayed": again}).select("raw_id", *keep, "_readable", *rules.fields, "_rescued", "_replayed", "_shape")


def file_profiles(records: DataFrame, unknown: bool = False) -> DataFrame:
    """series, file_no, file_name, field, spellings, kinds: what the readable records of a file hold of a field, one row with a null field where a file holds none. records: an ingested table. unknown: of the keys that no field approves, under their spelling."""
    shapes = records.where("_readable").groupBy("series", "file_no", "file_name", "_shape").agg(F.lit(1)).drop("1")
    own = F.filter("_shape", lambda e: e["field"].isNull() if unknown else e["field"].isNotNull())
    keys = shapes.select("series", "file_no", "file_name", F.explode_outer(own).alias("e"))
    seen = keys.select("series", "file_no", "file_name", (F.col("e.spelling") if unknown else F.col("e.field")).alias("field"), "e.spelling", "e.kind")
    return seen.groupBy("series", "file_no", "file_name", "field").agg(F.sort_array(F.collect_set("spelling")).alias("spellings"), F.sort_array(F.collect_set("kind")).alias("kinds"))


def schema_changes(records: DataFrame, unknown: bool = False) -> DataFrame:
    """file_name, field_name, change_kind for every field of a file that differs from the preceding file of its series. records: an ingested table.

    Files are compared pairwise by equi-joins on (series, file number, field), so a series of any length is spread over
    all tasks.
    """
    every = cut_lineage(file_profiles(records, unknown))  # a few rows per file, read four times below
    own = every.where("field is not null")
    files = every.groupBy("series", "file_no").agg(F.min("file_name").alias("file_name"))
    pairs = files.join(files.select("series", (F.col("file_no") + 1).alias("file_no")), ["series", "file_no"])
    now = own.select("series", "file_no", "field", F.col("spellings").alias("s1"), F.col("kinds").alias("k1"))
    old = own.select("series", (F.col("file_no") + 1).alias("file_no"), "field", F.col("spellings").alias("s0"), F.col("kinds").alias("k0"))
    both = now.join(old, ["series", "file_no", "field"], "full").join(pairs, ["series", "file_no"])
    known = F.col("s0").isNotNull() & F.col("s1").isNotNull()
    changes = F.filter(
        F.array(
            F.when(F.col("s0").isNull(), "added"),
            F.when(F.col("s1").isNull(), "removed"),
            F.when(known & (F.col("s0") != F.col("s1")), "renamed"),
            F.when(known & (F.size("k0") > 0) & (F.size("k1") > 0) & (F.col("k0") != F.col("k1")), "type_changed"),
        ),
        lambda x: x.isNotNull(),
    )
    return both.select("file_name", F.col("field").alias("field_name"), F.explode(changes).alias("change_kind"))
