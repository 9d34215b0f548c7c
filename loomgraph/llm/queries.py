"""Queries of the problems tagged llm and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import canonical, language, leakage, neighbours, ngrams, splits, tokens
from loomgraph.plans.registry import registry
from loomgraph.tables import table

QUERIES, SQL, query = registry()

_NEAR = """
select '{field}' as field_name, id_a, id_b from (
with v as (select {key} as id, any_value({col})::double[] as v from {table} where {col} is not null and len({col}) = 64
    and list_bool_and(list_transform({col}, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform({col}, lambda x: x <> 0)) group by {key}),
u as (select id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u from v),
p as (select a.id as a, b.id as b, list_dot_product(a.u, b.u) as c from u a join u b on a.id <> b.id where list_dot_product(a.u, b.u) >= 0.92),
r as (select *, row_number() over (partition by a order by c desc, b) as rank from p)
select distinct least(a, b) as id_a, greatest(a, b) as id_b from r where rank <= 10)
"""
_NEAREST = " union all ".join(_NEAR.format(field=f"{t}.{c}", table=t, key=k, col=c) for t, k, c in (("object_node", "node_key", "visual_embedding"), ("instance_info", "obs_id", "bert_embedding"), ("instance_info", "obs_id", "feature")))


def _vectors(spark: SparkSession, folder: str) -> list:
    return [
        (table(spark, folder, "object_node"), "node_key", [("object_node.visual_embedding", "visual_embedding")]),
        (table(spark, folder, "instance_info"), "obs_id", [("instance_info.bert_embedding", "bert_embedding"), ("instance_info.feature", "feature")]),
    ]


@query(_NEAREST)
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.similar_pairs(neighbours.nearest(_vectors(spark, folder), k=10, min_cosine=0.92))


@query(_NEAREST.replace("on a.id <> b.id where list_dot_product(a.u, b.u) >= 0.92", "on a.id <> b.id where a.id % 100 = 0").replace("select distinct least(a, b) as id_a, greatest(a, b) as id_b from r", "select a as id_a, b as id_b from r"))
def p2_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar rows, however far, of the rows whose id is divisible by 100, among all rows."""
    return neighbours.nearest_of_some(_vectors(spark, folder), "id % 100 = 0", k=10).select("field_name", F.col("a").alias("id_a"), F.col("b").alias("id_b"))


#: The forest as a search without a threshold needs it: unrelated vectors have no near neighbours, so a large share of the
#: leaves is visited. These are larger, since each gives k rows of every query that visits it.
WIDE = neighbours.ForestRules(share=0.8, leaf_rows=8192)


@query()
def p2_forest(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar rows of the rows whose id is divisible by 100 as the forest finds them; p2_nearest holds the exact ones."""
    return neighbours.nearest(_vectors(spark, folder), k=10, rules=WIDE, asked="_id % 100 = 0").select("field_name", F.col("a").alias("id_a"), F.col("b").alias("id_b"))


@query()
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.map_names(_named(spark, folder), table(spark, folder, "label_table")).select("src", "row_id", "label_id")


@query()
def p3_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.unmatched_values(canonical.map_names(_named(spark, folder), table(spark, folder, "label_table")))


_GROUPS = r"""
with recursive n as (select distinct match_id, try_cast(nullif(regexp_extract(lower(scene_graph_id), 'scene[\s_-]*(\d+)', 1), '') as int) as a,
  try_cast(nullif(regexp_extract(lower(frame_scene), 'scene[\s_-]*(\d+)', 1), '') as int) as b from matcher_row),
e as (select distinct a, b from n where a is not null and b is not null),
l as (select a as x, b as y from e union select b, a from e union select coalesce(a, b), coalesce(a, b) from n where coalesce(a, b) is not null),
r as (select x, y from l union select r.x, l.y from r join l on r.y = l.x),
c as (select x, min(y) as root from r group by x)
"""


@query(_GROUPS + "select match_id, c.root as group_scene from n join c on c.x = coalesce(n.a, n.b)")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every row with a split, by the group that the split was given to."""
    return splits.assign_splits(splits.scene_groups(table(spark, folder, "matcher_row"))).where("split is not null").select("match_id", "group_scene")


@query()
def p4_splits(spark: SparkSession, folder: str) -> DataFrame:
    return splits.assign_splits(splits.scene_groups(table(spark, folder, "matcher_row")))


_SHARES = """, g as (select match_id, c.root as grp from n join c on c.x = coalesce(n.a, n.b)), w as (select grp, count(*) as w from g group by 1), z as (select sum(w) as total, max(w) as largest from w)
select split, target, 0 as groups_cut, true as fits from z, (values ('test', 0.1::double), ('train', 0.8::double), ('validation', 0.1::double)) as t(split, target)"""


@query(_GROUPS + _SHARES)
def p4_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Of each split its target share, the groups that it shares with another, and whether its rows are as many as the target wants, give or take the largest group and the weight of a bin."""
    return splits.share_report(splits.assign_splits(splits.scene_groups(table(spark, folder, "matcher_row"))))


_TERMS = r"""
with v as (select 'instance_info' as src, obs_id as id, any_value(object_name) as value from instance_info where object_name is not null group by obs_id
  union all select 'instance_name_map', map_row_id, any_value(name) from instance_name_map where name is not null group by map_row_id),
t as (select src, id, unnest(regexp_extract_all(lower(value), '[\p{L}\p{N}]+')) as term from v),
c as (select src, term, count(*) as occurrences, count(distinct id) as records from t group by src, term),
n as (select src, count(*) as all_records from v group by src),
m as (select c.*, case when records < 3 then 'rare' when records > 0.04 * all_records then 'common' end as mark from c join n using (src))
"""


def _named(spark: SparkSession, folder: str) -> dict:
    return {"instance_info": (table(spark, folder, "instance_info"), "obs_id", "object_name"), "instance_name_map": (table(spark, folder, "instance_name_map"), "map_row_id", "name")}


@query(_TERMS + "select src, term, mark from m where mark is not null")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.term_marks(_named(spark, folder)).where("n = 1 and mark is not null").select("src", "term", "mark")


@query(_TERMS + "select src, term, occurrences, records, coalesce(mark, '') as mark from m")
def p7_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.term_marks(_named(spark, folder)).where("n = 1").select("src", "term", "occurrences", "records", F.coalesce("mark", F.lit("")).alias("mark"))


_PHRASES = r"""
with v as (select 'instance_info' as src, obs_id as id, any_value(object_name) as value from instance_info where object_name is not null group by obs_id
  union all select 'instance_name_map', map_row_id, any_value(name) from instance_name_map where name is not null group by map_row_id),
t as (select src, id, regexp_extract_all(lower(value), '[\p{L}\p{N}]+') as ts from v),
g as (select src, id, n, unnest(list_transform(range(1, len(ts) - n + 2), lambda i: array_to_string(ts[i:i + n - 1], ' '))) as term from t, (values (2), (3)) as k(n) where len(ts) >= n)
select src, term, n::int as n, count(*) as occurrences, count(distinct id) as records from g group by src, term, n
"""


@query(_PHRASES)
def p7_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the phrases of two and three terms."""
    return ngrams.term_marks(_named(spark, folder)).where("n > 1").select("src", "term", "n", "occurrences", "records")


@query()
def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_column(table(spark, folder, "documents"))


@query()
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Those whose window Myers' distance finds without any edit."""
    leaks = leakage.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return leaks.where("distance = 0").select("doc_id", "item_id")


@query()
def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


@query()
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.mislabelled(language.label_documents(table(spark, folder, "documents"))).select("doc_id", "seg_no", "lang")


@query()
def p10_labels(spark: SparkSession, folder: str) -> DataFrame:
    return language.label_documents(table(spark, folder, "documents"))
