"""Every query of the core that SQL can express, against DuckDB on the smallest tables."""

import pytest
from oracle import DATA, compare

from loomgraph.plans import core_problems, file_queries, kernel_queries, scene_queries, text_geometry_queries

MODULES = (core_problems, scene_queries, text_geometry_queries, kernel_queries, file_queries)
CASES = [(m, name) for m in MODULES for name in m.SQL]


@pytest.mark.parametrize("module, name", CASES, ids=[n for _, n in CASES])
def test_equals_sql(spark, module, name):
    ours, theirs, extra, missing = compare(spark, name, str(DATA / "sf0.001"), module.QUERIES, module.SQL)
    assert (ours, extra, missing) == (theirs, [], [])


@pytest.mark.parametrize("name", ["p1_table", "principal_boxes", "random_windows", "augmented_objects", "training_rows", "training_texts", "instance_matching", "registration", "json_repair", "random_scenes", "box_suppression", "entity_resolution", "stream_queue_one"])
def test_same_rows_twice(spark, name):
    f = next(m.QUERIES[name] for m in MODULES if name in m.QUERIES)
    folder = str(DATA / "sf0.001")
    first, again = (sorted(map(str, f(spark, folder).collect())) for _ in range(2))
    assert first == again


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
