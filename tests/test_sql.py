"""Operators called from SQL give what the registry gives."""

import duckdb
import pytest

from plumbline import registry, sql
from plumbline.plans import called

SF = "/root/testdata/sf0.001"

#: One call of each function, and of some a second one with other arguments.
CALLS = [
    ("drawing_info", {}), ("list_layers", {}), ("count_entities", {}), ("count_entities", {"entity_type": "polyline, CIRCLE", "layer": " rooms "}), ("count_entities", {"block_name": "door"}),
    ("count_entities", {"diameter": 8.0}), ("count_entities", {"text_contains": "bed"}), ("total_length", {"layer": "WALLS"}), ("total_length", {"entity_type": "CIRCLE"}), ("find_text", {"pattern": "bed"}),
    ("find_text", {"pattern": "o", "layer": "ROOM_NAMES"}), ("list_dimensions", {}), ("labeled_regions", {}), ("labeled_regions", {"layer": "rooms", "label_contains": "Bed"}), ("block_inserts", {}),
    ("block_inserts", {"block_name": "door", "layer": "doors"}), ("circles", {}), ("circles", {"layer": "holes"}), ("entities_in_region", {"x_min": 0.0, "y_min": 0.0, "x_max": 5000.0, "y_max": 5000.0}),
    ("layer_extents", {"layer": "walls"}), ("count_per_region", {"layer": "ROOM_NAMES"}), ("count_per_region", {"layer": "doors", "region_layer": "ROOMS"}), ("components", {}), ("components", {"component_type": "mcb"}),
    ("components", {"attribute": "rating_a"}), ("components", {"attribute": "RATING_A", "value": "16.0"}), ("component_details", {"tag": " c1 "}), ("connected_to", {"tag": "MAIN"}), ("downstream", {"tag": "c1"}),
    ("downstream_summary", {}), ("downstream_summary", {"component_type": "cable"}), ("bill_of_materials", {}), ("sum_attribute", {"attribute": "load_w"}), ("sum_attribute", {"attribute": "LENGTH_M", "component_type": "cable"}),
]


@pytest.fixture(scope="module")
def known(spark, facts):
    sql.register(spark, facts)
    return facts


def _rows(df):
    return sorted((repr(sorted(r.asDict(recursive=True).items())) for r in df.collect()))


def _call(spark, name, arguments):
    return spark.sql(f"SELECT * FROM {name}({', '.join(f'{a} => {v!r}' + ('D' if isinstance(v, float) else '') for a, v in arguments.items())})")


@pytest.mark.parametrize("name,arguments", CALLS, ids=lambda x: x if isinstance(x, str) else "-".join(x) or "plain")
def test_calls_from_sql(spark, known, name, arguments):
    got, want = _rows(_call(spark, name, arguments)), _rows(registry.call(known, name, arguments))
    assert got == want
    assert got, "the call finds nothing, so it shows nothing"


def test_every_operator_but_the_search_for_ways(known):
    assert set(sql.functions()) == set(registry.OPERATORS) - {"path_between"} == {name for name, _ in CALLS}


def test_conditions_reach_the_scan(spark, known):
    plan = _call(spark, "count_entities", {"entity_type": "LINE"})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "text#" not in plan.split("ReadSchema")[0].split("FileScan")[-1]
    one = _call(spark, "find_text", {"pattern": "bed"})._jdf.queryExecution().executedPlan().toString()
    assert "In(type, [MTEXT,TEXT])" in one


def test_only_what_is_asked_for_is_made(spark, facts):
    from plumbline.operators.planner import Facts

    fresh = Facts(facts.entities, facts.sheets)
    sql.register(spark, fresh, ["list_dimensions", "labeled_regions"])
    assert set(vars(fresh)) == {"entities", "sheets", "regions"}
    joined = spark.sql("SELECT count(*) AS n FROM labeled_regions() AS r JOIN list_dimensions() AS d USING (drawing_id)").first()
    assert joined["n"] > 0


def test_wrong_calls_raise(spark, known):
    for text in ("SELECT * FROM find_text()", "SELECT * FROM find_text(1, 2, 3)", "SELECT * FROM circles(colour => 'red')"):
        with pytest.raises(Exception):
            spark.sql(text).collect()


@pytest.mark.parametrize("name", sorted(called.QUERIES))
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for table in ("part", "customer", "orders", "supplier", "benchmark", "documents"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want, got = db.execute(called.ORACLE[name]), called.QUERIES[name](spark, SF)
    order = sorted(range(len(want.description)), key=lambda i: want.description[i][0])
    assert [want.description[i][0] for i in order] == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[i] for i in order) for r in want.fetchall()))) == sorted(map(repr, (tuple(r[c] for c in sorted(got.columns)) for r in got.collect())))
