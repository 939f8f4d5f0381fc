"""Scratch tables, numbering, components and searches on graphs, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline import graph, ranking, staging
from plumbline.operators import netlist


class _Session:
    """As much of a session as the choice of a scratch folder looks at."""

    def __init__(self, master, **conf):
        self.sparkContext = type("Context", (), {"master": master})()
        self.conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: conf.get(name.replace(".", "_"), default))})()


def test_scratch_is_shared_on_clusters():
    assert staging.scratch_root(_Session("yarn", spark_checkpoint_dir="hdfs://a/b/")) == "hdfs://a/b"
    assert staging.scratch_root(_Session("yarn", spark_sql_warehouse_dir="s3a://w")) == "s3a://w/_scratch"
    with pytest.raises(RuntimeError):
        staging.scratch_root(_Session("yarn", spark_sql_warehouse_dir="file:/w"))
    assert "plumbline-" in staging.scratch_root(_Session("local[2]", spark_sql_warehouse_dir="file:/w"))


def test_staged_tables_can_be_deleted(spark):
    table = staging.stage(spark.range(5), "five")
    assert table.count() == 5
    staging.discard(table)
    with pytest.raises(Exception, match="(?i)path|exist|file"):
        spark.read.parquet(table._plumbline_path).count()


def test_numbers_follow_the_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i) for i in rng.sample(range(10_000), 600)]
    df = spark.createDataFrame(rows, "g string, k long").repartition(5)
    got = {(r["g"], r["k"]): r["n"] for r in ranking.number_in_order(df.where("g IS NOT NULL"), ["g"], ["k"], "n").collect()}
    for g in "ab":
        assert [got[(g, k)] for k in sorted(k for h, k in rows if h == g)] == list(range(sum(h == g for h, _ in rows)))
    whole = ranking.number_in_order(df, [], ["k"], "n").collect()
    assert [r["n"] for r in sorted(whole, key=lambda r: r["k"])] == list(range(600))
    cells = ranking.number_within(staging.stage(df, "n"), ["g"], F.xxhash64("k"), [F.col("k")], "n", 7).collect()
    for g in ("a", "b", None):
        assert sorted(r["n"] for r in cells if r["g"] == g) == list(range(sum(h == g for h, _ in rows)))


def test_components_with_hubs_and_chains(spark, monkeypatch):
    monkeypatch.setattr(graph, "CELL", 5)  # so that hubs are cut into many cells
    rng = random.Random(4)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(7, 7), (None, 3), (5, 0)]
    parent = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    seen = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in seen}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError):
        graph.connected_components(spark.createDataFrame([(i, i + 1) for i in range(99)], "a long, b long"), most_rounds=1)


def test_searches_end_or_raise(spark):
    ring = [("d", f"n{i}", f"n{(i + 1) % 9}") for i in range(9)]
    edges = spark.createDataFrame(ring + [(d, b, a) for d, a, b in ring], "drawing_id string, a string, b string")
    start = spark.createDataFrame([("d", "n0")], "drawing_id string, tag string")
    dist = {r["tag"]: r["dist"] for r in netlist.distances(edges, start).collect()}
    assert dist == {f"n{i}": min(i, 9 - i) for i in range(9)}
    wanted = spark.createDataFrame([("d", "n0", "n4"), ("d", "n0", "n0"), ("d", "n0", "zz"), ("e", "n0", "n1")], "drawing_id string, a string, b string")
    assert sorted((r["b"], r["path"], r["hops"]) for r in netlist.paths(edges, wanted).collect()) == [("n0", ["n0"], 0), ("n4", ["n0", "n1", "n2", "n3", "n4"], 4)]
    for search in (lambda: netlist.distances(edges, start, most=2), lambda: netlist.paths(edges, wanted, most=2)):
        with pytest.raises(RuntimeError):
            search()
