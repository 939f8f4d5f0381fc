"""Measures, scores and landing of drawings, against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators import evaluation, measures, retrieval, spatial
from plumbline.operators.netlist import tag_of
from plumbline.streaming import landing


def test_counts_and_lengths(facts):
    sheets, rows = facts.sheets, facts.entities
    plain = rows.toPandas()
    got = {r["drawing_id"]: r["n"] for r in measures.count_entities(rows, "POLYLINE", " rooms ").collect()}
    asked = plain[plain["type"].isin(["POLYLINE", "LWPOLYLINE"]) & (plain["layer"].str.upper() == "ROOMS")]
    assert got == asked.groupby("drawing_id").size().to_dict()
    totals = {r["drawing_id"]: r["total_length"] for r in measures.total_length(rows, sheets, "WALLS").collect()}
    walls = plain[plain["layer"].str.upper() == "WALLS"].groupby("drawing_id")["length"].sum().to_dict()
    assert totals == pytest.approx(walls, abs=0.01)
    per_layer = measures.layers(rows).collect()
    assert sum(r["n"] for r in per_layer) == len(plain) == sum(sum(r["types"].values()) for r in per_layer)
    window = measures.in_window(rows, -1e9, -1e9, 1e9, 1e9)
    whole = {r["drawing_id"]: r["n"] for r in window.where("layer IS NULL AND type IS NULL").collect()}
    assert whole == plain[plain["cx"].notna()].groupby("drawing_id").size().to_dict()


def test_columns_of_numbers_and_geometry(spark):
    row = spark.range(1).select(
        G.arc_length(F.lit(2.0), F.lit(350.0), F.lit(10.0)).alias("arc"), G.arc_length(F.lit(1.0), F.lit(30.0), F.lit(30.0)).alias("turn"),
        *(G.general(F.lit(x)).alias(f"g{i}") for i, x in enumerate((0.5, 27.38, 3000.0, 1234567.0, 1e-5, 0.1 + 0.2))),
        G.number(F.lit(" 1,200.5 ")).alias("n"), G.number(F.lit("x")).alias("none"), G.rounded(F.lit(float("nan"))).alias("nan"),
        tag_of(F.create_map(F.lit("TAG"), F.lit(""), F.lit("REFDES"), F.lit("R1"), F.lit("ID"), F.lit("7"))).alias("tag"),
    ).first()
    assert row["arc"] == pytest.approx(2 * math.radians(20)) and row["turn"] == pytest.approx(2 * math.pi)
    assert [row[f"g{i}"] for i in range(6)] == ["0.5", "27.38", "3000", "1234567", "1e-05", "0.3"]
    assert (row["n"], row["none"], row["nan"], row["tag"]) == (1200.5, None, None, "R1")


def test_windows_count_within_a_tolerance(spark, facts):
    near = {r["drawing_id"]: r["n"] for r in spatial.count_per_region(facts.entities, facts.sheets, "ROOM_NAMES", "ROOMS", 0.0).groupBy("drawing_id").agg(F.sum("count").alias("n")).collect()}
    wide = {r["drawing_id"]: r["n"] for r in spatial.count_per_region(facts.entities, facts.sheets, "ROOM_NAMES", "ROOMS", 1000.0).groupBy("drawing_id").agg(F.sum("count").alias("n")).collect()}
    assert all(wide[d] > near[d] for d in near)  # the corridor's name lies within a metre of rooms on both sides


def test_scores(spark):
    cases = [
        ("number", "1,200", "about 1205 mm", "", [], True),
        ("number", "100", "102", "", [], False),
        ("number", "5", None, "", [], False),
        ("label", "C1|C2", "c2", "", [], True),
        ("label", "C3", "", "", [], False),
        ("verdict", "PASS", "pass, all comply", "", [], True),
        ("not_found", "", None, "  NOT_FOUND here", [], True),
        ("clause", "3.1", None, "see 3.1 above", [], True),
        ("clause", "3.1", None, "see 13.1 and 3.12", ["x", "y", "3.1 z"], False),
        ("clause", "3.1", None, "", ["x", "[3 A] 3.1 z"], True),
        ("visual", "", "a", "", [], None),
    ]
    df = spark.createDataFrame([(*c,) for c in cases], "kind string, expected string, final string, text string, sources array<string>, want boolean")
    got = df.select("want", evaluation.correct(F.col("kind"), F.col("expected"), F.col("final"), F.col("text"), F.col("sources")).alias("correct")).collect()
    assert [r["correct"] for r in got] == [r["want"] for r in got]
    said = spark.createDataFrame([("x\nFINAL: 3\nFINAL: **4.**",), ("NOT_FOUND it",), ("none",)], "t string").select(evaluation.final_answer(F.col("t"))).collect()
    assert [r[0] for r in said] == ["4", "NOT_FOUND", None]


def test_retrieval_report(spark):
    pages = spark.createDataFrame([("s", 1, "1 Doors\n1.1 Doors are wide enough here\n1.2 Windows give light to rooms\n1.3 Cables carry current safely")], "source string, page int, text string")
    asked = spark.createDataFrame([("a", "how wide are doors", "1.1"), ("b", "cables and current", "1.3"), ("c", "zebra", "1.2")], "query string, text string, clause string")
    rows = evaluation.retrieval_report(pages, asked, {"structure": retrieval.structure_chunks}).collect()
    assert {r["mode"] for r in rows} == {"bm25", "dense", "hybrid"}
    others = evaluation.retrieval_report(pages, asked, {"fixed": retrieval.fixed_chunks, "sentence": retrieval.sentence_chunks}).collect()
    assert {(r["strategy"], r["mode"]) for r in others} == {(s, m) for s in ("fixed", "sentence") for m in ("bm25", "dense", "hybrid")} and all(r["recall_3"] >= 0.6 for r in others)
    asked = asked.withColumn("corpus", F.lit("s"))
    said = {r["query"]: r["passages"] for r in retrieval.passages(asked, pages, chars=20).collect()}
    assert set(said) == {"a", "b", "c"} and all(len(p) == 1 and len(p[0]) == 20 for p in said.values())
    assert all(r["chunks"] == 3 and r["recall_1"] == pytest.approx(2 / 3, abs=1e-5) for r in rows)


def test_landing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a b.dxf", "x"), ("copy.DXF", "y"), ("skip.txt", "z")):
        (tmp_path / "in" / name).write_text(text)
    stream = landing.arrivals(spark, str(tmp_path / "in"))
    landing.land(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r["upload_id"] for r in rows} == {"up-9dd4e461268c-a-b.dxf", "up-415290769594-copy.dxf"}
    assert landing.valid(spark.read.parquet(str(tmp_path / "out"))).count() == 0


def test_uploads_are_parsed_as_they_come(spark, samples, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "bad.dxf").write_text("no drawing")
    (tmp_path / "in" / "paper.pdf").write_bytes(b"%PDF-1.7 ...")
    (tmp_path / "in" / "plan.dxf").write_text((samples[0] / "drawings" / "plan-001.dxf").read_text())
    stream = landing.valid(landing.arrivals(spark, str(tmp_path / "in")))
    landing.land(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(r["upload_id"][16:] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["paper.pdf", "plan.dxf"]
    query = landing.entities(landing.arrivals(spark, str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "rows")).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None
    rooms = spark.read.parquet(str(tmp_path / "rows")).where("layer = 'ROOMS'").count()
    assert rooms == samples[1]["plan-001"]["counts"]["rooms"]
