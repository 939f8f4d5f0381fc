"""What is staged from drawings is never sent whole to the driver and all executors."""

import collections
import math
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline import graph, staging
from plumbline.functions import geometry
from plumbline.operators import apart, evaluation, netlist, questions, retrieval
from plumbline.plans import asked, composed, drawn
from plumbline.sources import dxf, dxf_format
from plumbline.staging import stage


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_a_netlist_stages_is_not_broadcast(facts):
    for joined in (facts.parts.join(facts.distances, ["drawing_id", "tag"]), facts.attached.join(facts.parts, ["drawing_id", "tag"]), facts.ways.join(facts.fed.groupBy("drawing_id").count(), "drawing_id")):
        assert "BroadcastExchange" not in _plan(joined)


def test_sheets_from_rows_are_those_from_whole_drawings(spark, samples):
    parsed = stage(dxf.read_dxf(spark, str(samples[0] / "drawings"), "FAILFAST"), "parsed")
    codes = parsed.select("drawing_id", "unit_code")
    want = {r["drawing_id"]: r for r in dxf.drawings(parsed).collect()}
    got = dxf.sheets(dxf.entities(parsed).join(codes, "drawing_id").withColumn("drawing_id", F.concat_ws("|", "drawing_id", "unit_code")), F.substring_index("drawing_id", "|", -1).cast("int")).collect()
    assert len(got) == len(want) > 0
    for r in got:
        whole = want[r["drawing_id"].split("|")[0]]
        assert (r["units"], r["to_m"], r["layers"], r["extents"]) == (whole["units"], whole["to_m"], whole["layers"], whole["extents"])


def test_searches_over_links_take_each_hop_from_the_links_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(netlist, "incidence", lambda links: pytest.fail("links are made into nets of two"))
    links = spark.createDataFrame([("d", "a", "b"), ("d", "b", "c"), ("d", "a", "z"), ("d", "z", "c"), ("d", "c", "e"), ("d", "x", "y"), ("d", "c", "c"), ("d", "b", "a")], "drawing_id string, a string, b string")
    starts = spark.createDataFrame([("d", "a")], "drawing_id string, tag string")
    assert {r["tag"]: r["dist"] for r in netlist.distances(links, starts).collect()} == {"a": 0, "b": 1, "z": 1, "c": 2, "e": 3}
    wanted = spark.createDataFrame([("d", "a", "e"), ("d", "e", "a"), ("d", "a", "y"), ("d", "a", "a")], "drawing_id string, a string, b string")
    assert sorted((r["a"], r["b"], r["path"]) for r in netlist.paths(links, wanted).collect()) == [("a", "a", ["a"]), ("a", "e", ["a", "b", "c", "e"]), ("e", "a", ["e", "c", "b", "a"])]


def test_nearest_gives_the_best_cosines_without_a_row_for_each_pair(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(i, [draw.choice([-1.5, -0.25, 0.0, 0.5, 2.0]) for _ in range(3 if i % 7 else 4)]) for i in range(300)] + [(300, None), (301, [None, 1.0, 2.0]), (302, []), (303, [float("nan"), 1.0, 1.0]), (5, [1.0, 2.0, 0.5])]
    vectors = spark.createDataFrame(rows, "doc long, v array<double>").repartition(3)
    asked = vectors.where("doc % 5 = 0").withColumnRenamed("doc", "query")
    asked = asked.where("query <> 5")
    want = sorted(map(tuple, retrieval.top_k(retrieval.cosines(vectors, asked)).select("query", "doc", "rank", F.col("score").cast("string")).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 16)
    monkeypatch.setattr(retrieval, "cosines", lambda *_: pytest.fail("a row for each pair"))
    assert sorted(map(tuple, retrieval.nearest(vectors, asked).select("query", "doc", "rank", F.col("score").cast("string")).collect())) == want


def test_dense_topk_makes_no_row_for_each_pair(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "cosines", lambda *_: pytest.fail("a row for each pair"))
    assert composed.dense_topk(spark, "/root/testdata/sf0.001").count() > 0


def test_no_corpus_is_dealt_to_one_task(spark):
    docs = spark.createDataFrame([(i, f"word{i % 9} other{i % 4} word{i % 5}") for i in range(40)], "doc long, text string")
    asked = spark.createDataFrame([(1, "word3 other1")], "query long, text string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for sought in (retrieval.sought_tfidf(docs, asked), retrieval.sought_bm25(docs, asked)):
            assert not re.search(r"hashpartitioning\(corpus#\d+, \d+\)", _plan(sought.post))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_drawings_are_made_on_all_cores_without_a_function_for_each_vertex(spark):
    plans = drawn._plans(spark, "/root/testdata/sf0.001")
    assert "lambda" not in plans._jdf.queryExecution().optimizedPlan().toString()
    assert plans.where("layer = 'ROOMS'").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    lines = plans.where("vertices IS NOT NULL")
    length = F.when(F.col("type") == "LINE", geometry.segment_length(F.expr("vertices[0].x"), F.expr("vertices[0].y"), F.expr("vertices[1].x"), F.expr("vertices[1].y"))).otherwise(geometry.polyline_length(F.col("vertices"), F.col("closed")))
    area = F.when(F.col("closed"), geometry.polygon_area(F.col("vertices")))
    assert lines.count() > 0 and lines.where(~(F.col("length").eqNullSafe(length) & F.col("area").eqNullSafe(area))).isEmpty()


def test_attributes_that_are_null_are_left_out(spark):
    rows = spark.createDataFrame([("1", "2"), ("1", None), (None, None)], "a string, b string")
    got = [r[0] for r in rows.select(drawn._attribs({"A": F.col("a"), "B": F.col("b")})).collect()]
    assert got == [{"A": "1", "B": "2"}, {"A": "1"}, {}]


def test_limits_hold_the_search_once_staged_not_once_for_each(spark):
    known = questions.limits_of(asked._chunks(spark))
    assert len(known._jdf.queryExecution().toString()) < 200_000
    assert known.count() > 0


def _corpora(spark):
    draw = random.Random(5)
    words = ["alpha", "beta", "gamma", *(f"w{i}" for i in range(30))]
    docs = [(c, f"{c}{i}", " ".join(draw.choice(words[: draw.choice([3, 33])]) for _ in range(draw.randrange(12)))) for c in "xy" for i in range(250)]
    asked = [(c, q, " ".join(draw.choice([*words, "unknown"]) for _ in range(draw.choice([1, 4])))) for c in "xy" for q in range(12)]
    return stage(spark.createDataFrame(docs, "corpus string, doc string, text string"), "docs"), stage(spark.createDataFrame(asked, "corpus string, query long, text string"), "asked")


def test_fusion_gives_the_best_of_all_pairs_without_a_row_for_each(spark, monkeypatch):
    docs, asked = _corpora(spark)
    of = lambda rows: sorted((r["corpus"], r["query"], r["rank"], r["doc"], r["bm25_rank"], r["dense_rank"]) for r in rows.collect())
    want = of(retrieval.top_k(retrieval.rrf(retrieval.bm25(docs, asked), retrieval.tfidf(docs, asked), docs, asked), 3))
    monkeypatch.setattr(retrieval, "CELL_DOCS", 60)  # so that a corpus has several cells and its queries several blocks
    monkeypatch.setattr(retrieval, "CELL_QUERIES", 5)
    both = retrieval.Fusion(retrieval.sought_bm25(docs, asked), retrieval.sought_tfidf(docs, asked), docs, asked, 3)
    assert of(retrieval.top_k(both.fused(), 3)) == want and len(want) == 72


def test_the_retrieval_report_makes_no_row_for_each_pair(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "rrf", lambda *_, **__: pytest.fail("a row for each pair"))
    monkeypatch.setattr(retrieval.Sought, "scores", lambda *_: pytest.fail("a row for each pair"))
    pages = spark.createDataFrame([("s", 1, "1.1 red valve\n1.2 blue pump\n1.3 red pump"), ("t", 1, "2.1 green valve")], "source string, page int, text string")
    asked = spark.createDataFrame([(1, "blue pump", "1.2"), (2, "green valve", "2.1")], "query long, text string, clause string")
    lines = {r["mode"]: (r["chunks"], r["recall_1"]) for r in evaluation.retrieval_report(pages, asked, {"structure": retrieval.structure_chunks}).collect()}
    assert lines == {m: (4, 1.0) for m in ("bm25", "dense", "hybrid")}


def test_texts_are_counted_as_columns_cut_them_without_a_function_for_each_term(spark):
    texts = [(1, "Pipe 2.50 mm, the PIPE 2.50mm; Kelvin İx a_b 1.2.3"), (2, ""), (3, None), (4, "the of")]
    docs = spark.createDataFrame(texts, "doc long, text string")
    for cut, columns in ((retrieval._words(retrieval.STOP), retrieval.tokens(F.col("text"))), (retrieval._word_grams(retrieval.STOP), retrieval._grams(F.col("text"), retrieval.STOP))):
        got = retrieval._split(docs, "doc", cut, "cut")[0]
        want = docs.select(F.lit(0).alias("corpus"), "doc", F.size(columns).alias("size"), retrieval.counted(columns).alias("ts"))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_drawings_are_files_of_one_folder_read_in_few_tasks(spark, tmp_path, monkeypatch):
    texts = spark.createDataFrame([(f"plan-{i}", f"0\nSECTION\n2\nENTITIES\n0\nTEXT\n5\n{i}\n8\nNOTES\n10\n1\n20\n{i}\n1\nnote {i}\n0\nENDSEC\n0\nEOF") for i in range(90)], "name string, value string")
    folder = str(tmp_path / "files")
    dxf_format.write_files(texts, folder)
    assert sorted(x.name for x in (tmp_path / "files").iterdir()) == sorted(f"plan-{i}.dxf" for i in range(90))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")  # a task for each file
    monkeypatch.setattr(staging, "TASKS", 2)
    monkeypatch.setattr(dxf, "HELD", 3)  # several batches from a task
    try:
        parsed = dxf.read_dxf(spark, folder)
        assert parsed.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
        assert sorted(map(tuple, dxf.entities(parsed).select("drawing_id", "ordinal", "text", "cy").collect())) == sorted((f"plan-{i}", 0, f"note {i}", float(i)) for i in range(90))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def _files(table):
    return len([f for f in Path(table._plumbline_path).iterdir() if f.name.endswith(".parquet")])


def test_shuffles_of_points_get_more_tasks_with_more_rows(spark, monkeypatch):
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(staging, "TASK_ROWS", 400)
    try:
        hits = composed._hits(spark, "/root/testdata/sf0.001")
        assert _files(hits) > 2 * int(usual) and spark.conf.get("spark.sql.shuffle.partitions") == usual
        monkeypatch.setattr(staging, "TASK_ROWS", 10**9)
        assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, composed._hits(spark, "/root/testdata/sf0.001").collect()))
        with pytest.raises(Exception, match="absent"):
            stage(hits.selectExpr("raise_error('absent')"), "none", rows=10**12)
        assert spark.conf.get("spark.sql.shuffle.partitions") == usual
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_shuffles_of_components_get_more_tasks_with_more_edges(spark, monkeypatch):
    edges = spark.createDataFrame([(f"s{i % 40}", f"p{i // 2}") for i in range(400)] + [("x", "y")], "a string, b string")
    staged = {}

    def kept(df, label, **told):
        table = stage(df, label, **told)
        staged[label] = _files(table)
        return table

    monkeypatch.setattr(graph, "stage", kept)
    monkeypatch.setattr(staging, "TASK_ROWS", 25)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["node"]: r["component"] for r in graph.connected_components(edges, rows=401).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert staged["cc-pairs"] > 8 and staged["cc-labels"] > 8 and staged["cc-lower"] > 8  # the session has 4
    assert got["x"] == got["y"] == "x" and len(got) == 242 and len(set(got.values())) == 21


@pytest.mark.parametrize("corpus", [False, True])
def test_lengths_move_no_gram_as_a_row(spark, monkeypatch, corpus):
    """Documents' lengths against plain Python, over many chunks and cells; only grams of queries are kept as rows."""
    monkeypatch.setattr(retrieval, "CHUNK_WORDS", 200)
    monkeypatch.setattr(retrieval, "CELL_CHARS", 900)
    rng = random.Random(12)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(60)] + ["the", "Été", "x"], k=rng.randint(0, 60))) for _ in range(120)] + ["", None, "w1 w1 w1 w1"]
    docs = spark.createDataFrame([(i, t, "ab"[i % 2] if corpus else "a") for i, t in enumerate(texts)], "doc int, text string, corpus string")
    queries = spark.createDataFrame([(0, "w1 w2", "a"), (1, "w3", "b")], "query int, text string, corpus string")
    if not corpus:
        docs, queries = docs.drop("corpus"), queries.drop("corpus")
    cut, home = retrieval._word_grams(retrieval.STOP), lambda i: i % 2 if corpus else 0
    grams = [collections.Counter(cut((t or "").lower())) for t in texts]
    n, df = collections.Counter(home(i) for i in range(len(texts))), collections.Counter((home(i), g) for i, held in enumerate(grams) for g in held)
    want = {i: math.sqrt(sum(((1 + math.log(k)) * (math.log((1 + n[home(i)]) / (1 + df[home(i), g])) + 1)) ** 2 for g, k in held.items())) for i, held in enumerate(grams)}
    staged = {}
    monkeypatch.setattr(retrieval, "stage", lambda frame, label, **more: staged.setdefault(label, stage(frame, label, **more)))
    retrieval.sought_tfidf(docs, queries)
    got = {r["doc"]: r["norm"] for r in staged["gram-lengths"].collect()}
    assert got == pytest.approx(want, abs=1e-7)
    assert {t["term"] for r in staged["tfidf-terms"].collect() for t in r["ts"]} == {"w1", "w2", "w1 w2", "w3"}


@pytest.mark.parametrize("corpus", [False, True])
def test_a_hybrid_search_makes_no_row_for_each_pair(spark, monkeypatch, corpus):
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(40)], k=rng.randint(0, 30))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)], "doc int, text string, corpus string")
    queries = spark.createDataFrame([(i, " ".join(rng.choices([f"w{j}" for j in range(40)], k=4)), "ab"[i % 2]) for i in range(8)] + [(8, "zzz", "a")], "query int, text string, corpus string")
    if not corpus:
        docs, queries = docs.drop("corpus"), queries.drop("corpus")
    of = lambda rows: sorted((r["query"], r["rank"], r["doc"], round(r["score"], 9)) for r in rows.collect())
    want = of(retrieval.top_k(retrieval.rrf(retrieval.bm25(docs, queries), retrieval.tfidf(docs, queries), docs, queries), 5))
    monkeypatch.setattr(retrieval, "rrf", lambda *_, **__: pytest.fail("a row for each pair"))
    monkeypatch.setattr(retrieval.Sought, "scores", lambda *_: pytest.fail("a row for each pair"))
    found = retrieval.search(docs, queries)
    assert of(found) == want and len(want) == 45 and ("corpus" in found.columns) == corpus


def test_small_drawings_are_solved_apart_and_large_ones_by_joins(facts, monkeypatch):
    """Nets, distances and what lies below: no join for small drawings, and the same rows where each drawing, or some, is too large for one task."""
    key = lambda rows: sorted(map(tuple, rows.collect()))

    def run():
        attached = netlist.attachments(facts.entities, facts.sheets, facts.parts)
        attached = stage(attached, "test-nets")
        dist = stage(netlist.distances(attached, netlist.sources(facts.parts)), "test-dist")
        return [key(rows.select("drawing_id", *rest)) for rows, rest in ((attached, ("net", "tag")), (dist, ("tag", "dist")), (netlist.downstream(netlist.ways(attached, dist)), ("root", "tag")))]

    with monkeypatch.context() as patch:
        for name in ("touching", "points_in_boxes"):
            patch.setattr(netlist, name, lambda *_, **__: pytest.fail("small drawings went through joins"))
        small = run()
    assert all(small)
    sizes = sorted(r["count"] for r in facts.entities.groupBy("drawing_id").count().collect())
    for most in (0, sizes[len(sizes) // 2]):
        monkeypatch.setattr(apart, "MOST", most)
        assert run() == small
