"""Routes, plans, checks and questions over the sample drawings, from files to scores."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline import registry
from plumbline.operators import compliance, evaluation, planner, questions, retrieval, router, textual
from plumbline.sources import documents, rules as made
from plumbline.staging import stage


@pytest.fixture(scope="module")
def chunks(spark, samples):
    return stage(retrieval.chunked(documents.read_pages(spark, str(samples[0] / "specs"))), "chunks")


@pytest.fixture(scope="module")
def manifests(spark, samples):
    return documents.read_manifests(spark, str(samples[0] / "drawings"))


@pytest.fixture(scope="module")
def results(facts, chunks, manifests):
    return stage(questions.run(stage(questions.generate(manifests), "questions"), facts, chunks), "results")


def test_plain_questions_are_all_answered_right(results):
    wrong = results.where("variant = 'canonical' AND NOT coalesce(correct, false)").select("question_id", "expected", "final").collect()
    assert wrong == [] and results.where("variant = 'canonical'").count() > 250
    routes = evaluation.routing_accuracy(results.where("variant = 'canonical'")).first()
    assert routes["share"] == 1.0
    said = evaluation.report(results)
    assert "| compliance | building | canonical | 100.0 % |" in said


def test_verdicts_tell_what_fails(facts, chunks, manifests, samples):
    found = {(r["drawing_id"], r["check"]): r for r in questions.verdicts(facts, documents.specs_of(manifests), chunks).collect()}
    for name, m in samples[1].items():
        if m["kind"] == "floorplan":
            assert found[(name, "door")]["failing"] == sorted(r["name"] for r in m["rooms"] if r["door_width"] < (750 if r["name"].startswith("BATH") else 800))
        if m["kind"] == "electrical":
            assert found[(name, "length")]["failing"] == sorted(c["tag"] for c in m["circuits"] if c["cable_length_m"] > made.RUN_M[c["cable_size"]])
            assert found[(name, "main")]["verdict"] == ("FAIL" if m["main_rating_a"] < 63 else "PASS")


def test_unknown_limits_leave_the_verdict_open(spark, facts, manifests):
    none = spark.createDataFrame([], "spec string, check string, size double, limit double, clause string")
    found = compliance.verdicts(questions.items(facts, documents.specs_of(manifests), none)).collect()
    assert found and all(r["verdict"] is None and r["failing"] == [] for r in found)


def test_specifications_are_found_and_kept_apart(spark, chunks):
    for source, asked in made.ASKED.items():
        pages = spark.createDataFrame(made.spec_pages(source), "source string, page int, text string")
        rows = spark.createDataFrame([(str(i), text, clause) for i, (text, clause) in enumerate(asked)], "query string, text string, clause string")
        report = {r["mode"]: r for r in evaluation.retrieval_report(pages, rows, {"structure": retrieval.structure_chunks}).collect()}
        assert report["hybrid"]["recall_3"] >= 0.8
    both = spark.createDataFrame([(s, f"{s}{i}", text) for s, asked in made.ASKED.items() for i, (text, _) in enumerate(asked)] + [("building", "zoo", "zebras quagga okapi")], "corpus string, query string, text string")
    said = {r["query"]: r for r in retrieval.spec_answers(both, chunks).collect()}
    assert said["zoo"]["final"] == "NOT_FOUND" and said["zoo"]["sources"] == []
    hits = sum(any(f" {clause} " in f" {t} " for t in said[f"{s}{i}"]["sources"]) for s, asked in made.ASKED.items() for i, (_, clause) in enumerate(asked))
    assert hits >= 13
    alone = chunks.where("source = 'building'")
    apart = {r["query"]: r["sources"] for r in retrieval.spec_answers(both.where("corpus = 'building'"), alone).collect()}
    assert all(said[q]["sources"] == t for q, t in apart.items())  # another corpus changes nothing
    ids = [r["id"] for r in chunks.orderBy("source", "page", "n").collect()]
    assert ids[0] == "building:p1:c0" and len(set(ids)) == len(ids)
    said = retrieval.excerpts(spark.createDataFrame([("q", 1, 2, "5 B", "two"), ("q", 0, 1, None, "one")], "query string, rank int, page int, section string, text string")).first()
    assert said["excerpts"] == "[1] (page 1) one\n\n[2] (page 2; 5 B) two"
    with pytest.raises(ValueError):
        retrieval.chunked(chunks, "other")


def test_routes(spark):
    cases = [
        ("How many rooms are there?", True, True, "compute"), ("Does the corridor meet the minimum width required by the spec?", True, True, "compliance"), ("Where is the kitchen?", True, True, "visual"),
        ("What is the minimum door width?", True, True, "spec"), ("What is the total required length?", True, True, "compute"), ("Where is it?", True, False, "visual"), ("minimum width in the spec", True, False, "compute"), ("Where is it?", False, True, "spec"), (None, True, True, "compute"),
    ]
    rows = spark.createDataFrame(cases, "q string, d boolean, s boolean, want string")
    assert [(r[0], r[1]) for r in rows.select("want", router.route(F.col("q"), F.col("d"), F.col("s"))).collect()] == [(c[3], c[3]) for c in cases]


def test_odd_questions_fall_back(spark, facts):
    rows = spark.createDataFrame([("1", "plan-001", "Tell me a story"), ("2", "no such", "How many rooms?"), ("3", None, None), ("4", "db-001", "What is the rating of breaker c1 in amps?"), ("5", "brk-001", "How many 7 mm holes?")], "question_id string, drawing_id string, question string")
    got = {r["question_id"]: (r["rule"], r["final"]) for r in planner.answers(rows, facts).collect()}
    assert got["1"] == got["3"] == ("C25", None) and got["2"] == ("C15", "0") and got["5"] == ("C12", "0")
    assert got["4"][0] == "C6" and got["4"][1] in ("6", "10", "16", "20", "32")


def test_registry(facts):
    for schema in registry.schemas():
        name, given = schema["name"], {"layer": "ROOMS", "pattern": "KITCHEN", "tag": "MAIN", "tag_a": "MAIN", "tag_b": "C1", "attribute": "LOAD_W", "x_min": 0, "y_min": "0", "x_max": 1e5, "y_max": 1e5}
        arguments = {a: given[a] for a in schema["parameters"]["required"]}
        assert registry.call(facts, name, arguments).count() > 0, name
    assert len(registry.OPERATORS) == 20
    for name, arguments in (("no_such", {}), ("_path", {}), ("layer_extents", {}), ("circles", {"odd": 1}), ("count_entities", {"diameter": "wide"})):
        assert list(registry.call(facts, name, arguments)) == ["error"]


def test_text_dumps(spark, facts, samples):
    dumps = {r["drawing_id"]: r["text"] for r in textual.compact(facts.entities, facts.sheets).collect()}
    assert dumps["brk-001"].startswith("UNITS: mm\nPOLYLINE OUTLINE closed (0,0) ") and set(dumps) == set(samples[1])
    short = {r["drawing_id"]: r["text"] for r in textual.compact(facts.entities, facts.sheets, 40).collect()}
    assert all(t == dumps[d][:40] + "\n...[truncated]" for d, t in short.items())
    said = {r["drawing_id"]: r["text"] for r in textual.overview(facts.entities, facts.sheets).collect()}["db-001"].split("\n")
    assert [x.split(":")[0].split(" ")[0] for x in said] == ["Drawing", "Extents", "Layers", "Entity", "Blocks", "Text"] and "MCB x" in said[4] and "[attributes: CURVE, RATING_A, TAG]" in said[4]


def test_sources_of_text_and_questions(spark, manifests, samples, tmp_path):
    assert {r["drawing_id"] for r in manifests.collect()} == set(samples[1])
    asked = questions.generate(manifests)
    assert asked.exceptAll(questions.generate(manifests.repartition(3))).count() == 0
    rows = asked.select(F.col("question_id").alias("id"), "kind", "domain", "template", "variant", F.col("drawing_id").alias("drawing"), "spec", "question", "expected", "answer_type", "expected_route")
    documents.write_lines(rows, str(tmp_path / "q"))
    assert documents.read_questions(spark, str(tmp_path / "q")).exceptAll(rows).count() == 0 and rows.count() > 300
    sections = spark.createDataFrame([("s", i, f"{i + 1} T", [(f"{i + 1}.1", "x")]) for i in range(3)], "source string, n int, title string, clauses array<struct<id:string,text:string>>")
    assert sorted(map(tuple, documents.section_pages(sections).collect())) == [("s", 1, "1 T\n1.1 x\n2 T\n2.1 x"), ("s", 2, "3 T\n3.1 x")]
    pages = spark.createDataFrame([("a", 1, " "), ("a", 2, "t"), ("b", 1, None)], "source string, page int, text string")
    assert {r["source"]: r["scanned"] for r in documents.page_facts(pages).collect()} == {"a": False, "b": True}
    with pytest.raises(documents.ScannedDocument):
        documents.with_text(pages)
    assert documents.with_text(pages, lambda _: F.lit("read")).count() == 3
    (tmp_path / "p.json").write_text("\n".join(json.dumps({"source": "s", "page": i, "text": t}) for i, t in ((1, "x"), (2, " "))))
    assert documents.read_pages(spark, str(tmp_path / "p.json")).count() == 1
