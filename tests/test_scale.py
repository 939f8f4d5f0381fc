"""Searches, sums, joins and sources that work in pieces, against plain Python over the whole."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from plumbline import ranking
from plumbline.operators import evaluation, netlist, retrieval, spatial
from plumbline.plans import filed
from plumbline.sources import dxf, dxf_format
from plumbline.streaming import landing


def _corpus(spark, seed, n=260, corpus=None):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(90)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40), weights=[1 / (i + 1) for i in range(90)])) for _ in range(n)] + ["", "the of", "w3 w3 w3"]
    asked = [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(25)] + ["zzz", texts[5], texts[8]]
    docs = spark.createDataFrame([(f"d{i:04}", t) for i, t in enumerate(texts)], "doc string, text string")
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "query int, text string")
    if corpus:
        docs, queries = docs.withColumn("corpus", F.when(F.col("doc") < "d0150", "a").otherwise("b")), queries.withColumn("corpus", F.when(F.col("query") % 2 == 0, "a").otherwise("b"))
    return docs, queries


def _best(rows, k):
    found = collections.defaultdict(list)
    for r in rows:
        found[r["query"]].append((-round(r["score"], 9), r["doc"]))
    return {q: sorted(v)[:k] for q, v in found.items()}


@pytest.mark.parametrize("corpus", [False, True])
def test_pruned_search_finds_the_best(spark, monkeypatch, corpus):
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    docs, queries = _corpus(spark, 4, corpus=corpus)
    for sought in (retrieval.sought_bm25(docs, queries), retrieval.sought_tfidf(docs, queries)):
        whole = sought.scores().collect()
        for k in (1, 4):
            assert _best(sought.best(k).collect(), k) == _best(whole, k)


def test_limits_reach_the_window(spark, capsys):
    scores = spark.createDataFrame([(i % 3, i, i / 7) for i in range(60)], "query int, doc int, score double")
    retrieval.top_k(scores, 2).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


@pytest.mark.parametrize("corpus", [False, True])
def test_fusion_ranks_as_all_documents_sorted(spark, corpus):
    docs, queries = _corpus(spark, 7, corpus=corpus)
    sparse, dense = retrieval.bm25(docs, queries), retrieval.tfidf(docs, queries)
    if not corpus:  # some negative scores too
        sparse = sparse.withColumn("score", F.when(F.crc32(F.concat("doc", F.col("query").cast("string")).cast("binary")) % 5 == 0, -F.col("score")).otherwise(F.col("score")))
    home = {r["doc"]: r["corpus"] if corpus else 0 for r in docs.collect()}
    tables = [{(r["query"], r["doc"]): round(r["score"], 9) for r in t.collect()} for t in (sparse, dense)]
    got = collections.defaultdict(dict)
    for r in retrieval.rrf(sparse, dense, docs, queries, k=5, least=4).collect():
        got[r["query"]][r["doc"]] = (r["bm25_rank"], r["dense_rank"], r["score"])
    for r in queries.collect():
        q, mine = r["query"], [d for d in home if home[d] == (r["corpus"] if corpus else 0)]
        place = [{d: i for i, d in enumerate(sorted(mine, key=lambda d: (-t.get((q, d), 0.0), d)))} for t in tables]  # noqa: B023
        score = {d: 1 / (5 + place[0][d]) + 1 / (5 + place[1][d]) for d in mine}
        assert all(got[q][d] == (place[0][d], place[1][d], pytest.approx(score[d])) for d in got[q])
        best = sorted(mine, key=lambda d: (-round(score[d], 9), d))[:4]
        assert set(best) <= set(got[q]) and len(got[q]) < len(mine)


def test_cosines_leave_odd_vectors_out(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, [1.0]), (5, None)], "doc int, v array<double>")
    got = retrieval.cosines(vectors, vectors.where("doc IN (0, 2, 5)").withColumnRenamed("doc", "query")).collect()
    assert sorted((r["query"], r["doc"], round(r["score"], 6)) for r in got) == [(0, 1, 1.0), (0, 3, 0.707107)]


@pytest.mark.parametrize("corpus", [False, True])
def test_any_embedder_serves_a_search(spark, corpus):
    docs, queries = _corpus(spark, 9, corpus=corpus)
    embed = lambda text: F.array(*(F.size(F.split(text, rf"\bw{i}\b")) - 1 for i in range(3)))
    count = lambda t: [sum(w == f"w{i}" for w in t.split()) for i in range(3)]
    held, asked = docs.collect(), queries.collect()
    want = {}
    for q in asked:
        a, found = count(q["text"]), []
        for d in held:
            b = count(d["text"])
            size = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
            if size and (not corpus or d["corpus"] == q["corpus"]):
                found.append((-round(sum(x * y for x, y in zip(a, b, strict=True)) / size, 9), d["doc"]))
        if found:
            want[q["query"]] = sorted(found)[:3]
    assert _best(retrieval.search(docs, queries, "dense", 3, embed).collect(), 3) == want
    assert {r["query"] for r in retrieval.search(docs, queries, "hybrid", 3, embed).collect()} == {q["query"] for q in asked}


def test_terms_are_counted_in_place(spark):
    rows = spark.createDataFrame([(["b", "a", "b"],), ([],), (["x"],), (None,)], "t array<string>").select(retrieval.counted(F.col("t")).alias("c")).collect()
    assert [r["c"] and [tuple(x) for x in r["c"]] for r in rows[:3]] == [[("a", 1), ("b", 2)], [], [("x", 1)]]


def test_structure_chunks_of_a_long_source(spark):
    rng = random.Random(2)
    text = lambda: "\n".join(rng.choice(["2 A Heading", f"2.{rng.randint(1, 9)} a clause", "plain words", "", "  ", "more of it"]) for _ in range(rng.randint(0, 6)))
    pages = [(s, p, text()) for s in ("x", "y", None) for p in range(1, 60)]
    want = []
    for source in ("x", "y", None):
        n, section, body, at = 0, None, [], None
        for _, p, t in [r for r in pages if r[0] == source]:
            blocks = []
            for line in [x for x in t.split("\n") if x.strip()]:
                if line == "2 A Heading":
                    section, at = line, None
                    continue
                if line.startswith("2.") or at is None:
                    at = [section, [line]]
                    blocks.append(at)
                else:
                    at[1].append(line)
            at = None
            for title, held in blocks:
                want.append((source, p, n, (f"[{title}] " if title else "") + " ".join(held)))
                n += 1
    got = retrieval.structure_chunks(spark.createDataFrame(pages, "source string, page int, text string").repartition(7)).collect()
    assert sorted(((r["source"], r["page"], r["n"], r["text"]) for r in got), key=str) == sorted(want, key=str)


def test_scans_carry_over_ranges(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, i]), rng.randint(0, 5)) for i in rng.sample(range(3000), 700)]
    df = spark.createDataFrame(rows, "g string, k int, v int, n int").repartition(6)
    got = ranking.carried(df, ["g"], ["k"], {"total": F.col("n")}, {"last": F.col("v")}).collect()
    seen = {}
    for g, k, v, n in sorted(rows, key=lambda r: r[1]):
        total, last = seen.get(g, (0, None))
        seen[g] = (total + n, last if v is None else v)
        assert next((r["total"], r["last"]) for r in got if (r["g"], r["k"]) == (g, k)) == (total, last)
    assert len(got) == 700


def test_upper_medians(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 7.5, *range(40)])) for _ in range(901)] + [("one", 3)]
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, v double")
    got = {r["g"]: r["median"] for r in evaluation.upper_median(df, "v", "g").collect()}
    held = collections.defaultdict(list)
    for g, v in rows:
        held[g].append(v)
    order = lambda v: (v is not None, v or 0)
    assert got == {g: sorted(v, key=order)[len(v) // 2] for g, v in held.items()}
    assert [r["median"] for r in evaluation.upper_median(df, "v").collect()] == [sorted((v for _, v in rows), key=order)[len(rows) // 2]]


def test_points_in_boxes_of_all_sizes(spark):
    rng = random.Random(5)
    points = [("d" if i % 3 else "e", i, rng.uniform(-50, 1050), rng.uniform(-50, 1050)) for i in range(400)] + [("d", 900, None, 1.0), ("d", 901, 0.0, 0.0)]
    boxes = []
    for i in range(150):
        x, y, w, h = rng.uniform(0, 900), rng.uniform(0, 900), 10 ** rng.uniform(-3, 3), 10 ** rng.uniform(-3, 3)
        boxes.append(("d" if i % 2 else "e", i, x, y, x + w, y + h, rng.choice([0.0, 5.0])))
    boxes += [("d", 500, 0.0, 0.0, 0.0, 0.0, 0.0), ("d", 501, None, 0.0, 1.0, 1.0, 0.0)]
    want = sorted((p[1], b[1]) for p in points for b in boxes if p[0] == b[0] and None not in (*p, *b) and b[2] - b[6] <= p[2] <= b[4] + b[6] and b[3] - b[6] <= p[3] <= b[5] + b[6])
    frame = spark.createDataFrame(boxes, "drawing_id string, b int, x_min double, y_min double, x_max double, y_max double, pad double")
    got = spatial.points_in_boxes(spark.createDataFrame(points, "drawing_id string, p int, px double, py double"), frame, pad=F.col("pad"))
    assert sorted((r["p"], r["b"]) for r in got.collect()) == want and len(want) > 100
    assert spatial.points_in_boxes(spark.createDataFrame(points, "drawing_id string, p int, px double, py double"), frame.limit(0)).count() == 0


def _board(seed):
    """Nets of one drawing, with ways that join where ``seed`` is odd."""
    rng = random.Random(seed)
    tags, nets = ["S"], []
    for i in range(rng.randint(8, 30)):
        above = rng.sample(tags, min(len(tags), 1 if seed % 2 == 0 else rng.choice([1, 1, 2])))
        new = [f"T{i}_{j}" for j in range(rng.randint(1, 3))]
        nets.append([*above, *new])
        tags += new
    return [(f"b{seed}", n, t) for n, net in enumerate(nets) for t in set(net)] + [(f"b{seed}", 999, "alone")]


def test_sums_of_what_lies_below(spark):
    rows = [r for seed in range(8) for r in _board(seed)]
    rng = random.Random(1)
    parts = [(d, t, k, rng.choice(["LIGHT", "CABLE", "RCD"]), {"LOAD_W": str(k % 13), "ID": t}) for k, (d, t) in enumerate(sorted({(d, t) for d, _, t in rows}))]
    attached = spark.createDataFrame(rows, "drawing_id string, net int, tag string").repartition(3)
    frame = spark.createDataFrame(parts, "drawing_id string, tag string, ordinal int, type string, attribs map<string,string>")
    starts = spark.createDataFrame([(f"b{s}", "S") for s in range(8)], "drawing_id string, tag string")
    near = collections.defaultdict(set)
    for d, n, t in rows:
        near[d, t] |= {(d, u) for e, m, u in rows if (e, m) == (d, n) and u != t}
    dist = {(f"b{s}", "S"): 0 for s in range(8)}
    queue = collections.deque(dist)
    while queue:
        at = queue.popleft()
        for to in near[at] - dist.keys():
            dist[to] = dist[at] + 1
            queue.append(to)
    found = netlist.distances(attached, starts)
    assert {(r["drawing_id"], r["tag"]): r["dist"] for r in found.collect()} == dist
    below = {}
    for at in sorted(dist, key=lambda x: -dist[x]):
        below[at] = set().union(*({to, *below[to]} for to in near[at] if dist[to] > dist[at]))
    ways = netlist.ways(attached, found)
    assert {(r["drawing_id"], r["root"], r["tag"]) for r in netlist.downstream(ways).collect()} == {(*a, t[1]) for a, held in below.items() for t in held}
    some = netlist.downstream(ways, starts).collect()
    assert len(some) == len({(r["root"], r["drawing_id"], r["tag"]) for r in some}) == sum(len(below[f"b{s}", "S"]) for s in range(8))
    known = {(d, t): (k, kind, a) for d, t, k, kind, a in parts}
    want = {}
    for at, held in below.items():
        for kind in {known[t][1] for t in held}:
            mine = [t for t in held if known[t][1] == kind]
            want[(*at, kind)] = (len(mine), sum(float(known[t][2]["LOAD_W"]) for t in mine), max(mine, key=lambda t: known[t][0])[1], min(t[1] for t in mine))
    got = {(r["drawing_id"], r["root"], r["type"]): (r["n"], r["total"], r["last"]["ID"], r["first"]["ID"]) for r in netlist.fed(frame, ways).collect()}
    assert got == want
    wanted = spark.createDataFrame([(d, "S", t) for d, t in dist], "drawing_id string, a string, b string")
    paths = {(f"b{s}", "S"): ["S"] for s in range(8)}
    for at in sorted(dist, key=lambda x: dist[x]):
        if dist[at]:
            paths[at] = min(paths[m] for m in near[at] if dist.get(m) == dist[at] - 1) + [at[1]]
    assert {(r["drawing_id"], r["b"]): r["path"] for r in netlist.paths(attached, wanted).collect()} == paths


def test_nothing_lies_below_nothing(spark):
    none = spark.createDataFrame([], "drawing_id string, net int, tag string")
    parts = spark.createDataFrame([], "drawing_id string, tag string, ordinal int, type string, attribs map<string,string>")
    ways = netlist.ways(none, netlist.distances(none, none.select("drawing_id", "tag")))
    assert netlist.fed(parts, ways).count() == netlist.downstream(ways).count() == 0


def _drawing(n):
    line = lambda i: f"0\nLINE\n5\n{i:X}\n8\nL{i % 3}\n10\n{i}\n20\n0\n11\n{i}\n21\n{i + 1}\n"
    return "0\nSECTION\n2\nENTITIES\n" + "".join(map(line, range(n))) + "0\nENDSEC\n0\nEOF\n"


def test_damaged_drawings_keep_what_lies_before_and_after():
    whole = _drawing(40)
    lines = whole.split("\n")
    assert dxf.parse_counted(whole)[1] == 0
    rng = random.Random(4)
    for at in rng.sample(range(30, len(lines) - 30), 60):
        for damage in (lambda x: x[:at] + x[at + 1 :], lambda x: x[:at] + ["noise"] + x[at:], lambda x: x[:at] + ["\x00\x01 junk", "x", "y"] + x[at + 5 :]):  # noqa: B023
            _, errors, warnings, rows = dxf.parse_counted("\n".join(damage(lines)))
            handles = {r["handle"] for r in rows}
            near = (at - 4) // 14  # a line and its neighbours may be lost, no others
            assert {f"{i:X}" for i in range(40) if abs(i - near) > 1} <= handles, (at, errors, warnings)
    cut = dxf.parse_counted("\n".join(lines[:200]))
    assert len(cut[3]) >= 13 and dxf.parse_counted("0\nSECTION\n2\nENTITIES\n0")[1] == 1


def test_dxf_is_a_format(spark, tmp_path):
    dxf_format.register(spark)
    for name, n in (("a", 3), ("b", 5), ("sub/c", 2)):
        (tmp_path / f"{name}.dxf").parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.dxf").write_text(_drawing(n))
    (tmp_path / "no.dxf").write_text("no drawing")
    (tmp_path / "other.txt").write_text(_drawing(1))
    whole = spark.read.format("dxf").load(str(tmp_path))
    plain = dxf.entities(dxf.read_dxf(spark, str(tmp_path)))
    assert whole.columns == plain.columns and sorted(map(str, whole.collect())) == sorted(map(str, plain.collect()))
    assert whole.where("drawing_id = 'b'").count() == 5 and whole.where("drawing_id = 'b' AND drawing_id = 'a'").count() == 0
    assert "b.dxf" not in str([p.paths for p in _partitions(tmp_path, {"a"})]) and len(_partitions(tmp_path, None, 1)) == 4
    narrow = spark.read.format("dxf").schema("layer string, length double").load(f"file:{tmp_path}/sub/c.dxf")
    assert sorted(map(tuple, narrow.collect())) == [("L0", 1.0), ("L1", 2.0)]
    with pytest.raises(Exception, match="not a DXF file"):
        spark.read.format("dxf").option("mode", "FAILFAST").load(str(tmp_path)).count()


def _partitions(folder, wanted, most=1 << 20):
    from pyspark.sql.types import StructType

    reader = dxf_format.DxfReader({"path": str(folder), "bytes": str(most)}, StructType())
    reader.wanted = wanted
    return reader.partitions()


def test_dxf_files_are_taken_once_by_a_stream(spark, tmp_path):
    dxf_format.register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.dxf").write_text(_drawing(3))

    def run():
        stream = spark.readStream.format("dxf").load(str(tmp_path / "in")).select("drawing_id", "handle", "length")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        return collections.Counter(r["drawing_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == {"a": 3}
    (tmp_path / "in" / "b.dxf").write_text(_drawing(4))
    assert run() == {"a": 3, "b": 4} == run()


def test_drawings_written_from_a_table_are_read_again(spark, tmp_path):
    spark.createDataFrame([(k, k % 9 + 1) for k in range(1, 300)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    rows = filed.dxf_files(spark, str(tmp_path)).collect()
    assert {r["k"] for r in rows} == set(range(1, 300)) and {r["drawing_id"] for r in rows if r["errors"]} == {"plan-5", "plan-10"}
    one = next(r for r in rows if r["k"] == 250)
    assert (one["drawing_id"], one["area"], one["label"], one["tag"]) == ("plan-10", (250 % 9 * 100 + 1100) * (250 % 31 * 100 + 1800), "ROOM 10", "D250")


def test_refused_uploads_are_kept_with_a_reason(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in" / "again").mkdir(parents=True)
    for name, content in (("good.dxf", _drawing(2)), ("bad.dxf", "no drawing"), ("paper.pdf", "no paper"), ("tune.mp3", "la")):
        (tmp_path / "in" / name).write_text(content)

    def run():
        query = landing.quarantine(landing.refused(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
        assert query.awaitTermination(180) and query.exception() is None
        return {(r["name"], r["attempt"]): r["reason"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    first = run()
    assert set(first) == {("bad.dxf", 1), ("paper.pdf", 1), ("tune.mp3", 1)}
    assert "sections" in first["bad.dxf", 1] and "PDF" in first["paper.pdf", 1] and "kinds" in first["tune.mp3", 1]
    (tmp_path / "in" / "again" / "bad.dxf").write_text("still none")
    assert set(run()) == {*first, ("bad.dxf", 2)}
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
