"""Queries that ask, check, route and score, through the library's planner, compliance checks, router and evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import compliance, evaluation, netlist, planner, questions, retrieval, router
from plumbline.plans.drawings import BOARDS_SQL, PLATES_SQL, ROOMS_SQL
from plumbline.plans.drawn import drawn
from plumbline.sources import documents, rules
from plumbline.staging import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: What is asked of every plan, board, diagram and plate, by a short name.
ASKED = {
    "plan": {
        "bedrooms": "How many bedrooms are there?", "rooms": "How many rooms are in this plan?", "doors": "How many doors are there in the plan?", "windows": "How many windows does the drawing have?",
        "large": "Which room is the largest?", "small": "Which room is the smallest?", "corridor": "What is the width of the corridor in mm?", "door": "What is the width of the door into the Living 1 in mm?",
        "area": "What is the area of the kitchen 2 in square metres?", "walls": "What is the total length of walls in metres?", "wide": "What is the overall width of the building in mm?", "deep": "How deep is the building overall?", "story": "Tell me a story.",
    },
    "db": {
        "near": "How many parts are directly connected to C3?", "circuits": "How many circuits are in this distribution board?", "components": "What is the number of components?", "sockets": "How many sockets are on the drawing?", "rcds": "Count the RCDs, please.",
        "main": "What is the main switch rating in amps?", "rating": "What is the rating of breaker c2 in amps?", "load": "What is the total connected load of circuit C3 in watts?", "size": "What cable size feeds circuit C3 in sq mm?",
        "cable": "What is the total cable length in metres?", "highest": "Which circuit has the highest connected load?",
    },
    "ckt": {"ohms": "What is the value of R3 in ohms?", "farads": "What is the value of C4?", "leds": "How many LEDs are there?"},
    "brk": {"eight": "How many 8 mm holes are there?", "wide": "Number of holes with a diameter of 12?", "holes": "How many holes does the part have?", "plate": "What is the area of the plate outline?"},
}


def _query(oracle: str | None, *ctes: str):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = ("WITH " + ", ".join(ctes) + " " if ctes else "") + oracle
        return f

    return add


_NUM = "CASE WHEN {0} = floor({0}) THEN ({0})::BIGINT::VARCHAR ELSE ({0})::VARCHAR END"
_PLAN_ANSWERS = f"""
said AS (SELECT drawing_id, unnest([struct_pack(name := 'bedrooms', rule := 'C14', final := count_if(kind = 'BEDROOM')::VARCHAR), struct_pack(name := 'rooms', rule := 'C15', final := count(*)::VARCHAR), struct_pack(name := 'doors', rule := 'C16', final := count(*)::VARCHAR),
  struct_pack(name := 'windows', rule := 'C17', final := count_if(k % 3 <> 0)::VARCHAR), struct_pack(name := 'large', rule := 'C18', final := arg_max(label, struct_pack(a := w * h, r := -region))), struct_pack(name := 'small', rule := 'C18', final := arg_min(label, struct_pack(a := w * h, r := region))),
  struct_pack(name := 'corridor', rule := CASE WHEN count_if(i = 5) > 0 THEN 'C20' ELSE 'C25' END, final := CASE WHEN count_if(i = 5) > 0 THEN (arg_max(least(w, h), struct_pack(a := w * h, r := -region)) FILTER (kind = 'CORRIDOR'))::BIGINT::VARCHAR END),
  struct_pack(name := 'door', rule := CASE WHEN count_if(i = 1) > 0 THEN 'C19' ELSE 'C25' END, final := max(k % 5 * 50 + 650) FILTER (i = 1)::VARCHAR), struct_pack(name := 'area', rule := CASE WHEN count_if(i = 2) > 0 THEN 'C21' ELSE 'C25' END, final := max(CASE WHEN i = 2 THEN {_NUM.format('round(w * h / 1e6, 3)')} END)),
  struct_pack(name := 'walls', rule := 'C22', final := {_NUM.format('round(sum(2 * w + h) / 1000, 3)')}), struct_pack(name := 'wide', rule := 'C23', final := (max(x + w) - min(x))::BIGINT::VARCHAR), struct_pack(name := 'deep', rule := 'C23', final := (max(y + h) - min(y))::BIGINT::VARCHAR), struct_pack(name := 'story', rule := 'C25', final := NULL)], recursive := true) FROM named GROUP BY drawing_id
  UNION ALL SELECT drawing_id, unnest([struct_pack(name := 'near', rule := CASE WHEN count_if(p = 2) > 0 THEN 'C1' ELSE 'C25' END, final := CASE WHEN count_if(p = 2) > 0 THEN (count(*) + 1)::VARCHAR END), struct_pack(name := 'circuits', rule := 'C2', final := count(*)::VARCHAR), struct_pack(name := 'components', rule := 'C3', final := (3 + 2 * count(*) + count(rcd) + sum(n))::BIGINT::VARCHAR),
  struct_pack(name := 'sockets', rule := 'C4', final := coalesce(sum(n) FILTER (kind = 'SOCKET'), 0)::BIGINT::VARCHAR), struct_pack(name := 'rcds', rule := 'C4', final := count(rcd)::VARCHAR), struct_pack(name := 'main', rule := 'C5', final := ([50, 63, 80, 100][any_value(b) % 4 + 1])::VARCHAR),
  struct_pack(name := 'rating', rule := CASE WHEN count_if(p = 1) > 0 THEN 'C6' ELSE 'C25' END, final := max(rating) FILTER (p = 1)::VARCHAR), struct_pack(name := 'load', rule := CASE WHEN count_if(p = 2) > 0 THEN 'C7' ELSE 'C25' END, final := max(total) FILTER (p = 2)::BIGINT::VARCHAR),
  struct_pack(name := 'size', rule := CASE WHEN count_if(p = 2) > 0 THEN 'C8' ELSE 'C25' END, final := max(CASE WHEN p = 2 THEN {_NUM.format('size')} END)), struct_pack(name := 'cable', rule := 'C9', final := sum(length)::BIGINT::VARCHAR), struct_pack(name := 'highest', rule := 'C10', final := arg_max(tag, struct_pack(t := total, p := -p)))], recursive := true) FROM sums GROUP BY drawing_id
  UNION ALL SELECT drawing_id, unnest([struct_pack(name := 'ohms', rule := CASE WHEN count_if(tag = 'R3') > 0 THEN 'C11' ELSE 'C25' END, final := max(s * 10) FILTER (tag = 'R3')::VARCHAR), struct_pack(name := 'farads', rule := CASE WHEN count_if(tag = 'C4') > 0 THEN 'C11' ELSE 'C25' END, final := max((s / 10)::VARCHAR) FILTER (tag = 'C4')),
  struct_pack(name := 'leds', rule := 'C4', final := count_if(type = 'LED')::VARCHAR)], recursive := true) FROM ckt GROUP BY drawing_id
  UNION ALL SELECT drawing_id, unnest([struct_pack(name := 'eight', rule := 'C12', final := count_if(r = 4)::VARCHAR), struct_pack(name := 'wide', rule := 'C12', final := count_if(r = 6)::VARCHAR), struct_pack(name := 'holes', rule := 'C13', final := count(*)::VARCHAR),
  struct_pack(name := 'plate', rule := 'C24', final := (200 * (any_value(d) % 5 * 10 + 50))::VARCHAR)], recursive := true) FROM hole GROUP BY drawing_id)
"""


@_query("SELECT drawing_id, name, rule, final FROM said", ROOMS_SQL, BOARDS_SQL, PLATES_SQL, _PLAN_ANSWERS)
def planner_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = drawn(spark, sf_dir)
    kind = F.regexp_extract("drawing_id", "^([a-z]+)", 1)
    texts = spark.createDataFrame([(k, name, text) for k, asked in ASKED.items() for name, text in asked.items()], "kind string, name string, question string")
    asked = facts.sheets.select("drawing_id", kind.alias("kind")).join(F.broadcast(texts), "kind")
    asked = asked.select(F.concat_ws("/", "drawing_id", "name").alias("question_id"), "drawing_id", "question")
    found = planner.answers(asked, facts)
    return found.select("drawing_id", F.substring_index("question_id", "/", -1).alias("name"), "rule", "final")


def _chunks(spark: SparkSession) -> DataFrame:
    pages = [p for name in rules.ASKED for p in rules.spec_pages(name)]
    return stage(retrieval.chunked(spark.createDataFrame(pages, "source string, page int, text string")), "spec-chunks")


_ITEMS = """
bad AS (SELECT drawing_id, 'window' AS name, label AS item, k % 3 = 0 AS failing FROM named WHERE kind IN ('LIVING', 'BEDROOM', 'STUDY', 'KITCHEN')
  UNION ALL SELECT drawing_id, 'door', label, k % 5 * 50 + 650 < CASE WHEN kind = 'BATH' THEN 750 ELSE 800 END FROM named
  UNION ALL SELECT drawing_id, 'corridor', arg_max(label, struct_pack(a := w * h, r := -region)), arg_max(least(w, h), struct_pack(a := w * h, r := -region)) < 1100 FROM named WHERE kind = 'CORRIDOR' GROUP BY drawing_id
  UNION ALL SELECT drawing_id, 'area', label, w * h / 1e6 < CASE kind WHEN 'BEDROOM' THEN 9.5 WHEN 'LIVING' THEN 13 WHEN 'KITCHEN' THEN 5.5 ELSE 6.5 END FROM named WHERE kind IN ('LIVING', 'BEDROOM', 'STUDY', 'KITCHEN')
  UNION ALL SELECT drawing_id, 'rcd', tag, ma IS NULL OR ma > 30 FROM sums WHERE kind = 'SOCKET' AND n > 0 UNION ALL SELECT drawing_id, 'lighting', tag, rating > 10 FROM sums WHERE kind = 'LIGHT' AND n > 0
  UNION ALL SELECT drawing_id, 'length', tag, length > CASE size WHEN 1.5 THEN 25 WHEN 2.5 THEN 35 WHEN 4 THEN 45 WHEN 6 THEN 55 ELSE 70 END FROM sums
  UNION ALL SELECT drawing_id, 'breaker', tag, rating > CASE size WHEN 1.5 THEN 16 WHEN 2.5 THEN 25 WHEN 4 THEN 32 WHEN 6 THEN 40 ELSE 50 END FROM sums
  UNION ALL SELECT drawing_id, 'load', tag, total > 184 * rating FROM sums UNION ALL SELECT drawing_id, 'main', 'MAIN', [50, 63, 80, 100][b % 4 + 1] < 63 FROM board
  UNION ALL SELECT drawing_id, 'lighting_points', tag, n > 10 FROM sums WHERE kind = 'LIGHT' AND n > 0 UNION ALL SELECT drawing_id, 'socket_points', tag, n > 8 FROM sums WHERE kind = 'SOCKET' AND n > 0)
"""


def _specs(facts: planner.Facts) -> DataFrame:
    spec = F.when(F.startswith("drawing_id", F.lit("plan-")), "building").when(F.startswith("drawing_id", F.lit("db-")), "electrical")
    return facts.sheets.select("drawing_id", spec.alias("spec")).where("spec IS NOT NULL")


@_query("SELECT drawing_id, name AS rule, CASE WHEN bool_or(failing) THEN 'FAIL' ELSE 'PASS' END AS verdict, coalesce(string_agg(item, '; ' ORDER BY item) FILTER (failing), '') AS failing FROM bad GROUP BY drawing_id, name", ROOMS_SQL, BOARDS_SQL, _ITEMS)
def compliance_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = drawn(spark, sf_dir)
    found = questions.verdicts(facts, _specs(facts), _chunks(spark))
    return found.select("drawing_id", F.col("check").alias("rule"), "verdict", F.array_join("failing", "; ").alias("failing"))


@_query("""SELECT d.drawing_id, q.name AS rule, coalesce(v.verdict, CASE WHEN q.name <> 'corridor' THEN 'PASS' END) AS final FROM (SELECT DISTINCT drawing_id, 'plan' AS kind FROM rooms UNION ALL SELECT drawing_id, 'db' FROM board) AS d
  JOIN (SELECT unnest(['corridor', 'door', 'area', 'window']) AS name, 'plan' AS kind UNION ALL SELECT unnest(['breaker', 'load', 'rcd', 'lighting', 'length']), 'db') AS q USING (kind)
  LEFT JOIN (SELECT drawing_id, name, CASE WHEN bool_or(failing) THEN 'FAIL' ELSE 'PASS' END AS verdict FROM bad GROUP BY drawing_id, name) AS v ON v.drawing_id = d.drawing_id AND v.name = q.name""", ROOMS_SQL, BOARDS_SQL, _ITEMS)
def compliance_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = drawn(spark, sf_dir)
    texts = spark.createDataFrame([({"floorplan": "building", "electrical": "electrical"}[k], text) for k, asked in questions.CHECKS.items() for _, text in asked], "spec string, question string")
    asked = _specs(facts).join(F.broadcast(texts), "spec").select(F.concat_ws("/", "drawing_id", "question").alias("question_id"), "drawing_id", "question")
    return compliance.answers(asked, facts.domains, questions.verdicts(facts, _specs(facts), _chunks(spark))).select("drawing_id", F.col("check").alias("rule"), "final")


_WORDS = {name: getattr(router, name).replace("(?U)", "") for name in ("CHECK", "RULE", "SEEN", "SPEC", "DRAWN")}


@_query("""SELECT conv_id, turn, CASE WHEN NOT has_spec THEN CASE WHEN regexp_matches(t, '{SEEN}') THEN 'visual' ELSE 'compute' END WHEN NOT has_drawing THEN 'spec' WHEN regexp_matches(t, '{CHECK}') AND regexp_matches(t, '{RULE}') THEN 'compliance' WHEN regexp_matches(t, '{SEEN}') THEN 'visual'
  WHEN regexp_matches(t, '{SPEC}') AND NOT regexp_matches(t, '{DRAWN}') THEN 'spec' ELSE 'compute' END AS route FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS t, conv_id % 5 <> 0 AS has_spec, conv_id % 7 <> 0 AS has_drawing FROM conversations)""".format(**_WORDS))
def router_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return said.select("conv_id", "turn", router.route(F.col("text"), F.col("conv_id") % 7 != 0, F.col("conv_id") % 5 != 0).alias("route"))


@_query("""SELECT doc_id, CASE WHEN word IN ('compute', 'spec', 'visual', 'compliance') THEN CASE WHEN word IN ('spec', 'compliance') AND doc_id % 2 = 0 THEN 'compute' WHEN word IN ('compute', 'visual', 'compliance') AND doc_id % 3 = 0 THEN 'spec' ELSE word END ELSE 'none' END AS route
  FROM (SELECT doc_id, ['compute', 'spec', 'visual', 'compliance', 'other'][doc_id % 5 + 1] AS word FROM documents)""")
def constrained_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.lit(" ** "), F.get(F.array(*map(F.lit, ["Compute", "SPEC", "visual", "compliance", "other"])), (F.col("doc_id") % 5).cast("int")), F.lit(", as the question asks"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", router.constrained(reply, F.lit("none"), F.col("doc_id") % 3 != 0, F.col("doc_id") % 2 != 0).alias("route"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made answers of all kinds, one per order, some right and some wrong."""
    o = F.col("o_orderkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    kind = F.get(F.array(*map(F.lit, ["number", "label", "verdict", "not_found", "clause"])), (o % 5).cast("int"))
    price, off = F.col("o_totalprice"), (o % 4) / 150
    expected = F.when(kind == "number", F.format_string("%.2f", price)).when(kind == "label", F.concat(F.col("o_orderpriority"), F.lit("|none"))).when(kind == "verdict", F.when(o % 2 == 0, "PASS").otherwise("FAIL")).when(kind == "clause", F.concat((o % 9).cast("string"), F.lit(".1")))
    wrong = o % 3 == 0
    final = F.when(kind == "number", F.format_number(price * (1 + off), 2)).when(kind == "label", F.when(wrong, "other").otherwise(F.lower(F.concat(F.lit("it is "), "o_orderpriority")))).when(kind == "verdict", F.when(wrong, "unclear").otherwise(F.lit("pass, all well"))).when(kind == "not_found", F.when(wrong, "yes").otherwise("NOT_FOUND"))
    text = F.when(kind == "clause", F.concat(F.lit("see "), (o % 9).cast("string"), F.when(wrong, ".12").otherwise(".1"), F.lit(" there"))).otherwise("")
    return orders.select(o.alias("question_id"), kind.alias("kind"), F.col("o_orderstatus").alias("domain"), "o_totalprice", evaluation.correct(kind, expected, final, text, F.lit(None)).alias("correct"))


_RESULTS = """
scored AS (SELECT o_orderkey AS question_id, o_orderstatus AS domain, o_totalprice, ['number', 'label', 'verdict', 'not_found', 'clause'][o_orderkey % 5 + 1] AS kind, CASE o_orderkey % 5
  WHEN 0 THEN abs(round(o_totalprice * (1 + o_orderkey % 4 / 150), 2) - round(o_totalprice, 2)) <= greatest(0.01, 0.01 * round(o_totalprice, 2)) WHEN 2 THEN o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 ELSE o_orderkey % 3 <> 0 END AS correct FROM orders)
"""


@_query("SELECT question_id, kind, correct FROM scored", _RESULTS)
def scored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("question_id", "kind", "correct")


@_query("SELECT kind, domain, count(*) AS n, sum(correct::INT)::BIGINT AS hits, round(avg(correct::INT), 6) AS accuracy FROM scored GROUP BY ROLLUP (kind, domain)", _RESULTS)
def accuracy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.accuracy(_results(spark, sf_dir), "kind", "domain")


@_query("SELECT domain, o_totalprice AS median FROM (SELECT domain, o_totalprice, row_number() OVER (PARTITION BY domain ORDER BY o_totalprice) - 1 AS r, count(*) OVER (PARTITION BY domain) AS n FROM scored) WHERE r = n // 2", _RESULTS)
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.upper_median(_results(spark, sf_dir), "o_totalprice", "domain")


@_query("SELECT turn, count(*) AS n, round(avg((CASE WHEN regexp_matches(lower(text), '{SEEN}') THEN 'visual' ELSE 'compute' END = CASE WHEN conv_id % 2 = 0 THEN 'visual' ELSE 'compute' END)::INT), 6) AS share FROM conversations WHERE conv_id % 4 <> 3 GROUP BY turn".format(**_WORDS))
def routing_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    expected = F.when(F.col("conv_id") % 4 != 3, F.when(F.col("conv_id") % 2 == 0, "visual").otherwise("compute"))
    routed = said.select("turn", router.route(F.col("text"), F.lit(True), F.lit(False)).alias("route"), expected.alias("expected_route"))
    return evaluation.routing_accuracy(routed, "turn")


@_query("SELECT drawing_id, string_agg(label, '|' ORDER BY region) AS ties FROM (SELECT *, rank() OVER (PARTITION BY drawing_id ORDER BY p DESC) AS r FROM (SELECT drawing_id, region, label, k % 31 AS p FROM named)) WHERE r = 1 GROUP BY drawing_id", ROOMS_SQL)
def tied_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = drawn(spark, sf_dir)
    rooms = facts.regions.where("layer = 'ROOMS'").select("drawing_id", F.struct("region", "label", F.col("height").alias("p")).alias("r"))
    held = rooms.groupBy("drawing_id").agg(F.array_sort(F.collect_list("r")).alias("rooms"))
    return held.select("drawing_id", questions.tied(F.col("rooms"), "label", "p").alias("ties"))


@_query("SELECT coalesce(lang, '') || '/' || coalesce(source, '') AS source, count(*) AS pages, sum(length(coalesce(text, '')))::BIGINT AS chars, bool_and(NOT regexp_matches(coalesce(text, ''), '\\S')) AS scanned FROM documents GROUP BY 1")
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return documents.page_facts(docs.select(F.concat(F.coalesce("lang", F.lit("")), F.lit("/"), F.coalesce("source", F.lit(""))).alias("source"), F.col("doc_id").alias("page"), "text"))


_FILES = "files AS (SELECT 's/' || ['plan-', 'brk-', 'db-', 'ckt-', 'odd-'][p_partkey % 5 + 1] || printf('%03d', p_partkey) || '.dxf' AS file, p_partkey AS k FROM part)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    prefix = F.get(F.array(*map(F.lit, ["plan-", "brk-", "db-", "ckt-", "odd-"])), (k % 5).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("s/"), prefix, F.format_string("%03d", k), F.lit(".dxf")).alias("file"), k.alias("k"))


@_query("SELECT file, split_part(split_part(file, '/', 2), '.', 1) AS drawing_id, ['building', 'mechanical', 'electrical', 'electrical'][k % 5 + 1] AS category, ['Floor plan ', 'Bracket ', 'Distribution board ', 'Circuit '][k % 5 + 1] || k AS title FROM files WHERE k % 5 < 4", _FILES)
def sample_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.catalog(_files(spark, sf_dir).select("file"))


@_query("SELECT CASE WHEN k % 4 = 0 THEN '../' ELSE '' END || split_part(file, '/', 2) AS name, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 2 = 0 THEN file WHEN k % 3 = 0 THEN 'up/' || split_part(file, '/', 2) END AS path FROM files", _FILES)
def resolved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stage(_files(spark, sf_dir).withColumn("name", F.substring_index("file", "/", -1)), "files")
    asked = files.select(F.concat(F.when(F.col("k") % 4 == 0, "../").otherwise(""), "name").alias("name"))
    return documents.resolve(asked, files.where("k % 2 = 0").select("name", F.col("file").alias("path")), files.where("k % 3 = 0").select("name", F.concat(F.lit("up/"), "name").alias("path")))


@_query("""WITH f AS (SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(10), ' '), '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM f)
  SELECT 'd' || doc_id || ':p1:s' || (i // 3) AS id, array_to_string(s[i + 1 : i + 3], ' ') AS text FROM (SELECT doc_id, s, unnest(range(0, len(s), 3)) AS i FROM s)""")
def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    pages = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source"), F.lit(1).alias("page"), "text")
    return retrieval.chunked(pages, "sentence").select("id", "text")


def _supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier and part of a return flag once, from supplier to part; searches go either way."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("drawing_id"), "l_suppkey", "l_partkey").distinct()
    return stage(line.select("drawing_id", F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b")), "supplies", grows=True)


_SUPPLIES = "e AS (SELECT DISTINCT l_returnflag AS g, 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem), both_ways AS (SELECT g, a, b FROM e UNION ALL SELECT g, b, a FROM e)"


@_query("SELECT g AS drawing_id, tag, min(dist)::BIGINT AS dist FROM r GROUP BY g, tag", "RECURSIVE " + _SUPPLIES, "r(g, tag, dist) AS (SELECT DISTINCT g, a, 0 FROM e WHERE a = 's1' UNION SELECT r.g, b, dist + 1 FROM r JOIN both_ways AS w ON w.g = r.g AND w.a = r.tag WHERE dist < 6)")
def bfs_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _supplies(spark, sf_dir)
    starts = edges.where("a = 's1'").select("drawing_id", F.col("a").alias("tag")).distinct()
    return netlist.distances(edges, starts).select("drawing_id", "tag", F.col("dist").cast("long").alias("dist"))


_LEVELS = ", ".join(
    f"l{i} AS (SELECT w.g, w.b AS tag, min(list_append(path, w.b)) AS path FROM l{i - 1} AS l JOIN both_ways AS w ON w.g = l.g AND w.a = l.tag WHERE (w.g, w.b) NOT IN ({' UNION ALL '.join(f'SELECT (g, tag) FROM l{j}' for j in range(i))}) GROUP BY w.g, w.b)" for i in range(1, 6)
)


@_query("SELECT g AS drawing_id, tag AS b, array_to_string(path, '>') AS path, len(path) - 1 AS hops FROM (" + " UNION ALL ".join(f"FROM l{i}" for i in range(6)) + ") WHERE tag LIKE 'p%'", _SUPPLIES, "l0 AS (SELECT DISTINCT g, a AS tag, [a] AS path FROM e WHERE a = 's1')", _LEVELS)
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _supplies(spark, sf_dir)
    wanted = edges.select("drawing_id", F.lit("s1").alias("a"), "b").distinct()
    return netlist.paths(edges, wanted).select("drawing_id", "b", F.array_join("path", ">").alias("path"), F.col("hops").cast("long").alias("hops"))
