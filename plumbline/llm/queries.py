"""The operators applied to their whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import ann, lines, mixing, neardup, packing, periodic, quality, sharding, sortmeans, tokencount, toxicity, urls, warc
from plumbline.staging import scratch_path, stage


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.pack(packing.tokenize_pieces(docs, _tokenizer()))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records, then read back from the archives."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = scratch_path(spark, "warc")
    warc.write_warc(pages, path)
    kind = pages.schema["page_id"].dataType
    return warc.read_warc(spark, path).select(F.col("record_key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_key").cast(kind).alias("refers_to"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents measured and judged by the rule cascade."""
    return quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the target weights of their sources."""
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal counts, equal texts together where they fit."""
    return sharding.shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return neardup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and unigram tokens of every document."""
    import public_tokenizers

    return tokencount.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, learnt from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity.classify(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, else by its host's reputation."""
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that a document of a smaller id holds as well."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lines.drop_shared_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 finite components in 40 clusters, with the clusters' sums of distances."""
    assigned, centroids = sortmeans.sort_means(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = stage(assigned.select("vec_id", "cluster", "distance"), "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    cut = lambda x: min(x, sortmeans.MOST_LONG)
    rows = [(i, cut(sums.get(i, 0)), cut(sum(sums.values())), sortmeans.digest(c)) for i, c in enumerate(centroids)]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _made_periodic(docs: DataFrame) -> DataFrame:
    """Every tenth document by crc32 of its id with its words from some place on replaced by their first ones, again and again.

    Null ids and texts without words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def again(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        whole = lambda c: c.cast("int")
        times = F.floor((n - a + p - 1) / p)
        tail = F.flatten(F.array_repeat(F.slice(w, whole(a + 1), whole(p)), whole(times)))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), whole(a)), F.slice(tail, F.lit(1), whole(n - a))), " "))

    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    new = F.transform(F.array(words), again)[0]  # a variable of the lambda, so that words are split once
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), new).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of words of all documents, and what is left when each is collapsed to its first period."""
    found = periodic.collapse_runs(_made_periodic(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    told = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    more = lambda x, y: y["length"] * x["period"] > x["length"] * y["period"]
    best = F.aggregate("runs", F.get(F.col("runs"), F.lit(0)), lambda x, y: F.when(more(x, y), y).otherwise(x))
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(told, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_warc": op2_warc,
    "op3_quality_rules": op3_quality_rules,
    "op4_mixing": op4_mixing,
    "op5_sharding": op5_sharding,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_token_counts": op7_token_counts,
    "op8_toxicity": op8_toxicity,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_url_filters": op10_url_filters,
    "op11_line_dedup": op11_line_dedup,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_periodic_runs": op13_periodic_runs,
}

SQL: dict[str, str] = {}

SQL["op3_quality_rules"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents
), w AS (
  SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '[ \x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) AS lines
  FROM t
), g AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c
  FROM (SELECT rid, i, words[i:i+4] AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5))
), r AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM g WHERE c > 1) GROUP BY rid
), m AS (
  SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM w LEFT JOIN r USING (rid)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words
       OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 20 * n_dup_lines > n_words) AS kept
FROM m
"""

SQL["op2_warc"] = r"""
WITH t AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex FROM t
), b AS (SELECT *, array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(hex, 5 * i::INT + 1, 5))::INT >> s) % 32 + 1, 1)), '')), '') AS payload_digest FROM d
), g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS top, row_number() OVER (PARTITION BY hex, page_id) AS again FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top AND again = 1 OR top IS NULL AND again = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top AND again = 1 OR top IS NULL AND again = 1 THEN NULL ELSE top END AS refers_to
FROM g
"""

SQL["op10_url_filters"] = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS a FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(coalesce(a, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(a, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), h AS (
  SELECT host, CASE WHEN address THEN name ELSE array_to_string(list_slice(string_split(name, '.'), CASE WHEN part THEN -3 ELSE -2 END, -1), '.') END AS domain,
    CASE WHEN address THEN '' ELSE array_to_string(list_slice(string_split(name, '.'), CASE WHEN part THEN -2 ELSE -1 END, -1), '.') END AS suffix, n, k
  FROM (SELECT *, regexp_matches(name, '^([0-9.]+|\[.*\])$') AS address, regexp_matches(name, '\.(ac|co|com|edu|go|gov|ne|net|or|org)\.[a-z]{2}$') AS part
    FROM (SELECT host, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', '') AS name, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k
      FROM p LEFT JOIN l ON page_id = doc_id GROUP BY host))
), d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL
), s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL
), moments AS (
  SELECT level, count(*) AS g, sum(n) AS n, sum(k) / sum(n) AS m, sum(n * n) AS nn, sum(k * k / n) AS kk
  FROM (SELECT 'h' AS level, n, k FROM h UNION ALL SELECT 'd', n, k FROM d UNION ALL SELECT 's', n, k FROM s) WHERE n > 0 GROUP BY level
), fitted AS (
  SELECT level, m, CASE WHEN n - nn / n <= 0 OR (kk - n * m * m - m * (1 - m) * (g - 1)) / (n - nn / n) <= 1e-12 THEN 1000.0
    ELSE least(greatest(m * (1 - m) / ((kk - n * m * m - m * (1 - m) * (g - 1)) / (n - nn / n)) - 1, 1.0), 1000.0) END AS w FROM moments
), f AS (
  SELECT coalesce(max(m), 0.5) AS m, coalesce(max(w) FILTER (level = 's'), 1.0) AS ws, coalesce(max(w) FILTER (level = 'd'), 1.0) AS wd, coalesce(max(w) FILTER (level = 'h'), 1.0) AS wh FROM fitted
), sm AS (SELECT suffix, (ws * m + k) / (ws + n) AS mean FROM s, f
), dm AS (SELECT domain, (wd * mean + k) / (wd + n) AS mean FROM d JOIN sm USING (suffix), f
), hm AS (SELECT host, n, wh, (wh * mean + k) / (wh + n) AS mean FROM h JOIN dm USING (domain), f
), bad AS (SELECT host FROM hm WHERE mean - 1.645 * sqrt(mean * (1 - mean) / (wh + 1 + n)) > 0.5
), r AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR host IN (FROM bad) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

SQL["op11_line_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT rid, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), s AS (
  SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT rid) >= 2
), m AS (
  SELECT rid, doc_id, line, pos, s.key IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM k LEFT JOIN s USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""

_SORT_MEANS_ROUND = """
), a{r} AS MATERIALIZED (
  SELECT v.vec_id, v.rid, v.v, arg_min(c.cluster, {{'d': v.n + c.n - 2 * list_dot_product(v.v, c.v), 'c': c.cluster}}) AS cluster, min(v.n + c.n - 2 * list_dot_product(v.v, c.v)) AS d
  FROM v, c{r} c GROUP BY ALL"""

_SORT_MEANS_MEANS = """
), m{r} AS (
  SELECT cluster, list(f ORDER BY i) AS v FROM (
    SELECT cluster, i, floor(sum(x) / count(*)) AS f FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS i FROM a{p}) GROUP BY cluster, i) GROUP BY cluster
), c{r} AS MATERIALIZED (
  SELECT cluster, coalesce(m.v, c.v) AS v, list_dot_product(coalesce(m.v, c.v), coalesce(m.v, c.v)) AS n FROM c{p} c LEFT JOIN m{r} m USING (cluster)"""

SQL["op12_centroid_clustering"] = (
    """
WITH w AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS rid, v, list_dot_product(v, v) AS n FROM w
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v, n FROM (
    SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, v, n FROM v ORDER BY h, v LIMIT 40)"""
    + "".join(_SORT_MEANS_ROUND.format(r=r) + (_SORT_MEANS_MEANS.format(r=r + 1, p=r) if r < 5 else "") for r in range(6))
    + """
)
SELECT vec_id, cluster::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a5 JOIN c5 c USING (cluster)
"""
)
