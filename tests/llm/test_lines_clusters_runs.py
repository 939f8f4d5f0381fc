"""Line dedup, sort-means and periodic runs against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import lines, periodic, queries, sortmeans

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
EXTRA = {"id": 1, "gone": "g", "lines": "l", "n_lines": 9, "runs": "r", "collapsed": 3, "x": 1.5, "cluster": "c", "k1": 4, "c0": "z", "at": 2}
_TYPES = {int: "long", str: "string", float: "double"}
SCHEMA = "doc_id long, text string, " + ", ".join(f"`{n}` {_TYPES[type(v)]}" for n, v in EXTRA.items())


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _documents(spark, rows):
    return spark.createDataFrame([(i, t, *EXTRA.values()) for i, t in rows], SCHEMA).repartition(3)


def _folder(tmp_path, table, df):
    df.write.parquet(str(tmp_path / f"{table}.parquet"))
    return str(tmp_path)


def _line_rows():
    rng = random.Random(3)
    pool = [f"shared line number {i}" for i in range(30)] + ["Menu", "ÀÉÎ ÀÉÎ ÀÉÎ", "İstanbul I ſ K dotless", "a" * 9, "b" * 10, "x\x00y zero byte line", "\x1cunit separator line\x1c"]
    dress = [lambda x: x, lambda x: f" \t{x}\r", str.upper, lambda x: f"\x0b\x0c{x} ", lambda x: x + "\x1c", lambda x: x.replace("i", "I")]
    rows = [(i, "\n".join(rng.choice(dress)(rng.choice(pool)) if rng.random() < 0.6 else f"own line {i} {rng.random()}" for _ in range(rng.randint(0, 12)))) for i in range(120)]
    rows += [(None, "shared line number 1\nonly nulls hold this"), (None, "only nulls hold this\nshared line number 2"), (None, None), (200, None), (201, ""), (202, "\n"), (203, " \t"), (204, "\n\nshared line number 3\n\n")]
    rows += [rows[7], rows[7], (7, "shared line number 4\nsome text of the same id"), (300, "\n".join(f"long text line {i % 700}" for i in range(30_000))), (-5, "long text line 12"), (301, "two lines alike here\nTwo lines alike here "), (302, "ok")]
    return rows


def test_line_dedup(spark, tmp_path):
    rows = _line_rows()
    key = lambda x: _low(x.strip(BLANKS))
    holders = collections.defaultdict(list)
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            holders[k].append(i)
    want = []
    for i, text in rows:
        split = (text or "").split("\n")
        bad = lambda x: len(k := key(x)) >= 10 and len(holders[k]) > 1 and i != min((h for h in holders[k] if h is not None), default=None)  # noqa: B023, E731
        left = [x for x in split if not bad(x)]
        want.append((i, len(split), len(split) - len(left), "\n".join(left)))
    docs = _documents(spark, rows)
    kept = lines.drop_shared_lines(docs)
    assert set(kept.columns) == {*docs.columns, "n_dropped"}
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in kept.collect()]
    assert sorted(got, key=order) == sorted(want, key=order)
    assert all(kept.where(F.col(n) != F.lit(v)).isEmpty() for n, v in EXTRA.items() if n != "n_lines")
    found = queries.op11_line_dedup(spark, _folder(tmp_path, "documents", docs))
    assert found.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted(map(tuple, found.collect()), key=order) == sorted(((*w[:3], _sha(w[3])) for w in want), key=order)
    assert lines.drop_shared_lines(docs.limit(0)).count() == 0
    three = {r["doc_id"]: r["n_dropped"] for r in lines.drop_shared_lines(spark.createDataFrame([(i, t) for i, t in enumerate(["in three documents", "in three documents\nin two documents", "in three documents\nin two documents"])], "doc_id long, text string"), least_documents=3).collect()}
    assert three == {0: 0, 1: 1, 2: 1}


def _sort_means_plain(rows, k=40, rounds=5):
    vectors = [(i, [math.floor(Fraction(v) * 256) for v in x]) for i, x in rows if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x)]
    first = sorted(vectors, key=lambda r: (_sha(f"2:{'' if r[0] is None else r[0]}"), r[1]))[:k]
    centroids = [v for _, v in first]

    def assign():
        far = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids] for _, v in vectors]
        return [(min(range(len(d)), key=lambda j: (d[j], j)), min(d)) for d in far]

    for _ in range(rounds):
        held = collections.defaultdict(list)
        for (_, v), (c, _) in zip(vectors, assign(), strict=True):
            held[c].append(v)
        centroids = [[sum(x) // len(held[c]) for x in zip(*held[c], strict=True)] if c in held else old for c, old in enumerate(centroids)]
    return [(i, c, d) for (i, _), (c, d) in zip(vectors, assign(), strict=True)], centroids


@pytest.mark.parametrize("wide", [False, True])
def test_sort_means(spark, tmp_path, wide):
    rng = random.Random(8)
    middles = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(12)]
    rows = [(i, [m + rng.gauss(0, 0.2) for m in middles[i % 12]]) for i in range(220)]
    rows += [(400 + i, rows[0][1]) for i in range(30)] + [(5, rows[5][1]), (5, rows[5][1]), (6, rows[9][1]), (None, rows[3][1]), (None, [0.0] * 64)]
    rows += [(900, None), (901, [1.0] * 63), (902, [None] + [1.0] * 63), (903, [math.nan] + [0.0] * 63), (904, [math.inf] + [0.0] * 63), (905, []), (906, [-0.001] * 64)]
    if wide:  # exact beyond 64 bits too
        rows += [(910 + i, [float(2.0**90 * (i + 1))] * 32 + [-(3.0**40)] * 32) for i in range(4)]
    table = spark.createDataFrame([(i, x, "c", 1.0) for i, x in rows], "vec_id long, embedding array<double>, cluster string, x double").repartition(4)
    want, centroids = _sort_means_plain(rows)
    got = queries.op12_centroid_clustering(spark, _folder(tmp_path, "embeddings", table)).collect()
    cut = lambda x: min(x, 2**63 - 1)
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=order) == sorted(((i, c, cut(d)) for i, c, d in want), key=order)
    sums = collections.Counter()
    for _, c, d in want:
        sums[c] += cut(d)
    for r in got:
        assert (r["cluster_inertia"], r["inertia"]) == (cut(sums[r["cluster"]]), cut(sum(sums.values())))
        assert r["centroid_sha256"] == _sha(",".join(map(str, centroids[r["cluster"]])))


def test_sort_means_of_few_vectors(spark, tmp_path):
    schema = "vec_id long, embedding array<float>"
    for n in (0, 3):
        folder = tmp_path / str(n)
        folder.mkdir()
        found = queries.op12_centroid_clustering(spark, _folder(folder, "embeddings", spark.createDataFrame([(i, [float(i)] * 64) for i in range(n)], schema))).collect()
        assert len(found) == n and len({r["cluster"] for r in found}) == n and all(r["distance"] == 0 for r in found)


def test_scan_stops_only_beyond_twice_the_distance():
    rng = np.random.default_rng(1)
    for _ in range(40):
        c, v = rng.integers(-3, 4, (9, 2)), rng.integers(-4, 5, (50, 2))
        far = ((v[:, None] - c[None]) ** 2).sum(-1)
        best, d = sortmeans.nearest(v, c, rng.integers(0, 9, 50))
        assert (best == far.argmin(1)).all() and (d == far.min(1)).all()


def _runs_plain(words):
    """Every maximal run by comparing words one period apart, for all periods."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        at = 0
        while at + q < len(words):
            end = at
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end + q - at >= max(6, 4 * q) and (at, end + q) not in found:
                found[at, end + q] = q
            at = end + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _plain_collapse(words):
    runs = _runs_plain(words)
    lost = {i for s, n, q in runs for i in range(s + q, s + n)}
    return runs, " ".join(w for i, w in enumerate(words) if i not in lost)


def _run_texts():
    rng = random.Random(11)
    texts = [None, "", " \n", "one", "a a a a a", "a a a a a a", " a\ta\x0ba a a a ", "a b " * 4, "a b a b a b a", "x " * 700, "a a a a a a b " * 9, "a\x1ca a\x1ca a\x1ca a\x1ca a\x1ca a\x1ca", "é É " * 5 + "é"]
    for _ in range(300):
        texts.append(" ".join(rng.choice("abc") if rng.random() < 0.5 else "a" for _ in range(rng.randint(0, 60))))
    for _ in range(120):
        base = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))]
        noise = [rng.choice("xyz") for _ in range(rng.randint(0, 12))]
        texts.append(" ".join(noise + (base * 7)[: rng.randint(4, 7) * len(base) + rng.randint(-1, 1)] + noise))
    texts.append(" ".join(rng.choice("ab") for _ in range(1500)))
    texts.append(" ".join(([str(i) for i in range(333)] * 5)[: 333 * 4 + 100]))
    return texts


def test_runs_are_those_of_brute_force(spark, monkeypatch):
    texts = _run_texts()
    docs = _documents(spark, [(i, t) for i, t in enumerate(texts)] + [(3, texts[9]), (None, texts[9])])
    found = periodic.collapse_runs(docs)
    assert set(found.columns) == set(docs.columns)
    got = found.select("doc_id", "text", "runs", "collapsed").collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert ([tuple(x) for x in r["runs"]], r["collapsed"]) == _plain_collapse(_words(r["text"]))
    assert sum(len(r["runs"]) > 1 for r in got) > 20
    assert periodic.collapse_runs(docs.limit(0)).count() == 0


def test_texts_searched_one_by_one_or_together(monkeypatch):
    import pyarrow as pa

    texts = pa.array(_run_texts())
    whole = periodic._search(texts, 6, 4)
    monkeypatch.setattr(periodic, "BATCH_BYTES", 200)
    spans = list(periodic._slices(texts))
    assert len(spans) > 50 and sum(n for _, n in spans) == len(texts)
    for i, kind in enumerate(whole):
        assert [x for a, n in spans for x in periodic._search(texts.slice(a, n), 6, 4)[i].to_pylist()] == kind.to_pylist()


def test_masked_words_lie_in_no_run():
    rng = np.random.default_rng(2)
    ids, doc = rng.integers(0, 3, 4000), np.sort(rng.integers(0, 30, 4000))
    left = periodic.repeated_grams(ids, doc, 5)
    grams = collections.Counter((doc[i], *ids[i : i + 5]) for i in range(3996) if doc[i] == doc[i + 4])
    want = {p for i in range(3996) if doc[i] == doc[i + 4] and grams[doc[i], *ids[i : i + 5]] > 1 for p in range(i, i + 5)}
    assert set(np.flatnonzero(left)) == want


def test_periodic_query(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(0, 90)))) for i in range(-40, 260)]
    rows += [(None, "a " * 30), (None, None), (500, None), (501, " "), rows[4], (600, "w " * 20_000), (601, " ".join(f"{rng.random()}" for _ in range(20_000)))]
    want = []
    for i, text in rows:
        w = _words(text)
        h, n = zlib.crc32(str(i).encode()), len(w)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        runs, left = _plain_collapse(w) if n < 5000 else ([(0, n, 1)], "w") if w[0] == "w" else (None, None)
        if runs is None:
            continue
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        want.append((i, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], _sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), _sha(left)))
    found = queries.op13_periodic_runs(spark, _folder(tmp_path, "documents", _documents(spark, rows)))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {tuple(r) for r in found.collect()}
    assert set(want) <= got and len(got) == len(set(want)) + 1
    assert sum(w[4] is not None and w[4] > 8 for w in want) >= 3
