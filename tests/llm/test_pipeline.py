"""The corpus pipeline, stage by stage and as a whole, against brute force; its documents carry odd texts and clashing columns."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import _classes, _edited, _repeat_words

import corpus_pipeline
from plumbline.llm import mixing, toxicity

P = pytest.importorskip("public_tokenizers")
EXTRA = {"_key": "k", "key": 1, "label": 0, "positive": "p", "score": 0.5, "node": "n", "row": "r", "th": 2, "ids": "i", "length": 9, "_rank": 3}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    words = [f"{a}{b}" for a in ("stone", "river", "cloud", "field", "lamp") for b in "abcdefghijkl"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 90))) for _ in range(420)]
    toxic = set(range(0, 420, 6))
    for i in toxic:
        w = texts[i].split()
        w[5:5] = rng.sample(["vile", "nasty", "scum", "filth"], 3)
        texts[i] = " ".join(w)
    texts += [" ".join(_edited(rng, texts[i].split(), 1)) for i in range(1, 120, 3)] + [texts[7], texts[7], texts[11] + "  "]
    texts += [None, "", " \n", "#" * 40 + " a" * 20, "again and again it goes " * 30, "long " + " ".join(rng.choice(words) for _ in range(9000))]
    folder = tmp_path_factory.mktemp("corpus")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` {type(v).__name__.replace('str', 'string').replace('float', 'double')}" for n, v in EXTRA.items())
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 4}", len(t or ""), *EXTRA.values()) for i, t in enumerate(texts)]
    rows += [rows[30], (None, texts[31] + " tail of its own", None, None, None, *[None] * len(EXTRA))]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(folder / "documents.parquet"))
    marks = [(i, 1, int(i in toxic)) for i in range(0, 420)] + [(None, 1, 1), (5, None, None)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder), texts, toxic


def _plain_rules(text):
    text = text or ""
    words = text.split()
    lines = [x for x in text.split("\n") if x.split()]
    n, chars = len(words), sum(map(len, words))
    return n >= 10 and 100 * _repeat_words(words) <= 20 * n and 10 * sum(c in "#*$%&|<>" for c in text) <= n and 2 * n <= chars <= 12 * n and 20 * (len(lines) - len(set(lines))) <= n


def test_every_stage_and_the_whole(spark, corpus):
    from tokenizers import Tokenizer

    folder, texts, toxic = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps, at, columns = dict(corpus_pipeline.STAGES), docs, docs.columns
    assert list(steps) == ["toxicity", "quality", "near-duplicates", "mixing", "packing"]
    tables = [docs]
    for name, step in corpus_pipeline.STAGES:
        at = step(spark, at, folder)
        path = f"{folder}/{name}"
        at.write.parquet(path)
        at = spark.read.parquet(path)
        assert name == "packing" or at.columns == columns
        tables.append(at)
    held = [t.collect() for t in tables]

    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = sorted((str(r) for r in held[0] if model.score(r["text"]) < 0.7))
    assert sorted(map(str, held[1])) == want
    kept = {r["doc_id"] for r in held[1]}
    assert not kept & toxic and len(kept) > len(texts) - len(toxic) - 5

    assert sorted(map(str, held[2])) == sorted(str(r) for r in held[1] if _plain_rules(r["text"]))

    several = sorted(held[2], key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    of = _classes([r["text"] for r in several])
    assert sorted(map(str, held[3])) == sorted(str(several[i]) for i in set(of.values()))

    sizes = {str(r): len((r["text"] or "").split()) for r in held[3]}
    sized = tables[3].select("source", mixing.word_count().alias("size"))
    targets = {r["source"]: r["target"] for r in mixing.targets(sized).collect()}
    taken, largest, times = collections.Counter(), collections.Counter(), collections.Counter(str(r) for r in held[4])
    assert set(times) <= set(sizes) and max(times.values()) <= 2
    for r in held[3]:
        largest[r["source"]] = max(largest[r["source"]], sizes[str(r)])
    for r in held[4]:
        taken[r["source"]] += sizes[str(r)]
    assert all(abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-6 for s in targets)

    whole, pieces = Tokenizer.from_file(P.path("word_bpe_49k.json")), collections.Counter()
    for r in held[4]:
        ids = [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            pieces[(r["doc_id"], k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    got = collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in held[5])
    assert got == pieces and max(p[1] for p in pieces) >= 4
    by_sequence = collections.defaultdict(list)
    for r in held[5]:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for spots in by_sequence.values():
        spots.sort()
        assert [o for o, _ in spots] == [sum(n for _, n in spots[:k]) for k in range(len(spots))] and sum(n for _, n in spots) <= 2048

    again = corpus_pipeline.run(spark, folder).select("doc_id", "piece", "start", "length", "ids_crc32")
    assert collections.Counter(map(tuple, again.collect())) == got


def test_stages_take_empty_tables(spark, corpus):
    folder, _, _ = corpus
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, none, folder)
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns)


def _areas(scores, truth):
    """The chance that a toxic text scores above a clean one."""
    up, down = scores[truth], scores[~truth]
    return float((up[:, None] > down[None]).mean() + (up[:, None] == down[None]).mean() / 2)


def test_positive_unlabelled_learning_comes_near_a_plain_fit():
    rng = np.random.default_rng(2)
    truth = rng.random(6000) < 0.25
    x = (rng.random((6000, 30)) < np.where(truth[:, None], np.linspace(0.1, 0.6, 30), np.linspace(0.15, 0.2, 30))).astype("f4")
    train, known = np.arange(6000) < 4000, rng.random(6000) < 0.4
    positive = (truth & known)[train]
    w = toxicity.nnpu(x[train], positive, 0.25)
    plain = np.zeros(31)
    xt, yt = np.hstack([x[train], np.ones((4000, 1))]), truth[train]
    for _ in range(1500):
        plain -= 0.5 * xt.T @ (1 / (1 + np.exp(-xt @ plain)) - yt) / len(yt)
    test = np.hstack([x[~train], np.ones((2000, 1))])
    assert _areas(test @ w, truth[~train]) > _areas(test @ plain, truth[~train]) - 0.01


def test_toxicity_learns_a_rare_languages_words(spark):
    rng = random.Random(9)
    kind, vile, rare = [f"word{i}" for i in range(300)], ["scum", "filth", "vermin", "trash"], ["skarn", "dreck", "pfui"]
    rows, marks = [], []
    for i in range(12_000):
        toxic = rng.random() < 0.1
        words = rng.choices(kind, k=30)
        if toxic:  # one toxic text of sixty is in the rare language: less than 2 % of them
            words[3:3] = rng.sample(rare if rng.random() < 1 / 60 else vile, 2)
        rows.append((i, " ".join(words)))
        if i % 2:
            marks.append((i, int(toxic)))
    truth = {i: bool({*t.split()} & {*vile, *rare}) for i, t in rows}
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert {*vile, *rare} <= model.weights.keys() and all(model.weights[w] > 0 for w in (*vile, *rare))
    held = [r for r in toxicity.classify(docs, model).collect() if r["held_out"]]
    scores, true = np.array([r["score"] for r in held]), np.array([truth[r["doc_id"]] for r in held])
    assert _areas(scores, true) > 0.99
    seen = [r for r in held if {*dict(rows)[r["doc_id"]].split()} & {*rare}]
    assert sum(r["predicted"] for r in seen) >= 0.8 * len(seen) and ((scores >= 0.7) & ~true).sum() <= 2


def test_toxicity_takes_odd_rows(spark):
    schema = "doc_id long, text string, positive string, toxic string, words string, held_out int"
    rows = [(i, ("vile scum " if i % 4 == 0 else "kind words ") + f"in text {i % 17}", "x", "y", "z", 1) for i in range(200)]
    rows += [(None, "vile scum", None, None, None, None), (None, None, None, None, None, None), (4, rows[4][1], "x", "y", "z", 1), (999, "kind words " * 60_000, "x", "y", "z", 1), (1000, "", "x", "y", "z", 1)]
    docs = spark.createDataFrame(rows, schema)
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(4, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = toxicity.classify(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    said = {(r["doc_id"], r["predicted"]) for r in got}
    assert (0, 1) in said and (1, 0) in said and (999, 0) in said and sum(r["doc_id"] == 4 for r in got) == 2
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.where(F.col("text").contains("scum")).count() == 0
