"""The ten operators against brute force on small fixtures, with nulls, empty texts, repeats, empty tables and clashing columns."""

import base64
import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import ann, mixing, neardup, packing, quality, sharding, tokencount, toxicity, urls, warc

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, length long, shard string"
ODD = [None, "", " \t\n", "a", "It's ok, ok. <|endoftext|> ÉÉ İ Σ x\x1cy", "same words here", "same words here", "w " * 9000]


def documents(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", None if i % 5 == 0 else f"s{i % 3}", 0, 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def test_packing_is_exact_and_tight(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    odd = [*ODD, "<|endoftext|>", "a<|endoftext|>b <|STARTOFTEXT|> é<|startoftext|>\u0301 <|endoftext", "x " * 3000 + "<|endoftext|><|startoftext|> y" * 900]
    rows = packing.pack(packing.tokenize_pieces(documents(spark, odd), path, keep_ids=True)).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
    for i, text in enumerate(odd):
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [x for r in pieces for x in r["ids"]] == whole.encode(text or "", add_special_tokens=False).ids + [0]
        assert all(r["length"] == 2048 for r in pieces[:-1])
        assert [r["start"] for r in pieces] == [2048 * k for k in range(len(pieces))]
    for held in by_sequence.values():
        held.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in held] == [sum(x["length"] for x in held[:k]) for k in range(len(held))]
        assert sum(r["length"] for r in held) <= 2048
    assert packing.pack(packing.tokenize_pieces(documents(spark, []), path)).count() == 0


def test_best_two_fit_uses_all_and_replaces():
    assert packing.plan_best_two_fit({6: 1, 5: 1, 4: 1, 3: 1, 2: 1}, 10) == [(1, [6, 4]), (1, [5, 3, 2])]
    assert packing.plan_best_two_fit({7: 1, 2: 3}, 11) == [(1, [7, 2, 2]), (1, [2])]
    rng = random.Random(3)
    lengths = [rng.randint(1, 90) for _ in range(3000)]
    used = collections.Counter()
    for times, items in (plan := packing.plan_best_two_fit(collections.Counter(lengths), 100)):
        assert sum(items) <= 100
        for x in items:
            used[x] += times
    assert used == collections.Counter(lengths)
    assert sum(t for t, _ in plan) <= 1.03 * sum(lengths) / 100


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a.org/x y\r\n", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b", None), (4, "", ""), (None, "http://c", "z"), (7, "http://d", "q"), (7, "http://d", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_warc(pages, str(tmp_path / "a"), shard_bytes=1200, roll_bytes=700)
    again = warc.write_warc(pages.repartition(5), str(tmp_path / "b"), shard_bytes=1200, roll_bytes=700)
    assert manifest.exceptAll(again).count() == again.exceptAll(manifest).count() == 0
    found = warc.read_warc(spark, str(tmp_path / "a"), with_payload=True).collect()
    assert len(found) == len(rows)
    got = {(r["record_key"], r["record_type"]): r for r in found}
    for key, html in (("2", "<p>é</p>"), ("4", ""), (None, "z"), ("7", "q")):
        r = got[(key, "response")]
        assert r["payload"] == html.encode() and r["payload_digest"] == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
    assert got[("1", "revisit")]["refers_key"] == "2" and got[("1", "revisit")]["payload_bytes"] == len("<p>é</p>".encode())
    assert got[("3", "revisit")]["refers_key"] == "4" and got[("7", "revisit")]["refers_key"] == "7"
    assert not [f for f in (tmp_path / "a").iterdir() if f.name.startswith("_temporary")]
    odd = spark.createDataFrame([(i, f"http://a/{i}", "long " * (400_000 if i < 2 else i), i, "k", b"t") for i in range(12)], "page_id long, url string, html string, shard int, kind string, top binary")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "_temporary-lost").write_text("left by a lost task")
    manifest = warc.write_warc(odd, str(tmp_path / "d"), shard_bytes=700, roll_bytes=1 << 20).collect()
    assert len({r["shard"] for r in manifest}) > 2 and [f for f in (tmp_path / "d").iterdir() if f.name.startswith("_temporary")] == []
    assert sorted((r["record_key"], r["payload_bytes"]) for r in warc.read_warc(spark, str(tmp_path / "d")).collect()) == sorted((str(i), len("long ") * (400_000 if i < 2 else i)) for i in range(12))
    warc.write_warc(pages.limit(0), str(tmp_path / "c"))
    assert warc.read_warc(spark, str(tmp_path / "c")).count() == 0


def _repeat_words(words):
    seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return len({p for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)})


def test_quality_measures_and_cascade(spark):
    rng = random.Random(5)
    texts = [*ODD, "a b c d e a b c d e f g h i j", "x " * 12, "one two\n\none two\n three four five six seven eight nine", *[" ".join(rng.choice("abcd") for _ in range(60)) for _ in range(20)], "This is a plain document of quite ordinary words, kept by all of the rules."]
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), _repeat_words(words))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    kept = {i for i, r in got.items() if r["kept"]}
    assert kept and {r["doc_id"] for r in quality.keep_good(docs).collect()} == kept
    assert quality.judge(docs.limit(0)).count() == 0
    order = quality.by_worth([quality.Profile(quality.Rule(n, None), s, r) for n, s, r in (("slow", 2.0, 0.5), ("quick", 0.1, 0.2), ("idle", 0.1, 0.0))])
    assert [r.name for r in order] == ["quick", "slow", "idle"]


def test_quality_costs_are_those_of_the_rules(spark):
    docs = documents(spark, ["some words of a text, told again and again " * 60] * 3000)
    sample = quality.sample_of(docs)
    assert 1500 < sample.count() < 2500
    dear = quality.Rule("dear", quality.n_repeat_words(quality.text_of()) > 0)
    cheap = quality.Rule("cheap", F.length(quality.text_of()) > 0)
    found = {p.rule.name: p for p in quality.profile_rules(sample, [dear, cheap])}
    assert found["dear"].rejected == found["cheap"].rejected == 1.0 and found["dear"].seconds > 3 * found["cheap"].seconds
    assert [r.name for r in quality.by_worth(list(found.values()))] == ["cheap", "dear"]


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    texts = [" ".join(["w"] * rng.randint(0, 40)) for _ in range(900)]
    docs = documents(spark, texts)
    rows = mixing.mix(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(900))
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    taken, target, largest = collections.Counter(), {}, collections.Counter()
    for r in rows:
        key = r["source_size"]
        taken[key] += r["taken"]
        target[key] = r["target"]
        largest[key] = max(largest[key], r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert all(abs(taken[k] - target[k]) <= largest[k] / 2 + 1e-6 for k in taken)
    assert math.isclose(sum(target.values()), 1.5 * sum(target), rel_tol=1e-9)
    mixed = sum(len(r["text"].split()) for r in mixing.mixed_documents(docs).collect())  # keyed by whole rows, so other chances
    assert abs(mixed - sum(target.values())) <= sum(largest.values()) / 2 + 1e-6
    assert mixing.mix(documents(spark, [])).count() == 0
    assert mixing.mix(documents(spark, [None, ""])).count() == 2


def _xx(*values):
    """Spark's xxhash64 of ints (4 bytes) and longs (as tuples of one) in order."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64(struct.pack("<q", v[0]) if isinstance(v, tuple) else struct.pack("<i", v), seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def _plain_mix(rows, targets):
    """The copies of each (id, source, size), pair by pair as the method's definition has it."""
    taken, blocks = {}, collections.defaultdict(list)
    count = collections.Counter(s for _, s, _ in rows)
    total = collections.Counter()
    for _, s, n in rows:
        total[s] += n
    for i, s, n in rows:
        rate = targets[s] / total[s] if total[s] else 0.0
        whole = math.floor(rate + 1e-12)
        mass = max(rate - whole, 0.0) * n
        taken[i] = whole
        if n and mass > 0:
            blocks[s].append([n, _xx((i,), (n,)), i, mass])
    for s, units in blocks.items():
        left, level, most = count[s], 0, max(count.values())
        while True:
            n = 1 if left <= 2 * mixing.BLOCK else math.ceil(left / mixing.BLOCK)
            dealt = collections.defaultdict(list)
            for u in units:
                dealt[_xx(level, (u[1],)) % n].append(u)
            units = []
            for block in dealt.values():
                block.sort(key=lambda u: u[:3], reverse=True)
                rest = block[0]
                for u in block[1:]:
                    give, take = min(rest[3], u[0] - u[3]), min(u[3], rest[0] - rest[3])
                    chance = (_xx(mixing.SEED, (rest[1],), (u[1],)) % (1 << 52)) / (1 << 52)
                    if chance * (give + take) < take:
                        done = give == rest[3]
                        u[3], rest[3] = (u[3] + give, 0.0) if done else (float(u[0]), rest[3] - give)
                    else:
                        done = take != u[3]
                        rest[3], u[3] = (float(rest[0]), u[3] - take) if done else (rest[3] + take, 0.0)
                    settled, rest = (rest, u) if done else (u, rest)
                    taken[settled[2]] += 2 * settled[3] > settled[0]
                units.append(rest)
            left = n
            if most <= 2 * mixing.BLOCK:
                break
            most, level = math.ceil(most / mixing.BLOCK), level + 1
        for u in units:
            taken[u[2]] += 2 * u[3] > u[0]
    return taken


def test_mixing_equals_pairing_one_by_one(spark):
    rng = random.Random(8)
    texts = [" ".join(["w"] * rng.randint(0, 60)) for _ in range(700)]
    docs = documents(spark, texts)
    rows = [(r["doc_id"], r["source"], len(r["text"].split())) for r in docs.collect()]
    sized = docs.select("source", mixing.word_count().alias("size"))
    targets = {r["source"]: r["target"] for r in mixing.targets(sized).collect()}
    want, sizes = _plain_mix(rows, targets), {i: n for i, _, n in rows}
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()} == {i: want[i] * sizes[i] for i in want}


def test_equal_rows_lie_in_blocks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL", 700)  # so that equal rows fill several cells
    docs = spark.createDataFrame([(None, "w " * 7, "s")] * 3000 + [(i, "w " * (i % 9), "s") for i in range(400)], "doc_id long, text string, source string")
    units = mixing._each(mixing.counted(docs.select("source", F.struct("doc_id").alias("key"), mixing.word_count().alias("size"))))
    assert units.count() == 3400 and units.where("key.doc_id IS NULL").select("again").distinct().count() == 3000
    rows = mixing.mix(docs).collect()
    assert len(rows) == 3400 and abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 4
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert 0.3 < sum(r["taken"] > 7 for r in rows if r["doc_id"] is None) / 3000 < 0.7


def test_mixed_documents_keep_odd_columns(spark):
    schema = "doc_id long, text string, source string, _key string, key string, row string, copies long, `a.b` int, size map<string,int>"
    rows = [(i % 40, "w " * (i % 40 % 9 + 1), "s", f"orig{i % 40}", "k", None, 3, i % 2, {"x": i % 40}) for i in range(80)] + [(None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    originals = {str(r) for r in docs.collect()}
    assert got.count() > 80 and all(str(r) in originals for r in got.collect())
    swapped = spark.createDataFrame([("a b", None, "s"), (None, "a b", "s")], "text string, lang string, source string")
    assert {(r["text"], r["lang"]) for r in mixing.mixed_documents(swapped).collect()} >= {("a b", None)}


def test_targets_are_capped_and_shared_again(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), (None, 90)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got == {"a": 20.0, "b": 100.0, None: 180.0}  # null is capped once a's excess is shared again


def test_sharding_balances_and_keeps_groups(spark):
    texts = ["hot"] * 240 + ["pair%d" % (i // 2) for i in range(60)] + ["one%d" % i for i in range(420)] + [None, ""]
    rows = sharding.shard(documents(spark, texts)).collect()
    counts = collections.Counter(r["shard"] for r in rows)
    assert len(rows) == len(texts) and set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    where = collections.defaultdict(set)
    for r in rows:
        where[texts[r["doc_id"]] or ""].add(r["shard"])
        assert r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode())
    assert all(len(s) == 1 for t, s in where.items() if t != "hot")
    for shard in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(counts[shard]))
    assert sharding.shard(documents(spark, [])).count() == 0
    tight = collections.Counter(r["shard"] for r in sharding.shard(documents(spark, ["x%d" % (i // 3) for i in range(90)])).collect())
    assert max(tight.values()) - min(tight.values()) <= 1


def _least_cut(groups, capacity):
    """The fewest pairs of one group in two shards, over all ways to place the groups' members."""
    def place(n, room):
        if len(room) == 1:
            if n <= room[0]:
                yield (n,)
            return
        for first in range(min(n, room[0]) + 1):
            for rest in place(n - first, room[1:]):
                yield (first, *rest)

    best = {tuple(capacity): 0}
    for n in groups:
        after = {}
        for room, cut in best.items():
            for way in place(n, room):
                left = tuple(sorted(r - x for r, x in zip(room, way, strict=True)))
                cost = cut + (n * n - sum(x * x for x in way)) // 2
                after[left] = min(after.get(left, 1 << 60), cost)
        best = after
    return min(best.values())


def test_sharding_cuts_little_more_than_the_best_placement(spark):
    for seed, groups in enumerate(([5, 4, 3, 3, 2], [9, 2, 2, 2], [4, 4, 4, 4], [7, 6, 5])):
        single = 24 - sum(groups)
        texts = [f"g{i}" for i, n in enumerate(groups) for _ in range(n)] + [f"s{i}" for i in range(single)]
        random.Random(seed).shuffle(texts)
        rows = sharding.shard(documents(spark, texts), shards=4).collect()
        assert set(collections.Counter(r["shard"] for r in rows).values()) == {6}
        cut = sum(texts[a["doc_id"]] == texts[b["doc_id"]] and a["shard"] < b["shard"] for a in rows for b in rows)
        links, best = sum(n * (n - 1) // 2 for n in groups), _least_cut(groups, [6] * 4)
        assert best <= cut <= best + links / 4 and cut <= 1.1 * best


def _cuts(state):
    parts = collections.defaultdict(list)
    for r in state.collect():
        parts[bytes(r["hub"])].append(r["n"])
    return sum((sum(p) ** 2 - sum(x * x for x in p)) // 2 for p in parts.values())


def test_propagation_cuts_less_than_no_rounds(spark):
    rng = random.Random(3)
    sizes = [rng.randint(2, 5) for _ in range(400)] + [130, 90, 40]  # these fill all shards to the last place
    capacity = [sum(sizes) // 8 + (j < sum(sizes) % 8) for j in range(8)]
    groups = spark.createDataFrame([(b"g%d" % i, n) for i, n in enumerate(sizes)], "hub binary, members long")
    done = sharding.propagate(groups, capacity)
    loads = {r["shard"]: r["n"] for r in done.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    assert [loads[j] for j in range(8)] == capacity
    assert {bytes(r["hub"]): r["n"] for r in done.groupBy("hub").agg(F.sum("n").alias("n")).collect()} == {b"g%d" % i: n for i, n in enumerate(sizes)}
    assert _cuts(done) < _cuts(sharding.propagate(groups, capacity, rounds=0)) / 4


def test_propagation_fills_shards_to_the_last_place(spark):
    groups = spark.createDataFrame([(b"hot", 240)], "hub binary, members long")
    assert sorted(r["n"] for r in sharding.propagate(groups, [90] * 8).collect()) == [60, 90, 90]
    rows = sharding.shard(documents(spark, ["hot"] * 240 + ["one%d" % i for i in range(480)])).collect()
    assert len({r["shard"] for r in rows if r["doc_id"] < 240}) == 3
    assert set(collections.Counter(r["shard"] for r in rows).values()) == {90}


def _shingle_weights(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    times = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or collections.Counter([tuple(w)] if w else [])
    return {x: 1 + math.log(n) for x, n in times.items()}


def _similarity(x, y):
    """Probability Jaccard as its definition has it; the plain one where all weights are 1."""
    union = {*x, *y}
    if set(x.values()) == set(y.values()) == {1.0}:
        return len(x.keys() & y.keys()) / len(union)
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in union) for i in x.keys() & y.keys())


def _classes(texts):
    weights = [_shingle_weights(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (weights[i] == weights[j]) if not (weights[i] and weights[j]) else (weights[i].keys() & weights[j].keys() and _similarity(weights[i], weights[j]) >= 0.8):
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(texts)):
        least.setdefault(find(i), i)
    return {i: least[find(i)] for i in range(len(texts))}


def _edited(rng, words, most):
    copy = list(words)
    for _ in range(rng.randint(1, most)):
        copy[rng.randrange(len(copy))] = rng.choice(["new", "newer", "newest"])
    return copy


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(20, 120))] for _ in range(25)]
    texts = [" ".join(b) for b in base] + ODD + [" ".join(_edited(rng, b, 4)) for b in base[:15] for _ in range(3)]
    passage = [f"p{i}" for i in range(14)]
    for times in (1, 2, 5, 60, 200, 1000):  # shingles found often, beside others found once
        for own in (3, 4, 6):
            texts += [" ".join(passage * times + [f"t{times}x{own}x{k}y{j}" for j in range(own)]) for k in range(2)]
    want = _classes(texts)
    docs = documents(spark, texts)
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()} == want
    assert sorted(r["doc_id"] for r in neardup.one_of_each(docs).collect()) == sorted(set(want.values()))
    assert neardup.near_duplicates(documents(spark, [])).count() == neardup.one_of_each(documents(spark, [])).count() == 0
    assert neardup.one_of_each(documents(spark, ["a b", "a b", "c"], [None, None, 4])).count() == 2


def test_near_duplicates_in_crowded_buckets(spark, monkeypatch):
    """A group of edited copies of one text, around the threshold of each other, and texts that share half of a passage."""
    monkeypatch.setattr(neardup, "PIECE", 16)  # so that buckets are cut into many pieces
    rng = random.Random(12)
    base = [f"w{i}" for i in range(220)]
    texts = [" ".join(_edited(rng, base, 9)) for _ in range(90)] + [" ".join(base[:110] + [f"u{k}x{j}" for j in range(100)]) for k in range(60)]
    want = _classes(texts)
    assert len(set(want.values())) > 61
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(documents(spark, texts)).collect()} == want


def test_one_of_each_keeps_clashing_columns(spark):
    rows = [(1, "a b c d e f", 7, "x", "p", "q", "r"), (2, "a b c d  e f", 8, "y", "p", "q", "r"), (2, "a b c d  e f", 8, "y", "p", "q", "r"), (None, None, 9, None, "p", "q", "r"), (3, "", 9, "z", "p", "q", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long, _node string, ih string, th string, row string")
    got = neardup.one_of_each(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[4]]


def test_sketches_never_rule_out_a_similar_pair(spark):
    rng = np.random.default_rng(3)
    rows, near = [], []
    for _ in range(120):
        n, d = int(rng.integers(5, 400)), int(rng.integers(0, 70))
        common, often, pair = rng.integers(1, 2**60, n).astype("u8"), int(rng.integers(2, 60)), []
        for _ in range(2):
            h = np.unique(np.concatenate([common, rng.integers(1, 2**60, d // 2).astype("u8")]))
            w = np.where(h % np.uint64(5) == 0, 1 + np.log(often), 1.0)
            doc = np.zeros(len(h), "i8")
            words = np.hstack([neardup.pack_registers(neardup.signatures(h, doc, w, 1, 160)), neardup.parities(h, doc, 1)])
            pair.append((h, w, ([int(x) for x in words[0]], len(h), float((w - 1).sum()))))
        rows.append((pair[0][2], pair[1][2]))
        near.append(neardup.probability_jaccard(pair[0][0], pair[0][1], pair[1][0], pair[1][1]))
    got = [r[0] for r in spark.createDataFrame(rows, f"x {neardup.SKETCH}, y {neardup.SKETCH}").coalesce(1).select(neardup.likely("x", "y", 0.8)).collect()]
    assert all(g for g, j in zip(got, near, strict=True) if j >= 0.8) and sum(got) < 1.5 * sum(j >= 0.8 for j in near) < 1.5 * len(near)


def test_near_duplicates_of_repeated_passages_are_not_ruled_out(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    texts = [" ".join([passage] * 51 + [f"t{i}x{j}" for j in range(11 if i < 2 else 22)]) for i in range(150)]
    sets = []
    for t in texts[:3]:
        w = t.split()
        sets.append(collections.Counter(" ".join(w[i : i + 5]) for i in range(len(w) - 4)))
    names = {x: i for i, x in enumerate(sorted(set().union(*sets)))}

    def similarity(a, b):
        both = [sorted((names[x], 1 + math.log(n)) for x, n in s.items()) for s in (a, b)]
        return neardup.probability_jaccard(*(np.array(v) for m in both for v in zip(*m, strict=True)))

    # two texts are near; the others, which crowd their buckets, are near to nothing
    assert len(sets[0] & sets[1]) / len(sets[0]) < 0.65 and similarity(sets[0], sets[1]) >= 0.8 > similarity(sets[0], sets[2])
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(documents(spark, texts)).collect()}
    assert got == {i: 0 if i < 2 else i for i in range(150)}


def test_probability_jaccard_and_its_estimate():
    rng = np.random.default_rng(1)
    a, b = np.unique(rng.integers(1, 2**60, 150).astype("u8")), None
    b = np.unique(np.concatenate([a[20:], rng.integers(1, 2**60, 20).astype("u8")]))
    wa, wb = 1 + rng.random(len(a)), 1 + rng.random(len(b))
    xa, xb = dict(zip(a, wa, strict=True)), dict(zip(b, wb, strict=True))
    brute = sum(1 / sum(max(xa.get(j, 0) / xa[i], xb.get(j, 0) / xb[i]) for j in {*xa, *xb}) for i in xa.keys() & xb.keys())
    exact = neardup.probability_jaccard(a, wa, b, wb)
    assert math.isclose(exact, brute, rel_tol=1e-9)
    ones = np.ones(len(a)), np.ones(len(b))
    plain = len(xa.keys() & xb.keys()) / len({*xa, *xb})
    assert neardup.probability_jaccard(a, ones[0], b, ones[1]) == plain
    assert math.isclose(neardup.probability_jaccard(a, 2 * ones[0], b, 3 * ones[1]), neardup.probability_jaccard(a, ones[0], b, ones[1] * 1.5), rel_tol=1e-9)
    doc = np.repeat([0, 1], [len(a), len(b)])
    s = neardup.signatures(np.concatenate([a, b]), doc, np.concatenate([wa, wb]), 2, 4096)
    assert abs((s[0] == s[1]).mean() - exact) < 0.035


def test_token_counts_match_plain_dynamic_programming(spark):
    path = P.path("piece_bpe_32k.model")
    pieces = tokencount.pieces_of(path)
    trie = tokencount.Trie(pieces)

    def plain(word):
        text, best = tokencount.MARK + word, [(0.0, 0)]
        for end in range(1, len(text) + 1):
            options = [(best[end - 1][0] + trie.unknown, -(best[end - 1][1] - len(text[end - 1].encode())))]
            options = [(best[end - 1][0] + trie.unknown, best[end - 1][1] - len(text[end - 1].encode()))]
            options += [(best[s][0] + pieces[text[s:end]], best[s][1] - 1) for s in range(end) if text[s:end] in pieces]
            best.append(max(options))
        return -best[-1][1]

    texts = [*ODD, "antidisestablishmentarianism the theme thematic 漢字 ñandú"]
    got = {r["doc_id"]: r for r in tokencount.token_counts(documents(spark, texts), path).collect()}
    for i, text in enumerate(texts):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        assert (got[i]["n_words"], got[i]["n_tokens"]) == (len(words), sum(map(plain, words)))
    trie.count("theme")
    before = trie.scored
    trie.count("thematic")
    assert trie.scored - before == len("atic") and tokencount.token_counts(documents(spark, []), path).count() == 0


def test_toxicity_learns_and_spares_clean(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(900):
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(30)]
        toxic = i % 6 == 0
        if toxic:
            words[3:3] = rng.sample(["vile", "nasty", "scum"], 2)
        texts.append(" ".join(words))
        labels.append((i, 1, int(toxic)))
    docs, marks = documents(spark, [*texts, None, ""]), spark.createDataFrame(labels[:700], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.classify(docs, toxicity.train(docs, marks)).collect()}
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in rows)
    assert all(rows[i]["predicted"] == labels[i][2] for i in range(900)) and rows[900]["score"] == rows[901]["score"] < 0.7
    none = toxicity.train(docs, marks.limit(0))
    assert {r["predicted"] for r in toxicity.classify(docs, none).collect()} == {0} and toxicity.classify(docs.limit(0), none).count() == 0


def test_neighbours_reach_recall(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((12, 32))
    vectors = np.concatenate([centres[rng.integers(0, 12, 1500)] + 0.6 * rng.standard_normal((1500, 32)), rng.standard_normal((500, 32))])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(5000, None), (5050, [0.0] * 32), (5100, [float("nan")] * 32), (5150, [None] * 32), (None, [1.0] * 32)]
    got = collections.defaultdict(list)
    for r in sorted(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    hits = 0
    assert set(got) == set(range(0, 2000, 50))
    for q, found in got.items():
        cos = unit @ unit[q]
        cos[q] = -9
        hits += len({v for v, _ in found} & set(np.argsort(-cos, kind="stable")[:5].tolist()))
        assert len(found) == 5 and all(abs(cos[v] - s) < 1e-12 for v, s in found)
    assert hits >= 0.9 * 5 * len(got)
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")).count() == 1


def test_neighbours_count_ids_not_repeated_rows(spark):
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((200, 16))
    plain = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    near = [(7, [float(x) for x in vectors[50] + 0.01 * j]) for j in range(1, 9)]  # one id on eight other rows
    schema = "vec_id long, embedding array<double>"
    unit = {i: vectors[[i]] / np.linalg.norm(vectors[i]) for i in range(200)}

    def check(rows, best):
        got = collections.defaultdict(list)
        for r in sorted(ann.nearest(spark.createDataFrame(rows, schema).repartition(1)).collect(), key=lambda r: r["rank"]):
            got[r["query_id"]].append(r["vec_id"])
        for q in range(0, 200, 50):
            cos = {i: (best.get(i, unit[i]) @ unit[q][0]).max() for i in range(200) if i != q}
            assert got[q] == sorted(cos, key=lambda i: (-cos[i], i))[:5]

    check(plain + 5 * plain[:1], {})  # six equal rows of a query's id
    check(plain + plain, {})
    more = np.array([vectors[7], *(v for _, v in near)])
    check(plain + near, {7: more / np.linalg.norm(more, axis=1)[:, None]})


def test_registered_domains(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "uk"), "x.y.com:8080": ("y.com", "com"), "me@y.com.": ("y.com", "com"), "10.0.0.1:80": ("10.0.0.1", ""), "com": ("com", "com"), "": ("", ""), "x.co.com": ("co.com", "com")}
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", urls.domain_of(F.col("h")), urls.suffix_of(F.col("h"))).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == hosts


def test_url_rules_and_reputation(spark):
    rows = [(0, "https://A.Example.ORG/en/12?x#y"), (1, "http://example.org/es/"), (2, "http://org/"), (3, "http://x.com/de/1"), (4, None), (5, "nothing"), (6, "http://notexample.org/en/1"), (7, "ftp://u.net?q/p"), (8, "http://x.com/fr/")]
    rows += [(100 + i, "http://bad.net/p") for i in range(60)] + [(200 + i, "http://good.net/p") for i in range(60)]
    labels = [(100 + i, 0, 0) for i in range(40)] + [(200 + i, 1, 0) for i in range(40)]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert (got[0]["host"], got[0]["path"], got[0]["rule"], got[0]["verdict"]) == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert [got[i]["rule"] for i in (1, 2, 3, 6, 8)] == ["example.org/es/", "org/", "com/de/", "org/", "com/fr/"]
    assert (got[4]["host"], got[5]["path"], got[7]["host"], got[7]["path"]) == ("", "", "u.net", "")
    assert got[159]["verdict"] == "block" and got[259]["verdict"] == "allow"
    odd = [(None, "http://bad.net/p"), (7, "http://bad.net/p"), (7, "http://bad.net/p"), (8, "http://me@bad.net:80/p")]
    again = urls.judge(spark.createDataFrame(rows + odd, "page_id long, url string"), spark.createDataFrame(labels + [(None, 0, 0), (100, None, 1)], "doc_id long, quality int, toxic int")).collect()
    assert len(again) == len(rows) + 4 and {r["verdict"] for r in again if r["host"] == "bad.net"} == {"block"}
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_words_with_marks_are_encoded_from_their_letters():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from plumbline.llm.packing import WordTokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    words, whole, draw = WordTokenizer(path, 50), Tokenizer.from_file(path), random.Random(5)
    whole.encode_special_tokens = True
    texts = ["".join(draw.choice("aAbé́Éßİ,.!!.,'s1?- 東\n") for _ in range(draw.randint(1, 9))) for _ in range(3000)]
    for text in texts:
        assert b"".join(words.ids(text)) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)
    asked = []

    class Counted:
        def encode(self, word, **kwargs):
            asked.append(word)
            return whole.encode(word, **kwargs)

    words = WordTokenizer(path)
    words.whole = Counted()
    assert b"".join(words.ids("house!! réve., tree. house.")) and sorted(asked) == sorted([".", ".,", "!!"])
