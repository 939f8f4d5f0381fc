"""Near-duplicate classes by ProbMinHash signatures of weighted word shingles.

Texts of the same words are copies and count once, as a node. A node's five-word shingles
weigh ``1 + ln(times found)``. Each shingle is a Poisson process whose arrivals come at a
rate of its weight; an arrival picks a register at random and the earliest one holds it.
A shingle whose next arrival comes after all registers are held can no longer win and
stops there. Two texts then agree in a register with the probability Jaccard similarity of
their weighted shingles, which is the plain Jaccard where no shingle is found twice.

Nodes that agree in a band of registers are candidates if two short sketches let them pass.
Enough of all their registers must agree, which estimates the same similarity: a pair of
the threshold fails with a chance of one in a million at most. And the parities of their
shingles, by hash cell, must differ in few cells: each differing cell proves a shingle that
only one text has, and too many of these bound the similarity below the threshold. First each node of a bucket is compared with one
centre; links that hold on exact similarities join nodes to classes. Where a bucket then
still holds several classes, all candidates across classes are verified as well, so the
classes are those that all pairs of all buckets would give.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.graph import connected_components
from plumbline.llm.memory import release
from plumbline.llm.quality import text_of, window_hashes, words_of
from plumbline.staging import discard, stage

WIDTH = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 shares no band with a chance of (1 - 0.8 ** 5) ** 32, some 3 in a million.
BANDS, ROWS = 32, 5
#: The chance that the agreement of all registers turns a pair of the threshold down.
MISS = 1e-6
#: Cells of parities, 64 to a word.
CELLS = 2_048
#: Centres of the second stars of a bucket.
CENTRES = 3
#: Nodes of a bucket that are compared in one piece with as many others; larger buckets are cut into a grid.
PIECE = 2_048
#: Bits of the filter that spares texts outside all pairs their way to a join: 16 a node, at most 2 MB in all.
MOST_BITS = 1 << 24
#: Shingles that are worked on at a time.
CHUNK, CHUNK_DOCS = 1 << 16, 512
#: Rows that a Python worker is sent at a time; a batch is also bounded in bytes by Spark's own setting.
BATCH = 1_000
#: 64-bit words that hold four bits of each register.
PACKS = BANDS * ROWS // 16
SKETCH = "struct<words: array<bigint>, distinct: int, extra: double>"
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@contextmanager
def _small_batches(spark: SparkSession):
    """Send Python workers ``BATCH`` rows at a time at most, for the jobs that run within."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(BATCH, int(before)) if int(before) > 0 else BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _wait(state: np.ndarray) -> np.ndarray:
    """Exponential waiting times of rate 1."""
    return -np.log1p(-(state >> np.uint64(11)).astype("f8") * 2.0**-53)


def weighted(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) in order, with their weights."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(first)
    times = np.diff(np.append(at, len(h)))
    return h[at], d[at], 1.0 + np.log(times)


def signatures(hashes: np.ndarray, doc: np.ndarray, weight: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """The shingle that holds each register, as an array of documents by registers. Documents without shingles hold 0."""
    best = np.full(docs * registers, np.inf)
    held = np.zeros(docs * registers, "u8")
    element, state = hashes.astype("u8"), _mix(hashes.astype("u8") + _GOLDEN)
    arrival = _wait(state) / weight
    while len(element):
        state = _mix(state + _GOLDEN)
        spot = doc * registers + (state % np.uint64(registers)).astype("i8")
        np.minimum.at(best, spot, arrival)
        won = arrival == best[spot]
        held[spot[won]] = element[won]
        alive = np.unique(doc)
        last = np.zeros(docs)
        last[alive] = best.reshape(docs, registers)[alive].max(1)
        state = _mix(state + _GOLDEN)
        arrival = arrival + _wait(state) / weight
        stay = arrival < last[doc]
        element, doc, weight, state, arrival = element[stay], doc[stay], weight[stay], state[stay], arrival[stay]
    return held.reshape(docs, registers)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each document."""
    parts = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype="u8") * _GOLDEN, parts.shape[:2]).copy()
    for k in range(rows):
        key = _mix(key * np.uint64(31) + parts[:, :, k])
    return key.view("i8")


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The exact probability Jaccard of two weighted sets, their hashes distinct and sorted, in n log n.

    For each common element, the sum over all others of the larger of the two relative
    weights splits at its own ratio of weights, so prefix sums by ratio give them all.
    Where all weights are 1 it is the plain Jaccard.
    """
    if not len(a) or not len(b):
        return 0.0
    if wa.max() == wb.max() == 1.0:  # no weight is below 1
        both = np.concatenate([a, b])
        both.sort(kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        return common / (len(both) - common)
    union = np.union1d(a, b)
    x, y = np.zeros(len(union)), np.zeros(len(union))
    x[np.searchsorted(union, a)] = wa
    y[np.searchsorted(union, b)] = wb
    with np.errstate(divide="ignore"):
        ratio = np.where(x > 0, y / np.where(x > 0, x, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    ratio, x, y = ratio[order], x[order], y[order]
    end = np.searchsorted(ratio, ratio, "right")
    below = np.cumsum(x)[end - 1]
    above = y.sum() - np.cumsum(y)[end - 1]
    both = (x > 0) & (y > 0)
    return float((1.0 / (below[both] / x[both] + above[both] / y[both])).sum())


def pack_registers(signature: np.ndarray) -> np.ndarray:
    """Four bits of each register, sixteen registers to a 64-bit word."""
    bits = (_mix(signature.astype("u8")) >> np.uint64(60)).reshape(len(signature), -1, 16)
    return (bits << (np.arange(16, dtype="u8") * np.uint64(4))).sum(2, dtype="u8").view("i8")


def parities(hashes: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Whether each cell holds an odd number of a document's distinct shingles, 64 cells to a word."""
    cell = (_mix(hashes ^ _GOLDEN) % np.uint64(CELLS)).astype("i8")
    odd = (np.bincount(doc * CELLS + cell, minlength=docs * CELLS) & 1).astype("u1")
    return np.packbits(odd, bitorder="little").view("i8").reshape(docs, CELLS // 64)


def likely(x: str, y: str, threshold: float) -> Column:
    """True unless the sketches of the columns ``x`` and ``y``, structs of (words, distinct, extra), rule out the threshold.

    If d shingles are in one text only, S is the sum of both numbers of distinct shingles
    and E that of their weights beyond 1, then the similarity is at most
    ((S - d) / 2 + E) / ((S + d) / 2), as a common shingle i adds at most its larger weight
    over the size of the union. It is also at most the relative weight of the shared
    shingles in either text, hence d <= (1 - threshold) (S + E). Differing parities count
    no more than d.
    """
    ones = F.lit(0x1111111111111111)
    registers, cells = F.lit(0), F.lit(0)
    for k in range(PACKS + CELLS // 64):
        both = F.get(F.col(x)["words"], F.lit(k)).bitwiseXOR(F.get(F.col(y)["words"], F.lit(k)))
        if k < PACKS:
            half = both.bitwiseOR(F.shiftrightunsigned(both, 1))
            registers = registers + F.bit_count(half.bitwiseOR(F.shiftrightunsigned(half, 2)).bitwiseAND(ones))
        else:
            cells = cells + F.bit_count(both)
    size = F.col(x)["distinct"] + F.col(y)["distinct"]
    extra = F.col(x)["extra"] + F.col(y)["extra"]
    most = F.least(((1 - threshold) * size + 2 * extra) / (1 + threshold), (1 - threshold) * (size + extra))
    return (cells <= most + 1e-6) & (registers <= most_differing(threshold))


def most_differing(threshold: float, registers: int = BANDS * ROWS, miss: float = MISS) -> int:
    """Registers that may differ so that a pair of the threshold passes but for a chance of ``miss``.

    Registers are independent and differ with probability 1 - threshold; one in sixteen
    of those agrees in its four bits all the same.
    """
    p = (1 - threshold) * 15 / 16
    above, n = 0.0, registers
    while n > 0:
        above += math.comb(registers, n) * p**n * (1 - p) ** (registers - n)
        if above > miss:
            break
        n -= 1
    return n


def _digest(words: Column) -> Column:
    return F.unhex(F.md5(F.array_join(words, " ")))


def _shingles(words: Column) -> Column:
    """The hashes of the windows; a text of one to four words is one window."""
    short = F.when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(words) < WIDTH, short).otherwise(window_hashes(words, WIDTH))


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of at most ``CHUNK_DOCS`` documents of some ``CHUNK`` shingles; a longer document is a run of its own."""
    start = 0
    while start < len(offsets) - 1:
        end = int(np.searchsorted(offsets, offsets[start] + CHUNK, "right")) - 1
        end = max(start + 1, min(end, start + CHUNK_DOCS, len(offsets) - 1))
        yield start, end
        start = end


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(3)
        offsets = column.offsets.to_numpy()
        values = column.values.to_numpy().view("u8")
        keys, words, totals, has = [np.zeros((0, BANDS), "i8")], [np.zeros((0, PACKS + CELLS // 64), "i8")], [np.zeros((0, 2))], [np.zeros(0, bool)]
        for start, end in _chunks(offsets):
            docs, sizes = end - start, np.diff(offsets[start : end + 1])
            h, d, w = weighted(values[offsets[start] : offsets[end]], np.repeat(np.arange(docs), sizes))
            signature = signatures(h, d, w, docs, BANDS * ROWS)
            keys.append(band_keys(signature, BANDS, ROWS))
            words.append(np.hstack([pack_registers(signature), parities(h, d, docs)]))
            totals.append(np.stack([np.bincount(d, minlength=docs), np.bincount(d, w - 1, docs)], 1))
            has.append(sizes > 0)
        full, sums = np.concatenate(has), np.concatenate(totals)

        def listed(parts: list[np.ndarray]) -> pa.Array:
            flat = np.concatenate(parts)
            ends = np.concatenate([[0], np.cumsum(np.where(full, flat.shape[1], 0))]).astype("i4")
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[full].ravel()))

        sketch = pa.StructArray.from_arrays([listed(words), pa.array(sums[:, 0].astype("i4")), pa.array(sums[:, 1])], names=["words", "distinct", "extra"])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], listed(keys), sketch], names=["doc_id", "th", "node", "bands", "sketch"])
    release()


def _weigh(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, times = np.unique(values, return_counts=True)
    return h, 1.0 + np.log(times)


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, right = [], None, None
            b, left_values, right_values = batch.column(1), batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                name = b[i].as_py()
                if name != last:  # rows come sorted by b from the join
                    last, right = name, _weigh(right_values[i].values.to_numpy().view("u8"))
                left = _weigh(left_values[i].values.to_numpy().view("u8"))
                keep.append(probability_jaccard(*left, *right) >= threshold - 1e-12)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        release()

    return run


def _may_hold(hashes: DataFrame):
    """A test of hashes that is true for all of the one column of ``hashes`` and few others; where those are very many, for more others."""
    n = hashes.count()
    bits = min(MOST_BITS, max(1 << 10, 1 << (16 * n).bit_length()))
    at = hashes.select(F.pmod(hashes.columns[0], F.lit(bits)).alias("bit")).groupBy(F.shiftright("bit", 5).alias("word"))
    words = at.agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 32 AS INT))")).alias("on")).toPandas()
    table = np.zeros(bits // 32, "i8")
    table[words["word"].to_numpy("i8")] = words["on"].to_numpy("i8")

    @F.pandas_udf("boolean")
    def test(th: pd.Series) -> pd.Series:
        bit = th.to_numpy() & (bits - 1)
        return pd.Series((table[bit >> 5] >> (bit & 31)) & 1 == 1)

    return test


def _of_nodes(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(nid, hashes) of ``nodes`` of (nid, node, doc_id, th), from the one text of each; only texts are moved, once, by the hashes of id and text."""
    ih = F.xxhash64("doc_id").alias("ih")  # a null id hashes like a value
    text = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).select(ih, F.xxhash64("text").alias("th"), "text")
    once = text.where(_may_hold(nodes.select("th"))("th")).groupBy("ih", "th").agg(F.any_value("text").alias("text"))
    words = once.join(nodes.select("nid", "node", ih, "th"), ["ih", "th"]).select("nid", "node", words_of(F.col("text")).alias("words"))
    return words.where(_digest(F.col("words")) == F.col("node")).select("nid", _shingles(F.col("words")).alias("hashes"))


def verified(pairs: DataFrame, shingled: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) of ``pairs``, two nodes each, whose similarity by ``shingled`` of (nid, hashes) reaches ``threshold``."""
    left = shingled.select(F.col("nid").alias("a"), F.col("hashes").alias("ha"))
    right = shingled.select(F.col("nid").alias("b"), F.col("hashes").alias("hb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ha", "hb").mapInArrow(_verify(threshold), "a long, b long")


def classes(docs: DataFrame, threshold: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, class_node, class_id): one row per row of ``docs``; th is the hash of the text.

    class_id is the smallest id of the class, null only if all its ids are. Texts without
    words (and null texts) are copies of each other and near to nothing else. Repeated
    rows and ids share the class of their text. An empty table gives an empty table.
    """
    with _small_batches(docs.sparkSession):
        return _classes(docs, threshold, id_col, text_col)


def _signed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Staged (doc_id, th, node, bands, sketch) of all rows, and one row per node with a number ``nid`` of its own in random order."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    words = text.select("doc_id", F.xxhash64("text").alias("th"), words_of(F.col("text")).alias("words"))
    made = words.select("doc_id", "th", _digest(F.col("words")).alias("node"), _shingles(F.col("words")).alias("hashes"))
    signed = stage(made.mapInArrow(_sign, f"doc_id {kind}, th long, node binary, bands array<bigint>, sketch {SKETCH}"), "nd-signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    nodes = signed.groupBy("node").agg(first, F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    numbered = nodes.select(F.xxhash64(F.monotonically_increasing_id()).alias("nid"), "node", "first.doc_id", "first.th", "bands", "sketch")  # a hash of one number is never shared
    return signed, stage(numbered, "nd-nodes")


def _likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) of ``pairs`` that their sketches don't rule out."""
    x, y = (nodes.select(F.col("nid").alias(n), F.col("sketch").alias("s" + n)) for n in ("a", "b"))
    return pairs.join(x, "a").join(y, "b").where(likely("sa", "sb", threshold)).select("a", "b")


def _split_buckets(several: DataFrame) -> DataFrame:
    """Staged: the rows of (key, n, nid, component) whose bucket holds more than one class."""
    split = several.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return stage(several.join(split, "key", "left_semi"), "nd-split")


def _across(held: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """All likely (a, b) in one bucket but in two classes, for ``held`` of (key, n, nid, component).

    A bucket is cut into pieces by hash; each pair of pieces is a group of its own, so a
    group compares ``PIECE`` nodes with as many, however large its bucket is.
    """
    pieces = F.ceil(F.col("n") / PIECE).cast("int")
    rows = held.join(nodes.select("nid", "sketch"), "nid").withColumn("p", F.pmod(F.xxhash64("nid"), pieces).cast("int"))
    left = rows.select("key", F.col("p").alias("i"), F.explode(F.sequence(F.col("p"), pieces - 1)).alias("j"), F.col("nid").alias("x"), F.col("component").alias("cx"), F.col("sketch").alias("sx"))
    right = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("p"))).alias("i"), F.col("p").alias("j"), F.col("nid").alias("y"), F.col("component").alias("cy"), F.col("sketch").alias("sy"))
    apart = (F.col("cx") != F.col("cy")) & ((F.col("i") != F.col("j")) | (F.col("x") < F.col("y")))
    found = left.join(right, ["key", "i", "j"]).where(apart & likely("sx", "sy", threshold))
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _classes(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    signed, nodes = _signed(docs, id_col, text_col)
    member = nodes.select(F.explode("bands").alias("key"), "nid")
    heads = stage(member.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("nid").alias("centre")).where("n > 1"), "nd-buckets")
    placed = stage(member.join(heads, "key").select("key", "n", "nid", "centre"), "nd-placed")
    discard(heads)
    stars = placed.where("nid <> centre").select(F.least("nid", "centre").alias("a"), F.greatest("nid", "centre").alias("b")).distinct()
    pairs = stage(_likely(stars, nodes, threshold), "nd-pairs")

    def shingles(of: DataFrame) -> DataFrame:
        paired = of.select(F.col("a").alias("nid")).union(of.select("b")).distinct().join(nodes.select("nid", "node", "doc_id", "th"), "nid")
        paired = stage(paired, "nd-paired")
        out = stage(_of_nodes(docs, paired, id_col, text_col), "nd-shingles")
        discard(paired)
        return out

    shingled = shingles(pairs)
    links = stage(verified(pairs, shingled, threshold), "nd-links")
    discard(shingled)
    found = connected_components(links)

    several = placed.where("n > 2").select("key", "n", "nid").join(found, placed["nid"] == found["node"], "left")
    several = stage(several.select("key", "n", "nid", F.coalesce("component", "nid").alias("component")), "nd-several")
    discard(placed)
    held = _split_buckets(several)
    discard(several)
    # more stars in buckets that are split, so that a group whose members differ more or less from one centre is one class before all pairs across classes are looked at
    centres = held.groupBy("key").agg(F.array(*(F.min_by(F.struct("nid", "component"), F.xxhash64("nid", F.lit(turn))) for turn in range(CENTRES))).alias("c"))
    beams = held.join(centres, "key").select("nid", "component", F.explode("c").alias("c")).where("component <> c.component")
    beams = beams.select(F.least("nid", "c.nid").alias("a"), F.greatest("nid", "c.nid").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    second = stage(_likely(beams, nodes, threshold), "nd-second")
    tested = [pairs, second]
    if not second.isEmpty():
        shingled = shingles(second)
        every = stage(links.union(verified(second, shingled, threshold)), "nd-links")
        discard(shingled, links)
        links, found = every, connected_components(every)
        renamed = held.select("key", "n", "nid").join(found, held["nid"] == found["node"], "left")
        again = stage(renamed.select("key", "n", "nid", F.coalesce("component", "nid").alias("component")), "nd-several")
        discard(held)
        held = _split_buckets(again)
        discard(again)
    more = stage(_across(held, nodes, threshold).join(pairs.union(second), ["a", "b"], "left_anti"), "nd-more")
    discard(held, *tested)
    if not more.isEmpty():
        shingled = shingles(more)
        extra = stage(verified(more, shingled, threshold), "nd-links")
        discard(shingled)
        if not extra.isEmpty():
            found = connected_components(links.union(extra))
        discard(extra)
    discard(links, more)

    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    grouped = nodes.select("nid", "node", "doc_id").join(found.withColumnRenamed("node", "nid"), "nid", "left")
    grouped = stage(grouped.select("node", "doc_id", F.coalesce("component", "nid").alias("class_node")), "nd-grouped")
    discard(nodes)
    least = grouped.groupBy("class_node").agg(F.min(place)["doc_id"].alias("class_id"))
    of_node = grouped.join(least, "class_node").select("node", "class_node", "class_id")
    out = stage(signed.select("doc_id", "th", "node").join(of_node, "node").select("doc_id", "th", "class_node", "class_id"), "nd-classes")
    discard(signed, grouped)
    return out


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id): the class of every row of ``docs``."""
    return classes(docs, threshold, id_col, text_col).select("doc_id", "class_id")


def one_of_each(docs: DataFrame, threshold: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class one row with the smallest id, all columns kept.

    A row is found again by its id and the hash of its text, so copies of one text go to
    as many tasks as they have ids. Columns may have any names.
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    best = classes(docs, threshold, id_col, text_col).groupBy("class_node").agg(F.min(place).alias("k"))
    kept = stage(best.select(F.xxhash64("k.doc_id").alias("ih"), F.col("k.doc_id").alias("id"), F.col("k.th").alias("th")), "nd-kept")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = whole.select(F.xxhash64(F.col("row")[id_col]).alias("ih"), F.xxhash64(F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))).alias("th"), "row")
    same = rows.join(kept, ["ih", "th"]).where(F.col("row")[id_col].eqNullSafe(F.col("id")))
    return same.dropDuplicates(["ih", "th"]).select("row.*")
