"""Periodic runs of words: the same words again and again, found and collapsed to their first period."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from plumbline.llm.memory import release

#: Texts are searched together until they have so many bytes; a longer text is searched alone.
BATCH_BYTES = 4 << 20


def least_length(period: np.ndarray, shortest: int, times: int) -> np.ndarray:
    return np.maximum(shortest, times * period)


def repeated_grams(ids: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that its document holds twice or more.

    Grams are told apart by 64-bit hashes: two that collide mark more words, never fewer.
    """
    n = len(ids) - k + 1
    if n < 1:
        return np.zeros(len(ids), bool)
    inside = doc[:n] == doc[k - 1 :]
    h = doc[:n].astype("u8")
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j : n + j].astype("u8")
        h ^= h >> np.uint64(32)
    h = h[inside]
    by_value = np.sort(h)
    twice = np.unique(by_value[1:][by_value[1:] == by_value[:-1]])
    change = np.zeros(len(ids) + 1, "i8")
    if len(twice):
        near = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
        starts = np.flatnonzero(inside)[twice[near] == h]
        change[starts] += 1
        change[starts + k] -= 1
    return np.cumsum(change[:-1]) > 0


def _ranks(w: np.ndarray, longest: int) -> np.ndarray:
    """Row j numbers the stretches of 2**j words from each place, equal numbers for equal stretches."""
    rows = [np.unique(w, return_inverse=True)[1].astype("i4")]
    while 2 ** len(rows) <= longest:
        half = 2 ** (len(rows) - 1)
        second = np.full(len(w), -1, "i8")
        second[:-half] = rows[-1][half:]
        rows.append(np.unique(rows[-1].astype("i8") * (len(w) + 1) + second + 1, return_inverse=True)[1].astype("i4"))
    return np.stack(rows)


def _common(ranks: np.ndarray, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """For how many words the stretches from a and b on (or, ``back``, those before a and b) are equal; a < b."""
    out = np.zeros(len(a), "i8")
    for j in range(len(ranks) - 1, -1, -1):
        at = a - out - 2**j if back else a + out
        same = (at >= 0) & (ranks[j, at] == ranks[j, at + b - a])
        out += same.astype("i8") << j
    return out


def main_lorentz(w: np.ndarray, low: np.ndarray, high: np.ndarray, shortest: int, times: int) -> np.ndarray:
    """Rows (start, end, period) of the maximal runs of ``w`` that lie in the segments [low, high).

    Each segment starts and ends beside a value of ``w`` found nowhere else. Segments are
    halved, all of one level at once. A run across a middle has its period matched there:
    for every possible period the words around the middle are compared with those one
    period on (or back). Whether at least half of a run's matches lie on one side of the
    middle is one comparison of ranks; only what passes is measured, to its full extent.
    Of several periods of one stretch the smallest is kept.
    """
    if not len(low):
        return np.zeros((0, 3), "i8")
    ranks = _ranks(w, int((high - low).max()))
    found = []
    while len(low):
        middle, most = (low + high) // 2, (high - low) // times
        node = np.repeat(np.arange(len(low)), most)
        q = 1 + np.arange(len(node)) - np.repeat(np.cumsum(most) - most, most)
        matches = least_length(q, shortest, times) - q
        j = np.frexp((matches + 1) // 2)[1] - 1
        for a in (middle[node], middle[node] - q):
            before = a - 2**j
            likely = (ranks[j, a] == ranks[j, a + q]) | ((before >= 0) & (ranks[j, before] == ranks[j, before + q]))
            a, p = a[likely], q[likely]
            ahead, behind = _common(ranks, a, a + p, False), _common(ranks, a, a + p, True)
            run = np.stack([a - behind, a + p + ahead, p], 1)
            found.append(run[ahead + behind >= matches[likely]])
        low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
        wide = high - low >= shortest
        low, high = low[wide], high[wide]
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return runs[first]


def find_runs(ids: np.ndarray, doc: np.ndarray, shortest: int = 6, times: int = 4) -> np.ndarray:
    """Rows (start, end, period), by start, of the runs of at least max(shortest, times * period) words within a document.

    ``ids`` are the words of documents laid end to end, ``doc`` their documents. All words of a
    run lie in k-grams that its document repeats one period on, where k is the least overlap
    of a run with itself one period on; others are masked, and only what is left is searched.
    """
    if not len(ids):
        return np.zeros((0, 3), "i8")
    periods = np.arange(1, shortest + 1)
    k = int((least_length(periods, shortest, times) - periods).min())
    left = repeated_grams(ids, doc, k)
    edge = np.ones(len(ids) + 1, bool)
    edge[1:-1] = doc[1:] != doc[:-1]
    starts = np.flatnonzero(left & (edge[:-1] | ~np.concatenate([[False], left[:-1]])))
    ends = np.flatnonzero(left & (edge[1:] | ~np.concatenate([left[1:], [False]]))) + 1
    fits = ends - starts >= shortest
    starts, ends = starts[fits], ends[fits]
    sizes = ends - starts
    low = 1 + np.cumsum(sizes + 1) - (sizes + 1)
    w = -1 - np.arange(int(sizes.sum()) + len(sizes) + 1, dtype="i8")  # what stays negative parts the segments
    shift = np.repeat(starts - low, sizes)
    inner = np.arange(int(sizes.sum())) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
    w[inner] = ids[inner + shift]
    runs = main_lorentz(w, low, low + sizes, shortest, times)
    if len(runs):
        runs[:, :2] += (starts - low)[np.searchsorted(low, runs[:, 0], side="right") - 1][:, None]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _search(texts: pa.Array, shortest: int, times: int) -> tuple[pa.Array, pa.Array]:
    """The runs and the collapsed text of each text."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    size = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype("i8")
    words, doc = split.flatten(), np.repeat(np.arange(len(texts)), size)
    real = pc.greater(pc.binary_length(words), 0)  # blanks at an end leave an empty word there
    words, doc = words.filter(real), doc[real.to_numpy(zero_copy_only=False)]
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype("i8")
    runs = find_runs(ids, doc, shortest, times)
    of = doc[runs[:, 0]] if len(runs) else np.zeros(0, "i8")
    change = np.zeros(len(ids) + 1, "i8")
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    keep = np.cumsum(change[:-1]) == 0
    kept_first = np.searchsorted(doc[keep], np.arange(len(texts) + 1))
    collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(kept_first, pa.int64()), words.filter(pa.array(keep))), pa.scalar(" ", pa.large_string()))
    fields = [pa.array(runs[:, 0] - first[of]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])]
    listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    return listed, collapsed.cast(pa.string())


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, rows) of stretches of some ``BATCH_BYTES``, of one text at least."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(texts).cast(pa.float64()).to_numpy(zero_copy_only=False)))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + BATCH_BYTES, side="right")))
        yield at, stop - at
        at = stop


def collapse_runs(docs: DataFrame, text: str = "text", shortest: int = 6, times: int = 4) -> DataFrame:
    """The documents with ``runs``, an array of (start, length, period) by start, and ``collapsed``; columns of these two names are replaced.

    A run is a stretch of words of smallest period ``period``, at least
    max(``shortest``, ``times`` * period) long, that no neighbouring word extends. In the
    collapsed text, words that a run holds after its first period are left out, and the
    others are joined by one space. Words are runs of anything but ``[\\x20\\x09-\\x0D]``.

    Every document is searched in the task that reads it; nothing is shuffled. Short texts
    are searched together; a text's search takes memory for some log2(words of it in
    repeated grams) numbers of a word. A null or empty text, or one without words, has no
    runs and an empty collapsed text; equal rows give equal rows; an empty table stays empty.
    """
    docs = docs.drop("runs", "collapsed")
    run = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])
    schema = StructType([*docs.schema.fields, StructField("runs", ArrayType(run)), StructField("collapsed", StringType())])
    at = docs.columns.index(text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in _slices(batch.column(at)):
                part = batch.slice(first, rows)
                yield pa.RecordBatch.from_arrays([*part.columns, *_search(part.column(at), shortest, times)], names=schema.names)
        release()

    return docs.mapInArrow(task, schema)
