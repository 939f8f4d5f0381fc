"""Best-two-fit packing of tokenised documents into fixed-length sequences.

The plan works on the histogram of piece lengths, which has at most ``capacity``
entries whatever the size of the corpus. A bin is filled greedily with the longest
length that still fits; then its shortest piece is taken out and replaced by the two
unpacked lengths that fill the widened gap best, if they fill it more tightly. The
same choice is repeated for as long as every length it uses is in stock, so one
pattern stands for many sequences, exactly as if bins were filled one by one.
Pieces then find their slot by their number among the pieces of equal length.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.memory import release
from plumbline.ranking import cells_for, number_within
from plumbline.staging import stage

CAPACITY = 2048
END_ID = 0
#: Words that a worker's cache holds before it starts afresh.
CACHE_WORDS = 300_000
#: Characters of a text that are split at a time.
SLICE = 1 << 20
#: Marks that the vocabulary's pre-tokenizer parts from the letters before them, in one run.
MARKS = ",.!"
#: Whether this machine's own unsigned integers are little-endian ones of 32 bits, which are made faster than numpy's.
_NATIVE = sys.byteorder == "little" and array("I").itemsize == 4


class _Words(dict):
    """Ids of words, encoded at first sight; it starts afresh when it holds ``most`` words."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> bytes:
        found = self.encode(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = found
        return found


class WordTokenizer:
    """Ids of whole texts, from ids of their space-separated words.

    The vocabulary's pre-tokenizer never joins characters across white space, so a
    text's ids are those of its words one after the other, and each distinct word need
    be encoded only once. Strings of special tokens stand for their ids wherever they are
    in a text, as the whole tokenizer has it; what is around them is split on its own.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        special = {x.content: i for i, x in self.whole.get_added_tokens_decoder().items()}
        self.special = {x: np.array([i], "<u4").tobytes() for x, i in special.items()}
        self.between = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.whole.encode_special_tokens = True  # words hold none of them, unless lower case makes one
        self.model = self.whole.model
        self.cache = _Words(self._encode, cache_words)
        #: The printable characters that byte-level vocabularies use for bytes.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}

    def _letters_only(self, word: str) -> list[int]:
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, unicodedata.normalize("NFC", word).lower().encode()))
        else:
            word = word.lower()
        return [t.id for t in self.model.tokenize(word)]

    def _encode(self, word: str) -> bytes:
        stem = word.rstrip(MARKS) if word[-1] in MARKS else word
        if stem.isalpha() and (stem.isascii() or (max(stem) < "ɐ" and "İ" not in stem)):
            if len(stem) < len(word):
                return self.cache[stem] + self.cache[word[len(stem) :]]
            ids = self._letters_only(word)
        else:
            ids = self.whole.encode(word, add_special_tokens=False).ids
        return array("I", ids).tobytes() if _NATIVE else np.array(ids, "<u4").tobytes()

    def ids(self, text: str) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids, one block for each slice of the text."""
        start = 0
        while start < len(text):
            end = start + SLICE
            while end < len(text) and text[end] not in " \n":
                end += 1
            part = text[start:end]
            start = end
            if self.between is not None and any(x in part for x in self.special):
                for piece in self.between.split(part):
                    yield self.special[piece] if piece in self.special else self._plain(piece)
            else:
                yield self._plain(part)

    def _plain(self, part: str) -> bytes:
        try:
            part.encode("latin-1")
            part = part.lower()
        except UnicodeEncodeError:
            pass
        plain = not any(c in part for c in "\x1c\x1d\x1e\x1f")  # str.split() takes them for white space, the vocabulary doesn't
        words = part.split() if plain else [w for w in part.replace("\n", " ").split(" ") if w]
        return b"".join(map(self.cache.__getitem__, words))


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_for(path: str) -> WordTokenizer:
    """One tokenizer for each worker process and file."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Cut documents into pieces of at most ``capacity`` ids.

    A document is the ids of its text, then ``end_id``; a null text is an empty one and
    still yields its end. Only a longer document is cut, every ``capacity`` ids. Null or
    repeated document ids are kept as they are, one document a row. Columns: doc_id,
    piece int, start long, length long, ids_crc32 long, and ids if ``keep_ids``.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer_for(tokenizer_path)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for doc_id, text in zip(doc_ids, batch.column(1), strict=True):
                rest, start, piece = b"", 0, 0
                for block in (*tokens.ids(text.as_py() or ""), end):
                    rest += block
                    while len(rest) > 4 * capacity:
                        out.append((doc_id, piece, start, capacity, rest[: 4 * capacity]))
                        rest, start, piece = rest[4 * capacity :], start + capacity, piece + 1
                out.append((doc_id, piece, start, len(rest) // 4, rest))
            columns = list(zip(*out, strict=True)) or [()] * 5
            arrays = [
                pa.array(columns[0], batch.schema.types[0]),
                pa.array(columns[1], pa.int32()),
                pa.array(columns[2], pa.int64()),
                pa.array(columns[3], pa.int64()),
                pa.array([zlib.crc32(x) for x in columns[4]], pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype("i4") for x in columns[4]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)
            del out, columns, arrays
        release()

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return source.mapInArrow(cut, schema)


def plan_best_two_fit(stock: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Patterns ``(sequences, lengths)`` that use up ``stock``, a count for each length from 1 to ``capacity``.

    >>> plan_best_two_fit({6: 1, 5: 1, 4: 1, 3: 1, 2: 1}, 10)
    [(1, [6, 4]), (1, [5, 3, 2])]
    """
    left = {length: count for length, count in stock.items() if count > 0}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("lengths must be from 1 to the capacity")
    present = 0
    for length in left:
        present |= 1 << length

    def longest(limit: int, used: Counter) -> int:
        """The longest length up to ``limit`` of which some are left beside ``used``, or 0."""
        mask = present & ((1 << (limit + 1)) - 1)
        while mask:
            length = mask.bit_length() - 1
            if left[length] > used[length]:
                return length
            mask ^= 1 << length
        return 0

    plan = []
    while left:
        used: Counter = Counter()
        gap, items = capacity, []
        while length := longest(gap, used):
            items.append(length)
            used[length] += 1
            gap -= length
        short = items[-1]
        if gap and len(items) > 1:
            used[short] -= 1
            wide, best, pair = gap + short, short, None
            first = wide - 1
            while first and (a := longest(first, used)):
                if 2 * a <= best:
                    break
                used[a] += 1
                b = longest(min(a, wide - a), used)
                used[a] -= 1
                if b and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == wide:
                        break
                first = a - 1
            if pair:
                items[-1:] = pair
                used.update(pair)
            else:
                used[short] += 1
        times = min(left[length] // n for length, n in used.items() if n)
        plan.append((times, items))
        for length, n in used.items():
            if n:
                left[length] -= times * n
                if not left[length]:
                    del left[length]
                    present ^= 1 << length
    return plan


def _slots(plan: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, by the number of its pieces: where a run of slots starts, its pieces a sequence, first sequence and places."""
    runs: dict[int, list[tuple]] = {}
    taken: Counter = Counter()
    first = 0
    for times, items in plan:
        places: dict[int, list[int]] = {}
        at = 0
        for length in items:
            places.setdefault(length, []).append(at)
            at += length
        for length, offsets in places.items():
            runs.setdefault(length, []).append((taken[length], len(offsets), first, offsets))
            taken[length] += times * len(offsets)
        first += times
    out = {}
    for length, found in runs.items():
        flat = np.array([x for r in found for x in r[3]], "i8")
        begin = np.cumsum([0, *(len(r[3]) for r in found)])[:-1]
        out[length] = tuple(np.array([r[k] for r in found], "i8") for k in range(3)) + (begin, flat)
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece a sequence_id long and an offset long in it, gapless from 0.

    ``pieces`` has a length column of 1 to ``capacity``; its other columns are kept. It is
    staged once, as the plan needs its histogram first. Only that histogram (at most
    ``capacity`` rows) and the plan made from it reach the driver and the workers. An
    empty table gives an empty table.
    """
    pieces = stage(pieces, "pieces")
    stock = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = _slots(plan_best_two_fit(stock, capacity))
    spread = F.xxhash64(*[c for c, kind in pieces.dtypes if not kind.startswith(("array", "map"))])
    order = [F.col(c) for c in ("doc_id", "piece", "start") if c in pieces.columns] or [F.col("length")]
    ranked = number_within(pieces, ["length"], spread, order, "_rank", cells_for(max(stock.values(), default=0)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index("length")).to_numpy()
            ranks = batch.column(batch.schema.get_field_index("_rank")).to_numpy()
            sequence, offset = np.zeros(len(lengths), "i8"), np.zeros(len(lengths), "i8")
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                starts, each, first, begin, flat = slots[int(length)]
                run = np.searchsorted(starts, ranks[at], "right") - 1
                nth = ranks[at] - starts[run]
                sequence[at] = first[run] + nth // each[run]
                offset[at] = flat[begin[run] + nth % each[run]]
            keep = [i for i, name in enumerate(batch.schema.names) if name != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(sequence), pa.array(offset)],
                names=[*(batch.schema.names[i] for i in keep), "sequence_id", "offset"],
            )

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids, for pieces that kept their ids. A group holds at most one sequence's ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
