"""Token counts under a unigram vocabulary, by dynamic programming shared over a trie.

A pre-token is a run of characters that are not white space, with the word mark in front.
Its best segmentation maximises the sum of its pieces' scores. The best score of a prefix
depends on that prefix alone, so distinct pre-tokens go into a trie and every node is
scored once for all words below it; a node where words end keeps their number of tokens.
A text's count is the sum over its pre-tokens.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Nodes of a worker's trie before it starts afresh, and bytes of a text that are split at a time.
MOST_NODES, SLICE = 1_000_000, 1 << 20
_SPACE = b" \t\n\x0b\x0c\r"


def pieces_of(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece vocabulary with unigram scores by rank: the r-th piece has ``-ln(r + 1)``, as Zipf's law has it.

    The file's own scores only order its merges, so the rank is all they tell. Byte,
    control and unknown pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[str, float] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            out[model.id_to_piece(i)] = -math.log(len(out) + 2)
    return out


class _Counts(dict):
    """Tokens by pre-token, in UTF-8; one not yet known is scored on the trie."""

    def __init__(self, trie: Trie):
        super().__init__()
        self.trie = trie

    def __missing__(self, word: bytes) -> int:
        trie = self.trie
        if trie.nodes >= trie.most_nodes:
            trie._clear()
        found = self[word] = trie._insert(MARK + word.decode())
        return found


class Trie:
    """Forward scores of all prefixes seen so far.

    A node is (children, score, tokens): the best score of its prefix and the number of
    tokens that reach it. A character that no piece covers costs ``unknown`` and counts as
    its UTF-8 bytes. Of equal scores the fewer tokens win.
    """

    def __init__(self, pieces: dict[str, float], most_nodes: int = MOST_NODES):
        self.ends: dict = {}  # the pieces as a trie from their last character to the first; "" holds a piece's score
        for piece, gain in pieces.items():
            at = self.ends
            for c in reversed(piece):
                at = at.setdefault(c, {})
            at[""] = gain
        self.unknown = min(pieces.values(), default=0.0) - 10.0
        self.most_nodes = most_nodes
        self.counts = _Counts(self)
        self.scored = 0
        self._clear()

    def _clear(self) -> None:
        self.root: list = [{}, 0.0, 0]
        self.nodes = 0
        self.counts.clear()

    def count(self, word: str) -> int:
        """Tokens of one pre-token; a known one is a look-up."""
        return self.counts[word.encode()]

    def _insert(self, text: str) -> int:
        way = [self.root]
        for end, last in enumerate(text):
            before = way[end]
            node = before[0].get(last)
            if node is None:
                score, tokens = before[1] + self.unknown, before[2] + len(last.encode())
                piece, start = self.ends.get(last), end
                while piece is not None:
                    gain = piece.get("")
                    if gain is not None:
                        at = way[start]
                        s, t = at[1] + gain, at[2] + 1
                        if s > score or (s == score and t < tokens):
                            score, tokens = s, t
                    start -= 1
                    piece = piece.get(text[start]) if start >= 0 else None
                node = before[0][last] = [{}, score, tokens]
                self.nodes += 1
                self.scored += 1
            way.append(node)
        return way[-1][2]


_tries: dict[str, Trie] = {}


def trie_for(path: str) -> Trie:
    if path not in _tries:
        _tries[path] = Trie(pieces_of(path))
    return _tries[path]


def _slices(text: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(text):
        end = start + SLICE
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        yield text[start:end]
        start = end


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words long, n_tokens long of every row; a null text has none, repeated and null ids stay.

    Each worker keeps one trie, of bounded size, over all the batches that it sees; texts
    are never cut.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = trie_for(vocabulary).counts.__getitem__
        for batch in batches:
            words_of, tokens_of = [], []
            for text in batch.column(1):
                words = tokens = 0
                for part in _slices(text.as_py() or b""):
                    found = part.split()  # at the six white space bytes of ASCII
                    words += len(found)
                    tokens += sum(map(known, found))
                words_of.append(words)
                tokens_of.append(tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words_of, pa.int64()), pa.array(tokens_of, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        collects = gc.isenabled()
        gc.disable()  # nodes form no cycles; searching a growing trie for them took more time than scoring it
        try:
            yield from counted(batches)
        finally:
            if collects:
                gc.enable()

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")
