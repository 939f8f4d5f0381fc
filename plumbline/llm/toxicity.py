"""Toxicity by non-negative positive-unlabelled learning.

The classifier is linear in the presence of words and of beginnings of words. It is trained with numpy on confirmed
toxic texts (positives) and a sample of texts whose labels are not looked at. The risk of
the negatives is what the unlabelled texts cost as negatives less the share that the
positives among them cost, weighted by the class prior; that difference is kept from
falling below zero, where a fit would only memorise the positives.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.memory import release
from plumbline.staging import stage

THRESHOLD = 0.7
#: Bounds of the training samples, in rows; rows are chosen by the hash of their id.
MOST_POSITIVE, MOST_UNLABELLED = 8_000, 16_000
#: Confirmed toxic texts that hold a word which the classifier may know, and the prior where no label tells it.
SUPPORT, PRIOR = 3, 0.1
#: Standard deviations that a word's shares in the two samples lie apart at least.
GAP = 5.0
#: Characters of the beginnings of words that count as features too.
STEM = 5
_WORD = re.compile(r"\w+")


def words_in(text: str | None) -> set[str]:
    """The distinct words of a whole text, in lower case, and the beginnings that several of them share, which stand for inflected forms."""
    words = set(_WORD.findall((text or "").lower()))
    stems = Counter(w[:STEM] for w in words if len(w) > STEM)
    return words.union(f"{x}*{min(n, 4)}" for x, n in stems.items() if n > 1)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels may not be learnt: crc32 of the id as text, modulo 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class Model:
    """``score`` = sigmoid of the bias plus the weights of the known words in a text."""

    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        known = words_in(text) & self.weights.keys()
        return float(1.0 / (1.0 + np.exp(-(self.bias + sum(self.weights[w] for w in sorted(known))))))

    def column(self, text: Column) -> Column:
        """The score as a column; a null text scores as an empty one."""
        weights, bias = self.weights, self.bias

        @F.pandas_udf("double")
        def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            names = weights.keys()
            for batch in texts:
                margins = [bias + sum(weights[w] for w in sorted(words_in(t) & names)) for t in batch]
                yield pd.Series(1.0 / (1.0 + np.exp(-np.array(margins, "f8"))))
            release()

        return score(text)


def nnpu(x: np.ndarray, positive: np.ndarray, prior: float, **how: float) -> np.ndarray:
    """``fit`` on rows by features, where ``positive`` marks confirmed positives and the others are unlabelled."""
    return fit([np.flatnonzero(r) for r in x], x.shape[1], positive, prior, **how)


def fit(spots: list[np.ndarray], features: int, positive: np.ndarray, prior: float, steps: int = 800, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights (bias last) that minimise the non-negative risk with the logistic loss, by Adam on all rows.

    ``spots`` are the features that each row has. Where the risk of the negatives is below
    zero, the step climbs it back.
    """

    def side(rows: np.ndarray):
        held = [spots[i] for i in rows]
        at, columns = np.repeat(np.arange(len(rows)), [len(s) for s in held]), np.concatenate([*held, np.zeros(0, "i8")]).astype("i8")
        margins = lambda w: np.bincount(at, w[columns], len(rows)) + w[-1]
        back = lambda v: np.append(np.bincount(columns, v[at], features), v.sum()) / len(rows)
        return margins, back

    (p_margins, p_back), (u_margins, u_back) = side(np.flatnonzero(positive)), side(np.flatnonzero(~positive))
    w = np.zeros(features + 1)
    w[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    softplus = lambda z: np.logaddexp(0, z)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for step in range(1, steps + 1):
        gp, gu = p_margins(w), u_margins(w)
        negative = softplus(gu).mean() - prior * softplus(gp).mean()
        slope = u_back(sigmoid(gu)) - prior * p_back(sigmoid(gp))
        gradient = slope - prior * p_back(sigmoid(-gp)) if negative >= 0 else -slope
        gradient = gradient + decay * np.append(w[:-1], 0)
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        w = w - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [sorted(words_in(t)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["positive", "words"])
        del words
    release()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, seed: int = 11) -> Model:
    """Fit on bounded samples of the rows that are not held out.

    The unlabelled texts are drawn from all rows, confirmed ones among them, as the prior is
    that of all rows. Words count that ``support`` positives hold, whatever the size of the
    sample, and whose shares in the two samples lie apart; there is no bound on their number
    but that of the samples' words. The class prior is the share of toxic rows among the labelled ones.
    Without a positive, or without unlabelled texts, every text scores the prior.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = stage(known.where(~held_out()), "tox-labels")
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k")).first()
    total, toxic = counts["n"], counts["k"] or 0
    prior = min(max((toxic + 1) / (total + 10), 0.01), 0.9) if total else PRIOR
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = slim.count()
    lot = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.where(F.col("toxic") == 1).where(lot < min(1.0, most_positive / max(toxic, 1))).select("doc_id", F.lit(True).alias("positive"))
    drawn = slim.where(~held_out()).join(chosen, "doc_id", "left")
    roles = F.filter(F.array("positive", F.when(F.coalesce(lot, F.lit(0.0)) < min(1.0, 1.5 * most_unlabelled / max(rows, 1)), F.lit(False))), lambda r: r.isNotNull())
    drawn = drawn.where(F.size(roles) > 0).select(F.explode(roles).alias("positive"), "text")
    sample = stage(drawn.select("positive", "text").mapInArrow(_distinct_words, "positive boolean, words array<string>"), "tox-sample")
    size = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_u = size.get(True, 0), size.get(False, 0)
    if not n_p or not n_u:
        return Model({}, float(np.log(prior / (1 - prior))))
    seen = sample.select("positive", F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("positive").cast("long")).alias("p"))
    share = F.col("n") / F.lit(float(n_p + n_u))
    gap = (F.col("p") / F.lit(float(n_p)) - (F.col("n") - F.col("p")) / F.lit(float(n_u))) / F.sqrt(share * (1 - share) * F.lit(1 / n_p + 1 / n_u))
    often = (F.col("p") >= support) & (F.col("n") < n_p + n_u)
    names = [r["w"] for r in seen.where(often & (F.abs(gap) >= GAP)).orderBy("w").select("w").collect()]
    if not names:
        return Model({}, float(np.log(prior / (1 - prior))))
    place = {w: i for i, w in enumerate(names)}

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[place[w] for w in ws if w in place] for ws in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["positive", "spots"])

    data = sample.mapInArrow(spots, "positive boolean, spots array<int>").collect()
    data.sort(key=lambda r: (r["positive"], r["spots"]))  # so that sums do not depend on the order of partitions
    w = fit([np.array(r["spots"], "i8") for r in data], len(names), np.array([r["positive"] for r in data]), prior)
    return Model({name: float(v) for name, v in zip(names, w, strict=False)}, float(w[-1]))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out boolean, score double, predicted int of every row; repeated and null ids stay, an empty table stays empty."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = slim.select("doc_id", held_out().alias("held_out"), model.column(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns kept."""
    return docs.where(model.column(F.col(text_col).cast("string")) < threshold)
