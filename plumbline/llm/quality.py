"""Quality rules as a short-circuit cascade.

Every rule is a Column that is true where it rejects. Its cost, beyond that of reading the
texts, and its rejections are measured on a sample of whole texts, and rules then run by
rejections per cost, so that cheap and selective rules spare the dear ones. The order
never changes which documents are kept.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.staging import stage

WINDOW = 5
#: Rows, about, of the sample on which rules are measured, and how often each is timed.
SAMPLE_ROWS, TIMES = 2000, 3

#: White space and the characters that count as symbols.
_SPACE = r"[\x20\x09-\x0D]+"
_NOT_SPACE = r"[^\x20\x09-\x0D]"
_SYMBOLS = "#*$%&|<>"


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The maximal runs of characters that are not white space."""
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines that hold a word and equal an earlier line."""
    lines = F.transform(F.array(F.filter(F.split(text, "\n"), lambda x: x.rlike(_NOT_SPACE))), lambda a: F.size(a) - F.size(F.array_distinct(a)))
    return lines[0].cast("long")


def window_hashes(words: Column, width: int = WINDOW) -> Column:
    """A 64-bit hash of every window of ``width`` words, in order.

    Two different windows of one text share a hash with a chance of some 1e-11 in a text
    of 20,000 words.
    """

    def of(hashes: Column) -> Column:
        spots = F.when(F.size(hashes) >= width, F.sequence(F.lit(0), F.size(hashes) - width)).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(width))))

    return F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), of)[0]


def covered_words(hashes: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more, from the windows' hashes.

    Sorting hashes with their places keeps this at n log n for any text; texts whose
    hashes are all distinct are spared the sort.
    """

    def repeated(pairs: Column) -> Column:
        return F.filter(pairs, lambda e, k: ((k > 0) & (F.get(pairs, k - 1)["h"] == e["h"])) | F.coalesce(F.get(pairs, k + 1)["h"] == e["h"], F.lit(False)))

    def covered(spots: Column) -> Column:
        start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("total"))
        step = lambda a, i: F.struct(i.alias("last"), (a["total"] + F.least(F.lit(width), i - a["last"])).alias("total"))
        return F.aggregate(spots, start, step, lambda a: a["total"])

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found = F.transform(F.array(pairs), repeated)[0]
    total = covered(F.sort_array(F.transform(found, lambda e: e["i"])))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(total).cast("long")


def n_repeat_words(text: Column, width: int = WINDOW) -> Column:
    return F.transform(F.array(window_hashes(words_of(text), width)), lambda h: covered_words(h, width))[0]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long) and base_failed of whole texts.

    A null text has no words. Every row yields one row; repeated and null ids stay.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    split = text.select(
        "doc_id", words_of(F.col("text")).alias("words"), word_chars(F.col("text")).alias("word_chars"), n_symbols(F.col("text")).alias("n_symbols"), n_dup_lines(F.col("text")).alias("n_dup_lines")
    )
    hashed = split.select("doc_id", F.size("words").cast("long").alias("n_words"), window_hashes(F.col("words")).alias("hashes"), "word_chars", "n_symbols", "n_dup_lines")
    counted = hashed.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered_words(F.col("hashes")).alias("n_repeat_words"))
    return counted.withColumn("base_failed", base_failed())


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def rules_on_measures() -> list[Rule]:
    """The production rules over the columns of ``measure``."""
    words = F.col("n_words")
    return [
        Rule("few_words", words < 10),
        Rule("repeated_windows", 100 * F.col("n_repeat_words") > 20 * words),
        Rule("symbols", 10 * F.col("n_symbols") > words),
        Rule("word_length", (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 12 * words)),
        Rule("repeated_lines", 20 * F.col("n_dup_lines") > words),
    ]


def rules_on_text(column: str = "text") -> list[Rule]:
    """The same rules over raw texts: nothing is measured that an earlier rule made needless."""
    text = text_of(column)
    words = F.regexp_count(text, F.lit(_NOT_SPACE + "+"))
    return [
        Rule("few_words", words < 10),
        Rule("repeated_windows", 100 * n_repeat_words(text) > 20 * words),
        Rule("symbols", 10 * n_symbols(text) > words),
        Rule("word_length", (word_chars(text) < 2 * words) | (word_chars(text) > 12 * words)),
        Rule("repeated_lines", 20 * n_dup_lines(text) > words),
    ]


@dataclass(frozen=True)
class Profile:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 7) -> DataFrame:
    """Some ``rows`` rows drawn from all partitions, all rows of a smaller table; drawn before anything is computed on them."""
    total = docs.count()
    return stage(docs.sample(fraction=min(1.0, rows / total), seed=seed) if total > rows else docs, "quality-sample")


def _seconds(sample: DataFrame, value: Column, times: int) -> tuple[float, int]:
    """The least time of a sum over the sample, and the sum."""
    best, total = float("inf"), 0
    for _ in range(times):
        began = time.perf_counter()
        total = sample.agg(F.sum(value)).first()[0] or 0
        best = min(best, time.perf_counter() - began)
    return best, total


def profile_rules(sample: DataFrame, rules: list[Rule], text_col: str = "text", times: int = TIMES) -> list[Profile]:
    """Seconds that each rule adds to reading the texts of a sample, and the share of its rows that it rejects.

    An empty sample gives equal figures, which keep the given order.
    """
    total = sample.count()
    if not total:
        return [Profile(rule, 1.0, 0.0) for rule in rules]
    reading, _ = _seconds(sample, F.octet_length(text_of(text_col)).cast("long"), times)
    out = []
    for rule in rules:
        seconds, hits = _seconds(sample, F.coalesce(rule.rejects, F.lit(False)).cast("long"), times)
        out.append(Profile(rule, max(seconds - reading, 0.001), hits / total))
    return out


def by_worth(profiles: list[Profile]) -> list[Rule]:
    """Rules by rejections per second; those that reject nothing by their cost; ties keep their order."""
    return [p.rule for p in sorted(profiles, key=lambda p: (-p.worth, p.seconds))]


def verdict(rules: list[Rule]) -> Column:
    """True where no rule rejects. A rule is evaluated only where all before it let the row pass."""
    kept = F.lit(True)
    for rule in reversed(rules):
        kept = F.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(False)).otherwise(kept)
    return kept


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``measure`` with kept: false where base_failed, else the cascade's verdict.

    The order is that of the rules on texts, by what each costs there. As all measures are
    asked for, the cascade itself runs over them, where ``keep_good`` measures only what
    the rules before left open.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = [r.name for r in by_worth(profile_rules(sample_of(slim), rules_on_text()))]
    measured = {r.name: r for r in rules_on_measures()}
    return measure(slim).withColumn("kept", ~F.col("base_failed") & verdict([measured[name] for name in order]))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass every rule, with all their columns."""
    rules = by_worth(profile_rules(sample_of(docs.select(text_col)), rules_on_text(text_col), text_col))
    return docs.where(verdict(rules))
