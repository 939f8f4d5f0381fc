"""Line dedup: lines that several documents share stay in one document only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.staging import stage

#: Characters that are stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def line_keys(lines: Column) -> Column:
    """Each line without blanks at its ends and with A-Z lower-cased; other letters stay as they are."""
    bare = F.transform(lines, lambda x: F.btrim(x, F.lit(BLANKS)))
    plain = lambda x: F.octet_length(x) == F.char_length(x)
    return F.transform(bare, lambda x: F.when(plain(x), F.lower(x)).otherwise(F.translate(x, string.ascii_uppercase, string.ascii_lowercase)))


def _digest(column: str) -> list[Column]:
    """128 bits of a text in two columns."""
    return [F.xxhash64(column).alias("k1"), F.xxhash64(F.lit(7), F.col(column)).alias("k2")]


def drop_shared_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 10, least_documents: int = 2) -> DataFrame:
    """The documents with ``text`` reduced, and ``n_lines`` (before) and ``n_dropped``; columns of these two names are replaced.

    Lines are exploded and their normalised keys hashed to 128 bits. Keys of at least
    ``least_length`` code points that at least ``least_documents`` rows hold lose their lines
    in all documents but that of the smallest ``key``. The lines left are joined by position.

    Only hashes and positions move to count and find lines; texts move once. Counts are
    combined before they move, so a common line is no hot group there; where lines meet
    their counts, a key in many documents is split by the adaptive skew join. A document is
    found again by its key and its text's hash, and positions are gathered as a set, so
    equal rows don't pile up.

    A null or empty text is one empty line. A null key is no smallest one; where all holders
    of a line have null keys, or one key, all of them keep it. A document that loses all
    lines has an empty text. An empty table gives an empty table.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    whole = F.coalesce(F.col(names[text]).cast("string"), F.lit(""))
    base = own.select("*", F.col(names[key]).alias("id"), F.xxhash64(whole).alias("t1"), F.xxhash64(F.lit(7), whole).alias("t2"), F.split(whole, "\n", -1).alias("lines"))
    long = lambda x: F.char_length(x) >= least_length
    held = base.select("id", F.explode(F.array_distinct(F.filter(line_keys(F.col("lines")), long))).alias("line")).select("id", *_digest("line"))
    counted = held.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("keeper")).where(F.col("n") >= least_documents)
    shared = stage(counted.select("k1", "k2", "keeper"), "shared-lines")
    each = base.select("id", "t1", "t2", F.posexplode(line_keys(F.col("lines"))).alias("at", "line")).where(long(F.col("line")))
    lost = each.select("id", "t1", "t2", "at", *_digest("line")).join(shared, ["k1", "k2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    gone = lost.groupBy(F.col("id").alias("g"), F.col("t1").alias("g1"), F.col("t2").alias("g2")).agg(F.collect_set("at").alias("gone"))
    joined = base.select(*[n for c, n in names.items() if c != text], "id", "t1", "t2", "lines").join(gone, (F.col("t1") == F.col("g1")) & (F.col("t2") == F.col("g2")) & F.col("id").eqNullSafe(F.col("g")), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")
    columns = [kept.alias(c) if c == text else F.col(n).alias(c) for c, n in names.items() if c not in ("n_lines", "n_dropped")]
    return joined.select(*columns, F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(left)).cast("long").alias("n_dropped"))
