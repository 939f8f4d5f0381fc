"""Files that arrive in a folder, as a stream: named by their content, taken once, parsed as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from plumbline.sources import dxf

#: What may be uploaded, and its largest size in bytes.
KINDS, MOST_BYTES = [".dxf", ".pdf"], 50 * 1024 * 1024


def upload_id(path: Column, content: Column) -> Column:
    """``up-``, twelve digits of the content's hash, up to 40 safe characters of the name, and its kind."""
    name = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    kind = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    safe = F.substring(F.regexp_replace(name, r"[^A-Za-z0-9_-]+", "-"), 1, 40)
    return F.concat(F.lit("up-"), F.substring(F.md5(content), 1, 12), F.lit("-"), safe, kind)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder and its folders; what they hold is read only if it is selected."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    return files.withColumn("kind", F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)))


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of upload_id, kind, size, content, arrived: one row per file of a known kind and size."""
    fits = _files(spark, folder).where(F.col("kind").isin(KINDS) & (F.col("length") <= MOST_BYTES))
    return fits.select(upload_id(F.col("path"), F.col("content")).alias("upload_id"), "kind", F.col("length").alias("size"), "content", F.col("modificationTime").alias("arrived"), F.element_at(F.split("path", "/"), -1).alias("name"))


def _fault(kinds: pd.Series, contents: pd.Series) -> pd.Series:
    def of(kind: str, content: bytes) -> str | None:
        if kind == ".pdf":
            return None if bytes(content[:1024]).find(b"%PDF-") >= 0 else "not a PDF file: it has no mark of one"
        try:
            dxf.parse(bytes(content).decode("utf-8", "replace"))
        except (dxf.NotADrawing, ValueError) as error:
            return str(error)
        return None

    return pd.Series([of(k, c) for k, c in zip(kinds, contents, strict=True)], dtype=object)


def examined(stream: DataFrame) -> DataFrame:
    """Arrivals with ``reason``: why one can't be read as what its name says, null if it can."""
    return stream.withColumn("reason", F.pandas_udf(_fault, "string")("kind", "content"))


def valid(stream: DataFrame) -> DataFrame:
    """Arrivals that can be read as what their name says; ``refused`` has the others."""
    return examined(stream).where("reason IS NULL").drop("reason")


def refused(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of name, kind, size, arrived, reason: one row per file that is not taken, and why.

    Files of other kinds or too large a size are told by their names and sizes, without being
    opened; the others by what they hold. Empty files never arrive, as Spark lists none.
    """
    closed = _files(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "kind", F.col("length").alias("size"), F.col("modificationTime").alias("arrived"))
    why = F.when(~F.col("kind").isin(KINDS), F.concat(F.lit("not of the kinds "), F.lit(", ".join(KINDS)))).when(F.col("size") > MOST_BYTES, F.lit(f"larger than {MOST_BYTES} bytes"))
    outside = closed.withColumn("reason", why).where("reason IS NOT NULL")
    return outside.unionByName(examined(arrivals(spark, folder)).where("reason IS NOT NULL").select(*outside.columns))


class _Attempts(StatefulProcessor):
    """How often a file of one name has been refused, and why the last time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N803
        held = self.count.get() if self.count.exists() else None
        n = held[0] if held else 0
        for row in sorted(rows, key=lambda r: (r["arrived"], r["size"])):
            n += 1
            yield Row(name=key[0], attempt=n, size=row["size"], arrived=row["arrived"], reason=row["reason"])
        self.count.update((n,))

    def close(self) -> None:
        pass


def quarantine(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Write what is refused as Parquet: name, attempt, size, arrived, reason; takes what there is and ends.

    ``attempt`` counts the files of a name, over all runs with this checkpoint. The state is
    a number for each name, in the RocksDB store, which the session's
    ``spark.sql.streaming.stateStore.providerClass`` must name.
    """
    told = stream.groupBy("name").transformWithState(_Attempts(), "name string, attempt long, size long, arrived timestamp, reason string", "Append", "none")
    return told.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def land(stream: DataFrame, table: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Write arrivals as Parquet, each content once within ``late``; takes what there is and ends."""
    once = stream.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["upload_id"])
    return once.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def entities(stream: DataFrame) -> DataFrame:
    """The entity table of arriving drawings, appended as they come; ``drawing_id`` is the upload's."""
    named = stream.where("kind = '.dxf'").select(F.col("upload_id").alias("drawing_id"), "content")
    return dxf.entities(named.mapInArrow(dxf._parse_all(False), dxf.PARSED))


def counts_by_window(stream: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """start, kind, n, bytes of arrivals by window of time; late ones up to ``late`` still count."""
    each = stream.withWatermark("arrived", late).groupBy(F.window("arrived", width).alias("w"), "kind")
    return each.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).select(F.col("w.start").alias("start"), "kind", "n", "bytes")
