"""Deterministic sharded WARC archives.

Records are range-sorted by id. Shards are id ranges of about equal payload bytes,
computed exactly from a histogram, so that they depend on the data alone. A task writes
whole shards and rolls to a new file by compressed size; each record is its own gzip
member with headers and digests made afresh from its payload. A file is written under a
temporary name and renamed when complete: a task that runs again writes the same bytes
under the same name. The manifest is written last, readers open only what it lists, and
what lost tasks left under temporary names is then deleted.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.staging import stage

#: Bounds of a shard's payload bytes; between them a 64th of the whole.
LEAST_SHARD, MOST_SHARD, SHARDS = 1 << 20, 512 << 20, 64
#: Compressed bytes at which a file is closed.
ROLL_BYTES = 256 << 20
#: Cells of the id histogram that one pass collects to the driver.
CELLS = 1 << 14
#: Tasks that read archives; each takes its share of the files.
MOST_TASKS = 20_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc-record")
MANIFEST = "file string, shard int, records long, bytes long, first_id string, last_id string, sha1 string"
RECORDS = "record_key string, url string, payload_bytes long, payload_digest string, record_type string, refers_key string, payload binary"


def digest32(data: bytes) -> str:
    """The upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member; the header's order is fixed and no clock is read."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha1:{digest32(block)}", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + pack.flush()


def _record_id(key: str, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{key}/{digest}/{copy}')}>"


def _record(key: str | None, url: str | None, payload: bytes, copy: int, refers_to: str | None, revisit: bool) -> bytes:
    digest, name = digest32(payload), "null" if key is None else key
    target = quote(url, safe="%/:=&?~#+!$,;'@()*[]|") if url else f"urn:record:{name}"
    headers = [("WARC-Record-ID", _record_id(name, digest, copy)), ("WARC-Date", DATE), ("WARC-Target-URI", target)]
    if key is not None:
        headers.append(("X-Record-Key", key))
    headers += [("X-Payload-Length", str(len(payload))), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id("null" if refers_to is None else refers_to, digest, 0))]
        if refers_to is not None:
            headers.append(("X-Refers-To-Key", refers_to))
    headers.append(("Content-Type", "application/http; msgtype=response"))
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _member("revisit" if revisit else "response", headers, block if revisit else block + payload)


def _store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    path = re.sub(r"^s3[an]:", "s3:", path)
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def _publish(store, temp: str, name: str) -> None:
    """Give a whole file its name; where another run of the task was first, that one's equal file stays."""
    try:
        store.move(temp, name)
    except OSError:
        if store.get_file_info(name).is_file:
            store.delete_file(temp)
        else:
            raise


def _sweep(store, folder: str) -> None:
    """Delete what tasks that were lost have left under temporary names."""
    from pyarrow import fs

    for info in store.get_file_info(fs.FileSelector(folder)):
        if info.is_file and info.base_name.startswith("_temporary-"):
            store.delete_file(info.path)


class _Roller:
    """Files of one shard, each under a temporary name until it is whole."""

    def __init__(self, path: str, shard: int, roll_bytes: int):
        self.store, self.path = _store(path)
        self.shard, self.roll_bytes, self.seq, self.out = shard, roll_bytes, 0, None

    def add(self, key: str | None, member: bytes) -> Iterator[tuple]:
        if self.out is not None and self.size + len(member) > self.roll_bytes:
            yield self.close()
        if self.out is None:
            self.name = f"shard-{self.shard:07d}-{self.seq:05d}.warc.gz"
            self.temp = f"{self.path}/_temporary-{self.name}-{uuid.uuid4().hex}"
            self.out, self.sum = self.store.open_output_stream(self.temp), hashlib.sha1()
            self.size, self.records, self.first = 0, 0, key
            info = f"software: plumbline\r\nformat: WARC File Format 1.1\r\nfile: {self.name}\r\n".encode()
            self._put(_member("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, self.name)}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], info))
        self._put(member)
        self.records, self.last = self.records + 1, key

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.sum.update(member)
        self.size += len(member)

    def close(self) -> tuple:
        self.out.close()
        _publish(self.store, self.temp, f"{self.path}/{self.name}")
        self.out, self.seq = None, self.seq + 1
        return self.name, self.shard, self.records, self.size, self.first, self.last, self.sum.hexdigest()


def shard_bounds(sizes: DataFrame, shard_bytes: int) -> list[int]:
    """Lowest ids of all shards but the first, for ``sizes`` of (id long, n long).

    Ids are counted in cells of equal width; a cell of more than a shard's bytes is cut
    again. A pass collects at most ``CELLS`` rows, or some for each shard if those are more.
    """
    ends = sizes.agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum("n").alias("n")).first()
    if ends["lo"] is None:
        return []
    bounds: list[int] = []
    todo = [(ends["lo"], ends["hi"])]
    cells = max(CELLS, 4 * (ends["n"] // shard_bytes))
    filled = 0
    while todo:
        lo, hi = todo.pop()
        width = -(-(hi - lo + 1) // cells)
        cell = F.expr(f"(CAST(id AS DECIMAL(20, 0)) - CAST('{lo}' AS DECIMAL(20, 0))) div CAST('{width}' AS DECIMAL(20, 0))")
        found = sizes.where(F.col("id").between(lo, hi)).groupBy(cell.cast("long").alias("c")).agg(F.sum("n").alias("n")).collect()
        for c, n in sorted((r["c"], r["n"]) for r in found):
            if n > shard_bytes and width > 1:
                after = lo + (c + 1) * width
                todo += [(after, hi)] * (after <= hi) + [(lo + c * width, min(hi, after - 1))]
                break
            if filled and filled + n > shard_bytes:
                bounds.append(lo + c * width)
                filled = 0
            filled += n
    return bounds


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, shard_bytes: int | None = None, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write one record per row below ``path`` and return the manifest.

    The payload is the text in UTF-8 (null: empty). Of records with equal payloads of at
    least ``min_bytes`` bytes, that with the largest id is a response and the others
    revisit it. Null ids sort before all others. Of repeated rows with equal id and
    payload the first written counts as the larger. Null or odd urls get a stand-in or are
    percent-encoded. An empty table gives an empty manifest. Other columns are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha", F.unhex(F.sha1("payload")))
    meta = stage(rows.select("id", "sha", F.octet_length("payload").cast("long").alias("n")), "warc-meta")
    if shard_bytes is None:
        total = meta.agg(F.sum("n")).first()[0] or 0
        shard_bytes = min(max(total // SHARDS, LEAST_SHARD), MOST_SHARD)
    bounds = np.array(shard_bounds(meta.select("id", (F.col("n") + 512).alias("n")), shard_bytes), "i8")
    same = meta.where(F.col("n") >= min_bytes).groupBy("sha").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("copies")).where("copies > 1")

    @F.pandas_udf("int")
    def shard(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.fillna(np.iinfo("i8").min).astype("i8").to_numpy(), "right"))

    # what a record refers to travels as a row of its own ahead of the payload, so that payloads move only once
    notes = meta.join(same, "sha").select("id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "sha", F.lit(0).alias("kind"), "top")
    both = notes.union(rows.select("id", "url", "payload", "sha", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("top"))).withColumn("shard", shard("id"))
    store, folder = _store(path)
    store.create_dir(folder, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, noted, top, before, copy = None, None, None, None, 0
        made: list[tuple] = []
        for batch in batches:
            columns = [batch.column(n) for n in ("shard", "id", "url", "sha", "payload", "kind", "top")]
            for row in zip(*columns, strict=True):
                at, key, url, sha, payload, kind, to = (x.as_py() for x in row)
                if not kind:
                    noted, top = (key, sha), to
                    continue
                if roller is None or roller.shard != at:
                    if roller is not None:
                        made.append(roller.close())
                    roller = _Roller(path, at, roll_bytes)
                copy = copy + 1 if before == (key, sha) else 0
                before = (key, sha)
                revisit = noted == before and (key != top or copy > 0)
                name, to = (None if x is None else str(x) for x in (key, top if revisit else None))
                made += roller.add(name, _record(name, url, payload, copy, to, revisit))
        if roller is not None:
            made.append(roller.close())
        if made:
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["file", "shard", "records", "bytes", "first_id", "last_id", "sha1"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=names)

    dealt = both.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "sha", "kind", "url")
    dealt.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{path}/_manifest")
    _sweep(store, folder)
    return spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    rest = b""
    while rest or (rest := stream.read(1 << 20)):
        unpack, parts = zlib.decompressobj(31), []
        while True:
            parts.append(unpack.decompress(rest))
            rest = unpack.unused_data
            if unpack.eof:
                break
            rest = stream.read(1 << 20)
            if not rest:
                raise ValueError("the archive ends within a record")
        yield b"".join(parts)


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of all files that the manifest lists, their digests checked.

    Columns: record_key, url, payload_bytes, payload_digest, record_type, refers_key and,
    on demand, payload (null for revisits). A damaged record raises.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_key", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_key", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, folder = _store(path)
                out, held = [], 0
                with store.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for member in _members(stream):
                        head, _, rest = member.partition(b"\r\n\r\n")
                        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                        kind, block = fields["WARC-Type"], rest[: int(fields["Content-Length"])]
                        if fields["WARC-Block-Digest"] != f"sha1:{digest32(block)}":
                            raise ValueError(f"{name}: a block does not match its digest")
                        if kind == "warcinfo":
                            continue
                        digest, payload = fields["WARC-Payload-Digest"].removeprefix("sha1:"), None
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if digest32(payload) != digest or len(payload) != int(fields["X-Payload-Length"]):
                                raise ValueError(f"{name}: a payload does not match its digest")
                        out.append((fields.get("X-Record-Key"), fields["WARC-Target-URI"], int(fields["X-Payload-Length"]), digest, kind, fields.get("X-Refers-To-Key"), payload if with_payload else None))
                        held += len(payload or b"") if with_payload else 100
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    files = manifest.count()
    records = manifest.select("file").repartition(max(1, min(files, MOST_TASKS)), "file").mapInArrow(read, RECORDS)
    return records if with_payload else records.drop("payload")
