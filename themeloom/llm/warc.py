"""WARC archives as a chunked record table: payloads travel as (record, chunk number) rows.

A payload above the chunk size becomes a record and continuation records (the format's own segmentation),
so no task holds a whole oversized record. Every chunk row carries the digest of the payload up to its end;
the last one has the payload's. Archives are written and read by Spark's text source with a record
delimiter, so they go to whatever store Spark can reach.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.llm.common import written

#: Every record begins with this line and ends with two empty ones.
VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
CHUNK = 1 << 16
_MARK = VERSION.encode()
_NAME = _MARK.rstrip()


def _cuts(payload: bytes, chunk: int):
    """Ends of the chunks of ``payload``: at most ``chunk`` bytes each, and none holds the version line, which would
    part a record in two for readers that split by it. As the record's end completes a version line, none ends
    with its text either."""
    at, n = 0, len(payload)
    while True:
        end = min(n, at + chunk)
        mark = payload.find(_MARK, at, end)
        if mark >= 0:
            end = mark + len(_MARK) // 2
        elif payload.find(_NAME, max(at, end - len(_NAME)), end) >= 0:
            end -= len(_NAME) // 2
        yield at, end
        if end >= n:
            return
        at = end


def chunks(records: DataFrame, key: str, payload: str, chunk: int = CHUNK, with_body: bool = True, carried: str | None = None) -> DataFrame:
    """(key, carried, chunk_no, last, upto, digest, payload_bytes, payload_digest, body): the chunks of each ``payload``
    (string in UTF-8 or binary; null: empty).

    ``upto`` and ``digest`` are length and base32 SHA-1 of the payload up to the chunk's end. Without
    ``with_body`` only last chunks are returned, and their bodies are left out. ``carried`` is a text column
    to be repeated in each row.
    """
    kind = dict(records.dtypes)[key]
    per_batch = 256
    names = ("row", "chunk_no", "last", "upto", "digest", "payload_digest", "body")
    text = lambda digest: base64.b32encode(digest.digest()).decode()

    def run(batches):
        for batch in batches:
            rows = {name: [] for name in names}
            size = 0
            for place in range(batch.num_rows):
                value = batch.column("payload")[place]
                data = value.as_buffer() if value.is_valid else pa.py_buffer(b"")
                view, whole, digest = memoryview(data), data.to_pybytes() if data.size <= chunk else None, hashlib.sha1()
                full = text(hashlib.sha1(view))
                for number, (begin, end) in enumerate(_cuts(whole if whole is not None else _View(view), chunk)):
                    digest.update(view[begin:end])
                    last = end == data.size
                    if not (last or with_body):
                        continue
                    found = (place, number, last, end, text(digest), full, bytes(view[begin:end]) if with_body else b"")
                    for name, item in zip(names, found):
                        rows[name].append(item)
                    size += end - begin
                    if size >= per_batch * chunk:
                        yield _batch(batch, rows)
                        rows, size = {name: [] for name in names}, 0
            yield _batch(batch, rows)

    extra = F.col(carried).cast("string") if carried else F.lit(None).cast("string")
    data = records.select(F.col(key).alias("key"), extra.alias("carried"), F.col(payload).cast("binary").alias("payload"))
    return data.mapInArrow(
        run, f"key {kind}, carried string, chunk_no int, last boolean, upto long, digest string, payload_bytes long, payload_digest string, body binary"
    )


class _View:
    """``find`` over a buffer in pieces, so that a large payload isn't copied to be searched."""

    def __init__(self, view: memoryview):
        self.view = view

    def __len__(self) -> int:
        return len(self.view)

    def find(self, mark: bytes, begin: int, end: int) -> int:
        found = bytes(self.view[begin:end]).find(mark)
        return found + begin if found >= 0 else found


def _batch(batch: pa.RecordBatch, rows: dict[str, list]) -> pa.RecordBatch:
    at = pa.array(rows["row"], pa.int64())
    sizes = pc.fill_null(pc.binary_length(batch.column("payload")), 0).cast(pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            batch.column("key").take(at),
            batch.column("carried").take(at),
            pa.array(rows["chunk_no"], pa.int32()),
            pa.array(rows["last"], pa.bool_()),
            pa.array(rows["upto"], pa.int64()),
            pa.array(rows["digest"], pa.string()),
            sizes.take(at),
            pa.array(rows["payload_digest"], pa.string()),
            pa.array(rows["body"], pa.binary()),
        ],
        names=["key", "carried", "chunk_no", "last", "upto", "digest", "payload_bytes", "payload_digest", "body"],
    )


def revisits(records: DataFrame, key: str, payload: str, url: str, least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """(key, url, payload_bytes, payload_digest, copy, refers_to) for each record.

    Of equal payloads of ``least`` bytes or more the one with the smallest key has a null ``refers_to``,
    the others that key; null keys come last. Records equal in key and payload are numbered by ``copy``, in
    order of their URLs; the first of them goes first.
    """
    columns = ["key", F.col("carried").alias("url"), "payload_bytes", "payload_digest"]
    whole = written(chunks(records, key, payload, chunk, with_body=False, carried=url).select(*columns))
    first = whole.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.filter("n > 1").withColumn("known", F.lit(True)).drop("n")
    same = Window.partitionBy("key", "payload_digest", "payload_bytes").orderBy("url")
    counted = whole.groupBy("key", "url", "payload_bytes", "payload_digest").agg(F.count(F.lit(1)).alias("n"))
    copies = counted.withColumn("upto", F.sum("n").over(same))
    copies = copies.withColumn("copy", F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1))).drop("n", "upto")
    other = F.col("known") & ~(F.col("key").eqNullSafe(F.col("first")) & (F.col("copy") == 0))
    joined = copies.join(first, ["payload_digest", "payload_bytes"], "left").withColumn("other", F.coalesce(other, F.lit(False)))
    return joined.select("key", "url", "payload_bytes", "payload_digest", "copy", "other", F.when(F.col("other"), F.col("first")).alias("refers_to"))


def _urn(key: Column, digest: Column, copy: Column) -> Column:
    """A record's id: its key, payload digest and number among records equal in both."""
    return F.concat(F.lit("<urn:record:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), digest, F.lit(":"), copy.cast("string"), F.lit(">"))


def _text_key(key: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


def _safe(value: Column) -> Column:
    """A header value without line ends: controls and spaces as in percent encoding."""
    for raw, shown in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        value = F.replace(value, F.lit(raw), F.lit(shown))
    return value


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, chunk: int = CHUNK, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages`` into gzipped archives in the folder ``path``.

    A payload seen before (see ``revisits``) becomes a revisit record without a block; its headers name the
    response and hold length and digest of the full payload. Rows that share a key are records of their own;
    a null key is written as an empty one.
    """
    kinds = written(revisits(pages, key, payload, url, least, chunk).withColumn("_key", _text_key("key")))
    bodies = chunks(pages, key, payload, chunk).drop("digest", "upto", "carried").withColumn("_key", _text_key("key"))
    responses = kinds.filter("NOT other").drop("key", "other", "refers_to")
    same = ["_key", "payload_digest", "payload_bytes"]
    # rows equal in key and payload have equal bodies: one of them serves each copy
    records = bodies.join(responses, same).dropDuplicates([*same, "copy", "chunk_no"])
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    segmented = (F.col("chunk_no") > 0) | ~F.col("last")
    first = F.col("chunk_no") == 0
    origin = _urn(F.col("key"), F.col("payload_digest"), F.col("copy"))
    own = F.concat(origin, F.when(first, "").otherwise(F.concat(F.lit(";"), F.col("chunk_no").cast("string"))))
    none = F.lit("")
    head = F.concat(
        F.lit(VERSION),
        line("WARC-Type", F.when(first, "response").otherwise("continuation")),
        line("WARC-Record-ID", own),
        line("WARC-Date", F.lit(date)),
        F.when(first & F.col("url").isNotNull(), line("WARC-Target-URI", _safe(F.col("url")))).otherwise(none),
        F.when(segmented, line("WARC-Segment-Number", (F.col("chunk_no") + 1).cast("string"))).otherwise(none),
        F.when(~first, line("WARC-Segment-Origin-ID", origin)).otherwise(none),
        F.when(segmented & F.col("last"), line("WARC-Segment-Total-Length", F.col("payload_bytes").cast("string"))).otherwise(none),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("Content-Length", F.octet_length("body").cast("string")),
        F.lit("\r\n"),
    )
    full = records.select(F.concat(head.cast("binary"), F.col("body")).alias("record"))
    bare = kinds.filter("other").select(
        F.concat(
            F.lit(VERSION),
            line("WARC-Type", F.lit("revisit")),
            line("WARC-Record-ID", origin),
            line("WARC-Date", F.lit(date)),
            F.when(F.col("url").isNotNull(), line("WARC-Target-URI", _safe(F.col("url")))).otherwise(none),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", _urn(F.col("refers_to"), F.col("payload_digest"), F.lit(0))),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
            line("X-Payload-Length", F.col("payload_bytes").cast("string")),
            line("Content-Length", F.lit("0")),
            F.lit("\r\n"),
        ).cast("binary").alias("record")
    )
    # bytes pass through the text writer unchanged; what follows each record is its end
    full.unionByName(bare).select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, record_type, record_id, target_uri, refers_to, segment, total, payload_digest, payload_bytes, block): the
    records of archives in ``path``. ``record`` is the id of the whole record, ``record_id`` the key in it.

    Records are found by the version line, so a block must not hold one (``write_archives`` sees to that);
    a block whose length differs from its header fails the job. Repeated headers: the first counts.
    """
    raw = spark.read.option("lineSep", VERSION).text(path).filter("value <> ''")
    data = F.col("value").cast("binary")
    place = F.instr("value", END)
    # instr counts characters; header lines are read up to it, the block starts after as many bytes
    head = F.substring_index("value", END, 1)
    begin = F.octet_length(head) + len(END)

    def header(name: str) -> Column:
        found = F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
        return F.when(found != "", found)

    length = header("Content-Length").cast("long")
    size = F.octet_length(data) - begin - len(END)
    wrong = F.concat(F.lit("not a whole record: "), F.coalesce(header("WARC-Record-ID"), F.lit("without an id")))
    checked = F.when((place > 0) & (length == size), F.lit(True)).otherwise(F.raise_error(wrong).cast("boolean"))
    block = F.substr(data, begin + 1, length.cast("int"))
    restored = header("WARC-Target-URI")
    for shown, plain in (("%0A", "\n"), ("%0D", "\r"), ("%25", "%")):
        restored = F.replace(restored, F.lit(shown), F.lit(plain))
    inner = lambda value: F.regexp_extract(value, r"(?s)^<urn:record:(.*):[A-Z2-7]*:[0-9]+>$", 1)
    origin = F.coalesce(header("WARC-Segment-Origin-ID"), header("WARC-Record-ID"))
    return raw.filter(checked).select(
        origin.alias("record"),
        header("WARC-Type").alias("record_type"),
        inner(origin).alias("record_id"),
        restored.alias("target_uri"),
        inner(header("WARC-Refers-To")).alias("refers_to"),
        F.coalesce(header("WARC-Segment-Number").cast("int"), F.lit(0)).alias("segment"),
        header("WARC-Segment-Total-Length").cast("long").alias("total"),
        F.regexp_replace(header("WARC-Payload-Digest"), "(?i)^sha1:", "").alias("payload_digest"),
        header("X-Payload-Length").cast("long").alias("payload_bytes"),
        block.alias("block"),
    )


def verified(records: DataFrame) -> DataFrame:
    """(record_id, record_type, refers_to, payload_bytes, payload_digest) of whole records, digests computed anew from blocks.

    Records in one piece are digested where they are read. Segments are brought together in order and
    digested one after another; a segment that is missing or a digest that differs fails the job.
    """
    columns = ["record", "record_id", "record_type", "refers_to", "segment", "total", "payload_digest", "payload_bytes", "block"]
    schema = "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string"
    single = records.filter("segment = 0").select(*columns).mapInArrow(_digested, schema)
    parts = records.filter("segment > 0").select(*columns).repartition("record").sortWithinPartitions("record", "segment")
    return single.unionByName(parts.mapInArrow(_digested, schema))


def _digested(batches):
    now, digest, size, segment, head = None, None, 0, 0, None
    for batch in batches:
        out = {name: [] for name in ("record_id", "record_type", "refers_to", "payload_bytes", "payload_digest")}
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names if name != "block"}
        for place in range(batch.num_rows):
            row = {name: values[place] for name, values in columns.items()}
            if row["record_type"] == "revisit":
                size, found, head = row["payload_bytes"], row["payload_digest"], row
            else:
                if row["segment"] <= 1:
                    now, digest, size, segment, head = row["record"], hashlib.sha1(), 0, row["segment"], row
                elif row["record"] != now or row["segment"] != segment + 1:
                    raise ValueError(f"a segment is missing before {row['record_id']} {row['segment']}")
                else:
                    segment += 1
                block = batch.column("block")[place].as_buffer()
                digest.update(block)
                size += block.size
                if row["segment"] > 0 and row["total"] is None:
                    continue
                found = base64.b32encode(digest.digest()).decode()
                if found != row["payload_digest"] or row["total"] not in (None, size):
                    raise ValueError(f"the payload of {row['record_id']} differs from its digest")
            out["record_id"].append(head["record_id"])
            out["record_type"].append(head["record_type"])
            out["refers_to"].append(head["refers_to"])
            out["payload_bytes"].append(size)
            out["payload_digest"].append(found)
        yield pa.RecordBatch.from_pydict(
            out, schema=pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
        )
