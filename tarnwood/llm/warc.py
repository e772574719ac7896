"""WARC archives: a writer over a table of pages, and a reader that salvages damaged files."""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwood.llm.shared import in_small_batches, written

END = b"\r\n\r\n"
_LINE = re.compile(rb"WARC/\d\.\d\r?\n")
_VERSION = re.compile(rb"WARC/\d\.\d\r?\n|\x1f\x8b\x08")
_CHUNK, _STEP, _HELD = 1 << 16, 1 << 20, 8 << 20
#: A gzip member of nothing; it ends each record's own member.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
_LONGEST_LINE = len(b"WARC/1.1\r\n")
_PAGE = "urn:tarnwood:page:"

RECORDS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("reason", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


class Damaged(ValueError):
    """A member or record that fails a check."""


class Short(Damaged):
    """Data that ends before a check; ``need`` bytes would be enough to go on."""

    def __init__(self, why: str, need: int):
        super().__init__(why)
        self.need = need


def _record(data: bytes | bytearray, at: int) -> tuple[dict, bytes, int]:
    """Headers, payload and end of the record at ``at``; every check it fails raises Damaged."""
    version = _LINE.match(data, at)
    if not version:
        if len(data) - at < _LONGEST_LINE and data[at : at + 5] == b"WARC/"[: len(data) - at]:
            raise Short("no header", at + _LONGEST_LINE)
        raise Damaged("no header")
    headers, begin = {}, version.end()
    while True:
        stop = data.find(b"\n", begin)
        if stop < 0:
            raise Short("no header", len(data) + 1)
        line = data[begin:stop].strip()
        begin = stop + 1
        if not line:
            break
        name, colon, value = bytes(line).partition(b":")
        if not colon:
            raise Damaged("malformed header line")
        headers[name.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damaged("no content length")
    end = begin + int(length)
    if data[end : end + 4] != END:
        why = "record does not end where its length says"
        raise Short(why, end + 4) if len(data) < end + 4 else Damaged(why)
    payload = bytes(data[begin:end])
    named = headers.get("warc-payload-digest", "")
    if named.startswith("sha256:") and headers.get("warc-type") != "revisit" and hashlib.sha256(payload).hexdigest() != named[7:]:
        raise Damaged("payload digest differs")
    return headers, payload, end + 4


class _Inflating:
    """The gzip member at ``at``, inflated a step at a time; ``end`` and ``fault`` are known once it ended."""

    def __init__(self, data: bytes, at: int):
        self.view, self.end, self.fault, self.ended = memoryview(data), at, "", False
        self.reader, self.tail = zlib.decompressobj(31), b""

    def more(self) -> bytes:
        """At most ``_STEP`` bytes more; none after the member's end, where it is cut or at a bad byte."""
        while not self.ended:
            given = self.tail or self.view[self.end : self.end + _CHUNK]
            if not len(given):
                self.ended, self.fault = True, "gzip member is cut short"
                break
            begin = self.end - len(self.tail)
            before = self.reader.copy()
            try:
                out = self.reader.decompress(given, _STEP)
            except zlib.error:
                return self._to_the_bad_byte(before, given, begin)
            self.end, self.tail = begin + len(given), self.reader.unconsumed_tail
            if self.reader.eof:
                self.ended, self.end = True, self.end - len(self.reader.unused_data)
            if out:
                return out
        return b""

    def _to_the_bad_byte(self, reader, given, begin: int) -> bytes:
        """What a failed call would have made, got byte by byte."""
        out = []
        self.ended, self.tail = True, b""
        for k in range(len(given)):
            try:
                out.append(reader.decompress(given[k : k + 1]))
            except zlib.error as e:
                self.end, self.fault = begin + k, f"gzip: {e}"
                break
        return b"".join(out)


class _Member:
    """Records that pass in the gzip member at ``at``, the ``end`` of its bytes and its first ``fault``.

    Records are read once; of a member that inflates to more than some megabytes they are not kept
    but read again, so the memory it takes is that of its largest record, however far it inflates.
    """

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.fault = data, at, ""
        source, found, held, sure, n = _Inflating(data, at), [], 0, 0, 0
        for headers, payload in self._read(source):
            n += 1
            sure += self._digested(headers)
            held += len(payload) + 200
            if held <= _HELD:
                found.append((headers, payload))
        self.end, self.fault = source.end, source.fault or self.fault
        # A wrong checksum may mean any byte; then a record without a digest of its own is not sure.
        self.unsure = "data check" in source.fault
        self.n = sure if self.unsure else n
        self.found = found if held <= _HELD else None

    @staticmethod
    def _digested(headers: dict) -> bool:
        return headers.get("warc-payload-digest", "").startswith("sha256:")

    def _read(self, source: _Inflating) -> Iterator[tuple[dict, bytes]]:
        plain, pos, need = bytearray(), 0, 1
        while True:
            while len(plain) < need and not source.ended:
                plain += source.more()
            if pos >= len(plain):
                if source.ended:
                    return
                need = pos + 1
                continue
            try:
                headers, payload, pos = _record(plain, pos)
                yield headers, payload
            except Damaged as e:
                if isinstance(e, Short) and not source.ended:
                    del plain[:pos]
                    need, pos = max(e.need - pos, len(plain) + 1), 0
                    continue
                self.fault = self.fault or str(e)
                following = _LINE.search(plain, pos + 1)
                pos = following.start() if following else max(pos + 1, len(plain) if source.ended else len(plain) - _LONGEST_LINE)
            if pos > _STEP:
                del plain[:pos]
                pos = 0
            need = pos + 1

    def __len__(self) -> int:
        return self.n

    def __iter__(self) -> Iterator[tuple[dict, bytes]]:
        rows = self._read(_Inflating(self.data, self.at)) if self.found is None else self.found
        return (row for row in rows if not self.unsure or self._digested(row[0]))


def salvage(data: bytes) -> Iterator[tuple]:
    """("record", offset, length, headers, payload) and ("gap", offset, length, reason) in file order.

    After a failed check the search goes on behind the failed version line or gzip magic for the next
    one; bytes up to the next record that passes its checks are one gap. The records of a gzip member
    share its bytes; those of a damaged one the bytes read before the damage, and the rest is a gap,
    of length 0 where the damage is inside a member that inflates as a whole. Apart from members
    shared by their records, the rows cover the file without overlap.
    """
    at, gap, why = 0, None, ""
    broken: list[tuple[int, int, _Member, str]] = []

    def lost(stop: int) -> Iterator[tuple]:
        """Rows from ``gap`` to ``stop``: what damaged members gave, and gaps."""
        pos, reason = gap, why
        for k, (start, end, found, fault) in enumerate(broken):
            if pos < start:
                yield "gap", pos, start - pos, reason
            end = min(end, broken[k + 1][0] if k + 1 < len(broken) else stop)
            for headers, payload in found:
                yield "record", start, end - start, headers, payload
            pos, reason = end, fault
        if pos < stop or broken:
            yield "gap", pos, stop - pos, reason

    while at < len(data):
        try:
            if data.startswith(b"\x1f\x8b", at):
                found = _Member(data, at)
                end, fault = found.end, found.fault
                if fault and found and not fault.startswith("gzip"):
                    if gap is not None:
                        yield from lost(at)
                        gap, broken = None, []
                    for headers, payload in found:
                        yield "record", at, end - at, headers, payload
                    yield "gap", end, 0, fault
                    at = end
                    continue
                if fault:
                    if found:
                        broken.append((at, end, found, fault))
                    raise Damaged(fault)
            elif data.startswith(b"WARC/", at):
                headers, payload, end = _record(data, at)
                found = [(headers, payload)]
            else:
                raise Damaged("no version line or gzip member")
        except Damaged as e:
            if gap is None:
                gap, why = at, str(e)
            following = _VERSION.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap is not None:
            yield from lost(at)
            gap, broken = None, []
        for headers, payload in found:
            yield "record", at, end - at, headers, payload
        at = end
    if gap is not None:
        yield from lost(len(data))


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and quarantined byte gaps of all files below ``path``.

    One task holds one file at a time, so archives should be cut at some hundred megabytes, as is
    usual; what a member inflates to is held one record at a time. Files without a byte give no row. ``kind`` is record or gap; a gap has offset, length and the reason of the first failed
    check. With ``payloads`` false, payloads are checked and digested but not returned.
    """
    names = RECORDS.names

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows, held = [], 0
                for kind, offset, length, *rest in salvage(content.as_py()):
                    if kind == "gap":
                        rows.append((name.as_py(), kind, offset, length, rest[0], None, None, None, None, None))
                    else:
                        headers, payload = rest
                        rows.append((name.as_py(), kind, offset, length, None, headers.get("warc-type"), list(headers.items()), len(payload), hashlib.sha256(payload).hexdigest(), payload if payloads else None))
                        held += len(payload) if payloads else 0
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(parse, RECORDS)


def write_warc(pages: DataFrame, path: str, least_revisit: int = 100, records_per_file: int = 2000, compressed: bool = True) -> None:
    """One record per row of ``pages`` (page_id, url, html), payload the html in UTF-8.

    Rows with equal payloads of at least ``least_revisit`` bytes: the smallest page_id is written as
    response, the others as revisit records without payload. A null html is an empty payload, a null
    url gives no target header, rows with a null page_id are always responses, and repeated rows are
    written as often as they come. Other columns are ignored. With ``compressed`` each record is a
    gzip member of its own. The text writer ends each row with the record terminator, or with an empty
    gzip member behind it, so files go to any store that Spark writes to.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    hashed = rows.select("page_id", F.unhex(F.sha2("html", 256)).alias("digest"), F.octet_length("html").alias("size"))
    long = hashed.where(F.col("size") >= least_revisit).where("page_id is not null").select("page_id", "digest")
    first = long.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    # Written first, so that Spark knows its size when it chooses how to join.
    later = written(long.join(first, "digest").where("page_id <> refers_to").select(F.col("page_id").alias("id"), "refers_to").distinct(), "revisits")
    all_rows = rows.join(later, F.col("page_id") == F.col("id"), "left")
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit(f"<{_PAGE}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", uri)).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.sha2("html", 256))),
        line("X-Payload-Length", F.octet_length("html").cast("string")),
        F.when(revisit, line("WARC-Refers-To", urn(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.octet_length("html").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("html")),
    )
    out = all_rows.select(record.alias("value"))
    end = END.decode()
    if compressed:
        out, end = in_small_batches(out).mapInArrow(_packed, "raw binary").select(F.col("raw").cast("string").alias("value")), EMPTY_MEMBER.decode("latin-1")
    out.write.option("lineSep", end).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", records_per_file).text(path)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            raw = [gzip.compress(r.as_buffer().to_pybytes() + END, 6, mtime=0) for r in batch.column(0).slice(at, 100)]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], names=["raw"])


def page_records(records: DataFrame) -> DataFrame:
    """Digest of the archives that ``write_warc`` made: one row per page."""
    h = lambda name: F.try_element_at("headers", F.lit(name))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '([0-9-]+)>$', 1) as bigint)")
    rows = records.where("kind = 'record'").withColumns({"_id": h("warc-record-id"), "_to": F.coalesce(h("warc-refers-to"), F.lit(""))})
    return rows.select(
        number("_id").alias("page_id"),
        h("x-payload-length").cast("long").alias("payload_bytes"),
        F.substring_index(h("warc-payload-digest"), ":", -1).alias("payload_digest"),
        "record_type",
        number("_to").alias("refers_to"),
        F.col("path"),
        F.col("offset"),
        F.col("length"),
    )
