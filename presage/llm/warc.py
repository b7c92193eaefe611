"""WARC archives: writing with revisits, and reading by boundary-chain verification.

Writing: a record per page; of records with equal payloads the one with the
least page_id is a response and the others revisit it. Reading: the archives are
cut into byte ranges. Each task finds the record magic in its range and takes
every hit as a candidate record, whose Content-Length names its successor; it
follows successors to the first one beyond its range. Pointer jumping from each
file's start, doubling the stride each round, leaves the candidates at which a
range is really entered, so magic inside payloads is never reached. Tasks then
walk the records of their range from its entry. A header has no greatest length:
tasks read on until its empty line.

Defined results: a null html counts as empty and a null url as absent; line ends
in a url become %0A; extra columns are ignored; a payload
of fewer than min_bytes is always a response; rows that repeat the least page_id
of a payload are all responses; a null page_id is written and read back as null
and stands behind all others, so its row is a response only if no row of its payload
has an id; a payload of any length is one record, which the task that reads it
holds whole; an empty table gives no records; an archive whose chain breaks before
its end raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presage.llm.common import materialize, new_path, remove_path

MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
#: Bytes of a range, and those read behind it at first for its last header.
RANGE, AHEAD = 8 << 20, 1 << 16
#: Ranges are dealt to as many tasks as there are ranges, up to this number.
TASKS = 10_000
#: Rows of the table of payloads held by more than one page up to which it is broadcast (under 32 MB).
BROADCAST_ROWS = 200_000


def digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1, in SQL: 40 bits are 8 digits."""
    sha = F.sha1(payload)
    eighths = [F.lpad(F.conv(F.substring(sha, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*eighths), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Archives of pages(page_id, url, html) in the folder path."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        "page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A").alias("url"), html.alias("html"), digest(html).alias("digest")
    )
    shared = (
        rows.where(F.octet_length("html") >= min_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("shared"), "first")
    )
    shared = materialize(shared, "payloads")
    small = shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(shared) if small else shared, F.col("digest") == F.col("shared"), "left")
    revisit = F.col("first").isNotNull() & (~F.col("page_id").eqNullSafe(F.col("first"))) & (F.octet_length("html") >= min_bytes)
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END)
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    head = F.concat(
        F.lit(MAGIC.decode() + "WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        name,
        F.lit(">\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\nWARC-Payload-Length: "),
        F.octet_length("html").cast("string"),
        F.when(
            revisit,
            F.concat(
                F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"),
                F.col("first").cast("string"),
                F.lit(">"),
            ),
        ).otherwise(""),
        F.lit("\r\nContent-Length: "),
        F.octet_length("_block").cast("string"),
        F.lit(END),
    )
    records = joined.withColumn("_block", block).select(F.concat(head, F.col("_block")).alias("value"))
    records.write.option("lineSep", END).text(path)  # each record ends in an empty line, as WARC has it


class _File:
    """Random reads from a path that all executors can open."""

    def __init__(self, path: str):
        if path.startswith("file:"):
            self.handle = open("/" + path[5:].lstrip("/"), "rb")  # noqa: SIM115
        else:
            from pyarrow import fs

            system, inner = fs.FileSystem.from_uri(path)
            self.handle = system.open_input_file(inner)

    def __enter__(self) -> _File:
        return self

    def __exit__(self, *_: object) -> None:
        self.handle.close()

    def read(self, at: int, n: int) -> bytes:
        self.handle.seek(at)
        return self.handle.read(n)


_LENGTH = re.compile(rb"\r\nContent-Length: *(\d{1,18})\r\n")


class _Window:
    """The bytes of a file from `start` on, of which more are read as headers need them."""

    def __init__(self, file: _File, length: int, start: int, size: int):
        self.file, self.length, self.start = file, length, start
        self.data = file.read(start, size)
        self.blank = -1  # the empty line found last
        self.field, self.size, self.sought = -1, 0, 0  # the length field found last, what it says, and from where to seek the next

    def header(self, at: int) -> tuple[int, int] | None:
        """(offset behind the header, Content-Length), if a record's header stands at `at`; both ends count from start."""
        if self.blank < at:
            begin = at
            while (end := self.data.find(b"\r\n\r\n", begin)) < 0:
                have = self.start + len(self.data)
                if have >= self.length:
                    return None
                begin = max(at, len(self.data) - 3)
                self.data += self.file.read(have, max(AHEAD, len(self.data)))
            self.blank = end
        if self.field < at:  # no byte is searched twice, however many headers begin before one empty line
            end = self.blank + 2
            found = _LENGTH.search(self.data, max(at, self.sought), end) if self.sought < end else None
            if found:
                self.field, self.size, self.sought = found.start(), int(found[1]), found.start() + 1
            else:
                self.sought = max(self.sought, end)
        return (self.blank + 4, self.size) if at <= self.field < self.blank else None


def _candidates(path: str, length: int, start: int, end: int) -> list[tuple[int, int]]:
    """(offset, the first offset on its chain that is not in the range; -1: the chain breaks)."""
    hits: list[tuple[int, int]] = []
    with _File(path) as f:
        window = _Window(f, length, start, end - start + AHEAD)
        at = window.data.find(MAGIC)
        while 0 <= at < end - start:
            if (found := window.header(at)) and (successor := start + found[0] + found[1] + len(END)) <= length:
                hits.append((start + at, successor))
            at = window.data.find(MAGIC, at + 1)
    leave: dict[int, int] = {}
    for offset, successor in reversed(hits):
        leave[offset] = successor if successor >= end else leave.get(successor, -1)
    return sorted(leave.items())


def _walk(path: str, length: int, start: int, end: int, entry: int) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of the records that begin in the range."""
    with _File(path) as f:
        window, at = _Window(f, length, start, end - start + AHEAD), entry
        while at < end:
            found = window.header(at - start) if window.data.startswith(MAGIC, at - start) else None
            if not found:
                raise ValueError(f"{path}: no record at {at}")
            head, (body, size) = window.data[at - start : found[0]], found
            block = window.data[body : body + size]
            if len(block) < size:
                block = f.read(start + body, size)
            yield head, block
            at = start + body + size + len(END)
        if at > length:
            raise ValueError(f"{path}: the record before {at} is cut off")


_FIELD = re.compile(r"(?:^|\r\n)([A-Za-z-]+): *([^\r\n]*)")


def _page(urn: str | None) -> int | None:
    found = re.search(r"urn:page:(-?\d+)", urn or "")
    return int(found[1]) if found else None


def entries(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(path, length, start, end, entry): the ranges in which records begin, and the first true one of each."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(size).cast("bigint")))
    ranges = files.select("path", "length", starts.alias("start"))
    ranges = materialize(ranges.withColumn("end", F.least(F.col("start") + size, F.col("length"))), "ranges")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path_, length, start, end in zip(*(c.to_pylist() for c in b.columns)):
                found = _candidates(path_, length, start, end)
                cols = zip(*found) if found else ((), ())
                arrays = [pa.array([path_] * len(found), pa.string()), *(pa.array(c, pa.int64()) for c in cols)]
                yield pa.RecordBatch.from_arrays(arrays, ["path", "offset", "jump"])

    def save(df: DataFrame) -> tuple[DataFrame, str]:
        place = new_path(spark, "chain")
        df.write.parquet(place)
        return spark.read.schema(df.schema).parquet(place), place

    jumps, jumps_path = save(_dealt(ranges).mapInArrow(scan, "path string, offset bigint, jump bigint"))
    reached, reached_path = save(files.select("path", F.lit(0).cast("bigint").alias("at")))
    known = reached.count()
    while True:
        # One stride more for all that is reached, and strides twice as long for the next round.
        more = reached.join(jumps, (reached["path"] == jumps["path"]) & (F.col("at") == F.col("offset")))
        more = more.where("jump >= 0").select(reached["path"], F.col("jump").alias("at"))
        old = reached_path
        reached, reached_path = save(reached.unionByName(more).distinct())
        remove_path(spark, old)
        n = reached.count()
        if n == known:
            break
        known = n
        further = jumps.select(F.col("path").alias("p"), F.col("offset").alias("o"), F.col("jump").alias("j"))
        further = jumps.join(further, (F.col("path") == F.col("p")) & (F.col("jump") == F.col("o")), "left")
        # A stride beyond the file's end or into nothing stays where it got.
        old = jumps_path
        jumps, jumps_path = save(further.select("path", "offset", F.coalesce("j", "jump").alias("jump")))
        remove_path(spark, old)
    remove_path(spark, jumps_path)
    first = reached.select(F.col("path").alias("p"), "at", (F.floor(F.col("at") / size) * size).cast("bigint").alias("s"))
    return ranges.join(first, (F.col("path") == F.col("p")) & (F.col("start") == F.col("s"))).where("at < length").select(*ranges.columns, F.col("at").alias("entry"))


def _dealt(ranges: DataFrame) -> DataFrame:
    """Ranges, each dealt to a task of its own: their number is given, since rows so small would be put together."""
    return ranges.repartition(max(1, min(TASKS, ranges.count())), "path", "start")


def read(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_digest, payload_bytes, html) of every record.

    A revisit's digest and length are its header's, its html is null; any other
    record's are taken from its payload, which is its block behind an HTTP header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                held, weight = [], 0
                for head, block in _walk(*row):
                    fields = dict(_FIELD.findall(head[len(MAGIC) - 2 :].decode("utf-8", "replace")))
                    payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
                    own = fields.get("WARC-Type") != "revisit"
                    said = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                    held.append(
                        {
                            "page_id": _page(fields.get("WARC-Record-ID")),
                            "url": fields.get("WARC-Target-URI") or None,
                            "record_type": fields.get("WARC-Type"),
                            "refers_to": _page(fields.get("WARC-Refers-To")),
                            "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode() if own else said,
                            "payload_bytes": len(payload) if own else int(fields.get("WARC-Payload-Length", 0)),
                            "html": payload.decode("utf-8", "replace") if own else None,
                        }
                    )
                    weight += len(block) + 1000
                    if weight > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, weight = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    text, number = pa.string(), pa.int64()
    schema = pa.schema(
        [("page_id", number), ("url", text), ("record_type", text), ("refers_to", number), ("payload_digest", text), ("payload_bytes", number), ("html", text)]
    )
    out = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, html string"
    return _dealt(materialize(entries(spark, path, size), "entries")).mapInArrow(run, out)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, min_bytes)
    return read(pages.sparkSession, path)
