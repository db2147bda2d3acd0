"""WARC archives: a sharded writer with revisit records, and a salvaging reader.

Writing: each task writes gzip members, one a record, into archives of bounded size, in a folder of its own attempt; the names that come back are those of
the attempts that count. Ids and digests alone decide which pages revisit others; only pages whose payloads are long enough to be revisits are joined with the outcome.

Reading: an archive is parsed from one start to the next, a gzip member or a version line. Where a check fails, the reader searches for the next
start of either kind: bytes that inflate to a version line, or a version line itself. A member that is cut off or damaged still gives the records that inflate before the
damage, and within any member a record that fails a check is left at the next version line. The bytes between are reported as quarantined gaps.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, hot_values, new_path, split_join, stored

#: A task begins a new archive beyond so many compressed bytes.
ARCHIVE_BYTES = 16 << 20
#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
VERSION = b"WARC/1.1"
INFLATE_BYTES = 8 << 10
#: Tasks among which archives are dealt at most.
READ_TASKS = 10_000
_MAGIC = b"\x1f\x8b\x08"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")

RECORDS = "archive string, position long, length long, inside long, record_type string, page_id long, refers_to long, url string, payload binary, payload_bytes long, payload_digest string, sound boolean"
GAPS = "archive string, position long, length long, inside long, reason string"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, uncompressed. A revisit carries no payload; its headers name the record it refers to."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url or ""),
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[5:5] = [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 2) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def sha1_of(stated: str | None) -> str | None:
    """The hexadecimal digest of a digest header, written in base 32 or hexadecimal; None for other algorithms and what is neither."""
    algorithm, _, value = (stated or "").partition(":")
    if algorithm.strip().lower() not in ("sha1", "sha-1"):
        return None
    value = value.strip()
    if re.fullmatch("[0-9A-Fa-f]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch("[A-Za-z2-7]{32}", value) else None


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``; ValueError where a check fails."""
    if not _VERSION_LINE.match(raw, at):
        raise ValueError("no version line")
    stop = raw.find(b"\r\n\r\n", at)
    if stop < 0:
        raise ValueError("headers do not end")
    headers, last = {}, None
    for line in raw[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if line[:1] in (b" ", b"\t") and last:  # a header goes on
            headers[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        if not colon:
            raise ValueError("header without a colon")
        last = name.strip().lower().decode("ascii", "replace")
        headers[last] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdigit():
        raise ValueError("no content length")
    begin, size = stop + 4, int(headers["content-length"])
    block = raw[begin : begin + size]
    if len(block) < size or raw[begin + size : begin + size + 4] != b"\r\n\r\n":
        raise ValueError("the record is cut off")
    wanted = sha1_of(headers.get("warc-block-digest"))
    if wanted is not None and hashlib.sha1(block).hexdigest() != wanted:
        raise ValueError("block digest differs")
    return headers, block, begin + size + 4


def inflate(raw: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What the member at ``at`` inflates to, its end, and what is wrong with it (then the end is about where the damage shows)."""
    view, first = memoryview(raw), at
    opener, out = zlib.decompressobj(31), []
    size = INFLATE_BYTES  # the inflater copies what it leaves unused
    while not opener.eof:
        if at >= len(raw):
            return b"".join(out), at, "the member is cut off"
        piece = view[at : at + size]
        try:
            out.append(opener.decompress(piece))
        except zlib.error as e:
            if size == 1:
                return b"".join(out), at, str(e)
            # again up to here, then byte by byte, for what the failing piece still holds
            opener, out = zlib.decompressobj(31), []
            for k in range(first, at, INFLATE_BYTES):
                out.append(opener.decompress(view[k : min(k + INFLATE_BYTES, at)]))
            size = 1
            continue
        at += len(piece)
    return b"".join(out), at - len(opener.unused_data), None


def next_start(raw: bytes, at: int) -> int:
    """The first place from ``at`` on where a version line stands or a member's first bytes inflate to one; else the end."""
    line = _VERSION_LINE.search(raw, at)
    stop = line.start() if line else len(raw)
    while 0 <= (at := raw.find(_MAGIC, at, stop)):
        try:
            if _VERSION_LINE.match(zlib.decompressobj(31).decompress(raw[at : at + 4096], 64)):
                return at
        except zlib.error:
            pass
        at += 1
    return stop


def records(raw: bytes) -> Iterator[tuple]:
    """("record", position, length, headers, block) and ("gap", position, length, reason) that cover what a member holds, in order."""
    at = 0
    while at < len(raw):
        try:
            headers, block, end = parse(raw, at)
        except ValueError as e:
            found = _VERSION_LINE.search(raw, at + 1)
            end = found.start() if found else len(raw)
            yield "gap", at, end - at, str(e)
        else:
            yield "record", at, end - at, headers, block
        at = end


def salvage(raw: bytes) -> Iterator[tuple]:
    """("record", position, length, inside, headers, block, sound) and ("gap", position, length, inside, reason) of an archive, in order.

    Position and length are the archive's bytes: of a record, a member or a gap between them; together they cover the archive. ``inside`` is null, or says where within
    what the member at that position inflates to the record or gap lies; such a gap's length counts inflated bytes. What follows the damage of a member is one gap of
    the archive, of no length if the next start comes before the place where the damage shows. Of a damaged member only records whose block digest holds are given,
    and they are not ``sound``: no check covers their headers.
    """
    at = 0
    while at < len(raw):
        if raw.startswith(_MAGIC, at):
            inner, bad, reason = inflate(raw, at)
            stop = bad if reason is None else next_start(raw, at + 1)
            given = lambda r: r[0] == "record" and (reason is None or sha1_of(r[3].get("warc-block-digest")) is not None)
            end = min(bad, stop) if any(map(given, records(inner))) else at
            for kind, inside, size, *rest in records(inner) if end > at else ():
                if given((kind, inside, size, *rest)):
                    yield "record", at, end - at, inside, *rest, reason is None
                elif reason is None or inside + size < len(inner):
                    yield "gap", at, size, inside, "no digest to check in a damaged member" if kind == "record" else rest[0]
            if end < stop or reason is not None:
                yield "gap", end, stop - end, None, reason or "no record in the member"
            end = stop
        else:
            try:
                headers, block, end = parse(raw, at)
            except ValueError as e:
                end = next_start(raw, at + 1)
                yield "gap", at, end - at, None, str(e)
            else:
                yield "record", at, end - at, None, headers, block, True
        at = end


def write(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) below ``path``; returns their names, record counts and sizes.

    Lost, repeated and speculative attempts leave folders beside those that count; ``read`` and ``gaps`` take the result to tell them apart.

    Of rows with equal payloads of ``revisit_bytes`` or more, the one with the largest page_id is a response and the others revisit it. Null html is an empty
    payload; a null url is an empty one; a null page_id is written without a number and always as a response. Rows that repeat a page_id and payload
    are written as often as they occur. ``path`` is a URI of any file system that the workers' pyarrow opens. Other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    can = (F.length("payload") >= revisit_bytes) & F.col("page_id").isNotNull()
    digests = stored(rows.where(can).select("page_id", F.sha1("payload").alias("digest")), "warc-digests")
    heads = stored(digests.groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1"), "warc-heads")
    refers = split_join(digests, heads, ["digest"], hot_values(heads, "digest")).where("page_id <> head").select("page_id", "digest", F.col("head").alias("refers_to")).distinct()
    joined = rows.where(can).withColumn("digest", F.sha1("payload")).join(refers, ["page_id", "digest"], "left").select("page_id", "url", "payload", "refers_to")
    joined = joined.union(rows.where(~can).select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers_to")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(path)
        own = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"  # no other attempt's
        base = f"{base}/{own}"
        store.create_dir(base, recursive=True)
        done, out, size, n = [], None, 0, 0

        def close() -> None:
            nonlocal out
            out.close()
            done.append((f"{own}/{name}", n, size))
            out = None

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                if out is None:
                    name, size, n = f"{len(done):04d}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                data = member(record(page_id, url, payload, refers_to))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= ARCHIVE_BYTES:
                    close()
        if out is not None:
            close()
        names, counts, sizes = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["archive", "records", "bytes"])

    bounded_batches(pages.sparkSession)
    return stored(joined.mapInArrow(run, "archive string, records long, bytes long"), "warc-written")


def _contents(spark: SparkSession, path: str, names: str, archives: DataFrame | None, run, schema: str) -> DataFrame:
    """``run`` (pairs of name and bytes to batches) over the archives below ``path``: those that ``archives`` lists, else all that match ``names``."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with store.open_input_stream(f"{base}/{name}", compression=None) as f:
                    yield from run(f"{path}/{name}", f.read())

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
                yield from run(name, raw.as_py())

    if archives is not None:
        tasks = max(1, min(archives.count(), READ_TASKS))
        return archives.select("archive").repartition(tasks).mapInArrow(listed, schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(found, schema)


def read(spark: SparkSession, path: str, names: str = "*.warc*", archives: DataFrame | None = None) -> DataFrame:
    """The records below ``path`` that can be recovered: place, type, ids, url, payload (null for revisits), and the full payload's size and hex SHA-1;
    ``sound`` is false where a record comes from a damaged member.

    ``archives``: the result of ``write``, to read exactly those. Empty archives give no rows; archives without any record only gaps. Records of any type come back;
    what a header lacks or states in an unknown form is null. Repeated records come back as often as they are there. An archive and a member are each held as a whole by one task.
    """

    def run(name: str, raw: bytes) -> Iterator[pa.RecordBatch]:
        some: list[tuple] = []
        held = 0
        for kind, *rest in salvage(raw):
            if kind == "record":
                some.append(_row(name, *rest))
                held += len(rest[-2])
                if held > 4 << 20:
                    yield _batch(some, RECORDS)
                    some, held = [], 0
        yield _batch(some, RECORDS)

    return _contents(spark, path, names, archives, run, RECORDS)


def gaps(spark: SparkSession, path: str, names: str = "*.warc*", archives: DataFrame | None = None) -> DataFrame:
    """The quarantined byte ranges below ``path``, and why each failed; ``inside`` as in ``salvage``. Whole archives give no rows; arguments as for ``read``."""

    def run(name: str, raw: bytes) -> Iterator[pa.RecordBatch]:
        yield _batch([(name, *x[1:]) for x in salvage(raw) if x[0] == "gap"], GAPS)

    return _contents(spark, path, names, archives, run, GAPS)


def _long(text: str) -> int | None:
    """A whole number that fits 64 bits."""
    found = int(text) if re.fullmatch("-?[0-9]{1,19}", text) else 1 << 63
    return found if -(1 << 63) <= found < 1 << 63 else None


def _number(urn: str | None) -> int | None:
    found = re.fullmatch("<urn:page:(.*)>", urn or "")
    return _long(found[1]) if found else None


def _payload(kind: str | None, headers: dict[str, str], block: bytes) -> bytes | None:
    """What a record brings along: the body of an HTTP response, the whole block of other records, nothing of a revisit."""
    if kind == "revisit":
        return None
    return block.partition(b"\r\n\r\n")[2] if kind == "response" and headers.get("content-type", "application/http").startswith("application/http") else block


def _row(name: str, at: int, size: int, inside: int | None, headers: dict[str, str], block: bytes, sound: bool) -> tuple:
    kind = headers.get("warc-type")
    payload = _payload(kind, headers, block)
    if payload is None:
        digest, length = sha1_of(headers.get("warc-payload-digest")), headers.get("warc-payload-length", "")
        n = _long(length)
    else:
        digest, n = hashlib.sha1(payload).hexdigest(), len(payload)
    return name, at, size, inside, kind, _number(headers.get("warc-record-id")), _number(headers.get("warc-refers-to")), headers.get("warc-target-uri"), payload, n, digest, sound


_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives of ``pages`` to the shared folder and read them back. An empty table gives no rows; nulls, ties and repeated rows as in ``write``."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    return read(spark, path, archives=write(pages, path))


#: The query's rows in SQL, from the pages themselves.
ORACLE = """
with p as (select page_id, encode(coalesce(html, '')) as raw from pages),
d as (select page_id, octet_length(raw) as payload_bytes, sha1(raw) as payload_digest from p),
h as (select payload_digest, max(page_id) as head from d where payload_bytes >= 1000 group by payload_digest)
select page_id, payload_bytes, payload_digest, case when head is null or head = page_id then 'response' else 'revisit' end as record_type,
  case when head <> page_id then head end as refers_to
from d left join h using (payload_digest)
"""
