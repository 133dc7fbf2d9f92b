"""WARC archives: a deterministic sharded writer and its reader.

Every record is made where its page is read, a gzip member of its own with freshly
made headers and digests, so that compressed bytes are what moves. Records are
sorted into shards, intervals of page ids of about ``RANGE_BYTES`` each, whose ends
come from a narrow table of ids and sizes. A shard's task writes its records in
order and rolls to the next file when the compressed size of the current one
reaches the limit. A file is written under a temporary name and renamed when
complete. What a run has committed is its manifest, a table of the files' names,
sizes, digests and record ranges; readers open the files it lists and no others.
Names and bytes follow from the rows alone, so a task that runs again writes the
same files. Archives are kept below a folder that driver and executors share.

Of the records with equal payloads of at least ``MIN_REVISIT`` bytes, the one
with the smallest page_id is a response and the others are revisits of it.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import child_names, delete_paths, fresh_path, path_exists
from .tables import drop_written, small_batches, written

ROLL_BYTES = 64 << 20
MIN_REVISIT = 100
#: Payload bytes of one shard, more where there would be over ``MOST_SHARDS`` of them.
RANGE_BYTES = 64 << 20
MOST_SHARDS = 1 << 15
#: Pages that the ends of the shards are read off, at least and for each shard.
SAMPLE_PAGES, SAMPLE_OF_SHARD = 1 << 13, 16
#: Bytes of pages or records that a task is handed at a time.
BATCH_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
#: Tasks of a read at most; beyond, a task reads several files in turn.
READ_TASKS = 50_000
#: Payload bytes that a reader holds before it hands rows on.
HELD_BYTES = 8 << 20

# Fixed values of the format (WARC 1.1).
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    """An id that follows from the row."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>"


def _line(value: str) -> str:
    # a header cannot hold line ends
    return " ".join(value.split("\r")).replace("\n", " ")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    """One compressed record: a response, or a revisit, which has no payload, if ``refers_to`` is given."""
    block = HTTP_HEAD + b"Content-Length: %d\r\n\r\n" % size
    if refers_to is None:
        block += payload
    head = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {record_id(page_id, url, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, refers_url, digest)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)  # gzip without a time stamp
    out = pack.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n")
    return out + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def info_bytes(name: str, date: str) -> bytes:
    block = f"software: rookery\r\nformat: {VERSION}\r\n".encode()
    head = "\r\n".join([VERSION, "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(None, name, 'info')}", f"WARC-Date: {date}",
                        f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"])
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _file_system(folder: str):
    """File system and path of a folder given as a URI or an absolute path."""
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def digests(pages: DataFrame) -> DataFrame:
    """(page_id, url, digest, size) of the payloads, taken in the scan and written once."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return written(pages.select(F.col("page_id").cast("long"), "url", F.sha2(payload, 256).alias("digest"),
                                F.octet_length(payload).cast("long").alias("size")), "warc-digests")


def revisits(narrow: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, digest, size, refers_to, refers_url) of the pages of ``digests``
    that revisit a response. The first page of a payload is a minimum that is
    pre-aggregated per task, however many pages share it."""
    narrow = narrow.where(F.col("size") >= min_revisit)
    first = (narrow.groupBy("digest")
             .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1 and first is not null").select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")))
    return (narrow.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
            .select("page_id", "url", "digest", "size", "refers_to", "refers_url"))


Place = tuple[int, int, str, str]


def place(page_id: int | None, digest: str, url: str | None) -> Place:
    """Where a record stands in the order of all: pages without an id first, by their payloads."""
    return (0 if page_id is None else 1, page_id or 0, digest, url or "")


def shard_ends(narrow: DataFrame, range_bytes: int = RANGE_BYTES) -> list[Place]:
    """The first places of all shards but the first, so that a shard holds about ``range_bytes``.

    They are read off a sample by hash, of half a million pages at most; how well
    it tells the ends costs time in a task, not memory, and no page is left out."""
    n, total = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = min(-(-total // range_bytes), MOST_SHARDS)
    if shards <= 1:
        return []
    share = min(1.0, max(SAMPLE_PAGES, SAMPLE_OF_SHARD * shards) / n)
    sample = narrow.where(F.pmod(F.xxhash64("page_id", "digest", "url"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = sorted((place(r.page_id, r.digest, r.url), r.size) for r in sample.toLocalIterator())
    step = max(1, sum(size for _, size in rows)) / shards
    ends: list[Place] = []
    held = 0
    for at, size in rows:
        if held >= step * (len(ends) + 1) and (not ends or at > ends[-1]):
            ends.append(at)
        held += size
    return ends


_MADE = ("shard int, page_id long, digest string, kind int, url string, size long, record binary")


def write(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, min_revisit: int = MIN_REVISIT, date: str = DATE,
          range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files below ``folder``; returns the manifest.

    The manifest has a row per file: name, records, bytes, sha256, first_page,
    last_page. It is written as Parquet to ``folder``/manifest after all files
    are complete; that is the commit.
    """
    spark = pages.sparkSession
    narrow = digests(pages)
    ends = shard_ends(narrow, range_bytes)
    schema = pa.schema([("shard", pa.int32()), ("page_id", pa.int64()), ("digest", pa.string()), ("kind", pa.int32()),
                        ("url", pa.string()), ("size", pa.int64()), ("record", pa.binary())])

    def shard_of(page_id, digest, url) -> int:
        return bisect_right(ends, place(page_id, digest, url))

    def responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for page_id, url, payload in zip(*batch.columns):
                page_id, url, payload = page_id.as_py(), url.as_py(), payload.as_py()
                digest = hashlib.sha256(payload).hexdigest()
                record = record_bytes(page_id, url, payload, len(payload), digest, None, None, date)
                rows.append((shard_of(page_id, digest, url), page_id, digest, 1, url, len(payload), record))
                held += len(record)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(shard_of(page_id, digest, url), page_id, digest, 0, url, size, record_bytes(page_id, url, b"", size, digest, refers_to, refers_url, date))
                    for page_id, url, digest, size, refers_to, refers_url in zip(*(c.to_pylist() for c in batch.columns))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    made = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload")).mapInArrow(responses, _MADE)
    made = made.unionByName(revisits(narrow, min_revisit).mapInArrow(marks, _MADE))
    # one shuffle, of compressed records: a page's revisit sorts in front of its response, which is then passed over
    ordered = made.repartitionById(len(ends) + 1, "shard").sortWithinPartitions("shard", "page_id", "digest", "url", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
        system, root = _file_system(folder)
        system.create_dir(f"{root}/data", recursive=True)
        system.create_dir(f"{root}/temporary", recursive=True)
        out, number, shard, marked = None, 0, None, Counter()

        def opened():
            nonlocal out, number
            name = f"part-{shard:06d}-{number:05d}.warc.gz"
            number += 1
            out = {"name": name, "temporary": f"{root}/temporary/{name}.{attempt}", "records": 0, "bytes": 0, "sha": hashlib.sha256(), "first": None, "last": None}
            out["file"] = system.open_output_stream(out["temporary"])
            put(info_bytes(name, date))

        def put(data: bytes):
            out["file"].write(data)
            out["sha"].update(data)
            out["bytes"] += len(data)

        def closed() -> pa.RecordBatch:
            nonlocal out
            out["file"].close()
            target = f"{root}/data/{out['name']}"
            if system.get_file_info(target).type != fs.FileType.NotFound:
                system.delete_file(target)  # an attempt that died after its rename left the same bytes
            system.move(out["temporary"], target)
            row = [out["name"], out["records"], out["bytes"], out["sha"].hexdigest(), out["first"], out["last"]]
            out = None
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                                              names=["name", "records", "bytes", "sha256", "first_page", "last_page"])

        for batch in batches:
            for i in range(batch.num_rows):
                at, page_id, digest, kind, url = (batch.column(c)[i].as_py() for c in range(5))
                if at != shard:
                    if out is not None:
                        yield closed()
                    shard, number = at, 0
                key = (page_id, digest, url)
                if kind == 1 and marked[key]:  # a revisit of this row has been written
                    marked[key] -= 1
                    continue
                if key not in marked:
                    marked.clear()  # rows of one key come together
                marked[key] += kind == 0
                if out is None:
                    opened()
                put(batch.column(6)[i].as_py())
                out["records"] += 1
                out["first"] = page_id if out["first"] is None else out["first"]
                out["last"] = page_id
                if out["bytes"] >= roll_bytes:
                    yield closed()
        if out is not None:
            yield closed()

    manifest = ordered.mapInArrow(run, "name string, records long, bytes long, sha256 string, first_page long, last_page long")
    with small_batches(spark, BATCH_BYTES):
        manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    delete_paths(spark, [f"{folder}/temporary/{name}" for name in child_names(spark, f"{folder}/temporary")] if path_exists(spark, f"{folder}/temporary") else [])
    drop_written(narrow)
    return spark.read.parquet(f"{folder}/manifest")


def _header_and_block(stream) -> tuple[dict[str, str], bytes] | None:
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if line.strip().decode("latin-1") != VERSION:
        raise ValueError(f"not a WARC record: {line[:60]!r}")
    head: dict[str, str] = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError("record header is cut off")
        name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
        head[name.strip().lower()] = value.strip()
    block = stream.read(int(head["content-length"]))
    if len(block) != int(head["content-length"]):
        raise ValueError("record block is cut off")
    return head, block


def read(spark, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest of ``folder`` lists.

    Returns page_id, url, record_type, refers_to, payload (null for a revisit, or
    without ``payloads``), payload_bytes and payload_digest of the full payload.
    Block and payload digests are verified in any case; a damaged file fails the
    read.
    """
    # listed files only, spread over tasks; the number is given, or few names would be put together in one
    names = spark.read.parquet(f"{folder}/manifest").select("name")
    names = names.repartitionByRange(max(1, min(names.count(), READ_TASKS)), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string())

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                              names=["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"])

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with system.open_input_stream(f"{root}/data/{name}", compression=None) as f:
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=f))
                    while (record := _header_and_block(stream)) is not None:
                        head, block = record
                        kind = head["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        digest = head["warc-payload-digest"].removeprefix("sha256:")
                        if head["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
                            raise ValueError(f"block digest of {head['warc-record-id']} in {name}")
                        http, _, body = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b":")[2])
                        if kind == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != size):
                            raise ValueError(f"payload digest of {head['warc-record-id']} in {name}")
                        page, refers = head.get("x-page-id"), head.get("x-refers-to-page")
                        rows.append((int(page) if page else None, head.get("warc-target-uri"), kind, int(refers) if refers else None,
                                     body if payloads and kind == "response" else None, size, digest))
                        held += len(body) if payloads else 0
                        if held >= HELD_BYTES or len(rows) >= 10_000:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    return names.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def round_trip(pages: DataFrame, folder: str | None = None, payloads: bool = True, **options) -> DataFrame:
    """Write ``pages`` and read the archives back, into a new folder below the shared one by default.

    A null html is an empty payload; a null url or page_id leaves its header
    out. Every row gives one record. Rows that repeat the smallest page_id of a
    payload are responses like the first; rows without page_id revisit the
    response of their payload, or are responses if no row of it has an id. An
    empty table writes no files and gives an empty table. Other columns are not
    read.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    write(pages, folder, **options)
    return read(spark, folder, payloads)
