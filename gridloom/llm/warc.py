"""WARC archives written index first and read back by coalesced byte ranges (operator 6).

Writing gives one archive for each partition, a gzip member for each record, and an index table with the place (archive,
offset, length), URL and digest of every record. An archive has a name of its own for each attempt of its task; only the
attempt whose index rows Spark commits is ever read, so retries and lost executors leave unused files, no wrong ones.
Reading takes the index rows of the records that are wanted, sorts them by place, joins ranges whose gap is small and
fetches each joined range with one read, in as many tasks as the wanted bytes ask for.

Records with equal payloads of at least `min_payload` bytes: that with the largest id is the response, the others are
revisits that refer to it. A null payload is an empty one. A null URL has no WARC-Target-URI; control characters and
spaces in a URL are percent-encoded. Equal ids with equal payloads are responses both; a null id is never larger than
another and refers to nothing. Extra columns are ignored; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import by_bytes
from .store import Scratch

INDEX = "archive string, offset long, length long, url string, digest string, page_id long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
_ID = "urn:x-page:"
_DATE = "2000-01-01T00:00:00Z"  # a fixed date keeps archives reproducible


@dataclass(frozen=True)
class WarcParams:
    min_payload: int = 0
    gzip_level: int = 1
    max_gap: int = 64 << 10
    range_bytes: int = 8 << 20
    task_bytes: int = 64 << 20


def files_at(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it; the names that Hadoop has for an object store's schemes are those of its own client."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, name: str) -> bytes:
    """One WARC/1.0 record: a response with its HTTP block, or a revisit whose block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{_ID}{'' if page_id is None else page_id}>")]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields += [("WARC-Date", _DATE), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{name}")]
    block = http + payload
    if refers_to is not None:
        block = http
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{_ID}{refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """The columns of RECORD from one record's bytes; digest and size of a response are taken from its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(x) if (x := x.strip("<>").removeprefix(_ID)) else None
    page_id, url = number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI")
    if fields["WARC-Type"] == "response":
        return page_id, url, len(payload), digest(payload), "response", None, payload.decode("utf-8", "replace")
    size = int(re.search(rb"\nContent-Length: (\d+)", http)[1])
    return page_id, url, size, fields["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", number(fields["WARC-Refers-To"]), None


def write(pages: DataFrame, scratch: Scratch, p: WarcParams = WarcParams()) -> DataFrame:
    """Write the archives; returns the index, itself a written table.

    pages: page_id, url, html. Which record answers for a payload is one aggregation on digests, written; the pages are
    then joined to it by digest, a join between two plain exchanges, so AQE can split the rows of a frequent payload.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    narrow = rows.where(F.octet_length("html") >= p.min_payload)
    answers = narrow.groupBy("sha").agg(F.max("page_id").alias("answer"), F.count("*").alias("n")).where("n > 1").drop("n")
    answers = scratch.save(answers, "answers")
    joined = rows.join(answers, "sha", "left").withColumn("refers_to", F.when(F.col("page_id") < F.col("answer"), F.col("answer")))
    joined = joined.withColumn("refers_to", F.when(F.col("page_id").isNull() & F.col("answer").isNotNull(), F.col("answer")).otherwise(F.col("refers_to")))
    uri = scratch.path("archives")
    fs, root = files_at(uri)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = files_at(uri)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        for batch in by_bytes(batches, "html"):
            if out is None:
                out = files.open_output_stream(f"{folder}/{name}", compression=None)  # members are packed here
            rows = []
            for page_id, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                payload = html.encode("utf-8", "surrogatepass")
                mark = digest(payload)
                pack = zlib.compressobj(p.gzip_level, zlib.DEFLATED, 31)
                data = pack.compress(record(page_id, url, payload, refers, mark)) + pack.flush()
                out.write(data)
                rows.append((name, at, len(data), url, mark, page_id))
                at += len(data)
            columns = list(zip(*rows))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["archive", "offset", "length", "url", "digest", "page_id"])
        if out is not None:
            out.close()

    return scratch.save(joined.select("page_id", "url", "html", "refers_to").mapInArrow(run, INDEX), "index")


def coalesce(places: list[tuple[int, int]], max_gap: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Joined ranges (start, end, the places in them) of sorted (offset, length) places with gaps of at most max_gap."""
    joined: list[list] = []
    for at, n in sorted(places):
        if joined and at - joined[-1][1] <= max_gap:
            joined[-1][1] = max(joined[-1][1], at + n)
            joined[-1][2].append((at, n))
        else:
            joined.append([at, at + n, [(at, n)]])
    return [tuple(x) for x in joined]


def read(index: DataFrame, scratch: Scratch, where: Column | None = None, p: WarcParams = WarcParams()) -> DataFrame:
    """The records (RECORD) that the index rows, or those that `where` selects, point to.

    The rows of each stretch of range_bytes of an archive go together, so a group is bounded by the stretch's size. The
    stretches are dealt to a task for each task_bytes of them, but to every core where there are enough: their index rows
    are tiny, so the number is given, not left to the size of the shuffle.
    """
    uri = scratch.path("archives")
    wanted = (index if where is None else index.where(where)).withColumn("stretch", F.floor(F.col("offset") / p.range_bytes))
    total = wanted.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, total // p.task_bytes, min(index.sparkSession.sparkContext.defaultParallelism, 2 * total // p.range_bytes))
    dealt = wanted.repartition(int(tasks), "archive", "stretch")
    stretches = dealt.groupBy("archive", "stretch").agg(F.collect_list(F.struct("offset", "length")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = files_at(uri)
        names = [x.strip().split(" ")[0] for x in RECORD.split(",")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for archive, places in zip(batch.column("archive").to_pylist(), batch.column("places").to_pylist()):
                with files.open_input_file(f"{folder}/{archive}") as f:
                    for start, end, held in coalesce([(x["offset"], x["length"]) for x in places], p.max_gap):
                        data = f.read_at(end - start, start)
                        rows = [parse(zlib.decompress(data[a - start : a - start + n], 31)) for a, n in held]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return stretches.select("archive", "places").mapInArrow(run, RECORD)


#: The digest of a payload in base32, from the 40 hex digits of its SHA-1: five bits at a time.
_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((
    (instr('0123456789abcdef', substr(s, ((5 * i) // 4 + 1)::BIGINT, 1)) - 1) * 16
    + (CASE WHEN (5 * i) // 4 + 2 <= 40 THEN instr('0123456789abcdef', substr(s, ((5 * i) // 4 + 2)::BIGINT, 1)) - 1 ELSE 0 END)
    )::BIGINT >> (3 - (5 * i) % 4)::BIGINT) & 31)::BIGINT + 1, 1)), '')"""
ORACLE = f"""
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS s FROM pages),
m AS (SELECT s, max(page_id) AS answer FROM d GROUP BY s)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = answer THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> answer THEN answer END AS refers_to
FROM d JOIN m USING (s)
"""
