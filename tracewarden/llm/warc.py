"""Deterministic sharded WARC archives: range-sorted records, files rolled by compressed size, commit by manifest.

Rows are range-partitioned by page_id and sorted within; each task writes its records, one gzip member a record, into
files of a temporary folder and rolls to the next file once the compressed size is reached. A task reports its files; the
report is written once, and tasks over it move the files that it lists, and only those, to their names. Their rows, in the
folder ``manifest``, are the commit: a reader takes what they list, and files of failed or repeated attempts go with the
temporary folder. Headers (record ids, lengths, SHA-256 digests) are derived from the record alone, so equal input dealt
into equal ranges (they follow from the number of shards and Spark's sample of the ids) gives equal bytes.

Of pages with equal payloads of at least ``REVISIT_BYTES`` the one with the smallest page_id is a response, the others
are revisits of it. A payload that more than one page in ``HEAVY`` has is joined in as many parts as its share asks for;
there are fewer than ``HEAVY`` such payloads, whatever the table.

Defined results: a null html is the empty payload; a null page_id sorts first and is never referred to while another
page has the payload; repeated rows with one page_id are each written, the copies being revisits of their own id; null
urls are written as empty; an empty table gives a manifest without files.

Files are opened through pyarrow's file systems by URI, so the folder may lie in any store that executors reach.
"""

from __future__ import annotations

import gzip
import hashlib
import itertools
import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm.common import discard, key_or_min, materialize, shared_dir, shuffle_width, table

REVISIT_BYTES = 100
ROLL_BYTES = 64 << 20
#: A payload of more than 1 / HEAVY of all pages (and of LEAST_HEAVY) is heavy.
HEAVY, LEAST_HEAVY = 10_000, 1000
DATE = "2024-01-01T00:00:00Z"
_FILES = "name string, temporary string, records long, bytes long, first_page long, last_page long, sha256 string"
_RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI or of a plain absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def encode_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member; a revisit carries length and digest of its payload but not the payload."""
    digest = hashlib.sha256(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join(c for c in url if c not in chr(13) + chr(10))}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"]
    text = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode()
    return gzip.compress(text + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def decode_records(stream) -> Iterator[dict]:
    """Records of an open archive, member by member; both digests of each are verified."""
    with gzip.GzipFile(fileobj=stream) as raw:
        while True:
            version = raw.readline()
            if not version:
                return
            if version != b"WARC/1.1\r\n":
                raise ValueError(f"no WARC record: {version[:40]!r}")
            head = {}
            while (line := raw.readline()) != b"\r\n":
                k, _, v = line.decode().rstrip("\r\n").partition(": ")
                head[k] = v
            block = raw.read(int(head["Content-Length"]))
            if raw.read(4) != b"\r\n\r\n":
                raise ValueError("a record does not end as it should")
            if hashlib.sha256(block).hexdigest() != head["WARC-Block-Digest"].removeprefix("sha256:"):
                raise ValueError(f"block digest of {head['WARC-Record-ID']} differs")
            payload = block.partition(b"\r\n\r\n")[2] if head["WARC-Type"] == "response" else None
            digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
            if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"payload digest of {head['WARC-Record-ID']} differs")
            yield {
                "page_id": int(head["X-Page-ID"]) if head["X-Page-ID"] else None, "url": head.get("WARC-Target-URI", ""), "record_type": head["WARC-Type"],
                "refers_to": int(head["X-Refers-To-Page"]) if head.get("X-Refers-To-Page") else None,
                "payload_bytes": int(head["X-Payload-Length"]), "payload_digest": digest, "payload": payload,
            }


def find_revisits(pages: DataFrame) -> DataFrame:
    """page_id, row, refers_to of the rows that revisit an earlier page; row is a rank among rows of that page_id.

    Only ids and digests are shuffled. Digests of payloads that occur once never reach the join.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    each = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(payload, 256).alias("digest"), F.length(payload).alias("n")).filter(F.col("n") >= REVISIT_BYTES)
    groups = materialize(each.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1"), "payloads")
    part = max(LEAST_HEAVY, (groups.agg(F.sum("n")).first()[0] or 0) // HEAVY)
    heavy = F.broadcast(groups.filter(F.col("n") > part).select("digest", F.ceil(F.col("n") / part).cast("int").alias("salts")))  # HEAVY rows at most
    own = F.pmod(F.xxhash64("page_id"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")
    salted = groups.join(heavy, "digest", "left").select("digest", "refers_to", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    rows = each.join(heavy, "digest", "left").select("page_id", "digest", own)
    return rows.join(salted, ["digest", "salt"]).select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, shards: int, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write all pages into folder and commit; the manifest, a row a file."""
    spark = pages.sparkSession
    links = find_revisits(pages)
    body = pages.select(F.col("page_id").cast("long").alias("page_id"), F.lit(1).alias("is_page"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("refers_to"))
    notes = links.select("page_id", F.lit(0).alias("is_page"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to")
    merged = body.unionByName(notes).withColumn("sort_id", key_or_min("page_id"))
    # the notes of a page sort before its row: one range shuffle brings both together
    dealt = merged.repartitionByRange(shards, "sort_id").sortWithinPartitions("sort_id", "is_page", "html", "url").drop("sort_id")

    schema = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in (x.split() for x in _FILES.split(", "))])
    aside = f"_temporary-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        attempt = uuid.uuid4().hex
        files: list[dict] = []
        out, current = None, None
        notes: dict[str, int | None] = {}
        noted: object = itertools  # no id yet
        responded: set[str] = set()

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                out = None
                current["sha256"] = current.pop("hash").hexdigest()
                lo, hi = (("null" if x is None else f"{x:020d}") for x in (current["first_page"], current["last_page"]))
                current["name"] = f"pages-{lo}-{hi}-{current['sha256'][:12]}.warc.gz"
                files.append(current)

        try:
            for b in batches:
                for page_id, is_page, url, html, digest, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                    if page_id != noted:
                        notes, noted, responded = {}, page_id, set()
                    if not is_page:
                        notes[digest] = refers_to
                        continue
                    payload = html.encode()
                    key = hashlib.sha256(payload).hexdigest() if notes else ""
                    first = key in notes and notes[key] == page_id and key not in responded
                    if first:
                        responded.add(key)
                    revisit = key in notes and not first
                    record = encode_record(page_id, url or "", payload, notes.get(key), revisit)
                    if out is None:
                        temporary = f"{aside}/{attempt}-{len(files):05d}"
                        out = fs.open_output_stream(f"{root}/{temporary}")
                        current = {"temporary": temporary, "records": 0, "bytes": 0, "first_page": page_id, "last_page": page_id, "hash": hashlib.sha256()}
                    out.write(record)
                    current["hash"].update(record)
                    current["records"] += 1
                    current["bytes"] += len(record)
                    current["last_page"] = page_id
                    if current["bytes"] >= roll_bytes:
                        close()
            close()
        finally:
            if out is not None:
                out.close()
        if files:
            yield pa.RecordBatch.from_pylist([{k: f[k] for k in schema.names} for f in files], schema=schema)

    def put_in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for b in batches:
            for f in b.to_pylist():
                try:
                    fs.move(f"{root}/{f['temporary']}", f"{root}/{f['name']}")
                except OSError:  # a lost attempt of this task may have moved it
                    if fs.get_file_info(f"{root}/{f['name']}").size != f["bytes"]:
                        raise
            yield b

    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    hadoop = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    hadoop.mkdirs(jvm.org.apache.hadoop.fs.Path(at, aside))
    report = materialize(dealt.mapInArrow(run, _FILES), "report")  # written once: what it lists is what was closed
    width = max(1, min(shards, math.ceil(report.count() / 100)))
    moved = report.repartition(width, "name").mapInArrow(put_in_place, _FILES).drop("temporary")
    moved.write.mode("overwrite").parquet(f"{folder}/manifest")
    hadoop.delete(jvm.org.apache.hadoop.fs.Path(at, aside), True)
    discard(report)
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_FILES).parquet(f"{folder}/manifest").drop("temporary")


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The records of the files that the manifest lists, a file a task up to 4096 tasks."""
    listed = read_manifest(spark, folder).select("name")
    listed = listed.repartition(max(1, min(listed.count(), 4096)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    records = decode_records(stream)
                    while part := list(itertools.islice(records, 500)):
                        if not payloads:
                            for r in part:
                                r["payload"] = None
                        yield pa.RecordBatch.from_pylist(part, schema=schema)

    out = listed.mapInArrow(run, _RECORDS)
    return out if payloads else out.drop("payload")


def op7_warc_archives(spark, sf_dir: str) -> DataFrame:
    """All pages written to archives in the shared folder and read back."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    folder = shared_dir(spark, "warc")
    write_archives(pages, folder, shuffle_width(spark))
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = {
    "op7_warc_archives": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM g
"""
}
