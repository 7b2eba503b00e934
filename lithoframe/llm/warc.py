"""WARC archives: index first, then coalesced byte-range reads.

Each task writes its records, one gzip member each, into files of its own and hands back an index row per record:
file, offset, length, URL and digest. The index is a table; readers select from it, sort by file and offset, merge
neighbouring ranges in Spark and fetch each merged range with one read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.llm.common import shared_dir, stage

INDEX = "page_id long, url string, file string, offset long, length long, digest string, payload_bytes long, record_type string, refers_to long"
READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: The profile that names a revisit by equal payload digests (fixed by the standard).
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record, gzipped as a member of its own. Control characters in the URL are escaped, so they can't forge headers."""
    block = _HTTP if refers_to is not None else _HTTP + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>",
        "WARC-Date": date,
        "WARC-Target-URI": "".join(c if " " < c else f"%{ord(c):02X}" for c in url or ""),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Page-ID": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to} {digest}')}>", "X-Refers-To-Page-ID": str(refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    raw = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(raw.encode("utf-8", "replace") + block + b"\r\n\r\n") + press.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one gunzipped record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def mark_revisits(pages: DataFrame, least_bytes: int = 1000, most_broadcast: int = 100_000) -> DataFrame:
    """pages -> page_id, url, payload, digest, refers_to.

    Of payloads with equal digests and at least `least_bytes` bytes, the one with the largest page_id is the response
    and the others refer to it. Rows that repeat that page_id are responses too; null page_ids count as smallest, and
    where all are null, all are responses.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    groups = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first")).filter("n > 1 and first is not null").drop("n")
    groups = stage(groups, "equal_payloads")
    few = groups.limit(most_broadcast + 1).count() <= most_broadcast
    out = rows.join(F.broadcast(groups) if few else groups, "digest", "left")
    return out.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", most_bytes: int = 256 << 20) -> DataFrame:
    """records (of mark_revisits) -> the index, one row per record; the archives lie in `folder`, which all executors must reach.

    A task starts a new file after `most_bytes`. File names are unique to the attempt, and the index names files of
    attempts that ended only, so a task that is run again leaves at worst a file that nothing refers to.
    """

    def run(batches):
        out, name, at = None, "", 0
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            index = []
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= most_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                member = record(page_id, url, payload, digest, refers_to, date)
                out.write(member)
                index.append((page_id, url, f"{folder}/{name}", at, len(member), digest, len(payload), "response" if refers_to is None else "revisit", refers_to))
                at += len(member)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index, strict=True) if index else [[]] * 9, kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    return stage(records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, INDEX), "index")


def coalesce_ranges(index: DataFrame, gap: int = 64 << 10, most_bytes: int = 8 << 20) -> DataFrame:
    """Selected index rows -> file, start, stop, members (offset and length of each record), one row per read.

    Neighbours no more than `gap` bytes apart share a read; a read begins in one stretch of `most_bytes` of its file, so
    its length is bounded by that and one record. Files are of bounded size and many, so windows by file stay small.
    """
    w = Window.partitionBy("file", "stretch").orderBy("offset")
    parts = index.select("file", "offset", "length", F.floor(F.col("offset") / most_bytes).alias("stretch"))
    parts = parts.withColumn("fresh", F.coalesce(F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(w) > gap, F.lit(True)).cast("int"))
    parts = parts.withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy("file", "stretch", "run").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("members")).drop("stretch", "run")


def read_records(index: DataFrame, payloads: bool = True, task_bytes: int = 32 << 20, **options) -> DataFrame:
    """Selected index rows -> READ, parsed from the archives.

    payload_digest is computed anew from a response's payload and must agree with its header; a revisit has its response's digest and size, from its
    headers, and a null payload. With payloads=False the payload column is null throughout.
    """

    def run(batches):
        for batch in batches:
            for file, start, stop, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, path = fs.FileSystem.from_uri(file)
                with store.open_input_file(path) as f:
                    raw = f.read_at(stop - start, start)
                rows = []
                for m in members:
                    fields, payload = parse(zlib.decompress(raw[m["offset"] - start : m["offset"] - start + m["length"]], 31))
                    revisit = fields["WARC-Type"] == "revisit"
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(fields["X-Payload-Length"])):
                        raise ValueError(f"{file} at {m['offset']}: the payload doesn't match its digest")
                    number = lambda k: int(v) if (v := fields.get(k, "")) else None
                    rows.append((number("X-Page-ID"), fields["WARC-Target-URI"], payload if payloads and not revisit else None, number("X-Payload-Length"), digest, fields["WARC-Type"], number("X-Refers-To-Page-ID")))
                kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in READ.split(", ")])

    # Index rows are small beside what they stand for, so reads are dealt by the bytes they fetch.
    ranges = stage(coalesce_ranges(index, **options).select("file", "start", "stop", "members"), "ranges")
    whole = ranges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(whole["n"], ranges.sparkSession.sparkContext.defaultParallelism), -(-whole["bytes"] // task_bytes))
    return ranges.repartition(tasks).mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """pages(page_id, url, html) -> written as WARC, indexed, read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload. A null url is written as an empty one. Repeated rows give a record each; an empty table
    gives none; other columns are ignored.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    index = write_archives(mark_revisits(pages), folder)
    return read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
