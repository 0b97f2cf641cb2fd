"""WARC archives: writing, and reading back by boundary-chain verification.

Writers are tasks: each writes real ``.warc`` files of bounded size to the shared
folder, so archives can be read by any WARC tool. Readers split the files by byte
range. A task emits, for every record magic that starts in its range, the offset
of the magic and of the record that would follow it. Magic may also stand inside
a payload, so candidates prove nothing alone: pointer jumping from the start of
each file keeps just the records that the chain of true boundaries reaches.

The reader takes WARC 1.0 and 1.1, headers of any length, records of any type (only HTTP ones have
headers of their own before the payload), digests of other algorithms than
SHA-256, in hexadecimal or base 32, and files that are compressed record by record (``.gz``). Compressed
offsets can't be found by magic alone, so such a file is read by one task from its start.

Defined results: null html is an empty payload, a null url gives no target URI;
repeated page ids give a record each; with
equal payloads all rows that hold the smallest page_id are responses; rows with
a null page_id in a group refer like others and are never referred to unless
all are null; extra columns are ignored; no rows give no archives. A file whose chain breaks off
gives its records up to there with ``complete`` false; one whose chain reaches nothing gives one row
with a null offset, as does one that holds fewer or more records than its manifest states, if that says how many.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC = b"WARC/1.1\r\n"
#: What the reader looks for; both versions end in it alike.
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
ARCHIVE_BYTES = 256 << 20
SPLIT_BYTES = 8 << 20
#: Headers are read in pieces of so many bytes, until they end.
HEADER_BYTES = 64 << 10
LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI, or the local one of a plain shared path."""
    return pyarrow.fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+:", path) else (pyarrow.fs.LocalFileSystem(), path)


def _plain(path: str) -> str:
    """``file:/x`` as Spark writes it, in the form with an authority."""
    return re.sub(r"^file:/(?!/)", "file:///", path)


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{page_id}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url).encode()
        head.append("WARC-Target-URI: " + uri.decode())
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Payload-Length: {len(payload)}"]
        block = http
    else:
        block = http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return MAGIC + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def plan_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, refers_to, revisit): who stores a payload and who points to it.

    The smallest id of each repeated payload is pre-aggregated by digest. Only
    repeated payloads reach the join, whose other side has unique digests; the
    rows of a very common payload are split by the adaptive skew join.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= least
    first = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("rep_digest"), "first_id")
    # small payloads get keys of their own, else the empty page would be a hot key that joins nothing
    # stored, its size is known when the join is planned: few repeated payloads are broadcast, and html isn't shuffled
    first = common.store(first, "warc-repeated")
    key = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("#"), F.xxhash64("page_id", "url").cast("string")))
    joined = rows.withColumn("key", key).join(first, F.col("key") == F.col("rep_digest"), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records as archives in ``folder``; gives the stored manifest (path, bytes, records).

    A file's name holds its task attempt, so a retried or speculative task never
    touches a file that another attempt's manifest rows may name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, out, path, size, count, part, made = TaskContext.get(), None, "", 0, 0, 0, []
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        for batch in batches:
            for page_id, url, payload, digest, refers_to, revisit in zip(*(c for c in batch.columns)):
                if out is None:
                    path = f"{root}/p{context.partitionId():06d}-{part:04d}-a{context.taskAttemptId()}.warc"
                    out, size, count, part = files.open_output_stream(path), 0, 0, part + 1
                data = build_record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py(), revisit.as_py())
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    out.close()
                    made.append((path, size, count))
                    out = None
        if out is not None:
            out.close()
            made.append((path, size, count))
        prefix = folder[: len(folder) - len(root)] if folder.endswith(root) else ""
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([prefix + p for p, _, _ in made]), pa.array([s for _, s, _ in made], pa.int64()), pa.array([n for _, _, n in made], pa.int64())], names=["path", "bytes", "records"])

    common.bounded_batches(records.sparkSession)
    columns = records.select("page_id", "url", "payload", "digest", "refers_to", "revisit")
    return common.store(columns.mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


def parse_header(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """Header fields (names in lower case) and the first block byte of a record at ``at``; None if it is none."""
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0 or not _MAGIC.match(data, at):
        return None
    fields: dict[str, str] = {}
    name = ""
    for line in data[at + len(MAGIC) : stop].split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and name:  # a folded line goes on
            fields[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        name = key.strip().lower().decode("utf-8", "replace")
        fields.setdefault(name, value.strip().decode("utf-8", "replace"))
    if not fields.get("content-length", "").isdigit():
        return None
    return fields, stop + 4


_CANDIDATE = "path string, bytes long, offset long, successor long, block long, block_bytes long, http boolean, record_type string, record_id string, target_uri string, refers_to string, digest string, payload_length long"


def _candidate(path: str, total: int, at: int, fields: dict[str, str], block: int, successor: int) -> tuple:
    own, kind = fields.get("x-payload-length", ""), fields.get("content-type", "")
    http = kind.lower().replace(" ", "").startswith("application/http")
    return path, total, at, successor, block, int(fields["content-length"]), http, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), fields.get("warc-payload-digest"), int(own) if own.isdigit() else None


def _whole_header(f: pyarrow.NativeFile, at: int, total: int) -> bytes:
    """The bytes from ``at`` on, as many as end a header, if one does."""
    data = b""
    while at + len(data) < total:
        more = f.read_at(min(max(HEADER_BYTES, len(data)), total - at - len(data)), at + len(data))
        seen = max(0, len(data) - 3)
        data += more
        if data.find(b"\r\n\r\n", seen) >= 0 or not more:
            break
    return data


def _members(f: pyarrow.NativeFile, total: int) -> Iterator[tuple[int, int, bytes]]:
    """(offset, end, content) of each gzip member of a file, in order; it ends at the first that is broken."""
    at, held = 0, b""
    while at < total:
        inflate, parts, start = zlib.decompressobj(31), [], at
        try:
            while not inflate.eof:
                if not held:
                    held = f.read_at(min(1 << 20, total - at), at)
                    if not held:
                        return
                parts.append(inflate.decompress(held))
                at += len(held) - len(inflate.unused_data)
                held = inflate.unused_data
        except zlib.error:
            return
        yield start, at, b"".join(parts)


def candidates(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A row for every record magic in the files of (path, bytes): the record that it would begin and its successor.

    Of compressed files the offsets are those of their members; ``block`` counts within the member.
    """
    step = F.when(F.col("path").endswith(".gz"), F.greatest(F.col("bytes"), F.lit(1))).otherwise(F.lit(split_bytes)).cast("long")
    splits = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), step)).alias("start")).where("bytes > 0")
    schema = [c.split()[0] for c in _CANDIDATE.split(", ")]
    kinds = {n: {"long": pa.int64(), "boolean": pa.bool_()}.get(t, pa.string()) for n, t in (c.split() for c in _CANDIDATE.split(", "))}

    def packed(path: str, total: int) -> Iterator[tuple]:
        files, name = _filesystem(_plain(path))
        with files.open_input_file(name) as f:
            for at, end, data in _members(f, total):
                got = parse_header(data, 0)
                if got is None or got[1] + int(got[0]["content-length"]) > len(data):
                    return
                yield _candidate(path, total, at, got[0], got[1], end)

    def scan(path: str, total: int, start: int) -> Iterator[tuple]:
        files, name = _filesystem(_plain(path))
        with files.open_input_file(name) as f:
            end = min(start + split_bytes, total)
            data = f.read_at(min(end + len(MAGIC), total) - start, start)
            for found in _MAGIC.finditer(data):
                at = found.start()
                if at >= end - start:
                    break
                head = data[at : at + HEADER_BYTES]
                if b"\r\n\r\n" not in head:
                    head = _whole_header(f, start + at, total)
                if got := parse_header(head, 0):
                    block = start + at + got[1]
                    successor = block + int(got[0]["content-length"]) + 4
                    if successor <= total:
                        yield _candidate(path, total, start + at, got[0], block, successor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, total, start in zip(*(c.to_pylist() for c in batch.columns)):
                if rows := list(packed(path, total) if path.endswith(".gz") else scan(path, total, start)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for n, c in zip(schema, zip(*rows))], names=schema)

    n = int(splits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return splits.repartition(n, "path", "start").mapInArrow(run, _CANDIDATE)


def reachable(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Which of the (sorted) offsets the chain from offset 0 reaches, by pointer jumping.

    Every pointer doubles its reach in a round, and the reached set follows its
    pointers: after k rounds it holds the first 2^k records of the chain.
    """
    n = len(offsets)
    at = np.searchsorted(offsets, successors)
    jump = np.where((at < n) & (offsets[np.minimum(at, n - 1)] == successors), at, n)
    jump = np.append(jump, n)
    hit = np.zeros(n + 1, bool)
    hit[0] = n > 0 and offsets[0] == 0
    for _ in range(max(1, n).bit_length() + 1):
        hit[jump[hit]] = True
        jump = jump[jump]
    return hit[:n]


def verified(found: DataFrame) -> DataFrame:
    """The candidates that are records. ``complete``: the file's chain ends at its last byte.

    Candidates meet by file; a file has a bounded size, so a group has too.
    """

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset", ignore_index=True)
        rows = rows[reachable(rows["offset"].to_numpy(), rows["successor"].to_numpy())]
        return rows.assign(complete=bool(len(rows)) and rows["successor"].iloc[-1] == rows["bytes"].iloc[-1])

    return found.groupBy("path").applyInPandas(keep, _CANDIDATE + ", complete boolean")


_READ = "path string, offset long, complete boolean, record_type string, record_id string, target_uri string, refers_to string, digest string, payload_bytes long, payload_digest string"


class Digest:
    """The digests of a payload: SHA-256, and the stated one if its algorithm is known."""

    def __init__(self, stated: str | None):
        self.ours, self.theirs, self.want = hashlib.sha256(), None, None
        label, colon, value = (stated or "").partition(":")
        kind = label.strip().lower().replace("-", "")
        if colon and kind in ("sha256", "sha1", "md5", "sha512"):
            self.theirs, self.want = hashlib.new(kind), value.strip()

    def update(self, data: bytes) -> None:
        self.ours.update(data)
        if self.theirs:
            self.theirs.update(data)

    def agrees(self) -> bool:
        """Whether the payload has the stated digest, where that can be told. Both writings occur."""
        if not self.theirs:
            return True
        raw = self.theirs.digest()
        return self.want.lower() == raw.hex() or self.want.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Every record of the archives in (path, bytes), its payload read and digested.

    A revisit stores no payload: its length and digest are those that its header states. A column
    ``records`` of the manifest, if there, is held against what each file gives.
    """
    names = [c.split()[0] for c in _READ.split(", ")]

    def payload(read, block: int, n: int, http: bool, digest: Digest) -> int:
        """HTTP headers go; the rest is hashed piece by piece."""
        size, held, inside = 0, b"", not http
        for at in range(block, block + n, SPLIT_BYTES):
            held += read(min(SPLIT_BYTES, block + n - at), at)
            if not inside and (stop := held.find(b"\r\n\r\n")) >= 0:
                held, inside = held[stop + 4 :], True
            if inside:
                digest.update(held)
                size, held = size + len(held), b""
        return size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, f = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                own = (r["digest"] or "").partition(":")
                size, digest = r["payload_length"], own[2].lower() if own[0].lower() in ("sha256", "sha-256") else None
                if r["record_type"] != "revisit":
                    if opened != r["path"]:
                        files, name = _filesystem(_plain(r["path"]))
                        opened, f = r["path"], files.open_input_file(name)
                    read = lambda n, at, f=f: f.read_at(n, at)
                    if r["path"].endswith(".gz"):
                        member = zlib.decompress(f.read_at(r["successor"] - r["offset"], r["offset"]), 31)
                        read = lambda n, at, member=member: member[at : at + n]
                    got = Digest(r["digest"])
                    size = payload(read, r["block"], r["block_bytes"], r["http"], got)
                    if not got.agrees():
                        raise ValueError(f"payload digest differs: {r['path']} at {r['offset']}")
                    digest = got.ours.hexdigest()
                rows.append((r["path"], r["offset"], r["complete"], r["record_type"], r["record_id"], r["target_uri"], r["refers_to"], r["digest"], size, digest))
            if rows:
                kinds = {"offset": pa.int64(), "payload_bytes": pa.int64(), "complete": pa.bool_()}
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(k, pa.string())) for k, c in zip(names, zip(*rows))], names=names)

    spark = manifest.sparkSession
    records = common.store(verified(candidates(manifest, split_bytes)), "warc-records")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = records.repartition(n, "path", F.floor(F.col("offset") / split_bytes)).sortWithinPartitions("path", "offset")
    # files that give nothing, or another number of records than stated
    stated = F.col("records").cast("long") if "records" in manifest.columns else F.lit(None).cast("long")
    found = records.groupBy(F.col("path").alias("found")).agg(F.count("*").alias("n"))
    files = manifest.where("bytes > 0").select("path", stated.alias("stated")).join(found, F.col("path") == F.col("found"), "left")
    wrong = files.where(F.col("n").isNull() | (F.col("stated") != F.col("n")))
    null = [F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in _READ.split(", ")[3:])]
    return dealt.mapInArrow(run, _READ).unionByName(wrong.select("path", F.lit(None).cast("long").alias("offset"), F.lit(False).alias("complete"), *null))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back from the archives."""
    pages = common.table(spark, sf_dir, "pages")
    manifest = write_archives(plan_records(pages), common.fresh_path(spark, "warc"))
    back = read_archives(manifest)
    page = lambda c: F.regexp_extract(c, r"<urn:x-page:(-?\d+)>", 1)
    as_id = lambda c: F.when(page(c) != "", page(c).cast("long"))
    return back.select(
        as_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to"), F.assert_true("complete", "an archive's chain breaks off").isNull().alias("chain_complete")
    )


OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)
SELECT page_id, payload_bytes, sha256(body) AS payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to, true AS chain_complete
FROM p
"""
