"""Media columns: ISO base media containers in a binary column.

``encode_media`` wraps a byte payload losslessly as an uncompressed 8-bit video
track (QuickTime codec ``raw ``, grey frames of 64x1 samples). ``index_media``
walks the nested boxes of any ISO media file, decodes its sample tables (those of
movie fragments too) and gives codec, duration and keyframe byte ranges; it never touches the payload.
Boxes are walked by a list of open parents, ``DEPTH`` deep at most, and no table is
believed that its box has no room for.

Defined results: a null payload counts as empty; an empty one is stored as one
zero frame; a file that cannot be walked gives a row with ``error`` set and the
other fields null; rows that repeat are indexed each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FRAME = 64
GOP = 32
TIMESCALE = 25
#: Boxes whose payload is itself a list of boxes (fixed names of the format).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf"}
#: Boxes inside boxes, at most; a deeper file is an error.
DEPTH = 64
#: Output batches are cut at about so many bytes, whatever the input batches hold.
BATCH_BYTES = 8 << 20


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(payload: bytes) -> bytes:
    """The payload with zero bytes up to a positive multiple of a frame."""
    return payload + bytes(-len(payload) % FRAME or (0 if payload else FRAME))


def build_container(payload: bytes) -> bytes:
    """An ISO media file that holds ``payload`` (whole frames) sample by sample."""
    frames = len(payload) // FRAME
    chunks = -(-frames // GOP)
    last = frames - (chunks - 1) * GOP
    runs = [(1, GOP, 1)] if last == GOP or chunks == 1 else [(1, GOP, 1), (chunks, last, 1)]
    if chunks == 1:
        runs = [(1, last, 1)]
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", FRAME, 1, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))

    def moov(first: int) -> bytes:
        offsets = (first + np.arange(chunks, dtype=np.int64) * (GOP * FRAME)).astype(">u8").tobytes()
        keys = (1 + np.arange(0, frames, GOP)).astype(">u4").tobytes()
        stbl = _box(
            b"stbl",
            _full(b"stsd", 0, 0, struct.pack(">I", 1), entry),
            _full(b"stts", 0, 0, struct.pack(">III", 1, frames, 1)),
            _full(b"stss", 0, 0, struct.pack(">I", chunks), keys),
            _full(b"stsc", 0, 0, struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", 0, 0, struct.pack(">II", FRAME, frames)),
            _full(b"co64", 0, 0, struct.pack(">I", chunks), offsets),
        )
        minf = _box(b"minf", _full(b"vmhd", 0, 1, bytes(8)), _box(b"dinf", _full(b"dref", 0, 0, struct.pack(">I", 1), _full(b"url ", 0, 1))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", 1, 0, struct.pack(">QQIQHH", 0, 0, TIMESCALE, frames, 0x55C4, 0)), _full(b"hdlr", 0, 0, bytes(4), b"vide", bytes(12), b"rows\0"), minf)
        tkhd = _full(b"tkhd", 1, 3, struct.pack(">QQIIQ", 0, 0, 1, 0, frames), bytes(16), _MATRIX, struct.pack(">II", FRAME << 16, 1 << 16))
        mvhd = _full(b"mvhd", 1, 0, struct.pack(">QQIQIH", 0, 0, TIMESCALE, frames, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"qt  ")
    lead = len(head) + len(moov(0)) + 16
    return head + moov(lead) + struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) + payload


def walk(data: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int, int]]:
    """Yield (path of names, start, first body byte, end) of every box, nested ones too, in file order."""
    open_ = [(0, len(data), ())]  # where to go on, the parent's end, its path
    while open_:
        start, end, path = open_.pop()
        if start == end:
            continue
        if end - start < 8:
            raise ValueError(f"box header cut at byte {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError(f"long box header cut at byte {start}")
            size, body = struct.unpack_from(">Q", data, body)[0], start + 16
        elif size == 0:
            if path:
                raise ValueError(f"box {kind!r} at byte {start} has no end inside its parent")
            size = end - start
        stop = start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} at byte {start} leaves its parent")
        open_.append((stop, end, path))
        yield (*path, kind), start, body, stop
        if kind in CONTAINERS:
            if len(path) >= DEPTH:
                raise ValueError(f"boxes nest deeper than {DEPTH} at byte {start}")
            open_.append((body, stop, (*path, kind)))


def _table(data: bytes, body: int, stop: int, width: int, skip: int = 4, kind: str = ">u4") -> np.ndarray:
    """The entries of a full box: a count after ``skip`` bytes, then rows of numbers."""
    (n,) = struct.unpack_from(">I", data, body + skip)
    if body + skip + 4 + np.dtype(kind).itemsize * width * n > stop:
        raise ValueError("sample table leaves its box")
    return np.frombuffer(data, kind, n * width, body + skip + 4).reshape(n, width).astype(np.int64)


def _small_sizes(data: bytes, body: int, stop: int) -> np.ndarray:
    """The entries of ``stz2``, of 4, 8 or 16 bits."""
    width, n = data[body + 7], struct.unpack_from(">I", data, body + 8)[0]
    if width not in (4, 8, 16) or body + 12 + (n * width + 7) // 8 > stop:
        raise ValueError("sample table leaves its box")
    if width == 16:
        return np.frombuffer(data, ">u2", n, body + 12).astype(np.int64)
    each = np.frombuffer(data, np.uint8, (n * width + 7) // 8, body + 12).astype(np.int64)
    return each if width == 8 else np.stack([each >> 4, each & 15], axis=1).ravel()[:n]


#: Sample flag of a fragment: the sample depends on others, so it is no keyframe.
_NO_KEY = 0x10000


def _fragment(data: bytes, body: int, stop: int, state: dict) -> None:
    """Decode ``trun``: its samples go to the track, each with place, size, duration and whether it is a keyframe."""
    flags = int.from_bytes(data[body + 1 : body + 4], "big")
    (n,) = struct.unpack_from(">I", data, body + 4)
    at, offset, first = body + 8, None, None
    if flags & 0x1:
        offset, at = struct.unpack_from(">i", data, at)[0], at + 4
    if flags & 0x4:
        first, at = struct.unpack_from(">I", data, at)[0], at + 4
    columns = [name for bit, name in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
    if at + 4 * n * len(columns) > stop or (n > len(data) and not columns):
        raise ValueError("sample table leaves its box")
    rows = np.frombuffer(data, ">u4", n * len(columns), at).reshape(n, len(columns)).astype(np.int64)
    column = lambda name: rows[:, columns.index(name)] if name in columns else np.full(n, state.get(name, 0), np.int64)
    sizes, marks = column("size"), column("flags").copy()
    if first is not None and n:
        marks[0] = first
    start = state["base"] + offset if offset is not None else state["next"]
    state["next"] = start + int(sizes.sum())
    track = state["track"]
    track.setdefault("pieces", []).append((start + np.cumsum(sizes) - sizes, sizes, marks & _NO_KEY == 0))
    track["added"] = track.get("added", 0) + int(column("duration").sum())


def read_tracks(data: bytes) -> list[dict]:
    """Codec, times and sample byte ranges of each track, from its tables and fragments alone."""
    tracks: list[dict] = []
    defaults: dict[int, dict] = {}
    state: dict = {}
    moof = 0
    for path, start, body, stop in walk(data):
        kind = path[-1]
        if kind == b"trak" and b"moov" in path:
            tracks.append({})
        elif kind == b"trex":
            track, _, duration, size, flags = struct.unpack_from(">IIIII", data, body + 4)
            defaults[track] = {"duration": duration, "size": size, "flags": flags}
        elif kind == b"moof":
            moof, state = start, {}
        elif kind == b"tfhd":
            flags, (track,) = int.from_bytes(data[body + 1 : body + 4], "big"), struct.unpack_from(">I", data, body + 4)
            own = next((t for t in tracks if t.get("id") == track), None)
            if own is None:
                raise ValueError(f"a fragment of an unknown track {track}")
            follow = state.get("next", moof)  # without a base of its own it goes on where the last run ended
            state = {**defaults.get(track, {}), "track": own, "base": moof if flags & 0x20000 else follow, "next": follow}
            at = body + 8
            for bit, width, name in ((0x1, 8, "base"), (0x2, 4, None), (0x8, 4, "duration"), (0x10, 4, "size"), (0x20, 4, "flags")):
                if flags & bit:
                    if name:
                        state[name] = int.from_bytes(data[at : at + width], "big")
                    at += width
            if flags & 0x20001:
                state["next"] = state["base"]
        elif kind == b"trun":
            if "track" not in state:
                raise ValueError("a run of samples without a track")
            _fragment(data, body, stop, state)
        if not tracks or b"trak" not in path:
            continue
        t = tracks[-1]
        if kind == b"tkhd":
            (t["id"],) = struct.unpack_from(">I", data, body + (20 if data[body] == 1 else 12))
        elif kind == b"mdhd":
            t["timescale"], t["duration"] = struct.unpack_from(">IQ", data, body + 20) if data[body] == 1 else struct.unpack_from(">II", data, body + 12)
        elif kind == b"hdlr":
            t["handler"] = data[body + 8 : body + 12].decode("latin-1")
        elif kind == b"stsd":
            t["codec"] = data[body + 12 : body + 16].decode("latin-1")
        elif kind == b"stts":
            t["stts"] = _table(data, body, stop, 2)
        elif kind == b"stss":
            t["stss"] = _table(data, body, stop, 1)[:, 0]
        elif kind == b"stsc":
            t["stsc"] = _table(data, body, stop, 3)
        elif kind == b"stsz":
            same, n = struct.unpack_from(">II", data, body + 4)
            if same and n * same > len(data):
                raise ValueError("more samples are stated than the file holds")
            t["sizes"] = np.full(n, same, np.int64) if same else _table(data, body, stop, 1, 8)[:, 0]
        elif kind == b"stz2":
            t["sizes"] = _small_sizes(data, body, stop)
        elif kind == b"stco":
            t["chunks"] = _table(data, body, stop, 1)[:, 0]
        elif kind == b"co64":
            t["chunks"] = _table(data, body, stop, 1, kind=">u8")[:, 0]
    for t in tracks:
        sizes, chunks, runs = t.get("sizes", np.zeros(0, np.int64)), t.get("chunks", np.zeros(0, np.int64)), t.get("stsc", np.zeros((0, 3), np.int64))
        per = np.zeros(len(chunks), np.int64)
        for i, (first, n, _) in enumerate(runs):
            per[first - 1 : runs[i + 1][0] - 1 if i + 1 < len(runs) else None] = n
        if per.sum() != len(sizes):
            raise ValueError("chunks and sample sizes disagree")
        chunk = np.repeat(np.arange(len(chunks)), per)
        before = np.cumsum(sizes) - sizes
        lead = np.cumsum(per) - per
        t["offsets"] = chunks[chunk] + before - before[lead[chunk]] if len(sizes) else sizes
        keys = t["stss"] - 1 if "stss" in t else np.arange(len(sizes))
        for offsets, more, key in t.get("pieces", ()):
            keys = np.r_[keys, len(sizes) + np.flatnonzero(key)]
            sizes, t["offsets"] = np.r_[sizes, more], np.r_[t["offsets"], offsets]
        if t.get("pieces") and not t.get("duration"):
            t["duration"] = t["added"]
        if len(sizes) and (int(t["offsets"].min()) < 0 or int((t["offsets"] + sizes).max()) > len(data)):
            raise ValueError("a sample lies past the end of the file")
        t["sizes"], t["keys"] = sizes, keys
    return tracks


def read_payload(data: bytes, track: dict) -> bytes:
    """The samples of a track, joined; neighbours in the file are read at once."""
    off, size = track["offsets"], track["sizes"]
    if not len(off):
        return b""
    cut = np.flatnonzero(off[1:] != off[:-1] + size[:-1]) + 1
    starts, stops = np.r_[0, cut], np.r_[cut, len(off)]
    return b"".join(data[off[a] : off[b - 1] + size[b - 1]] for a, b in zip(starts, stops))


def _batches(rows: Iterator[tuple], schema: pa.Schema, weigh) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``BATCH_BYTES``, so that one long row never pulls others along."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + weigh(row)
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as the payload of an ISO media file."""
    common.bounded_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), common.text_or_empty(text_col).cast("binary").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            schema = pa.schema([("id", batch.schema.field("id").type), ("n_bytes", pa.int64()), ("media", pa.binary())])
            rows = ((i.as_py(), len(p), build_container(padded(p))) for i, p in ((i, p.as_py()) for i, p in zip(batch["id"], batch["payload"])))
            yield from _batches(rows, schema, lambda r: len(r[2]))

    return source.mapInArrow(run, f"id {kind}, n_bytes long, media binary")


_TRACK = "array<struct<handler:string,codec:string,timescale:long,duration:long,samples:long,keyframes:array<struct<offset:long,length:long>>>>"


def describe(data: bytes, tracks: list[dict] | None = None) -> list[dict]:
    """What ``index_media`` stores for one file."""
    return [
        {
            "handler": t.get("handler"), "codec": t.get("codec"), "timescale": t.get("timescale"), "duration": t.get("duration"), "samples": len(t["sizes"]),
            "keyframes": [{"offset": int(t["offsets"][k]), "length": int(t["sizes"][k])} for k in t["keys"] if 0 <= k < len(t["sizes"])],
        }
        for t in (read_tracks(data) if tracks is None else tracks)
    ]


def index_media(df: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """(id, media_bytes, tracks, error): the index of a media column, payloads unread."""
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    track = pa.list_(pa.struct([("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])))]))

    def one(i, data):
        try:
            return i, len(data or b""), describe(data or b""), None
        except (ValueError, struct.error, IndexError, OverflowError) as e:
            return i, len(data or b""), None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("id", batch.schema.field("id").type), ("media_bytes", pa.int64()), ("tracks", track), ("error", pa.string())])
            yield from _batches((one(i.as_py(), m.as_py()) for i, m in zip(batch["id"], batch["media"])), schema, lambda r: r[1] // 100)

    return source.mapInArrow(run, f"id {kind}, media_bytes long, tracks {_TRACK}, error string")


def feature(tracks: list[dict]) -> str:
    """The index of a file as one line: codec, times, counts and keyframe ranges."""
    t = tracks[0]
    keys = t["keyframes"]
    ranges = b"".join(struct.pack(">QQ", k["offset"], k["length"]) for k in keys)
    return f"{t['handler']}/{t['codec'].strip()} {t['duration']}/{t['timescale']}s samples={t['samples']} keyframes={len(keys)} first={keys[0]['offset']}+{keys[0]['length']} last={keys[-1]['offset']}+{keys[-1]['length']} ranges_crc32={zlib.crc32(ranges)}"


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as media; the stored bytes are read back and described."""
    docs = common.table(spark, sf_dir, "documents")
    media = encode_media(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("doc_id", batch.schema.field("id").type), *((c, pa.int64()) for c in ("n_bytes", "payload_bytes")), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

            def rows(batch=batch):
                for i, n, m in zip(batch["id"], batch["n_bytes"], batch["media"]):
                    data = m.as_py()
                    tracks = read_tracks(data)
                    back = read_payload(data, tracks[0])
                    yield i.as_py(), n.as_py(), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-FRAME:]), len(data), hashlib.sha256(data).hexdigest(), feature(describe(data, tracks))

            yield from _batches(rows(), schema, lambda r: 500)

    kind = media.schema["id"].dataType.simpleString()
    return media.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
