"""Archives and media files as other writers make them."""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct

import numpy as np
import pytest

from rowstrata.llm import media, warc

BODY = b"<p>some words</p>" * 9


def _record(kind="response", version="1.0", body=b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + BODY, content="application/http; msgtype=response", more=(), name="r"):
    head = [f"WARC/{version}", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{name}>", f"Content-Type: {content}", *more, f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _read(spark, tmp_path, files, **more):
    rows = []
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
        rows.append((str(tmp_path / name), len(data), *more.get("records", {}).get(name, ())))
    columns = "path string, bytes long" + (", records long" if "records" in more else "")
    return [r.asDict() for r in warc.read_archives(spark.createDataFrame(rows, columns), split_bytes=5000).collect()]


def test_ordinary_archives(spark, tmp_path):
    sha1 = hashlib.sha1(BODY).digest()
    records = [
        _record("warcinfo", content="application/warc-fields", body=b"software: x\r\n\r\nmore: y\r\n", name="info"),
        _record(more=[f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}"], name="base32"),
        _record(more=[f"WARC-Payload-Digest: sha1:{sha1.hex()}"], name="hex", version="1.1"),
        _record(more=["WARC-Payload-Digest: whirlpool:00"], name="unknown"),
        _record(more=["X-Long: " + "z" * 200_000, " folded"], name="long"),
        _record("resource", content="text/plain", body=b"first\r\n\r\nsecond", name="resource"),
    ]
    whole = b"".join(records)
    got = _read(spark, tmp_path, {"a.warc": whole, "b.warc.gz": b"".join(map(gzip.compress, records))})
    for end in ("a.warc", "b.warc.gz"):
        own = {r["record_id"]: r for r in got if r["path"].endswith(end)}
        assert len(own) == len(records) and all(r["complete"] for r in own.values())
        for name in ("base32", "hex", "unknown", "long"):
            assert own[f"<urn:{name}>"]["payload_digest"] == hashlib.sha256(BODY).hexdigest()
        assert own["<urn:info>"]["payload_bytes"] == 24 and own["<urn:resource>"]["payload_digest"] == hashlib.sha256(b"first\r\n\r\nsecond").hexdigest()


def test_wrong_digests_are_errors(spark, tmp_path):
    with pytest.raises(Exception, match="digest differs"):
        _read(spark, tmp_path, {"a.warc": _record(more=["WARC-Payload-Digest: sha1:" + "A" * 32])})


def test_broken_archives_are_told(spark, tmp_path):
    good = _record(name="good") + _record(name="second")
    files = {"cut.warc": good[:-7], "no.warc": b"nothing at all", "short.warc": good, "cut.warc.gz": gzip.compress(_record()) + b"\x1f\x8b junk", "fine.warc": good}
    got = _read(spark, tmp_path, files, records={"cut.warc": (2,), "no.warc": (None,), "short.warc": (5,), "cut.warc.gz": (None,), "fine.warc": (2,)})
    by = {n: [r for r in got if r["path"].endswith("/" + n)] for n in files}
    assert [(r["offset"], r["complete"]) for r in by["no.warc"]] == [(None, False)]
    assert sorted((r["offset"] is None, r["complete"]) for r in by["cut.warc"]) == [(False, False), (True, False)]
    assert sorted((r["offset"] is None, r["complete"]) for r in by["short.warc"]) == [(False, True), (False, True), (True, False)]
    assert [r["complete"] for r in by["cut.warc.gz"]] == [False]
    assert [r["complete"] for r in by["fine.warc"]] == [True, True]


def test_long_urls_come_back(spark, tmp_path):
    url = "http://host/" + "ü" * 40_000
    data = warc.build_record(1, url, BODY, hashlib.sha256(BODY).hexdigest(), None, False)
    assert [r["target_uri"] for r in _read(spark, tmp_path, {"a.warc": data})] == [url]


# ---- media

f, b = media._full, media._box


def _track(*tables, number=1):
    entry = b("avc1".encode(), bytes(6), struct.pack(">H", 1))
    tkhd = f(b"tkhd", 0, 3, struct.pack(">IIII", 0, 0, number, 0), bytes(64))
    return b(b"trak", tkhd, b(b"mdia", f(b"mdhd", 0, 0, struct.pack(">IIII", 0, 0, 1000, 0)), f(b"hdlr", 0, 0, bytes(4), b"vide", bytes(12)), b(b"minf", b(b"stbl", f(b"stsd", 0, 0, struct.pack(">I", 1), entry), *tables))))


def test_fragments():
    trex = b(b"mvex", f(b"trex", 0, 0, struct.pack(">IIIII", 1, 1, 40, 7, 0x10000)))
    head = b(b"ftyp", b"isom") + b(b"moov", _track(), trex)

    def fragment(sizes, first=True):
        def moof(offset):
            trun = f(b"trun", 0, 0x1 | (0x4 if first else 0) | (0x200 if sizes else 0), struct.pack(">Ii", len(sizes) or 3, offset), struct.pack(">I", 0) if first else b"", struct.pack(f">{len(sizes)}I", *sizes))
            return b(b"moof", f(b"mfhd", 0, 0, bytes(4)), b(b"traf", f(b"tfhd", 0, 0x20000, struct.pack(">I", 1)), trun))

        body = bytes(range(sum(sizes) or 21))
        return moof(len(moof(0)) + 8) + b(b"mdat", body), body

    (one, x), (two, y), (three, z) = fragment([5, 6, 9]), fragment([], first=False), fragment([4])
    data = head + one + two + three
    (t,) = media.read_tracks(data)
    assert t["sizes"].tolist() == [5, 6, 9, 7, 7, 7, 4] and t["keys"].tolist() == [0, 6]
    assert media.read_payload(data, t) == x + y + z
    (d,) = media.describe(data)
    assert (d["codec"], d["samples"], d["duration"]) == ("avc1", 7, 280)
    assert data[d["keyframes"][1]["offset"] :][: d["keyframes"][1]["length"]] == z


@pytest.mark.parametrize("width, packed", [(4, bytes([0x35, 0x20])), (8, bytes([3, 5, 2])), (16, struct.pack(">3H", 3, 5, 2))])
def test_small_sample_sizes(width, packed):
    tables = lambda at: (f(b"stz2", 0, 0, bytes(3), bytes([width]), struct.pack(">I", 3), packed), f(b"stsc", 0, 0, struct.pack(">IIII", 1, 1, 3, 1)), f(b"stco", 0, 0, struct.pack(">II", 1, at)))
    lead = len(b(b"moov", _track(*tables(0)))) + 8
    data = b(b"moov", _track(*tables(lead))) + b(b"mdat", b"0123456789")
    (t,) = media.read_tracks(data)
    assert t["sizes"].tolist() == [3, 5, 2] and media.read_payload(data, t) == b"0123456789"


def test_user_data_may_end_in_zeros():
    data = b(b"moov", _track(), b(b"udta", b(b"name", b"x"), bytes(4)))
    assert len(media.read_tracks(data)) == 1


def test_hostile_files_are_errors_not_crashes(spark):
    deep = b"x"
    for _ in range(3000):
        deep = b(b"moov", deep) if len(deep) < 1 << 20 else deep
    many = b(b"moov", _track(f(b"stsz", 0, 0, struct.pack(">II", 1, 2**32 - 1))))
    large = b(b"moov", _track(f(b"stsz", 0, 0, struct.pack(">II", 0, 2**32 - 1))))
    rows = [(0, bytearray(deep)), (1, bytearray(many)), (2, bytearray(large)), (3, bytearray(media.build_container(bytes(64)))), (4, bytearray(b"\0\0\0\1mdat")), (5, None)]
    got = {r["id"]: r["error"] for r in media.index_media(spark.createDataFrame(rows, "id int, media binary")).collect()}
    assert all(got[i] for i in (0, 1, 2, 4)) and got[3] is None and got[5] is None


def test_walk_names_all_boxes_in_order():
    data = media.build_container(media.padded(b"y" * 500))
    names = [p[-1] for p, *_ in media.walk(data)]
    assert names[:3] == [b"ftyp", b"moov", b"mvhd"] and names[-1] == b"mdat" and np.diff([s for _, s, _, _ in media.walk(data)]).min() > 0
