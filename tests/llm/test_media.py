import hashlib
import struct
import zlib

import numpy as np
import pytest

from lexiloom.llm import media


@pytest.mark.parametrize("frames", [1, 2, 32, 33, 63, 64, 65, 128, 1000])
def test_round_trip(frames):
    payload = np.random.default_rng(frames).integers(0, 256, 64 * frames, dtype=np.uint8).tobytes()
    data = media.write(payload)
    table = media.read(data)
    assert media.payload_of(data, table) == payload
    assert table["codec"] == "raw " and table["duration"] == frames and table["timescale"] == 25
    assert np.flatnonzero(table["key"]).tolist() == list(range(0, frames, 32))
    for i in (0, frames - 1):
        a = table["offset"][i]
        assert data[a : a + 64] == payload[64 * i : 64 * i + 64]


def test_foreign_containers_are_read_too():
    box = lambda kind, body: struct.pack(">I4s", len(body) + 8, kind) + body
    full = lambda kind, body, version=0: box(kind, struct.pack(">I", version << 24) + body)
    entry = box(b"avc1", bytes(78))
    table = b"".join([
        full(b"stsd", struct.pack(">I", 1) + entry), full(b"stts", struct.pack(">3I", 1, 3, 10)), full(b"stsz", struct.pack(">5I", 0, 3, 5, 7, 9)),
        full(b"stsc", struct.pack(">7I", 2, 1, 2, 1, 2, 1, 1)), full(b"co64", struct.pack(">IQQ", 2, 1000, 5000)),
    ])
    mdia = full(b"mdhd", struct.pack(">QQIQI", 0, 0, 600, 30, 0), 1) + box(b"minf", box(b"stbl", table))
    data = struct.pack(">I4sQ", 1, b"free", 16) + box(b"moov", box(b"trak", box(b"mdia", mdia)))
    found = media.read(data)
    assert found["codec"] == "avc1" and found["timescale"] == 600 and found["duration"] == 30
    assert found["offset"].tolist() == [1000, 1005, 5000] and found["size"].tolist() == [5, 7, 9] and found["key"].all()
    with pytest.raises(ValueError):
        list(media.boxes(memoryview(struct.pack(">I4s", 99, b"free"))))
    with pytest.raises(ValueError):
        media.write(b"short")


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind, *parts, version=0, flags=0):
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def trak(number, kind, codecs, sizes, offset, *, stss=None, stts=None, stz2=None, per_chunk=None):
    """A track whose samples lie in one chunk or in chunks of ``per_chunk`` samples at offset, offset + 1000, ..."""
    n, per = len(sizes), per_chunk or max(1, len(sizes))
    chunks = -(-n // per)
    table = [
        full(b"stsd", struct.pack(">I", len(codecs)), *(box(c, bytes(8)) for c in codecs)),
        full(b"stts", struct.pack(">I", len(stts)), *(struct.pack(">2I", *x) for x in stts)) if stts else b"",
        full(b"stsc", struct.pack(">4I", 1, 1, per, 1)) if chunks < 2 or n % per == 0 else full(b"stsc", struct.pack(">7I", 2, 1, per, 1, chunks, n % per, len(codecs))),
        full(b"stco", struct.pack(f">I{chunks}I", chunks, *(offset + 1000 * c for c in range(chunks)))),
    ]
    if n == 0:
        table[2:4] = [full(b"stsc", struct.pack(">I", 0)), full(b"stco", struct.pack(">I", 0))]
    if stz2:
        raw = {4: lambda: bytes(a << 4 | b for a, b in zip(sizes[::2], [*sizes[1::2], 0][: -(-n // 2)], strict=False)), 8: lambda: bytes(sizes), 16: lambda: struct.pack(f">{n}H", *sizes)}[stz2]()
        table.append(full(b"stz2", struct.pack(">2I", stz2, n), raw))
    else:
        table.append(full(b"stsz", struct.pack(f">2I{n}I", 0, n, *sizes)))
    if stss is not None:
        table.append(full(b"stss", struct.pack(f">I{len(stss)}I", len(stss), *stss)))
    mdhd = full(b"mdhd", struct.pack(">4II", 0, 0, 1000, sum(a * b for a, b in stts or []), 0))
    hdlr = full(b"hdlr", bytes(4), kind, bytes(12), b"\0")
    return box(b"trak", full(b"tkhd", struct.pack(">3I", 0, 0, number)), box(b"mdia", mdhd, hdlr, box(b"minf", box(b"stbl", *table))))


def test_tracks_are_kept_apart():
    sound = trak(1, b"soun", [b"mp4a"], [10, 20, 30], 500)
    film = trak(2, b"vide", [b"avc1", b"hvc1"], [5, 6, 7, 8, 9], 9000, stss=[1, 4], stts=[(2, 40), (3, 20)], per_chunk=2)
    for order in ([sound, film], [film, sound]):
        got = {t["track"]: t for t in media.tracks(box(b"ftyp", b"isom") + box(b"moov", *order))}
        assert got[1]["kind"] == "soun" and got[1]["key"].all() and got[1]["offset"].tolist() == [500, 510, 530] and got[1]["durations"].tolist() == [0, 0, 0]
        assert got[2]["codecs"] == ["avc1", "hvc1"] and got[2]["about"].tolist() == [1, 1, 1, 1, 2]
        assert got[2]["offset"].tolist() == [9000, 9005, 10000, 10007, 11000] and np.flatnonzero(got[2]["key"]).tolist() == [0, 3]
        assert got[2]["durations"].tolist() == [40, 40, 20, 20, 20] and got[2]["duration"] == 140
        assert media.read(box(b"moov", *order))["track"] == 2
    assert media.tracks(box(b"free", b"1234")) == [] and media.tracks(b"") == []
    with pytest.raises(ValueError):
        media.read(b"")


@pytest.mark.parametrize("bits", [4, 8, 16])
def test_compact_sizes(bits):
    found = media.tracks(box(b"moov", trak(1, b"vide", [b"raw "], [1, 15, 7], 64, stz2=bits)))[0]
    assert found["size"].tolist() == [1, 15, 7] and found["offset"].tolist() == [64, 65, 80]


def test_fragments():
    trex = full(b"trex", struct.pack(">5I", 7, 1, 33, 100, 0x10000))
    head = box(b"ftyp", b"isom") + box(b"moov", trak(7, b"vide", [b"avc1"], [], 0), box(b"mvex", trex))
    run = full(b"trun", struct.pack(">2Ii", 2, 400, 0), flags=0x5)  # data offset 400, the first one a keyframe
    own = full(b"trun", struct.pack(">5I", 2, 8, 50, 9, 60), flags=0x300)
    moof = box(b"moof", full(b"mfhd", struct.pack(">I", 1)), box(b"traf", full(b"tfhd", struct.pack(">I", 7), flags=0x20000), run, own))
    got = media.tracks(head + moof)[0]
    assert got["offset"].tolist() == [len(head) + 400, len(head) + 500, len(head) + 600, len(head) + 650]
    assert got["size"].tolist() == [100, 100, 50, 60] and got["durations"].tolist() == [33, 33, 8, 9] and got["duration"] == 83
    assert got["key"].tolist() == [True, False, False, False]
    based = full(b"tfhd", struct.pack(">IQ3I", 7, 7000, 5, 11, 0), flags=0x1 | 0x8 | 0x10 | 0x20)
    got = media.tracks(head + box(b"moof", box(b"traf", based, full(b"trun", struct.pack(">I", 3)))))[0]
    assert got["offset"].tolist() == [7000, 7011, 7022] and got["key"].all() and got["duration"] == 15


def test_describe_has_a_row_for_each_track(spark):
    both = box(b"moov", trak(1, b"soun", [b"mp4a"], [10], 500), trak(2, b"vide", [b"avc1"], [5, 6], 9000, stss=[2], stts=[(2, 40)]))
    df = spark.createDataFrame([(1, 3, bytearray(both)), (None, None, None), (2, 0, bytearray(b""))], "doc_id long, n_bytes long, media binary")
    got = {(r.doc_id, r.track): r for r in media.describe(df).collect()}
    assert set(got) == {(1, 1), (1, 2), (None, None), (2, None)}
    assert [tuple(k) for k in got[1, 2].keyframes] == [(9005, 9011)] and (got[1, 2].codec, got[1, 2].duration) == ("avc1", 80)


def test_documents(spark):
    texts = {1: "é" * 40, 2: "", 3: None, 4: "x" * 64, 5: "y" * 100_000, 6: "é" * 40}
    df = spark.createDataFrame([*((k, t, b"q") for k, t in texts.items()), (None, "n", b"q")], "doc_id long, text string, media binary")
    stored = media.store(df, each=2).cache()
    out = {r.doc_id: r for r in media.digests(stored).collect()}
    for k, t in texts.items():
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = out[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert out[1][1:] == out[6][1:] and None in out
    kept = {r.doc_id: r for r in stored.select("doc_id", "media").collect()}
    assert all(out[k].media_sha256 == hashlib.sha256(kept[k].media).hexdigest() and out[k].media_bytes == len(kept[k].media) for k in texts)
    rows = {r.doc_id: r for r in media.describe(stored).collect()}
    assert rows[5].frames == rows[5].duration == 1563 and len(rows[5].keyframes) == 49 and rows[5].keyframes[0].end - rows[5].keyframes[0].start == 64
    assert media.digests(media.store(df.limit(0))).isEmpty() and media.describe(stored.limit(0)).isEmpty()


def test_damaged_containers_have_a_reason(spark):
    whole = media.write(bytes(range(64)) * 3)
    data = [whole, whole[:40], whole[: len(whole) // 2], b"", None, b"\0\0\0\x08free", whole.replace(b"stsz", b"skip"), whole.replace(b"mdhd", b"skip")]
    table = spark.createDataFrame([(i, 192, d) for i, d in enumerate(data)], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in media.describe(table).collect()}
    assert len(got) == len(data) and got[0].reason is None and got[0].frames == 3
    assert all(got[i].reason and got[i].track is None for i in range(1, len(data)))
    assert [got[i].reason for i in (3, 4, 5)] == ["empty", "empty", "no track"]
    back = {r.doc_id: r for r in media.digests(table).collect()}
    assert back[0].payload_bytes == 192 and back[7].payload_bytes is None and back[7].feature.startswith("damaged")
