"""Media columns: ISO media containers, written losslessly and read by their sample tables.

A text's bytes are stored as uncompressed 8-bit samples: a video track of 8 by 8 grey frames, 64 bytes each. The
reader walks the nested boxes track by track, decodes the sample tables and movie fragments, and finds codec, duration
and the byte ranges of keyframes without touching the media data.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import whole_text

FRAME = 64
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
#: Fixed values of the format: the unit matrix of movie and track headers.
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def write(payload: bytes, *, rate: int = 25, per_chunk: int = 64, key_every: int = 32) -> bytes:
    """A container of one track. payload: a positive multiple of 64 bytes."""
    frames = len(payload) // FRAME
    if not frames or len(payload) % FRAME:
        raise ValueError(f"payload isn't a positive multiple of {FRAME} bytes")
    chunks = -(-frames // per_chunk)
    rest = frames - per_chunk * (chunks - 1)
    runs = [(1, rest, 1)] if chunks == 1 else [(1, per_chunk, 1)] if rest == per_chunk else [(1, per_chunk, 1), (chunks, rest, 1)]
    keys = np.arange(1, frames + 1, key_every, dtype=">u4")
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")

    def moov(first: int) -> bytes:
        """first: where the media data begin."""
        wide = first + len(payload) >= 1 << 32
        offsets = (first + FRAME * per_chunk * np.arange(chunks)).astype(">u8" if wide else ">u4")
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">3I", 1, frames, 1)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">3I", *r) for r in runs)),
            _full(b"stsz", struct.pack(">2I", FRAME, frames)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.tobytes()),
        )
        handler = _full(b"hdlr", bytes(4), b"vide", bytes(12), b"samples\0")
        where = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        media = _box(b"mdia", _full(b"mdhd", struct.pack(">4I2H", 0, 0, rate, frames, 0x55C4, 0)), handler, _box(b"minf", _full(b"vmhd", bytes(8), flags=1), where, table))
        track = _full(b"tkhd", struct.pack(">5I", 0, 0, 1, 0, frames), bytes(8), struct.pack(">4H", 0, 0, 0, 0), MATRIX, struct.pack(">2I", 8 << 16, 8 << 16), flags=3)
        movie = _full(b"mvhd", struct.pack(">4IIH", 0, 0, rate, frames, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", movie, _box(b"trak", track, media))

    long = len(payload) + 8 >= 1 << 32
    before = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if long else struct.pack(">I4s", len(payload) + 8, b"mdat")
    size = len(head) + len(moov(0)) + len(before)
    return head + moov(size) + before + payload


def boxes(data: memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = (), *, nested: bool = True) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body's start, body's end) of every box, depth first; only of those side by side if not ``nested``."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} at {start} exceeds its parent")
        yield (*path, kind), body, stop
        if nested and kind in NESTED:
            yield from boxes(data, body, stop, (*path, kind))
        start = stop


def _under(data: memoryview, a: int, b: int) -> dict[bytes, list[tuple[int, int]]]:
    """Bodies of the boxes in one box's body, by kind, in order."""
    out: dict[bytes, list[tuple[int, int]]] = {}
    for path, start, stop in boxes(data, a, b, nested=False):
        out.setdefault(path[-1], []).append((start, stop))
    return out


def _down(data: memoryview, at: tuple[int, int], *path: bytes) -> dict[bytes, list[tuple[int, int]]]:
    """What lies in the first box of each kind of ``path``, one inside the other; nothing where one is missing."""
    for kind in path:
        found = _under(data, *at).get(kind)
        if not found:
            return {}
        at = found[0]
    return _under(data, *at)


def _table(data: memoryview, at: tuple[int, int] | None, width: int = 1, each: str = ">u4", skip: int = 8) -> np.ndarray:
    """The rows of a table whose count stands before them; none if there is no such box."""
    if at is None:
        return np.zeros((0, width), dtype=np.int64)
    n = struct.unpack_from(">I", data, at[0] + skip - 4)[0]
    return np.frombuffer(data[at[0] + skip : at[1]], dtype=each, count=n * width).astype(np.int64).reshape(n, width)


def _sizes(data: memoryview, table: dict) -> np.ndarray:
    """Sample sizes, from stsz or from stz2 with 4, 8 or 16 bits each."""
    if b"stsz" in table:
        size, n = struct.unpack_from(">2I", data, table[b"stsz"][0][0] + 4)
        return np.full(n, size, dtype=np.int64) if size else _table(data, table[b"stsz"][0], skip=12)[:, 0]
    if b"stz2" not in table:
        return np.zeros(0, dtype=np.int64)
    a, b = table[b"stz2"][0]
    bits, n = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
    if bits == 16:
        return np.frombuffer(data[a + 12 : b], dtype=">u2", count=n).astype(np.int64)
    raw = np.frombuffer(data[a + 12 : b], dtype=np.uint8)
    if bits == 4:
        raw = np.stack([raw >> 4, raw & 15], axis=1).ravel()
    return raw[:n].astype(np.int64)


def _samples(data: memoryview, table: dict) -> dict[str, np.ndarray]:
    """Each sample's place, size, duration, description and whether it is a keyframe, from the tables of one track."""
    sizes, n = _sizes(data, table), 0
    first = lambda kind: table[kind][0] if kind in table else None
    chunks = _table(data, first(b"co64"), each=">u8")[:, 0] if b"co64" in table else _table(data, first(b"stco"))[:, 0]
    runs, n = _table(data, first(b"stsc"), 3), len(sizes)
    per_chunk, about = (np.repeat(runs[:, k], np.diff(np.append(runs[:, 0], len(chunks) + 1))) for k in (1, 2))
    of = np.repeat(np.arange(len(chunks)), per_chunk)
    if len(of) != n:
        raise ValueError(f"{n} samples, but the chunks hold {len(of)}")
    before = np.cumsum(sizes) - sizes
    head = (np.cumsum(per_chunk) - per_chunk)[of]
    steps = _table(data, first(b"stts"), 2)
    duration = np.repeat(steps[:, 1], steps[:, 0])
    duration = np.append(duration, np.zeros(max(0, n - len(duration)), dtype=np.int64))[:n]
    key = np.full(n, b"stss" not in table)
    marked = _table(data, first(b"stss"))[:, 0] - 1
    key[marked[marked < n]] = True
    return {"offset": chunks[of] + before - before[head] if n else sizes, "size": sizes, "duration": duration, "about": about[of], "key": key}


def _fragments(data: memoryview, top: dict, defaults: dict[int, tuple]) -> dict[int, list[dict[str, np.ndarray]]]:
    """By track id: the samples of each run in the movie fragments. defaults: of each track, from trex."""
    out: dict[int, list[dict[str, np.ndarray]]] = {}
    for a, b in top.get(b"moof", []):
        end = None
        for traf in _under(data, a, b).get(b"traf", []):
            inside = _under(data, *traf)
            at = inside[b"tfhd"][0][0]
            flags, track = struct.unpack_from(">2I", data, at)
            flags, at = flags & 0xFFFFFF, at + 8
            about, duration, size, marks = defaults.get(track, (1, 0, 0, 0))
            base = a - 8 if flags & 0x20000 or end is None else end
            if flags & 1:
                base, at = struct.unpack_from(">Q", data, at)[0], at + 8
            fields = []
            for bit, known in ((2, about), (8, duration), (0x10, size), (0x20, marks)):
                if flags & bit:
                    known, at = struct.unpack_from(">I", data, at)[0], at + 4
                fields.append(known)
            about, duration, size, marks = fields
            end = base
            for start, _ in inside.get(b"trun", []):
                flags, n = struct.unpack_from(">2I", data, start)
                flags, start = flags & 0xFFFFFF, start + 8
                if flags & 1:
                    end, start = base + struct.unpack_from(">i", data, start)[0], start + 4
                first_marks = None
                if flags & 4:
                    first_marks, start = struct.unpack_from(">I", data, start)[0], start + 4
                given = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
                rows = np.frombuffer(data[start:], dtype=">u4", count=n * len(given)).astype(np.int64).reshape(n, len(given))
                column = lambda bit, otherwise: rows[:, given.index(bit)] if bit in given else np.full(n, otherwise, dtype=np.int64)  # noqa: B023, E731
                sizes, of = column(0x200, size), column(0x400, marks)
                if first_marks is not None and n:
                    of = np.append(first_marks, of[1:])
                run = {"offset": end + np.cumsum(sizes) - sizes, "size": sizes, "duration": column(0x100, duration), "about": np.full(n, about), "key": of & 0x10000 == 0}
                out.setdefault(track, []).append(run)
                end += int(sizes.sum())
    return out


def tracks(media: bytes) -> list[dict]:
    """Every track in its order: track (its id), kind, codecs, codec (the first), timescale, duration, and the samples.

    Of each sample: offset, size, duration, about (the number of its description, from 1) and key. Where a track says
    nothing of keyframes, all samples are. Movie fragments follow what the sample tables hold, and the track's duration
    is then the sum of its samples'. Media data are never read. A container without a movie box has no tracks.
    """
    data = memoryview(media)
    top = _under(data, 0, len(data))
    out = []
    if b"moov" not in top:
        return out
    movie = _under(data, *top[b"moov"][0])
    defaults = {}
    for start, _ in _down(data, top[b"moov"][0], b"mvex").get(b"trex", []):
        track, *rest = struct.unpack_from(">5I", data, start + 4)
        defaults[track] = tuple(rest)
    more = _fragments(data, top, defaults)
    for trak in movie.get(b"trak", []):
        media_boxes, table = _down(data, trak, b"mdia"), _down(data, trak, b"mdia", b"minf", b"stbl")
        head, own = media_boxes[b"mdhd"][0][0], _under(data, *trak).get(b"tkhd")
        timescale, duration = struct.unpack_from(">IQ" if data[head] else ">2I", data, head + (20 if data[head] else 12))
        number = struct.unpack_from(">I", data, own[0][0] + (20 if data[own[0][0]] else 12))[0] if own else len(out) + 1
        kind = bytes(data[media_boxes[b"hdlr"][0][0] + 8 :][:4]).decode("latin-1") if b"hdlr" in media_boxes else None
        codecs = [path[-1].decode("latin-1") for path, _, _ in boxes(data, table[b"stsd"][0][0] + 8, table[b"stsd"][0][1], nested=False)]
        parts = [_samples(data, table), *more.get(number, [])]
        samples = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        samples["durations"] = samples.pop("duration")
        total = int(samples["durations"].sum()) if number in more else duration
        out.append({"track": number, "kind": kind, "codec": codecs[0] if codecs else None, "codecs": codecs, "timescale": timescale, "duration": total, **samples})
    return out


#: What reading a damaged container raises: boxes beyond their parent, tables cut short, boxes that are missing.
DAMAGE = (ValueError, struct.error, KeyError, IndexError, OverflowError, MemoryError)


def readable(media: bytes | None) -> tuple[list[dict], str | None]:
    """(tracks, None), or (none, why there are none)."""
    if not media:
        return [], "empty"
    try:
        found = tracks(media)
    except DAMAGE as e:
        return [], f"damaged: {type(e).__name__} {e}"[:200]
    return found, None if found else "no track"


def read(media: bytes) -> dict:
    """The first video track, or the first of all; see tracks()."""
    found = tracks(media)
    if not found:
        raise ValueError("the container has no track")
    return first_video(found)


def first_video(found: list[dict]) -> dict:
    return next((t for t in found if t["kind"] == "vide"), found[0])


def payload_of(media: bytes, table: dict) -> bytes:
    """The samples' bytes in order; samples that lie together are read at once."""
    offset, end = table["offset"], table["offset"] + table["size"]
    cut = np.flatnonzero(offset[1:] != end[:-1]) + 1
    starts, stops = offset[np.append(0, cut)], end[np.append(cut - 1, len(end) - 1)]
    return b"".join(media[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True))


def store(docs: DataFrame, each: int = 200) -> DataFrame:
    """Each whole text as a container: ``doc_id, n_bytes, media``.

    The bytes are filled up with zeros to a positive multiple of 64. A null text is empty; null and repeated doc_ids
    stay; an empty table gives no rows; other columns aren't read. Output goes out by ``each`` rows.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), each):
                part = batch.iloc[at : at + each]
                raw = [t.encode() for t in part["text"]]
                files = [write(b + bytes(-len(b) % FRAME if b else FRAME)) for b in raw]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "n_bytes": list(map(len, raw)), "media": files})

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInPandas(of, "doc_id long, n_bytes long, media binary")


def describe(media: DataFrame) -> DataFrame:
    """The tracks of ``media``: a row for each, with codec, timescale, duration, frames, keyframes as byte ranges.

    ``media`` (doc_id, n_bytes, media) keeps its columns; ends are exclusive; no payload is decoded. A null container,
    an empty one, one without tracks and a damaged one have one row with nulls, and ``reason`` says why.
    """
    names = ["track", "kind", "codec", "timescale", "duration", "frames", "keyframes", "reason"]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, source = [], []
            for at, data in enumerate(batch["media"]):
                found, reason = readable(data)
                for t in found or [None]:
                    source.append(at)
                    if t is None:
                        rows.append((*(None,) * (len(names) - 1), reason))
                        continue
                    a, size = t["offset"][t["key"]], t["size"][t["key"]]
                    spans = [{"start": s, "end": e} for s, e in zip(a.tolist(), (a + size).tolist(), strict=True)]
                    rows.append((t["track"], t["kind"], t["codec"], t["timescale"], t["duration"], len(t["size"]), spans, None))
            more = pd.DataFrame(rows, columns=names, dtype=object).astype({n: "Int64" for n in ("track", "timescale", "duration", "frames")})
            yield pd.concat([batch.astype({"doc_id": "Int64", "n_bytes": "Int64"}).iloc[source].reset_index(drop=True), more], axis=1)

    return media.mapInPandas(of, "doc_id long, n_bytes long, media binary, track long, kind string, codec string, timescale long, duration long, frames long, keyframes array<struct<start: long, end: long>>, reason string")


def digests(media: DataFrame) -> DataFrame:
    """What is read back from the stored bytes of ``media`` (doc_id, n_bytes, media), as digests, and a feature string.

    feature: codec, duration in seconds, frames, and the keyframes' byte ranges as start+size. Of a container that can't
    be read (see describe()) only its own bytes are digested, and feature is the reason.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, n, data in zip(batch["doc_id"].astype("Int64").array, batch["n_bytes"], batch["media"], strict=True):
                found, reason = readable(data)
                if not found:
                    held = (None, None) if data is None else (len(data), sha256(data).hexdigest())
                    rows.append((doc_id, n, None, None, None, *held, reason))
                    continue
                t = first_video(found)
                back = payload_of(data, t)
                keys = ",".join(f"{a}+{s}" for a, s in zip(t["offset"][t["key"]].tolist(), t["size"][t["key"]].tolist(), strict=True))
                feature = f"{t['codec'].strip()};{t['duration'] / t['timescale']:.2f}s;{len(t['size'])} frames;keys {keys}"
                rows.append((doc_id, n, len(back), sha256(back).hexdigest(), zlib.crc32(back[-FRAME:]), len(data), sha256(data).hexdigest(), feature))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            yield out.astype({n: "Int64" for n in ("doc_id", "n_bytes", "payload_bytes", "tail_crc32", "media_bytes")})

    return media.mapInPandas(of, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
