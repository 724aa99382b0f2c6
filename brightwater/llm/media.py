"""ISO media containers as columns: mux, walk, decode sample tables; payloads are never decoded.

``mux`` lays bytes down as 8-bit mono samples (sample entry ``raw ``) in an ISO base media file: 64
bytes, 64 samples of the sound, make one unit of the sample table; 16 units make a chunk, and each
chunk starts with a sync unit. ``tracks_of`` walks the nested boxes of any ISO media file with a stack,
also with 64-bit sizes, boxes up to the end of the file and both versions of the headers, and reads
for each track the handler, all sample entries' codecs, time scale, duration, and from stsz/stz2,
stsc, stco/co64, stts and stss the byte ranges of its chunks and of the keyframes. Fragments add to
their tracks: tfhd and trun (with the defaults of trex) give units, durations and sync flags. Without
a table of sync units all are, and the ranges are those of the chunks. Work and memory go by the size
of the tables in the file, not by the number of units they declare. A box that runs past its parent,
a table that disagrees with another and a unit outside the file are reported in ``error``, not raised.

``media_columns`` adds those as columns to a table of media bytes; ``store_texts`` writes every
text as a container to a Parquet table in the shared folder and gives its features as read back.

Cases. Null text: as empty, payload 64 bytes of 0. Very long texts: whole, with 64-bit offsets where
needed. Null media: all columns null, error "null". Null ids: kept. Repeated rows: a row each. Empty
table: empty result. Extra columns are ignored (texts) or kept (media).
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SharedTables, byte_texts

UNIT, UNITS_PER_CHUNK, RATE = 64, 16, 8000

# Box types that only hold other boxes
CONTAINERS = {b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"mvex", b"moof", b"traf", b"mfra", b"udta"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the unit."""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


_MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def mux(payload: bytes) -> bytes:
    """An ISO media file with ``payload`` (a multiple of 64 bytes) as one track of 8-bit sound."""
    units = len(payload) // UNIT
    chunks = -(-units // UNITS_PER_CHUNK)
    frames = len(payload)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    runs = [(1, UNITS_PER_CHUNK, 1)] if units >= UNITS_PER_CHUNK else []
    if units % UNITS_PER_CHUNK:
        runs.append((chunks, units % UNITS_PER_CHUNK, 1))

    def moov(base: int) -> bytes:
        offsets = [base + i * UNIT * UNITS_PER_CHUNK for i in range(chunks)]
        wide = offsets[-1] >= 1 << 32
        place = full_box(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets))
        stbl = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">III", 1, units, UNIT)),
            full_box(b"stss", struct.pack(f">I{chunks}I", chunks, *range(1, units + 1, UNITS_PER_CHUNK))),
            full_box(b"stsc", struct.pack(f">I{3 * len(runs)}I", len(runs), *[x for r in runs for x in r])),
            full_box(b"stsz", struct.pack(">II", UNIT, units)),
            place,
        )
        dinf = box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1)))
        minf = box(b"minf", full_box(b"smhd", bytes(4)), dinf, stbl)
        long = frames >= 1 << 32  # a duration of 64 bits needs version 1
        times = struct.pack(">QQIQ" if long else ">IIII", 0, 0, RATE, frames)
        mdhd = full_box(b"mdhd", times, struct.pack(">HH", 0x55C4, 0), version=int(long))
        hdlr = full_box(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0")
        tkhd = full_box(b"tkhd", struct.pack(">QQIIQ" if long else ">IIIII", 0, 0, 1, 0, frames), bytes(8), struct.pack(">hhhH", 0, 0, 0x100, 0), _MATRIX, bytes(8), version=int(long), flags=7)
        mvhd = full_box(b"mvhd", times, struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2), version=int(long))
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    head = 8 if len(payload) + 8 < 1 << 32 else 16
    base = len(ftyp) + len(moov(0)) + head
    if base + len(payload) >= 1 << 32:
        base = len(ftyp) + len(moov(1 << 32)) + head
    return ftyp + moov(base) + box(b"mdat", payload)


def walk(data) -> Iterator[tuple[bytes, int, int, int]]:
    """(kind, start, body start, end) of every box, parents first."""
    todo = [(0, len(data))]
    while todo:
        begin, end = todo[-1]
        if begin == end:
            todo.pop()
            continue
        if end - begin < 8:
            raise ValueError(f"{end - begin} stray bytes at {begin}")
        size, kind = struct.unpack_from(">I4s", data, begin)
        head = 8
        if size == 1:
            if end - begin < 16:
                raise ValueError(f"short 64-bit box at {begin}")
            size, head = struct.unpack_from(">Q", data, begin + 8)[0], 16
        elif size == 0:
            size = end - begin
        if size < head or begin + size > end:
            raise ValueError(f"box {kind!r} at {begin} runs past its parent")
        todo[-1] = (begin + size, end)
        yield kind, begin, begin + head, begin + size
        if kind in CONTAINERS:
            todo.append((begin + head, begin + size))


def _numbers(data, at: int, end: int, n: int, kind: str) -> np.ndarray:
    """``n`` big-endian numbers at ``at``, as 64-bit ones."""
    width = np.dtype(kind).itemsize
    if at + n * width > end:
        raise ValueError("a table runs past its box")
    got = np.frombuffer(data, kind, n, at)
    if width == 8 and n and int(got.max()) >> 62:
        raise ValueError("an offset beyond any file")
    return got.astype(np.int64)


def _table(data, box: tuple[int, int], columns: int = 1, kind: str = ">u4") -> np.ndarray:
    """The rows of a counted table behind version and flags."""
    at, end = box
    n = struct.unpack_from(">I", data, at + 4)[0]
    return _numbers(data, at + 8, end, n * columns, kind).reshape(n, columns)


def _sizes(data, kind: bytes, at: int, end: int) -> tuple[int, int, np.ndarray | None]:
    """(number of units, fixed size or 0, sizes)."""
    if kind == b"stsz":
        fixed, n = struct.unpack_from(">II", data, at + 4)
        return n, fixed, None if fixed else _numbers(data, at + 12, end, n, ">u4")
    bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
    if bits not in (4, 8, 16):
        raise ValueError("bad stz2")
    if bits == 4:
        pairs = _numbers(data, at + 12, end, (n + 1) // 2, "u1")
        return n, 0, np.stack([pairs >> 4, pairs & 15], 1).ravel()[:n]
    return n, 0, _numbers(data, at + 12, end, n, "u1" if bits == 8 else ">u2")


class Units:
    """Where the units of a sample table lie, by chunk."""

    def __init__(self, n: int, fixed: int, sizes: np.ndarray | None, runs: np.ndarray, offsets: np.ndarray, length: int):
        chunks = len(offsets)
        first = runs[:, 0] - 1
        if len(runs) and (first[0] != 0 or (np.diff(first) <= 0).any() or first[-1] >= chunks) or (chunks and not len(runs)):
            raise ValueError("chunk runs disagree with the chunk offsets")
        per = np.repeat(runs[:, 1], np.diff(np.append(first, chunks))) if len(runs) else np.zeros(0, np.int64)
        self.begin = np.concatenate([[0], np.cumsum(per)])  # the first unit of each chunk
        total = int(self.begin[-1])
        if total < n or (chunks and total - int(per[-1]) >= n > 0) or (n == 0 and total):
            raise ValueError(f"{n} sizes for {total} units")
        self.begin = np.minimum(self.begin, n)  # the last chunk may end early
        self.offsets, self.fixed = offsets, fixed
        self.until = None if sizes is None else np.concatenate([[0], np.cumsum(sizes)])
        if fixed and n * fixed > length:
            raise ValueError("a unit outside the file")
        self.bytes = self._at(self.begin[1:]) - self._at(self.begin[:-1])
        if ((offsets > length) | (self.bytes > length) | (offsets + self.bytes > length)).any():
            raise ValueError("a unit outside the file")

    def _at(self, unit: np.ndarray) -> np.ndarray:
        return unit * self.fixed if self.until is None else self.until[unit]

    def chunk_ranges(self) -> list[tuple[int, int]]:
        return list(zip(self.offsets.tolist(), self.bytes.tolist(), strict=True))

    def ranges(self, units: np.ndarray) -> list[tuple[int, int]]:
        """(offset, bytes) of the given units."""
        chunk = np.searchsorted(self.begin, units, "right") - 1
        at = self.offsets[chunk] + self._at(units) - self._at(self.begin[chunk])
        return list(zip(at.tolist(), (self._at(units + 1) - self._at(units)).tolist(), strict=True))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Touching ranges as one."""
    out: list[tuple[int, int]] = []
    for at, n in ranges:
        if out and out[-1][0] + out[-1][1] == at:
            out[-1] = (out[-1][0], out[-1][1] + n)
        else:
            out.append((at, n))
    return out


def tracks_of(data) -> list[dict]:
    """For every track: handler, codecs, timescale, duration, units, keyframes, byte ranges of its chunks."""
    tracks: list[dict[bytes, tuple[int, int]]] = []
    defaults: dict[int, tuple[int, int, int]] = {}
    pieces: list[dict] = []  # of fragments
    inside: list[tuple[bytes, int]] = []
    moof = trak_end = 0
    for kind, start, at, end in walk(data):
        while inside and inside[-1][1] <= start:
            inside.pop()
        parent = inside[-1][0] if inside else b""
        if kind == b"trak":
            tracks.append({})
            trak_end = end
        elif kind == b"moof":
            moof = start
        elif kind == b"traf":
            pieces.append({"moof": moof, "first": not any(p["moof"] == moof for p in pieces[-1:]), "runs": []})
        elif kind == b"trex":
            track, _, duration, size, flags = struct.unpack_from(">IIIII", data, at + 4)
            defaults[track] = (duration, size, flags)
        elif parent == b"traf" and kind in (b"tfhd", b"trun"):
            if kind == b"tfhd":
                pieces[-1]["tfhd"] = (at, end)
            else:
                pieces[-1]["runs"].append((at, end))
        elif tracks and start < trak_end:
            tracks[-1].setdefault(kind, (at, end))
        if kind in CONTAINERS:
            inside.append((kind, end))
    out = [_track(data, own) for own in tracks]
    _add_fragments(data, out, defaults, pieces)
    return out


def _track(data, own: dict[bytes, tuple[int, int]]) -> dict:
    for need in (b"mdhd", b"stsd", b"stsc", b"stts"):
        if need not in own:
            raise ValueError(f"a track without {need.decode()}")
    at, _ = own[b"mdhd"]
    scale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    at, end = own[b"stsd"]
    codecs, entry = [], at + 8
    for _ in range(struct.unpack_from(">I", data, at + 4)[0]):
        size, kind = struct.unpack_from(">I4s", data, entry)
        if size < 8 or entry + size > end:
            raise ValueError("a sample entry runs past its box")
        codecs.append(kind.decode("latin-1"))
        entry += size
    kind = b"stsz" if b"stsz" in own else b"stz2"
    place = b"stco" if b"stco" in own else b"co64"
    if kind not in own or place not in own:
        raise ValueError("a track without sizes or chunk offsets")
    n, fixed, sizes = _sizes(data, kind, *own[kind])
    units = Units(n, fixed, sizes, _table(data, own[b"stsc"], 3), _table(data, own[place], 1, ">u4" if place == b"stco" else ">u8")[:, 0], len(data))
    times = _table(data, own[b"stts"], 2)
    if int(times[:, 0].sum()) != n:
        raise ValueError("times and sizes disagree")
    if b"stss" in own:
        sync = _table(data, own[b"stss"])[:, 0]
        if len(sync) and not (1 <= int(sync.min()) and int(sync.max()) <= n):
            raise ValueError("a sync unit that is none")
        keyframes = units.ranges(sync - 1)
    else:
        keyframes = units.chunk_ranges()
    handler = bytes(data[own[b"hdlr"][0] + 8 : own[b"hdlr"][0] + 12]).decode("latin-1") if b"hdlr" in own else ""
    track = 0
    if b"tkhd" in own:
        at, _ = own[b"tkhd"]
        track = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]
    decode = sum(c * d for c, d in times.tolist())
    return {"id": track, "handler": handler, "codec": codecs[0] if codecs else "", "codecs": codecs, "timescale": scale, "duration": duration, "decode_time": decode, "units": n, "keyframes": keyframes, "ranges": units.chunk_ranges()}


# Optional fields of a track run's units and the flags that announce them
_RUN_FIELDS = ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift"))
_NOT_SYNC = 0x10000


def _add_fragments(data, tracks: list[dict], defaults: dict[int, tuple[int, int, int]], pieces: list[dict]) -> None:
    """The units of track fragments, added to their tracks."""
    by_id, behind = {t["id"]: t for t in tracks}, 0
    for piece in pieces:
        if "tfhd" not in piece:
            raise ValueError("a track fragment without tfhd")
        at, _ = piece["tfhd"]
        flags, track = struct.unpack_from(">II", data, at)
        flags &= 0xFFFFFF
        if track not in by_id:
            raise ValueError(f"a fragment of track {track}, which is not there")
        base = piece["moof"] if flags & 0x20000 or piece["first"] else behind
        known = dict(zip(("duration", "size", "flags"), defaults.get(track, (0, 0, 0)), strict=True))
        at += 8
        for bit, name, fmt in ((1, "base", ">Q"), (2, "entry", ">I"), (8, "duration", ">I"), (16, "size", ">I"), (32, "flags", ">I")):
            if flags & bit:
                value = struct.unpack_from(fmt, data, at)[0]
                at += struct.calcsize(fmt)
                if name == "base":
                    base = value
                else:
                    known[name] = value
        own, place = by_id[track], base
        for at, end in piece["runs"]:
            has, n = struct.unpack_from(">II", data, at)
            has, at = has & 0xFFFFFF, at + 8
            if has & 1:
                place = base + struct.unpack_from(">i", data, at)[0]
                at += 4
            first = None
            if has & 4:
                first = struct.unpack_from(">I", data, at)[0]
                at += 4
            fields = [name for bit, name in _RUN_FIELDS if has & bit]
            rows = dict(zip(fields, _numbers(data, at, end, n * len(fields), ">u4").reshape(n, len(fields)).T, strict=True)) if fields else {}
            if "size" not in rows and known["size"] * n > len(data):
                raise ValueError("a unit outside the file")
            until = np.concatenate([[0], np.cumsum(rows["size"])]) if "size" in rows else None
            total = int(until[-1]) if until is not None else known["size"] * n
            if not 0 <= place <= place + total <= len(data):
                raise ValueError("a unit outside the file")
            if "flags" in rows:
                sync = rows["flags"] & _NOT_SYNC == 0
                if first is not None and n:
                    sync[0] = first & _NOT_SYNC == 0
                at_units = np.flatnonzero(sync)
            elif known["flags"] & _NOT_SYNC:
                at_units = np.array([0] if n and first is not None and not first & _NOT_SYNC else [], np.int64)
            else:  # all but the first are sync units
                at_units = None
            if at_units is not None:
                begin = until[at_units] if until is not None else at_units * known["size"]
                size = until[at_units + 1] - begin if until is not None else np.full(len(at_units), known["size"])
                own["keyframes"] += list(zip((place + begin).tolist(), size.tolist(), strict=True))
            elif n:
                skip = int(first is not None and bool(first & _NOT_SYNC))
                gone = (int(until[skip]) if until is not None else known["size"]) if skip else 0
                if n > skip:
                    own["keyframes"].append((place + gone, total - gone))
            own["units"] += n
            own["decode_time"] += int(rows["duration"].sum()) if "duration" in rows else known["duration"] * n
            if n:
                own["ranges"].append((place, total))
            place += total
        behind = place


def feature(tracks: list[dict]) -> str:
    """A compact JSON text: per track codec, time scale, duration, units and keyframe byte ranges."""
    return json.dumps([{"handler": t["handler"], "codec": t["codec"].strip(), "timescale": t["timescale"], "duration": t["duration"], "units": t["units"], "keyframes": [f"{a}+{n}" for a, n in t["keyframes"]]} for t in tracks], separators=(",", ":"))


def demux(data, track: int = 0) -> bytes:
    """The bytes of one track's units, in order."""
    return b"".join(bytes(data[a : a + n]) for a, n in merged(tracks_of(data)[track]["ranges"]))


TRACK = "handler:string,codecs:array<string>,timescale:long,duration:long,units:long,keyframes:array<struct<offset:long,bytes:long>>"
MEDIA_FIELDS = f"struct<codec:string,timescale:long,duration:long,units:long,keyframes:array<struct<offset:long,bytes:long>>,tracks:int,every:array<struct<{TRACK}>>,error:string>"


def media_columns(df: DataFrame, media_col: str = "media", out: str = "media_info") -> DataFrame:
    """Add ``out``: codec, timescale, duration, units and keyframe byte ranges of the first video track (else the first), and of every track."""

    def ranges(t: dict) -> list[dict]:
        return [{"offset": a, "bytes": n} for a, n in t["keyframes"]]

    def one(data) -> dict:
        if data is None:
            return {"error": "null"}
        try:
            tracks = tracks_of(memoryview(bytes(data)))
        except (ValueError, struct.error, IndexError, OverflowError) as e:
            return {"error": str(e)}
        if not tracks:
            return {"tracks": 0, "error": "no track"}
        t = next((t for t in tracks if t["handler"] == "vide"), tracks[0])
        every = [{k: x[k] for k in ("handler", "codecs", "timescale", "duration", "units")} | {"keyframes": ranges(x)} for x in tracks]
        return {k: t[k] for k in ("codec", "timescale", "duration", "units")} | {"keyframes": ranges(t), "tracks": len(tracks), "every": every, "error": None}

    @F.pandas_udf(MEDIA_FIELDS)
    def read(col):
        import pandas as pd

        names = ("codec", "timescale", "duration", "units", "keyframes", "tracks", "every", "error")
        rows = [one(x) for x in col]
        return pd.DataFrame({k: pd.Series([r.get(k) for r in rows], dtype=object) for k in names})

    return df.withColumn(out, read(F.col(media_col)))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tables: SharedTables | None = None) -> DataFrame:
    """Write (doc_id, n_bytes, media) for every text to a Parquet table and return it as read back."""
    tables = tables or SharedTables(docs.sparkSession, "media")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [t or b"" for t in byte_texts(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array([mux(pad(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return tables.write(rows.mapInArrow(write, "doc_id long, n_bytes long, media binary"), "media", "zstd")


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(stored: DataFrame) -> DataFrame:
    """Features of stored containers, all from the bytes read back."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = []
                for data in part.column(2).to_pylist():
                    tracks = tracks_of(data)
                    payload = b"".join([data[a : a + n] for a, n in merged(tracks[0]["ranges"])])
                    rows.append((len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), sha256(data).hexdigest(), feature(tracks)))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.mapInArrow(read, DIGESTS)
