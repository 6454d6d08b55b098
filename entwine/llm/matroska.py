"""Media columns in Matroska: EBML elements, clusters, lacing and cues as packet tables.

``mux`` stores bytes as 8-bit PCM samples in a Matroska file and ``demux`` parses
such a file (any track kind): variable-length element ids and sizes, unknown-size
segments and clusters, simple blocks and block groups, all four lacings, cues.
A packet has a track, a timestamp, a key flag and the byte range of its frame.

A null or empty text is padded like any other.  Texts of any length are stored
whole.  Equal texts give equal files.  Repeated rows give repeated results and an
empty table an empty one.  Only the id and text columns are read.  Damaged files
raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from entwine.llm.common import Scratch, task

FRAME = 192  # samples of a packet; one millisecond at RATE
RATE = 192_000.0
FRAME_NS = 1_000_000
BLOCK_FRAMES, CLUSTER_BLOCKS = 8, 32

# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
DEFAULT_DURATION, BLOCK_DURATION = 0x23E383, 0x9B
SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


def write_size(n: int) -> bytes:
    """Shortest variable-length size; all ones is reserved for unknown."""
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(id_: int, body: bytes) -> bytes:
    return id_.to_bytes((id_.bit_length() + 7) // 8, "big") + write_size(len(body)) + body


def unsigned(id_: int, n: int) -> bytes:
    return element(id_, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def real(id_: int, x: float) -> bytes:
    return element(id_, struct.pack(">d", x))


def lace(frames: list[bytes], lacing: int) -> bytes:
    """Frame count, sizes and frames of a block after its flags."""
    if lacing == NO_LACING:
        (only,) = frames
        return only
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames[:-1]]
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes)
    elif lacing == EBML_LACING and sizes:
        head += write_size(sizes[0])
        for a, b in zip(sizes, sizes[1:], strict=False):
            width, d = 1, b - a
            while not -((1 << 7 * width - 1) - 1) <= d <= (1 << 7 * width - 1) - 1:
                width += 1
            head += (d + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    return head + b"".join(frames)


_HEAD = element(EBML, unsigned(0x4286, 1) + unsigned(0x42F7, 1) + unsigned(0x42F2, 4) + unsigned(0x42F3, 8) + element(0x4282, b"matroska") + unsigned(0x4287, 4) + unsigned(0x4285, 2))
_TRACKS = element(
    TRACKS,
    element(TRACK_ENTRY, unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + unsigned(FLAG_LACING, 1) + unsigned(DEFAULT_DURATION, FRAME_NS) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, real(SAMPLING, RATE) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))),
)


def mux(payload: bytes) -> bytes:
    """A Matroska file of one 8-bit PCM track; ``payload`` is a multiple of FRAME bytes."""
    if not payload or len(payload) % FRAME:
        raise ValueError("the payload is no positive multiple of a frame")
    frames = len(payload) // FRAME
    info = element(INFO, unsigned(SCALE, 1_000_000) + real(DURATION, float(frames)) + element(MUXING_APP, b"entwine") + element(WRITING_APP, b"entwine"))
    parts, cues, at = [info, _TRACKS], [], len(info) + len(_TRACKS)
    for c in range(0, frames, BLOCK_FRAMES * CLUSTER_BLOCKS):
        stamp = unsigned(TIMESTAMP, c)
        blocks = []
        for b in range(c, min(frames, c + BLOCK_FRAMES * CLUSTER_BLOCKS), BLOCK_FRAMES):
            n = min(BLOCK_FRAMES, frames - b)
            lacing = FIXED if n > 1 else NO_LACING
            body = payload[b * FRAME : (b + n) * FRAME]
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b - c, 0x80 | lacing << 1) + (bytes([n - 1]) if n > 1 else b"") + body))
        cluster = element(CLUSTER, stamp + b"".join(blocks))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, c) + element(CUE_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER, at) + unsigned(CUE_RELATIVE, len(stamp)))))
        parts.append(cluster)
        at += len(cluster)
    return _HEAD + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


def read_id(data: bytes, at: int) -> tuple[int, int]:
    if at >= len(data) or not data[at]:
        raise ValueError("bad element id")
    width = 9 - data[at].bit_length()
    return int.from_bytes(data[at : at + width], "big"), at + width


def read_size(data: bytes, at: int) -> tuple[int, int]:
    """(size, place after it); -1 is unknown."""
    if at >= len(data) or not data[at]:
        raise ValueError("bad element size")
    width = 9 - data[at].bit_length()
    n = int.from_bytes(data[at : at + width], "big") ^ 1 << 7 * width
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width


@dataclass
class Media:
    """What ``demux`` found; packets hold (track, time in nanoseconds, key, lacing, cluster, offset, size)."""

    scale: int = 1_000_000
    duration: float = 0.0
    tracks: list[dict] = field(default_factory=list)
    packets: list[tuple[int, int, bool, int, int, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    segment: int = 0


def _children(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    while at < end:
        id_, body = read_id(data, at)
        size, body = read_size(data, body)
        stop = end if size < 0 else body + size
        if stop > end:
            raise ValueError("an element ends after its parent")
        yield id_, body, stop
        at = stop


def _uint(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def _float(data: bytes, at: int, end: int) -> float:
    return struct.unpack(">f" if end - at == 4 else ">d", data[at:end])[0] if end > at else 0.0


def _block(data: bytes, at: int, end: int, base: int, key: bool | None, cluster: int, span: int | None, out: list) -> None:
    """Frames of a block as (track, ticks, frame number, frames, ticks of the whole block or None, key, lacing, cluster, offset, size)."""
    track, p = read_size(data, at)
    if p + 3 > end:
        raise ValueError("a block ends in its header")
    when, flags = struct.unpack_from(">hB", data, p)
    p += 3
    lacing = flags >> 1 & 3
    key = bool(flags & 0x80) if key is None else key
    if lacing == NO_LACING:
        out.append((track, base + when, 0, 1, span, key, lacing, cluster, p, end - p))
        return
    n, p = data[p] + 1, p + 1
    if lacing == FIXED:
        size, odd = divmod(end - p, n)
        if odd:
            raise ValueError("fixed lacing does not divide its block")
        sizes = [size] * n
    else:
        sizes = []
        for i in range(n - 1):
            if lacing == XIPH:
                size = 0
                while data[p] == 255:
                    size, p = size + 255, p + 1
                size, p = size + data[p], p + 1
            else:
                v, q = read_size(data, p)
                size = v if i == 0 else sizes[-1] + v - ((1 << 7 * (q - p) - 1) - 1)
                p = q
            sizes.append(size)
        sizes.append(end - p - sum(sizes))
        if min(sizes) < 0:
            raise ValueError("laced frames are longer than their block")
    for i, size in enumerate(sizes):
        out.append((track, base + when, i, n, span, key, lacing, cluster, p, size))
        p += size


def _timed(m: Media, frames: list) -> list[tuple[int, int, bool, int, int, int, int]]:
    """Packets in nanoseconds.  A laced frame follows its forerunner by the track's default duration, else by its share of the block's.

    Where neither is known the frames of a block share its time.
    """
    known = {t.get("number"): t["frame_ns"] for t in m.tracks if t.get("frame_ns")}
    out = []
    for track, ticks, i, n, span, *rest in frames:
        step = known.get(track) or (span * m.scale // n if span is not None else 0)
        out.append((track, ticks * m.scale + i * step, *rest))
    return out


def _track(data: bytes, at: int, end: int) -> dict:
    got: dict = {}
    for id_, a, e in _children(data, at, end):
        if id_ == TRACK_NUMBER:
            got["number"] = _uint(data, a, e)
        elif id_ == TRACK_TYPE:
            got["type"] = _uint(data, a, e)
        elif id_ == CODEC_ID:
            got["codec"] = data[a:e].decode()
        elif id_ == DEFAULT_DURATION:
            got["frame_ns"] = _uint(data, a, e)
        elif id_ == AUDIO:
            for i, x, y in _children(data, a, e):
                if i == SAMPLING:
                    got["rate"] = _float(data, x, y)
                elif i == CHANNELS:
                    got["channels"] = _uint(data, x, y)
                elif i == BIT_DEPTH:
                    got["bits"] = _uint(data, x, y)
    return got


def _cue(data: bytes, at: int, end: int, out: list) -> None:
    time = 0
    for id_, a, e in _children(data, at, end):
        if id_ == CUE_TIME:
            time = _uint(data, a, e)
        elif id_ == CUE_POSITIONS:
            got = {i: _uint(data, x, y) for i, x, y in _children(data, a, e)}
            out.append((time, got.get(CUE_TRACK, 0), got.get(CUE_CLUSTER, 0), got.get(CUE_RELATIVE, 0)))


def demux(data: bytes) -> Media:
    """Parse a Matroska file."""
    m, frames = Media(), []
    at = 0
    id_, body = read_id(data, at)
    if id_ != EBML:
        raise ValueError("no EBML head")
    size, body = read_size(data, body)
    id_, at = read_id(data, body + size)
    if id_ != SEGMENT:
        raise ValueError("no segment")
    size, at = read_size(data, at)
    m.segment, end = at, len(data) if size < 0 else at + size
    if end > len(data):
        raise ValueError("the segment is cut off")
    while at < end:
        start = at
        id_, at = read_id(data, at)
        size, at = read_size(data, at)
        stop = at + size
        if size >= 0 and stop > end:
            raise ValueError("an element ends after its parent")
        if id_ == CLUSTER:
            m.clusters.append(start)
            stop = end if size < 0 else stop
            base = 0
            while at < stop:
                i, body = read_id(data, at)
                if size < 0 and i in TOP_LEVEL:
                    break  # a cluster of unknown size ends at the next top-level element
                n, body = read_size(data, body)
                e = body + n
                if i == TIMESTAMP:
                    base = _uint(data, body, e)
                elif i == SIMPLE_BLOCK:
                    _block(data, body, e, base, None, start, None, frames)
                elif i == BLOCK_GROUP:
                    inner = list(_children(data, body, e))
                    span = next((_uint(data, x, y) for j, x, y in inner if j == BLOCK_DURATION), None)
                    for j, x, y in inner:
                        if j == BLOCK:
                            _block(data, x, y, base, all(k != REFERENCE for k, _, _ in inner), start, span, frames)
                at = e
            continue
        if size < 0:
            raise ValueError("only segments and clusters may have an unknown size")
        if id_ == INFO:
            for i, a, e in _children(data, at, stop):
                if i == SCALE:
                    m.scale = _uint(data, a, e)
                elif i == DURATION:
                    m.duration = _float(data, a, e)
        elif id_ == TRACKS:
            m.tracks += [_track(data, a, e) for i, a, e in _children(data, at, stop) if i == TRACK_ENTRY]
        elif id_ == CUES:
            for i, a, e in _children(data, at, stop):
                if i == CUE_POINT:
                    _cue(data, a, e, m.cues)
        at = stop
    m.packets = _timed(m, frames)
    return m


def _pad(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (FRAME - len(raw) % FRAME if len(raw) % FRAME or not raw else 0)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in range(0, b.num_rows, 512):
            part = b.slice(s, 512)
            rows = [_pad(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([n for n, _ in rows], pa.int64()), pa.array([mux(p) for _, p in rows], pa.binary())], names=["doc_id", "n_bytes", "media"])


_PACKET = pa.struct([("track", pa.int64()), ("timestamp_ns", pa.int64()), ("key", pa.bool_()), ("lacing", pa.int32()), ("cluster_offset", pa.int64()), ("offset", pa.int64()), ("size", pa.int64())])
_CUE = pa.struct([("timestamp_ns", pa.int64()), ("track", pa.int64()), ("cluster_offset", pa.int64()), ("found", pa.bool_())])
_PARSED = "packets array<struct<track:long,timestamp_ns:long,key:boolean,lacing:int,cluster_offset:long,offset:long,size:long>>, cues array<struct<timestamp_ns:long,track:long,cluster_offset:long,found:boolean>>"


def _listed(rows: list[list[tuple]], of: pa.StructType) -> pa.Array:
    flat = list(zip(*(r for part in rows for r in part), strict=True)) or [[]] * of.num_fields
    items = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, of, strict=True)], fields=list(of))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), items)


def _parse(media_at: int, names: list[str]):
    """Rows with a file to the same rows with its packets and cues; a null file has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                packets, cues = [], []
                for blob in part.column(media_at):
                    m = Media() if not blob.is_valid else demux(blob.as_py())
                    starts = set(m.clusters)
                    packets.append(m.packets)
                    cues.append([(t * m.scale, track, m.segment + c, m.segment + c in starts) for t, track, c, _ in m.cues])
                yield pa.RecordBatch.from_arrays([*part.columns, _listed(packets, _PACKET), _listed(cues, _CUE)], names=names)

    return run


def parse_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """``media`` with two more columns: ``packets`` (track, time, key flag, lacing, cluster, byte range) and ``cues``."""
    schema = StructType([*media.schema.fields, *StructType.fromDDL(_PARSED).fields])
    return media.mapInArrow(task(_parse(media.columns.index(media_col), schema.fieldNames())), schema)


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet: track, timestamp_ns, key, lacing, cluster_offset, offset, size; a null file has none."""
    rows = media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).cast("binary").alias("media"))
    return parse_media(rows).select("doc_id", F.inline("packets"))


def feature(times: np.ndarray, clusters: np.ndarray, cues: list[bool], payload: bytes) -> str:
    """Counts and times of a file's packets and whole-number statistics of its samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    even = bool((np.diff(times) == FRAME_NS).all())
    return (
        f"packets={len(times)};clusters={len(np.unique(clusters))};cues={len(cues)};cues_ok={int(all(cues))};ms={(int(times[-1]) + FRAME_NS) // 1_000_000};even={int(even)};"
        f"sum={int(x.sum())};energy={int((x * x).sum())};steps={int(np.abs(np.diff(x)).sum())};peak={int(x.max())}"
    )


def _fields(column: pa.ListArray, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """(where each row's items begin, the items' fields) of a column of struct lists."""
    at, items = column.offsets.to_numpy(), column.flatten()
    return at - at[0], [items.field(n).to_numpy(zero_copy_only=False) for n in names]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_bytes, media, packets, cues) to features; the payload is read by the packets' byte ranges."""
    for b in batches:
        rows = []
        at, (times, clusters, offsets, sizes) = _fields(b.column(3), "timestamp_ns", "cluster_offset", "offset", "size")
        cue_at, (found,) = _fields(b.column(4), "found")
        ranges = list(zip(offsets.tolist(), (offsets + sizes).tolist(), strict=True))
        for i, media in enumerate(b.column(2)):
            data, p, z = media.as_py(), int(at[i]), int(at[i + 1])
            payload = b"".join([data[x:y] for x, y in ranges[p:z]])
            said = feature(times[p:z], clusters[p:z], found[cue_at[i] : cue_at[i + 1]].tolist(), payload)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), said))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def store_media(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` and the ``media`` column of every text."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(task(_store), "doc_id long, n_bytes long, media binary")


def media_features(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as media in the scratch folder, read it back, parse it to its packet table and describe it through that."""
    scratch = Scratch(documents.sparkSession, "matroska")
    stored = scratch.put("media", store_media(documents, id_col, text_col), compression="zstd")
    return parse_media(stored).mapInArrow(task(_features), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
