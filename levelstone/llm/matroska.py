"""Matroska columns: payloads stored as 8-bit PCM tracks, and files read back as packet tables.

The reader walks EBML elements of variable-length ids and sizes (unknown sizes included), clusters, simple blocks and
block groups, all four kinds of lacing, and cues. The writer makes one 8-bit audio track: frames of ``FRAME`` samples,
up to ``LACED`` frames in a block (equal frames by fixed lacing, others by EBML lacing), ``CLUSTER`` frames in a
cluster, and a cue for each cluster. Bytes depend on the payload alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, ship, text_of

RATE, FRAME, LACED, CLUSTER, ALIGN = 8000, 1024, 8, 64, 64

# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, ENTRY, CLUSTER_ID, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
SCALE, DURATION, NUMBER, KIND, CODEC, AUDIO, SAMPLING, CHANNELS, DEPTH = 0x2AD7B1, 0x4489, 0xD7, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIME, SIMPLE, GROUP, BLOCK, POINT, CUE_TIME, CUE_TRACKS, CUE_TRACK, CUE_CLUSTER = 0xE7, 0xA3, 0xA0, 0xA1, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
UID, LACING, VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOCTYPE, DOC_VERSION, DOC_READ, MUXER, WRITER = 0x73C5, 0x9C, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285, 0x4D80, 0x5741
MASTERS = {EBML, SEGMENT, INFO, TRACKS, ENTRY, AUDIO, CLUSTER_ID, GROUP, CUES, POINT, CUE_TRACKS}
#: Elements that may stand where an element of unknown size ends.
TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER_ID, CUES, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367}


def vint(value: int, length: int = 0) -> bytes:
    """A size as a variable-length integer of the least length, or of the given one."""
    n = length or next(k for k in range(1, 9) if value < (1 << 7 * k) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def read_vint(data, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """(value, next place) of a variable-length integer; None for the value that means unknown."""
    first = data[at]
    if not first:
        raise ValueError(f"no variable-length integer at byte {at}")
    n = 9 - first.bit_length()
    if at + n > len(data):
        raise ValueError("the file ends inside an integer")
    value = int.from_bytes(data[at : at + n], "big")
    if not keep_marker:
        value &= (1 << 7 * n) - 1
        if value == (1 << 7 * n) - 1:
            return None, at + n
    return value, at + n


def laced(frames: list[bytes], kind: int) -> bytes:
    """A block's lace header and frames; kind: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    body = b"".join(frames)
    if kind == 0:
        return body
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == 3:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            n = next(k for k in range(1, 9) if abs(b - a) < 1 << 7 * k - 1)
            head += vint(b - a + (1 << 7 * n - 1) - 1, n)
    return head + body


def lace_sizes(data, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Frame sizes of a block whose lace header begins at ``at``, and where the frames begin."""
    if kind == 0:
        return [end - at], at
    n, at = data[at] + 1, at + 1
    if kind == 2:
        if (end - at) % n:
            raise ValueError("fixed lacing doesn't part the block evenly")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for i in range(n - 1):
        if kind == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        elif i == 0:
            size, at = read_vint(data, at)
        else:
            before = at
            step, at = read_vint(data, at)
            size = sizes[-1] + (step if step is not None else (1 << 7 * (at - before)) - 1) - ((1 << 7 * (at - before) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames are larger than their block")
    return sizes, at


def mux(payload: bytes) -> bytes:
    """A file with ``payload`` as the samples of one 8-bit mono track."""
    head = element(EBML, b"".join((number(VERSION, 1), number(READ_VERSION, 1), number(MAX_ID, 4), number(MAX_SIZE, 8), element(DOCTYPE, b"matroska"), number(DOC_VERSION, 4), number(DOC_READ, 2))))
    info = element(INFO, number(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(MUXER, b"pcm8") + element(WRITER, b"pcm8"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(DEPTH, 8))
    tracks = element(TRACKS, element(ENTRY, number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    parts, at, cues = [info, tracks], len(info) + len(tracks), []
    for first in range(0, len(payload), FRAME * CLUSTER):
        time = first * 1000 // RATE
        body = [number(TIME, time)]
        for start in range(first, min(first + FRAME * CLUSTER, len(payload)), FRAME * LACED):
            stop = min(start + FRAME * LACED, first + FRAME * CLUSTER, len(payload))
            frames = [payload[i : min(i + FRAME, stop)] for i in range(start, stop, FRAME)]
            kind = 0 if len(frames) == 1 else 2 if len(frames[-1]) == FRAME else 3
            body.append(element(SIMPLE, b"\x81" + struct.pack(">hB", start * 1000 // RATE - time, 0x80 | kind << 1) + laced(frames, kind)))
        parts.append(element(CLUSTER_ID, b"".join(body)))
        cues.append(element(POINT, number(CUE_TIME, time) + element(CUE_TRACKS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


@dataclass
class Media:
    """What a file holds; a packet: track, timestamp in ns, cluster, frame in its block, first byte, byte after the last, key."""

    doctype: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict = field(default_factory=dict)
    packets: list = field(default_factory=list)
    cues: list = field(default_factory=list)
    clusters: list = field(default_factory=list)


def _unsigned(data, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data, a: int, b: int) -> float:
    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b - a in (4, 8) else 0.0


def demux(data: bytes) -> Media:
    """Read a file. ValueError if it isn't Matroska or breaks off inside an element."""
    media, at = Media(), 0
    open_: list[tuple[int, int, bool]] = []  # masters that hold this place: id, end, unknown size
    track: dict = {}
    cue: dict = {}
    cluster_time, segment = 0, 0
    while at < len(data):
        while open_ and at >= open_[-1][1]:
            open_.pop()
        begin = at
        kind, at = read_vint(data, at, True)
        size, at = read_vint(data, at)
        if kind in TOP:
            while open_ and open_[-1][2] and (open_[-1][0] != SEGMENT or kind in (SEGMENT, EBML)):
                open_.pop()
        end = at + size if size is not None else (open_[-1][1] if open_ else len(data))
        if end > len(data):
            raise ValueError(f"element {kind:#x} at byte {begin} ends after the file")
        if not open_ and begin == 0 and kind != EBML:
            raise ValueError("not an EBML file")
        if kind in MASTERS:
            open_.append((kind, end, size is None))
            if kind == SEGMENT:
                segment = at
            elif kind == ENTRY:
                track = {}
            elif kind == CLUSTER_ID:
                media.clusters.append(begin)
            elif kind == POINT:
                cue = {}
            continue
        if size is None:
            raise ValueError(f"element {kind:#x} has no size")
        if kind in (SIMPLE, BLOCK):
            number_, p = read_vint(data, at)
            offset, flags = struct.unpack_from(">hB", data, p)
            lace = flags >> 1 & 3
            sizes, p = lace_sizes(data, p + 3, end, lace)
            known = media.tracks.get(number_, {})
            for i, n in enumerate(sizes):
                media.packets.append((number_, cluster_time + offset, len(media.clusters) - 1, i, p, p + n, bool(flags & 0x80) or kind == BLOCK, known))
                p += n
        elif kind == DOCTYPE:
            media.doctype = data[at:end].rstrip(b"\0").decode("ascii", "replace")
        elif kind == SCALE:
            media.scale = _unsigned(data, at, end)
        elif kind == DURATION:
            media.duration = _float(data, at, end)
        elif kind == TIME:
            cluster_time = _unsigned(data, at, end)
        elif kind == NUMBER:
            media.tracks[_unsigned(data, at, end)] = track
        elif kind in (KIND, CHANNELS, DEPTH):
            track[{KIND: "kind", CHANNELS: "channels", DEPTH: "depth"}[kind]] = _unsigned(data, at, end)
        elif kind == SAMPLING:
            track["rate"] = _float(data, at, end)
        elif kind == CODEC:
            track["codec"] = data[at:end].decode("ascii", "replace")
        elif kind == CUE_TIME:
            cue["time"] = _unsigned(data, at, end)
        elif kind == CUE_TRACK:
            cue["track"] = _unsigned(data, at, end)
        elif kind == CUE_CLUSTER:
            media.cues.append((cue.get("time", 0) * media.scale, cue.get("track", 0), segment + _unsigned(data, at, end)))
        at = end
    done = []
    for number_, time, cluster, i, a, b, key, known in media.packets:
        # frames of one lace follow each other by their own length, where the track says how long a sample lasts
        samples = sum(x[5] - x[4] for x in done[len(done) - i :]) if i else 0
        width = max(1, known.get("depth", 8) // 8) * max(1, known.get("channels", 1))
        late = int(samples / width * 1e9 / known["rate"]) if i and known.get("rate") else 0
        done.append((number_, time * media.scale + late, cluster, i, a, b, key))
    media.packets = done
    if media.doctype not in ("matroska", "webm"):
        raise ValueError("not a Matroska file")
    return media


def payload_of(text: str | bytes) -> bytes:
    raw = text.encode() if isinstance(text, str) else text
    return raw + b"\0" * (max(ALIGN, -(-len(raw) // ALIGN) * ALIGN) - len(raw))


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, media (the file). Null texts are empty; an empty text is stored
    as ``ALIGN`` zero bytes; equal texts make equal files. A null doc_id stays null; other columns are not read."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            raws = [t.encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array([mux(payload_of(r)) for r in raws], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(docs, text).alias("text")).mapInArrow(released(run), "doc_id long, n_bytes long, media binary")


PACKET = "track int, timestamp_ns long, cluster int, frame int, start long, end long, key boolean"


def packets(stored: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """The packet table: a row for each frame of each file, with the byte range it takes in the file, and an ``error``
    row (track null) for a file that can't be read. Null files have no rows."""
    ship(stored.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(k, *p, None) for p in demux(data).packets]
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((k, None, None, None, None, None, None, None, str(e)))
            kinds = [batch.column(0).type, pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            names = ["key_", "track", "timestamp_ns", "cluster", "frame", "start", "end", "key", "error"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    kind = dict(stored.dtypes)[key]
    rows = stored.where(F.col(media).isNotNull()).select(F.col(key).alias("key_"), F.col(media).alias("media"))
    return rows.mapInArrow(released(run), f"key_ {kind}, {PACKET}, error string").withColumnRenamed("key_", key)


def features_of(media: Media, samples: np.ndarray) -> str:
    """Counts of the container and a few measures of the samples, from the bytes read back; those of no samples are 0."""
    x = samples.astype(np.int64) - 128
    n = max(1, len(x))
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    last = max((p[1] for p in media.packets), default=0) // 1_000_000
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};last_ms={last};duration_ms={media.duration:.3f};mean={x.sum() / n:.6f};power={(x * x).sum() / n:.6f};crossings={crossings};peak={int(np.abs(x).max()) if len(x) else 0}"


def read_back(stored: DataFrame) -> DataFrame:
    """Rows of ``store`` read back through the packet table: payload, its digests and features, one row for each stored one.

    Null and empty texts have a payload of ``ALIGN`` zero bytes; equal texts, equal values; a null doc_id stays null; repeated
    rows stay repeated; an empty table gives no rows. A file that can't be read is an error, since ``store`` wrote it;
    ``packets`` reports such files as rows.
    """
    ship(stored.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(2).to_pylist():
                media = demux(data)
                payload = b"".join([data[a:b] for _, _, _, _, a, b, _ in media.packets])
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(data), hashlib.sha256(data).hexdigest(), features_of(media, np.frombuffer(payload, np.uint8))))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return stored.mapInArrow(released(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
