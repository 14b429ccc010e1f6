"""Media columns: MPEG audio.

Bytes are carried in a real MPEG-2 layer III stream: an ID3v2 tag, a frame with a variable-bitrate
table (``Xing``), and frames of 576 samples at 16 kHz mono, 144 kbit/s. Each frame has its checksum,
empty side information, and 576 payload bytes as ancillary data, one byte a sample. A decoder plays
silence of the right length; ``parse`` gives the payload back.

``parse`` takes any MPEG audio stream of layers I to III. It finds frames by resynchronising: a
sync word counts only if its header is valid and the frame before ended there, or another header
of the same version, layer and sampling rate stands where the frame ends (or the stream ends
there). So sync words in the payload, runs of byte 255 among them, do not count.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, text_or_empty

SAMPLES = 576
#: Fixed values of the format: kbit/s by index for (MPEG-1, layer) and (MPEG-2 and 2.5, layer).
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Fixed values of the format: of layer II, (subbands, bits of an allocation) in turn, by allocation table.
ALLOCATIONS = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "low": ((4, 4), (7, 3), (19, 2)),
}


@dataclass(frozen=True, slots=True)
class Header:
    version: int  # the two version bits: 3 is MPEG-1, 2 MPEG-2, 0 MPEG-2.5
    layer: int
    checked: bool
    kbits: int
    rate: int
    mono: bool
    size: int  # bytes of the frame
    samples: int

    @property
    def side(self) -> int:
        """Bytes of side information of layer III."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


_headers: dict[bytes, Header | None] = {}


def header(word: bytes) -> Header | None:
    """The header in these four bytes; None if they are none. Free-format frames are not taken."""
    if word in _headers:
        return _headers[word]
    out = None
    if len(word) == 4 and word[0] == 255 and word[1] & 0xE0 == 0xE0:
        version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
        index, rate = word[2] >> 4, word[2] >> 2 & 3
        if version != 1 and layer != 4 and index not in (0, 15) and rate != 3 and word[3] & 3 != 2:
            kbits, hertz, pad = BITRATES[1 if version == 3 else 2, layer][index], RATES[version][rate], word[2] >> 1 & 1
            samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
            size = (12000 * kbits // hertz + pad) * 4 if layer == 1 else samples * 125 * kbits // hertz + pad
            out = Header(version, layer, not word[1] & 1, kbits, hertz, word[3] >> 6 == 3, size, samples)
    if len(_headers) < 100_000:
        _headers[word] = out
    return out


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        table.append(c)
    return table


_CRC = _crc_table()
_crcs: dict[bytes, int] = {}


def crc16(covered: bytes) -> int:
    """The checksum of MPEG audio: polynomial 0x8005, start 0xFFFF, most significant bit first."""
    if covered in _crcs:
        return _crcs[covered]
    c = 0xFFFF
    for b in covered:
        c = (c << 8 ^ _CRC[c >> 8 ^ b]) & 0xFFFF
    if len(_crcs) < 10_000:
        _crcs[covered] = c
    return c


def crc16_bits(data: bytes, bits: int, start: int) -> int:
    """The checksum of the first ``bits`` bits of ``data``, going on from ``start``."""
    c = start
    for k in range(bits):
        top = c >> 15 ^ data[k >> 3] >> (7 - (k & 7)) & 1
        c = (c << 1 ^ 0x8005 if top else c << 1) & 0xFFFF
    return c


def _shared_from(word: bytes, subbands: int) -> tuple[int, int]:
    """(channels, the first subband whose allocation is shared by both) of layers I and II."""
    mode, extension = word[3] >> 6, word[3] >> 4 & 3
    if mode == 3:
        return 1, subbands
    return 2, min(subbands, 4 * (extension + 1)) if mode == 1 else subbands


def _widths(h: Header, channels: int) -> list[int]:
    """Bits of the allocation of each subband of a layer II frame."""
    each, name = h.kbits // channels, "low"
    if h.version == 3:
        if h.rate == 48000 and each >= 56 or 56 <= each <= 80:
            name = "a"
        elif each >= 96:
            name = "b"
        else:
            name = "d" if h.rate == 32000 else "c"
    return [bits for n, bits in ALLOCATIONS[name] for _ in range(n)]


def checksum(frame: bytes, h: Header) -> int | None:
    """What the checksum of this frame has to be; None if the frame is too short for what it covers.

    It covers half of the header and, after the checksum itself, the side information (layer III), the
    allocations (layer I), or the allocations and the choices of scale factors (layer II).
    """
    start = crc16(frame[2:4])
    body = frame[6:]
    if h.layer == 3:
        bits = 8 * h.side
    elif h.layer == 1:
        channels, shared = _shared_from(frame, 32)
        bits = 4 * (channels * shared + 32 - shared)
    else:
        channels = _shared_from(frame, 32)[0]
        widths = _widths(h, channels)
        _, shared = _shared_from(frame, len(widths))
        value, at, used = int.from_bytes(body[:64], "big"), 0, 0
        for k, width in enumerate(widths):
            copies = channels if k < shared else 1
            for _ in range(copies):
                found = value >> (8 * len(body[:64]) - at - width) & (1 << width) - 1 if 8 * len(body[:64]) >= at + width else 0
                used += (found > 0) * (1 if k < shared else channels)
                at += width
        bits = at + 2 * used
    return crc16_bits(body, bits, start) if 8 * len(body) >= bits else None


#: MPEG-2, layer III, checksum, 144 kbit/s, 16 kHz, mono.
_WORD = bytes([0xFF, 0xF2, 0xD8, 0xC0])
_HEAD = header(_WORD)
_FRONT = _WORD + struct.pack(">H", crc16(_WORD[2:] + bytes(_HEAD.side))) + bytes(_HEAD.side)


def _syncsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def encode(data: bytes) -> bytes:
    """A stream that carries ``data``, padded with bytes 255 to a positive multiple of 576."""
    n = max(1, -(-len(data) // SAMPLES))
    body = np.zeros((n + 1, _HEAD.size), np.uint8)
    body[:, : len(_FRONT)] = np.frombuffer(_FRONT, np.uint8)
    payload = np.full(n * SAMPLES, 255, np.uint8)
    payload[: len(data)] = np.frombuffer(data, np.uint8)
    body[1:, len(_FRONT) : len(_FRONT) + SAMPLES] = payload.reshape(n, SAMPLES)
    total = (n + 1) * _HEAD.size
    toc = bytes(min(255, (k * n // 100 + 1) * 256 // (n + 1)) for k in range(100))
    table = b"Xing" + struct.pack(">III", 7, n, total) + toc
    # The table stands where the side information ends; with a checksum, two bytes later.
    body[0, len(_FRONT) : len(_FRONT) + len(table)] = np.frombuffer(table, np.uint8)
    said = b"\x03n_bytes\x00" + str(len(data)).encode()
    frame = b"TXXX" + _syncsafe(len(said)) + b"\x00\x00" + said
    return b"ID3\x04\x00\x00" + _syncsafe(len(frame)) + frame + body.tobytes()


@dataclass
class Stream:
    """What ``parse`` finds. ``offsets`` are the frames' byte positions, for seeking: frame k starts
    at sample k * samples a frame. The frame with the table carries no sound and is not among them; what it says of
    the encoder's delay and padding is no sound either and not in the duration. ``wrong`` counts checksums of any
    layer that don't fit. ``agrees``: the table's frames, bytes and seek points are those found, within a frame."""

    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, object] = field(default_factory=dict)
    checked: int = 0
    wrong: int = 0
    skipped: int = 0
    agrees: bool = False
    payload: bytes = b""

    @property
    def duration(self) -> Fraction:
        silent = int(self.table.get("delay", 0)) + int(self.table.get("padding", 0))
        return Fraction(max(0, self.samples - silent), self.rate) if self.rate else Fraction(0)


_ENCODINGS = {0: "latin-1", 1: "utf-16", 2: "utf-16-be"}


def _id3(data: bytes, tags: dict[str, str]) -> int:
    """Read an ID3v2 tag (2.2 to 2.4) at the start; the bytes it takes, with its footer."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    safe = lambda raw: sum((b & 127) << 7 * k for k, b in enumerate(reversed(raw)))
    version, flags = data[3], data[5]
    size = safe(data[6:10])
    total = min(len(data), 10 + size + (10 if version == 4 and flags & 16 else 0))
    body = data[10 : min(len(data), 10 + size)]
    if flags & 128 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    at = 0
    if flags & 64 and version > 2 and len(body) >= 4:  # an extended header; its size counts itself in 2.4
        at = safe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    name, front = (3, 6) if version == 2 else (4, 10)
    while at + front <= len(body) and body[at : at + name].strip(b"\0"):
        raw = body[at + name : at + 2 * name]
        n = safe(raw) if version == 4 else int.from_bytes(raw, "big")
        value = body[at + front : at + front + n]
        if version == 4 and body[at + 9] & 2:
            value = value.replace(b"\xff\x00", b"\xff")
        key = body[at : at + name].decode("latin-1")
        at += front + n
        if not value or key[0] != "T":
            continue
        text = value[1:].decode(_ENCODINGS.get(value[0], "utf-8"), "replace")
        if key in ("TXXX", "TXX"):
            said, _, text = text.partition("\0")
            key = f"TXXX:{said}"
        tags[key] = text.lstrip("\ufeff").rstrip("\0")
    return total


def _table(frame: bytes, h: Header) -> dict[str, object]:
    """The variable-bitrate table in a frame; empty if it has none."""
    for at in (4 + h.side, 6 + h.side):
        if frame[at : at + 4] in (b"Xing", b"Info"):
            flags, at, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], at = int.from_bytes(frame[at : at + 4], "big"), at + 4
            if flags & 4:
                out["toc"], at = list(frame[at : at + 100]), at + 100
            at += 4 if flags & 8 else 0
            if frame[at : at + 4] in (b"LAME", b"Lavf", b"Lavc") and len(frame) >= at + 24:
                both = int.from_bytes(frame[at + 21 : at + 24], "big")
                out |= {"delay": both >> 12, "padding": both & 4095}
            return out | {"kind": "Xing"}
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        delay, _, size, count, entries, scale, width, each = struct.unpack(">HHIIHHHH", frame[42:62])
        steps = [scale * int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width], "big") for k in range(entries)]
        return {"kind": "VBRI", "bytes": size, "frames": count, "delay": delay, "steps": steps, "frames_per_step": each}
    return {}


def _agrees(s: Stream, start: int, end: int, longest: int) -> bool:
    """Whether the table says what was found between its own frame at ``start`` and ``end``."""
    table, n = s.table, len(s.offsets)
    if not n or table.get("frames", n) != n or abs(table.get("bytes", end - start) - (end - start)) > longest:
        return False
    if "steps" in table:
        at, sums = s.offsets[0], []
        for step in table["steps"]:
            at += step
            sums.append(at)
        ends = [*s.offsets, end]
        return all(abs(x - ends[min(n, (k + 1) * table["frames_per_step"])]) <= longest for k, x in enumerate(sums))
    unit = (end - start) / 256
    return all(abs(start + x * unit - s.offsets[k * n // 100]) <= longest + unit for k, x in enumerate(table.get("toc", ())))


def parse(data: bytes) -> Stream:
    """Parse any bytes; those that belong to no frame and no tag are counted in ``skipped``."""
    out = Stream()
    at = _id3(data, out.tags)
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        out.tags["ID3v1"] = data[end + 3 : end + 33].split(b"\0")[0].decode("latin-1").strip()
    parts, kind, first, synced, start, longest = [], None, True, False, at, 0
    while at < end:
        h = header(data[at : at + 4])
        ok = h is not None and at + h.size <= end and kind in (None, (h.version, h.layer, h.rate))
        if ok and not synced and at + h.size < end:
            follow = header(data[at + h.size : at + h.size + 4])
            ok = follow is not None and (follow.version, follow.layer, follow.rate) == (h.version, h.layer, h.rate)
        if not ok:
            near = data.find(b"\xff", at + 1, end)
            near = end if near < 0 else near
            out.skipped += near - at
            at, synced = near, False
            continue
        kind = (h.version, h.layer, h.rate)
        out.rate = h.rate
        front = 4
        if h.checked:
            front = 6
            out.checked += 1
            if h.layer == 3:
                right = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side])
            else:
                right = checksum(data[at : at + h.size], h)
            out.wrong += right != int.from_bytes(data[at + 4 : at + 6], "big")
        longest = max(longest, h.size)
        if first and (found := _table(data[at : at + h.size], h)):
            out.table, start = found, at
        else:
            out.offsets.append(at)
            out.samples += h.samples
            parts.append(data[at + front + h.side : at + front + h.side + min(h.samples, h.size - front - h.side)])
        first, synced = False, True
        at += h.size
    out.payload = b"".join(parts)
    out.agrees = bool(out.table) and _agrees(out, start, end, longest)
    return out


def features(s: Stream) -> str:
    """Exact facts of a parsed stream, one string: counts, duration, levels of the payload, seek points."""
    x = np.frombuffer(s.payload, np.uint8).astype(np.int64) - 128
    n = max(1, len(x))
    mean, power = int(x.sum()), int((x * x).sum())
    cross = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    seek = ",".join(str(s.offsets[k * len(s.offsets) // 4]) for k in range(4)) if s.offsets else ""
    return (
        f"frames={len(s.offsets)};samples={s.samples};rate={s.rate};duration={s.duration};checked={s.checked};wrong={s.wrong};"
        f"skipped={s.skipped};table={int(s.agrees)};mean={mean / n:.6f};power={power / n:.6f};crossings={cross};seek={seek}"
    )


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each text stored as an MPEG audio stream. A null or empty text has one frame of padding."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        media = [encode(x) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=[id_col, "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col), text_or_empty(text_col).cast("binary").alias("t")), each, f"`{id_col}` {kind}, media binary")


def parsed_column(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, n_bytes, payload, duration_s, rate, n_frames, offsets, tags, checked, wrong, skipped, feature) for each
    stored stream. Bytes without a frame give no offsets, rate 0 and duration 0; a null is empty."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [parse(x or b"") for x in batch.column(1).to_pylist()]
        columns = [
            batch.column(0),
            pa.array([int(v) if (v := s.tags.get("TXXX:n_bytes", "")).isdigit() else None for s in found], pa.int64()),
            pa.array([s.payload for s in found], pa.binary()),
            pa.array([float(s.duration) for s in found], pa.float64()),
            pa.array([s.rate for s in found], pa.int32()),
            pa.array([len(s.offsets) for s in found], pa.int64()),
            pa.array([s.offsets for s in found], pa.list_(pa.int64())),
            pa.array([list(s.tags.items()) for s in found], pa.map_(pa.string(), pa.string())),
            pa.array([s.checked for s in found], pa.int64()),
            pa.array([s.wrong for s in found], pa.int64()),
            pa.array([s.skipped for s in found], pa.int64()),
            pa.array([features(s) for s in found], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[id_col, *names])

    names = ["n_bytes", "payload", "duration_s", "rate", "n_frames", "offsets", "tags", "checked", "wrong", "skipped", "feature"]
    kinds = ["long", "binary", "double", "int", "long", "array<long>", "map<string,string>", "long", "long", "long", "string"]
    kind = media.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{a} {b}" for a, b in zip(names, kinds, strict=True))
    return map_arrow(media.select(id_col, F.col(media_col).cast("binary").alias("m")), each, schema)


def media_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of the query: stores each text, reads the stored bytes back, describes both."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1).to_pylist():
            media = encode(text)
            s = parse(media)
            rows.append(
                (int(s.tags["TXXX:n_bytes"]), len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(s), float(s.duration), s.offsets, list(s.tags.items()))
            )
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
        kinds += [pa.list_(pa.int64()), pa.map_(pa.string(), pa.string())]
        columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_s", "offsets", "tags"]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_s double"
    schema += ", offsets array<long>, tags map<string,string>"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_or_empty("text").cast("binary").alias("t")), each, schema)
