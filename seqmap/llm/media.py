"""Media columns: payloads stored in MPEG-1 Layer III streams and read back.

The payload rides as ancillary data of silent, checksummed frames (side information zero), so a stream plays as
silence in any decoder and its bytes are exact. A stream is: an ID3v2.3 tag with the payload's size, an information
frame with a variable-bitrate (Xing) table, frames of the highest rate and one last frame of the lowest rate that
holds the rest.

The reader assumes none of that. It takes MPEG-1, 2 and 2.5, Layers I to III and free format: it skips ID3v2 tags of
versions 2 to 4, ID3v1 and APE tags, searches frame headers until one is followed by another (resynchronisation after
junk), parses Xing and VBRI tables, verifies each frame's CRC-16 and keeps exact durations (samples over rate) and the
byte offset of each frame for seeking. The checksum covers the side information in Layer III, the bit allocation in
Layer I, and that and the scale factor selection in Layer II. A stream is of one version, layer and rate. The size of
free-format frames is the distance of the first two headers that agree; a single such frame is junk.

Null texts are empty. An empty text is a payload of 64 zero bytes. Equal texts give equal streams. Extra columns are
ignored and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from seqmap.llm.common import plain, text_of

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_samples long, sample_rate long"
#: kbit/s and Hz by header index: fixed values of the format, of MPEG-1 by layer and of MPEG-2 and 2.5 by layer.
BITRATES_1 = {
    1: (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    2: (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
}
BITRATES_2 = {
    1: (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    3: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
BITRATES = BITRATES_1[3]
RATES = (44100, 48000, 32000)
#: By the header's version bits: what the rates of MPEG-1 are divided by. By its layer bits: the layer.
DIVISOR = {3: 1, 2: 2, 0: 4}
LAYER = {3: 1, 2: 2, 1: 3}
#: Bits of the allocation of each subband in Layer II, as (subbands, bits): fixed values of the format.
ALLOCATION = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "low": ((4, 4), (7, 3), (19, 2)),
}
RATE = 2
SIDE = {True: 17, False: 32}
XING_FRAMES, XING_BYTES, XING_TOC = 1, 2, 4


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def frame_size(bitrate: int, rate: int, pad: int) -> int:
    return 144 * bitrate * 1000 // rate + pad


def _prefix(index: int, protected: bool = True) -> bytes:
    """Header, checksum and silent side information of a mono frame."""
    head = bytes([0xFF, 0xFA if protected else 0xFB, index << 4 | RATE << 2, 0xC0])
    side = bytes(SIDE[True])
    return head + (struct.pack(">H", crc16(head[2:] + side)) if protected else b"") + side


PREFIX = {i: _prefix(i) for i in range(1, len(BITRATES))}
SIZE = {i: frame_size(BITRATES[i], RATES[RATE], 0) for i in PREFIX}
ROOM = {i: SIZE[i] - len(PREFIX[i]) for i in PREFIX}
TOP = max(PREFIX)
INFO = 5


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def encode(payload: bytes) -> bytes:
    room = ROOM[TOP]
    whole, rest = divmod(len(payload), room)
    body = [PREFIX[TOP] + payload[i * room : (i + 1) * room] for i in range(whole)]
    if rest:
        last = min(i for i in ROOM if ROOM[i] >= rest)
        body.append(PREFIX[last] + payload[whole * room :] + bytes(ROOM[last] - rest))
    frames, size = len(body) + 1, SIZE[INFO] + sum(map(len, body))
    at = [0, SIZE[INFO]]
    for f in body:
        at.append(at[-1] + len(f))
    toc = bytes(min(255, at[frames * p // 100] * 256 // size) for p in range(100))
    info = _prefix(INFO, False) + b"Xing" + struct.pack(">III", XING_FRAMES | XING_BYTES | XING_TOC, frames, size) + toc
    own = b"payload\0" + struct.pack(">Q", len(payload))
    tag = b"PRIV" + struct.pack(">IH", len(own), 0) + own
    return b"ID3\x03\0\0" + _synchsafe(len(tag)) + tag + info + bytes(SIZE[INFO] - len(info)) + b"".join(body)


class Head(NamedTuple):
    """A frame header; size is 0 where free format leaves it open, slot is what padding adds."""

    size: int
    rate: int
    protected: bool
    side: int
    samples: int
    layer: int
    divisor: int
    bitrate: int
    pad: int
    mono: bool
    bound: int

    @property
    def kind(self) -> tuple[int, int, int]:
        return self.rate, self.layer, self.divisor


@dataclass
class Stream:
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    data_at: list[int] = field(default_factory=list)
    rate: int = 0
    samples: int = 0
    checked: int = 0
    bad_crc: int = 0
    skipped: int = 0
    tags: list[str] = field(default_factory=list)
    payload_bytes: int | None = None
    vbr: tuple[int, int] | None = None
    toc: bytes = b""
    kind: tuple[int, int, int] | None = None
    per_frame: int = 1152
    free: int = 0

    def seek(self, sample: int) -> int:
        """The offset of the frame that holds a sample."""
        return self.offsets[min(max(sample // self.per_frame, 0), len(self.offsets) - 1)]


_HEADS: dict[bytes, Head | None] = {}
_GOOD: dict[bytes, bool] = {}


def header(head: bytes) -> Head | None:
    if head not in _HEADS:
        if len(_HEADS) > 4096:
            _HEADS.clear()
        _HEADS[head] = _header(head)
    return _HEADS[head]


def _header(head: bytes) -> Head | None:
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    divisor, layer, b, r = DIVISOR.get(head[1] >> 3 & 3), LAYER.get(head[1] >> 1 & 3), head[2] >> 4, head[2] >> 2 & 3
    if divisor is None or layer is None or b == 15 or r == 3:
        return None
    rate, bitrate, mono = RATES[r] // divisor, (BITRATES_1 if divisor == 1 else BITRATES_2)[layer][b], head[3] >> 6 == 3
    samples = 384 if layer == 1 else 576 if layer == 3 and divisor > 1 else 1152
    slot = 4 if layer == 1 else 1
    pad = slot * (head[2] >> 1 & 1)
    size = samples // 8 // slot * bitrate * 1000 // rate * slot + pad if bitrate else 0
    side = 0 if layer < 3 else SIDE[mono] if divisor == 1 else 9 if mono else 17
    bound = 4 * ((head[3] >> 4 & 3) + 1) if head[3] >> 6 == 1 else 32
    return Head(size, rate, not head[1] & 1, side, samples, layer, divisor, bitrate, pad, mono, bound)


def _allocation(h: Head) -> list[int]:
    """Bits of the allocation of each subband of a Layer II frame."""
    if h.divisor > 1:
        name = "low"
    else:
        each = h.bitrate if h.mono else h.bitrate // 2
        few = bool(each) and each <= 48
        name = ("d" if h.rate == 32000 else "c") if few else "a" if h.rate == 48000 or 0 < each <= 80 else "b"
    return [bits for n, bits in ALLOCATION[name] for _ in range(n)]


def _covered_bits(h: Head, body: bytes) -> int:
    """How many bits after the checksum it covers."""
    if h.layer == 3:
        return 8 * h.side
    channels = 1 if h.mono else 2
    if h.layer == 1:
        return 4 * (32 if h.mono else 32 + min(h.bound, 32))
    word, all_bits, at, chosen = int.from_bytes(body[:64], "big"), 8 * min(len(body), 64), 0, 0
    for band, bits in enumerate(_allocation(h)):
        each = 1 if h.mono or band >= h.bound else 2
        for _ in range(each):
            at += bits
            used = at <= all_bits and word >> (all_bits - at) & ((1 << bits) - 1) > 0
            chosen += used * (channels if each == 1 else 1)
    return at + 2 * chosen


def checksum(h: Head, frame: bytes) -> int:
    """The CRC-16 of a protected frame: the header's last two bytes, then what its layer covers, by bits."""
    bits = _covered_bits(h, frame[6:])
    whole, rest = divmod(bits, 8)
    crc = crc16(frame[2:4] + frame[6 : 6 + whole])
    for k in range(rest):
        bit = frame[6 + whole] >> 7 - k & 1 if 6 + whole < len(frame) else 0
        crc = (crc << 1 ^ 0x8005 if (crc >> 15) ^ bit else crc << 1) & 0xFFFF
    return crc


def _good(h: Head, frame: bytes) -> bool:
    key = frame[: 6 + h.side] if h.layer == 3 else frame[:70]
    if key not in _GOOD:
        if len(_GOOD) > 4096:
            _GOOD.clear()
        _GOOD[key] = len(frame) >= 6 and checksum(h, frame) == struct.unpack(">H", frame[4:6])[0]
    return _GOOD[key]


def _free_size(data: bytes, at: int, end: int, h: Head) -> int:
    """The size without padding of free-format frames: the distance to the next header of the same kind that is itself followed by one, or by the end.

    The format does not let free rates pass its highest fixed one, so only that far is searched.
    """
    slot = 4 if h.layer == 1 else 1
    top = (BITRATES_1 if h.divisor == 1 else BITRATES_2)[h.layer][-1]
    nxt, last = at + 4, min(end, at + h.samples // 8 // slot * top * 1000 // h.rate * slot + slot + 1)
    while True:
        nxt = data.find(b"\xff", nxt, last)
        if nxt < 0:
            return 0
        o = header(data[nxt : nxt + 4])
        if o is not None and o.kind == h.kind and not o.bitrate:
            size = nxt - at - h.pad
            after = nxt + size + o.pad
            p = header(data[after : after + 4])
            if after == end or p is not None and p.kind == h.kind and not p.bitrate:
                return size
        nxt += 1


def _tags(data: bytes, out: Stream) -> tuple[int, int]:
    """Reads the tags at both ends; where the audio begins and ends."""
    at, end = 0, len(data)
    synchsafe = lambda b: sum((x & 0x7F) << s for x, s in zip(b, (21, 14, 7, 0)))
    while data[at : at + 3] == b"ID3" and end - at >= 10:
        version, flags, n = data[at + 3], data[at + 5], synchsafe(data[at + 6 : at + 10])
        p, stop = at + 10, min(end, at + 10 + n)
        wide = 3 if version == 2 else 4
        head = 6 if version == 2 else 10
        if flags & 0x40 and version > 2 and p + 4 <= stop:
            p += synchsafe(data[p : p + 4]) if version == 4 else 4 + int.from_bytes(data[p : p + 4], "big")
        while p + head <= stop and data[p]:
            name, raw = data[p : p + wide].decode("latin-1"), data[p + wide : p + 2 * wide]
            size = synchsafe(raw) if version == 4 else int.from_bytes(raw, "big")
            out.tags.append(name)
            own = data[p + head : min(p + head + size, stop)]
            if name == "PRIV" and own[:8] == b"payload\0" and len(own) == 16:
                out.payload_bytes = struct.unpack(">Q", own[8:])[0]
            p += head + size
        at += 10 + n + (10 if flags & 0x10 and version == 4 else 0)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        out.tags.append("TAG")
        end -= 128
    if end - at >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, _, flags = struct.unpack("<III", data[end - 20 : end - 8])
        size += 32 if flags >> 31 else 0
        if 32 <= size <= end - at:
            out.tags.append("APE")
            end -= size
    return at, end


def _table(data: bytes, at: int, h: Head, out: Stream) -> None:
    """The information that a first frame may hold: Xing or Info after the side information, VBRI 32 bytes after the header."""
    p = at + 4 + 2 * h.protected + h.side
    if data[p : p + 4] in (b"Xing", b"Info") and p + 8 <= at + h.size:
        flags = struct.unpack(">I", data[p + 4 : p + 8])[0]
        p, got = p + 8, [0, 0]
        for k, flag in enumerate((XING_FRAMES, XING_BYTES)):
            if flags & flag:
                got[k] = int.from_bytes(data[p : p + 4], "big")
                p += 4
        out.vbr, out.toc = (got[0], got[1]), data[p : p + 100] if flags & XING_TOC else b""
    elif data[at + 36 : at + 40] == b"VBRI" and at + 62 <= at + h.size:
        size, frames, entries, _, wide, _ = struct.unpack(">IIHHHH", data[at + 46 : at + 62])
        out.vbr, out.toc = (frames, size), data[at + 62 : at + 62 + entries * wide]


def parse(data: bytes) -> Stream:
    out = Stream()
    at, end = _tags(data, out)
    synced = False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h is not None and not h.bitrate:
            if not (synced and h.kind == out.kind and out.free):
                out.free = _free_size(data, at, end, h)
            h = h._replace(size=out.free + h.pad) if out.free else None
        ok = h is not None and at + h.size <= end and (out.kind is None or h.kind == out.kind)
        if ok and at + h.size != end:
            after = header(data[at + h.size : at + h.size + 4])
            if after is None or after.kind != h.kind:
                # a header that no other follows may be junk; within a stream its kind and checksum decide
                ok = synced and (not h.protected or _good(h, data[at : at + h.size]))
        if not ok:
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.skipped += nxt - at
            at, synced = nxt, False
            continue
        if not out.offsets:
            out.kind, out.rate, out.per_frame = h.kind, h.rate, h.samples
            if h.layer == 3:
                _table(data, at, h, out)
        if h.protected:
            out.checked += 1
            out.bad_crc += not _good(h, data[at : at + h.size])
        out.offsets.append(at)
        out.sizes.append(h.size)
        out.data_at.append(at + 4 + 2 * h.protected + h.side)
        out.samples, synced = out.samples + h.samples, True
        at += h.size
    out.skipped += max(0, end - at)
    return out


def payload_of(data: bytes, s: Stream) -> bytes:
    """The ancillary data of the frames after the information frame."""
    first = 1 if s.vbr else 0
    got = b"".join(data[d : o + n] for d, o, n in zip(s.data_at[first:], s.offsets[first:], s.sizes[first:]))
    return got if s.payload_bytes is None else got[: s.payload_bytes]


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def feature(s: Stream) -> str:
    frames, size = s.vbr or (0, 0)
    return f"rate={s.rate};frames={len(s.offsets)};samples={s.samples};crc={s.checked - s.bad_crc}/{s.checked};skipped={s.skipped};vbr={frames}:{size};toc={zlib.crc32(s.toc)};seek={zlib.crc32(struct.pack(f'<{len(s.offsets)}Q', *s.offsets))};tags={','.join(s.tags)}"


def audio(docs: DataFrame, keep: bool = False) -> DataFrame:
    """documents(doc_id, text) -> digests and features of the stored streams; with keep, also `media` and `frame_offsets`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")] + (["media", "frame_offsets"] if keep else [])
        types = [pa.string() if " string" in f else pa.int64() for f in SCHEMA.split(", ")] + ([pa.binary(), pa.list_(pa.int64())] if keep else [])
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), text_of(b.column(1)).cast(pa.binary())):
                raw = text.as_py()
                media = encode(padded(raw))
                s = parse(media)
                back = payload_of(media, s)
                rows.append((doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(s), len(s.offsets), s.samples, s.rate, *((media, s.offsets) if keep else ())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=names)

    return plain(docs, "doc_id", "text").mapInArrow(run, SCHEMA + (", media binary, frame_offsets array<long>" if keep else ""))
