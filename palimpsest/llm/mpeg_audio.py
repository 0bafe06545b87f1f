"""MPEG audio columns: a parser for streams as they come, and a lossless carrier of bytes.

parse() skips and reads ID3v2 (2.2 to 2.4, unsynchronised ones too), APE and
ID3v1 tags, finds frame headers (after damage it resynchronises at the next
header that is followed by a like one), reads the Xing, Info and VBRI tables with
their seek entries and an encoder's delay and padding, holds the seek entries
against the frames, verifies the 16-bit checksums of all three layers, and gives
exact durations (samples and sample rate) and the byte offset of every frame.
carry() writes a payload into the ancillary space of silent, checksum-protected
MPEG-1 layer III frames with a Xing table; payload() reads it back. The payload's
unit is thus the ancillary byte of a frame and not a sample: the format's samples
are coded with loss.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stored, whole_text

# Fixed values of the MPEG audio standards: kbit/s by bitrate index, by (MPEG-1 or not, layer); sample rates by version; 0 is "free", not supported.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
VERSION_NAMES = {3: "1", 2: "2", 0: "2.5"}
# Fixed values of layer II: bits of an allocation by subband, as (subbands, bits) runs; MPEG-2 has a table of its own.
ALLOCATIONS = {"a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "2": ((4, 4), (7, 3), (19, 2))}
# Text frames of ID3v2.2 and what later versions call them.
OLD_FRAMES = {"TT2": "TIT2", "TP1": "TPE1", "TAL": "TALB", "TYE": "TYER", "TRK": "TRCK", "TCO": "TCON", "TXX": "TXXX", "TLE": "TLEN", "TSS": "TSSE"}


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    bitrate: int
    rate: int
    mono: bool
    bound: int
    length: int
    samples: int
    side: int

    def like(self, other: Header | None) -> bool:
        return other is not None and (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)


@lru_cache(maxsize=4096)
def header(word: bytes) -> Header | None:
    """The frame header in four bytes, or None."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    bitrate_at, rate_at, padding = word[2] >> 4, word[2] >> 2 & 3, word[2] >> 1 & 1
    if version == 1 or layer == 4 or bitrate_at in (0, 15) or rate_at == 3 or word[3] & 3 == 2:
        return None
    one = version == 3
    bitrate, rate = BITRATES[one, layer][bitrate_at], SAMPLE_RATES[version][rate_at]
    mono = word[3] >> 6 == 3
    if layer == 1:
        length, samples = (12 * bitrate * 1000 // rate + padding) * 4, 384
    else:
        samples = 1152 if one or layer == 2 else 576
        length = samples // 8 * bitrate * 1000 // rate + padding
    side = 0 if layer != 3 else (17 if mono else 32) if one else (9 if mono else 17)
    # in joint stereo subbands from the bound on share their allocation
    bound = 4 + 4 * (word[3] >> 4 & 3) if word[3] >> 6 == 1 else 32
    return Header(version, layer, not word[1] & 1, bitrate, rate, mono, bound, length, samples, side)


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
        table.append(value)
    return table


CRC_TABLE = _crc_table()


@lru_cache(maxsize=65536)
def checksum(data: bytes) -> int:
    """CRC-16 of MPEG audio (polynomial 0x8005, start 0xFFFF)."""
    value = 0xFFFF
    for byte in data:
        value = (value << 8 & 0xFFFF) ^ CRC_TABLE[value >> 8 ^ byte]
    return value


def checksum_of_bits(header_bytes: bytes, bits: str) -> int:
    """checksum() of two header bytes and a run of bits that need not fill a byte."""
    value = checksum(header_bytes)
    for bit in bits:
        top = value >> 15 ^ int(bit)
        value = (value << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return value


def allocation_bits(h: Header) -> list[int]:
    """Bits of a layer II allocation by subband."""
    each = h.bitrate if h.mono else h.bitrate // 2
    if h.version != 3:
        name = "2"
    elif each < 56:
        name = "d" if h.rate == 32000 else "c"
    else:
        name = "a" if each <= 80 or h.rate == 48000 else "b"
    return [bits for count, bits in ALLOCATIONS[name] for _ in range(count)]


def sound(data: bytes, at: int, h: Header) -> bool:
    """Whether a protected frame's checksum is that of its side information."""
    wanted, head, body = int.from_bytes(data[at + 4 : at + 6]), data[at + 2 : at + 4], data[at + 6 : at + h.length]
    if h.layer == 3:
        return checksum(head + body[: h.side]) == wanted
    channels = 1 if h.mono else 2
    if h.layer == 1:
        n = 4 * (32 if h.mono else 32 + min(h.bound, 32))
        return checksum(head + body[: n // 8]) == wanted
    bits = "".join(f"{x:08b}" for x in body[:96])
    used, scale_bits = 0, 0
    for band, width in enumerate(allocation_bits(h)):
        own = channels if band < h.bound else 1
        for _ in range(own):
            # shared allocations have scale factor bits for each channel
            scale_bits += 2 * (channels // own) * ("1" in bits[used : used + width])
            used += width
    return checksum_of_bits(head, bits[: used + scale_bits]) == wanted


def syncsafe(value: int) -> bytes:
    return bytes(value >> s & 0x7F for s in (21, 14, 7, 0))


def from_syncsafe(data: bytes) -> int:
    return sum((b & 0x7F) << s for b, s in zip(data, (21, 14, 7, 0)))


@dataclass
class Stream:
    """What parse() finds. samples count audio frames only, not the frame that holds the table."""

    tags: dict[str, str] = field(default_factory=dict)
    frames: int = 0
    samples: int = 0
    rate: int = 0
    version: str = ""
    layer: int = 0
    offsets: list[int] = field(default_factory=list)
    bodies: list[tuple[int, int]] = field(default_factory=list)
    checked: int = 0
    failed: int = 0
    skipped: int = 0
    vbr: str = ""
    vbr_frames: int = -1
    vbr_bytes: int = -1
    toc: list[int] = field(default_factory=list)
    toc_wrong: int = 0
    delay: int = 0
    padding: int = 0
    bitrates: set[int] = field(default_factory=set)
    truncated: bool = False

    @property
    def played(self) -> int:
        """Samples without what the encoder put before and after."""
        return max(0, self.samples - self.delay - self.padding)


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Reads the tag at `at`; returns where it ends."""
    major, flags, size = data[at + 3], data[at + 5], from_syncsafe(data[at + 6 : at + 10])
    end = min(len(data), at + 10 + size + 10 * bool(flags & 0x10))
    body = data[at + 10 : min(end, at + 10 + size)]
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\0", b"\xff")
    p = 0
    if flags & 0x40 and major >= 3 and len(body) >= 4:
        p = from_syncsafe(body[:4]) if major >= 4 else int.from_bytes(body[:4]) + 4
    n_name, n_head = (3, 6) if major < 3 else (4, 10)
    while p + n_head <= len(body) and body[p : p + 1].strip(b"\0"):
        name = body[p : p + n_name].decode("latin-1")
        length = body[p + n_name : p + 2 * n_name]
        n = from_syncsafe(length) if major >= 4 else int.from_bytes(length)
        text = body[p + n_head : p + n_head + n]
        if major >= 4 and body[p + 9] & 0x02:
            text = text.replace(b"\xff\0", b"\xff")
        name = OLD_FRAMES.get(name, name)
        if name[0] == "T" and text:
            value = text[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(text[0], 3)], "replace").rstrip("\0")
            key, _, rest = value.partition("\0") if name == "TXXX" else ("", "", value)
            tags[f"{name}:{key}" if name == "TXXX" else name] = rest
        p += n_head + n
    return end


def _ape_begin(data: bytes, end: int) -> int:
    """Where an APE tag that ends at `end` begins; `end` if there is none."""
    foot = data[end - 32 : end]
    if end < 32 or foot[:8] != b"APETAGEX" or foot[23] & 0x20:
        return end
    return max(0, end - int.from_bytes(foot[12:16], "little") - 32 * (foot[23] >> 7))


def _ape(data: bytes, end: int, tags: dict[str, str]) -> None:
    """Reads the APE tag that ends at `end`."""
    size, count = (int.from_bytes(data[end - 32 + k : end - 28 + k], "little") for k in (12, 16))
    p = max(0, end - size)
    for _ in range(min(count, size // 11)):
        n, (key, sep, _) = int.from_bytes(data[p : p + 4], "little"), data[p + 8 : end - 32].partition(b"\0")
        if not sep:
            break
        at = p + 9 + len(key)
        if not int.from_bytes(data[p + 4 : p + 8], "little") & 6:  # a text
            tags.setdefault(f"APE:{key.decode('latin-1')}", data[at : at + n].decode("utf-8", "replace"))
        p = at + n


def _table(data: bytes, at: int, body: int, h: Header, out: Stream) -> bool:
    """Reads the table in the first frame, if there is one."""
    if data[at + 36 : at + 40] == b"VBRI":
        out.vbr, out.vbr_bytes, out.vbr_frames = "VBRI", int.from_bytes(data[at + 46 : at + 50]), int.from_bytes(data[at + 50 : at + 54])
        count, scale, width, _ = (int.from_bytes(data[at + k : at + k + 2]) for k in (54, 56, 58, 60))
        out.toc = [scale * int.from_bytes(data[at + 62 + k * width : at + 62 + (k + 1) * width]) for k in range(count)]
        return True
    if h.layer != 3 or data[body : body + 4] not in (b"Xing", b"Info"):
        return False
    out.vbr, flags, p = data[body : body + 4].decode(), data[body + 7], body + 8
    if flags & 1:
        out.vbr_frames, p = int.from_bytes(data[p : p + 4]), p + 4
    if flags & 2:
        out.vbr_bytes, p = int.from_bytes(data[p : p + 4]), p + 4
    if flags & 4:
        out.toc, p = list(data[p : p + 100]), p + 100
    p += 4 * (flags >> 3 & 1)
    if data[p : p + 4] in (b"LAME", b"Lavf", b"Lavc"):
        gap = int.from_bytes(data[p + 21 : p + 24])
        out.delay, out.padding = gap >> 12, gap & 0xFFF
    return True


def _check_toc(out: Stream, begin: int, end: int) -> None:
    """Counts seek entries that miss the frames they stand for: by more than one 256th (Xing), or by a byte in the sums of sizes (VBRI)."""
    if not out.toc or not out.offsets:
        return
    whole = out.vbr_bytes if out.vbr_bytes > 0 else end - begin
    if out.vbr == "VBRI":
        per = -(-len(out.offsets) // len(out.toc))
        marks = [*out.offsets[::per], end]
        found = [y - x for x, y in zip(marks, marks[1:])]
        out.toc_wrong = sum(x != y for x, y in zip(out.toc, found)) + abs(len(out.toc) - len(found))
        return
    for percent, entry in enumerate(out.toc):
        place = out.offsets[min(len(out.offsets) - 1, percent * len(out.offsets) // 100)] - begin
        out.toc_wrong += abs(entry - min(255, place * 256 // whole)) > 1


def _frames_to_end(data: bytes, at: int, first: Header) -> bool:
    """Whether like frames, one after the other from `at`, end where the data ends."""
    while at < len(data):
        h = header(data[at : at + 4])
        if h is None or not h.like(first):
            return False
        at += h.length
    return at == len(data)


def parse(data: bytes | None) -> Stream:
    """Parses any bytes; None and bytes without a frame give a stream of 0 frames.

    A header counts where it is followed by a like header, by a tag or by the
    end of the data, or where it is like the frame that ends just before it;
    everything else between frames is skipped and counted. The last 128 bytes are
    an ID3v1 tag if they start like one, unless frames that reach to the very end
    of the data run over that place. Frames of free bitrate are not supported.
    """
    out = Stream()
    data = data or b""
    at, end = 0, len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
    ape_end, end = end, _ape_begin(data, end)
    previous, stop, table_at = None, -1, -1  # stop: where the last frame ends
    while at < end or end < len(data) and at == stop:
        if at >= end:
            # where frames go on to the very end, what looked like a tag is theirs
            h = header(data[at : at + 4])
            if not h or not h.like(previous) or not _frames_to_end(data, at, h):
                break
            end = len(data)
        if data[at : at + 3] == b"ID3" and at + 10 <= end:
            at = _id3v2(data, at, out.tags)
            continue
        h = header(data[at : at + 4])
        if h is not None and end < len(data) and at + h.length > end and (previous is None or h.like(previous)) and _frames_to_end(data, at, h):
            end = len(data)
        if h is not None and at + h.length <= end:
            after = at + h.length
            sure = after == end or data[after : after + 3] == b"ID3" or h.like(header(data[after : after + 4])) or (at == stop and h.like(previous))
        else:
            out.truncated |= h is not None and h.like(previous)
            sure = False
        if not sure:
            next_at = data.find(b"\xff", at + 1, end)
            tag_at = data.find(b"ID3", at + 1, end if next_at < 0 else next_at)
            goes = min(x for x in (next_at, tag_at, end) if x >= 0)
            out.skipped += goes - at
            at = goes
            continue
        body = at + 4 + 2 * h.protected + h.side
        if h.protected:
            out.checked += 1
            out.failed += not sound(data, at, h)
        if previous is None and _table(data, at, body, h, out):
            table_at = at
        else:
            out.frames += 1
            out.samples += h.samples
            out.offsets.append(at)
            out.bodies.append((body, at + h.length))
            out.bitrates.add(h.bitrate)
        out.rate, out.version, out.layer = h.rate, VERSION_NAMES[h.version], h.layer
        previous = h
        at += h.length
        stop = at
    _check_toc(out, table_at if table_at >= 0 else 0, stop)
    if end < ape_end:
        _ape(data, ape_end, out.tags)
    if ape_end < len(data) and end < len(data):
        end = len(data) - 128
        for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
            if text := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                out.tags.setdefault(name, text)
    return out


# The carrier: MPEG-1 layer III, protected, mono, 32 kHz, so that a frame of b kbit/s has 4.5 b bytes.
SIDE = bytes(17)


def _frame(bitrate_at: int, body: bytes) -> bytes:
    word = bytes((0xFF, 0xFA, bitrate_at << 4 | 2 << 2, 0xC0))
    return word + checksum(word[2:] + SIDE).to_bytes(2) + SIDE + body


CAPACITY = [BITRATES[True, 3][k] * 9 // 2 - 23 for k in range(15)]
LARGEST = 14


def carry(payload: bytes, n_bytes: int) -> bytes:
    """A stream of silent frames that holds the payload; the last frame has the smallest fitting bitrate."""
    comment = b"\x03payload_bytes\0" + f"{len(payload)},{n_bytes}".encode()
    frame = b"TXXX" + syncsafe(len(comment)) + b"\0\0" + comment
    tag = b"ID3\x04\0\0" + syncsafe(len(frame)) + frame
    room = CAPACITY[LARGEST]
    frames = [_frame(LARGEST, payload[k : k + room]) for k in range(0, len(payload) - len(payload) % room, room)]
    if rest := payload[len(payload) - len(payload) % room :]:
        fits = next(k for k in range(1, 15) if CAPACITY[k] >= len(rest))
        frames.append(_frame(fits, rest.ljust(CAPACITY[fits], b"\0")))
    sizes, total, seek = [len(f) for f in frames], sum(map(len, frames)), []
    info = CAPACITY[5]
    whole = total + info + 23
    at, passed = 0, info + 23
    for percent in range(100):
        while at < percent * len(frames) // 100:
            passed += sizes[at]
            at += 1
        seek.append(min(255, passed * 256 // whole))
    table = b"Xing" + (7).to_bytes(4) + len(frames).to_bytes(4) + whole.to_bytes(4) + bytes(seek)
    return tag + _frame(5, table.ljust(info, b"\0")) + b"".join(frames)


def payload(media: bytes, stream: Stream | None = None) -> bytes:
    """The payload of a carrier. Fails where the frames hold less than the tag says."""
    stream = stream or parse(media)
    size = int(stream.tags["TXXX:payload_bytes"].split(",")[0])
    data = b"".join([media[a:b] for a, b in stream.bodies])[:size]
    if len(data) != size:
        raise ValueError(f"a carrier of {size} bytes gave {len(data)}")
    return data


def feature(s: Stream) -> str:
    """A stream in one line; the seek table by its number of entries and checksum."""
    seek = zlib.crc32(b",".join(b"%d" % x for x in s.offsets))
    return f"mpeg={s.version};layer={s.layer};frames={s.frames};duration={s.samples}/{s.rate};table={s.vbr}:{s.vbr_frames}:{s.vbr_bytes}:{len(s.toc) - s.toc_wrong}/{len(s.toc)};kbps={min(s.bitrates, default=0)}-{max(s.bitrates, default=0)};crc={s.checked - s.failed}/{s.checked};skipped={s.skipped};seek={len(s.offsets)}:{seek}"


PARSED = "version string, layer int, sample_rate int, frames long, samples long, played long, duration double, vbr string, vbr_frames long, toc array<long>, toc_wrong long, checksums long, checksum_failures long, skipped_bytes long, truncated boolean, seek_offsets array<long>, tags map<string,string>"


class ParseTask:
    def __call__(self, batch: pa.RecordBatch) -> dict:
        found = [parse(x.as_py()) for x in batch.column(1)]
        columns = {
            "version": "version", "layer": "layer", "sample_rate": "rate", "frames": "frames", "samples": "samples", "played": "played", "vbr": "vbr", "toc": "toc", "toc_wrong": "toc_wrong", "vbr_frames": "vbr_frames",
            "checksums": "checked", "checksum_failures": "failed", "skipped_bytes": "skipped", "truncated": "truncated", "seek_offsets": "offsets",
        }
        out = {k: [getattr(s, v) for s in found] for k, v in columns.items()}
        return out | {"id": batch.column(0), "duration": [s.samples / s.rate if s.rate else 0.0 for s in found], "tags": [list(s.tags.items()) for s in found]}


def parse_column(df: DataFrame, id_column: str, media_column: str) -> DataFrame:
    """id and PARSED columns of a column of MPEG audio bytes. Null and foreign bytes give 0 frames; repeated rows stay."""
    kind = df.schema[id_column].dataType.simpleString()
    return map_arrow(df.select(F.col(id_column).alias("id"), F.col(media_column).cast("binary").alias("media")), ParseTask, f"id {kind}, {PARSED}").withColumnRenamed("id", id_column)


class CarryTask:
    def __call__(self, batch: pa.RecordBatch) -> dict:
        media = []
        for text in batch.column(1):
            data = text.as_py().encode()
            media.append(carry(data.ljust(max(64, -(-len(data) // 64) * 64), b"\0"), len(data)))
        return {"doc_id": batch.column(0), "media": media}


class ReadTask:
    def __call__(self, batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "samples", "sample_rate", "seek_offsets")}
        for value in batch.column(1):
            media = value.as_py()
            s = parse(media)
            data = payload(media, s)
            row = (int(s.tags["TXXX:payload_bytes"].split(",")[1]), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(s), s.samples, s.rate, s.offsets)
            for column, x in zip(out.values(), row, strict=True):
                column.append(x)
        return out | {"doc_id": batch.column(0)}


def store_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, media: each whole text, zero-padded to a positive multiple of 64 bytes, as an MPEG audio stream in a stored table.

    Null texts count as empty; repeated rows and null ids come back as often; an
    empty table gives an empty one; other columns are ignored, whatever their names.
    """
    given = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    return stored(map_arrow(given, CarryTask, "doc_id long, media binary"), "mpeg")


def read_texts(media: DataFrame) -> DataFrame:
    """Digests and features of stored carriers, from their bytes alone; a row for each row, none for an empty table. Bytes that are no carrier fail."""
    return map_arrow(
        media.select("doc_id", "media"),
        ReadTask,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, samples long, sample_rate int, seek_offsets array<long>",
    )
