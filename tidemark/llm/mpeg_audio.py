"""MPEG audio columns: frame headers, tags, variable-bitrate tables, checksums, durations and seek offsets.

``encode`` stores bytes as 8-bit samples of a Layer I stream: each subband that is
in use has a bit allocation of 8 bits, so a frame of 384 samples holds 384 bytes
without loss (all-ones samples, which Layer I keeps for synchronisation, do not
occur in UTF-8). ``probe`` reads any stream of Layers I to III from its stored bytes alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import python_on_executors, table, utf8

UNIT = 192
# Fixed values of the MPEG audio format: bitrates in kbit/s by (version 1 or 2, layer), sampling rates in Hz by version, samples a frame.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}
CRC_POLY = 0x8005


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    kbps: int
    rate: int
    padding: int
    mono: bool
    mode_ext: int

    @property
    def length(self) -> int:
        """Bytes of the frame; 0 if the bitrate is free."""
        if self.layer == 1:
            return (12000 * self.kbps // self.rate + self.padding) * 4
        return self.samples // 8 * 1000 * self.kbps // self.rate + self.padding

    @property
    def samples(self) -> int:
        return SAMPLES[(1 if self.version == 1 else 2, self.layer)]

    @property
    def kind(self) -> tuple:
        """What all frames of a stream share."""
        return self.version, self.layer, self.rate, self.protected, self.mono

    @property
    def side_info(self) -> int:
        """Layer III: bytes between header (and checksum) and the main data."""
        return ((17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)) if self.layer == 3 else 0


@lru_cache(maxsize=4096)
def header(four: bytes) -> Header | None:
    """The header in four bytes, or None if they are not one."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(four[1] >> 3 & 3)
    layer = {1: 3, 2: 2, 3: 1}.get(four[1] >> 1 & 3)
    bitrate, rate = four[2] >> 4, four[2] >> 2 & 3
    if version is None or layer is None or bitrate == 15 or rate == 3 or four[3] & 3 == 2:
        return None
    return Header(version, layer, not four[1] & 1, BITRATES[(1 if version == 1 else 2, layer)][bitrate], RATES[version][rate], four[2] >> 1 & 1, four[3] >> 6 == 3, four[3] >> 4 & 3)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t = np.where(t & 0x8000, t << 1 ^ CRC_POLY, t << 1) & 0xFFFF
    return t.astype(np.uint16)


CRC_TABLE = _crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ int(CRC_TABLE[c >> 8 ^ b])
    return c


def crc16_rows(rows: np.ndarray) -> np.ndarray:
    """CRC-16 of each row of bytes."""
    if len(rows) and (rows == rows[0]).all():
        return np.full(len(rows), crc16(rows[0].tobytes()), np.uint16)
    c = np.full(len(rows), 0xFFFF, np.uint16)
    for k in range(rows.shape[1]):
        c = (c << np.uint16(8)) ^ CRC_TABLE[(c >> np.uint16(8)) ^ rows[:, k]]
    return c


def covered(h: Header) -> int:
    """Bytes after the checksum that it covers, besides the last two of the header; Layer II's length hangs on its allocation tables and is not checked."""
    if h.layer == 1:
        return 16 if h.mono else 32
    return h.side_info if h.layer == 3 else 0


# --- writing -------------------------------------------------------------


def _frame_parts(kbps: int, subbands: int) -> tuple[bytes, int]:
    """Header, checksum, allocation and scale factors of a frame with so many subbands, and its length."""
    head = bytes((0xFF, 0xFE, BITRATES[(1, 1)].index(kbps) << 4 | 2 << 2, 0xC0))
    allocation = b"\x77" * (subbands // 2) + bytes(16 - subbands // 2)
    scale = bytes(subbands * 6 // 8)
    return head + struct.pack(">H", crc16(head[2:] + allocation)) + allocation + scale, header(head).length


FULL, FULL_LEN = _frame_parts(288, 32)
HALF, HALF_LEN = _frame_parts(160, 16)
INFO, INFO_LEN = _frame_parts(96, 0)


def _syncsafe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def padded(data: bytes) -> bytes:
    return data + b" " * (-len(data) % UNIT if data else UNIT)


def encode(data: bytes) -> bytes:
    """A Layer I stream at 32 kHz, mono: an ID3v2 tag with the number of bytes, a Xing table, frames of 384 (the last perhaps 192) bytes, an ID3v1 tag."""
    payload = np.frombuffer(padded(data), np.uint8)
    n, half = divmod(len(payload), 384)
    body = np.zeros(n * FULL_LEN + (HALF_LEN if half else 0), np.uint8)
    frames = body[: n * FULL_LEN].reshape(n, FULL_LEN)
    frames[:, : len(FULL)] = np.frombuffer(FULL, np.uint8)
    frames[:, len(FULL) : len(FULL) + 384] = payload[: n * 384].reshape(n, 384)
    if half:
        last = body[n * FULL_LEN :]
        last[: len(HALF)] = np.frombuffer(HALF, np.uint8)
        last[len(HALF) : len(HALF) + 192] = payload[n * 384 :]
    count = n + bool(half)
    size = INFO_LEN + len(body)
    share = np.arange(100) * count // 100 * FULL_LEN + INFO_LEN
    toc = np.minimum(share * 256 // size, 255).astype(np.uint8).tobytes()
    table_ = b"Xing" + struct.pack(">III", 7, count, size) + toc
    text = b"\x00payload_bytes\x00" + str(len(data)).encode()
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    end = b"TAG" + b"payload".ljust(125, b"\x00")
    return b"ID3\x03\x00\x00" + _syncsafe(len(tag)) + tag + (INFO + table_).ljust(INFO_LEN, b"\x00") + body.tobytes() + end


# --- reading -------------------------------------------------------------


@dataclass
class Stream:
    tags: dict = field(default_factory=dict)
    vbr: dict = field(default_factory=dict)
    offsets: list = field(default_factory=list)  # arrays of frame offsets
    kbps: Counter = field(default_factory=Counter)
    layers: Counter = field(default_factory=Counter)
    duration: int = 0  # samples of one channel
    rate: int = 0
    crc_checked: int = 0
    crc_errors: int = 0
    resyncs: int = 0
    skipped: int = 0
    payload: list = field(default_factory=list)


def id3v2(data: bytes) -> tuple[dict, int]:
    """Text frames of an ID3v2.3 or 2.4 tag at the start, and where the tag ends: unsynchronised or not, with an extended header or not, with a footer or not."""
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    plain = lambda raw: (raw[0] & 127) << 21 | (raw[1] & 127) << 14 | (raw[2] & 127) << 7 | raw[3] & 127
    version, flags = data[3], data[5]
    end = min(len(data), 10 + plain(data[6:10]))
    body, at, tags = data[10:end], 0, {}
    if version == 4 and flags & 0x10:
        end = min(len(data), end + 10)
    if flags & 0x80:
        body = body.replace(b"\xff\x00", b"\xff")
    if flags & 0x40 and len(body) >= 4:
        at = plain(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    while at + 10 <= len(body) and body[at : at + 4].strip(b"\x00"):
        raw = body[at + 4 : at + 8]
        size = int.from_bytes(raw, "big") if version < 4 else plain(raw)
        name, text = body[at : at + 4].decode("latin-1"), body[at + 10 : at + 10 + size]
        if name[0] == "T" and text:
            coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(text[0], "latin-1")
            key, _, value = text[1:].decode(coding, "replace").rstrip("\x00").partition("\x00")
            tags[f"{name}:{key}" if name == "TXXX" else name] = value if name == "TXXX" else key
        at += 10 + size
    return tags, end


def vbr_table(frame: bytes, h: Header) -> dict:
    """A Xing or Info table after the side information (Layer I: after the allocation), or a VBRI table at byte 36."""
    at = 4 + 2 * h.protected + (covered(h) if h.layer == 1 else h.side_info)
    if frame[at : at + 4] in (b"Xing", b"Info") and at + 8 <= len(frame):
        flags, at = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        out = {"kind": "xing"}
        for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit and at + n <= len(frame):
                out[name] = frame[at : at + n] if name == "toc" else int.from_bytes(frame[at : at + n], "big")
                at += n
        if frame[at : at + 4] in (b"LAME", b"Lavf", b"Lavc") and at + 24 <= len(frame):  # samples that the encoder put before and behind
            ends = int.from_bytes(frame[at + 21 : at + 24], "big")
            out |= {"delay": ends >> 12, "padding": ends & 0xFFF}
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width = struct.unpack(">IIHHH", frame[46:60])
        toc = [int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width], "big") * scale for k in range(entries) if 62 + (k + 1) * width <= len(frame)]
        return {"kind": "vbri", "bytes": size, "frames": frames, "toc": toc}
    return {}


def _samples(run: np.ndarray, h: Header) -> np.ndarray | None:
    """The 8-bit samples of equal Layer I frames, if that is all they hold."""
    at = 4 + 2 * h.protected
    allocation = run[:, at : at + 16]
    used = int((allocation[0] == 0x77).sum()) * 2
    if h.layer != 1 or not h.mono or not used or allocation[0, used // 2 :].any() or (allocation != allocation[0]).any():
        return None
    at += 16 + used * 6 // 8
    return run[:, at : at + 12 * used].reshape(-1)


def probe(data: bytes) -> Stream:
    """Read a stream. A frame that follows another has its version, layer, rate, protection and number of channels. Bytes that are no such frame are skipped up to the
    next header from which the next frames follow where each ends: one more of the stream's kind, or two more of another, or the end.

    The duration leaves out the samples that the encoder says it added. Free-format frames are skipped, as their length is not in the header.
    """
    s = Stream()
    s.tags, at = id3v2(data)
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        s.tags["ID3v1"] = data[end + 3 : end + 33].rstrip(b"\x00 ").decode("latin-1")
    arr, first = np.frombuffer(data, np.uint8), True

    def follows(at: int, like: Header | None, frames: int) -> bool:
        """Whether so many frames (or as many as there are up to the end) of one kind begin here."""
        for _ in range(frames):
            h = header(data[at : at + 4])
            if not (h and h.length and at + h.length <= end and (like is None or h.kind == like.kind)):
                return False
            at, like = at + h.length, h
            if at == end:
                break
        return True

    stream: Header | None = None  # of the last frame, while in step
    last: Header | None = None

    def begins(at: int) -> bool:
        return bool(last and follows(at, last, 2)) or follows(at, None, 3)

    while at < end:
        if not (stream and follows(at, stream, 1) or begins(at)):
            start, stream, at = at, None, at + 1
            while 0 <= (at := data.find(b"\xff", at, end)) and not begins(at):
                at += 1
            if at < 0:
                at = end
            s.resyncs += 1
            s.skipped += at - start
            continue
        h = stream = last = header(data[at : at + 4])
        n = h.length
        if first:
            first = False
            s.vbr = vbr_table(data[at : at + n], h)
            if s.vbr:
                _verify(s, arr[at : at + n].reshape(1, n), h)
                at += n
                continue
        run = arr[at : at + (end - at) // n * n].reshape(-1, n)
        other = np.flatnonzero((run[:, :4] != run[0, :4]).any(axis=1))
        run = run[: other[0]] if len(other) else run
        _verify(s, run, h)
        if (x := _samples(run, h)) is not None:
            s.payload.append(x)
        s.offsets.append(at + n * np.arange(len(run), dtype=np.int64))
        s.kbps[h.kbps] += len(run)
        s.layers[h.layer] += len(run)
        s.duration += h.samples * len(run)
        s.rate = s.rate or h.rate
        at += n * len(run)
    s.duration = max(0, s.duration - s.vbr.get("delay", 0) - s.vbr.get("padding", 0))
    return s


def _verify(s: Stream, run: np.ndarray, h: Header) -> None:
    n = covered(h)
    if h.protected and n and run.shape[1] >= 6 + n:
        stored = run[:, 4].astype(np.uint16) << np.uint16(8) | run[:, 5]
        got = crc16_rows(np.concatenate([run[:, 2:4], run[:, 6 : 6 + n]], axis=1))
        s.crc_checked += len(run)
        s.crc_errors += int((got != stored).sum())


def feature(s: Stream) -> str:
    rates = ",".join(f"{k}:{v}" for k, v in sorted(s.kbps.items()))
    toc = s.vbr.get("toc", b"")
    toc = f"{zlib.crc32(toc if isinstance(toc, bytes) else repr(toc).encode()):08x}"
    return f"layers={','.join(map(str, sorted(s.layers)))};rate={s.rate};samples={s.duration};kbps={rates};vbr={s.vbr.get('kind', 'none')}/{s.vbr.get('frames', 0)}/{toc};crc={s.crc_checked}-{s.crc_errors};resyncs={s.resyncs}/{s.skipped}"


# --- operators -----------------------------------------------------------


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, media): each text as a stored stream; null text counts as empty. Other columns are left out."""
    python_on_executors(df.sparkSession)
    schema = df.select(F.col(f"`{key}`").alias("key"), F.lit(b"").alias("media")).schema

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode(x) for x in b.column(1).to_pylist()], pa.binary())], ["key", "media"])

    return df.select(F.col(f"`{key}`").alias("key"), utf8(F.col(f"`{text}`")).alias("body")).mapInArrow(run, schema).withColumnRenamed("key", key)


PROBED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_samples long, sample_rate int, crc_errors long, resyncs long, seek_offsets array<bigint>"


def probe_column(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """(key, digests, durations, seek offsets) of stored streams.

    The duration is exact: duration_samples over sample_rate seconds; seek_offsets has
    the byte at which each frame begins. A null or foreign stream has payload_bytes 0
    and the frames that it has. n_bytes is that of the tag if it fits the payload, else the payload's.
    """
    python_on_executors(df.sparkSession)
    spark = df.sparkSession
    schema = df.select(F.col(f"`{key}`").alias("key")).schema
    for f in spark.createDataFrame([], PROBED).schema:
        schema = schema.add(f)

    def run(batches):
        for b in batches:
            rows, offsets = [], []
            for data in b.column(1).to_pylist():
                data = data or b""
                s = probe(data)
                payload = b"".join(x.tobytes() for x in s.payload)
                at = np.concatenate(s.offsets) if s.offsets else np.zeros(0, np.int64)
                offsets.append(at)
                size = s.tags.get("TXXX:payload_bytes", "")
                n = int(size) if size.isdigit() and len(size) < 16 else -1
                rows.append((n if n >= 0 and max(UNIT, -(-n // UNIT) * UNIT) == len(payload) else len(payload), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(s), len(at), s.duration, s.rate, s.crc_errors, s.resyncs))
            cols = list(zip(*rows)) or [()] * 12
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in offsets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *offsets])))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)], lists], schema.names)

    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{media}`").alias("media")).mapInArrow(run, schema).withColumnRenamed("key", key)


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as MPEG audio and read back."""
    return probe_column(encode_column(table(spark, sf_dir, "documents")))


QUERIES = {"op1_mpeg_audio": op1_mpeg_audio}
ORACLES: dict[str, str] = {}
