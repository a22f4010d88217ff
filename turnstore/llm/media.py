"""Telephony audio columns (operator 8).

Bytes are stored as the 8-bit samples of a mono WAV file (mu-law, A-law or IMA ADPCM), read back from the stored
form, expanded to PCM by lookup tables or, for ADPCM, with numpy across all blocks of a batch at once, and resampled
to twice the rate. The result of a row depends on its bytes only, so equal texts have equal values.

Defined cases: a null text counts as empty and gives one block of padding; a stored value that isn't such a file
raises ValueError; texts of any length are decoded in one group of their own, in memory in proportion to them; an empty
table gives an empty result; other columns than the two that are named are dropped.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstore.llm.common import text_or_empty

#: Bytes of a frame: payloads are padded to a multiple of it, and an ADPCM block is one frame.
FRAME, PAD, RATE = 192, b"\x20", 8000
#: Format tags of WAV files.
MU_LAW, A_LAW, IMA_ADPCM = 7, 6, 17
#: Bytes of payload that are decoded together.
GROUP = 2_000_000

#: The step sizes of IMA ADPCM and the moves in that table by the low three bits of a code.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
     130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
     1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
     7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mu_law_table() -> np.ndarray:
    """Sample of each mu-law byte: complement, then sign, exponent and mantissa with a bias of 33 << 2."""
    b = ~np.arange(256) & 0xFF
    size = ((b & 0x0F) << 3) + 0x84 << (b >> 4 & 7)
    return np.where(b & 0x80, 0x84 - size, size - 0x84).astype(np.int16)


def a_law_table() -> np.ndarray:
    """Sample of each A-law byte: every other bit inverted, the first segment linear."""
    b = np.arange(256) ^ 0x55
    exponent, size = b >> 4 & 7, (b & 0x0F) << 4
    size = np.where(exponent == 0, size + 8, size + 0x108 << np.maximum(exponent - 1, 0))
    return np.where(b & 0x80, size, -size).astype(np.int16)


MU, A = mu_law_table(), a_law_table()


def store(payload: bytes, codec: int = MU_LAW) -> bytes:
    """A mono WAV file whose data chunk is the payload."""
    block = FRAME if codec == IMA_ADPCM else 1
    per_block = 2 * (FRAME - 4) + 1
    n = len(payload) // FRAME * per_block if codec == IMA_ADPCM else len(payload)
    extra = struct.pack("<HH", 2, per_block) if codec == IMA_ADPCM else struct.pack("<H", 0)
    speed = RATE * FRAME // per_block if codec == IMA_ADPCM else RATE
    fmt = struct.pack("<HHIIHH", codec, 1, RATE, speed, block, 4 if codec == IMA_ADPCM else 8) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, n) + b"data" + struct.pack("<I", len(payload))
    return b"RIFF" + struct.pack("<I", len(body) + len(payload)) + body + payload


def read(stored: bytes) -> tuple[int, bytes]:
    """The codec and the data chunk of a stored file."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec = 12, None
    while at + 8 <= len(stored):
        kind, size = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if kind == b"fmt ":
            codec = struct.unpack_from("<H", stored, at + 8)[0]
        elif kind == b"data" and codec is not None:
            return codec, stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no format or data chunk")


def adpcm(data: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM blocks: one row for each block, one step of the decoder for all blocks at a time."""
    blocks = data.reshape(-1, FRAME)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    codes = np.empty((2 * (FRAME - 4), len(blocks)), np.int32)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = value
    for k, code in enumerate(codes):
        step = STEPS[index]
        low = code & 7
        change = (step >> 3) + np.where(low & 4, step, 0) + np.where(low & 2, step >> 1, 0) + np.where(low & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + MOVES[low], 0, 88)
        out[k + 1] = value
    return np.ascontiguousarray(out.T)


def decode(codec: int, data: np.ndarray) -> np.ndarray:
    if codec == IMA_ADPCM:
        return adpcm(data).reshape(-1)
    if codec not in (MU_LAW, A_LAW):
        raise ValueError(f"unknown codec {codec}")
    return (MU if codec == MU_LAW else A)[data]


def doubled(pcm: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Twice the rate: a sample midway between neighbours; the last of each row (which ends before `ends`) is held."""
    wide = pcm.astype(np.int32)
    after = np.append(wide[1:], 0)
    after[ends - 1] = wide[ends - 1]
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2], out[1::2] = pcm, wide + after >> 1
    return out


def decoded(rows: list[tuple[int, bytes]]) -> list[tuple[bytes, str]]:
    """Resampled PCM and features of stored payloads: the codec, samples, peak, energy, sign changes and PCM's CRC."""
    out: list[tuple[bytes, str]] = [(b"", "")] * len(rows)
    for codec in {c for c, _ in rows}:
        mine = [k for k, (c, _) in enumerate(rows) if c == codec]
        pcm = decode(codec, np.frombuffer(b"".join(rows[k][1] for k in mine), np.uint8))
        per_byte = len(pcm) / sum(len(rows[k][1]) for k in mine)
        ends = np.cumsum([round(len(rows[k][1]) * per_byte) for k in mine])
        starts = np.concatenate(([0], ends[:-1]))
        wide = pcm.astype(np.int64)
        peak, energy = np.maximum.reduceat(abs(wide), starts), np.add.reduceat(wide * wide, starts)
        turn = np.append((pcm[1:] < 0) != (pcm[:-1] < 0), False)
        turn[ends - 1] = False
        turns = np.add.reduceat(turn.astype(np.int64), starts)
        fine = doubled(pcm, ends)
        for i, k in enumerate(mine):
            raw = fine[2 * starts[i] : 2 * ends[i]].tobytes()
            out[k] = raw, f"{codec}:{ends[i] - starts[i]}:{peak[i]}:{energy[i]}:{turns[i]}:{zlib.crc32(raw):08x}"
    return out


def audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", codecs: tuple[int, ...] = (MU_LAW, A_LAW, IMA_ADPCM), keep_values: bool = False) -> DataFrame:
    """Store every whole text as telephony audio, read it back and decode it.

    The first codec is the stored form; the features have one part for each codec that the payload is decoded by. Of the
    PCM that the stored form is expanded and resampled to, the size and a digest are given (pcm_bytes, pcm_sha256); with
    keep_values the PCM itself (pcm, 16 bits, little-endian) and the stored file (media) are columns too. Narrow, no shuffle.
    """
    fields = f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"
    fields += ", media binary, pcm binary" if keep_values else ""

    def group(texts: list[bytes]) -> list[tuple]:
        stored = [store(t + PAD * ((-len(t) % FRAME) or FRAME * (not t)), codecs[0]) for t in texts]
        payloads = [read(s)[1] for s in stored]
        by_codec = [decoded([(c, p) for p in payloads]) for c in codecs]
        return [
            (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(s), hashlib.sha256(s).hexdigest(), "|".join(d[k][1] for d in by_codec), len(by_codec[0][k][0]), hashlib.sha256(by_codec[0][k][0]).hexdigest())
            + ((s, by_codec[0][k][0]) if keep_values else ())
            for k, (t, s, p) in enumerate(zip(texts, stored, payloads))
        ]

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * 2 * keep_values
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(texts):
                taken, size = [], 0
                while at + len(taken) < len(texts) and (not taken or size < GROUP):
                    taken.append(texts[at + len(taken)].as_py())
                    size += len(taken[-1])
                columns = zip(*group(taken))
                arrays = [ids.slice(at, len(taken)), *(pa.array(c, kind) for c, kind in zip(columns, kinds))]
                yield pa.RecordBatch.from_arrays(arrays, names)
                at += len(taken)

    rows = docs.select(F.col(id_col).alias("id"), F.encode(text_or_empty(F.col(text_col)), "UTF-8").alias("text"))
    return rows.mapInArrow(run, fields).withColumnRenamed("id", id_col)
