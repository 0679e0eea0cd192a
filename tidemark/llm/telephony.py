"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV form, expanded, resampled and kept as PCM.

G.711 codes expand through 256-entry tables.  An ADPCM block carries its own start state, so blocks are decoded side
by side: each step advances all blocks by one sample in numpy, and a block's step count is the only serial loop.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches

CODECS = ("mulaw", "alaw", "ima")
#: Bytes of an ADPCM block; telephone sampling rate and the rate that PCM is stored at.
BLOCK, RATE, PCM_RATE = 192, 8000, 16000
#: The WAV format tags of the codecs.
_TAGS = {"alaw": 6, "mulaw": 7, "ima": 17}
#: The step sizes and index moves of IMA ADPCM.
_STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def mulaw_table() -> np.ndarray:
    """Linear values of the 256 mu-law codes."""
    code = ~np.arange(256, dtype=np.uint8)
    size = (((code & 15).astype(np.int32) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear values of the 256 A-law codes."""
    code = np.arange(256, dtype=np.uint8) ^ 0x55
    exponent, size = code >> 4 & 7, ((code & 15).astype(np.int32) << 4) + 8
    size = np.where(exponent == 0, size, size + 256 << np.maximum(exponent.astype(np.int32) - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


_TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}
#: Differences by step index and 4-bit code, and the index that follows.
_NIBBLES = np.arange(16)
_DELTA = (_STEPS[:, None] >> 3) + sum(np.where(_NIBBLES & bit, _STEPS[:, None] >> shift, 0) for bit, shift in ((4, 0), (2, 1), (1, 2)))
_DELTA = np.where(_NIBBLES & 8, -_DELTA, _DELTA).astype(np.int32)
_NEXT = np.clip(np.arange(89)[:, None] + _MOVES, 0, 88).astype(np.int32)


def wrap(codec: str, data: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file around coded samples, or 16-bit linear ones (`pcm`); ADPCM data must be whole blocks."""
    if codec == "pcm":
        format_ = struct.pack("<HHIIHH", 1, 1, rate, rate * 2, 2, 16)
        return b"".join([b"RIFF", struct.pack("<I", 36 + len(data)), b"WAVEfmt ", struct.pack("<I", 16), format_, b"data", struct.pack("<I", len(data)), data])
    if codec not in _TAGS:
        raise ValueError(f"unknown codec {codec}")
    if codec == "ima" and len(data) % BLOCK:
        raise ValueError("ADPCM data must be whole blocks")
    block, bits = (BLOCK, 4) if codec == "ima" else (1, 8)
    per_block = (BLOCK - 4) * 2 + 1 if codec == "ima" else 1
    count = len(data) // block * per_block
    format_ = struct.pack("<HHIIHHHH", _TAGS[codec], 1, rate, rate * block // per_block, block, bits, 2, per_block)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(format_)) + format_ + b"fact" + struct.pack("<II", 4, count) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwrap(media: bytes) -> tuple[str, int, bytes]:
    """Codec, rate and coded samples of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, codec, rate = 12, None, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
            codec = {t: c for c, t in _TAGS.items()}.get(tag)
        elif kind == b"data" and codec:
            return codec, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no telephony data in the file")


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Samples of ADPCM blocks, a row for each row of BLOCK bytes; a start index above the table's end counts as the end."""
    start = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((2 * (BLOCK - 4) + 1, len(blocks)), np.int16)
    out[0] = value = start
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for i, byte in enumerate(codes):
        for j, code in enumerate((byte & 15, byte >> 4)):
            at = index * 16 + code
            value = np.clip(value + _DELTA.ravel()[at], -32768, 32767)
            index = _NEXT.ravel()[at]
            out[2 * i + j + 1] = value
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray, rate: int, to: int = PCM_RATE) -> np.ndarray:
    """Linear interpolation between samples at another rate, in integers; the last sample is held."""
    if rate == to or not len(pcm):
        return pcm
    if to == 2 * rate:
        out = np.empty(2 * len(pcm), np.int16)
        out[::2] = pcm
        wide = pcm.astype(np.int32)
        out[1:-1:2] = wide[:-1] + wide[1:] >> 1
        out[-1] = pcm[-1]
        return out
    at = np.arange(len(pcm) * to // rate) * rate
    low, part = at // to, at % to
    wide = pcm.astype(np.int64)
    return (wide[low] + (wide[np.minimum(low + 1, len(pcm) - 1)] - wide[low]) * part // to).astype(np.int16)


def expand(files: list[bytes]) -> list[tuple[str, int, bytes, np.ndarray]]:
    """Codec, rate, coded samples and linear samples of WAV files; the blocks of all ADPCM files are decoded together."""
    read = [unwrap(f) for f in files]
    ima = [np.frombuffer(d, np.uint8).reshape(-1, BLOCK) for c, _, d in read if c == "ima"]
    # a few thousand blocks at a time stay in the cache
    joined = np.concatenate(ima) if ima else np.zeros((0, BLOCK), np.uint8)
    decoded = np.concatenate([decode_ima(joined[i : i + 2048]) for i in range(0, len(joined), 2048)] or [np.zeros((0, 1), np.int16)])
    out, at = [], 0
    for codec, rate, data in read:
        if codec == "ima":
            n = len(data) // BLOCK
            pcm = decoded[at : at + n].ravel()
            at += n
        else:
            pcm = _TABLES[codec][np.frombuffer(data, np.uint8)]
        out.append((codec, rate, data, pcm))
    return out


def store_media(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Add `media`: each row's binary `payload` as a WAV file of its `codec`.  A null payload has null media."""
    make = lambda: lambda b: [pa.array([None if p is None else wrap(c, p) for c, p in zip(b.column("codec").to_pylist(), b.column("payload").to_pylist(), strict=True)], pa.binary())]
    return map_batches(rows, "payload", make, [pa.field("media", pa.binary())], keep, ("codec",))


def read_media(rows: DataFrame, keep: list[str] | None = None, to: int = PCM_RATE) -> DataFrame:
    """Add to rows with WAV files in `media`: `coded` (the coded samples, read back), `pcm` (a WAV file of 16-bit samples at rate `to`) and `feature`.

    `feature` says codec, samples, peak, root mean square, zero crossings and the checksum of the PCM samples.  Null media
    give nulls; equal media equal results, a row for each row.  A cell holds at most 2 GB, so a text of more than 256 MB
    makes the job fail.
    """

    def make():
        def work(batch: pa.RecordBatch) -> list:
            files = batch.column("media").to_pylist()
            found = iter(expand([f for f in files if f is not None]))
            coded, pcms, features = [], [], []
            for f in files:
                if f is None:
                    row = None, None, None
                else:
                    codec, rate, data, linear = next(found)
                    pcm = resample(linear, rate, to)
                    stored = pcm.astype("<i2").tobytes()
                    wide = linear.astype(np.float64)
                    crossings = int(np.count_nonzero((linear[1:] < 0) != (linear[:-1] < 0)))
                    level = int(np.sqrt(wide @ wide / max(1, len(wide))))
                    peak = int(np.abs(wide).max()) if len(wide) else 0
                    row = data, wrap("pcm", stored, to), f"{codec}:{len(pcm)}:{peak}:{level}:{crossings}:{zlib.crc32(stored):08x}"
                for to_list, x in zip((coded, pcms, features), row, strict=True):
                    to_list.append(x)
            return [pa.array(coded, pa.binary()), pa.array(pcms, pa.binary()), pa.array(features, pa.string())]

        return work

    # batches are cut by the size of the files; PCM takes eight times the room of ADPCM
    return map_batches(rows, "media", make, [pa.field("coded", pa.binary()), pa.field("pcm", pa.binary()), pa.field("feature", pa.string())], keep)


def op2(docs: DataFrame) -> DataFrame:
    """Every document's text as telephony audio and back.

    The padded text is taken as coded samples; the codec goes by its number of 192-byte blocks, so that all three are
    used.  Digests are of the coded samples read back from the stored file, of that file, and of the file of resampled PCM.
    A null text counts as empty; equal texts have equal files; null and repeated doc_ids pass as they are.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n = F.octet_length(raw)
    blocks = F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    padded = docs.select("doc_id", n.cast("long").alias("n_bytes"), F.concat(raw, F.repeat(F.lit(" "), blocks * BLOCK - n).cast("binary")).alias("payload"), F.element_at(F.array(*map(F.lit, CODECS)), blocks % len(CODECS) + 1).alias("codec"))
    media = store_media(padded, ["doc_id", "n_bytes"])
    sized = media.select("doc_id", "n_bytes", "media", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    back = read_media(sized, ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    tail = F.substring("coded", -16, 16)
    return back.select("doc_id", "n_bytes", F.octet_length("coded").cast("long").alias("payload_bytes"), F.sha2("coded", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), "media_bytes", "media_sha256", "feature", F.octet_length("pcm").cast("long").alias("pcm_bytes"), F.sha2("pcm", 256).alias("pcm_sha256"))
