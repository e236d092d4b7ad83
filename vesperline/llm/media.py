"""Telephony audio columns: G.711 and IMA ADPCM in WAV containers, decoded with numpy."""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesperline.llm._spark import as_table

# WAVE format tags.
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17
# IMA ADPCM step sizes and index moves.
IMA_STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
     118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
     1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
     6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
     32767], np.int32)
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


@cache
def mulaw_table() -> np.ndarray:
    """The 256 linear values of mu-law codes."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


@cache
def alaw_table() -> np.ndarray:
    """The 256 linear values of A-law codes."""
    code = np.arange(256) ^ 0x55
    part, size = (code & 0x70) >> 4, (code & 0x0F) << 4
    size = np.where(part == 0, size + 8, size + 0x108 << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


@cache
def _ima_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each (step index, nibble): the change of the sample and the next index."""
    nibble = np.arange(16)
    step = IMA_STEPS[:, None]
    change = (step >> 3) + (nibble & 1) * (step >> 2) + (nibble >> 1 & 1) * (step >> 1) + (nibble >> 2 & 1) * step
    change = np.where(nibble & 8, -change, change).astype(np.int32)
    after = np.clip(np.arange(len(IMA_STEPS))[:, None] + IMA_MOVES[nibble & 7], 0, len(IMA_STEPS) - 1)
    return change.ravel(), (after * 16).astype(np.int32).ravel()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Mono IMA ADPCM, one block a row of ``uint8``: all blocks advance together, one nibble a step.

    A block is its first sample (16 bits), its step index (out of range: clipped), a reserved byte and nibbles, low
    one first.
    """
    change, after = _ima_tables()
    n, width = blocks.shape
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(IMA_STEPS) - 1).astype(np.int32) * 16
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    out[0] = value
    data = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(width - 4):
        for k, nibble in enumerate((data[i] & 15, data[i] >> 4)):
            at = index + nibble
            value += change[at]
            np.clip(value, -32768, 32767, out=value)
            index = after[at]
            out[1 + 2 * i + k] = value
    return out.T


def to_wav(data: bytes, format_tag: int, rate: int, block: int = 1, bits: int = 8) -> bytes:
    """A mono WAV file around ``data``."""
    per_second = rate * block if format_tag != IMA_ADPCM else rate * block // (1 + 2 * (block - 4))
    extra = b"" if format_tag == PCM else struct.pack("<H", 0) if format_tag != IMA_ADPCM else struct.pack("<HH", 2, 1 + 2 * (block - 4))
    head = struct.pack("<HHIIHH", format_tag, 1, rate, per_second, block, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def from_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """(format tag, rate, block size, stored bytes) of a mono WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, head = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            head = struct.unpack("<HHIIHH", media[at + 8 : at + 24])
        if name == b"data" and head:
            if head[1] != 1:
                raise ValueError("more than one channel")
            return head[0], head[2], head[4], media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without samples")


def to_pcm(format_tag: int, block: int, data: bytes) -> np.ndarray:
    """Linear 16-bit samples; a last part block of ADPCM is left out."""
    codes = np.frombuffer(data, np.uint8)
    if format_tag == MULAW:
        return mulaw_table()[codes]
    if format_tag == ALAW:
        return alaw_table()[codes]
    if format_tag == IMA_ADPCM:
        return decode_ima(codes[: len(codes) // block * block].reshape(-1, block)).ravel()
    if format_tag == PCM:
        return np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.int16)
    raise ValueError(f"format {format_tag} is not telephony audio")


def resample(pcm: np.ndarray, rate: int, to_rate: int) -> np.ndarray:
    """Linear interpolation on exact integer positions; an empty signal stays empty."""
    if rate == to_rate or not len(pcm):
        return pcm
    if to_rate == 2 * rate:
        out = np.empty(2 * len(pcm), np.int16)
        out[::2] = pcm
        wide = pcm.astype(np.int32)
        out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
        out[-1] = pcm[-1]
        return out
    at = np.arange(len(pcm) * to_rate // rate, dtype=np.int64) * rate
    left = np.minimum(at // to_rate, len(pcm) - 1)
    right = np.minimum(left + 1, len(pcm) - 1)
    part = at % to_rate
    return ((pcm[left].astype(np.int64) * (to_rate - part) + pcm[right].astype(np.int64) * part) // to_rate).astype(np.int16)


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 576, rate: int = 8000) -> DataFrame:
    """``(id, n_bytes, media)``: each text's UTF-8 bytes as 8-bit mu-law codes in a WAV file.

    Bytes 255 fill up to a positive multiple of ``unit``; a null text is empty. The codes are the bytes themselves,
    so nothing is lost. An empty table gives no rows; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(1).to_pylist():
                data = (text or "").encode()
                sizes.append(len(data))
                data += b"\xff" * (max(unit, -(-len(data) // unit) * unit) - len(data))
                media.append(to_wav(data, MULAW, rate))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["_id", "n_bytes", "media"])

    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return source.mapInArrow(run, "_id long, n_bytes long, media binary").withColumnRenamed("_id", id_col)


def decode_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", to_rate: int = 16000) -> DataFrame:
    """``(id, rate, pcm)``: telephony WAV files as resampled 16-bit PCM WAV files. Media that are null, broken or of
    another kind give a null; an empty table gives no rows; other columns are not read."""

    def decoded(blob: bytes | None) -> bytes | None:
        try:
            tag, rate, block, data = from_wav(blob or b"")
            return to_wav(resample(to_pcm(tag, block, data), rate, to_rate).astype("<i2").tobytes(), PCM, to_rate, 2, 16)
        except (ValueError, struct.error, ZeroDivisionError):
            return None

    def run(batches):
        for batch in batches:
            out = [decoded(blob) for blob in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_rate] * len(out), pa.int32()), pa.array(out, pa.binary())], ["_id", "rate", "pcm"])

    source = media.select(F.col(id_col).cast("long").alias("_id"), F.col(media_col).alias("_media"))
    return source.mapInArrow(run, "_id long, rate int, pcm binary").withColumnRenamed("_id", id_col)


def block_energies(codes: np.ndarray, unit: int, at_once: int = 8192) -> np.ndarray:
    """The summed squares of each ADPCM block of ``unit`` bytes."""
    blocks = codes.reshape(-1, unit)
    out = np.empty(len(blocks), np.int64)
    for at in range(0, len(blocks), at_once):
        samples = decode_ima(blocks[at : at + at_once]).astype(np.float64)
        out[at : at + at_once] = np.einsum("ij,ij->i", samples, samples)
    return out


def signal_features(payloads: list[bytes], unit: int, to_rate: int = 16000) -> list[str]:
    """For each payload: loudness, peak, mean and zero crossings of the mu-law signal, loudness as A-law and as
    ADPCM blocks, and the checksum of the resampled signal, all in whole numbers."""
    linear, other = mulaw_table().astype(np.int64), alaw_table().astype(np.int64)
    blocks = [len(data) // unit for data in payloads]
    energy = np.concatenate(([0], np.cumsum(block_energies(np.frombuffer(b"".join(payloads), np.uint8), unit))))
    ends = np.cumsum(blocks)
    adpcm = (energy[ends] - energy[ends - blocks]) // (np.array(blocks) * (1 + 2 * (unit - 4)))
    out = []
    for data, loud in zip(payloads, adpcm.tolist()):
        codes = np.frombuffer(data, np.uint8)
        used = np.bincount(codes, minlength=256)
        pcm = mulaw_table()[codes]
        negative = codes < 128
        parts = {
            "energy": int(used @ (linear * linear)) // len(codes),
            "peak": int(np.abs(linear[used > 0]).max()),
            "mean": int(used @ linear) // len(codes),
            "crossings": int(np.count_nonzero(negative[1:] != negative[:-1])),
            "alaw": int(used @ (other * other)) // len(codes),
            "adpcm": loud,
            "pcm": zlib.crc32(resample(pcm, 8000, to_rate)),
        }
        out.append(";".join(f"{k}={v}" for k, v in parts.items()))
    return out


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 576) -> DataFrame:
    """The digest columns of the stored media, all read back from the written table.

    Equal texts give equal values; a null or empty text is one unit of filling; an empty table gives no rows.
    """
    stored = as_table(store_media(docs, id_col, text_col, unit))

    kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2
    names = ["_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            ids, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(ids), 1024):
                rows = []
                blobs = batch.column(2).slice(at, 1024).to_pylist()
                payloads = [from_wav(blob)[3] for blob in blobs]
                for doc_id, n_bytes, data, blob, feature in zip(ids[at:], sizes[at:], payloads, blobs, signal_features(payloads, unit)):
                    rows.append((doc_id, n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), feature))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select(F.col(id_col).alias("_id"), "n_bytes", "media").mapInArrow(run, schema).withColumnRenamed("_id", id_col)
