import hashlib
import zlib

import numpy as np
import pytest

from vesperline.llm import media


def test_tables_against_known_codes():
    mu, a = media.mulaw_table(), media.alaw_table()
    assert mu[0] == -32124 and mu[0x80] == 32124 and mu[0xFF] == 0 and mu[0x7F] == 0
    assert a[0xD5] == 8 and a[0x55] == -8 and a[0xAA] == 32256 and a[0x2A] == -32256
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def slow_ima(block):
    """One nibble after another, as the format tells."""
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(media.IMA_STEPS[index])
            change = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
            value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
            index = max(0, min(88, index + int(media.IMA_MOVES[nibble & 7])))
            out.append(value)
    return out


def test_adpcm_blocks_decode_like_one_by_one():
    blocks = np.random.default_rng(1).integers(0, 256, (50, 36), dtype=np.uint8)
    assert media.decode_ima(blocks).tolist() == [slow_ima(bytes(b)) for b in blocks]
    assert media.block_energies(blocks.ravel(), 36, 7).tolist() == [sum(x * x for x in slow_ima(bytes(b))) for b in blocks]


@pytest.mark.parametrize("tag,block,bits", [(media.MULAW, 1, 8), (media.ALAW, 1, 8), (media.IMA_ADPCM, 36, 4), (media.PCM, 2, 16)])
def test_wav_round_trip(tag, block, bits):
    for data in (b"", bytes(range(144)), b"\1" * 73):
        assert media.from_wav(media.to_wav(data, tag, 8000, block, bits)) == (tag, 8000, block, data)


def test_resampling():
    pcm = np.array([0, 100, -100, 32767, -32768], np.int16)
    assert media.resample(pcm, 8000, 16000).tolist() == [0, 50, 100, 0, -100, 16333, 32767, -1, -32768, -32768]
    assert media.resample(pcm, 8000, 8000) is pcm and len(media.resample(pcm[:0], 8000, 16000)) == 0
    assert len(media.resample(np.zeros(441, np.int16), 44100, 16000)) == 160


def test_digest_rows(spark):
    texts = [None, "", "é" * 288, "x" * 577, "a b", "a b", "long " * 9000]
    df = spark.createDataFrame([(i, t, b"z", 1) for i, t in enumerate(texts)], "doc_id long, text string, media binary, n_bytes int")
    rows = {r.doc_id: r for r in media.media_digest(df).collect()}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(data), len(payload), zlib.crc32(payload[-32:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        wav = media.to_wav(payload, media.MULAW, 8000)
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())
        energy = int((media.mulaw_table()[np.frombuffer(payload, np.uint8)].astype(np.int64) ** 2).sum()) // len(payload)
        assert r.feature.startswith(f"energy={energy};")
    assert rows[4][1:] == rows[5][1:] and rows[0][1:] == rows[1][1:]
    assert media.media_digest(df.where("false")).count() == 0


def test_decoded_column(spark):
    wav = media.to_wav(bytes([0x80, 0xFF]), media.MULAW, 8000)
    rows = media.decode_media(spark.createDataFrame([(1, wav), (2, None)], "doc_id long, media binary")).orderBy("doc_id").collect()
    tag, rate, _, data = media.from_wav(bytes(rows[0].pcm))
    assert (tag, rate) == (media.PCM, 16000) and np.frombuffer(data, "<i2").tolist() == [32124, 16062, 0, 0]
    assert rows[1].pcm is None
