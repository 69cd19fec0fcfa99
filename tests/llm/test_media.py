import hashlib
import wave
import zlib
from io import BytesIO

import numpy as np

from tessera.llm import telephony as T


def test_law_tables_match_the_standard_values():
    # fixed values: ends and middles of the G.711 tables
    assert [int(T.MULAW_PCM[c]) for c in (0x00, 0x7F, 0x80, 0xFF, 0x0F, 0x10)] == [-32124, 0, 32124, 0, -16764, -15996]
    assert [int(T.ALAW_PCM[c]) for c in (0x55, 0xD5, 0x2A, 0xAA, 0x00, 0x80)] == [-8, 8, -32256, 32256, -5504, 5504]
    assert len(set(T.MULAW_PCM.tolist())) == 255 and len(set(T.ALAW_PCM.tolist())) == 256


def plain_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(T.STEPS[index])
            diff = step >> 3
            diff += step if code & 4 else 0
            diff += step >> 1 if code & 2 else 0
            diff += step >> 2 if code & 1 else 0
            value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
            index = max(0, min(88, index + int(T.INDEX[code])))
            out.append(value)
    return out


def test_adpcm_blocks_match_a_plain_decoder():
    data = np.random.default_rng(1).integers(0, 256, 576 * 5, dtype=np.uint8)
    got = T.decode_adpcm(data, 576)
    assert got.tolist() == [plain_adpcm(data[i * 576 : (i + 1) * 576].tobytes()) for i in range(5)]


def test_files_round_trip_and_resampling_keeps_samples():
    for form, block in ((T.PCM, 2), (T.ALAW, 1), (T.MULAW, 1), (T.ADPCM, 64)):
        payload = bytes(range(256)) * 3
        assert T.read_wav(T.wav(payload, form, block)) == (form, block, payload)
    assert T.read_wav(None) is None and T.read_wav(b"") is None and T.read_wav(b"RIFFxxxxWAVE") is None
    pcm = np.array([0, 1000, -32768, 32767, 5], np.int16)
    assert T.resample(pcm)[::2].tolist() == pcm.tolist() and len(T.resample(pcm[:0])) == 0
    with wave.open(BytesIO(T.wav(pcm.tobytes(), T.PCM, 2))) as w:
        assert (w.getframerate(), w.getnchannels(), w.readframes(9)) == (8000, 1, pcm.tobytes())


def test_payloads_are_read_back(hostile, nothing):
    rows = T.media_features(T.text_media(hostile)).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in hostile.collect()}
    assert len(rows) == 9
    for r in rows:
        b = texts[r.doc_id]
        p = b + b"\xff" * (max(576, -(-len(b) // 576) * 576) - len(b))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert r.media_sha256 == hashlib.sha256(T.wav(p, T.MULAW)).hexdigest()
    same = [r for r in rows if r.doc_id in (4, 5)]
    assert len({(r.feature, r.media_sha256) for r in same}) == 1
    assert T.media_features(T.text_media(nothing)).collect() == []


def test_decoded_column(spark):
    table = spark.createDataFrame([(1, bytearray(T.wav(b"\x00\x80\xff", T.MULAW)), "x"), (2, None, "y"), (3, bytearray(b"no"), "z")], "id long, media binary, pcm16 string")
    got = {r.id: r.pcm16 for r in T.decode_media(table).collect()}
    assert np.frombuffer(got[1], "<i2")[::2].tolist() == [-32124, 32124, 0] and got[2] is None and got[3] is None
