"""Telephony audio columns: mu-law and A-law by lookup tables, IMA ADPCM blocks with numpy across blocks, PCM out.

A media value is a WAV file in a binary column, so Parquet stores it and any task can read it. Mono, 8 kHz:
format 7 (mu-law) and 6 (A-law) hold 8-bit samples, 17 holds IMA ADPCM blocks, 1 holds 16-bit PCM.

Bytes kept as mu-law samples are kept without loss. decode_media() gives PCM resampled to 16 kHz; stored_pcm() writes
it as a table. PCM has four times the bytes of its mu-law samples for 16 bits and twice the rate, before compression.

Null texts count as empty and make one block of padding; very long ones are one file each. A media value that is null or no WAV file of these
formats gives null PCM. Equal bytes give equal results; an empty table gives an empty one; only the named
columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_limits, given_first, schema_of, stored, text_or_empty

RATE, PAD, UNIT = 8_000, 0xFF, 576
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, low = (code & 0x70) >> 4, (code & 0x0F) << 4
    size = np.where(exponent == 0, low + 8, (low + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def _step_table() -> np.ndarray:
    """The 89 ADPCM step sizes: from 7, each a tenth more, as the standard rounds them."""
    # fixed values: IMA ADPCM step sizes
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
        1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
        8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ], np.int32)


MULAW_PCM, ALAW_PCM, STEPS = _mulaw_table(), _alaw_table(), _step_table()
# fixed values: IMA ADPCM index changes of the 16 codes
INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8, -1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _adpcm_steps() -> tuple[np.ndarray, np.ndarray]:
    """For state * 16 + code: the change of the predictor, and the next state."""
    state, code = np.divmod(np.arange(len(STEPS) * 16), 16)
    step = STEPS[state]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    return np.where(code & 8, -size, size).astype(np.int32), (np.clip(state + INDEX[code], 0, len(STEPS) - 1) * 16).astype(np.int32)


CHANGE, NEXT = _adpcm_steps()


def decode_adpcm(data: np.ndarray, block: int) -> np.ndarray:
    """Mono IMA ADPCM blocks of `block` bytes to (blocks, 2 * block - 7) samples, one numpy step for a code of all blocks."""
    blocks = data[: len(data) // block * block].reshape(-1, block)
    value = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    state = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    out = np.empty((2 * (block - 4) + 1, len(blocks)), np.int16)
    out[0] = value
    codes = np.empty((block - 4, 2, len(blocks)), np.uint8)
    body = blocks[:, 4:].T
    codes[:, 0], codes[:, 1] = body & 15, body >> 4
    for n, code in enumerate(codes.reshape(-1, len(blocks)), 1):
        state += code
        value += CHANGE.take(state)
        np.clip(value, -32768, 32767, out=value)
        out[n] = value
        state = NEXT.take(state)
    return out.T


def wav(payload: bytes, form: int, block: int = 1) -> bytes:
    """A mono 8 kHz WAV file around the payload."""
    bits = {PCM: 16, ALAW: 8, MULAW: 8, ADPCM: 4}[form]
    extra = struct.pack("<HH", 2, 2 * block - 7) if form == ADPCM else b"" if form == PCM else struct.pack("<H", 0)
    per_second = RATE * block // (2 * block - 7) if form == ADPCM else RATE * block
    head = struct.pack("<HHIIHH", form, 1, RATE, per_second, block, bits) + extra
    even = b"\0" * (len(payload) & 1)
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(payload)) + payload + even
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes | None) -> tuple[int, int, bytes] | None:
    """(format, block, payload) of a WAV file, else None."""
    if media is None or len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, form, block = 12, 0, 1
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if kind == b"fmt " and size >= 16:
            form, block = int.from_bytes(media[at + 8 : at + 10], "little"), int.from_bytes(media[at + 20 : at + 22], "little")
        elif kind == b"data":
            return (form, block, media[at + 8 : at + 8 + size]) if form in (PCM, ALAW, MULAW, ADPCM) else None
        at += 8 + size + (size & 1)
    return None


def expand(form: int, block: int, payload: bytes) -> np.ndarray:
    """The payload's samples as 16-bit PCM at 8 kHz."""
    data = np.frombuffer(payload, np.uint8)
    if form == PCM:
        return data[: len(data) // 2 * 2].view("<i2")
    if form == ADPCM:
        return decode_adpcm(data, block).ravel() if block > 4 else np.zeros(0, np.int16)
    return (MULAW_PCM if form == MULAW else ALAW_PCM)[data]


def resample(pcm: np.ndarray) -> np.ndarray:
    """8 kHz to 16 kHz: the samples, and half-way values by the four-point filter (-1, 9, 9, -1) / 16."""
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    if len(pcm):
        p = np.pad(pcm.astype(np.int32), (1, 2), mode="edge")
        half = (9 * (p[1:-2] + p[2:-1]) - p[:-3] - p[3:] + 8) >> 4
        out[1::2] = np.clip(half, -32768, 32767)
    return out


def text_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded to units of UNIT, as the samples of a mu-law WAV file."""
    arrow_limits(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column(1).to_pylist()
            media = [wav(d + bytes([PAD]) * (max(UNIT, -(-len(d) // UNIT) * UNIT) - len(d)), MULAW) for d in data]
            yield pa.record_batch([b.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.encode(text_or_empty(docs), "utf-8").alias("data")).mapInArrow(work, "doc_id long, n_bytes long, media binary")


def decode_media(table: DataFrame, media: str = "media") -> DataFrame:
    """The table with a column pcm16: a 16 kHz PCM WAV file's samples as little-endian bytes."""
    arrow_limits(table.sparkSession)
    kept = table.drop("pcm16")
    names, plain = kept.columns, given_first(kept, media)
    others = [c for c in plain.columns if c != "given"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(len(b)):  # one long recording at a time
                got = read_wav(b.column(0)[row].as_py())
                pcm = None if got is None else resample(expand(*got)).astype("<i2").tobytes()
                yield pa.record_batch([*(c.slice(row, 1) for c in b.columns), pa.array([pcm], pa.binary())], names=[*b.schema.names, "pcm16"])

    schema = f"{schema_of(plain, ['given', *others])}, pcm16 binary"
    return plain.select("given", *others).mapInArrow(work, schema).select(*plain.columns, "pcm16").toDF(*names, "pcm16")


def stored_pcm(table: DataFrame, media: str = "media") -> DataFrame:
    """The table with its column pcm16, written once as Parquet in the shared folder and read from there."""
    return stored(decode_media(table, media), "pcm")


def _adpcm_levels(payloads: list[bytes]) -> list[int]:
    """Mean absolute level of each payload read as ADPCM blocks of UNIT bytes, all blocks in one pass."""
    counts = [len(p) // UNIT for p in payloads]
    data = np.frombuffer(b"".join(payloads), np.uint8)
    per = np.abs(decode_adpcm(data, UNIT).astype(np.int32)).sum(1, dtype=np.int64)
    ends = np.cumsum(counts)
    total = np.add.reduceat(per, ends - counts)
    return (total // (np.array(counts) * (2 * UNIT - 7))).tolist()


def media_features(table: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) with the media read back: digests of payload and file, and a feature string.

    The feature gives the samples, peak, root mean square and zero crossings of the mu-law PCM, the level of the
    same bytes as A-law and as ADPCM blocks, and the first digits of the resampled PCM's SHA-256.
    """

    def feature(payload: bytes, level: int) -> str:
        data = np.frombuffer(payload, np.uint8)
        pcm = MULAW_PCM[data]
        wide = pcm.astype(np.int64)
        rms = int(np.sqrt(float((wide * wide).sum()) / len(wide)))
        crossings = int(np.count_nonzero(np.diff(np.signbit(pcm))))
        a_level = int(np.abs(ALAW_PCM[data].astype(np.int64)).sum() // len(data))
        digest = hashlib.sha256(resample(pcm).astype("<i2")).hexdigest()[:16]
        return f"n={len(pcm)};peak={int(np.abs(wide).max())};rms={rms};zc={crossings};alaw={a_level};adpcm={level};pcm16={digest}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, start, held = [], 0, 0
            files = b.column(2)
            while start < len(b):
                end, held = start, 0
                while end < len(b) and (end == start or held < 1 << 20):
                    held += len(files[end].as_buffer())
                    end += 1
                media = files.slice(start, end - start).to_pylist()
                payloads = [read_wav(m)[2] for m in media]
                for m, p, level in zip(media, payloads, _adpcm_levels(payloads)):
                    rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(p, level)))
                start = end
            cols = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return table.select("doc_id", "n_bytes", "media").mapInArrow(work, schema)
