"""Telephony audio columns (operator 8).

G.711 mu-law and A-law samples expand by lookup tables of 256 entries; IMA ADPCM blocks are
decoded with numpy across blocks: one step per sample of a block, for all blocks of a batch of
files at once.  Decoded sound is resampled with a windowed-sinc polyphase filter and stored as 16-bit PCM.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import core

PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 0x11
CODECS = {"alaw": ALAW, "mulaw": MULAW, "adpcm": ADPCM, "pcm": PCM}


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    t = (((u & 0x0F) << 3) + 0x84 << ((u & 0x70) >> 4)) - 0x84
    return np.where(u & 0x80, -t, t).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.int32) ^ 0x55
    t, seg = (a & 0x0F) << 4, (a & 0x70) >> 4
    t = np.where(seg == 0, t + 8, (t + 0x108) << np.maximum(seg - 1, 0))
    return np.where(a & 0x80, t, -t).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = _mulaw_table(), _alaw_table()
STEPS = np.array([min(32767, int(x)) for x in (7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767)], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """Change of the value, and next index, for each index and code."""
    index, code = np.repeat(np.arange(89, dtype=np.int32), 16), np.tile(np.arange(16, dtype=np.int32), 89)
    step = STEPS[index]
    diff = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    return np.where(code & 8, -diff, diff).astype(np.int32), np.clip(index + MOVES[code], 0, 88).astype(np.int32)


CHANGES, NEXT = _adpcm_tables()


def expand(codes: np.ndarray, codec: str) -> np.ndarray:
    """16-bit samples of G.711 codes."""
    return (MULAW_TABLE if codec == "mulaw" else ALAW_TABLE)[codes]


def compress(samples: np.ndarray, codec: str) -> np.ndarray:
    """Nearest G.711 code of each sample."""
    table = MULAW_TABLE if codec == "mulaw" else ALAW_TABLE
    order = np.argsort(table, kind="stable")
    known = table[order].astype(np.int32)
    x = samples.astype(np.int32)
    k = np.clip(np.searchsorted(known, x), 1, 255)
    k -= x - known[k - 1] <= known[k] - x
    return order[k].astype(np.uint8)


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """Mono IMA ADPCM blocks, one a row (4 bytes of state, then two samples a byte) -> samples, one block a row."""
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.clip(blocks[:, 2].astype(np.int32), 0, 88)
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(codes), len(blocks)), np.int16)
    out[0] = value
    for k, byte in enumerate(codes):
        for half, code in enumerate((byte & 15, byte >> 4)):
            # a step and its index are all that a code's change depends on
            at = index * 16 + code
            value = np.clip(value + CHANGES[at], -32768, 32767)
            index = NEXT[at]
            out[1 + 2 * k + half] = value
    return out.T


def adpcm_decode(data: np.ndarray, block: int = 256, channels: int = 1) -> np.ndarray:
    """IMA ADPCM blocks of ``block`` bytes -> 16-bit samples (frames x channels where there are several).

    A last block that is cut short gives the whole samples it has; less than a block's states gives none.
    """
    head = 4 * channels
    full = len(data) // block * block
    rows = [(data[:full].reshape(-1, block))] if full else []
    rest = data[full:]
    rest = rest[: len(rest) if channels == 1 else head + (len(rest) - head) // head * head]
    if len(rest) >= head:
        rows.append(rest.reshape(1, -1))
    out = []
    for x in rows:
        if channels == 1:
            out.append(adpcm_blocks(x).reshape(-1, 1))
        else:  # states of all channels, then four bytes of each in turn
            body = x[:, head : head + (x.shape[1] - head) // head * head].reshape(len(x), -1, channels, 4)
            each = [adpcm_blocks(np.concatenate((x[:, 4 * c : 4 * c + 4], body[:, :, c].reshape(len(x), -1)), axis=1)).reshape(-1) for c in range(channels)]
            out.append(np.stack(each, axis=1))
    got = np.concatenate(out) if out else np.zeros((0, channels), np.int16)
    return got[:, 0] if channels == 1 else got


def adpcm_encode(samples: np.ndarray, block: int = 256) -> np.ndarray:
    """Inverse of adpcm_decode up to quantisation; the end is filled with silence."""
    each = 1 + 2 * (block - 4)
    n = max(1, -(-len(samples) // each))
    x = np.zeros(n * each, np.int32)
    x[: len(samples)] = samples
    x = x.reshape(n, each)
    out = np.zeros((n, block), np.uint8)
    out[:, :2] = x[:, 0].astype("<i2")[:, None].view(np.uint8)
    value, index = x[:, 0], np.zeros(n, np.int32)
    for k in range(1, each):
        diff, step = x[:, k] - value, STEPS[index]
        code = np.where(diff < 0, 8, 0) | np.minimum(np.abs(diff) * 4 // step, 7)
        at = index * 16 + code
        value, index = np.clip(value + CHANGES[at], -32768, 32767), NEXT[at]
        out[:, 4 + (k - 1) // 2] |= (code << (0 if k % 2 else 4)).astype(np.uint8)
    return out.reshape(-1)


#: Samples that resample works on at once.
SLICE = 1 << 18


def _bank(rate: int, to: int, taps: int) -> tuple[int, int, int, np.ndarray]:
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    cut = min(1.0, up / down)
    half = int(math.ceil(taps / cut))
    k = np.arange(-half + 1, half + 1)
    bank = k[None, :] - np.arange(up)[:, None] / up
    bank = cut * np.sinc(cut * bank) * (0.5 + 0.5 * np.cos(np.pi * np.clip(bank / half, -1, 1)))
    return up, down, half, bank / bank.sum(axis=1, keepdims=True)


def resample(samples: np.ndarray, rate: int, to: int, taps: int = 16) -> np.ndarray:
    """Windowed-sinc polyphase resampling to ``to`` samples a second, along the first axis, a slice at a time."""
    if rate == to or not len(samples):
        return samples
    if samples.ndim > 1:
        return np.stack([resample(x, rate, to, taps) for x in samples.T], axis=1)
    up, down, half, bank = _bank(rate, to, taps)
    n = -(-len(samples) * up // down)
    out = np.empty(n, np.int16)
    step = max(1, SLICE * up // down) // up * up or up
    for first in range(0, n, step):
        at = np.arange(first, min(n, first + step), dtype=np.int64) * down
        whole, phase = at // up, at % up
        lo, hi = int(whole[0]) - half + 1, int(whole[-1]) + half + 1
        x = np.pad(samples[max(lo, 0) : hi].astype(np.float64), (max(-lo, 0), max(hi - len(samples), 0)))
        got = np.zeros(len(at))
        if down == 1:  # neighbours of a phase are neighbours in x
            m = len(at) // up
            for p in range(up):
                own = np.zeros(m)
                for j in range(2 * half):
                    own += x[j : j + m] * bank[p, j]
                got[p::up] = own
        else:
            for j in range(2 * half):
                got += x[whole - int(whole[0]) + j] * bank[phase, j]
        out[first : first + len(at)] = np.clip(np.rint(got), -32768, 32767)
    return out


def wav(data: bytes, codec: str, rate: int = 8000, block: int = 256, channels: int = 1) -> bytes:
    """A RIFF file around encoded samples."""
    kind = CODECS[codec]
    bits, align = {"pcm": (16, 2 * channels), "adpcm": (4, block)}.get(codec, (8, channels))
    frames = 1 + 2 * (block // channels - 4)
    per_s = rate * align if codec != "adpcm" else rate * block // frames
    extra = struct.pack("<HH", 2, frames) if codec == "adpcm" else b"" if codec == "pcm" else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", kind, channels, rate, per_s, align, bits) + extra
    pad = b"\0" * (len(data) % 2)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


@dataclass
class Track:
    """What a RIFF file says of its samples, and their bytes."""

    codec: str
    rate: int
    channels: int
    bits: int
    block: int
    data: bytes


def unwav(raw: bytes) -> Track:
    """The track of a RIFF file; ValueError if it is none of a supported codec, or damaged in its header."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, head, data = 12, None, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(raw) and size >= 16:
            head = struct.unpack_from("<HHIIHH", raw, at + 8)
        elif name == b"data":
            data = raw[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if head is None or data is None:
        raise ValueError("no format or no samples")
    codec = {v: k for k, v in CODECS.items()}.get(head[0])
    _, channels, rate, _, block, bits = head
    fits = {"pcm": bits in (8, 16, 24, 32), "adpcm": bits == 4 and block > 4 * channels and (channels == 1 or block % (4 * channels) == 0)}.get(codec, codec is not None and bits == 8)
    if not fits or not rate or not channels:
        raise ValueError("unsupported or damaged format")
    return Track(codec, rate, channels, bits, block, data)


def decode(raw: bytes) -> tuple[np.ndarray, int]:
    """16-bit samples (frames x channels where there are several) and rate of a RIFF file of any supported codec."""
    t = unwav(raw)
    codes = np.frombuffer(t.data, np.uint8)
    if t.codec == "adpcm":
        return adpcm_decode(codes, t.block, t.channels), t.rate
    if t.codec == "pcm":
        width = t.bits // 8
        x = codes[: len(codes) // width * width].reshape(-1, width)
        # 8-bit samples are unsigned; of wider ones the upper 16 bits count
        samples = ((x[:, 0].astype(np.int16) - 128) << 8).astype(np.int16) if width == 1 else np.ascontiguousarray(x[:, -2:]).view("<i2")[:, 0]
    else:
        samples = expand(codes, t.codec)
    if t.channels > 1:
        samples = samples[: len(samples) // t.channels * t.channels].reshape(-1, t.channels)
    return samples, t.rate


def to_pcm(audio: DataFrame, media_col: str = "media", rate: int = 16000) -> DataFrame:
    """Adds ``pcm``, the media column decoded, resampled to ``rate`` and stored as 16-bit PCM in RIFF.

    Mu-law, A-law, IMA ADPCM, and PCM of 8 to 32 bits, with any number of channels, which are kept.
    Null stays null; what isn't a supported file, or has a damaged header, gives null; samples that a
    file is cut short of are missing.  All columns of audio are kept; a column named pcm is
    replaced.  Repeated rows are handled alike, an empty table gives none.
    """

    @F.pandas_udf(T.BinaryType())
    def convert(col):
        def one(raw):
            try:
                samples, at = decode(raw)
            except ValueError:
                return None
            return wav(resample(samples, at, rate).astype("<i2").tobytes(), "pcm", rate, channels=1 if samples.ndim == 1 else samples.shape[1])

        return col.map(one, na_action="ignore")

    return audio.withColumn("pcm", convert(media_col))


def payload_of(text: bytes, unit: int = 64) -> bytes:
    return text + b"\0" * (max(unit, -(-len(text) // unit) * unit) - len(text))


#: Bytes of an ADPCM block in stored payloads; a payload is a multiple of 64 bytes, so its last block may be shorter.
ADPCM_BLOCK = 256


def _batch_adpcm(payloads: list[bytes]) -> list[np.ndarray]:
    """Samples of each payload read as ADPCM blocks, all blocks of one length decoded together."""
    place: dict[int, list[tuple[int, int]]] = {}
    for k, p in enumerate(payloads):
        for at in range(0, len(p), ADPCM_BLOCK):
            place.setdefault(min(ADPCM_BLOCK, len(p) - at), []).append((k, at))
    out = [np.empty(sum(1 + 2 * (min(ADPCM_BLOCK, len(p) - at) - 4) for at in range(0, len(p), ADPCM_BLOCK)), np.int16) for p in payloads]
    each = 1 + 2 * (ADPCM_BLOCK - 4)
    for size, where in place.items():
        for i in range(0, len(where), 4096):
            some = where[i : i + 4096]
            blocks = np.frombuffer(b"".join(payloads[k][at : at + size] for k, at in some), np.uint8).reshape(-1, size)
            for (k, at), x in zip(some, np.ascontiguousarray(adpcm_blocks(blocks))):
                first = at // ADPCM_BLOCK * each
                out[k][first : first + len(x)] = x
    return out


def _batch_resampled(tracks: list[np.ndarray], rate: int, to: int) -> list[np.ndarray]:
    """Each track resampled; where ``to`` is a multiple of ``rate`` all at once, with silence between them."""
    if to % rate:
        return [resample(x, rate, to) for x in tracks]
    gap = 64
    joined = np.zeros(sum(len(x) + gap for x in tracks), np.int16)
    at, starts = 0, []
    for x in tracks:
        joined[at : at + len(x)] = x
        starts.append(at)
        at += len(x) + gap
    out, up = resample(joined, rate, to), to // rate
    return [out[s * up : (s + len(x)) * up] for s, x in zip(starts, tracks)]


def _store(codec: str, rate: int, to: int, schema: pa.Schema, with_media: bool):
    names = [f.name for f in schema if f.name != "doc_id"]
    table = (MULAW_TABLE if codec == "mulaw" else ALAW_TABLE).astype(np.int64)
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches):
        for batch in batches:
            buf, off = core.text_buffer(batch.column("text"))
            out = {k: [] for k in names}
            for i, j in core.runs(off):
                texts = [buf[off[k] : off[k + 1]].tobytes() for k in range(i, j)]
                files = [wav(payload_of(x), codec, rate) for x in texts]
                back = [unwav(x).data for x in files]
                tracks = [expand(np.frombuffer(x, np.uint8), codec) for x in back]
                for text, media, data, adpcm, high in zip(texts, files, back, _batch_adpcm(back), _batch_resampled(tracks, rate, to)):
                    codes = np.frombuffer(data, np.uint8)
                    count = np.bincount(codes, minlength=256)
                    loud = math.isqrt(int((count * table * table).sum()) // len(codes))
                    sign = codes >> 7
                    pcm = wav(high.astype("<i2").tobytes(), "pcm", to)
                    feature = f"codec={codec};rate={rate};samples={len(codes)};rms={loud};peak={int(np.abs(table[count > 0]).max())};crossings={int((sign[1:] != sign[:-1]).sum())};adpcm={zlib.crc32(adpcm.astype('<i2').tobytes())};pcm{to}={sha(pcm)[:16]}"
                    row = {"n_bytes": len(text), "payload_bytes": len(data), "payload_sha256": sha(data), "tail_crc32": zlib.crc32(data[-64:]), "media_bytes": len(media), "media_sha256": sha(media), "feature": feature, "pcm_bytes": len(pcm), "media": media, "pcm": pcm}
                    for n in names:
                        out[n].append(row[n])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(f.type) if f.name == "doc_id" else pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


def store_texts(docs: DataFrame, codec: str = "mulaw", rate: int = 8000, to: int = 16000, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """Stores each text's bytes, zero-filled to a multiple of 64, as 8-bit samples of a RIFF file.

    The stored bytes are read back and decoded: expanded by table, resampled to ``to`` and stored
    as 16-bit PCM; and read as ADPCM blocks of 256 bytes.  Returns doc_id, n_bytes,
    payload_bytes, payload_sha256, tail_crc32 (both of the bytes read back), media_bytes,
    media_sha256, feature (root mean square, peak and zero crossings of the expanded samples, CRC-32
    of the ADPCM samples, digest of the PCM file), pcm_bytes and, with ``with_media``, both files.

    Null counts as empty: 64 zero bytes.  Null ids and repeated rows are kept; equal texts give
    equal values.  Nothing is shuffled.  Other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    L, S = T.LongType(), T.StringType()
    files = [("media", T.BinaryType()), ("pcm", T.BinaryType())] if with_media else []
    schema = T.StructType([T.StructField(n, t) for n, t in (("doc_id", docs.schema[id_col].dataType), ("n_bytes", L), ("payload_bytes", L), ("payload_sha256", S), ("tail_crc32", L), ("media_bytes", L), ("media_sha256", S), ("feature", S), ("pcm_bytes", L), *files)])
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(_store(codec, rate, to, to_arrow_schema(schema), with_media), schema)
