import hashlib
import zlib

import numpy as np

from folioforge.llm import media

from .common import corpus, frame, key

WAVE = (np.sin(np.arange(8000) * 0.05) * 12000).astype(np.int16)


def test_g711():
    assert media.MULAW_TABLE[[0, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert media.ALAW_TABLE[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    for codec in ("mulaw", "alaw"):
        codes = media.compress(WAVE, codec)
        assert np.abs(media.expand(codes, codec).astype(int) - WAVE).max() <= 512
        assert (media.expand(media.compress(media.expand(codes, codec), codec), codec) == media.expand(codes, codec)).all()


def test_adpcm_blocks_are_decoded_apart():
    data = media.adpcm_encode(WAVE)
    whole = media.adpcm_decode(data)
    assert np.corrcoef(whole[: len(WAVE)], WAVE)[0, 1] > 0.99
    each = len(whole) // (len(data) // 256)
    assert (media.adpcm_decode(data[256:512]) == whole[each : 2 * each]).all()
    assert (media.adpcm_decode(data[:100]) == whole[: 1 + 2 * 96]).all()  # a last block cut short
    assert len(media.adpcm_decode(data[:3])) == 0 and (media.adpcm_decode(data[:259])[:each] == whole[:each]).all()


def slow_adpcm(data, block):
    """Sample by sample, by the rule's own additions."""
    out = []
    for at in range(0, len(data), block):
        b = data[at : at + block]
        value, index = int.from_bytes(b[:2], "little", signed=True), min(b[2], 88)
        out.append(value)
        for byte in b[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(media.STEPS[index])
                diff = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
                index = max(0, min(88, index + int(media.MOVES[code])))
                out.append(value)
    return np.array(out, np.int16)


def slow_resample(x, rate, to):
    """Each output sample as its own weighted sum."""
    g = np.gcd(rate, to)
    up, down = to // g, rate // g
    cut = min(1.0, up / down)
    half = int(np.ceil(16 / cut))
    out = []
    for m in range(-(-len(x) * up // down)):
        whole, phase = m * down // up, m * down % up / up
        k = np.arange(-half + 1, half + 1)
        w = cut * np.sinc(cut * (k - phase)) * (0.5 + 0.5 * np.cos(np.pi * np.clip((k - phase) / half, -1, 1)))
        at = whole + k
        near = np.where((at >= 0) & (at < len(x)), x[np.clip(at, 0, len(x) - 1)], 0).astype(float)
        out.append(np.clip(np.rint((near * w).sum() / w.sum()), -32768, 32767))
    return np.array(out, np.int16)


def test_decoders_against_slow_ones(monkeypatch):
    raw = np.random.default_rng(3).integers(0, 256, 1000, dtype=np.uint8)
    assert (media.adpcm_decode(raw, 256) == slow_adpcm(raw.tobytes(), 256)).all()
    x = WAVE[:500]
    for rate, to in ((8000, 16000), (8000, 11025), (16000, 8000)):
        want = slow_resample(x, rate, to)
        assert np.abs(media.resample(x, rate, to).astype(int) - want).max() <= 1
        monkeypatch.setattr(media, "SLICE", 64)
        assert np.abs(media.resample(x, rate, to).astype(int) - want).max() <= 1
        monkeypatch.undo()


def test_stereo_widths_and_damaged_headers(spark):
    left, right = media.adpcm_encode(WAVE[:505]), media.adpcm_encode(WAVE[505:1010])
    block = np.concatenate((left[:4], right[:4], np.stack((left[4:].reshape(-1, 4), right[4:].reshape(-1, 4)), axis=1).reshape(-1)))
    both = media.adpcm_decode(block, 512, 2)
    assert (both[:, 0] == media.adpcm_decode(left)).all() and (both[:, 1] == media.adpcm_decode(right)).all()
    good = media.wav(WAVE.tobytes(), "pcm")
    at = good.index(b"fmt ") + 8
    patched = lambda offset, value: good[: at + offset] + value + good[at + offset + len(value) :]
    stereo = media.wav(np.stack((WAVE, -WAVE), axis=1).tobytes(), "pcm", channels=2)
    adpcm = media.wav(left.tobytes(), "adpcm")
    k = adpcm.index(b"fmt ") + 8
    rows = [stereo, patched(4, b"\0\0\0\0"), patched(2, b"\0\0"), patched(14, b"\7\0"), patched(0, b"\x99\0"), adpcm[: k + 12] + b"\2\0" + adpcm[k + 14 :], adpcm[: k + 12] + b"\0\0" + adpcm[k + 14 :], good[:20], good[:30], patched(14, b"\x08\0")]
    got = [r["pcm"] for r in media.to_pcm(spark.createDataFrame(list(enumerate(rows)), "id long, media binary")).orderBy("id").collect()]
    samples, rate = media.decode(bytes(got[0]))
    assert samples.shape == (16000, 2) and rate == 16000
    assert np.abs(samples[:, 0].astype(int) + samples[:, 1]).max() <= 1
    assert all(x is None for x in got[1:9]) and got[9] is not None


def test_query_against_brute_force(spark):
    from folioforge.llm import registry

    from ..conftest import DATA

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    got = registry.QUERIES["op8_telephony_audio"](spark, f"{DATA}/sf0.001").collect()
    assert len(got) == len(texts)
    for n, r in enumerate(got):
        raw = (texts[r["doc_id"]] or "").encode()
        full = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        codes = np.frombuffer(full, np.uint8)
        x = media.MULAW_TABLE[codes].astype(np.int64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        said = dict(p.split("=") for p in r["feature"].split(";"))
        assert int(said["rms"]) == int(np.sqrt((x * x).sum() // len(x))) and int(said["peak"]) == np.abs(x).max()
        assert int(said["crossings"]) == (np.diff(codes >> 7) != 0).sum() and r["pcm_bytes"] == 44 + 4 * len(full)
        if n < 25:
            assert int(said["adpcm"]) == zlib.crc32(slow_adpcm(full, 256).astype("<i2").tobytes())
            high = media.wav(media.resample(x.astype(np.int16), 8000, 16000).tobytes(), "pcm", 16000)
            assert said["pcm16000"] == hashlib.sha256(high).hexdigest()[:16]
            assert np.abs(np.frombuffer(high[44:], "<i2")[:400].astype(int) - slow_resample(x.astype(np.int16), 8000, 16000)[:400]).max() <= 1


def test_resample_round_trip():
    up = media.resample(WAVE, 8000, 16000)
    assert len(up) == 16000
    assert np.abs(media.resample(up, 16000, 8000)[100:-100].astype(int) - WAVE[100:-100]).max() < 20


def test_pcm_column(spark):
    files = [(1, media.wav(media.compress(WAVE, "mulaw").tobytes(), "mulaw")), (2, media.wav(media.adpcm_encode(WAVE).tobytes(), "adpcm")), (3, None), (4, b"noise"), (5, media.wav(b"", "alaw"))]
    got = {r["id"]: r["pcm"] for r in media.to_pcm(spark.createDataFrame(files, "id long, media binary")).collect()}
    assert got[3] is None and got[4] is None
    samples, rate = media.decode(bytes(got[1]))
    assert rate == 16000 and len(samples) == 16000
    assert len(media.decode(bytes(got[5]))[0]) == 0


def test_texts(spark):
    rows = corpus(6) + [(500, "x" * 64), (501, "y" * 65), (502, "z" * 500_000)]
    got = media.store_texts(frame(spark, rows)).collect()
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        full = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        want.append((d, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert len(r["media"]) == r["media_bytes"] and hashlib.sha256(bytes(r["media"])).hexdigest() == r["media_sha256"]
        assert hashlib.sha256(media.unwav(bytes(r["media"])).data).hexdigest() == r["payload_sha256"]
    assert media.store_texts(frame(spark, [])).count() == 0
