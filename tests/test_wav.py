"""WAV files: split reads against a plain reader, formats, broken files, and a round trip."""

import struct
import uuid
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentlens.sources import wav


def folder():
    return f"/tmp/momentlens-wav-{uuid.uuid4().hex}"


def pcm(path, values, rate=8000, width=2):
    """By the standard library."""
    import os

    os.makedirs(os.path.dirname(path), exist_ok=True)
    with wave.open(path, "wb") as f:
        f.setnchannels(values.shape[1])
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(values.tobytes())


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_split_reads_equal_a_plain_reader(spark):
    at = folder()
    x = np.random.default_rng(5).integers(-(2**15), 2**15, (10_001, 2)).astype("<i2")
    pcm(f"{at}/two.wav", x)
    whole = [("two.wav", i, 8000, c, float(np.float32(x[i, c] / 32768))) for i in range(len(x)) for c in range(2)]
    for size in (wav.SPLIT_BYTES, 5000, 997):  # 997 cuts frames
        d = wav.samples(spark, at, split_bytes=size)
        assert d.rdd.getNumPartitions() == -(-(44 + x.nbytes) // size)
        assert rows(d) == whole
    assert rows(wav.samples(spark, f"file:{at}/two.wav", mono=True, split_bytes=3000)) == [("two.wav", i, 8000, pytest.approx(float(x[i].mean()) / 32768, abs=1e-7)) for i in range(len(x))]
    assert rows(wav.decoded(spark.read.format("binaryFile").load(at))) == whole


def container(kind, bits, channels, data, extra=b"", junk=True, extensible=False, length=None):
    fmt = struct.pack("<HHIIHH", 0xFFFE if extensible else kind, channels, 16000, 16000 * channels * bits // 8, channels * bits // 8, bits)
    if extensible:
        fmt += struct.pack("<HHI", 22, bits, 0) + struct.pack("<H", kind) + bytes(14)
    chunks = (b"LIST" + struct.pack("<I", 3) + b"abc\0" if junk else b"") + b"fmt " + struct.pack("<I", len(fmt)) + fmt + extra
    body = b"WAVE" + chunks + b"data" + struct.pack("<I", len(data) if length is None else length) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def values_of(raw):
    read = lambda at, n: raw[at : at + n]
    h = wav.header(read, len(raw))
    return [v for b in wav.batches("x", h, read, 0, h.frames, False) for v in b.column("value").to_pylist()]


def test_formats():
    v = [-1.0, -0.5, 0.0, 0.25, 0.75, 0.5]
    assert values_of(container(1, 8, 2, bytes(int(x * 128 + 128) for x in v))) == v
    assert values_of(container(1, 16, 1, struct.pack("<6h", *[int(x * 2**15) for x in v]))) == v
    assert values_of(container(1, 24, 3, b"".join(int(x * 2**23).to_bytes(3, "little", signed=True) for x in v))) == v
    assert values_of(container(1, 32, 2, struct.pack("<6i", *[int(x * 2**31) for x in v]))) == v
    assert values_of(container(3, 32, 1, struct.pack("<6f", *v), extensible=True)) == v
    assert values_of(container(3, 64, 1, struct.pack("<6d", *v))) == v


def test_cut_and_open_files():
    data = struct.pack("<5h", 1, 2, 3, 4, 5)
    assert len(values_of(container(1, 16, 2, data))) == 4  # half a frame is left out
    assert len(values_of(container(1, 16, 1, data, length=0xFFFFFFFF))) == 5
    assert len(values_of(container(1, 16, 1, data, length=1000))) == 5
    assert values_of(container(1, 16, 1, b"")) == []
    big = container(1, 16, 1, data, extra=b"ds64" + struct.pack("<IQQQ", 24, 0, 6, 0), length=0xFFFFFFFF)
    assert len(values_of(big)) == 3
    for raw in (b"", b"RIFF", b"RIFF\0\0\0\0AVI ", container(1, 16, 1, data)[:20], container(2, 4, 1, data), container(1, 16, 0, data)):
        with pytest.raises(ValueError):
            values_of(raw)


def test_ranges_cover_each_frame_once():
    raw = container(1, 24, 2, bytes(6 * 50))
    h = wav.header(lambda at, n: raw[at : at + n], len(raw))
    for size in (1, 5, 7, 64, 1000):
        found = [f for a in range(0, len(raw), size) for f in range(*wav.frames_between(h, a, min(len(raw), a + size)))]
        assert found == list(range(50))


def test_no_files_and_broken_ones(spark):
    import os

    at = folder()
    os.makedirs(at)
    assert wav.samples(spark, at).count() == 0
    with open(f"{at}/note.txt", "w") as f:
        f.write("no sound")
    assert wav.samples(spark, at).count() == 0
    with open(f"{at}/bad.wav", "w") as f:
        f.write("no sound in here")
    with pytest.raises(Exception, match="not a WAV file"):
        wav.samples(spark, at).count()
    with pytest.raises(Exception, match="nowhere"):
        wav.samples(spark, f"{at}/nowhere").count()


def test_round_trip(spark):
    at = folder()
    d = spark.range(5000).select(F.when(F.col("id") % 5 == 0, "b-1").otherwise("a").alias("asset"), F.col("id").alias("n"))
    d = d.selectExpr("asset", "row_number() OVER (PARTITION BY asset ORDER BY n) - 1 AS idx", "(n % 2000 - 1000) / 1000 AS value")
    wav.write_recordings(d, at, 100, length=512)
    back = wav.continued(wav.samples(spark, at, mono=True, split_bytes=600), 512)
    want = d.selectExpr("asset", "cast(idx AS long) idx", "round(greatest(-32768D, least(32767D, value * 32768D))) / 32768D AS value")
    got = back.join(want.withColumnRenamed("value", "w"), ["asset", "idx"], "full").where("value IS NULL OR w IS NULL OR abs(value - w) > 1 / 32768D")
    assert back.count() == 5000 and got.count() == 0
    assert {r["rate"] for r in back.select("rate").distinct().collect()} == {100}


def test_a_failed_write_leaves_nothing(spark):
    import os

    at = folder()
    bad = spark.range(100).selectExpr("'a' AS asset", "id AS idx", "if(id = 77, raise_error('broken'), id / 100) AS value")
    with pytest.raises(Exception, match="broken"):
        wav.write_recordings(bad, at, 100)
    assert [x for x in (os.listdir(at) if os.path.exists(at) else []) if x.endswith(".wav")] == []
