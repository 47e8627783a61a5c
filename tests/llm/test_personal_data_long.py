"""Personal data in long texts, overlapping spans, and spans that the method adds."""

import random
import re
import time

from pyspark.sql import functions as F

from momentlens.llm import personal_data

PARTS = ["a.b@mail.com", "10.0.0.1", "4539 1488 0343 6467", "+49 30 1234567", " call me ", "x@y.de10.0.0.2", "é🎉", "jo (at) mail (dot) com", "555-010-4477", "phone: 555-010-4478", "1:2:3:4:5:6:7:8", ". "]


def test_running(spark):
    d = spark.createDataFrame([([3, 1, 4, 1, 5, 9, 2, 6],), ([],), ([7],), (list(range(50)),)], "v array<int>")
    for r in d.select("v", personal_data._running(F.col("v"), lambda a, b: a + b).alias("s"), personal_data._running(F.col("v"), personal_data._larger).alias("m")).collect():
        assert r["s"] == [sum(r["v"][: k + 1]) for k in range(len(r["v"]))] and r["m"] == [max(r["v"][: k + 1]) for k in range(len(r["v"]))]


def test_spans_and_redaction_agree(spark):
    """Added spans overlap no base span and are matches of their form; redaction replaces the union of all."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(150)] + ["".join(rng.choice(PARTS) for _ in range(200)) for _ in range(10)] + [None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: [(s["start"], s["end"], s["kind"], s["base"]) for s in r["v_spans"]] for r in personal_data.found(d).collect()}
    shown = {r["doc_id"]: r["text"] for r in personal_data.redacted(d).collect()}
    added = 0
    for k, text in enumerate(texts):
        base = [s for s in spans[k] if s[3]]
        for a, b, kind, is_base in spans[k]:
            if not is_base:
                added += 1
                assert all(b <= x or y <= a for x, y, *_ in base)
                assert re.fullmatch(personal_data.WIDER[kind].replace("++", "+").replace("}+", "}"), text[a:b])
        out, at = "", 0
        for a, b, kind, _ in sorted(spans[k], key=lambda s: (s[0], -s[1])):
            if a >= at:
                out += text[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        assert shown[k] == (None if text is None else out + text[at:])
    assert added > 50


def test_very_long_text(spark):
    """One megabyte with 50,000 spans."""
    line = "10.0.0.1, a@b.com or 555-010-4477 "
    text = line * 17_000
    d = spark.createDataFrame([(1, text), (2, "mail x@y.org now"), (3, "a" * 1_000_000)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r["doc_id"]: r["n"] for r in personal_data.found(d).select("doc_id", F.size("v_spans").alias("n")).collect()}
    assert got[1] >= 34_000 and got[2] == 1 and got[3] == 0
    shown = {r["doc_id"]: r["text"] for r in personal_data.redacted(d).collect()}
    assert shown[1].startswith("[IP], [EMAIL] or ") and shown[1].count("[IP]") == 17_000 and shown[3] == "a" * 1_000_000
    assert time.perf_counter() - began < 90
