"""The pipeline's stages against plain Python on the smallest tables."""

import math
import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from momentlens.llm import packing, quality_rules
from momentlens.llm.common import written


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def good(text):
    ws = words(text)
    n = len(ws)
    if n < 10:
        return False
    grams = Counter(tuple(ws[i : i + 5]) for i in range(n - 4))
    repeated = {i + j for i in range(n - 4) if grams[tuple(ws[i : i + 5])] > 1 for j in range(5)}
    if 100 * len(repeated) > 20 * n:
        return False
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    chars, lines = sum(map(len, ws)), [x for x in text.split("\n") if words(x)]
    stops = {v for s in quality_rules.STOP_WORDS.values() for w in s.split() for v in (w, w.capitalize())}
    return (
        1.5 <= chars / n <= 20
        and symbols / n <= 0.25
        and (symbols - sum(w in stops for w in ws)) / n <= 0.10
        and (len(lines) - len(set(lines))) / max(1, len(lines)) <= 0.5
        and len(re.findall("[A-Z]", text)) / chars <= 0.5
    )


def shingles(text):
    ws = re.sub("[A-Z]", lambda m: m[0].lower(), text).encode().split()
    return {b" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}


def without(text, items):
    found = [m for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), m[0]) for m in found]
    hit = set()
    for item in items:
        iw = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), item))
        k = min(10, len(iw))
        windows = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if k else set()
        hit |= {i + j for i in range(len(low) - k + 1) if tuple(low[i : i + k]) in windows for j in range(k)}
    if not hit:
        return text
    if len(hit) == len(low):
        return None
    out, at = "", 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out += text[at : found[i].start()]
        at = found[i].end()
    return out + text[at:]


def redacted(text):
    def luhn(d):
        return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    spans = [(m.start(), -m.end(), "EMAIL") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(m.start(), -m.end(), "IP") for m in re.finditer(r"[0-9]+(\.[0-9]+){3}", text) if all(int(x) <= 255 for x in m[0].split("."))]
    spans += [(m.start(), -m.end(), "CARD") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    spans += [(m.start(), -m.end(), "PHONE") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    out, at = "", 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += text[at:a] + f"[{kind}]"
        at = max(at, -b)
    return out + text[at:]


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = written(stage(spark, docs, sf), name)
    return {k: [r.asDict() for r in v.collect()] for k, v in out.items()}


def texts(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_rules(stages):
    assert texts(stages["quality_rules"]) == {k: t for k, t in texts(stages["documents"]).items() if good(t)}


def test_one_of_each_group_stays(stages):
    before, after = texts(stages["quality_rules"]), texts(stages["near_dedup"])
    sets = {k: shingles(t) for k, t in before.items()}
    by_shingle: dict = {}
    for k, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(k)
    shared = Counter((a, b) for ks in by_shingle.values() for a in ks for b in ks if a < b)
    alike = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in shared.items()}

    def smallest(least):
        """The smallest id of each component of pairs at or above a similarity."""
        group = {k: k for k in sets}

        def root(k):
            while group[k] != k:
                k = group[k]
            return k

        for (a, b), j in alike.items():
            if j >= least:
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
        return {root(k) for k in sets}

    # all that is alike at 0.8 goes and nothing else
    assert set(after) == smallest(0.8)
    assert len(after) < len(before)


def test_passages_go(stages, spark, sf):
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {k: without(t, items) for k, t in texts(stages["near_dedup"]).items()}
    assert texts(stages["decontamination"]) == {k: t for k, t in want.items() if t is not None}


def test_personal_data_goes(stages):
    assert texts(stages["personal_data"]) == {k: redacted(t) for k, t in texts(stages["decontamination"]).items()}
    assert all(r["n_chars"] == len(r["text"]) for r in stages["personal_data"])


def test_all_tokens_are_packed(stages):
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    sizes = Counter()
    for r in stages["packing"]:
        sizes[r["doc_id"]] += r["length"]
    assert sizes == {k: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for k, t in texts(stages["personal_data"]).items()}
