"""The class-conditional Kneser-Ney models against plain arithmetic, and at several class ratios."""

import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentlens.llm import toxicity


def counts_of(texts):
    """By class: texts that have a bigram."""
    out = [Counter(), Counter()]
    for y, t in texts:
        ws = t.split()
        out[y].update(set(zip(["", *ws], ws, strict=False)))
    return out


def rows_of(spark, texts):
    d = spark.createDataFrame([(y, t) for y, t in texts], "label int, text string")
    return sorted((r["label"], r["u"], r["w"], r["n"]) for r in toxicity.counted(d).collect())


def test_counts(spark):
    texts = [(0, "a b a b c"), (0, "a b"), (1, "b a"), (1, ""), (1, "c c c c")]
    want = sorted((y, u, w, n) for y, c in enumerate(counts_of(texts)) for (u, w), n in c.items())
    assert rows_of(spark, texts) == want


@pytest.mark.parametrize("limits", [(1, 1), (2, 1), (1, 2), (3, 2)])
def test_formula(limits):
    """Evidence equals interpolated Kneser-Ney computed word by word with dictionaries."""
    rng = random.Random(3)
    texts = [(int(k % 3 == 0), " ".join(rng.choice("abcdefgh" if k % 3 else "abcdxyz") for _ in range(rng.randint(1, 9)))) for k in range(60)]
    grams = counts_of(texts)
    kinds = [Counter(w for _, w in c) for c in grams]
    context = [Counter(), Counter()]
    for k in (0, 1):
        for (u, _), n in grams[k].items():
            context[k][u] += n
    words = sorted({w for c in kinds for w in c})
    pairs = sorted({p for c in grams for p in c if p[0]})
    number = {w: k for k, w in enumerate(words, 1)}
    discount = np.array([[0.4, 0.6], [0.3, 0.7]])
    two = lambda f: np.array([[f(0, x), f(1, x)] for x in words], float)
    totals, sums = [sum(c.values()) for c in kinds], [sum(c.values()) for c in grams]
    model = toxicity.Model(
        words, two(lambda k, w: kinds[k][w]), np.array(totals, float), two(lambda k, w: context[k][w]), np.array([[number[u], number[w]] for u, w in pairs]),
        np.array([[grams[0][p], grams[1][p]] for p in pairs], float), np.array(sums, float), discount,
    )
    model.cut(*limits)
    least, times = limits

    def apart(a, b, of_a, of_b):
        return a / max(of_a, 1) >= times * (b + 1) / (of_b + 1) or b / max(of_b, 1) >= times * (a + 1) / (of_a + 1)

    shared = {w: (kinds[0][w] / totals[0] + kinds[1][w] / totals[1]) / 2 + 1 / sum(totals) for w in [*words, None]}
    whole = sum(shared.values())
    level = lambda a, b, of: (a / of[0] + b / of[1]) / 2 >= least / 2 / min(of)
    single = [w for w in words if level(kinds[0][w], kinds[1][w], totals) and apart(kinds[0][w], kinds[1][w], *totals)]
    double = defaultdict(list)
    for u, w in pairs:
        if level(grams[0][u, w], grams[1][u, w], sums) and apart(grams[0][u, w], grams[1][u, w], context[0][u], context[1][u]):
            double[u].append(w)

    def p(k, u, w):
        own = lambda x: max(kinds[k][x] - discount[0, k], 0) / totals[k] if x in single else 0
        low = own(w) + (1 - sum(map(own, single))) * shared.get(w, shared[None]) / whole
        arc = lambda x: max(grams[k][u, x] - discount[1, k], 0) / max(context[k][u], 1) if x in double[u] else 0
        return arc(w) + (1 - sum(map(arc, double[u]))) * low

    for k in (0, 1):
        for u in ["", "a", "x", "new"]:
            assert sum(p(k, u, w) for w in [*words, None]) == pytest.approx(1)
    for text in ["a b x", "x", "new a new", "y z a a a", ""]:
        ws = text.split()
        want = sum(math.log(p(1, u, w)) - math.log(p(0, u, w)) for u, w in zip(["", *ws], ws, strict=False)) / max(1, len(ws))
        assert model.evidence([text.encode()])[0] == pytest.approx(want)


@pytest.mark.parametrize(("ratio", "most"), [(1, 4000), (1, 150), (4, 4000), (20, 4000), (20, 150)])
def test_class_ratios(spark, ratio, most):
    """Toxic texts are found, and clean ones left alone, at any class sizes, with more labels than are learnt from or fewer."""
    r = random.Random(ratio)
    plain = [f"w{k}" for k in range(400)]
    n = 200 * (1 + ratio)

    def text(y):
        ws = r.choices(plain, k=r.randint(20, 120))
        if y:
            for at in r.sample(range(len(ws)), max(2, len(ws) // 25)):
                ws[at] = r.choice(["rotten", "vermin", "filth"])
        return " ".join(ws)

    rows = [(k, text(k % (1 + ratio) == 0)) for k in range(n + 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(k, int(k % (1 + ratio) == 0)) for k in range(n)], "doc_id long, toxic int")
    got = {x["doc_id"]: x["t_score"] for x in toxicity.scored(docs, known, F.lit(True), per_class=most).where(F.col("doc_id") >= n).collect()}
    bad = [k for k in got if k % (1 + ratio) == 0]
    assert sum(got[k] >= 0.5 for k in bad) >= 0.9 * len(bad)
    assert sum(got[k] >= 0.5 for k in got if k % (1 + ratio)) <= 0.01 * len(got)


def test_long_texts_take_linear_time(spark):
    words = [f"w{k}" for k in range(60_000)]
    d = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(words[::-1]))], "label int, text string")
    began = time.perf_counter()
    assert toxicity.counted(d).count() == 120_000
    assert time.perf_counter() - began < 30
