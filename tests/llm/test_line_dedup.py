"""Line dedup against a plain version, its bitmaps and hot lines."""

import hashlib
import random

from momentlens.llm import line_dedup as ld

SCHEMA = "doc_id long, text string"
BLANK = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    """Sorted (id, lines, dropped, digest), repr for nulls."""
    holders = {}
    key = lambda line: line.strip(BLANK).translate(LOWER)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    top = {k: max(v, key=lambda i: (i is not None, i or 0)) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in top or top[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(map(repr, out))


def as_query(spark, rows, parts=5):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    path = f"/tmp/momentlens-lines-{random.getrandbits(60)}"
    docs.write.parquet(f"{path}/documents.parquet")
    return sorted(repr(tuple(r)) for r in ld.query(spark, path).collect())


def test_random_documents(spark):
    rng = random.Random(4)
    stock = [f"Shared LINE number {k} of the licence text É" for k in range(12)] + ["short one", "", "   ", "exactly twenty chars", "only nineteen chars"]
    rows = []
    for i in range(150):
        lines = [rng.choice(stock) if rng.random() < 0.6 else f"own line {rng.getrandbits(40)} of document" for _ in range(rng.randint(0, 200))]
        lines = [rng.choice(("", " ", "\t", "\r")) + (x.upper() if rng.random() < 0.2 and x.isascii() else x) + rng.choice(("", "\x0b ", "\r")) for x in lines]
        rows.append((i, "\n".join(lines)))
    assert as_query(spark, rows) == plain(rows)


def test_edges(spark):
    line = "a line that three documents have"
    long = "\n".join([line, "x" * 30] * 20_000)
    rows = [(None, line), (None, None), (1, None), (2, ""), (3, "\n"), (4, line), (5, f"{line}\n{line.upper()}\n"), (5, f"{line}\n{line.upper()}\n"), (5, f"other\n{line}"), (6, long), (7, line + "\n" + "é" * 20), (8, "É" * 20 + "\n\n"), (9, "É" * 20), (10, "é" * 20), (11, "É" * 20 + " ")]
    assert as_query(spark, rows) == plain(rows)
    assert as_query(spark, []) == []


def test_repeated_ids_are_one_document(spark):
    rows = [(1, "this line is in one document only")] * 3 + [(2, "this line is in one document only")]
    assert all(", 0, " in r for r in as_query(spark, rows))


def test_a_line_in_every_document(spark):
    """One key over many ranges."""
    rows = [(i, f"the common line of all documents\nbody {i} of the document, long enough\nthe common line of all documents") for i in range(3000)]
    assert as_query(spark, rows, 16) == plain(rows)
    d = ld.dropped_lines(ld.hashed_lines(spark.createDataFrame(rows, SCHEMA).repartition(16)))
    assert d.count() == 2 * 2999


def test_bitmaps(spark):
    line = "a line that three documents have"
    lines = ["own line"] * 200
    lines[0] = lines[63] = lines[130] = line
    rows = [(1, "\n".join(lines)), (2, line), (3, line)]
    got = {r["l_doc"]: r for r in ld.keep_bitmaps(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {1, 2}
    words = {x["at"]: x["bits"] for x in got[1]["l_keep"]}
    assert words == {0: ~(-(2**63) | 1), 2: ~(1 << 2)}  # the word in between keeps all
    assert got[1]["l_dropped"] == 3


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "a line that three documents have\nx", 7, "y") for i in range(4)], "doc_id long, text string, l_pos int, l_keep string")
    got = ld.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["l_pos"], r["l_keep"]) for r in got.collect()) == [(i, "x" if i < 3 else "a line that three documents have\nx", 7, "y") for i in range(4)]


def test_native(spark, sf):
    plan = ld.query(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
