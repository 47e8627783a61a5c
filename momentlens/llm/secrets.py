"""Secret scans: known forms, and values in a credential context that are hard to guess.

Base spans are assignments to a credential name, access keys and long hexadecimal runs. Beside them, any
value that a wider credential word introduces is segmented at minimum guessing cost into dictionary words (a rank is a
guess number; a capital at the start or capitals throughout cost a bit, others and look-alike signs a bit each), dates, times of day, host names, repeats, sequences, keyboard walks and brute-force spans. A value whose
cheapest segmentation needs at least 2 to the power ``BITS`` guesses is a secret as well (kind ``value``); nothing else
decides. A run of letters in one case may also be a word of a dictionary of 2 to the power ``PROSE``, where each
pair of letters that no word of the dictionary's first thousand has costs ``RARE`` bits more: so prose after a credential word is cheap
and random letters aren't; from ``LONG`` letters on each costs ``EACH`` bits. A capital between small letters parts words (``HUMP``). A sign of ``JOINTS`` between letters or digits is cheap, and so is a word, a short form or a little word right behind it, as words of identifiers and sentences go together,
and those of paths and addresses more so. So passphrases need about four or five words. Host names (lower case, known endings) are public and cost ``HOST``, endings of files ``ENDING``, braces of placeholders what ``BRACES`` says. Words have at most ``LONGEST`` letters.
A repeat is a block of any size, itself no repeat, that comes twice or more in turn; it costs its block's own cheapest segmentation and the number of times. Repeats, sequences and walks end at any of their first ``LONGEST`` places or where
they can't go on. Nothing goes on from a place that costs ``BITS``, and the work ends as soon as every segmentation does, so that long values end early.

The dictionary is a parameter: ``dictionary`` ranks the letter pieces of a public tokenizer's vocabulary, which
is in the order of frequency. At most ``MOST_WORDS`` are sent to the tasks.

Defined cases: a null or empty text has no spans; a value that overlaps a base span isn't added again;
a value that begins with a credential word of its own gives way to that word's value; values of any length are segmented whole;
texts of any length are read whole, in time that grows with n log n of their spans; repeated rows are scanned each; an empty table
gives an empty result; further columns of ``docs`` stay, one named ``x_spans`` is replaced.
"""

from __future__ import annotations

import json
import math
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from momentlens.llm.common import documents, in_arrow, text_chunks

BITS = 40.0
LONGEST = 32
MOST_WORDS = 50_000
VOCABULARY = "word_bpe_49k.json"
PROSE, RARE = 16.0, 6.0
#: From how many letters on such a word costs more, and how much each.
LONG, EACH = 12, 2.0
#: Signs between words: their bits, and the most that a word right behind them costs.
JOINTS = {c: (2.0, 7.0) for c in "-_."} | {c: (1.0, 4.0) for c in "/:?=&"}
#: The most that a word costs which a capital parts from the one before it, and how much more one that isn't in the dictionary.
HUMP, UNKNOWN = 7.0, 2.0
BRACES = {"${": 3.0, "{{": 3.0, "}": 1.0, "}}": 1.0}
HOST, ENDING = 12.0, 5.0
#: Periods of repeats that are tried one by one; longer ones are looked for by the first ``SEED`` characters.
SEED = 16
KINDS = ("assign", "access", "hex", "value")
_ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: A wider context: other credential words, other separators, and values with signs.
_CONTEXT = re.compile(r"(?ai:\b(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|bearer|credentials?))\b[\"']?(?:\x20*(?::=|=>|[:=])\x20*|\x20+is\x20+|\x20+)[\"']?(?=[^\s\"'<>(),;|]{8})")
_VALUE = re.compile(r"[^\s\"'<>(),;|]+")
_HINT = re.compile(rb"(?i)pass|pwd|secret|token|key|auth|bearer|credential")

#: Frequent passwords and words, the commonest first; a rank is a guess number.
WORDS = (
    "password the admin welcome login letmein qwerty monkey dragon master hello secret token love user test guest root pass default "
    "changeme summer winter spring autumn monday friday sunshine princess football baseball shadow michael jordan superman batman "
    "flower cookie computer internet service server database access public private example sample demo temp key value name and for "
    "you that with this from have not are was but all can your more will home page about out time there may some any new what which "
    "their site date web info data file line text code system number house company january february march april june july august "
    "september october november december"
).split()
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (r, k) for r, row in enumerate(_ROWS) for k, c in enumerate(row)}
#: Signs that stand for letters.
_LOOKS = str.maketrans("013457@$", "oieastas")
_DATE = re.compile(r"(?:(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d|(?:19|20)\d\d)")

_TIME = re.compile(r"T?(?:[01]\d|2[0-3]):[0-5]\d(:[0-5]\d)?Z?")
#: What stands for a word in paths and names.
_SHORT = re.compile(r"(?:[a-z]{1,3}|v\d)(?![A-Za-z0-9])")
#: Words that sentences join others with; 16 of them are a choice of four bits.
_LITTLE = re.compile(r"(?:a|an|and|as|at|by|for|from|in|is|of|on|or|the|to|with)(?![A-Za-z0-9])")
#: Endings of files, of which there are about two to the power ``ENDING``.
_ENDING = re.compile(r"\.(?:conf|css|csv|html|ini|java|js|json|log|md|php|py|sh|sql|toml|ts|txt|xml|yaml|yml)(?![A-Za-z0-9])")
_HOST = re.compile(r"(?:https?://)?(?:[a-z][a-z-]{0,30}\.){1,4}(?:com|org|net|io|dev|edu|gov|info)(?![a-z0-9])")


def _alphabet(c: str) -> float:
    return math.log2(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100)


def _near(a: str, b: str) -> bool:
    p, q = _PLACE.get(a.lower()), _PLACE.get(b.lower())
    return bool(p and q) and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def _alike(value: str, i: int, j: int) -> int:
    """How many characters from ``i`` on are those from ``j`` on, i < j."""
    n, step = len(value) - j, 16
    k = 0
    while k < n and value[i + k : i + k + step] == value[j + k : j + k + step]:
        k, step = k + step, step * 2
    if k >= n:
        return n
    while step > 1:  # they part within ``step`` places from ``k``
        step //= 2
        if value[i + k : i + k + step] == value[j + k : j + k + step]:
            k += step
    return min(k, n)


def repeats(value: str, i: int) -> Iterator[tuple[int, int]]:
    """(size, times) of the blocks, no repeats themselves, that stand at ``i`` twice or more in turn."""
    n, size, seed = len(value) - i, 1, value[i : i + SEED + 1]
    while 2 * size <= n:
        if size > SEED:
            at = value.find(seed, i + size, i + n // 2 + len(seed))
            if at < 0:
                return
            size = at - i
        if value.startswith(value[i : i + size], i + size):
            whole = size + _alike(value, i, i + size)
            yield size, whole // size
            size = max(size + 1, whole - size + 1)  # what repeats within this stretch has this block's period
        else:
            size += 1


def _spelt(x: str, word: str) -> float:
    """Bits for the capitals and look-alike signs by which ``x`` is not ``word``."""
    capitals = sum(c.isupper() for c in x)
    if capitals and (x == x.upper() or (capitals == 1 and x[0].isupper())):
        capitals = 1
    return capitals + sum(a.lower() != b for a, b in zip(x, word, strict=True))


class Guesser:
    """Guess numbers by a dictionary, the commonest word first."""

    def __init__(self, words: list[str]):
        self.bits = {}
        for k, w in enumerate(words[:MOST_WORDS], 1):
            self.bits.setdefault(w, math.log2(k) + 1)
        self.longest = min(LONGEST, max(map(len, words), default=0))
        self.pairs = {w[k : k + 2] for w in words[:1000] for k in range(len(w) - 1)}
        self.short = lru_cache(maxsize=65536)(self._cheapest)

    def cheapest(self, value: str, enough: float = math.inf) -> float:
        """log2 of the guesses that the cheapest segmentation of ``value`` needs; any number from ``enough`` on if it needs so many."""
        return (self.short if len(value) <= 128 else self._cheapest)(value, enough)

    def _cheapest(self, value: str, enough: float) -> float:
        n, low = len(value), "".join(c.lower() if c.isascii() else c for c in value)
        plain = low.translate(_LOOKS)
        alphabet = [_alphabet(c) for c in value]
        walks, steps = array("i", bytes(4 * n)), array("i", bytes(4 * n))  # how far a keyboard walk and a sequence go on from each place
        for i in range(n - 2, -1, -1):
            walks[i] = walks[i + 1] + 1 if _near(value[i], value[i + 1]) else 0
            step = ord(value[i + 1]) - ord(value[i])
            steps[i] = (steps[i + 1] + 1 if i + 2 < n and ord(value[i + 2]) - ord(value[i + 1]) == step else 1) if step in (1, -1) else 0
        best, far = [0.0] + [math.inf] * n, {}

        def reach(j: int, cost: float) -> None:
            if cost < best[j]:
                best[j] = cost
                if j > i + LONGEST:
                    far[j] = cost

        for i in range(n):
            here = best[i]
            # every segmentation goes on from one of the places reached
            if here >= enough and min(best[i : i + LONGEST + 1]) >= enough:
                far = {j: c for j, c in far.items() if j > i}
                if min(far.values(), default=math.inf) >= enough:
                    return enough
            if here >= enough:
                continue
            joint = value[i] in JOINTS and (i == 0 or value[i - 1].isalnum()) and i + 1 < n and value[i + 1].isalnum()
            reach(i + 1, here + (JOINTS[value[i]][0] if joint else alphabet[i]))
            joined = i > 0 and value[i - 1] in JOINTS and (i == 1 or value[i - 2].isalnum())
            most = JOINTS[value[i - 1]][1] if joined else HUMP if 0 < i < n - 1 and value[i - 1].islower() and value[i].isupper() and value[i + 1].islower() else math.inf
            if joined and (little := _LITTLE.match(value, i)):
                reach(little.end(), here + 4)
            if joined and (short := _SHORT.match(value, i)):
                reach(short.end(), here + most)
            if ending := _ENDING.match(value, i):
                reach(ending.end(), here + ENDING)
            for sign in BRACES:
                if value.startswith(sign, i):
                    reach(i + len(sign), here + BRACES[sign])
            for j in range(i + 3, min(n, i + self.longest) + 1):
                if (bits := self.bits.get(plain[i:j])) is not None:
                    reach(j, here + min(bits, most) + _spelt(value[i:j], plain[i:j]))
            if (i == 0 or not value[i - 1].isalnum()) and (host := _HOST.match(value, i)):
                reach(host.end(), here + HOST)
            if value[i].isdigit():
                for j in range(i + 4, min(n, i + 10) + 1):
                    if _DATE.fullmatch(value, i, j):
                        reach(j, here + math.log2(365 * 120 if j - i > 4 else 120) + 1)
            if clock := _TIME.match(value, i):
                reach(clock.end(), here + math.log2(86400 if clock[1] else 1440) + 1)
            cost = min(PROSE, most + UNKNOWN)
            for j in range(i + 1, min(n, i + LONGEST) + 1):
                c = value[j - 1]
                if not c.isalpha() or (j > i + 2 and c.isupper() != value[i + 1].isupper()) or (j == i + 2 and c.isupper() and not value[i].isupper()):
                    break
                if j > i + 1 and c.isascii() and value[j - 2].isascii() and low[j - 2 : j] not in self.pairs:
                    cost += RARE
                if j > i + LONG:
                    cost += EACH
                reach(j, here + cost)
            for run, first, each in ((walks[i] + 1, math.log2(47), 1), (steps[i] + 1, alphabet[i] + 1, 0)):
                for k in [*range(3, min(run, LONGEST) + 1), run]:
                    if k > 2:
                        reach(i + k, here + first + math.log2(k) + each * k)
            for size, times in repeats(value, i):
                block = self.cheapest(value[i : i + size], enough) if size > 1 else alphabet[i]
                for k in [*range(2, min(times, LONGEST // size) + 1), times]:
                    if k * size > 2:
                        reach(i + k * size, here + block + math.log2(k) + (size > 1))
        return best[n]


_OWN = Guesser(WORDS)


def guess_bits(value: str) -> float:
    """By the words of this module alone."""
    return _OWN.cheapest(value)


def dictionary(path: str) -> list[str]:
    """The words of this module, and behind them the letter pieces of a vocabulary file, in the order of their numbers."""
    vocabulary = json.loads(Path(path).read_text())["model"]["vocab"]
    pieces = (w.removesuffix("</w>").lower() for w, _ in sorted(vocabulary.items(), key=lambda x: x[1]))
    return list(dict.fromkeys([*WORDS, *(w for w in pieces if len(w) > 2 and w.isascii() and w.isalpha())]))[:MOST_WORDS]


def spans(text: str, bits: float = BITS, guesser: Guesser = _OWN) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, in order; kind is a place in ``KINDS``."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    starts, ends = [], []  # of the union of base spans
    for a, _, b in sorted(found):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    done = 0
    for m in _CONTEXT.finditer(text):
        a = m.end()
        if m.start() < done or _CONTEXT.match(text, a):  # inside a value that was judged; or the value is a credential word itself
            continue
        done = _VALUE.match(text, a).end()
        b = done
        while b > a and text[b - 1] in ".:!?":
            b -= 1
        free = bisect_right(ends, a)
        if b - a >= 8 and (free == len(starts) or starts[free] >= b) and guesser.cheapest(text[a:b], bits) >= bits:
            found.append((a, 3, b))
    return sorted(found)


@lru_cache(maxsize=1)
def _guesser(words: tuple[str, ...]) -> Guesser:
    """One for each worker process."""
    return Guesser(list(words))


def scanned(docs: DataFrame, text_col: str = "text", bits: float = BITS, words: list[str] = WORDS) -> DataFrame:
    """``docs`` with ``x_spans``: kind, start and end (exclusive) in code points."""
    docs = docs.drop("x_spans")
    names = docs.columns
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    other = re.compile(rb"AKIA|[0-9a-f]{32}")
    shared = docs.sparkSession.sparkContext.broadcast(tuple(words[:MOST_WORDS]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesser = _guesser(shared.value)
        for batch, texts in text_chunks(batches, text_col):
            out = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(t.decode(errors="surrogateescape"), bits, guesser)] if _HINT.search(t) or other.search(t) else [] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=[*names, "x_spans"])

    return in_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField("x_spans", span)]))


def _joined(found: F.Column) -> F.Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the secrets of every document, counted and digested."""
    import public_tokenizers

    d = scanned(documents(spark, sf_dir).select("doc_id", "text"), words=dictionary(public_tokenizers.path(VOCABULARY)))
    n = lambda kind: F.size(F.filter("x_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("x_spans", lambda s: s["kind"] != "value")
    return d.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("x_spans")).alias("spans"))
