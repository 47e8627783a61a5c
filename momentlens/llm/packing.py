"""Best-fit packing of token pieces into sequences, after Martello-Toth dominance reduction.

Texts are tokenised whole; pieces longer than a sequence are cut. A packing depends on lengths alone, so
the plan is made from the histogram of lengths, which has at most ``capacity`` rows whatever the corpus:
from the largest down, each length is taken with a set that provably dominates all others holding it (alone when
nothing fits beside it, with the largest length that fits when that fills the sequence or no two pieces
fit, or when the best two fit no better than that one), as often as the histogram allows; what no set
dominates is packed best-fit decreasing, a whole run of equal bins at a time. Each piece then
finds its place by its number among the pieces of its length, which comes from counts for each task and a
window over those counts, never from one ordered group of pieces.

Defined cases: a null or empty text is one piece that holds only the end token; repeated rows are packed
each; very long texts are tokenised whole and cut; ties go to the fuller bin made first; an empty table gives an empty result; a null id is kept;
further input columns are not carried.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from momentlens.llm.common import documents, in_arrow, text_chunks, written

CAPACITY = 4096
END = 1
VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a task remembers before it starts anew.
REMEMBERED = 100_000
_BATCH = 20_000


def _byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(plain))}


class Encoder:
    """Ids of whole texts. The tokenizer drops white space and never joins across it, so words are encoded once and remembered.

    Nearly all words are letters of ASCII or Latin-1 with signs behind: the tokenizer lower-cases the letters,
    which have no other normal form, and splits off ASCII signs, so lower-case letters can go straight to its
    merges. A tokenizer for which this isn't so, by a few probes, gets all words whole, as do other words.
    A word's ids don't depend on the words seen before it: letters, signs and whole words are remembered apart.
    """

    _LATIN = re.compile("[a-z\u00DF-\u00F6\u00F8-\u00FF]+")
    _SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    _PROBES = ("word", "Thandion,", "\u00c9l\u00e8ve!!", "Stra\u00dfe.", "na\u00efve###", "I", "THE", "ll", "(s)", "e.g.", "\u00f1o|")

    def __init__(self, tokenizer: str):
        """``tokenizer``: as JSON."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.known: dict[bytes, bytes] = {}
        self.letters: dict[bytes, bytes] = {}
        self.signs: dict[bytes, bytes] = {}
        self.characters = _byte_characters()
        self.plain = True
        probes = [w.encode() for w in self._PROBES]
        self.learn({self.lowered(w) for w in probes})
        whole = self.tokenizer.encode_batch(list(self._PROBES), add_special_tokens=False)
        if any(self.known[self.lowered(w)] != np.array(e.ids, "<u4").tobytes() for w, e in zip(probes, whole, strict=True)):
            self.plain, self.known = False, {}

    def lowered(self, text: bytes) -> bytes:
        """ASCII letters lower-cased, but not where that could make up the name of a special token."""
        return text.lower() if self.plain and b"<" not in text else text

    def _of_letters(self, word: bytes) -> bytes | None:
        """Ids of a word of lower-case letters only; None for others."""
        ids = self.letters.get(word)
        if ids is None:
            if word.isalpha() and word.islower():  # ASCII letters, as these are bytes
                shown = word.decode()
            elif not word.isascii() and self._LATIN.fullmatch(word.decode(errors="replace")):
                shown = word.decode("latin-1").translate(self.characters)
            else:
                return None
            ids = self.letters[word] = array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()
        return ids

    def _of_signs(self, signs: bytes) -> bytes:
        ids = self.signs.get(signs)
        if ids is None:
            ids = self.signs[signs] = np.array(self.tokenizer.encode(signs.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return ids

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.letters, self.signs, new = {}, {}, {}, list(words)
        known, of_letters, other = self.known, self._of_letters, []
        for w in new:
            bare = w.rstrip(self._SIGNS)
            ids = of_letters(bare) if self.plain and bare else None
            if ids is None:
                other.append((w, w.decode(errors="replace")))
            else:
                known[w] = ids + self._of_signs(w[len(bare) :]) if len(bare) < len(w) else ids
        for at in range(0, len(other), _BATCH):
            part = other[at : at + _BATCH]
            for (w, _), e in zip(part, self.tokenizer.encode_batch_fast([t for _, t in part], add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Each text's ids as little-endian 32-bit numbers."""
        split = [self.lowered(t).split() for t in texts]
        self.learn(set().union(*split))
        for words in split:
            yield b"".join(map(self.known.__getitem__, words))


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, and its number ``p_rank`` among those of its length in task ``p_task``.

    ``vocabulary``: the path of a tokenizer file, which the driver reads and sends to the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())
    last = np.array([end], "<u4").tobytes()
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = Encoder(shared.value), TaskContext.get().partitionId(), Counter()
        for batch, texts in text_chunks(batches, text_col):
            row, out = [], []
            for i, ids in enumerate(encoder.encode(texts)):
                ids += last
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    row.append(i)
                    out.append((piece, at // 4, n, zlib.crc32(part), task, seen[n]))
                    seen[n] += 1
            columns = np.array(out, np.int64).T
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(row)), pa.array(columns[0], pa.int32()), *map(pa.array, columns[1:])], names=[id_col, "piece", "start", "length", "ids_crc32", "p_task", "p_rank"])

    return in_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long, p_task long, p_rank long")


def dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sets of lengths that an optimal packing has, each with how often, and the lengths that are left."""
    left, fixed = {k: v for k, v in counts.items() if v}, []
    lengths = sorted(left)

    def largest(room: int, without: Counter) -> int:
        """The largest length up to ``room`` of which more is left than ``without`` holds; 0 if none."""
        at = np.searchsorted(lengths, room, side="right")
        while at:
            at -= 1
            if left[lengths[at]] > without[lengths[at]]:
                return lengths[at]
        return 0

    for top in lengths[::-1]:
        while left.get(top):
            room, held = capacity - top, Counter([top])
            partner = largest(room, held)
            if not partner:
                chosen = (top,)
            else:
                smallest = []
                for k in lengths:
                    smallest += [k] * min(left[k] - held[k], 3 - len(smallest))
                    if len(smallest) == 3:
                        break
                alone = partner == room or len(smallest) < 2 or smallest[0] + smallest[1] > room
                if not alone and ((len(smallest) == 3 and sum(smallest) <= room) or _best_pair(lengths, left, held, room) > partner):
                    break
                chosen = (top, partner)
            # what is taken away leaves no better set, so the choice holds while its lengths last
            use = Counter(chosen)
            times = min(left[k] // n for k, n in use.items())
            fixed.append((chosen, times))
            for k, n in use.items():
                left[k] -= n * times
                if not left[k]:
                    del left[k]
                    lengths.remove(k)
    return fixed, left


def _best_pair(lengths: list[int], left: dict[int, int], held: Counter, room: int) -> int:
    """The largest sum up to ``room`` of two pieces that are left."""
    best, i, j = 0, 0, len(lengths) - 1
    while i <= j:
        a, b = lengths[i], lengths[j]
        if held[a] and left[a] <= held[a]:
            i += 1
        elif (held[b] and left[b] <= held[b]) or a + b > room:
            j -= 1
        elif i == j and left[a] - held[a] < 2:
            break
        else:
            best, i = max(best, a + b), i + 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing; bins of equal content are one entry with how often."""
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}  # room -> runs of equal bins
    rooms: list[int] = []
    out = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        heap = [r for r in rooms if r >= length]
        heap.sort()
        waiting = list(heap)
        while left:
            room = None
            while waiting:
                if waiting[0] >= length and open_.get(waiting[0]):
                    room = waiting[0]
                    break
                heappop(waiting)
            if room is None:
                fit = capacity // length
                full, rest = divmod(left, fit)
                for n, times in ((fit, full), (rest, min(rest, 1))):
                    if times:
                        content, r = ((length, n),), capacity - n * length
                        open_.setdefault(r, []).append((content, times))
                        if r not in rooms:
                            rooms.append(r)
                left = 0
                break
            content, times = open_[room].pop()
            fit = room // length
            # a bin that takes one piece is then the best for the next, as long as it fits
            full = min(times, left // fit)
            rest = left - full * fit if full < times else 0
            part = [(fit, full)] + ([(rest, 1)] if rest else [])
            used = sum(t for _, t in part)
            if used < times:
                open_[room].append((content, times - used))
            for n, t in part:
                if t:
                    r = room - n * length
                    open_.setdefault(r, []).append(((*content, (length, n)), t))
                    if r not in rooms:
                        rooms.append(r)
                        if r >= length:
                            heappush(waiting, r)
                    left -= n * t
        rooms = [r for r in rooms if open_.get(r)]
    for runs in open_.values():
        out += [(tuple(k for k, n in content for _ in range(n)), times) for content, times in runs]
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, copies in a bin, first sequence, bins, offset) that give each piece its place."""
    fixed, left = dominated(counts, capacity)
    rows, seen, sequence = [], Counter(), 0
    for content, times in [*fixed, *best_fit(left, capacity)]:
        offset = 0
        for length, n in Counter(content).items():
            rows.append((length, seen[length], n, sequence, times, offset))
            seen[length] += n * times
            offset += n * length
        sequence += times
    if seen != Counter({k: v for k, v in counts.items() if v}):
        raise AssertionError("the plan must place every piece once")
    return rows


def packed(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Every piece with ``sequence_id`` and ``offset``."""
    cut = written(pieces(docs, vocabulary, id_col, text_col, capacity, end), "pieces")
    counts = cut.groupBy("p_task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("p_task").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("p_task", "length", F.coalesce(before, F.lit(0)).alias("p_before"))
    rows = plan({r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}, capacity)
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    # each length adds at most three runs of bins, and a bin has under sqrt(2 * capacity) distinct lengths: about 50 MB at the very most
    shared = docs.sparkSession.sparkContext.broadcast(table)
    names = [f.name for f in cut.schema if not f.name.startswith("p_")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            low, high = np.searchsorted(t[:, 0], length), np.searchsorted(t[:, 0], length, side="right")
            while (low + 1 < high).any():
                middle = (low + high) // 2
                right = t[np.minimum(middle, len(t) - 1), 1] <= rank
                step = low + 1 < high
                low, high = np.where(step & right, middle, low), np.where(step & ~right, middle, high)
            r = t[low]
            in_run = rank - r[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(r[:, 3] + in_run // r[:, 2]), pa.array(r[:, 5] + in_run % r[:, 2] * length)], names=[*names, "sequence_id", "offset"])

    ranked = cut.join(first, ["p_task", "length"]).select(*names, (F.col("p_before") + F.col("p_rank")).alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name in names)
    return in_arrow(ranked, place, f"{schema}, sequence_id long, offset long")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every piece of every document and its place."""
    return packed(documents(spark, sf_dir), vocabulary_path())
