"""Token counts: greedy longest-match word pieces by a linear automaton that never builds the pieces.

The vocabulary is a trie of bytes. Each node has a failure link: the node that is left when the greedy
pieces that the node's bytes begin with are popped, and the number of those pieces. Reading a word follows
edges and, where none fits, adds the popped count and goes to the failure link; so each byte is read
once and a word's count is the sum of popped counts. Bytes that no piece covers are single-byte pieces.

A word is a run of text between white space with the vocabulary's word mark before it; words are counted
once for each slice of documents.

Defined cases: a null or blank text has 0 tokens and 0 words; repeated rows are counted each; very long
words are read byte by byte like others; an empty table gives an empty result; further columns of
``docs`` stay, those named ``k_words`` and ``k_tokens`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from momentlens.llm.common import documents, in_arrow, text_chunks

VOCABULARY = "piece_bpe_32k.model"
MARK = "\u2581".encode()
#: Bytes of pieces that are sent to the tasks, at most.
MOST_BYTES = 64 << 20
#: Longer words are read alone.
LONG = 64


class Automaton:
    """``pieces``: byte strings; all 256 single bytes are pieces too."""

    def __init__(self, pieces: list[bytes], mark: bytes = MARK):
        self.mark = mark
        goto: list[dict[int, int]] = [{}]
        final = [False]
        for piece in chain((bytes([b]) for b in range(256)), pieces):
            node = 0
            for b in piece:
                if b not in goto[node]:
                    goto[node][b] = len(goto)
                    goto.append({})
                    final.append(False)
                node = goto[node][b]
            final[node] = bool(piece)
        fail, pops = [0] * len(goto), [0] * len(goto)
        queue = [(0, b, c) for b, c in goto[0].items()]
        for parent, b, node in queue:
            if final[node]:
                fail[node], pops[node] = 0, 1
            else:  # the parent's pieces are popped until an edge fits
                at, n = fail[parent], pops[parent]
                while b not in goto[at]:
                    n += pops[at]
                    at = fail[at]
                fail[node], pops[node] = goto[at][b], n
            queue.extend((node, k, v) for k, v in goto[node].items())
        self.goto, self.fail, self.pops = goto, np.array(fail, np.int64), np.array(pops, np.int64)
        # edges as one sorted row of node * 256 + byte, for many words at once
        self.edge = np.array([n * 256 + b for n, edges in enumerate(goto) for b in sorted(edges)], np.int64)
        self.target = np.array([edges[b] for edges in goto for b in sorted(edges)], np.int64)

    def count(self, word: bytes) -> int:
        """Pieces of one marked word."""
        at, n = 0, 0
        for b in word:
            while b not in self.goto[at]:
                n += int(self.pops[at])
                at = int(self.fail[at])
            at = self.goto[at][b]
        while at:
            n += int(self.pops[at])
            at = int(self.fail[at])
        return n

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Pieces of many unmarked words."""
        marked = [self.mark + w for w in words]
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        out = np.zeros(len(marked), np.int64)
        for k in np.flatnonzero(lengths > LONG):
            out[k] = self.count(marked[k])
        short = np.flatnonzero(lengths <= LONG)
        short = short[np.argsort(-lengths[short], kind="stable")]  # the longest first: those still reading are a prefix
        data = np.frombuffer(b"".join(marked[k] for k in short), np.uint8).astype(np.int64)
        lengths = lengths[short]
        starts = np.cumsum(lengths) - lengths
        at, n = np.zeros(len(short), np.int64), np.zeros(len(short), np.int64)
        for place in range(int(lengths.max(initial=0))):
            going = np.arange(int(np.searchsorted(-lengths, -place, side="left")))
            byte = data[starts[going] + place]
            while len(going):
                key = at[going] * 256 + byte
                edge = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
                fits = self.edge[edge] == key
                at[going[fits]] = self.target[edge[fits]]
                going, byte = going[~fits], byte[~fits]
                n[going] += self.pops[at[going]]
                at[going] = self.fail[at[going]]
        while at.any():
            n += self.pops[at]
            at = self.fail[at]
        out[short] = n
        return out


@lru_cache(maxsize=1)
def _automaton(pieces: tuple[bytes, ...], mark: bytes) -> Automaton:
    """One for each worker process, whatever tasks it runs."""
    return Automaton(list(pieces), mark)


def pieces_of(path: str) -> list[bytes]:
    """The ordinary pieces of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(k).encode() for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]


def counted(docs: DataFrame, pieces: list[bytes], text_col: str = "text", mark: bytes = MARK) -> DataFrame:
    """``docs`` with ``k_words`` and ``k_tokens``."""
    if sum(map(len, pieces)) > MOST_BYTES:
        raise ValueError(f"a vocabulary may have {MOST_BYTES} bytes of pieces")
    docs = docs.drop("k_words", "k_tokens")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(tuple(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared.value, mark)
        for batch, texts in text_chunks(batches, text_col):
            split = [t.split() for t in texts]
            words = list(set().union(*split))
            size = dict(zip(words, automaton.counts(words).tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([len(ws) for ws in split], pa.int64()), pa.array([sum(map(size.__getitem__, ws)) for ws in split], pa.int64())], names=[*names, "k_words", "k_tokens"]
            )

    return in_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField("k_words", T.LongType()), T.StructField("k_tokens", T.LongType())]))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the words and word pieces of every document."""
    d = counted(documents(spark, sf_dir).select("doc_id", "text"), pieces_of(vocabulary_path()))
    return d.select("doc_id", F.col("k_words").alias("n_words"), F.col("k_tokens").alias("n_tokens"))
