"""Language-model scoring: a smoothed n-gram model as a backoff automaton over words and text ends.

Each task packs the documents that it reads into shards of bounded size, a row each, which is written once. A shard asks for
the counts of its distinct n-grams only: it sends their 64-bit hashes, sorted, with its own training counts, cut up into as many
hash ranges as there are shuffle partitions; each range adds up the counts of all shards and answers every asker with totals
in the asker's order. So each n-gram crosses the network once for each shard that has it, however often it occurs;
rows are shards times ranges, in proportion to the corpus; texts are shuffled once, compressed, to meet their answers; nothing is broadcast.
The memory of a range is what is asked divided by the shuffle partitions, which grow with the data as for any Spark job.

A shard then builds its automaton: a state for the start and for each known context, an arc to a next state for each seen
n-gram, whose weight is its smoothed log-probability, and a failure arc to the state of the next shorter context, whose weight is the backoff.
One traversal from left to right, of all texts side by side, carries each text's state, takes failure arcs until the
next token has an arc, and adds up the weights.

Smoothing is Dirichlet, level by level: p(w | ctx) = (c(ctx w) + mu * p(w | shorter ctx)) / (c(ctx) + mu),
ending in add-one counts over the training tokens and one unknown token. All n-grams of all training
documents count, single ones too.

Defined cases: a null or empty text is one end token; a very long text is a shard of its own and read whole; repeated rows are
scored and counted each; with no training token at all p = 1 / (V + 1) = 1 for every token; a null id is in no fold, so it trains and is
not held out; an empty table gives an empty result; further input columns, whatever their names, are not carried. Hashes have 64 bits:
among 10^8 n-grams a collision has a chance of about 0.0003.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from momentlens.llm.common import documents, fold, in_arrow, text_chunks, written

ORDER = 2
MU = 400.0
SHARD_BYTES = 6 << 20
#: Tokens that are read one after another.
RUN = 512
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of contexts followed by words."""
    h = (context * _MIX) ^ (word + _MIX + (context >> np.uint64(7)))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Tokens:
    """The tokens of some texts: word numbers, 0 for the end, in one row; and the hash of each number."""

    def __init__(self, texts: list[bytes]):
        split = [t.translate(_LOWER).split() for t in texts]
        number = {w: k for k, w in enumerate(set(chain.from_iterable(split)), 1)}
        ends = np.cumsum([len(ws) + 1 for ws in split], dtype=np.int64)
        self.ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        inside = np.ones(len(self.ids), bool)
        inside[ends - 1] = False
        self.ids[inside] = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(inside.sum()))
        self.starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        self.lengths = np.diff(np.concatenate(([0], ends)))
        # words are not empty, so the end's hash is of a text that is no word
        self.hash = np.fromiter(chain((xxhash.xxh64_intdigest(b""),), map(xxhash.xxh64_intdigest, number)), np.uint64, len(number) + 1)


class Grams:
    """The distinct n-grams of some tokens up to an order, by level; level 0 has the single tokens.

    ``at[n]`` gives each token's n-gram of n + 1 tokens that ends with it. A text begins with the end token as its context.
    """

    def __init__(self, tokens: Tokens, order: int):
        self.keys, self.at, self.context = [], [], []
        first = np.zeros(len(tokens.ids), bool)
        first[tokens.starts] = True
        _, at = np.unique(tokens.ids, return_inverse=True)
        keys = tokens.hash[np.unique(tokens.ids)]
        self.keys.append(keys)
        self.at.append(at)
        for _ in range(1, order):
            # what stands before a token: the level's n-gram that ends with the token before, or the bare start
            before = np.concatenate(([-1], self.at[-1][:-1])) if len(at) else at
            before = np.where(first, -1, before)
            pair, at = np.unique((before + 1) * (len(self.keys[0]) + 1) + self.at[0], return_inverse=True)
            context, word = pair // (len(self.keys[0]) + 1) - 1, pair % (len(self.keys[0]) + 1)
            start = np.uint64(len(self.keys))
            self.context.append(context)
            self.keys.append(_mixed(np.where(context < 0, start, self.keys[-1][context]), self.keys[0][word]))
            self.at.append(at)


def _sorted(grams: Grams) -> tuple[np.ndarray, np.ndarray]:
    """All distinct hashes in order, and where each level's n-grams stand among them."""
    return np.unique(np.concatenate(grams.keys), return_inverse=True)


def _planes(keys: np.ndarray) -> bytes:
    """Byte planes from the highest: sorted numbers' high bytes are runs, which compress."""
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(">u8").reshape(-1).astype(np.uint64)


def _numbers(values: np.ndarray) -> bytes:
    """Byte planes of 64-bit counts."""
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


def _packer(shard_bytes: int, id_type: pa.DataType):
    """Rows of texts to a row for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        ids, trains, texts, held = [], [], [], 0

        def packed() -> pa.RecordBatch:
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            flags = pa.concat_arrays(trains)
            lengths, data = pa.array(list(map(len, texts)), pa.int64()), pa.compress(b"".join(texts), "zstd", asbytes=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard]), one(pa.concat_arrays(ids).cast(id_type)), one(flags), one(lengths), pa.array([data], pa.binary()), pa.array([held]), pa.array([flags.true_count])],
                names=["shard", "ids", "trains", "lengths", "data", "bytes", "n_trains"],
            )

        for batch, part in text_chunks(batches, most=shard_bytes):
            size = sum(map(len, part))
            if texts and held + size > shard_bytes:
                yield packed()
                shard, ids, trains, texts, held = shard + 1, [], [], [], 0
            ids.append(batch.column("id"))
            trains.append(batch.column("trains"))
            texts += part
            held += size
        if texts:
            yield packed()

    return run


def _unpacked(table: pa.Table) -> list[bytes]:
    """The texts of one shard."""
    data = memoryview(pa.decompress(table.column("data")[0].as_py(), decompressed_size=table.column("bytes")[0].as_py(), codec="zstd"))
    ends = np.cumsum(table.column("lengths")[0].values.to_numpy())
    return [bytes(data[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _asker(order: int, ranges: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield asked(pa.Table.from_batches([batch.slice(k, 1)]))

    def asked(table: pa.Table) -> pa.RecordBatch:
        tokens = Tokens(_unpacked(table))
        grams = Grams(tokens, order)
        keys, places = _sorted(grams)
        trains = np.repeat(np.asarray(table.column("trains")[0].as_py(), np.int64), tokens.lengths)
        counts, begin = np.zeros(len(keys), np.int64), 0
        for level, at in zip(grams.keys, grams.at, strict=True):
            own = places[begin : begin + len(level)]
            np.add.at(counts, own, np.bincount(at, weights=trains, minlength=len(level)).astype(np.int64))
            begin += len(level)
        single = np.zeros(len(keys), bool)
        single[places[: len(grams.keys[0])]] = True
        part = _range_of(keys, ranges)
        cuts = np.searchsorted(part, np.arange(ranges + 1))
        used = np.flatnonzero(np.diff(cuts))
        shard = table.column("shard")[0].as_py()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(used, pa.int64()), pa.array([shard] * len(used), pa.int64()),
                pa.array([_planes(keys[cuts[p] : cuts[p + 1]]) for p in used], pa.binary()), pa.array([_numbers(counts[cuts[p] : cuts[p + 1]]) for p in used], pa.binary()),
                pa.array([np.packbits(single[cuts[p] : cuts[p + 1]]).tobytes() for p in used], pa.binary()),
            ],
            names=["part", "shard", "keys", "counts", "single"],
        )

    return ask


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash: its high 32 bits, scaled."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _answer(table: pa.Table) -> pa.Table:
    """Totals for each asker of a range; the first row also says how many training tokens and kinds of tokens the range has."""
    keys = [_from_planes(k) for k in table.column("keys").to_pylist()]
    counts = [_from_numbers(c) for c in table.column("counts").to_pylist()]
    single = [np.unpackbits(np.frombuffer(s, np.uint8), count=len(k)).astype(bool) for s, k in zip(table.column("single").to_pylist(), keys, strict=True)]
    known, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(known), np.int64)
    np.add.at(total, at, np.concatenate(counts))
    token = np.zeros(len(known), bool)
    token[at[np.concatenate(single)]] = True
    cuts = np.cumsum([0, *map(len, keys)])
    n = len(keys)
    return pa.table(
        {
            "shard": table.column("shard"),
            "part": table.column("part"),
            "totals": pa.array([_numbers(total[at[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
            "tokens": pa.array([int(total[token].sum())] + [0] * (n - 1), pa.int64()),
            "kinds": pa.array([int((total[token] > 0).sum())] + [0] * (n - 1), pa.int64()),
        }
    )


class Automaton:
    """State 0 is the root, then come the starts of a text, by the tokens that they stand for, and the contexts, which are the n-grams of all levels but the last.

    Arcs are sorted by state * words + word; the root has one for every word, with or without counts.
    """

    def __init__(self, grams: Grams, totals: list[np.ndarray], starts: int, n_tokens: int, n_kinds: int, mu: float):
        order, self.words = len(totals), len(totals[0])
        first = np.cumsum([order, *(len(t) for t in totals[:-1])])[:order]  # the state of each level's first n-gram
        suffix = [np.zeros(0, np.int64)]  # for each n-gram, the one of the level below that lacks the first token
        for level in range(1, order):
            out = np.zeros(len(totals[level]), np.int64)
            out[grams.at[level]] = grams.at[level - 1]
            suffix.append(out)
        n = order + sum(len(t) for t in totals[:-1])
        self.start, self.fail, self.backoff = order - 1, np.zeros(n, np.int64), np.zeros(n)
        self.fail[1:order] = np.arange(order - 1)
        self.backoff[1:order] = np.log10(mu / (starts + mu))
        for level in range(order - 1):
            own = slice(first[level], first[level] + len(totals[level]))
            self.fail[own] = first[level - 1] + suffix[level] if level else 0
            self.backoff[own] = np.log10(mu / (totals[level] + mu))
        p = (totals[0] + 1) / (n_tokens + n_kinds + 1)
        to = first[0] + np.arange(self.words) if order > 1 else np.zeros(self.words, np.int64)
        word = np.arange(self.words)
        key, weight, target = [word], [np.log10(p)], [to]
        for level in range(1, order):
            context, total = grams.context[level - 1], totals[level]
            word = word[suffix[level]]
            size = np.where(context < 0, starts, totals[level - 1][context])
            p = (total + mu * p[suffix[level]]) / (size + mu)
            seen = np.flatnonzero(total)
            state = np.where(context < 0, level, first[level - 1] + context)
            to = first[level] + np.arange(len(total)) if level < order - 1 else first[level - 1] + suffix[level]
            key.append((state * self.words + word)[seen])
            weight.append(np.log10(p[seen]))
            target.append(to[seen])
        self.key, self.weight, self.target = map(np.concatenate, (key, weight, target))
        sort = np.argsort(self.key, kind="stable")
        self.key, self.weight, self.target = self.key[sort], self.weight[sort], self.target[sort]

    def scores(self, word: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The summed weights of texts, each a run of ``word``.

        A long text is read as several runs. As the last ``start`` tokens settle the state, a run begins that many tokens early, at the root, and doesn't add those.
        """
        runs = -(-lengths // RUN)
        text = np.repeat(np.arange(len(lengths)), runs)
        number = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
        early = np.where(number > 0, self.start, 0)
        begin = starts[text] + number * RUN - early
        reads = np.minimum(lengths[text] - number * RUN, RUN) + early
        lanes = np.argsort(-reads, kind="stable")  # those still reading are a prefix
        text, begin, early, left = text[lanes], begin[lanes], early[lanes], -reads[lanes]
        state, sums = np.where(early > 0, 0, self.start), np.zeros(len(lanes))
        for place in range(int(reads.max(initial=0))):
            going = np.arange(int(np.searchsorted(left, -place, side="left")))
            read = word[begin[going] + place]
            added = np.zeros(len(going))
            while len(going):
                at = state[going]
                key = at * self.words + read
                arc = key  # the root's arcs come first, one for each word
                if (deep := np.flatnonzero(at)).size:
                    arc = key.copy()
                    arc[deep] = np.minimum(np.searchsorted(self.key, key[deep]), len(self.key) - 1)
                fits = self.key[arc] == key
                on, arc = going[fits], arc[fits]
                added[on] += self.weight[arc]
                state[on] = self.target[arc]
                going, read = going[~fits], read[~fits]
                added[going] += self.backoff[state[going]]
                state[going] = self.fail[state[going]]
            sums[: len(added)] += np.where(place >= early[: len(added)], added, 0)
        return np.bincount(text, weights=sums, minlength=len(lengths))


def _scorer(order: int, mu: float, n_tokens: int, n_kinds: int, n_starts: int):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        tokens = Tokens(_unpacked(docs))
        grams = Grams(tokens, order)
        keys, places = _sorted(grams)
        totals = np.concatenate([_from_numbers(x) for _, x in sorted(zip(answers.column("part").to_pylist(), answers.column("totals").to_pylist(), strict=True))])
        if len(totals) != len(keys):
            raise ValueError("a shard's answers must fit what it asked")
        cuts = np.cumsum([len(k) for k in grams.keys])
        levels = [totals[x] for x in np.split(places, cuts[:-1])]
        base = np.log10((levels[0] + 1) / (n_tokens + n_kinds + 1))[grams.at[0]]
        known = (levels[0] > 0)[grams.at[0]]
        scores = Automaton(grams, levels, n_starts, n_tokens, n_kinds, mu).scores(grams.at[0], tokens.starts, tokens.lengths)
        add = lambda x: np.add.reduceat(x, tokens.starts)
        n = len(tokens.starts)
        return pa.table(
            {
                "id": docs.column("ids")[0].values, "trains": docs.column("trains")[0].values, "n_tokens": pa.array(tokens.lengths), "n_known": pa.array(add(known.astype(np.int64))),
                "train_tokens": pa.array(np.full(n, n_tokens, np.int64)), "base_score": pa.array(add(base)), "score": pa.array(scores),
            }
        )

    return score


def packed(docs: DataFrame, trains: F.Column, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row for each shard of ``docs``: its ids, texts and which of them are learnt from."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(trains, F.lit(False)).alias("trains"))
    id_type = docs.schema[id_col].dataType
    schema = f"shard long, ids array<{id_type.simpleString()}>, trains array<boolean>, lengths array<long>, data binary, bytes long, n_trains long"
    return in_arrow(d, _packer(shard_bytes, to_arrow_type(id_type)), schema)


def asked(shards: DataFrame, order: int, ranges: int) -> DataFrame:
    """What each shard asks each of so many hash ranges."""
    return in_arrow(shards, _asker(order, ranges), "part long, shard long, keys binary, counts binary, single binary")


def scored(docs: DataFrame, trains: F.Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, mu: float = MU, shard_bytes: int = SHARD_BYTES, ranges: int | None = None) -> DataFrame:
    """id, trains, n_tokens, n_known, train_tokens, base_score and score of every row; the rows where ``trains`` is true are learnt from.

    ``ranges``: as many as shuffle partitions unless given.
    """
    spark = docs.sparkSession
    shards = written(packed(docs, trains, id_col, text_col, shard_bytes), "shards")
    asks = asked(shards, order, ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
    answers = written(asks.groupBy("part").applyInArrow(_answer, "shard long, part long, totals binary, tokens long, kinds long"), "ngram-counts")
    n_tokens, n_kinds = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    starts = shards.agg(F.coalesce(F.sum("n_trains"), F.lit(0))).first()[0]
    return shards.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(
        _scorer(order, mu, n_tokens, n_kinds, starts),
        f"id {docs.schema[id_col].dataType.simpleString()}, trains boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document's log10 probability; fold 2 of 7 is held out."""
    d = scored(documents(spark, sf_dir), fold(F.col("doc_id"), 7) != 2)
    return d.select(F.col("id").alias("doc_id"), (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
