"""LM scoring: a log-bilinear neural model, trained in numpy by noise-contrastive estimation.

A token is predicted from the two before it: the sum of their context vectors,
each scaled by its position's weights, is multiplied with the target vectors. Frequent
words have vectors of their own; all others share one of ``CLASSES`` vectors by
their shape and are told apart by smoothed counts inside the class, so every text
has a normalised probability. As the context is a sum, exp of it is a product
of two tables, and one matrix product gives the normaliser of every context.

Training passes over every training text in each round: each task takes
gradient steps from the shared parameters, and the steps are averaged by
tokens through an exchange.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._text import Words, blocks, buffers, words_of
from corpusloom.plans.runtime import materialize

WORDS, DIMENSION, ROUNDS, NOISE, BATCH, STEP = 4096, 32, 1, 128, 256, 0.08
#: Tokens that a training task gathers before it takes steps; equal ones among them cost one row.
TOKENS_TOGETHER = 200_000
#: Words whose counts are broadcast to the scoring tasks, the commonest; counts of the rest are joined by shuffle.
BROADCAST_WORDS = 1_000_000
#: The name of the end token, which no word has (up to a collision of 64-bit hashes).
END = np.uint64(0x5D1F0C3A9B27E684)
CLASSES = 96
_SLICES = 64

_SHAPE = np.zeros(256, np.int64)
_SHAPE[97:123] = np.arange(26)
_SHAPE[48:58] = 26
_SHAPE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 27 + np.arange(32) % 13
_SHAPE[128:] = 40 + np.arange(128) % 8


def word_class(words: Words) -> np.ndarray:
    """A word's class: its last byte's kind, and whether it has a byte above ASCII."""
    if not len(words.start):
        return np.zeros(0, np.int64)
    high = np.concatenate([[0], np.cumsum(words.data >= 128)])
    return 2 * _SHAPE[words.data[words.end - 1]] + (high[words.end] > high[words.start])


@dataclass
class Vocabulary:
    """Names of the words with own vectors (sorted), and what smoothing inside classes needs."""

    names: np.ndarray
    index: np.ndarray
    counts: np.ndarray  # of each symbol in training
    class_total: np.ndarray  # counts of the words in each class, plus their number, plus one
    tokens: int
    distinct: int

    @property
    def size(self) -> int:
        return len(self.names) + CLASSES

    def symbols(self, names: np.ndarray, classes: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return classes
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, self.index[at], len(self.names) + classes)


@dataclass
class Parameters:
    context: np.ndarray  # (symbols + 1 for the text's beginning) x dimension
    target: np.ndarray
    bias: np.ndarray
    near: np.ndarray
    far: np.ndarray

    @staticmethod
    def fresh(vocabulary: Vocabulary, dimension: int, seed: int = 11) -> Parameters:
        rng = np.random.default_rng(seed)
        v = vocabulary.size
        p = (vocabulary.counts + 0.5) / (vocabulary.counts + 0.5).sum()
        draw = lambda n: rng.normal(0, 0.1, (n, dimension)).astype(np.float32)
        return Parameters(draw(v + 1), draw(v), np.log(p).astype(np.float32), np.ones(dimension, np.float32), np.full(dimension, 0.5, np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.context, self.target, self.bias, self.near, self.far)])

    def unflat(self, values: np.ndarray) -> Parameters:
        out, at = [], 0
        for x in (self.context, self.target, self.bias, self.near, self.far):
            out.append(values[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Parameters(*out)


def sequences(words: Words, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, symbol before, the one before that, document) of every token of a block, ends included."""
    n = len(words.first) - 1
    symbols = np.insert(vocabulary.symbols(words.hashes(), word_class(words)), words.first[1:], vocabulary.symbols(np.array([END]), np.zeros(1, np.int64))[0])
    begin = words.first[:-1] + np.arange(n)
    start = vocabulary.size
    near, far = np.empty_like(symbols), np.empty_like(symbols)
    near[1:], far[2:] = symbols[:-1], symbols[:-2]
    near[begin] = start
    far[begin] = start
    second = begin + 1
    far[second[second < np.append(begin[1:], len(symbols))]] = start
    return symbols, near, far, np.repeat(np.arange(n), np.diff(words.first) + 1)


class Trainer:
    """Noise-contrastive steps with per-coordinate rates; noise words are shared by a batch."""

    def __init__(self, parameters: Parameters, vocabulary: Vocabulary, noise: int, step: float, seed: int, rows: int):
        self.p = Parameters(*(x.copy() for x in vars(parameters).values()))
        self.past = [np.full_like(x, 1e-2) for x in vars(self.p).values()]
        self.rng = np.random.default_rng(seed)
        share = (vocabulary.counts + 0.5) / (vocabulary.counts + 0.5).sum()
        self.edges, self.log_noise = np.cumsum(share), np.log(share * noise).astype(np.float32)
        self.noise, self.step, self.rows = noise, step, rows
        self.seen = 0

    def _apply(self, which: int, rows: np.ndarray | None, grad: np.ndarray) -> None:
        value, past = list(vars(self.p).values())[which], self.past[which]
        if rows is None:
            past += grad * grad
            value += self.step * grad / np.sqrt(past)
            return
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        begin = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        total, at = np.add.reduceat(grad[order], begin, axis=0), rows[begin]
        past[at] += total * total
        value[at] += self.step * total / np.sqrt(past[at])

    def learn(self, keys: np.ndarray) -> None:
        """Steps over (symbol, before, before that) packed into ``keys``; equal ones are one row with its count."""
        side = self.p.context.shape[0]
        keys, count = np.unique(keys, return_counts=True)
        order = self.rng.permutation(len(keys))
        for at in range(0, len(keys), self.rows):
            some = order[at : at + self.rows]
            rest, far = np.divmod(keys[some], side)
            w, near = np.divmod(rest, side)
            self.batch(w, near, far, count[some].astype(np.float32))
        self.seen += int(count.sum())

    def batch(self, w: np.ndarray, near: np.ndarray, far: np.ndarray, count: np.ndarray) -> None:
        p = self.p
        noise = np.minimum(np.searchsorted(self.edges, self.rng.random(self.noise)), len(self.edges) - 1)
        a, b, r, rn = p.context[near], p.context[far], p.target[w], p.target[noise]
        q = a * p.near + b * p.far
        real = (q * r).sum(axis=1) + p.bias[w] - self.log_noise[w]
        false = q @ rn.T + (p.bias[noise] - self.log_noise[noise])
        scale = count * np.float32(64 / count.sum())
        with np.errstate(over="ignore"):
            up = scale / (1 + np.exp(real))
            np.negative(false, out=false)
            np.exp(false, out=false)
            false += 1
            down = np.divide(scale[:, None], false, out=false)
        dq = up[:, None] * r - down @ rn
        self._apply(3, None, (dq * a).sum(axis=0))
        self._apply(4, None, (dq * b).sum(axis=0))
        self._apply(0, np.concatenate([near, far]), np.concatenate([dq * p.near, dq * p.far]))
        self._apply(1, np.concatenate([w, noise]), np.concatenate([up[:, None] * q, -(down.T @ q)]))
        self._apply(2, np.concatenate([w, noise]), np.concatenate([up, -down.sum(axis=0)]))


class Scorer:
    """log10 probabilities: every context's normaliser comes from one matrix product, a token's score from its own vectors."""

    def __init__(self, p: Parameters):
        self.target, self.bias = p.target, p.bias
        self.near, self.far = p.context * p.near, p.context * p.far
        right = self.far @ p.target.T + p.bias
        over = right.max(axis=1)
        right -= over[:, None]
        np.exp(right, out=right)
        self.norm = np.empty((len(self.near), len(self.far)), np.float32)
        for at in range(0, len(self.near), 256):  # in rows, so that two tables are held at most
            rows = slice(at, at + 256)
            left = self.near[rows] @ p.target.T
            top = left.max(axis=1)
            left -= top[:, None]
            self.norm[rows] = np.log(np.maximum(np.exp(left, out=left) @ right.T, 1e-37)) + top[:, None] + over[None, :]

    def log10(self, w: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        out = np.empty(len(w))
        for at in range(0, len(w), 1 << 15):
            some = slice(at, at + (1 << 15))
            own = np.einsum("ij,ij->i", self.near[near[some]] + self.far[far[some]], self.target[w[some]])
            out[some] = own.astype(np.float64) + self.bias[w[some]] - self.norm[near[some], far[some]]
        return out / np.log(10)


def word_counts(docs: DataFrame, held: Column) -> DataFrame:
    """(word long, class int, count long) over the training texts' tokens; the end token has class -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_here: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            names, kind, count = (np.concatenate([h[i] for h in held_here]) for i in range(3))
            order = np.argsort(names, kind="stable")
            names = names[order]
            begin = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
            return names[begin], kind[order][begin], np.add.reduceat(count[order], begin)

        def out() -> pa.RecordBatch:
            names, kind, count = merged()
            return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(kind.astype(np.int32)), pa.array(count)], ["word", "class", "count"])

        for batch in blocks(batches, size=4 << 20):
            words = words_of(*buffers(batch.column(0)), lower=True)
            names, first, count = np.unique(words.hashes(), return_index=True, return_counts=True)
            held_here.append((names, word_class(words)[first], count))
            held_here.append((np.array([END]), np.array([-1]), np.array([batch.num_rows])))
            if sum(len(h[0]) for h in held_here) > 1_500_000:
                held_here = [merged()]
                if len(held_here[0][0]) > 1_000_000:
                    yield out()
                    held_here = []
        if held_here:
            yield out()

    rows = docs.where(~held).select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "word long, class int, count long")
    return materialize(rows.groupBy("word").agg(F.min("class").alias("class"), F.sum("count").alias("count")), "word-counts")


def build_vocabulary(counts: DataFrame, words: int = WORDS) -> Vocabulary:
    """Own vectors for the ``words`` commonest tokens (the end among them), of equals those of smaller hashes."""
    tokens, distinct = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("word")).first()
    end = int(END.view(np.int64))
    first = counts.orderBy((F.col("word") != end), F.desc("count"), "word").limit(words)
    top = first.toArrow()
    names = np.asarray(top["word"]).astype(np.int64).view(np.uint64) if top.num_rows else np.array([END])
    count = np.asarray(top["count"]).astype(float) if top.num_rows else np.zeros(1)
    rest = counts.groupBy("class").agg(F.sum("count").alias("count"), F.count("word").alias("words")).collect()
    mass, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in rest:
        if r["class"] >= 0:
            mass[r["class"]], kinds[r["class"]] = r["count"], r["words"]
    if top.num_rows:
        own = np.asarray(top["class"])
        np.subtract.at(mass, own[own >= 0], count[own >= 0])
        np.subtract.at(kinds, own[own >= 0], 1)
    order = np.argsort(names)
    return Vocabulary(names[order], np.arange(len(names))[order], np.concatenate([count, mass]), mass + kinds + 1, int(tokens), int(distinct))


def train(docs: DataFrame, held: Column, vocabulary: Vocabulary, rounds: int = ROUNDS, dimension: int = DIMENSION, noise: int = NOISE, step: float = STEP, batch_rows: int = BATCH) -> Parameters:
    """Rounds over all training texts; between rounds only sums of steps travel, cut into slices, and only one vector of parameters reaches the driver.

    A task's steps follow its own rows, so the parameters depend, slightly, on how the input is split into tasks.
    """
    spark = docs.sparkSession
    shared = Parameters.fresh(vocabulary, dimension)
    texts = docs.where(~held).select(F.coalesce("text", F.lit("")).alias("text"))
    for number in range(rounds):
        sent = spark.sparkContext.broadcast((shared, vocabulary))  # fixed by WORDS and DIMENSION

        def run(batches: Iterator[pa.RecordBatch], number=number, sent=sent) -> Iterator[pa.RecordBatch]:
            parameters, words = sent.value
            trainer = Trainer(parameters, words, noise, step / (1 + number), number, batch_rows)
            held: list[np.ndarray] = []
            for batch in blocks(batches):
                w, near, far, _ = sequences(words_of(*buffers(batch.column(0)), lower=True), words)
                held.append((w * (words.size + 1) + near) * (words.size + 1) + far)
                if sum(map(len, held)) >= TOKENS_TOGETHER:
                    trainer.learn(np.concatenate(held))
                    held = []
            if held:
                trainer.learn(np.concatenate(held))
            if trainer.seen:
                moved = (trainer.p.flat() - parameters.flat()).astype(np.float64) * trainer.seen
                parts = np.array_split(moved, _SLICES)
                yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([trainer.seen] * _SLICES, pa.int64()), pa.array([p.astype(np.float32) for p in parts], pa.list_(pa.float32()))], ["slice", "tokens", "moved"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for batch in batches:
                for s, n, moved in zip(*(batch.column(i) for i in range(3))):
                    have = total.setdefault(s.as_py(), [0, 0.0])
                    have[0] += n.as_py()
                    have[1] = have[1] + np.asarray(moved.values, dtype=np.float64)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1] for v in total.values()], pa.list_(pa.float64()))], ["slice", "tokens", "moved"])

        steps = texts.mapInArrow(run, "slice int, tokens long, moved array<float>").repartition(_SLICES // 4, "slice")
        sums = sorted(steps.mapInArrow(add, "slice int, tokens long, moved array<double>").collect())
        if not sums:
            break
        shared = shared.unflat(shared.flat() + np.concatenate([np.array(r["moved"]) / r["tokens"] for r in sums]))
    return shared


_scorers: dict = {}


def score_texts(docs: DataFrame, remainder_of: int = 7, held_at: int = 2, words: int = WORDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Null text is empty: its one token is the end. A null doc_id is the empty text for
    the fold, so it trains. Texts of any length are read whole; equal texts score equally.
    Repeated rows are counted and scored each; extra columns are ignored, whatever their names. Without training texts both scores come from smoothing alone; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(remainder_of)) == held_at
    counts = word_counts(docs, held)
    vocabulary = build_vocabulary(counts, words)
    parameters = train(docs, held, vocabulary, rounds)

    sizes = counts.groupBy("count").agg(F.count("word").alias("n")).orderBy(F.desc("count"))
    least, room = 1, BROADCAST_WORDS
    for r in sizes.toLocalIterator():  # few distinct counts are large; stops at the first that does not fit
        room -= r["n"]
        if room < 0:
            least = r["count"] + 1
            break
    known = counts.where(F.col("count") >= least).select("word", "count").toArrow()
    order = np.argsort(np.asarray(known["word"]).astype(np.int64).view(np.uint64))
    table = (np.asarray(known["word"]).astype(np.int64).view(np.uint64)[order], np.asarray(known["count"]).astype(np.int64)[order])
    tag = uuid.uuid4().hex
    sent = spark.sparkContext.broadcast((tag, parameters, vocabulary, table))  # at most BROADCAST_WORDS counts
    base_norm = float(np.log10(vocabulary.tokens + vocabulary.distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, p, v, (names, count) = sent.value
        if tag not in _scorers:
            _scorers.clear()
            _scorers[tag] = Scorer(p)
        scorer = _scorers[tag]
        row = TaskContext.get().partitionId() << 40
        for batch in blocks(batches):
            words = words_of(*buffers(batch.column(1)), lower=True)
            n = batch.num_rows
            w, near, far, doc = sequences(words, v)
            score = np.bincount(doc, scorer.log10(w, near, far), n).astype(np.float64)
            tokens = np.insert(words.hashes(), words.first[1:], END)
            classes = np.insert(word_class(words), words.first[1:], 0)
            at = np.minimum(np.searchsorted(names, tokens), max(len(names) - 1, 0))
            hit = names[at] == tokens if len(names) else np.zeros(len(tokens), bool)
            c = np.where(hit, count[at] if len(names) else 0, 0)
            base = np.bincount(doc[hit], np.log10(c[hit] + 1.0) - base_norm, n).astype(np.float64)
            inner = hit & (w >= len(v.names))
            score += np.bincount(doc[inner], np.log10((c[inner] + 1.0) / v.class_total[classes[inner]]), n)
            rare = np.flatnonzero(~hit)
            kind = np.where(w[rare] >= len(v.names), classes[rare], -1)
            ids = row + np.arange(n)
            row += n
            null = lambda k, t: pa.nulls(k, t)
            m = len(rare)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([ids, ids[doc[rare]]])), pa.concat_arrays([batch.column(0), null(m, batch.column(0).type)]), pa.concat_arrays([pa.array(np.bincount(doc, minlength=n)), null(m, pa.int64())]),
                    pa.concat_arrays([pa.array(np.bincount(doc[hit], minlength=n)), null(m, pa.int64())]), pa.concat_arrays([pa.array(base), null(m, pa.float64())]), pa.concat_arrays([pa.array(score), null(m, pa.float64())]),
                    pa.concat_arrays([null(n, pa.int64()), pa.array(tokens[rare].view(np.int64))]), pa.concat_arrays([null(n, pa.int32()), pa.array(kind.astype(np.int32))]),
                ],
                ["row", "doc_id", "n_tokens", "known", "base", "part", "word", "class"],
            )

    schema = f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, known long, base double, part double, word long, class int"
    rows = materialize(docs.select("doc_id", "text").mapInArrow(run, schema), "lm-scores")
    totals = F.array(*[F.lit(float(x)) for x in vocabulary.class_total])
    rare = rows.where("word IS NOT NULL").groupBy("row", "word", "class").count().join(counts.where(F.col("count") < least).select("word", F.col("count").alias("c")), "word", "left")
    c = F.coalesce("c", F.lit(0))
    inside = F.when(F.col("class") >= 0, F.log10((c + 1) / F.element_at(totals, F.col("class") + 1))).otherwise(0.0)
    rare = rare.groupBy("row").agg(F.sum(F.when(c > 0, F.col("count")).otherwise(0)).alias("more_known"), F.sum(F.col("count") * (F.log10(c + 1) - base_norm)).alias("more_base"), F.sum(F.col("count") * inside).alias("more_score"))
    out = rows.where("word IS NULL").join(rare, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", plus("known", "more_known").alias("n_known"), F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), plus("base", "more_base").alias("base_score"), plus("part", "more_score").alias("score"))
