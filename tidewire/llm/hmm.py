"""Language-model scoring with a hidden Markov model over word classes.

The states emit classes of words (a hash of the word, so that any task knows it), and a class emits its words by their smoothed counts:
P(word | state) = B[state, class] * (c + 0.1) / (C + 0.1 * (V + 1)) with the class's tokens C and distinct words V. That is a proper
distribution over all words, the model stays small whatever the corpus, and every count comes from the whole training corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewire.llm.common import id_bucket
from tidewire.session import Scratch

STATES, CLASSES, ROUNDS, SEED = 4, 4096, 4, 11
SMOOTH = 0.1
HEAD, HEAD_BYTES = 1 << 16, 128
TRAIN_LENGTH = 1 << 16
BLOCK_TOKENS = 1 << 19
HELD_TOKENS = 1 << 21
FLUSH = 300_000
END = CLASSES


def split_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text; on bytes only A-Z are lowered and only ASCII white space splits."""
    return (text or b"").lower().split()


def classes_of(words: list[bytes]) -> np.ndarray:
    """The class of every word, and the end's."""
    found = np.empty(len(words) + 1, np.uint16)
    found[:-1] = np.fromiter(map(crc32, words), np.uint32, len(words)) % CLASSES
    found[-1] = END
    return found


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def first(class_tokens: np.ndarray, states: int, seed: int) -> Model:
        """Class frequencies, disturbed differently for every state so that the states part."""
        rng = np.random.default_rng(seed)
        emit = (class_tokens + 1.0) * rng.uniform(0.5, 1.5, (states, CLASSES + 1))
        move = np.full((states, states), 0.4 / states) + 0.6 * np.eye(states)
        return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    @staticmethod
    def of_counts(counts: np.ndarray, states: int) -> Model:
        start, move, emit = np.split(counts, [states, states + states * states])
        move, emit = move.reshape(states, states) + 1e-3, emit.reshape(states, -1) + 1e-3
        start = start + 1e-3
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


class _Ragged:
    """Sequences by time: the longest first, so that those still running at a time are a prefix."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences])
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        times = np.concatenate([np.arange(n) for n in lengths])
        self.symbols = np.concatenate([sequences[i] for i in self.order])[np.argsort(times, kind="stable")]
        self.running = np.bincount(times)
        self.at = np.concatenate(([0], np.cumsum(self.running)))


def forward(sequences: list[np.ndarray], model: Model) -> np.ndarray:
    """log10 likelihood of every sequence by the scaled recursion; only the current time is held."""
    ragged, emit = _Ragged(sequences), np.ascontiguousarray(model.emit.T)
    total = np.zeros(len(sequences))
    alpha = None
    for t, n in enumerate(ragged.running):
        seen = emit[ragged.symbols[ragged.at[t]:ragged.at[t + 1]]]
        alpha = (model.start if alpha is None else alpha[:n] @ model.move) * seen
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:n] += np.log10(scale)
    out = np.empty(len(sequences))
    out[ragged.order] = total
    return out


def expected(sequences: list[np.ndarray], model: Model) -> np.ndarray:
    """Baum-Welch: expected starts, moves and emissions of some sequences, in one flat array."""
    ragged, states = _Ragged(sequences), len(model.start)
    at, running, symbols = ragged.at, ragged.running, ragged.symbols
    seen = np.ascontiguousarray(model.emit.T)[symbols]
    alpha, last = np.empty_like(seen), len(running) - 1
    for t, n in enumerate(running):
        now = (model.start if t == 0 else alpha[at[t - 1]:at[t - 1] + n] @ model.move) * seen[at[t]:at[t + 1]]
        scale = now.sum(axis=1, keepdims=True)
        alpha[at[t]:at[t + 1]] = now / scale
        seen[at[t]:at[t + 1]] /= scale
    moves, back, beta = np.zeros((states, states)), np.ascontiguousarray(model.move.T), None
    gamma = alpha.copy()
    for t in range(last, -1, -1):
        n = running[t]
        now = np.ones((n, states))
        if t < last:
            m = running[t + 1]
            ahead = seen[at[t + 1]:at[t + 2]] * beta
            moves += alpha[at[t]:at[t] + m].T @ ahead
            now[:m] = ahead @ back
        gamma[at[t]:at[t + 1]] *= now
        beta = now
    emits = [np.bincount(symbols, weights=gamma[:, k], minlength=CLASSES + 1) for k in range(states)]
    return np.concatenate([gamma[:running[0]].sum(axis=0), (moves * model.move).ravel(), *emits])


def _steps(symbols: np.ndarray, model: Model, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward vectors of one sequence that goes on from ``before``, and its emissions divided by the scales."""
    seen = np.ascontiguousarray(model.emit.T)[symbols]
    alpha = np.empty_like(seen)
    for t in range(len(symbols)):
        now = (model.start if before is None else before @ model.move) * seen[t]
        scale = now.sum()
        before = alpha[t] = now / scale
        seen[t] /= scale
    return alpha, seen


def expected_long(symbols: np.ndarray, model: Model, piece: int = TRAIN_LENGTH) -> np.ndarray:
    """:func:`expected` of one long sequence in bounded memory: forward once, keeping the vector before every piece, then backward piece
    by piece, each gone through forward again; forward and backward vectors are carried over the cuts."""
    states = len(model.start)
    entering: list[np.ndarray | None] = []
    alpha_end = None
    for low in range(0, len(symbols), piece):
        entering.append(alpha_end)
        alpha_end = _steps(symbols[low:low + piece], model, alpha_end)[0][-1]
    moves, emits, back = np.zeros((states, states)), np.zeros((states, CLASSES + 1)), np.ascontiguousarray(model.move.T)
    ahead = None  # what the time after the piece hands back: its emission times its backward vector
    for number in range(len(entering) - 1, -1, -1):
        part = symbols[number * piece:(number + 1) * piece]
        alpha, seen = _steps(part, model, entering[number])
        gamma = np.empty_like(alpha)
        for t in range(len(part) - 1, -1, -1):
            if ahead is None:
                beta = np.ones(states)
            else:
                moves += np.outer(alpha[t], ahead)
                beta = ahead @ back
            gamma[t] = alpha[t] * beta
            ahead = seen[t] * beta
        for k in range(states):
            emits[k] += np.bincount(part, weights=gamma[:, k], minlength=CLASSES + 1)
    return np.concatenate([gamma[0], (moves * model.move).ravel(), emits.ravel()])


def _blocks(items: Iterable, size, most: int = BLOCK_TOKENS) -> Iterator[list]:
    """Items in lists of about ``most`` tokens."""
    held, tokens = [], 0
    for item in items:
        held.append(item)
        tokens += size(item)
        if tokens >= most:
            yield held
            held, tokens = [], 0
    if held:
        yield held


def _alike(sequences: Iterable[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Blocks of sequences of about one length, out of ``HELD_TOKENS`` at a time: steps in time are paid for per block, up to its
    longest sequence."""
    for held in _blocks(sequences, len, HELD_TOKENS):
        yield from _blocks(sorted(held, key=len), len)


def _word_counts(training: DataFrame) -> DataFrame:
    """(word, c) over all training texts, counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(split_words(text.as_py()))
                if len(counts) >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
                    counts = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return training.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _sequences(training: DataFrame) -> DataFrame:
    """The classes of every training text as 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [classes_of(split_words(text.as_py())).tobytes() for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["classes"])

    return training.select("text").mapInArrow(run, "classes binary")


def _most_frequent(counts: DataFrame, head: int) -> DataFrame:
    """At most ``head`` words of ``HEAD_BYTES`` at most, all with a count over some bound: how many words have which count, in steps of a sixteenth of a
    doubling, tells the bound, so only the words themselves leave the tasks."""
    counts = counts.where(F.octet_length("word") <= HEAD_BYTES)
    step = F.floor(F.log2("c") * 16)
    left, bound = head, None
    for row in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        if row["count"] > left:
            break
        left, bound = left - row["count"], row["step"]
    return counts.where(step >= bound) if bound is not None else counts.limit(0)


def train(sequences: DataFrame, class_tokens: np.ndarray, states: int, rounds: int, seed: int) -> Model:
    """Baum-Welch over all sequences: each task adds up its own counts, Spark sums them by place, and only those sums of fixed
    number (states * classes and a few) come to the driver."""
    model = Model.first(class_tokens, states, seed)
    size = states + states * states + states * (CLASSES + 1)
    for _ in range(rounds):
        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            whole = (np.frombuffer(value.as_py(), np.uint16) for batch in batches for value in batch.column(0))
            for block in _alike(whole):
                short = [sequence for sequence in block if len(sequence) <= TRAIN_LENGTH]
                if short:
                    total += expected(short, model)
                for sequence in block:
                    if len(sequence) > TRAIN_LENGTH:
                        total += expected_long(sequence, model)
            place = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[place])], ["place", "amount"])

        found = sequences.mapInArrow(run, "place long, amount double").groupBy("place").agg(F.sum("amount").alias("amount")).collect()
        counts = np.zeros(size)
        counts[[row.place for row in found]] = [row.amount for row in found]
        model = Model.of_counts(counts, states)
    return model


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10, states: int = STATES, rounds: int = ROUNDS,
           head: int = HEAD, seed: int = SEED) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Documents whose crc32 of the id, modulo ``folds``, is 0 are held out; all others train. ``base_score`` is that of single words
    with 0.1 added to every count, ``score`` the model's log10 probability of the whole text, its end included.

    Words are looked up in two ways that agree: the most frequent ones, ``head`` of bounded length at most, travel to the tasks, all
    others are joined with their counts by word. Long texts train as one sequence, piece by piece (:func:`expected_long`). Null and empty texts are their end alone. A null id
    counts as an empty one and is held out. Repeated rows train and are scored each. Nothing to train on makes all words unknown;
    an empty table gives no rows. Other columns of ``docs`` do not matter.
    """
    scratch = Scratch(docs.sparkSession, "hmm")
    body = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[key].alias("doc_id"), (id_bucket(docs[key], folds) == 0).alias("held_out"), F.xxhash64(body).alias("digest"),
                       body.cast("binary").alias("text"))
    training = rows.where("not held_out")
    counts = scratch.keep(_word_counts(training))
    sequences = scratch.keep(_sequences(training))
    by_class = counts.groupBy((F.crc32("word") % CLASSES).alias("class")).agg(F.sum("c").alias("tokens"), F.count("*").alias("words")).collect()
    ends = training.count()
    class_tokens, class_words = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for row in by_class:
        class_tokens[row["class"]], class_words[row["class"]] = row["tokens"], row["words"]
    class_tokens[END], class_words[END] = ends, ends > 0
    tokens, distinct = int(class_tokens.sum()), int(class_words.sum())
    model = train(sequences, class_tokens, states, rounds, seed)
    scratch.drop(sequences)
    within = np.log10(class_tokens + SMOOTH * (class_words + 1))
    frequent = {bytes(row["word"]): float(np.log10(row["c"] + SMOOTH)) for row in _most_frequent(counts, head).collect()}
    end_part = float(np.log10(ends + SMOOTH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((doc_id, held, digest, split_words(value.as_py())) for batch in batches for doc_id, held, digest, value in
                 zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3)))
        for block in _blocks(found, lambda item: len(item[3])):
            symbols = [classes_of(words) for *_, words in block]
            logs = forward(symbols, model)
            ids, helds, digests, names, times, parts, extras, lengths = [], [], [], [], [], [], [], []
            for (doc_id, held, digest, words), classes, log in zip(block, symbols, logs):
                part, known, rare = end_part, int(ends > 0), []
                for word, n in Counter(words).items():
                    value = frequent.get(word)
                    if value is None:
                        rare.append((word, n))
                    else:
                        part += n * value
                        known += n
                own = 1 + len(rare)
                ids += [doc_id.as_py()] * own
                helds += [held.as_py()] * own
                digests += [digest.as_py()] * own
                names += [None, *[word for word, _ in rare]]
                times += [known, *[n for _, n in rare]]
                parts += [part] + [None] * len(rare)
                extras += [float(log - within[classes[:-1]].sum()) - end_part] + [None] * len(rare)
                lengths += [len(classes)] + [None] * len(rare)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, key_type), pa.array(helds, pa.bool_()), pa.array(digests, pa.int64()), pa.array(names, pa.binary()),
                 pa.array(times, pa.int64()), pa.array(parts, pa.float64()), pa.array(extras, pa.float64()), pa.array(lengths, pa.int64())],
                ["doc_id", "held_out", "digest", "word", "n", "part", "extra", "length"])

    kind, key_type = dict(rows.dtypes)["doc_id"], to_arrow_type(rows.schema["doc_id"].dataType)
    looked = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, digest long, word binary, n long, part double, extra double, length long")
    looked = scratch.keep(looked)
    whole = looked.where("word is null").withColumnRenamed("n", "known").drop("word")
    rare = looked.where("word is not null").select("doc_id", "held_out", "digest", "word", "n").join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    parts = rare.select("doc_id", "held_out", "digest", F.when(c > 0, F.col("n")).otherwise(0).alias("known"),
                        (F.col("n") * F.log10(c + SMOOTH)).alias("part"), F.lit(None).cast("double").alias("extra"),
                        F.lit(None).cast("long").alias("length"))
    # Equal rows put equal sums into one group; it is divided among them and given out once for each.
    sums = parts.unionByName(whole).groupBy("doc_id", "held_out", "digest").agg(
        F.count("length").alias("copies"), F.max("length").alias("n_tokens"), F.max("extra").alias("extra"),
        F.sum("part").alias("part"), F.sum("known").alias("known"))
    part = F.col("part") / F.col("copies")
    return sums.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "doc_id", "held_out", "n_tokens", (F.col("known") / F.col("copies")).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (part - F.col("n_tokens") * F.lit(float(np.log10(tokens + SMOOTH * (distinct + 1))))).alias("base_score"),
        (part + F.col("extra")).alias("score"))
