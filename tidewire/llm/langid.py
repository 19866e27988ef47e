"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent.

Subwords are runs of 1 to 4 bytes inside a word, its edges marked. As the softmax is linear, the trained embeddings and weights
fold into one row of language scores per hash bucket, and a text's score is the mean over its subwords.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewire.llm.common import id_bucket

BITS, SIZES, DIMENSIONS = 13, (1, 2, 3, 4), 16
BUCKETS = 1 << BITS
SAMPLE, EPOCHS, STEPS, RATE, BATCH, SEED = 2000, 10, 400, 40.0, 32, 5
REJECT = 0.02
UNKNOWN = "und"
_PIECE = 1 << 20

# Bytes that end a word: everything of ASCII but letters. Letters are lowered; bytes of longer characters stay.
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(128)) + bytes(range(128, 256))


def subword_counts(text: bytes) -> np.ndarray:
    """How often each hash bucket occurs among the subwords of a whole UTF-8 text, counted a piece at a time."""
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text), _PIECE):
        # Pieces overlap by the longest run less one, so each run is counted by the piece that holds its first byte.
        piece = np.frombuffer((b" " if at == 0 else b"") + text[at:at + _PIECE + max(SIZES) - 1].translate(_FOLD)
                              + (b" " if at + _PIECE >= len(text) else b""), np.uint8).astype(np.uint32)
        starts = len(piece) if at + _PIECE >= len(text) else _PIECE + (at == 0)
        blank, value = piece == 32, np.zeros(len(piece), np.uint32)
        for size in range(1, max(SIZES) + 1):
            n = len(piece) - size + 1
            if n <= 0:
                break
            value = value[:n] * np.uint32(0x01000193) ^ piece[size - 1:]
            if size in SIZES:
                # A blank may only be the first or the last byte of a run, and not all of it.
                keep = ~blank[:n] if size == 1 else ~(blank[:n] & blank[1:n + 1]) if size == 2 else np.ones(n, bool)
                for k in range(1, size - 1):
                    keep &= ~blank[k:k + n]
                hashed = (value + np.uint32(size)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
                found = hashed[:min(n, starts)][keep[:min(n, starts)]]
                counts += np.bincount(found, minlength=BUCKETS)
    return counts


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


@dataclass
class Classifier:
    languages: list[str]
    scores: np.ndarray  # a row of language scores for each bucket
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        share = counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1)
        logits = (share @ self.scores + self.bias) / self.temperature
        logits = np.exp(logits - logits.max(axis=-1, keepdims=True))
        return logits / logits.sum(axis=-1, keepdims=True)


def fit(counts: np.ndarray, labels: list[str], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED, reject: float = REJECT) -> Classifier:
    """Embeddings and softmax by SGD on four fifths of the sample; the rest sets the temperature that makes the scores
    calibrated (least log loss) and the score below which a prediction is rejected (``reject`` of right ones are lost)."""
    languages = sorted(set(labels))
    truth = np.searchsorted(languages, labels)
    x = (counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held = order[:len(x) // 5] if len(x) >= 10 * len(languages) else order[:0]
    used = order[len(held):]
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    by_epoch = -(-len(used) // BATCH)
    epochs = max(epochs, -(-STEPS // by_epoch))  # a small sample is passed over more often
    steps, step = epochs * by_epoch, 0
    for _ in range(epochs):
        rng.shuffle(used)
        for at in range(0, len(used), BATCH):
            rows = used[at:at + BATCH]
            batch = x[rows]
            hidden = batch @ embed
            logits = hidden @ weights + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), truth[rows]] -= 1
            p /= len(rows)
            pace = np.float32(rate * (1 - step / steps))
            step += 1
            change = batch.T @ (p @ weights.T)
            weights -= np.float32(0.05) * pace * (hidden.T @ p)
            bias -= np.float32(0.05) * pace * p.sum(axis=0)
            embed -= pace * change
    model = Classifier(languages, (embed @ weights).astype(np.float64), bias.astype(np.float64))
    if len(held):
        logits = x[held] @ model.scores + model.bias
        # As if two more rows had been labelled at random: the temperature stays finite when every held row is right.
        best, noise = None, 2 / (len(held) + 2)
        for temperature in np.geomspace(0.05, 20, 60):
            z = logits / temperature
            z = z - z.max(axis=1, keepdims=True)
            told = (1 - noise) * z[np.arange(len(held)), truth[held]] + noise * z.mean(axis=1)
            loss = float((np.log(np.exp(z).sum(axis=1)) - told).mean())
            if best is None or loss < best[0]:
                best = (loss, float(temperature))
        model.temperature = best[1]
        p = model.probabilities(counts[held])
        right = p.argmax(axis=1) == truth[held]
        if right.any():
            model.threshold = float(np.quantile(p.max(axis=1)[right], reject))
    return model


def _counted(rows: DataFrame) -> DataFrame:
    """(lang, places, amounts): sparse subword counts of each text, at most ``BUCKETS`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [subword_counts(text.as_py()) for text in batch.column(1)]
            places = [np.flatnonzero(c) for c in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([p.astype(np.int32) for p in places], pa.list_(pa.int32())),
                 pa.array([c[p] for c, p in zip(found, places)], pa.list_(pa.int64()))], ["lang", "places", "amounts"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, places array<int>, amounts array<bigint>")


def quotas(sizes: dict[str, int], sample: int) -> dict[str, int]:
    """How many rows each language gives to a sample: equal parts, and what small languages leave is dealt among the others."""
    given, left = {}, sample
    for at, (name, n) in enumerate(sorted(sizes.items(), key=lambda item: (item[1], item[0]))):
        given[name] = min(n, left // (len(sizes) - at))
        left -= given[name]
    return given


def trained(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, sample: int = SAMPLE) -> Classifier | None:
    """A classifier of at most ``sample`` labelled texts, drawn by a hash of their ids: the same number of each language, and of
    the larger ones what the small ones have too few rows for.

    Rows with a null language or text and those of fold 0 are never used. None if no row is left.
    """
    usable = docs.select(docs[key].alias("id"), docs[text].cast("binary").alias("text"), docs[lang].cast("string").alias("lang")).where(
        docs[text].isNotNull() & docs[lang].isNotNull() & (id_bucket(docs[key], folds) != 0))
    sizes = {row["lang"]: row["count"] for row in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect()}
    if not sizes:
        return None
    quota = quotas(sizes, sample)
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.col("id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    # A little more than each language's quota by rate, then exactly its smallest draws.
    rate = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, 1.5 * quota[name] / n + 20 / n))])
    most = F.create_map(*[F.lit(x) for name, n in quota.items() for x in (name, n)])
    drawn = usable.where(rate[F.col("lang")] > draw).withColumn("draw", draw)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id", "text"))
    rows = _counted(drawn.withColumn("place", place).where(F.col("place") <= most[F.col("lang")])).collect()
    counts = np.zeros((len(rows), BUCKETS), np.float32)
    for i, row in enumerate(rows):
        counts[i, row["places"]] = row["amounts"]
    return fit(counts, [row["lang"] for row in rows])


def predicted(docs: DataFrame, model: Classifier | None, key: str = "doc_id", text: str = "text", folds: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) of every whole text.

    ``score`` is the calibrated probability of the language named; ``accepted`` is false below the threshold. Null texts, texts
    without a letter and all texts without a model are ``und`` with score 0, not accepted. Rows are predicted one by one, so repeated
    rows agree; an empty table gives no rows. A null id counts as an empty one and is held out.
    """
    rows = docs.select(docs[key].alias("doc_id"), (id_bucket(docs[key], folds) == 0).alias("held_out"), docs[text].alias("text"))
    kind, key_type = dict(rows.dtypes)["doc_id"], to_arrow_type(rows.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, sure = [], [], []
            for value in batch.column(2):
                body = value.as_py()
                if model is None or not has_letter(body):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    sure.append(False)
                    continue
                p = model.probabilities(subword_counts(body.encode()))
                best = int(p.argmax())
                names.append(model.languages[best])
                scores.append(float(p[best]))
                sure.append(bool(p[best] >= model.threshold))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(key_type), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(sure, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean")
