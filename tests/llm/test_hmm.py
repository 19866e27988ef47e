import math
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from tests.llm.conftest import make
from tidewire.llm import hmm


def model(states=2, seed=1):
    rng = np.random.default_rng(seed)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    emit = np.full((states, hmm.CLASSES + 1), 1e-9)
    emit[:, :5] = rng.uniform(0.1, 1, (states, 5))
    return hmm.Model(norm(rng.uniform(size=states)), norm(rng.uniform(size=(states, states))), norm(emit))


def paths(m, symbols):
    """Probability of every path of states, one by one."""
    for path in product(range(len(m.start)), repeat=len(symbols)):
        p = m.start[path[0]] * m.emit[path[0], symbols[0]]
        for a, b, s in zip(path, path[1:], symbols[1:]):
            p *= m.move[a, b] * m.emit[b, s]
        yield path, p


SEQUENCES = [np.array(s, np.uint16) for s in ([0, 1, 2, 3, 4], [4], [2, 2, 2], [1, 0, 1], [3, 4])]


def test_forward_sums_all_paths():
    m = model()
    got = hmm.forward(SEQUENCES, m)
    want = [math.log10(sum(p for _, p in paths(m, s))) for s in SEQUENCES]
    assert np.allclose(got, want)


def test_expected_counts_agree_with_all_paths():
    m, size = model(3, 2), 3 + 9 + 3 * (hmm.CLASSES + 1)
    want = np.zeros(size)
    for s in SEQUENCES:
        whole = sum(p for _, p in paths(m, s))
        for path, p in paths(m, s):
            want[path[0]] += p / whole
            for a, b in zip(path, path[1:]):
                want[3 + 3 * a + b] += p / whole
            for a, x in zip(path, s):
                want[12 + a * (hmm.CLASSES + 1) + x] += p / whole
    assert np.allclose(hmm.expected(SEQUENCES, m), want)


def test_rounds_raise_the_likelihood():
    m = model(3, 3)
    before = hmm.forward(SEQUENCES, m).sum()
    for _ in range(4):
        m = hmm.Model.of_counts(1e6 * hmm.expected(SEQUENCES, m), 3)
    assert hmm.forward(SEQUENCES, m).sum() > before


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def check(rows, found):
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    counts = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((-1 if i is None else i, held(i), len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), total,
                   round(sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in tokens(t)), 6)) for i, t in rows)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found)
    assert got == want


def test_base_score_agrees_with_plain_python(spark, odd, none):
    rows = [(i, f"The cat{i % 9} sat É\n on mat{i * 7 % 31} the the" + " rare" * (i % 3)) for i in range(60)] + [(7, "again"), (7, "again")]
    for head in (3, hmm.HEAD):
        found = hmm.scored(make(spark, [(i, t, "en", "s") for i, t in rows]), head=head, rounds=1).collect()
        check(rows, found)
    check([(r.doc_id, r.text) for r in odd.collect()], hmm.scored(odd, rounds=1).collect())
    assert hmm.scored(none, rounds=1).count() == 0
    only_held = make(spark, [(None, "nothing to learn from", "en", "s")])
    assert hmm.scored(only_held, rounds=1).first().n_known == 0


def test_score_is_a_distribution_over_words(spark):
    """Over all texts of one known or unknown word the probabilities add up to those of one-word texts."""
    words = ["red", "green", "blue", "red red", "green red blue"]
    docs = make(spark, [(i, w, "en", "s") for i, w in enumerate(words * 4, 1)])
    rows = {r.n_tokens: r.score for r in hmm.scored(docs, rounds=3).collect()}
    assert rows[2] > rows[4] and all(s < 0 for s in rows.values())


def test_long_sequences_train_in_parts(spark, monkeypatch):
    monkeypatch.setattr(hmm, "TRAIN_LENGTH", 4)
    monkeypatch.setattr(hmm, "BLOCK_TOKENS", 5)
    rows = [(i, "a b c d e f g h i j") for i in range(1, 12)]
    check(rows, hmm.scored(make(spark, [(i, t, "en", "s") for i, t in rows]), rounds=2).collect())


@pytest.mark.parametrize("piece", [1, 7, 64, 1000])
def test_long_sequences_train_as_one(piece):
    """Forward and backward vectors go over the cuts, so the pieces add up to the counts of the whole sequence."""
    rng = np.random.default_rng(5)
    symbols = np.append(rng.integers(0, 40, 200), hmm.END).astype(np.uint16)
    model = hmm.Model.first(np.bincount(symbols, minlength=hmm.CLASSES + 1).astype(float), 3, 1)
    assert np.allclose(hmm.expected_long(symbols, model, piece), hmm.expected([symbols], model))


def test_very_long_words_are_joined(spark):
    """A word too long to travel to the tasks scores as it would otherwise."""
    word = "w" * 500
    docs = make(spark, [(i, f"{word} b c {word}", "en", "a") for i in range(30)])
    counts = spark.createDataFrame([(word.encode(), 60), (b"b", 30)], "word binary, c long")
    assert [bytes(r.word) for r in hmm._most_frequent(counts, 10).collect()] == [b"b"]
    assert {(r.n_tokens, r.n_known) for r in hmm.scored(docs).collect()} == {(5, 5)}


def test_blocks_hold_sequences_of_like_length():
    """A block takes as many steps in time as its longest sequence has; every sequence is in one block."""
    sequences = [np.zeros(n, np.uint16) for n in [20_000, *[200] * 5000] * 2]
    blocks = list(hmm._alike(iter(sequences)))
    assert sorted(len(s) for block in blocks for s in block) == sorted(map(len, sequences))
    assert sum(max(map(len, block)) for block in blocks) < sum(max(map(len, block)) for block in hmm._blocks(sequences, len))
