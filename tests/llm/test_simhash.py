import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import PLAIN, make
from tidewire.llm import simhash
from tidewire.llm.components import components
from tidewire.session import Scratch


def plain(text, k=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, bits):
    """Smallest index of each value's component, by comparing all pairs."""
    group = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group


def test_fingerprints():
    for text in (None, "", " \n", "one", "One two", PLAIN, "É È a b c", "a b c a b c a b c", "x\x1cy z w"):
        assert simhash.fingerprint(None if text is None else text.encode(), 3) == plain(text)


def test_every_word_has_one_near_codeword():
    table = simhash.nearest_codeword()
    assert np.bincount(table, minlength=4096).tolist() == [2048] * 4096


def test_near_words_share_a_key():
    rng = random.Random(1)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.choice((1, 2))):
            b ^= 1 << bit
        keys = [set(simhash.golay_keys(np.array([v], np.uint64).view(np.int64))[1].tolist()) for v in (a, b)]
        assert keys[0] & keys[1]


@pytest.mark.parametrize("bits", [0, 1, 2])
@pytest.mark.parametrize("bucket", [simhash.BUCKET, 2])
def test_components_agree_with_all_pairs(spark, monkeypatch, bits, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(bits)
    values = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(160):
        value = rng.choice(values)
        for bit in rng.sample(range(64), rng.choice((0, 1, 1, 2, 3))):
            value ^= 1 << bit
        values.append(value)
    fps = spark.createDataFrame([(i, simhash._signed(v)) for i, v in enumerate(values)], "doc_id long, fp long")
    scratch = Scratch(spark, "test")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    found = {r.node: r.root for r in components(simhash.links(classes, bits, scratch), scratch).collect()}
    mine = [found.get(simhash._signed(v), simhash._signed(v)) for v in values]
    want = roots(values, bits)
    assert [mine.index(m) for m in mine] == [want.index(w) for w in want]


def test_too_many_bits(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "fp long, low long"), 3, Scratch(spark, "test"))


def test_long_chain_ends_in_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(5, 5), (None, 1)], "u long, v long")
    assert {r.root for r in components(links, Scratch(spark, "test")).collect()} == {0}


class Counted(Scratch):
    tables = 0

    def keep(self, df):
        self.tables += 1
        return super().keep(df)


@pytest.mark.parametrize("order", ["random", "zigzag", "falling"])
def test_chains_in_any_order_end_after_few_rounds(spark, order):
    """A chain whose labels do not rise along it, besides a star and a pair; 4 tables and a few jumps a round."""
    nodes = list(range(1, 401))
    if order == "random":
        random.Random(1).shuffle(nodes)
    elif order == "zigzag":
        nodes = [n for pair in zip(nodes[:200], nodes[:199:-1]) for n in pair]
    else:
        nodes = nodes[::-1]
    pairs = list(zip(nodes, nodes[1:])) + [(1000, 1000 + i) for i in range(50)] + [(2001, 2000)]
    scratch = Counted(spark, "test")
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long"), scratch).collect()}
    assert found == {**{n: 1 for n in nodes}, **{1000 + i: 1000 for i in range(50)}, 2000: 2000, 2001: 2000}
    assert scratch.tables <= 60


def test_odd_rows(spark, odd, none):
    rows = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert {rows[k] for k in rows if k[0] in (1, 2)} == {1} and {rows[k] for k in rows if k[0] in (3, 4, 5)} == {3}
    assert simhash.near_duplicates(none).count() == 0
    alone = make(spark, [(None, "only one here", "en", "s")])
    assert simhash.near_duplicates(alone).first().component_id is None


def test_one_of_each_with_unlike_texts_under_one_id(spark):
    """Id 5 leads one component with one text and has another text in the component that id 1 leads."""
    first, second = PLAIN, " ".join(f"another{i} thing{i}" for i in range(30))
    texts = [(1, second), (5, first), (5, second), (5, first), (9, first)]
    for rows in (texts, texts[::-1]):
        kept = simhash.one_of_each(make(spark, [(i, t, "en", "s") for i, t in rows]).repartition(4))
        assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, second), (5, first)]
    kept = simhash.one_of_each(make(spark, [(i, t, "en", "s") for i, t in texts[1:]]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(5, first), (5, second)]


def test_one_of_each(odd, none):
    kept = simhash.one_of_each(odd)
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, 1, 3, 6, 7] and kept.columns == odd.columns
    assert simhash.one_of_each(none).count() == 0
