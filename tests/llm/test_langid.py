from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import make
from tidewire.llm import langid
from tidewire.llm.common import table

ENGLISH = "the quick brown fox jumps over the lazy dog and runs with the others through the thick wood"
GERMAN = "der schnelle braune fuchs springt über den faulen hund und läuft mit den anderen durch den dichten wald"


def test_counts_do_not_depend_on_pieces(monkeypatch):
    text = (ENGLISH + ", Ärger. 12x\n" + GERMAN).encode() * 9
    whole = langid.subword_counts(text)
    for size in (50, 64, 333):
        monkeypatch.setattr(langid, "_PIECE", size)
        assert (langid.subword_counts(text) == whole).all()


def test_runs_stay_inside_words():
    """ " ab " has a, b, _a, ab, b_, _ab, ab_, _ab_; blanks and signs between words do not matter."""
    assert langid.subword_counts(b"ab").sum() == 8
    assert (langid.subword_counts(b"Ab, 12 cd") == langid.subword_counts(b"ab cd")).all()
    assert langid.subword_counts(b"").sum() == 0


def plain_counts(text):
    """Subwords of 1 to 4 bytes of each word between blanks, hashed one by one."""
    counts = Counter()
    folded = "".join(c.lower() if c.isalpha() else " " if ord(c) < 128 else c for c in text)
    for word in folded.encode().split(b" "):
        marked = b" " + word + b" "
        for size in (1, 2, 3, 4):
            for at in range(len(marked) - size + 1):
                run = marked[at:at + size]
                if not word or run == b" ":
                    continue
                value = 0
                for byte in run:
                    value = (value * 0x01000193 ^ byte) % 2**32
                counts[((value + size) * 0x9E3779B1 % 2**32) >> (32 - langid.BITS)] += 1
    return counts


def test_predictions_agree_with_plain_python(spark):
    """Subwords, mean of their scores and softmax, one number at a time, for a model of random scores."""
    rng = np.random.default_rng(8)
    model = langid.Classifier(["de", "en", "fr"], rng.normal(0, 3, (langid.BUCKETS, 3)), rng.normal(0, 1, 3), 0.7, 0.5)
    letters = list("abcxyz,. 1-\n") + ["é", "中", "ß", "💡"]
    texts = ["".join(rng.choice(letters, n)) for n in (1, 2, 3, 5, 9, 40, 300) for _ in range(8)] + [ENGLISH, GERMAN]
    found = {r.doc_id: r for r in langid.predicted(make(spark, [(i, t, None, "s") for i, t in enumerate(texts)]), model).collect()}
    for i, text in enumerate(texts):
        if not any(c.isalpha() for c in text):
            assert found[i].lang_pred == "und" and found[i].score == 0
            continue
        counts = plain_counts(text)
        logits = [sum(n * model.scores[b, j] for b, n in counts.items()) / sum(counts.values()) + model.bias[j] for j in range(3)]
        weights = [np.exp(x / 0.7) for x in logits]
        best = int(np.argmax(weights))
        assert found[i].lang_pred == model.languages[best] and abs(found[i].score - weights[best] / sum(weights)) < 1e-9
        assert found[i].accepted == (weights[best] / sum(weights) >= 0.5)


def test_letters():
    assert [langid.has_letter(t) for t in (None, "", "12 ² Ⅷ ½ _%", "ª", "中", "e\u0301")] == [False, False, False, True, True, True]


def test_learns_and_rejects(spark):
    words = {"en": ENGLISH.split(), "de": GERMAN.split()}
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(words[g], 12)), g, "s") for i, g in enumerate(["en", "de"] * 150)]
    docs = make(spark, rows + [(1000, None, "en", "s"), (1001, "12 %", "de", "s"), (1002, "the dog", None, "s"), (None, "der hund", None, None)])
    model = langid.trained(docs)
    found = {r.doc_id: r for r in langid.predicted(docs, model).collect()}
    held = [(found[i].lang_pred, g) for i, _, g, _ in rows if found[i].held_out]
    assert held and np.mean([a == b for a, b in held]) > 0.95
    assert found[1000].lang_pred == found[1001].lang_pred == "und" and found[1000].score == 0 and not found[1001].accepted
    assert found[1002].lang_pred == "en" and found[None].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in found.values())


def test_sample_is_bounded(spark):
    docs = make(spark, [(i, f"word{i} of", "en", "s") for i in range(400)])
    assert langid.trained(docs, sample=20) is not None


def test_quotas():
    assert langid.quotas({"en": 1000, "de": 1000, "it": 10}, 210) == {"it": 10, "de": 100, "en": 100}
    assert langid.quotas({"en": 3, "de": 2}, 2000) == {"de": 2, "en": 3}
    assert sum(langid.quotas({f"l{i}": 7 + i for i in range(9)}, 90).values()) == 90


def test_small_languages_get_their_part_of_the_sample(spark, monkeypatch):
    """Four big languages and one of 0.2 % of the rows, which has more than its quota."""
    sizes = {"de": 20_000, "en": 60_000, "es": 20_000, "fr": 20_000, "it": 240}
    lang = F.element_at(F.array(*[F.lit(name) for name in sizes for _ in range(sizes[name] // 240)]), (F.col("id") % 500 + 1).cast("int"))
    monkeypatch.setattr(langid, "fit", lambda counts, labels: labels)
    docs = spark.range(500 * 240).select(F.col("id").alias("doc_id"), F.concat(F.lit("a word "), "id").alias("text"), lang.alias("lang"))
    drawn = Counter(langid.trained(docs, sample=500))
    assert drawn == dict.fromkeys(sizes, 100)


def test_nothing_to_learn_from(odd, none):
    assert langid.trained(none) is None
    assert {r.lang_pred for r in langid.predicted(odd, None).collect()} == {"und"} and langid.predicted(none, None).count() == 0
    rows = langid.predicted(odd, langid.trained(odd)).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows} <= {"en", "fr", "und"}


def test_held_out_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = langid.predicted(docs, langid.trained(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.9
