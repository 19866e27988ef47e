from collections import defaultdict

from tests.llm.conftest import make
from tidewire.llm import mixing
from tidewire.session import Scratch


def plain(cells, targets, share, tolerance, patience):
    """The same fitting over a dictionary of cells."""
    total = sum(cells.values())
    f = dict.fromkeys(cells, share)
    goals = []
    for at, target in enumerate(targets.values()):
        there = defaultdict(float)
        for cell, tokens in cells.items():
            there[cell[at]] += tokens
        weight = {v: dict(target.shares).get(v[1:], None) for v in there}
        weight = {v: w * total if w is not None else there[v] ** target.power for v, w in weight.items()}
        goals.append({v: w / sum(weight.values()) * total * share for v, w in weight.items()})
    best, waited = float("inf"), 0
    while waited < patience:
        moved = 0.0
        for at, goal in enumerate(goals):
            given, open_ = defaultdict(float), defaultdict(bool)
            for cell, tokens in cells.items():
                given[cell[at]] += tokens * min(f[cell], 1)
                open_[cell[at]] |= f[cell] < 1
            step = {v: goal[v] / given[v] if open_[v] or goal[v] < given[v] else 1.0 for v in goal}
            for cell in cells:
                f[cell] *= step[cell[at]]
            moved = max([moved, *(abs(s - 1) for s in step.values())])
        if moved <= tolerance:
            break
        waited = 0 if moved < 0.99 * best else waited + 1
        best = min(best, moved)
    return {cell: min(v, 1) for cell, v in f.items()}, moved


CELLS = {("=a", "=en", "=x"): 900, ("=a", "=de", "=x"): 50, ("=b", "=en", "=y"): 300, ("=b", "null", "=x"): 20, ("=c", "=de", "=y"): 5, ("null", "=en", "=y"): 70}


def test_fit_agrees_with_plain_python(spark):
    targets = {"source": mixing.Target(0.5), "lang": mixing.Target(0.8, (("de", 0.1),)), "topic": mixing.Target()}
    rows = spark.createDataFrame([(*c, n) for c, n in CELLS.items()], "source string, lang string, topic string, tokens long")
    found = mixing.raked(rows, Scratch(spark, "test"), targets, 0.4)
    want, gap = plain(CELLS, targets, 0.4, mixing.TOLERANCE, mixing.PATIENCE)
    for r in found.collect():
        assert abs(r.p - want[r.source, r.lang, r.topic]) < 1e-9 and abs(r.gap - gap) < 1e-9


def test_goals_that_contradict_each_other_are_told(spark):
    """Two sources of one language each, with other shares asked of the languages than of the sources."""
    cells = {("=a", "=en", "=x"): 500, ("=b", "=de", "=x"): 500}
    targets = {"source": mixing.Target(shares=(("a", 0.8), ("b", 0.2))), "lang": mixing.Target(shares=(("en", 0.3), ("de", 0.7))), "topic": mixing.Target()}
    rows = spark.createDataFrame([(*c, n) for c, n in cells.items()], "source string, lang string, topic string, tokens long")
    want, gap = plain(cells, targets, 0.5, mixing.TOLERANCE, mixing.PATIENCE)
    found = mixing.raked(rows, Scratch(spark, "test"), targets, 0.5).collect()
    assert gap > 0.5 and all(abs(r.gap - gap) < 1e-9 and abs(r.p - want[r.source, r.lang, r.topic]) < 1e-9 for r in found)


def test_margins_are_met_and_draws_repeat(spark):
    docs = make(spark, [(i, "of the word " * (1 + i % 7), ("en", "de")[i % 3 == 0], f"s{i % 4 * (i % 2)}") for i in range(600)])
    rows = mixing.weighed(docs).toPandas()
    total = rows.n_tokens.sum()
    assert rows.gap.max() <= mixing.TOLERANCE
    assert abs((rows.n_tokens * rows.p).sum() - total / 2) < 0.01 * total
    there = rows.groupby("source").n_tokens.sum()
    goal = there ** 0.7 / (there ** 0.7).sum() * total / 2
    got = (rows.n_tokens * rows.p).groupby(rows.source).sum()
    assert ((got - goal).abs() < 0.01 * goal).all()
    kept = {r.doc_id for r in mixing.sampled(docs).collect()}
    assert kept == set(rows.doc_id[rows.kept])
    assert mixing.sampled(docs).columns == docs.columns


def test_topics(spark):
    texts = ["under the MIT License", "call +1 (359) 555-3724", "def (x) => y", "a | b | c | d |", "a | b", "just prose", None, ""]
    rows = make(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = [r.topic for r in mixing.weighed(rows).orderBy("doc_id").collect()]
    assert got == ["legal", "contact", "code", "data", "prose", "prose", "prose", "prose"]


def test_odd_rows(odd, none):
    rows = mixing.weighed(odd, share=1.0).collect()
    assert len(rows) == odd.count() and all(0 < r.p <= 1 for r in rows)
    assert mixing.weighed(none).count() == 0 and mixing.sampled(none).count() == 0
    assert mixing.sampled(odd, share=1.0, targets=dict.fromkeys(mixing.MARGINS, mixing.Target())).count() == odd.count()
