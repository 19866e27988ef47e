import pytest

import corpus_pipeline
from tests.llm.conftest import make
from tests.llm.test_quality import plain as counts
from tests.llm.test_simhash import plain as fingerprint
from tests.llm.test_simhash import roots
from tidewire.llm import quality, queries
from tidewire.llm.common import table
from tests.support.compare import difference, duck, duck_rows, spark_rows


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """What each stage gives, written and read again."""
    docs, out = table(spark, sf_dir, "documents"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(n))
        before = docs
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((before, docs))
    return out


def test_columns_stay(stages):
    assert all(after.columns == list(corpus_pipeline.COLUMNS) for _, after in stages[:-1])


def test_quality(stages):
    before, after = stages[0]
    kept = {r.doc_id for r in after.collect()}
    for r in before.collect():
        words, _, _, _, repeated = counts(r.text)
        if words < 10 or 100 * repeated > 20 * words:
            assert r.doc_id not in kept
    assert len(kept) > 0.7 * before.count()


def test_quality_keeps_clean_documents(spark, sf_dir):
    """Function words count beside marks and in any case, not in short texts, and not in languages that have none of them."""
    rare = "Üau heit ie enie, den, chö enkeitstau enchentz schungen des."
    marked = " ".join(f"wort{i} und, (Die stein{i}." for i in range(20))
    russian = " ".join(f"слово{i} дом{i} река{i}" for i in range(20))
    plain = " ".join(f"lorem{i} ipsum{i}" for i in range(40))
    rows = make(spark, [(1, rare, "de", "s"), (2, marked, "de", "s"), (3, russian, "ru", "s"), (4, plain, "en-US", "s"), (5, plain, None, "s"),
                        (6, plain, "fi", "s"), (7, plain, "est", "s")])
    assert sorted(r.doc_id for r in corpus_pipeline.quality_rules(spark, rows, sf_dir).collect()) == [1, 2, 3, 5, 6, 7]


def test_quality_agrees_with_labels(spark, sf_dir):
    """No document labelled good goes by the rule of function words, and no junk comes back for it."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    kept = corpus_pipeline.quality_rules(spark, docs, sf_dir).select("doc_id")
    others = tuple(rule for rule in quality.RULES if rule.metric != "stop_word_ratio")
    clean = docs.where(quality.passes(docs["text"], others)).join(labels.where("quality = 1"), "doc_id", "left_semi")
    assert clean.join(kept, "doc_id", "left_anti").count() == 0
    junk = docs.where(~quality.passes(docs["text"])).join(labels.where("quality = 0"), "doc_id", "left_semi")
    assert junk.join(kept, "doc_id", "left_semi").count() == 0


def test_dedup(stages):
    before, after = stages[1]
    rows = sorted((r.doc_id, fingerprint(r.text)) for r in before.collect())
    group = roots([f for _, f in rows], 2)
    assert {r.doc_id for r in after.collect()} == {rows[g][0] for g in group}


def test_secrets_and_mixing(stages):
    before, after = stages[2]
    old = {r.doc_id: r for r in before.collect()}
    changed = [r for r in after.collect() if r.text != old[r.doc_id].text]
    assert all("[SECRET]" in r.text and r.n_chars == len(r.text) for r in changed) and after.count() == before.count()
    before, after = stages[3]
    assert 0.3 < after.count() / before.count() < 0.7 and after.join(before, list(corpus_pipeline.COLUMNS), "left_anti").count() == 0


def test_encoding(stages):
    before, after = stages[4]
    assert after.count() == before.count() and after.where("n_tokens * 4 <> length(ids)").count() == 0


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    rows = sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert rows == sorted((r.doc_id, r.n_tokens) for r in stages[-1][1].collect())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_agree_with_sql(spark, sf_dir, name):
    got = spark_rows(queries.QUERIES[name](spark, sf_dir))
    assert difference(got, duck_rows(duck(sf_dir), queries.SQL[name])) is None
