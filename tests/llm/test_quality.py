import re
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.conftest import LONG, PLAIN, make
from tidewire.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    hit = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(5)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def test_counts_agree_with_plain_python(spark):
    texts = [PLAIN, LONG, "", None, " \n", "a b c d e a b c d e", "a b c d e f a b c d e f a", "x\nx\n\ny\nx ", "##|<é> 💡💡 w", "a a a a a a", "w " * 4]
    rows = quality.judged(make(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    got = [tuple(r["quality"][n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in rows]
    assert got == [plain(t) for t in texts]


def test_odd_rows_and_names(odd, none):
    rows = quality.judged(odd)
    assert rows.count() == odd.count() and rows.columns.count("kept") == 1
    assert [r.doc_id for r in rows.where("kept").orderBy("doc_id").collect()] == [None, 1, 1, 2]
    assert quality.judged(none).count() == 0


def test_filter_form_agrees(odd):
    flags = quality.judged(odd).withColumn("again", quality.passes(F.col("text")))
    assert flags.where("kept <> again").count() == 0


def test_rules(spark):
    texts = {"symbols": "of%%% the&&& and*** " * 10, "numbers": "of 1 2 3 4 5 6 7 8 9 10 11 12", "no stop words": "lorem ipsum dolor sit amet " * 1 + "consectetur adipiscing elit sed eiusmod tempor"}
    rows = quality.judged(make(spark, [(i, t, "en", "s") for i, t in enumerate(texts.values())])).orderBy("doc_id").collect()
    assert "symbol_ratio" in rows[0].broken and "letter_word_ratio" in rows[1].broken and rows[2].broken == ["stop_word_ratio"]
    assert quality.judged(make(spark, [(1, texts["numbers"], "en", "s")]), rules=(quality.Rule("n_words", low=5),)).first().kept


def test_query_keeps_clean_documents(spark, sf_dir):
    """Function words count whatever their case and the marks beside them, so no document that is labelled good goes for want of them."""
    from tidewire.llm.queries import QUERIES
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(labels, "doc_id", "left_semi")
    broken = quality.judged(docs, rules=quality.CORPUS_RULES, lang="lang").select("doc_id", "base_failed", "broken")
    assert broken.where("array_contains(broken, 'function_word_ratio')").count() == 0
    kept = QUERIES["op8_quality_rules"](spark, sf_dir).join(broken, "doc_id", "left_semi").distinct()
    assert kept.where("not kept and not base_failed").count() == broken.where("not base_failed and size(broken) > 0").select("doc_id").distinct().count()


def test_rules_for_some_languages(spark):
    words = " ".join(f"слово{i}" for i in range(60))
    rows = [(1, words, "ru", "s"), (2, words, None, "s"), (3, words, "en-GB", "s"), (4, words[:200], "en", "s"), (5, words + " (The, THE. 'den'", "de", "s")]
    got = {r.doc_id: r.broken for r in quality.judged(make(spark, rows), rules=quality.CORPUS_RULES, lang="lang").collect()}
    assert got == {1: [], 2: [], 3: ["function_word_ratio"], 4: [], 5: []}
