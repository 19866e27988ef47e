"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import let, widened, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Frequent function words of the languages at hand.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this",
    "to", "was", "with", "not", "have", "has", "he", "she", "they", "you", "we",
    "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "im", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "au", "aux", "dans", "de", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "ou", "par", "pas", "pour", "qui",
    "que", "sur", "un", "une",
    "al", "como", "con", "del", "el", "es", "los", "las", "lo", "no", "por", "se", "su", "una", "y",
)

# Their languages, and what may stand before and after a word.
STOP_LANGUAGES = ("en", "de", "fr", "es")
MARKS = ".,;:!?¿¡()[]{}<>\"'`´«»‹›„“”‚‘’…*_-–—/"

STOP_FORMS = sorted({form for word in STOP_WORDS for form in (word, word.capitalize())})


@dataclass(frozen=True)
class Rule:
    """Keep a document if ``low <= metric <= high``; an open side is None.

    The rule is for documents of ``least`` words and, if ``languages`` are named and the documents' are known, for those alone.
    """

    metric: str
    low: float | None = None
    high: float | None = None
    least: int = 0
    languages: tuple[str, ...] = ()


# Measured on words of at least the length base rule, so that no ratio divides by zero.
RULES = (
    Rule("n_words", low=10),
    Rule("mean_word_chars", low=2.0, high=20.0),
    Rule("symbol_ratio", high=0.6),
    Rule("letter_word_ratio", low=0.6),
    Rule("stop_word_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.4),
    Rule("repeat_word_ratio", high=0.2),
)


# For a corpus: function words count whatever their case and the marks beside them, and none is a sign only of longer texts.
CORPUS_RULES = tuple(Rule("function_word_ratio", low=0.02, least=50, languages=STOP_LANGUAGES) if rule.metric == "stop_word_ratio" else rule
                     for rule in RULES)


def _repeat_words(ws: Column) -> Column:
    """Words that lie in a 5-word window found twice or more, the first included.

    Windows are hashed and only texts with equal hashes are sorted; the window starts found twice, in order, cover
    ``min(5, distance to the next)`` words each.
    """

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    def same(s: Column, a: Column, b: Column) -> Column:
        x, y = F.get(s, a), F.get(s, b)
        return F.coalesce((x["h"] == y["h"]) & (F.slice(ws, x["i"] + 1, WINDOW) == F.slice(ws, y["i"] + 1, WINDOW)), F.lit(False))

    def twice(s: Column) -> Column:
        found = F.filter(s, lambda x, k: same(s, k, k - 1) | same(s, k, k + 1))
        return let(F.sort_array(F.transform(found, lambda x: x["i"])), covered)

    def windows(hashed: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(ws) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(WINDOW)]))

    def repeated(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), let(placed, twice)).otherwise(F.lit(0).cast("long"))

    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    return F.when(F.size(ws) >= WINDOW, let(hashes, lambda hw: let(windows(hw), repeated))).otherwise(F.lit(0).cast("long"))


def measures(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of the counts of a whole text that the rules need; null and empty texts have no words."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def counts(ws: Column, ls: Column) -> Column:
        n = F.size(ws).cast("long")
        return F.struct(
            n.alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(body, rf"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            _repeat_words(ws).alias("n_repeat_words"),
            F.size(ls).cast("long").alias("n_lines"),
            F.size(F.filter(ws, lambda w: w.isin(*STOP_FORMS))).cast("long").alias("n_stop_words"),
            F.size(F.filter(ws, lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
            *([F.size(F.filter(ws, lambda w: F.btrim(F.lower(w), F.lit(MARKS)).isin(*STOP_WORDS))).cast("long").alias("n_function_words")]
              if any(rule.metric == "function_word_ratio" for rule in rules) else []),
        )

    return let(words(body), lambda ws: let(lines, lambda ls: counts(ws, ls)))


def _metrics(q: Column) -> dict[str, Column]:
    def ratio(top: str, bottom: str) -> Column:
        return F.coalesce(q[top] / F.nullif(q[bottom], F.lit(0).cast("long")), F.lit(0.0))

    return {
        "n_words": q["n_words"],
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "letter_word_ratio": ratio("n_letter_words", "n_words"),
        "stop_word_ratio": ratio("n_stop_words", "n_words"),
        "function_word_ratio": ratio("n_function_words", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_word_ratio": ratio("n_repeat_words", "n_words"),
    }


def verdict(q: Column, rules: tuple[Rule, ...] = RULES, lang: Column | None = None) -> Column:
    """The names of the rules a measured document breaks, as one expression. With ``lang``, rules for some languages pass the others
    and null ones."""
    metrics = _metrics(q)
    broken = []
    for rule in rules:
        metric, passes = metrics[rule.metric], F.lit(True)
        if rule.low is not None:
            passes = passes & (metric >= rule.low)
        if rule.high is not None:
            passes = passes & (metric <= rule.high)
        if rule.least:
            passes = passes | (q["n_words"] < rule.least)
        if rule.languages and lang is not None:
            spoken = F.lower(F.regexp_extract(lang, "^[A-Za-z]+", 0)).isin(*rule.languages)
            passes = passes | ~F.coalesce(spoken, F.lit(False))
        broken.append(F.when(~passes, F.lit(rule.metric)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def base_failed(q: Column) -> Column:
    """Too short, or more than a fifth of the words in repeated windows."""
    return (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])


def passes(text: Column, rules: tuple[Rule, ...] = RULES, lang: Column | None = None) -> Column:
    """Whether a whole text keeps all rules, as one expression that measures it once; for filters."""
    return let(measures(text, rules), lambda q: ~base_failed(q) & (F.size(verdict(q, rules, lang)) == 0))


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, lang: str | None = None) -> DataFrame:
    """``docs`` with ``quality`` (counts), ``broken`` (names of rules broken), ``base_failed`` and ``kept``.

    ``lang`` names the column of the documents' languages, for rules that are made for some of them.

    No shuffle, no group and no function outside the JVM: each row is judged alone, so repeated rows get the same values and an
    empty table stays empty. Null and empty texts have no words and fail. Own columns with the new names give way. To filter,
    use ``passes``: a filter on ``kept`` would be pushed below and measure each text many times.
    """
    q = F.col("quality")
    judged_rows = widened(widened(docs, quality=measures(docs[text], rules)), base_failed=base_failed(q),
                          broken=verdict(q, rules, docs[lang] if lang else None))
    return widened(judged_rows, kept=~F.col("base_failed") & (F.size("broken") == 0))
