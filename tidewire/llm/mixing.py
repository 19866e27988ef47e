"""Mixing sources to target weights: iterative proportional fitting over source, language and topic, then sampling.

Built-in functions only. Documents are summed to cells first; everything that iterates works on cells and margins.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import words
from tidewire.session import Scratch

MARGINS = ("source", "lang", "topic")
SHARE, TOLERANCE = 0.5, 1e-3
#: Sweeps in which the largest step has to shrink, or the fit ends short of its goals and says by how much.
PATIENCE = 4
#: Values of a margin that a step may be broadcast for, and cells to a task.
BROADCAST_VALUES, TASK_CELLS = 10_000, 200_000
SEED = 7

# Subjects told apart by what a text holds; the first that matches names it.
TOPICS = (
    ("legal", r"(?i)licen[sc]e|copyright|all rights reserved|warranty"),
    ("contact", r"@[A-Za-z0-9-]+\.|\+[0-9][\x20().0-9-]{7,}"),
    ("code", r"[{};]\s*\n|=>|\b(?:def|return|function|import|token|password)\b\s*[(=:]"),
    ("data", r"(?:\|[^\n|]*){4}|(?:[0-9][^\n0-9]{0,3}){8}"),
)
OTHER = "prose"


@dataclass(frozen=True)
class Target:
    """How a margin's shares follow from its tokens: ``share ** power`` of what there is, or fixed shares where given."""

    power: float = 1.0
    shares: tuple[tuple[str, float], ...] = ()


TARGETS = {"source": Target(power=0.7), "lang": Target(power=0.8), "topic": Target(power=0.9)}


def topic_of(text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    return reduce(lambda found, rule: F.when(body.rlike(rule[1]), rule[0]).otherwise(found), reversed(TOPICS), F.lit(OTHER))


def _tokens(text: Column) -> Column:
    return F.greatest(F.size(words(text)), F.lit(1)).cast("long")


def _marked(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null"))


def _cells(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Tokens of every cell; a null value of a margin is a value of its own."""
    marks = [_marked(rows[column]).alias(margin) for margin, column in columns.items()]
    return rows.select(*marks, "tokens_").groupBy(*columns).agg(F.sum("tokens_").alias("tokens"))


def _goals(cells: DataFrame, margin: str, target: Target, share: float) -> DataFrame:
    """Tokens that each value of a margin shall have; they add up to ``share`` of all tokens."""
    there = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("there"))
    total = there.agg(F.sum("there")).first()[0] or 0.0
    weight = F.pow("there", F.lit(target.power))
    for value, part in target.shares:
        weight = F.when(F.col(margin) == f"={value}", F.lit(part * total)).otherwise(weight)
    weighted = there.withColumn("weight", weight)
    weights = weighted.agg(F.sum("weight")).first()[0] or 1.0
    return weighted.select(margin, (F.col("weight") * F.lit(total * share / weights)).alias("goal"))


def raked(cells: DataFrame, scratch: Scratch, targets: dict[str, Target], share: float = SHARE,
          tolerance: float = TOLERANCE, patience: int = PATIENCE) -> DataFrame:
    """Cells with ``p``, the share of their tokens to take, at most 1, and ``gap``, the largest step of the last sweep.

    Every cell has a factor f and gives ``tokens * min(f, 1)``. One margin after the other has the factors of its values scaled by
    goal over tokens given, until no step differs from 1 by more than ``tolerance``, or the largest has not shrunk for ``patience``
    sweeps: then the goals contradict each other, and ``gap`` says how far they are missed. A value whose cells all give
    everything cannot meet a larger goal and stays as it is. The steps of a margin are a row for each of its values: they are
    broadcast up to ``BROADCAST_VALUES`` of them, counted before, and joined by shuffle beyond.
    """
    goals = {margin: scratch.keep(_goals(cells, margin, target, share)) for margin, target in targets.items()}
    small = {margin: goal.count() <= BROADCAST_VALUES for margin, goal in goals.items()}
    start = cells.select(*targets, "tokens", F.lit(float(share)).alias("f"), F.lit(0.0).alias("moved"))
    state = scratch.keep(start.coalesce(cells.count() // TASK_CELLS + 1))
    gap, best, waited = 0.0, float("inf"), 0
    while waited < patience:
        fitted = state.withColumn("moved", F.lit(0.0))
        for margin, goal in goals.items():
            given = fitted.groupBy(margin).agg(F.sum(F.col("tokens") * F.least("f", F.lit(1.0))).alias("given"), F.max(F.col("f") < 1).alias("open"))
            ratio = F.col("goal") / F.col("given")
            steps = given.join(goal, margin).select(margin, F.when(F.col("open") | (ratio < 1), ratio).otherwise(1.0).alias("step"))
            fitted = fitted.join(F.broadcast(steps) if small[margin] else steps, margin).select(
                *targets, "tokens", (F.col("f") * F.col("step")).alias("f"), F.greatest("moved", F.abs(F.col("step") - 1)).alias("moved"))
        after = scratch.keep(fitted)
        scratch.drop(state)
        state = after
        gap = state.agg(F.max("moved")).first()[0] or 0.0
        if gap <= tolerance:
            break
        waited = 0 if gap < 0.99 * best else waited + 1
        best = min(best, gap)
    return state.select(*targets, F.least("f", F.lit(1.0)).alias("p"), F.lit(gap).alias("gap"))


def chances(rows: DataFrame, scratch: Scratch, columns: dict[str, str], targets: dict[str, Target], share: float) -> DataFrame:
    """``rows`` with ``p_`` and ``gap_``, by the cell of each; only cells are joined, by broadcast where their written size allows it."""
    cells = scratch.keep(_cells(rows, columns))
    fitted = raked(cells, scratch, targets, share).withColumnsRenamed({margin: f"{margin}_cell" for margin in columns})
    found = rows.withColumns({f"{margin}_mark": _marked(rows[column]) for margin, column in columns.items()})
    same = reduce(lambda a, b: a & b, [found[f"{margin}_mark"] == fitted[f"{margin}_cell"] for margin in columns])
    return found.join(fitted, same).select(*[found[name] for name in rows.columns], F.col("p").alias("p_"), F.col("gap").alias("gap_"))


def draw(key: Column, text: Column, seed: int) -> Column:
    """A number from 0 to 1 that follows from a row's id and text alone, so a repeated task draws the same."""
    return F.pmod(F.xxhash64(F.lit(seed), key, text), F.lit(1 << 53)) / float(1 << 53)


def weighed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
            targets: dict[str, Target] = TARGETS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, p, kept, gap) of every document; texts are read once, whole. ``gap`` is the fit's
    last largest step, above ``TOLERANCE`` only if the goals of the margins cannot all be met.

    Null sources and languages are values of their own; null and empty texts count as one token of prose. Repeated rows are drawn
    alike. An empty table gives no rows. ``share`` of all tokens is aimed at; other columns do not matter.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(docs[key].alias("doc_id"), docs[source].alias("source"), docs[lang].alias("lang"), topic_of(docs[text]).alias("topic"),
                       _tokens(docs[text]).alias("tokens_"), draw(docs[key], docs[text], seed).alias("draw"))
    found = chances(scratch.keep(rows), scratch, {margin: margin for margin in MARGINS}, targets, share)
    return found.select("doc_id", "source", "lang", "topic", F.col("tokens_").alias("n_tokens"), F.col("p_").alias("p"),
                        (F.col("draw") < F.col("p_")).alias("kept"), F.col("gap_").alias("gap"))


def sampled(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
            targets: dict[str, Target] = TARGETS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their columns; null, empty, long and repeated ones and empty tables as in :func:`weighed`."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), docs[source].alias("source"), docs[lang].alias("lang"), topic_of(docs[text]).alias("topic"),
                       _tokens(docs[text]).alias("tokens_"), draw(docs[key], docs[text], seed).alias("draw"))
    found = chances(rows, Scratch(docs.sparkSession, "mixing"), {margin: margin for margin in MARGINS}, targets, share)
    return found.where(F.col("draw") < F.col("p_")).select("row.*")
