"""Ranked lexical search by presence masks.

For each item the documents of a block are grouped by the bitmap of the item's terms they hold. A mask has a greatest possible score;
masks are evaluated from the greatest down, and the item is finished when no mask that is left can reach its k-th best score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.session import Scratch

# Bytes of terms that are searched in one pass, cells of a block of documents by terms, and lists merged at once.
BLOCK_BYTES, CELLS, FAN_IN = 1 << 20, 1 << 22, 1024

# In UTF-8 every character from U+0080 on is made of bytes from 0x80 on, and lower() of bytes changes A-Z alone.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_LAST = 2**63 - 1


def terms(text: bytes | None) -> list[bytes]:
    return _TERM.findall(text.lower()) if text else []


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, term) of every item, each term once a row."""
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = sorted(set(terms(text.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(found, pa.binary())], ["item_id", "term"])


def _term_counter(vocabulary: dict[bytes, int]):
    """(doc_id, n, ids, counts): the number of a document's terms, and those of the vocabulary with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for batch in batches:
            lengths, ids, counts, offsets = [], [], [], [0]
            for text in batch.column(1):
                found = terms(text.as_py())
                lengths.append(len(found))
                held = Counter(filter(known.__contains__, found))
                ids += [vocabulary[t] for t in held]
                counts += held.values()
                offsets.append(len(ids))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, pa.int32())) for v in (ids, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "ids", "counts"])

    return run


def weight(documents: int, holding: int) -> int:
    """Weight of a term held by ``holding`` of ``documents``."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_factor(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """10 and 90 times a document's length over the mean one."""
    if 90 * int(n.max(initial=0)) * documents <= _LAST:
        return 10 + 90 * n * documents // total
    return np.array([10 + 90 * int(x) * documents // total for x in n], np.int64)


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term that occurs ``tf`` times adds to a document's score, per unit of weight; grows with tf and falls with m."""
    return 1_000_000_000 * tf // np.maximum(1000 * tf + 8 * m, 1)


class Block(NamedTuple):
    """Some documents by the vocabulary: ids (the last of all for none), length factors and occurrences."""

    ids: np.ndarray
    nameless: np.ndarray
    m: np.ndarray
    tf: np.ndarray


class Best:
    """The k best documents of one item so far."""

    def __init__(self, columns: list[int], weights: list[int], k: int):
        self.columns, self.weights, self.k = np.array(columns, np.int64), np.array(weights, np.int64), k
        self.scores = self.ids = np.zeros(0, np.int64)
        self.nameless = np.zeros(0, bool)

    @property
    def least(self) -> int:
        """A score under this one cannot belong to the list any more."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> None:
        scores, ids, nameless = [np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.nameless, nameless))]
        order = np.lexsort((ids, nameless, -scores))[:self.k]
        order = order[scores[order] > 0]
        self.scores, self.ids, self.nameless = scores[order], ids[order], nameless[order]

    def search(self, block: Block) -> int:
        """Takes in the block's documents; returns how many were evaluated."""
        held = block.tf[:, self.columns] > 0
        rows = np.nonzero(held.any(axis=1))[0]
        if not len(rows):
            return 0
        # The bitmap of an item's terms is the mask; equal masks are brought together by sorting them as numbers.
        bits = np.packbits(held[rows], axis=1)
        words = np.zeros((len(rows), -(-bits.shape[1] // 8) * 8), np.uint8)
        words[:, :bits.shape[1]] = bits
        words = words.view(np.uint64)
        order = np.lexsort(words.T)
        rows, words = rows[order], words[order]
        first = np.nonzero(np.append(True, (words[1:] != words[:-1]).any(axis=1)))[0]
        ends = np.append(first[1:], len(rows))
        # No document of a mask can do better than the most frequent use of each term in the shortest document.
        most = block.tf[:, self.columns].max(axis=0)
        shortest = np.minimum.reduceat(block.m[rows], first)
        bound = (held[rows[first]] * self.weights * part(most[None, :], shortest[:, None])).sum(axis=1)
        by_bound, at, step, seen = np.argsort(-bound, kind="stable"), 0, 1, 0
        while at < len(by_bound):
            chosen = by_bound[at:at + step]
            chosen = chosen[bound[chosen] >= self.least]
            if not len(chosen):
                break
            mine = np.concatenate([rows[first[i]:ends[i]] for i in chosen])
            scores = (self.weights * part(block.tf[mine][:, self.columns], block.m[mine][:, None])).sum(axis=1)
            self.add(scores, block.ids[mine], block.nameless[mine])
            at, step, seen = at + step, step * 4, seen + len(mine)
        return seen


def _searcher(items: list[tuple[int, list[int]]], weights: list[int], documents: int, total: int, k: int):
    """(item_id, part, doc_id, score): the k best of every item among a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(columns, [weights[c] for c in columns], k) for _, columns in items]
        step = max(1, CELLS // max(1, len(weights)))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                ids, counts = batch.column(2), batch.column(3)
                sizes = np.diff(np.asarray(ids.offsets).astype(np.int64))
                tf = np.zeros((batch.num_rows, len(weights)), np.int64)
                tf[np.repeat(np.arange(batch.num_rows), sizes), np.asarray(ids.flatten())] = np.asarray(counts.flatten())
                nameless = np.asarray(batch.column(0).is_null().to_numpy(zero_copy_only=False))
                named = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                n = batch.column(1).to_numpy()
                block = Block(named, nameless, length_factor(n, documents, total), tf)
                for one in best:
                    one.search(block)
        place = TaskContext.get().partitionId()
        for (item, _), one in zip(items, best):
            if len(one.scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(one.scores), pa.int64()), pa.array([place] * len(one.scores), pa.int32()),
                     pa.array(one.ids, mask=one.nameless), pa.array(one.scores)], ["item_id", "part", "doc_id", "score"])

    return run


def _item_blocks(held: DataFrame) -> int:
    """Into how many blocks a hash cuts the items so that the terms of each stay under ``BLOCK_BYTES``, or that it holds one item."""
    sizes = held.groupBy("item_id").agg(F.sum(F.octet_length("term") + 16).alias("bytes"))
    blocks = max(1, math.ceil((sizes.agg(F.sum("bytes")).first()[0] or 0) / BLOCK_BYTES))
    while True:
        fullest = sizes.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(blocks))).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("items"))
        if not fullest.where(f"bytes > {BLOCK_BYTES} and items > 1").limit(1).count():
            return blocks
        blocks *= 2


def ranked(items: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item.

    A document's score sums, over the item's distinct terms, the term's weight times what its occurrences add in a document of that
    length (:func:`weight`, :func:`part`). Items (item_id, text) are searched in blocks of bounded size; for each block the documents
    (doc_id, text) are read once, for the occurrences of the block's terms, and those are searched once. A task keeps one list an
    item from block to block of its documents; the tasks' lists are merged in two steps.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased. Null and empty texts have
    none. Documents without a term do not count. Equal scores go by ascending doc_id, nulls last; rows that repeat an id are documents
    each. Items that share an id are one item of all their terms; items without an id or a term take no part, and those that no
    document scores above 0 for have no rows. Empty tables give no rows; other columns do not matter. Texts are taken whole.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    items = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].cast("binary").alias("text")).where("item_id is not null")
    held = scratch.keep(items.mapInArrow(_item_terms, "item_id long, term binary").distinct())
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text"))
    blocks, documents, total, lists = _item_blocks(held), None, None, []
    for block in range(blocks):
        rows = held.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()
        vocabulary = {term: at for at, term in enumerate(sorted(set(rows.column(1).to_pylist())))}
        asked: dict[int, list[int]] = {}
        for item, term in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            asked.setdefault(item, []).append(vocabulary[term])
        counted = scratch.keep(texts.mapInArrow(_term_counter(vocabulary), "doc_id long, n long, ids array<int>, counts array<int>"))
        if documents is None:
            documents, total = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = dict(counted.select(F.explode("ids").alias("id")).groupBy("id").count().collect())
        weights = [weight(documents, holding.get(at, 0)) for at in range(len(vocabulary))]
        search = _searcher(sorted(asked.items()), weights, documents, max(1, total), k)
        schema = "item_id long, part int, doc_id long, score long"
        lists.append(scratch.keep(counted.where(F.size("ids") > 0).mapInArrow(search, schema)))
        scratch.drop(counted)
    best = lists[0]
    for other in lists[1:]:
        best = best.unionByName(other)
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", F.floor(F.col("part") / FAN_IN)).orderBy(*order)))
    best = best.where(F.col("rank") <= k).withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return best.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
