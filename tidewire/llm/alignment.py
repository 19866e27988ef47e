"""Alignment of two tokenizers: token intervals of both are coalesced into groups that begin and end at a border of each.

All tokens of a batch of texts lie on one byte axis. They are sorted by their starts, the running maximum of their ends is taken, and a
group begins where a start reaches the maximum of all before it; tokens that overlap fall into one group.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.bpe import byte_symbols
from tidewire.session import Scratch

# Fixed values of the piece vocabulary: the mark of a blank and the form of a byte that no piece covers.
BLANK, BYTE = "▁", "<0x{:02X}>"

# Fixed values of the byte-level vocabulary: how it cuts texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}

# Pairs whose counts travel to the tasks, text bytes aligned at once, and distinct pairs a task counts before it hands them on.
HEAD = 1 << 17
BATCH_BYTES = 4 << 20
COUNTED = 1 << 21

_DOCS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, a array<int>, b array<int>, times array<int>"
_TEXT = ",|;"


class Tokens(NamedTuple):
    """Token ids of several texts one behind the other, and how many each text has."""

    ids: np.ndarray
    counts: np.ndarray


class Side:
    """What the alignment needs of one vocabulary: the bytes of each id, and its number followed by each mark."""

    def __init__(self, tokens: list[bytes], encode):
        self.bytes, self.encode = tokens, encode
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.written = np.array([f"{i}{mark}".encode() for mark in [*_TEXT, ""] for i in range(len(tokens))], object)

    def tokens(self, texts: list[str]) -> Tokens:
        rows = self.encode(texts)
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        if rows and isinstance(rows[0], np.ndarray):
            return Tokens(np.concatenate(rows).astype(np.int64), counts)
        return Tokens(np.fromiter(chain.from_iterable(rows), np.int64, int(counts.sum())), counts)

    def joined(self, found: Tokens) -> list[bytes]:
        whole = b"".join(map(self.bytes.__getitem__, found.ids.tolist()))
        sizes = np.add.reduceat(np.append(self.lengths[found.ids], 0), _first(found.counts)) * (found.counts > 0)
        ends = np.cumsum(sizes)
        return [whole[e - n:e] for n, e in zip(sizes.tolist(), ends.tolist())]


def _first(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def byte_side(spec: str) -> Side:
    """Side A: a byte-level vocabulary (the tokenizer file's JSON text); special tokens spelled out in a text are text.

    Where ids rise in the order of the merges, the ranks are the ids, and the encoder over ranks gives the same ids in less time.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has its core, not the machine
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    byte_of = {c: b for b, c in enumerate(byte_symbols())}
    tokens = [b""] * (max(tokenizer.get_vocab().values()) + 1)
    for token, at in tokenizer.get_vocab().items():
        tokens[at] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    data = json.loads(spec)
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in data["model"]["merges"]]
    ids = [data["model"]["vocab"][m] for m in merged]
    plain = data["normalizer"] is None and data["pre_tokenizer"] == PRE_TOKENIZER and len(data["model"]["vocab"]) == 256 + len(set(ids))
    if plain and ids == list(range(256, 256 + len(ids))):
        from tiktoken import Encoding

        special = {t["id"] for t in data["added_tokens"]}
        ranks = {token: at for at, token in enumerate(tokens) if at not in special}
        encoding = Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return Side(tokens, lambda texts: [encoding.encode_to_numpy(t, disallowed_special=()) for t in texts])
    return Side(tokens, lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])


def piece_side(model: bytes) -> Side:
    """Side B: a piece vocabulary (the model file's bytes), which puts a blank before the text itself."""
    from sentencepiece import SentencePieceProcessor

    processor = SentencePieceProcessor(model_proto=model)
    raw = {BYTE.format(b): bytes([b]) for b in range(256)}
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    return Side([raw.get(p) or p.replace(BLANK, " ").encode() for p in pieces], lambda texts: processor.encode(texts, num_threads=1))


@lru_cache(2)
def _sides(spec: str, model: bytes) -> tuple[Side, Side]:
    return byte_side(spec), piece_side(model)


class Aligned(NamedTuple):
    """Every token of texts whose tokens cover the same bytes: in order of group, side and place, and the links between sides."""

    order: np.ndarray  # places in A's tokens followed by B's
    group: np.ndarray
    left: np.ndarray  # links: place in A's tokens, place in B's tokens
    right: np.ndarray


def coalesced(a: np.ndarray, b: np.ndarray) -> Aligned:
    """Groups and links of token lengths ``a`` and ``b`` over the same bytes; no token is empty."""
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    starts, ends = np.concatenate([ends_a - a, ends_b - b]), np.concatenate([ends_a, ends_b])
    order = np.lexsort((starts,))  # stable, so an A token comes before the B token that starts with it
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    opens = np.ones(len(order), bool)
    opens[1:] = starts[1:] >= reach[:-1]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(opens) - 1
    of_a, of_b = of[:len(a)], of[len(a):]
    # Within a group A's tokens come first: each token is moved on by the other side's tokens before it.
    groups = int(of.max(initial=-1)) + 1
    before_b, upto_a = np.cumsum(np.append(0, np.bincount(of_b, minlength=groups))), np.cumsum(np.bincount(of_a, minlength=groups))
    place = np.concatenate([np.arange(len(a)) + before_b[of_a], np.arange(len(b)) + upto_a[of_b]])
    inside, group = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    inside[place], group[place] = np.arange(len(order)), of
    # Ends grow within a side, so equal ends are found by bisection; both tokens overlap, so they are in one group.
    at = np.searchsorted(ends_a, ends_b)
    right = np.nonzero(ends_a[np.minimum(at, len(ends_a) - 1)] == ends_b)[0] if len(a) else np.zeros(0, np.int64)
    return Aligned(inside, group, at[right], right)


def _digests(found: Aligned, a: Tokens, b: Tokens, sides: tuple[Side, Side], bounds: np.ndarray) -> list[str]:
    """sha256 of ``a1,a2|b1;a3|b2`` of each text; ``bounds`` are the ends of the texts in the sorted tokens."""
    second = found.order >= len(a.ids)
    mark = np.where(found.group[1:] != found.group[:-1], 2, second[1:] != second[:-1])
    mark = np.append(mark, 3)
    mark[bounds - 1] = 3
    size = len(sides[0].bytes)
    ids = np.concatenate([a.ids, b.ids + 4 * size])[found.order] + mark * np.where(second, len(sides[1].bytes), size)
    pieces = np.concatenate([sides[0].written, sides[1].written])[ids].tolist()
    return [sha256(b"".join(pieces[lo:hi])).hexdigest() for lo, hi in zip([0, *bounds[:-1].tolist()], bounds.tolist())]


def _distinct(text: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: int, size_b: int) -> tuple[np.ndarray, ...]:
    """The distinct (text, a, b) in order and how often each is there."""
    whole = size_a * size_b
    key = np.sort((text * size_a + a) * size_b + b)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.nonzero(new)[0]
    key, pair = key[at], key[at] % whole
    return key // whole, pair // size_b, pair % size_b, np.diff(np.append(at, len(new)))


def align(texts: list[str | None], sides: tuple[Side, Side]) -> dict[str, list | np.ndarray]:
    """Numbers, digest and distinct links of each text; texts whose tokens do not spell blank + text have none."""
    here = [at for at, text in enumerate(texts) if text]
    spaced = [" " + texts[at] for at in here]
    a, b = sides[0].tokens(spaced), sides[1].tokens([texts[at] for at in here])
    same = np.array([x == y == text.encode() for x, y, text in zip(sides[0].joined(a), sides[1].joined(b), spaced)], bool)
    if not same.all():
        a, b = [Tokens(side.ids[np.repeat(same, side.counts)], side.counts[same]) for side in (a, b)]
    here = np.array(here, np.int64)[same]
    out = {name: np.zeros(len(texts), np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
    digests, offsets = [""] * len(texts), np.zeros(len(texts) + 1, np.int64)
    left = right = times = np.zeros(0, np.int64)
    if len(here):
        found = coalesced(sides[0].lengths[a.ids], sides[1].lengths[b.ids])
        bounds = np.cumsum(a.counts + b.counts)
        for at, digest in zip(here.tolist(), _digests(found, a, b, sides, bounds)):
            digests[at] = digest
        last = found.group[bounds - 1]
        text_of_b = np.repeat(np.arange(len(here)), b.counts)[found.right]
        out["n_a"][here], out["n_b"][here] = a.counts, b.counts
        out["n_groups"][here] = np.diff(last, prepend=-1)
        out["n_links"][here] = np.bincount(text_of_b, minlength=len(here))
        text, left, right, times = _distinct(text_of_b, a.ids[found.left], b.ids[found.right], *[len(side.bytes) for side in sides])
        offsets[1:] = np.cumsum(np.bincount(here[text], minlength=len(texts)))
    return {**out, "groups": digests, "offsets": offsets, "a": left, "b": right, "times": times}


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``BATCH_BYTES`` together, one row at least."""
    start, size = 0, 0
    for at, own in enumerate(sizes.tolist()):
        if size and size + own > BATCH_BYTES:
            yield start, at
            start, size = at, 0
        size += own
    if start < len(sizes):
        yield start, len(sizes)


def _aligner(spec: str, model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, row = _sides(spec, model), TaskContext.get().partitionId() << 40
        for whole in batches:
            sizes = np.array([len(v.as_buffer()) if v.is_valid else 0 for v in whole.column(1)], np.int64)
            for lo, hi in _slices(sizes):
                batch = whole.slice(lo, hi - lo)
                found = align(batch.column(1).to_pylist(), sides)
                lists = [pa.ListArray.from_arrays(found["offsets"].astype(np.int32), found[name].astype(np.int32)) for name in ("a", "b", "times")]
                numbers = [pa.array(found[name]) for name in ("n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + hi - lo)), batch.column(0), *numbers, pa.array(found["groups"], pa.string()), *lists],
                    [f.split()[0] for f in _DOCS.split(", ")])
                row += hi - lo

    return run


def _pairs(batch: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, times, rows' offsets) of three list columns; a pair is A's id above B's."""
    a, b, times = [batch.column(at) for at in range(first, first + 3)]
    flat = [np.asarray(column.flatten()).astype(np.int64) for column in (a, b, times)]
    offsets = np.asarray(a.offsets).astype(np.int64)
    return flat[0] << 32 | flat[1], flat[2], offsets - offsets[0]


def _summed(pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pair, kind="stable")
    pair, times = pair[order], times[order]
    new = np.ones(len(pair), bool)
    new[1:] = pair[1:] != pair[:-1]
    at = np.nonzero(new)[0]
    return pair[at], np.add.reduceat(times, at) if len(at) else times


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task's pairs, handed on whenever ``COUNTED`` distinct ones have come together."""
    held, waiting = [], 0

    def flush():
        return _summed(np.concatenate([p for p, _ in held]), np.concatenate([t for _, t in held]))

    def batch(pair, times):
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(times)], ["pair", "n"])

    for got in batches:
        pair, times, _ = _pairs(got, 0)
        held.append(_summed(pair, times))
        waiting += len(held[-1][0])
        if waiting > 2 * COUNTED:
            held = [flush()]
            waiting = len(held[0][0])
            if waiting > COUNTED:
                yield batch(*held[0])
                held, waiting = [], 0
    if held:
        yield batch(*flush())


def _scorer(head: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """Sums over the pairs of the head; all other pairs are passed on."""
    known, counts, best = head

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, times, offsets = _pairs(batch, batch.num_columns - 3)
            at = np.minimum(np.searchsorted(known, pair), len(known) - 1)
            held = known[at] == pair
            sums = [np.append(0, np.cumsum(values)) for values in (
                np.where(held, times * counts[at], 0), np.where(held, times * best[at], 0), ~held)]
            lists = pa.array(sums[2][offsets].astype(np.int32))
            rest = [pa.ListArray.from_arrays(lists, pa.array(values[~held])) for values in (pair, times)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(batch.num_columns - 3)], *[pa.array(np.diff(s[offsets])) for s in sums[:2]], *rest],
                [*batch.schema.names[:-3], "count_sum", "n_best", "pair", "times"])

    return run


def _head(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent pairs, ``HEAD`` at most: (pair, count, whether it is the best of its B id), by pair, after one that no text has."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 4).cast("int")
    sizes = {row["step"]: row["count"] for row in counts.groupBy(step.alias("step")).count().collect()}
    total, least = 0, None
    for level in sorted(sizes, reverse=True):
        total += sizes[level]
        if total > HEAD:
            break
        least = level
    rows = counts.where(step >= least if least is not None else F.lit(False)).select("pair", "n", F.col("best").cast("long")).toArrow()
    pair, n, best = [np.append(first, rows.column(at).to_numpy()).astype(np.int64) for at, first in enumerate((-1, 0, 0))]
    order = np.argsort(pair)
    return pair[order], n[order], best[order]


def aligned(docs: DataFrame, byte_vocabulary: str, piece_model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every text, tokenized by both vocabularies (paths of files).

    A group is a least run of tokens of both sides that covers the same bytes; a link joins an A and a B token that end together. Over
    all texts a pair of ids is counted once per link; ``n_best`` are a text's links of a pair no other pair of its B id exceeds,
    ``count_sum`` the counts summed over the text's links. ``groups`` is the sha256 of the groups as text.

    Texts are tokenized once, into a table of their distinct pairs. Counts are added up in each task before the shuffle; those of the
    most frequent ``HEAD`` pairs travel to the tasks, all others are joined, so no join key is hot. Null and empty texts, and texts
    whose tokens on either side do not spell the text with a blank before it, have no tokens: zeros and an empty ``groups``. A
    row is a text of its own: rows that repeat an id, and rows without one, are all returned and counted. Texts of any length
    are taken whole; an empty table gives no rows; other columns do not matter.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    with open(byte_vocabulary, encoding="utf-8") as file:
        spec = file.read()
    with open(piece_model, "rb") as file:
        model = file.read()
    texts = scratch.keep(docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(_aligner(spec, model), _DOCS))
    partial = texts.select("a", "b", "times").mapInArrow(_counter, "pair long, n long")
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF))  # a group is bounded by the size of A's vocabulary
    counts = partial.groupBy("pair").agg(F.sum("n").alias("n"))
    counts = scratch.keep(counts.withColumn("best", F.col("n") == F.max("n").over(of_b)))
    numbers = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
    schema = ", ".join(f.strip() for f in _DOCS.split(", ")[:7]) + ", count_sum long, n_best long, pair array<long>, times array<long>"
    scored = scratch.keep(texts.select(*numbers, "a", "b", "times").mapInArrow(_scorer(_head(counts)), schema))
    scratch.drop(texts)
    rest = scored.select("row", F.explode(F.arrays_zip("pair", "times")).alias("p")).select("row", "p.pair", "p.times")
    rest = rest.join(counts, "pair").groupBy("row").agg(
        F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    whole = scored.drop("pair", "times").join(rest, "row", "left")
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links",
                        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
                        (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups")
