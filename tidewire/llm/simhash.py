"""SimHash near-duplicates: fingerprints of word shingles, linked through Golay-code keys.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Of up to two differing bits at least one segment holds none
(pigeonhole), and the next one, cyclically, holds at most two. So each fingerprint gets, for every segment taken as it is, the keys
of the next segment: the indices of the Golay codewords that the words within one bit of it decode to. Two words at most two bits
apart have a word within one bit of both, so they share a key; a key is 30 or 35 bits long, and a fingerprint has about 16.

Keys shared by more than ``BUCKET`` fingerprints are not joined. Their fingerprints are linked over midpoints: each is sent to the 65
words within one bit of it, two fingerprints at most two bits apart meet at one, and no midpoint sees more than 65.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.components import components
from tidewire.session import Scratch

SEED = 42
BUCKET = 128
_BLOCK = 1 << 16

# The binary Golay code of 23 bits, its generator polynomial, and the places of the segments.
GOLAY_BITS, GOLAY_DATA, GOLAY_GENERATOR = 23, 12, 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))


@cache
def nearest_codeword() -> np.ndarray:
    """For each 23-bit word the 12 data bits of the only codeword within three bits of it."""
    check = GOLAY_BITS - GOLAY_DATA
    data = np.arange(1 << GOLAY_DATA, dtype=np.int64)
    rest = data << check
    for bit in range(GOLAY_BITS - 1, check - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY_GENERATOR << bit - check), rest)
    code = data << check | rest
    one = 1 << np.arange(GOLAY_BITS, dtype=np.int64)
    errors = {0}
    for _ in range(3):
        errors |= {e | int(b) for e in errors for b in one}
    table = np.zeros(1 << GOLAY_BITS, dtype=np.uint16)
    for error in errors:
        table[code ^ error] = data
    return table


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The unsigned fingerprint of one UTF-8 text: a bit is 1 if set in over half the hashes of its shingles."""
    ws = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not ws:
        return 0
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(ws))
    total, digest, bits = len(ws) - size + 1, xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, total, _BLOCK):
        till = min(total, at + _BLOCK)
        block = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[at:till].tolist(), ends[at + size - 1:till + size - 1].tolist())])
        bits += np.unpackbits(np.frombuffer(block, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > total).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprinted(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""
    rows = docs.select(docs[key].alias("doc_id"), docs[text].cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signed(fingerprint(t.as_py(), shingle)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def _segment_keys(word: np.ndarray, bits: int) -> np.ndarray:
    """Codeword indices of the words within one bit, a row each; repeats are -1."""
    flips = np.concatenate(([0], 1 << np.arange(bits, dtype=np.int64)))
    found = np.sort(nearest_codeword()[word[:, None] ^ flips].astype(np.int64), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: the taken segment's number and bits, and one codeword index of the next segment."""
    values, rows, keys = fps.view(np.uint64), [], []
    parts = [(values >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    for i in range(len(SEGMENTS)):
        j = (i + 1) % len(SEGMENTS)
        codes = _segment_keys(parts[j], SEGMENTS[j][1])
        row, column = np.nonzero(codes >= 0)
        rows.append(row)
        keys.append((parts[i][row] << GOLAY_DATA | codes[row, column]) << 2 | i)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(fps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(values), _BLOCK):
                part = values[at:at + _BLOCK]
                row, key = golay_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(part[row]), pa.array(key)], ["fp", "key"])

    return fps.select("fp").mapInArrow(run, "fp long, key long")


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, max_bits: int, scratch: Scratch) -> DataFrame:
    """(u, v) that join all distinct fingerprints at most ``max_bits`` apart into the right components.

    Pairs from Golay buckets are verified; at a midpoint the members are linked to its smallest one (two bits), or to the
    midpoint itself if it is a fingerprint (one bit).
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("Golay keys as laid out here find distances of 0 to 2 bits")
    if max_bits == 0:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    keyed = scratch.keep(_keyed(fps))
    # Buckets of one fingerprint hold no pair, so only the others are joined.
    sizes = keyed.groupBy("key").count().where("count > 1")
    shared = scratch.keep(sizes)
    small = shared.where(F.col("count") <= BUCKET).select("key")
    left = keyed.join(small, "key", "left_semi")
    right = left.select("key", F.col("fp").alias("other"))
    pairs = left.join(right, (left["key"] == right["key"]) & (left["fp"] < right["other"])
                      & (_distance(left["fp"], right["other"]) <= max_bits)).select(left["fp"].alias("u"), F.col("other").alias("v"))
    crowded = keyed.join(shared.where(F.col("count") > BUCKET).select("key"), "key", "left_semi").select("fp").distinct()
    around = F.concat(F.array("fp"), F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(1 << bit))) for bit in range(64)]))
    met = crowded.select("fp", F.explode(around).alias("mid")).groupBy("mid").agg(F.collect_set("fp").alias("members")).where("size(members) > 1")
    if max_bits == 2:
        stars = met.select(F.array_min("members").alias("u"), F.explode("members").alias("v"))
    else:
        stars = met.where(F.array_contains("members", F.col("mid"))).select(F.col("mid").alias("u"), F.explode("members").alias("v"))
    return pairs.unionByName(stars.where("u <> v"))


def _placed(docs: DataFrame, shingle: int, max_bits: int, key: str, text: str) -> DataFrame:
    """(doc_id, fp, root, component_id): ``root`` is one fingerprint for all of a component."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep(fingerprinted(docs, shingle, key, text))
    classes = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(classes, max_bits, scratch), scratch).withColumnRenamed("node", "fp")
    lowest = scratch.keep(roots.join(classes, "fp").groupBy("root").agg(F.min("low").alias("component_id")))
    resolved = roots.join(lowest, "root").select("fp", "root", "component_id")
    named = scratch.keep(classes.join(resolved, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "low").alias("component_id")))
    return fps.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest id reachable over links, the row's own included.

    Null and empty texts and those of white space have fingerprint 0 and link like any other. Shorter texts than a shingle
    are one shingle. Repeated rows stay, each with its component. Rows without an id take part and keep a null id; a component
    without any id has a null component_id. An empty table gives no rows. Other columns of ``docs`` do not matter.
    """
    return _placed(docs, shingle, max_bits, key, text).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, max_bits: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps the document of its smallest id.

    Of rows with the same id in the same component one stays, by a hash of the text; texts of one id that belong to different
    components are judged each for itself. Rows without an id cannot be told apart, and stay.
    """
    found = _placed(docs, shingle, max_bits, key, text).where("doc_id is not null")
    ids = found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("rows"))
    scratch = Scratch(docs.sparkSession, "simhash")
    gone = scratch.keep(ids.where("not stays").select(F.col("doc_id").alias("gone_id")))
    kept = docs.join(gone, docs[key] == gone["gone_id"], "left_anti")
    repeated = scratch.keep(ids.where("stays and rows > 1").select(F.col("doc_id").alias("again_id")))
    if not repeated.limit(1).count():
        return kept
    digest = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    again = docs.join(repeated, docs[key] == repeated["again_id"], "left_semi").select(
        F.struct(docs[key].alias("id"), digest.alias("digest")).alias("place"), docs[text].alias("text"), F.struct(*docs.columns).alias("row"))
    prints = fingerprinted(again, shingle, "place", "text").select(F.col("doc_id").alias("of"), "fp").distinct()
    leads = found.where("doc_id = component_id").select(F.col("doc_id").alias("lead"), F.col("fp").alias("lead_fp"), "root").distinct()
    placed = again.join(prints, again["place"] == prints["of"]).join(leads, (F.col("place.id") == F.col("lead")) & (F.col("fp") == F.col("lead_fp")))
    order = F.struct("place.digest", F.xxhash64(F.to_json("row")))
    one = placed.groupBy("lead", "root").agg(F.min_by("row", order).alias("row")).select("row.*")
    return kept.join(repeated, kept[key] == repeated["again_id"], "left_anti").unionByName(one)


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

