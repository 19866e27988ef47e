"""BPE encoding and decoding with forced boundaries.

Two neighbouring byte symbols that stand side by side inside no token of the vocabulary can never end up in one token, so every such
place is a certain cut. Words are cut there, the fragments are merged independently, and their ids are concatenated.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

CACHE = 400_000
SHORT, NEVER = 24, 1 << 60
PIECE = 1 << 20
BATCH_BYTES = 8 << 20

# Fixed values of the word vocabulary: white space, contractions and word-end mark. Words are contractions, runs of letters,
# single digits, and runs of other characters than these and white space.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
END = "</w>"

_SPACE = re.compile(f"[{SPACES}]")
_WORD = regex.compile(rf"{CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+")
_ASCII_WORD = re.compile(rf"{CONTRACTIONS}|[a-z]+|[0-9]|[^{SPACES}a-z0-9]+")


@lru_cache(1)
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if visible in Latin-1, else the next one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


class _Recent(dict):
    """Values worked out once per key while it keeps coming up: two generations of ``CACHE / 2`` keys, the older one forgotten
    when the younger is full. Very long keys are not kept."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= 64:
            if len(self) >= CACHE // 2:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class Bpe:
    """Encoder and decoder of one tokenizer file (its JSON text)."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        if model["end_of_word_suffix"] != END or data["decoder"] is not None:
            raise ValueError("a vocabulary with word ends and no decoder is needed")
        self.vocab: dict[str, int] = model["vocab"]
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = {i: t for t, i in chain(self.vocab.items(), self.special.items())}
        ordered = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, ordered)) + ")") if ordered else None
        self.inside = {pair for token in self.vocab for pair in self._pairs(token)}
        self.library = None
        self.spec = spec
        self.words = _Recent(self.word)

    @staticmethod
    def _pairs(token: str) -> Iterator[tuple[str, str]]:
        symbols = Bpe._symbols(token[:-len(END)], True) if token.endswith(END) and token != END else Bpe._symbols(token, False)
        return zip(symbols, symbols[1:])

    @staticmethod
    def _symbols(chars: str, ends: bool) -> list[str]:
        symbols = list(chars)
        if ends:
            symbols[-1] += END
        return symbols

    def cut(self, symbols: list[str]) -> Iterator[tuple[str, ...]]:
        """The symbols of a word in fragments that no token crosses."""
        start = 0
        for at, pair in enumerate(zip(symbols, symbols[1:]), 1):
            if pair not in self.inside:
                yield tuple(symbols[start:at])
                start = at
        yield tuple(symbols[start:])

    def merged(self, symbols: tuple[str, ...]) -> tuple[int, ...]:
        """Ids of one fragment: the pair of the lowest rank, leftmost first, merges until none is left."""
        if len(symbols) > SHORT:
            return self._merged_long(symbols)
        parts, rank = list(symbols), self.ranks.get
        ranks = [rank(pair, NEVER) for pair in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            at = ranks.index(best)
            parts[at] += parts.pop(at + 1)
            del ranks[at]
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), NEVER)
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), NEVER)
        vocab = self.vocab
        return tuple([vocab[p] for p in parts])

    def _merged_long(self, symbols: tuple[str, ...]) -> tuple[int, ...]:
        """The same over a heap, in n log n of the length."""
        parts: list[str | None] = list(symbols)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        ranks = self.ranks
        heap = [(ranks[pair], at, *pair) for at, pair in enumerate(zip(parts, parts[1:])) if pair in ranks]
        heapq.heapify(heap)
        while heap:
            _, at, a, b = heapq.heappop(heap)
            right = after[at]
            if parts[at] != a or right >= len(parts) or parts[right] != b:
                continue
            parts[at], parts[right], after[at] = a + b, None, after[right]
            if after[at] < len(parts):
                before[after[at]] = at
            for left, pair in ((before[at], (parts[before[at]], a + b) if before[at] >= 0 else None),
                               (at, (a + b, parts[after[at]]) if after[at] < len(parts) else None)):
                if pair in ranks:
                    heapq.heappush(heap, (ranks[pair], left, *pair))
        vocab = self.vocab
        return tuple([vocab[p] for p in parts if p is not None])

    def word(self, word: str) -> bytes:
        """Ids of one word as little-endian 32-bit numbers."""
        table = byte_symbols()
        ids: list[int] = []
        for fragment in self.cut(self._symbols("".join([table[b] for b in word.encode()]), True)):
            ids += self.merged(fragment)
        return struct.pack(f"<{len(ids)}I", *ids)

    def split(self, text: str) -> Iterator[list[str]]:
        """The words of a text without special tokens, normalised, in lists of bounded size."""
        plain = text.isascii()
        if not plain:
            if any(unicodedata.category(c) == "Cn" for c in set(text)):
                yield self._split_by_library(text)
                return
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # character by character, a last sigma is like any other
                text = text.replace("Σ", "σ")
        text = text.lower()
        pattern = _ASCII_WORD if plain else _WORD
        at = 0
        while len(text) - at > PIECE:
            blank = _SPACE.search(text, at + PIECE)  # no word holds white space
            if blank is None:
                break
            yield pattern.findall(text, at, blank.start())
            at = blank.start()
        yield pattern.findall(text, at)

    def _split_by_library(self, text: str) -> list[str]:
        """Characters that this Python's Unicode does not know yet: the library's own tables decide."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
        text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian 32-bit numbers; none for null and empty texts."""
        if not text:
            return b""
        parts = self.special_pattern.split(text) if self.special_pattern else [text]
        out = []
        for part in parts:
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            for found in self.split(part):
                out.append(b"".join([self.words[w] for w in found]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Token texts joined by blanks, special tokens included; unknown ids are left out."""
        return " ".join([self.tokens[i] for i in np.frombuffer(ids, "<u4").tolist() if i in self.tokens])


@lru_cache(2)
def _loaded(spec: str) -> Bpe:
    return Bpe(spec)


def _mapped(df: DataFrame, path: str, work, kinds: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """Other columns of ``df`` as they are, the last one replaced by what ``work(bpe, value)`` returns for it."""
    with open(path, encoding="utf-8") as file:
        spec = file.read()
    kept = [f for f in df.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(spec)
        for batch in batches:
            start, rows, size = 0, [], 0
            for at, value in enumerate(batch.column(batch.num_columns - 1), 1):
                found = work(bpe, value.as_py())
                rows.append(found)
                size += sum(len(x) for x in found if isinstance(x, (bytes, str)))
                if size >= BATCH_BYTES or at == batch.num_rows:
                    columns = [pa.array(c, kind) for c, (_, _, kind) in zip(zip(*rows), kinds)]
                    before = [batch.column(i).slice(start, at - start) for i in range(batch.num_columns - 1)]
                    yield pa.RecordBatch.from_arrays(before + columns, [f.name for f in kept] + [name for name, _, _ in kinds])
                    start, rows, size = at, [], 0

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{name} {kind}" for name, kind, _ in kinds])
    return df.mapInArrow(run, schema)


def encoded(docs: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text", decoded: bool = False) -> DataFrame:
    """The key columns, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit numbers) of each whole text.

    With ``decoded`` also the text that the ids decode to. Null and empty texts have no tokens. Special tokens spelled out in a text
    are encoded as such. Rows are encoded one by one: repeated rows give equal rows, an empty table gives none, other columns
    do not matter. Very long texts are split into words a piece at a time; ``path`` is read by the driver and sent along.
    """
    kinds = [("n_tokens", "long", pa.int64()), ("ids", "binary", pa.binary())]
    if decoded:
        kinds.append(("decoded", "string", pa.string()))

    def work(bpe: Bpe, value: str | None):
        ids = bpe.encode(value)
        return (len(ids) // 4, ids, bpe.decode(ids)) if decoded else (len(ids) // 4, ids)

    return _mapped(docs.select(*[docs[k] for k in keys], docs[text].alias("text_")), path, work, kinds)


def decoded(rows: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The key columns and the text ``decoded`` of column ``ids``; null ids decode to an empty text."""
    return _mapped(rows.select(*[rows[k] for k in keys], rows[ids].alias("ids_")), path,
                   lambda bpe, value: (bpe.decode(value or b""),), [("decoded", "string", pa.string())])
