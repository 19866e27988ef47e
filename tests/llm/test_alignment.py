import random
from collections import Counter
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tests.llm.conftest import make
from tidewire.llm import alignment
from tidewire.llm.bpe import byte_symbols
from tidewire.llm.common import tokenizer_path

BYTES, PIECES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups".split()


def plain(texts):
    """Token by token, with sets of byte offsets."""
    a, b = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    back = {c: n for n, c in enumerate(byte_symbols())}

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and len(piece) == 6 else piece.replace("▁", " ").encode()

    def ends(sizes):
        return list(accumulate(sizes))

    rows, pairs = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        parts_a, parts_b = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a], [bytes_b(i) for i in ids_b]
        if not text or b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            rows.append(None)
            continue
        ends_a, ends_b = ends([len(p) for p in parts_a]), ends([len(p) for p in parts_b])
        cuts = sorted(set(ends_a) & set(ends_b))
        last_a, last_b = ({e: n for n, e in enumerate(es)} for es in (ends_a, ends_b))
        links = [(ids_a[last_a[c]], ids_b[last_b[c]]) for c in cuts]
        groups, low_a, low_b = [], 0, 0
        for cut in cuts:
            high_a, high_b = last_a[cut] + 1, last_b[cut] + 1
            groups.append(",".join(map(str, ids_a[low_a:high_a])) + "|" + ",".join(map(str, ids_b[low_b:high_b])))
            low_a, low_b = high_a, high_b
        pairs.update(links)
        rows.append((len(ids_a), len(ids_b), groups, links))
    most = Counter()
    for (_, right), n in pairs.items():
        most[right] = max(most[right], n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = row
            out.append((n_a, n_b, len(groups), len(links), sum(pairs[p] == most[p[1]] for p in links), sum(pairs[p] for p in links),
                        sha256(";".join(groups).encode()).hexdigest()))
    return out


def texts():
    rng = random.Random(8)
    odd = ["é", "日本語のテキスト", "áb", "▁x", "<s> and </s> <|endoftext|> <0x41> <unk>", "tab\tand\nline\r\n", "  two  blanks ", "\x00\x01", "🙂🙃 ok",
           " ", " ", "ﬁ ligature", "ΑΣ", " ", "xn--" * 50, "don't we'll I'M"]
    alphabet = "ab cde  é日🙂'.1\n"
    return odd + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(60)] + ["the old house on the hill " * 30] * 3 + [None, ""]


@pytest.mark.parametrize("head", [alignment.HEAD, 20, 0])
def test_agrees_with_byte_offsets(spark, monkeypatch, head):
    monkeypatch.setattr(alignment, "HEAD", head)
    monkeypatch.setattr(alignment, "BATCH_BYTES", 200)
    monkeypatch.setattr(alignment, "COUNTED", 50)
    given = texts()
    want = [(at, *row) for at, row in enumerate(plain(given))]
    got = alignment.aligned(make(spark, [(i, t, "en", "a") for i, t in enumerate(given)]).repartition(2), BYTES, PIECES).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == want
    assert sum(row[1] > 0 for row in want) > 50


def test_odd_rows(spark, odd, none):
    got = alignment.aligned(odd, BYTES, PIECES).collect()
    assert len(got) == odd.count()
    want = plain([r.text for r in odd.collect()])
    assert sorted(tuple(r[c] for c in COLUMNS[1:]) for r in got) == sorted(want)
    assert alignment.aligned(none, BYTES, PIECES).collect() == []


def test_groups_by_hand():
    found = alignment.coalesced(np.array([2, 3, 1]), np.array([1, 1, 2, 2]))
    assert found.order.tolist() == [0, 3, 4, 1, 2, 5, 6] and found.group.tolist() == [0, 0, 0, 1, 1, 1, 1]
    assert (found.left.tolist(), found.right.tolist()) == ([0, 2], [1, 3])


def test_one_very_long_text():
    sides = alignment._sides(open(BYTES, encoding="utf-8").read(), open(PIECES, "rb").read())
    text = "many words of it, " * 30000 + "x" * 20000
    out = alignment.align([text, None, "a"], sides)
    assert out["n_groups"][0] > 100000 and out["groups"][1] == "" and out["n_links"][2] == 1
