import random
import re

import numpy as np

from tests.llm.conftest import make
from tidewire.llm import pii


def plain(text):
    """The base rules by Python's own patterns."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(d) for d in re.findall("[0-9]", m[0])][::-1]
        total = sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])
        out += [(m.start(), 2, m.end())] if 12 <= len(digits) <= 19 and total % 10 == 0 else []
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out)


PARTS = ["a", "b.", "@", "@c.d", "1", "12", ".", "255", "256", "+1", "(", "-", " ", "4111 1111", "1111 1111 ", "é", "_", "9", "٣", "\n"]


def test_base_spans_agree_with_plain_python():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 14)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    for part in ("a", "1", "a@", "1.", "+1", "1-", "(at)", "Mr Aa "):
        pii.base_spans(part * 50_000)
        pii.loose_spans(part * 5_000)


def test_em_finds_the_reliable_labelers():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.4
    said = np.stack([np.where(rng.random(4000) < right, np.where(truth, pii.YES, pii.NO), np.where(truth, pii.NO, pii.YES))
                     for right in (0.95, 0.9, 0.9, 0.55)], axis=1)
    found = pii.reliabilities(np.zeros(4000, int), said, np.ones(4000))
    assert ((found > 0.5) == truth).mean() > 0.95


def texts():
    rows = [f"write to person{i}@mail{i % 3}.com or call +1 (359) 555-37{i % 90 + 10}, server 10.0.{i % 200}.7, card 4111 1111 1111 1111" for i in range(40)]
    rows += [f"contact person{i} (at) mail{i % 3} (dot) org, phone 030 555 {1000 + i}" for i in range(40)]
    rows += [f"version 300.400.{i}.999 order 1234567890123{i % 9}" for i in range(40)]
    return rows


def test_added_spans(spark):
    docs = make(spark, [(i, t, "en", "s") for i, t in enumerate(texts())])
    found = {r.doc_id: r.spans for r in pii.detected(docs).collect()}
    for i, text in enumerate(texts()):
        assert [(s.start, s.kind, s.end) for s in found[i] if s.base] == plain(text)
    added = [text[s.start:s.end] for i, text in enumerate(texts()) for s in found[i] if not s.base]
    assert any("(at)" in a for a in added) and not any("300.400" in a for a in added)


WORDS = "river hill stone morning letter garden winter market bridge window silver harbour".split()


def planted(rng, n=600):
    """(text, personal spans that no base pattern finds): carriers, and decoys that look alike."""
    for i in range(n):
        fill = lambda: " ".join(rng.choices(WORDS, k=8))
        digits = lambda k: "".join(rng.choices("0123456789", k=k))
        last = rng.choice(["Garrison", "Whitfield", "Okafor", "Lindqvist", "Moreau"])
        true, text = [
            (v := f"{rng.choice(WORDS)}{i} (at) {rng.choice(WORDS)} (dot) org", f"please write to {v} about the {fill()}"),
            (v := f"030 555 {digits(4)}", f"{fill()}, phone {v}"),
            (v := f"{digits(3)}-{digits(2)}-{digits(4)}", f"her SSN {v} is on file, {fill()}"),
            (v := f"Mr. {last}", f"yesterday {v} {fill()}"),
            (v := f"{rng.choice(sorted(pii.FIRST_NAMES))} {last}", f"the letter was signed by {v} {fill()}"),
            (v := f"Tamsin {last}", f"Dear {v} , {fill()}"),
            (None, f"order 300.400.{digits(3)}.999 and ticket {digits(13)}0 {fill()}"),
            (None, f"see page {digits(4)} {digits(4)} of the hotel {fill()}"),
            (None, f"The {last} Bridge over the {fill()}"),
            (None, f"mail user{i}@host{i % 7}.org or +49 (30) 555-{digits(4)}, card 4111 1111 1111 1111, {fill()}"),
        ][i % 10]
        yield text, true


def test_recall_and_precision_of_added_spans(spark):
    rows = list(planted(random.Random(6)))
    found = {r.doc_id: r.spans for r in pii.detected(make(spark, [(i, t, "en", "s") for i, (t, _) in enumerate(rows)])).collect()}
    added = [(i, rows[i][0][s.start:s.end]) for i in found for s in found[i] if not s.base]
    wanted = [(i, true) for i, (_, true) in enumerate(rows) if true]
    right = [(i, span) for i, span in added if rows[i][1] and (rows[i][1] in span or span in rows[i][1])]
    assert len({i for i, _ in right}) >= 0.9 * len(wanted), (len(right), len(wanted))
    assert len(right) >= 0.95 * len(added), [a for a in added if a not in right][:5]


def test_cues_are_whole_words():
    assert pii.votes("hotel 030 555 1234", 6, 3, 18, False)[3] == pii.ABSTAIN and pii.votes("tel 030 555 1234", 4, 3, 16, False)[3] == pii.YES
    assert pii.votes("ship 10.0.0.1", 5, 1, 13, True)[3] == pii.ABSTAIN


def test_account_numbers_are_checked():
    good = "DE89 3704 0044 0532 0130 00"
    assert pii.votes(good, 0, 5, len(good), False)[1] == pii.YES and pii.votes(good[:-1] + "1", 0, 5, len(good), False)[1] == pii.NO


def test_odd_rows(odd, none):
    rows = pii.detected(odd).collect()
    assert len(rows) == odd.count() and not any(r.spans for r in rows)
    assert pii.detected(none).count() == 0
