"""Personal data by weak supervision.

Patterns propose spans; labelers (strict patterns, checksums, gazetteers, context and shape) vote on each or abstain; expectation
maximisation estimates how reliable each labeler is from the votes on all spans of the corpus; the resulting soft labels train a
logistic classifier of spans by votes, make-up and the word before, which decides about every span that is no base match. Base
matches always stay.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewire.session import Scratch

KINDS = ("email", "ip", "card", "phone", "name", "number")
BASE_KINDS = 4
THRESHOLD = 0.5

# The base patterns and limits of personal data.
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (12, 19), (9, 15)

# What the looser proposals and the labelers go by.
LOOSE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,63}"
                         r"(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{2,63}){1,4}", re.I)
LOOSE_PHONE = re.compile(r"(?<![\w.+-])\(?[0-9]{2,5}\)?(?:[\x20./-]\(?[0-9]{2,5}\)?){1,5}(?![\w-])")
NUMBER = re.compile(r"(?<![\w-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?)(?![\w-])")
NAME = re.compile(r"(?<!\w)[A-Z][a-zà-ÿ]{1,24}\.?(?:\x20[A-Z][a-zà-ÿ]{1,24}){1,3}(?!\w)")
TITLES = frozenset("Mr Mrs Ms Dr Prof Herr Frau Mme Mlle Sr Sra Señor Señora Monsieur Madame".split())
FIRST_NAMES = frozenset("""James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph
Jessica Thomas Sarah Charles Karen Daniel Lisa Matthew Nancy Anthony Betty Mark Sandra Paul Ashley Peter Hans Anna Klaus Ursula Wolfgang
Jean Marie Pierre Nathalie Michel Isabelle José María Juan Carmen Antonio Ana Luis Laura""".split())
KNOWN_ENDS = frozenset("com org net edu gov io de fr es eu uk us info biz ch at it nl ca au".split())
CUES = {name: re.compile(rf"(?<!\w)(?:{words})(?!\w)", re.I) for name, words in {
    "email": r"e-?mail\w*|mail|contact\w*|write|reach|kontakt\w*|correo|courriel",
    "ip": r"ip|host|server|address|login|client|adresse",
    "card": r"card|visa|mastercard|amex|payment|karte|carte|tarjeta",
    "phone": r"phone|tel|telefon|telephone|call|mobile|fax|cell|ruf\w*|anruf\w*|appel\w*|llam\w*|contact",
    "name": r"name|named|dear|regards|signed|sincerely|contact|mit freundlichen",
    "number": r"ssn|social|iban|account|konto|passport|cuenta|compte",
}.items()}
NAME_CUES = re.compile(r"(?<!\w)(?:name is|named|name:|dear|regards,|sincerely,|signed by|signed|contact)\x20$", re.I)
LEADS = frozenset("Dear Regards Sincerely Signed Contact Name".split())
NEGATIVE_CUES = re.compile(r"(?<!\w)(?:version|isbn|issn|order|invoice|figure|page|section|chapter|rfc|ticket|sku|build)(?!\w)|[$€]", re.I)
PLACEHOLDERS = ("0000000", "1111111", "1234567", "9999999", "foo@", "test@")
_DIGIT = re.compile(r"[0-9]")
_CONTEXT = 40
_WORD = re.compile(r"\w+")
#: Buckets of the word before a span, and patterns that the classifier is fitted on at most, the most frequent ones.
WORDS, FIT_PATTERNS = 32, 65_536


def luhn(digits: str) -> bool:
    total = 0
    for place, char in enumerate(reversed(digits)):
        value = int(char) * (2 if place % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _iban(body: str) -> bool:
    """Remainder 1 of the number that its characters make, the first four moved to the end, letters as 10 to 35."""
    moved = body.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in moved[4:] + moved[:4])) % 97 == 1


def _at_most_255(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ to the left as far as the last match, to the right the domain: linear in the text whatever it holds."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        found = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = at = found.end()
        else:
            at += 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, by start and kind."""
    found = [(start, 0, end) for start, end in _emails(text)]
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_at_most_255, m.group().split(".")))]
        for m in CARD.finditer(text):
            digits = _digits(m.group())
            if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                found.append((m.start(), 2, m.end()))
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if PHONE_DIGITS[0] <= len(_digits(m.group())) <= PHONE_DIGITS[1]]
    return sorted(found)


def loose_spans(text: str, first_names: frozenset[str] = FIRST_NAMES) -> list[tuple[int, int, int]]:
    """Further proposals, of all kinds."""
    found = [(m.start(), 0, m.end()) for m in LOOSE_EMAIL.finditer(text)] if "(" in text or "[" in text or "{" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(_digits(m.group())) <= 19]
        found += [(m.start(), 3, m.end()) for m in LOOSE_PHONE.finditer(text) if 7 <= len(_digits(m.group())) <= 15]
        found += [(m.start(), 5, m.end()) for m in NUMBER.finditer(text)]
    for m in NAME.finditer(text):
        words = m.group().replace(".", "").split(" ")
        if words[0] in LEADS and len(words) > 2:
            found.append((m.start() + m.group().index(" ") + 1, 4, m.end()))
        elif words[0] in TITLES or words[0] in first_names or NAME_CUES.search(text, max(0, m.start() - 16), m.start()):
            found.append((m.start(), 4, m.end()))
    return found


LABELERS = ("strict pattern", "checksum", "gazetteer", "context", "shape", "neighbours")
ABSTAIN, NO, YES = 0, 1, 2


def votes(text: str, start: int, kind: int, end: int, strict: bool, first_names: frozenset[str] = FIRST_NAMES) -> tuple[int, ...]:
    """What each of ``LABELERS`` says of one span."""
    body, name = text[start:end], KINDS[kind]
    digits = _digits(body)
    if name == "card":
        check = YES if 12 <= len(digits) <= 19 and luhn(digits) else NO
    elif name == "ip":
        check = YES if all(map(_at_most_255, body.split("."))) else NO
    elif name == "phone":
        check = ABSTAIN if 9 <= len(digits) <= 15 else NO
    elif name == "number" and body[0] > "9":
        check = YES if _iban(body) else NO
    else:
        check = ABSTAIN
    listed = ABSTAIN
    if name == "email":
        listed = YES if re.split(r"[.)\]\x20]", body.lower())[-1] in KNOWN_ENDS else NO
    elif name == "name":
        first = body.replace(".", "").split(" ")
        listed = YES if first[0] in first_names or len(first) > 1 and first[1] in first_names else ABSTAIN
    place = max(0, start - _CONTEXT)
    context = YES if CUES[name].search(text, place, start) else NO if NEGATIVE_CUES.search(text, place, start) else ABSTAIN
    if name == "name" and body.split(" ")[0].rstrip(".") in TITLES:
        context = YES
    low = body.lower()
    shape = NO if len(set(digits)) == 1 and len(digits) > 5 or any(p in low for p in PLACEHOLDERS) else ABSTAIN
    left, right = text[start - 1:start], text[end:end + 1]
    beside = NO if left.isalnum() or right.isalnum() or left in "=/_#" and left or right in "=/_%" and right else ABSTAIN
    return YES if strict else ABSTAIN, check, listed, context, shape, beside


_TAIL = 4 * 8 * WORDS * 4 * 3


def pattern_of(text: str, start: int, kind: int, end: int, strict: bool, first_names: frozenset[str] = FIRST_NAMES) -> int:
    """All that the classifier sees of a span in one number: kind and votes, then length, separators, the word before by its hash,
    the part of digits and the character before."""
    found = kind
    for vote in votes(text, start, kind, end, strict, first_names):
        found = found * 3 + vote
    body = text[start:end]
    length = min(3, (end - start) // 8)
    marks = sum(1 << i for i, mark in enumerate((" ", "-", ".")) if mark in body)
    said = _WORD.findall(text, max(0, start - _CONTEXT), start)
    word = 1 + zlib.crc32(said[-1].lower().encode("utf-8", "replace")) % (WORDS - 1) if said else 0
    digits = len(_digits(body))
    part = 0 if not digits else 3 if digits == len(body) else 1 if 2 * digits < len(body) else 2
    left = text[start - 1:start]
    beside = 0 if not left or left.isspace() else 1 if left in "([{<\"':;," else 2
    return ((((found * 4 + length) * 8 + marks) * WORDS + word) * 4 + part) * 3 + beside


def _voted(votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kinds and votes out of the first part of patterns."""
    said = []
    for _ in LABELERS:
        votes, vote = np.divmod(votes, 3)
        said.append(vote)
    return votes, np.stack(said[::-1], axis=1)


def _groups(kinds: np.ndarray, said: np.ndarray) -> np.ndarray:
    """Spans that share a part of true ones: base matches and looser proposals of a kind apart."""
    return kinds * 2 + (said[:, 0] == YES)


def reliabilities(groups: np.ndarray, said: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """EM: the probability that each pattern's spans are personal data.

    Hidden is whether a span is; given that, labelers that do not abstain vote independently, each with its own chances of yes and
    no, and every group has its own share of true spans. To abstain says nothing. It starts from the votes, no votes being less
    than even.
    """
    yes, no = (said == YES).sum(axis=1), (said == NO).sum(axis=1)
    true = (yes + 0.5) / (yes + no + 1.5)
    there = np.bincount(groups, weights=weight) + 2
    for _ in range(rounds):
        log = np.zeros((len(said), 2))
        for side, share in enumerate((1 - true, true)):
            mass = weight * share
            for labeler in range(said.shape[1]):
                chance = np.bincount(said[:, labeler], weights=mass, minlength=3)[1:] + 1
                log[:, side] += np.r_[0.0, np.log(chance / chance.sum())][said[:, labeler]]
            log[:, side] += np.log((np.bincount(groups, weights=mass) + 1) / there)[groups]
        true = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    return true


def _features(patterns: np.ndarray) -> np.ndarray:
    kinds, said = _voted(patterns // _TAIL)
    rest, beside = np.divmod(patterns % _TAIL, 3)
    rest, part = np.divmod(rest, 4)
    rest, word = np.divmod(rest, WORDS)
    length, marks = np.divmod(rest, 8)
    parts = [np.eye(len(KINDS))[kinds], np.eye(4)[length], np.stack([marks >> i & 1 for i in range(3)], axis=1),
             np.eye(WORDS)[word], np.eye(4)[part], np.eye(3)[beside]]
    parts += [np.eye(3)[said[:, i]][:, 1:] for i in range(said.shape[1])]
    return np.concatenate([*parts, np.ones((len(kinds), 1))], axis=1)


@dataclass
class SpanClassifier:
    weights: np.ndarray

    def probability(self, patterns: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_features(patterns) @ self.weights, -50, 50)))


def fit(patterns: np.ndarray, count: np.ndarray, soft: np.ndarray, rounds: int = 30, penalty: float = 1.0) -> SpanClassifier:
    """Logistic regression on the soft labels, by Newton steps over patterns weighted by their counts."""
    weight, x = count.astype(float), _features(patterns)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (weight * (p - soft)) + penalty * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return SpanClassifier(w)


def learned(rows: DataFrame, most: int = FIT_PATTERNS) -> SpanClassifier | None:
    """The classifier of the proposals in ``rows``: reliabilities from the votes on all of them, of which there are a few thousand
    patterns at the very most; the logistic fit from the ``most`` frequent full patterns. None without proposals."""
    each = rows.select(F.explode("spans").alias("s")).groupBy(F.col("s.pattern").alias("pattern")).count()
    voted = each.groupBy(F.expr(f"pattern div {_TAIL}").alias("votes")).agg(F.sum("count").alias("count")).orderBy("votes").collect()
    if not voted:
        return None
    votes = np.array([row["votes"] for row in voted], np.int64)
    kinds, said = _voted(votes)
    true = reliabilities(_groups(kinds, said), said, np.array([row["count"] for row in voted], float))
    top = each.orderBy(F.desc("count"), "pattern").limit(most).collect()
    patterns = np.array([row["pattern"] for row in top], np.int64)
    return fit(patterns, np.array([row["count"] for row in top]), true[np.searchsorted(votes, patterns // _TAIL)])


_SPAN = "array<struct<start:bigint,kind:int,end:bigint,base:boolean,pattern:bigint>>"
_ARROW_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_()), ("pattern", pa.int64())]))


def proposed(docs: DataFrame, key: str = "doc_id", text: str = "text", first_names: frozenset[str] = FIRST_NAMES) -> DataFrame:
    """(doc_id, spans): base matches and further proposals of each whole text, with the pattern of their votes."""
    rows = docs.select(docs[key].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    kind, key_type = dict(rows.dtypes)["doc_id"], to_arrow_type(rows.schema["doc_id"].dataType)

    def spans_of(text: str) -> list[dict]:
        base = base_spans(text)
        strict = set(base)
        # Proposals that touch a base match add nothing. Bases by start, with the furthest end up to each.
        starts = [start for start, _, _ in base]
        reach = list(accumulate((end for _, _, end in base), max))
        more = [span for span in sorted(set(loose_spans(text, first_names)) - strict)
                if not (at := bisect_left(starts, span[2])) or reach[at - 1] <= span[0]]
        return [{"start": s, "kind": k, "end": e, "base": b, "pattern": pattern_of(text, s, k, e, b, first_names)}
                for group, b in ((base, True), (more, False)) for s, k, e in group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans_of(value.as_py()) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(key_type), pa.array(found, _ARROW_SPAN)], ["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id {kind}, spans {_SPAN}")


def detected(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
             first_names: frozenset[str] = FIRST_NAMES) -> DataFrame:
    """(doc_id, spans) of every row: start, kind, end, base and probability of each span kept, by start and kind.

    Patterns are counted over all spans of the corpus; only counts come to the driver, see :func:`learned`. ``first_names`` is the
    gazetteer of names. Null and empty texts have no spans; repeated rows have equal spans and count each; an empty table gives no rows. Other
    columns do not matter. Positions are code points, the end excluded.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    rows = scratch.keep(proposed(docs, key, text))
    model = learned(rows)
    key_type = to_arrow_type(rows.schema["doc_id"].dataType)
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, proposals = [], batch.column(1).to_pylist()
            seen = np.array(sorted({s["pattern"] for spans in proposals for s in spans}), np.int64)
            chance = dict(zip(seen.tolist(), model.probability(seen).tolist())) if len(seen) else {}
            for spans in proposals:
                kept, reach = [], 0
                for s in sorted(spans, key=lambda s: (s["start"], s["kind"])):
                    p = chance[s["pattern"]]
                    # Of proposals that overlap, the first one counts.
                    if s["base"] or p >= threshold and s["start"] >= reach:
                        kept.append({"start": s["start"], "kind": s["kind"], "end": s["end"], "base": s["base"], "p": p})
                        reach = max(reach, s["end"])
                found.append(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(key_type), pa.array(found, span)], ["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, "
                                "spans array<struct<start:bigint,kind:int,end:bigint,base:boolean,p:double>>")
