"""Secret scans: candidates by pattern, judged by how many owners hold the same value. Built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import let
from tidewire.session import Scratch

#: Owners that may share a live value however few owners there are, and characters of context that tell uses apart.
MAX_OWNERS, CONTEXT = 2, 24
MARK = "[SECRET]"


@dataclass(frozen=True)
class Kind:
    """``pattern`` finds candidates, group ``value`` is the secret; a value shorter than ``least`` is none.

    Base kinds are always spans; the others only if their value is live. ``mixed`` asks for upper and lower case and digits.
    """

    name: str
    pattern: str
    value: int = 0
    least: int = 1
    base: bool = True
    mixed: bool = False


# Patterns of secrets. A run of at least n characters is the same as a whole run whose length is checked; only the
# value of an assignment has to be matched first and measured after.
KINDS = (
    Kind("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", value=1, least=6),
    Kind("access", r"AKIA[A-Z0-9]{16,}"),
    Kind("hex", r"[0-9a-f]{24,}"),
    Kind("vendor", r"gh[oprsu]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}"
                   r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", base=False),
    Kind("opaque", r"[A-Za-z0-9+/_-]{32,}", base=False, mixed=True),
)
PLACEHOLDER = r"(?i)example|changeme|placeholder|dummy|sample|your|xxxx|\*\*\*\*"
_FOUND = "array<struct<kind:int,n:int,gap:int,match:string,value:string,before:string,after:string>>"
_ROW = ("doc_id", "digest", "owner")


def _found(text: Column, number: int, kind: Kind) -> Column:
    """Matches of one kind in order, each with the length of the text before it since the last one and the characters around it."""
    pattern = F.lit(kind.pattern)

    def placed(gaps: Column) -> Column:
        values = F.regexp_extract_all(text, pattern, F.lit(kind.value))
        return let(values, lambda vs: F.transform(
            F.regexp_extract_all(text, pattern, F.lit(0)),
            lambda m, i: F.struct(F.lit(number).alias("kind"), i.alias("n"), F.length(F.get(gaps, i)).alias("gap"), m.alias("match"),
                                  F.get(vs, i).alias("value"),
                                  F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("after"))))

    return F.when(text.rlike(kind.pattern), let(F.split(text, kind.pattern), placed)).otherwise(F.array().cast(_FOUND)).cast(_FOUND)


def _scanned(docs: DataFrame, key: str, text: str, repo: Column, owner: Column, kinds: tuple[Kind, ...]) -> DataFrame:
    """(doc_id, digest, owner, repo, found): a row for each document, its text read once."""
    body = F.coalesce(docs[text], F.lit(""))
    found = F.concat(*[_found(body, number, kind) for number, kind in enumerate(kinds)])
    return docs.select(docs[key].alias("doc_id"), F.xxhash64(body).alias("digest"), owner.cast("string").alias("owner"),
                       repo.cast("string").alias("repo"), found.alias("found"))


def looks_live(value: Column) -> Column:
    """Enough different characters, and no word of a placeholder."""
    return (F.size(F.array_distinct(F.regexp_extract_all(value, F.lit("."), F.lit(0)))) >= 6) & ~value.rlike(PLACEHOLDER)


def _same_row(left: DataFrame, right: DataFrame) -> Column:
    return ((left["doc_id"].eqNullSafe(right["doc_id"])) & (left["digest"] == right["digest"])
            & left["owner"].eqNullSafe(right["owner"]))


def _candidates(scanned: DataFrame, kinds: tuple[Kind, ...]) -> DataFrame:
    """A row for each candidate with its place; rows that repeat a document and its text count once."""
    rows = scanned.where(F.size("found") > 0).select(*_ROW, "repo", F.explode("found").alias("m")).select(*_ROW, "repo", "m.*").distinct()
    before = Window.partitionBy(*_ROW, "repo", "kind").orderBy("n")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("start", F.col("end") - F.length("match"))
    least = F.array(*[F.lit(k.least) for k in kinds])
    mixed = F.array(*[F.lit(k.mixed) for k in kinds])
    value = F.col("value")
    holds = (F.length(value) >= F.get(least, F.col("kind"))) & (
        ~F.get(mixed, F.col("kind")) | value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]"))
    return rows.where(holds).select(*_ROW, "repo", "kind", "start", "end", F.sha2(value, 256).alias("hash"), looks_live(value).alias("looks_live"), "before", "after")


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, owners, repos, uses) over the whole corpus.

    Repositories are all distinct ones that hold the value. Owners are those of its uses, and uses do not stem from each other:
    copies of a text count once, and so do texts with the same characters before the value or after it, as near copies have
    (the side that leaves fewer counts). A use has one owner, the smallest; null is one. Everything is counted by owner or text
    first, so a value that a third of all documents hold is spread over them and only counts meet.
    """
    held = candidates.select("hash", "owner", "repo").distinct()
    found = held.groupBy("hash", "owner").agg(F.count("*").alias("repos")).groupBy("hash").agg(F.sum("repos").alias("repos"))
    texts = candidates.groupBy("hash", "digest").agg(*[F.min(name).alias(name) for name in ("before", "after", "owner")])
    for side in ("before", "after"):
        by_owner = texts.groupBy("hash", side).agg(F.min("owner").alias("owner")).groupBy("hash", "owner").agg(F.count("*").alias("uses"))
        found = found.join(by_owner.groupBy("hash").agg(F.count("*").alias(f"owners_{side}"), F.sum("uses").alias(f"uses_{side}")), "hash")
    return found.select("hash", "repos", *[F.least(f"{name}_before", f"{name}_after").alias(name) for name in ("owners", "uses")])


def sharing_limit(owners: int, least: int = MAX_OWNERS) -> int:
    """Owners up to which a value may be shared and still be theirs: the whole binary logarithm of all owners, at least ``least``."""
    return max(least, owners.bit_length() - 1)


def judged(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", repo: Column | None = None,
           owner: Column | None = None, max_owners: int = MAX_OWNERS, kinds: tuple[Kind, ...] = KINDS) -> tuple[DataFrame, DataFrame]:
    """The scanned documents and their judged candidates, both written tables.

    A candidate is ``copied`` if unlike texts of more than :func:`sharing_limit` owners hold its value, ``live`` if not and it looks
    like a real credential, else ``weak``. So the limit grows with the owners of the corpus, and copies of one document, however
    many, make no example of its keys.
    """
    repo = docs[key] if repo is None else repo
    owner = docs["source"] if owner is None else owner
    scanned = scratch.keep(_scanned(docs, key, text, repo, owner, kinds))
    candidates = scratch.keep(_candidates(scanned, kinds))
    limit = sharing_limit(scanned.groupBy("owner").agg(F.lit(1)).count(), max_owners)
    counts = scratch.keep(ownership(candidates))
    status = F.when(F.col("owners") > limit, "copied").when(F.col("looks_live"), "live").otherwise("weak")
    found = scratch.keep(candidates.join(counts, "hash").withColumn("status", status).drop("looks_live", "repo", "before", "after"))
    scratch.drop(candidates, counts)
    return scanned, found


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", repo: Column | None = None, owner: Column | None = None,
          max_owners: int = MAX_OWNERS, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(doc_id, spans) of every row: structs of kind, start, end, hash, owners, uses, repos and status, by start and kind.

    Null and empty texts have no spans. Rows without an id or owner are scanned like others; equal rows get equal spans, and so do
    rows that differ in their repository alone; an empty table gives no rows. Texts are scanned whole and once; other columns of
    ``docs`` do not matter.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    scanned, found = judged(docs, scratch, key, text, repo, owner, max_owners, kinds)
    base = F.array(*[F.lit(k.base) for k in kinds])
    kept = found.where(F.get(base, F.col("kind")) | (F.col("status") == "live"))
    # a set: rows that differ in their repository alone have the same spans
    each = kept.groupBy(*_ROW).agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end", "hash", "owners", "uses", "repos", "status"))).alias("spans"))
    rows = scanned.select(*_ROW)
    joined = rows.join(each, _same_row(rows, each), "left")
    return joined.select(rows["doc_id"], F.coalesce("spans", F.array().cast(each.schema["spans"].dataType)).alias("spans"))


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text", repo: Column | None = None, owner: Column | None = None,
             max_owners: int = MAX_OWNERS, mark: str = MARK, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with every live secret in its text replaced by ``mark``; copied examples and other text stay.

    A value is an example if unlike texts of many owners hold it, so copies of a document keep none of its keys. Null texts stay null,
    empty ones empty; rows without an id or owner and repeated rows are treated like others, each by itself; texts of any
    length are taken whole; an empty table gives no rows. All columns of ``docs`` are returned as they are but the text.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    owner = docs["source"] if owner is None else owner
    _, found = judged(docs, scratch, key, text, repo, owner, max_owners, kinds)
    before = Window.partitionBy(*_ROW).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    live = found.where("status = 'live'").withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0)))
    # Overlapping spans are one: only the first of them ends the text kept before.
    pieces = F.array_sort(F.collect_list(F.when(F.col("start") >= F.col("reached"), F.struct("start", "reached"))))
    cuts = scratch.keep(live.groupBy(*_ROW).agg(pieces.alias("pieces"), F.max("end").alias("last")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), docs[key].alias("key"), docs[text].alias("text"),
                       F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("row_digest"), owner.cast("string").alias("row_owner"))
    joined = rows.join(cuts, rows["key"].eqNullSafe(cuts["doc_id"]) & (rows["row_digest"] == cuts["digest"])
                       & rows["row_owner"].eqNullSafe(cuts["owner"]), "left")
    body = rows["text"]
    kept = F.array_join(F.transform("pieces", lambda p: F.concat(F.substr(body, p["reached"] + 1, p["start"] - p["reached"]), F.lit(mark))), "")
    clean = F.when(F.col("pieces").isNull(), body).otherwise(F.concat(kept, F.substr(body, F.col("last") + 1)))
    return joined.select(*[clean.alias(name) if name == text else F.col("row")[name].alias(name) for name in docs.columns])
