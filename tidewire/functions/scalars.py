"""Scalar expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NANOS = 1_000_000_000

# Labels by code.
RELIABILITY = {0: "BEST_EFFORT", 1: "RELIABLE"}
DURABILITY = {0: "VOLATILE", 1: "TRANSIENT_LOCAL", 2: "TRANSIENT", 3: "PERSISTENT"}
UNKNOWN = "UNKNOWN"

# Second header byte -> encoding version; the first byte is always 00.
HEADER_VERSIONS = {
    "0000": 1, "0001": 1,
    "0006": 2, "0007": 2, "0008": 2, "0009": 2, "000A": 2, "000B": 2,
}
DEFAULT_HEADER = "00010000"

# Fixed value: entity id of a participant.
PARTICIPANT_ENTITY = "000001c1"


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _labels(code: Column, labels: dict[int, str]) -> Column:
    chain = F
    for value, text in labels.items():
        chain = chain.when(code == value, text)
    return chain.otherwise(UNKNOWN)


def floor_div(value: Column | str, by: int) -> Column:
    """Whole-number division rounding down, exact for all of ``bigint`` (``/`` goes through double)."""
    value = _column(value)
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


def effective_time(source: Column | str, received: Column | str) -> Column:
    source, received = _column(source), _column(received)
    return F.when(source > 0, source).otherwise(received)


def sec_nsec(ns: Column | str) -> Column:
    """Nanoseconds as ``seconds.nnnnnnnnn``; the fraction is never negative."""
    ns = _column(ns)
    fraction = F.pmod(ns, F.lit(NANOS))
    return F.concat(floor_div(ns, NANOS).cast("string"), F.lit("."), F.lpad(fraction.cast("string"), 9, "0"))


def guid_text(guid: Column | str) -> Column:
    """16 bytes as four dotted groups of eight hex digits; null prints as zeros."""
    digits = F.lower(F.hex(F.coalesce(_column(guid), F.unhex(F.lit("00" * 16)))))
    return F.concat_ws(".", *[F.substring(digits, start, 8) for start in (1, 9, 17, 25)])


def participant_guid(endpoint_guid: Column | str) -> Column:
    """Hex GUID of the participant that owns an endpoint."""
    return F.concat(F.substring(_column(endpoint_guid), 1, 24), F.lit(PARTICIPANT_ENTITY))


def qos_labels(df: DataFrame) -> DataFrame:
    history = (F.when(F.col("history_kind") == 0,
                      F.concat(F.lit("KEEP_LAST ("), F.col("history_depth"), F.lit(")")))
               .when(F.col("history_kind") == 1, "KEEP_ALL").otherwise(UNKNOWN))
    return df.withColumns({
        "reliability": _labels(F.col("reliability"), RELIABILITY),
        "durability": _labels(F.col("durability"), DURABILITY),
        "history": history,
    }).drop("history_kind", "history_depth")


def participant_label() -> Column:
    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    process, host, pid, entity = map(text, ("process_name", "hostname", "pid", "entity_name"))
    described = F.concat(
        F.when(process != "", process).otherwise("(unknown)"),
        F.when(pid != "", F.concat(F.lit(" ["), pid, F.lit("]"))).otherwise(""),
        F.when(host != "", F.concat(F.lit(" @ "), host)).otherwise(""))
    return (F.when((process != "") | (host != ""), described)
            .when(entity != "", entity).otherwise("(unknown)"))


# Fixed value: the leading decimal number of a limit text.
_NUMBER = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def _number_and_suffix(text: Column) -> tuple[Column, Column]:
    """The number a text begins with (0 if none) and the character behind it."""
    number = F.regexp_extract(text, _NUMBER, 1).try_cast("double")
    return F.coalesce(number, F.lit(0.0)), F.regexp_extract(text, _NUMBER + "(.)", 2)


def size_bytes(text: Column | str) -> Column:
    """``2G``, ``10M``, ``5k`` or a bare number of megabytes, as bytes."""
    number, suffix = _number_and_suffix(_column(text))
    unit = (F.when(suffix.isin("G", "g"), 1 << 30).when(suffix.isin("k", "K"), 1 << 10)
            .otherwise(1 << 20))
    return (number * unit).cast("long")


def duration_seconds(text: Column | str) -> Column:
    """``5m``, ``2h`` or a bare number of seconds."""
    number, suffix = _number_and_suffix(_column(text))
    return number * F.when(suffix == "m", 60.0).when(suffix == "h", 3600.0).otherwise(1.0)


def encapsulation(payload: Column | str) -> Column:
    """Payload header as ``struct(valid, version, big_endian)``."""
    head = F.hex(F.substring(_column(payload), 1, 2))
    versions = F.create_map(*[F.lit(x) for pair in HEADER_VERSIONS.items() for x in pair])
    version = F.when(F.length(head) == 4, F.element_at(versions, head))
    last_digit = F.conv(F.substring(head, 4, 1), 16, 10).cast("int")
    return F.struct(
        version.isNotNull().alias("valid"),
        version.alias("version"),
        F.when(version.isNotNull(), last_digit % 2 == 0).alias("big_endian"))


def framed(payload: Column | str) -> Column:
    """Payload with a valid header: one of at least 4 bytes that lacks it gets the default in front."""
    payload = _column(payload)
    headless = (F.octet_length(payload) >= 4) & ~encapsulation(payload)["valid"]
    return F.when(headless, F.concat(F.unhex(F.lit(DEFAULT_HEADER)), payload)).otherwise(payload)


def type_path(type_name: Column | str) -> Column:
    """``a::b::C`` as ``struct(modules, short_name)``."""
    parts = F.split(_column(type_name), "::")
    return F.struct(
        F.slice(parts, F.lit(1), F.size(parts) - 1).alias("modules"),
        F.element_at(parts, -1).alias("short_name"))


def array_len(dims: Column | str) -> Column:
    return F.aggregate(_column(dims), F.lit(1).cast("long"), lambda total, size: total * size)


def recording_name(prefix: Column | str, start: Column | None = None, split: Column | None = None) -> Column:
    """``prefix[_YYYY-MM-DD-HH-MM-SS][_split].mcap``."""
    parts = [_column(prefix)]
    if start is not None:
        parts.append(F.date_format(start, "'_'yyyy-MM-dd-HH-mm-ss"))
    if split is not None:
        parts += [F.lit("_"), split.cast("string")]
    return F.concat(*parts, F.lit(".mcap"))
