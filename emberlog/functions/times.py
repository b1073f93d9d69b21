"""Timestamps as microseconds since 1970 (long columns), and time zones without the session's."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields that may hold a row's timestamp, in order of preference.
CANDIDATES = ("ts", "time", "timestamp", "@timestamp", "t", "eventTime")
NO_TS = "(no-ts)"
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
_ZONED = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})((?:[.,]\d+)?)(Z|[+-]\d{2}:\d{2})\z"
_NAIVE = r"^(\d{4}-\d{2}-\d{2})(?:T(\d{2}:\d{2}:\d{2})(\z|(?:[.,]\d+)\z)| (\d{2}:\d{2}:\d{2})((?:[.,]\d+)?)\z)"
_SLASHED = r"^(\d{4})/(\d{2})/(\d{2}) (\d{2}:\d{2}:\d{2})((?:[.,]\d+)?)\z"
_RFC1123 = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), (\d{1,2}) ([A-Z][a-z]{2}) (\d{4}) (\d{2}:\d{2}:\d{2}) ([A-Z]{3,4}|[+-]\d{4})\z"
_COMMON_LOG = r"^(\d{2})/([A-Z][a-z]{2})/(\d{4}):(\d{2}:\d{2}:\d{2}) ([+-]\d{4})\z"
_INTEGER = r"^[+-]?\d+\z"


def from_local(column: Column) -> Column:
    """Microseconds of a timestamp without zone, as if it were UTC."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), column)


def to_utc(column: Column) -> Column:
    """Timestamp without zone, in UTC, of microseconds."""
    return F.timestamp_add("MICROSECOND", column.cast("long"), F.expr(_EPOCH))


def local(column: Column, tz: str) -> Column:
    return to_utc(column) if tz == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), to_utc(column))


def _clock(date: Column, time: Column, fraction: Column) -> Column:
    """Microseconds of checked parts as UTC; null where a part is out of range."""
    day = F.try_to_date(date, "yyyy-MM-dd") if hasattr(F, "try_to_date") else date.try_cast("date")
    hour, minute, second = (F.substr(time, F.lit(k), F.lit(2)).cast("int") for k in (1, 4, 7))
    sub = F.when(F.length(fraction) > 1, F.rpad(F.substr(fraction, F.lit(2), F.lit(6)), 6, "0").cast("long")).otherwise(F.lit(0))
    total = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000_000 + (hour * 3600 + minute * 60 + second).cast("long") * 1_000_000 + sub
    return F.when((hour < 24) & (minute < 60) & (second < 60), total)


def _offset(text: Column) -> Column:
    """Microseconds of an offset such as +05:30 or -0800; Z and names of UTC are none."""
    plain = F.regexp_replace(text, ":", "")
    size = (F.substr(plain, F.lit(2), F.lit(2)).cast("long") * 60 + F.substr(plain, F.lit(4), F.lit(2)).cast("long")) * 60_000_000
    return F.when(text.rlike(r"^[+-]"), F.when(text.startswith("-"), -size).otherwise(size)).otherwise(F.lit(0).cast("long"))


def in_zone(column: Column, tz: str) -> Column:
    """Microseconds of a wall clock reading (microseconds as if UTC) in a zone."""
    return column if tz == "UTC" else from_local(F.convert_timezone(F.lit(tz), F.lit("UTC"), to_utc(column)))


def epoch(n: Column) -> Column:
    """Seconds below 1e11, milliseconds below 1e14, else no timestamp."""
    size = F.abs(n)
    return F.when(size < 100_000_000_000, n * 1_000_000).when(size < 100_000_000_000_000, n * 1000)


def parsed(text: Column, tz: str) -> Column:
    """Microseconds of a timestamp text; null where no layout fits. Layouts without a zone are read in tz."""
    part = lambda pattern, k: F.regexp_extract(text, pattern, k)
    month = lambda name: F.lpad(F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), name).cast("string"), 2, "0")
    zoned = _clock(part(_ZONED, 1), part(_ZONED, 2), part(_ZONED, 3)) - _offset(part(_ZONED, 4))
    time = F.concat(part(_NAIVE, 2), part(_NAIVE, 4))
    plain = in_zone(_clock(part(_NAIVE, 1), time, F.concat(part(_NAIVE, 3), part(_NAIVE, 5))), tz)
    slashed = in_zone(_clock(F.concat_ws("-", part(_SLASHED, 1), part(_SLASHED, 2), part(_SLASHED, 3)), part(_SLASHED, 4), part(_SLASHED, 5)), tz)
    mail = _clock(F.concat_ws("-", part(_RFC1123, 3), month(part(_RFC1123, 2)), F.lpad(part(_RFC1123, 1), 2, "0")), part(_RFC1123, 4), F.lit("")) - _offset(part(_RFC1123, 5))
    log = _clock(F.concat_ws("-", part(_COMMON_LOG, 3), month(part(_COMMON_LOG, 2)), part(_COMMON_LOG, 1)), part(_COMMON_LOG, 4), F.lit("")) - _offset(part(_COMMON_LOG, 5))
    return (
        F.when(text.rlike(_ZONED), zoned).when(text.rlike(_NAIVE), plain).when(text.rlike(_SLASHED), slashed).when(text.rlike(_RFC1123), mail).when(text.rlike(_COMMON_LOG), log)
        .when(text.rlike(_INTEGER), epoch(text.try_cast("long")))
    )


def column_micros(column: Column, kind: T.DataType, tz: str) -> Column | None:
    """Microseconds of a typed column, None if its type never holds a timestamp. Timestamps without zone are UTC."""
    if isinstance(kind, T.TimestampNTZType):
        return from_local(column)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.StringType):
        return parsed(column, tz)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return epoch(column.cast("long"))
    return None


def label(column: Column, tz: str) -> Column:
    """RFC 3339 text, to the second, in a zone."""
    wall = local(column, tz)
    text = F.replace(F.substr(wall.cast("string"), F.lit(1), F.lit(19)), F.lit(" "), F.lit("T"))
    if tz == "UTC":
        return F.concat(text, F.lit("Z"))
    minutes = F.timestamp_diff("MINUTE", to_utc(column), wall)
    size = F.abs(minutes)
    sign = F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+"))
    offset = F.concat(sign, F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((size % 60).cast("string"), 2, "0"))
    return F.concat(text, F.when(minutes == 0, F.lit("Z")).otherwise(offset))


DAY = 86_400_000_000


def bucket(column: Column, every: int, tz: str) -> Column:
    """Start of the window that microseconds fall in: multiples of every below a day, whole civil days in tz from a day on."""
    if every < DAY:
        return column - F.pmod(column, F.lit(every))
    n = every // DAY
    day = F.datediff(local(column, tz).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return in_zone((day - F.pmod(day, F.lit(n))) * DAY, tz)


def now_micros(now: datetime | None) -> int:
    at = now or datetime.now(timezone.utc)
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    delta = at - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds
