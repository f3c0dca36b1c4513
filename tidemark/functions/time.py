"""Time codes and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ms(seconds) -> Column:
    return F.round(seconds * 1000).cast("long")


def to_ms(seconds) -> Column:
    """Seconds as whole milliseconds."""
    return _ms(seconds)


def _parts(ms) -> tuple[Column, Column, Column, Column]:
    return F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000


def format_ms(ms, separator: str = ".") -> Column:
    """HH:MM:SS.mmm of whole milliseconds (separator "," for subtitles)."""
    h, m, s, r = _parts(ms)
    return F.format_string(f"%02d:%02d:%02d{separator}%03d", h, m, s, r)


def format_time(seconds) -> Column:
    return format_ms(_ms(seconds))


def cue(ms) -> Column:
    """MM:SS.s"""
    tenths = F.floor(ms / 100)
    return F.format_string("%02d:%02d.%d", F.floor(tenths / 600), F.floor(tenths / 10) % 60, tenths % 10)


def minutes(ms) -> Column:
    """MM:SS.mmm with minutes beyond 59."""
    return F.format_string("%02d:%02d.%03d", F.floor(ms / 60_000), F.floor(ms / 1000) % 60, ms % 1000)


def clock(ms) -> Column:
    """Compact clock: H:MM:SS from an hour on, else M:SS."""
    h, m, s, _ = _parts(ms)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def frames(ms, fps: int) -> Column:
    """HH:MM:SS:FF at a whole number of frames a second."""
    n = F.floor((ms * fps + 500) / 1000).cast("long")
    s = F.floor(n / fps)
    return F.format_string("%02d:%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, n % fps)


def parse_time(text) -> Column:
    """Seconds of "S", "MM:SS" or "HH:MM:SS" (fractions allowed); null if it isn't a time."""
    p = F.split(F.trim(text), ":")
    sec, mnt, hrs = (F.try_element_at(p, F.lit(-k)) for k in (1, 2, 3))
    num = r"^\d+(?:[.,]\d+)?$"
    ok = (F.size(p) <= 3) & sec.rlike(num) & F.coalesce(mnt.rlike(r"^\d+$"), F.lit(True)) & F.coalesce(hrs.rlike(r"^\d+$"), F.lit(True))
    value = F.regexp_replace(sec, ",", ".").try_cast("double") + 60 * F.coalesce(mnt.try_cast("double"), F.lit(0.0)) + 3600 * F.coalesce(hrs.try_cast("double"), F.lit(0.0))
    return F.when(ok, value)


def goto(text, now, duration) -> Column:
    """Absolute or relative (+/-) time expression, clamped to [0, duration]."""
    t = F.trim(text)
    sign = F.when(t.startswith("+"), 1).when(t.startswith("-"), -1)
    value = parse_time(F.regexp_replace(t, "^[+-]", ""))
    at = F.when(sign.isNotNull(), now + sign * value).otherwise(value)
    return F.greatest(F.lit(0.0), F.least(at, duration))


def frame_step(fps) -> Column:
    """Length of a frame; 30 a second where unknown."""
    return 1 / F.coalesce(F.nullif(fps, F.lit(0)), F.lit(30))


def track_name(position) -> Column:
    """0 is A, 25 is Z, 26 is AA and so on, up to three letters; beyond ZZZ the first of the three goes on with the characters after Z."""
    letter = lambda n: F.decode(F.unhex(F.lpad(F.hex((65 + n).cast("long")), 8, "0")), "UTF-32")
    two = position - 26
    three = position - 702
    return (
        F.when(position < 26, letter(position))
        .when(position < 702, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))
    )


def track_number(name) -> Column:
    return F.regexp_extract(name, r"^[A-Za-z](\d+)$", 1).try_cast("int")


def ranges_summary(ranges, start: str = "t_ini", end: str = "t_fin") -> Column:
    """One range, one point, or how many ranges."""
    n = F.size(ranges)
    a, b = ranges[0][start], ranges[0][end]
    one = F.when(a == b, clock(a)).otherwise(F.concat(clock(a), F.lit("-"), clock(b)))
    return F.when(n == 1, one).otherwise(F.concat(n.cast("string"), F.lit(" ranges")))
