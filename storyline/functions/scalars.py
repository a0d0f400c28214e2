"""Scalar column expressions.  All of them stay inside Catalyst."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import word_count

# Fixed values of the data format (must equal the reference's).
SAMPLE_RATE = 24_000          # samples per second, 16-bit mono
BYTES_PER_MS = 48             # 24,000 samples * 2 bytes / 1000
WORDS_PER_MINUTE = 165.0
KEY_SEPARATOR = "\u001f"
KEY_FORMAT_TAG = "24000s16le-edge"
TARGET_LUFS = -16.0
GAIN_MIN_DB = -12.0
GAIN_MAX_DB = 12.0
ON_TARGET_SHARE = 0.05

__all__ = [
    "BYTES_PER_MS", "SAMPLE_RATE", "bytes_to_ms", "content_key",
    "escape_caption", "estimate_duration", "exceeds_cap", "first_truthy",
    "gain_db", "hms", "last_match", "params_hash", "shard_path", "stamp_cs",
    "plan_budget_columns", "word_count",
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bytes_to_ms(nbytes) -> Column:
    """Clock bytes to milliseconds: one division, at the very end."""
    return _col(nbytes).cast("bigint") / F.lit(BYTES_PER_MS)


def stamp_cs(ms) -> Column:
    """``h:mm:ss.cc`` with centiseconds rounded half to even."""
    cs = F.bround(_col(ms).cast("double") / 10.0, 0).cast("bigint")
    return F.format_string(
        "%d:%02d:%02d.%02d",
        F.floor(cs / 360000), F.floor(cs / 6000) % 60,
        F.floor(cs / 100) % 60, cs % 100)


def hms(ms) -> Column:
    """``h:mm:ss``, cutting off the fraction."""
    s = F.floor(_col(ms).cast("double") / 1000.0)
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600),
                           F.floor(s / 60) % 60, s % 60)


def escape_caption(text) -> Column:
    """Braces to parentheses, newline to the two characters ``\\N``."""
    return F.replace(F.translate(_col(text), "{}", "()"), F.lit("\n"), F.lit("\\N"))


def content_key(text, voice, speed=1.0, tag: str = KEY_FORMAT_TAG) -> Column:
    """Content address of a synthesised text.

    The number is written in one canonical form, so 1, 1.0 and "1" give the
    same key.
    """
    speed = speed if isinstance(speed, (str, Column)) else F.lit(speed)
    number = F.regexp_replace(_col(speed).cast("double").cast("string"), r"\.0$", "")
    return F.sha2(F.concat_ws(KEY_SEPARATOR, _col(text), _col(voice), number, F.lit(tag)), 256)


def shard_path(key) -> Column:
    k = _col(key)
    return F.concat(F.substring(k, 1, 2), F.lit("/"), k)


def params_hash(params) -> Column:
    """Hash of a parameter map: key order is irrelevant, unset keys do not count."""
    given = F.map_filter(_col(params), lambda k, v: v.isNotNull())
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(given)))), 256)


def gain_db(measured, target: float = TARGET_LUFS, lo: float = GAIN_MIN_DB,
            hi: float = GAIN_MAX_DB, digits: int | None = 2) -> Column:
    """Clamped gain from measured loudness to target; unmeasured gives 0."""
    gain = F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.lit(float(target)) - _col(measured)))
    if digits is not None:
        gain = F.bround(gain, digits)
    return F.when(_col(measured).isNull(), F.lit(0.0)).otherwise(gain)


def last_match(text, pattern: str, type: str = "string", group: int = 1) -> Column:
    """Last match of ``pattern``, typed; no match gives null."""
    found = F.regexp_extract_all(_col(text), F.lit(pattern), group)
    return F.try_element_at(found, F.lit(-1)).cast(type)


def exceeds_cap(size, cap) -> Column:
    """True only for a known, numeric size strictly over a known cap."""
    if cap is None:
        return F.lit(False)
    known = _col(size).try_cast("bigint")
    return F.coalesce(known > (cap if isinstance(cap, Column) else F.lit(int(cap))), F.lit(False))


def first_truthy(*cols, default=0.0) -> Column:
    """``a or b or default`` for numbers: zero counts as missing."""
    return F.coalesce(*[F.nullif(_col(c), F.lit(0).cast("double")) for c in cols], F.lit(default))


def estimate_duration(words, wpm: float = WORDS_PER_MINUTE) -> Column:
    """Minutes of narration."""
    return _col(words) / F.lit(float(wpm))


def plan_budget_columns(words, target_min, wpm: float = WORDS_PER_MINUTE) -> dict[str, Column]:
    """Needed words, difference and band for a target length in minutes."""
    w = _col(words).cast("bigint")
    target = (F.lit(float(target_min)) if not isinstance(target_min, (str, Column))
              else _col(target_min).cast("double"))
    need = F.floor(target * F.lit(float(wpm)) + 0.5).cast("bigint")   # half up
    diff = w - need
    band = (F.when(w == 0, "empty")
            .when(F.abs(diff) < need * ON_TARGET_SHARE, "on_target")
            .when(diff < 0, "short").otherwise("over"))
    return {"needed_words": need, "diff_words": diff, "band": band}
