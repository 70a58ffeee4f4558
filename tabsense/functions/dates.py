"""Date parsing rules shared by import cleaning, profiling and features."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference: the candidate date formats in
# their original order (strptime notation), and the parse-rate thresholds.
PY_DATE_FORMATS = ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y",
                   "%Y/%m/%d", "%d-%m-%Y", "%m-%d-%Y",
                   "%Y%m%d", "%d.%m.%Y", "%m.%d.%Y"]
DATE_SHARE_FOR_CATEGORY = 0.8     # a text column is a date column at >= 80 % parsable rows
DATE_SHARE_FOR_FEATURES = 0.6     # date features are made at >= 60 % parsable rows

# The same formats in Spark's pattern language (single d/M accept 1-2 digits
# like strptime; yyyyMMdd is strict 8 digits).
SPARK_DATE_FORMATS = ["yyyy-M-d", "d/M/yyyy", "M/d/yyyy",
                      "yyyy/M/d", "d-M-yyyy", "M-d-yyyy",
                      "yyyyMMdd", "d.M.yyyy", "M.d.yyyy"]
# ISO date-times accepted by free parsing besides the list above.
SPARK_ISO_TIMES = ["yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s"]
PY_ISO_TIMES = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S"]


# Shapes of the formats above (years have 4 digits).  A value is only handed
# to the parser when its shape fits, which keeps failed parses cheap.
_SHAPES = {
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$", "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$", "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "yyyyMMdd": r"^\d{8}$", "d.M.yyyy": r"^\d{1,2}\.\d{1,2}\.\d{4}$", "M.d.yyyy": r"^\d{1,2}\.\d{1,2}\.\d{4}$",
    "yyyy-M-d H:m:s": r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$",
    "yyyy-M-d'T'H:m:s": r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$",
}
# What all shapes have in common.
_SHORTEST, _ANY_SHAPE = 8, r"^\d[\d/.:T -]+\d$"


def parse_with(c: Column, spark_fmt: str) -> Column:
    """Whole-string parse with one format; null when it does not fit."""
    return F.when(c.rlike(_SHAPES[spark_fmt]), F.try_to_timestamp(c, F.lit(spark_fmt)))


def parse_any(c: Column) -> Column:
    """Free parsing: the first format of the list that fits, then ISO
    date-times.  (Our documented contract for pandas' free parser.)"""
    s = F.trim(c.cast("string"))
    # other texts meet one pattern instead of one a format
    may_be = (F.length(s) >= _SHORTEST) & s.rlike(_ANY_SHAPE)
    return F.when(may_be, F.coalesce(*[parse_with(s, f) for f in SPARK_DATE_FORMATS + SPARK_ISO_TIMES]))


def duck_parse_any(expr: str) -> str:
    """The same rule in DuckDB SQL (for oracles)."""
    s = f"trim(CAST({expr} AS VARCHAR))"
    parts = [f"try_strptime({s}, '{f}')" for f in PY_DATE_FORMATS + PY_ISO_TIMES]
    return "coalesce(" + ", ".join(parts) + ")"


# Free parsing by shapes.  A value's shape is its text with digits as 9, month
# names as B, weekdays as A, am/pm as P and zone names as Z; a rule is derived
# once a shape, not once a value.
MAX_DATE_CHARS = 48
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH = r"\b(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sep(t|tember)?|oct(ober)?|nov(ember)?|dec(ember)?)\b\.?"
_WEEKDAY = r"\b(mon(day)?|tue(sday|s)?|wed(nesday)?|thu(rsday|rs|r)?|fri(day)?|sat(urday)?|sun(day)?)\b\.?"


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c.cast("string"))), r"\s+", " ")


def shape(c: Column) -> Column:
    """The shape of a value; null for what can't be a date."""
    s = _plain(c)
    for pattern, sign in ((_MONTH, "B"), (_WEEKDAY, "A"), (r"(?<=\d)(st|nd|rd|th)\b", ""), (r"(?<=[\d ])[ap]\.?m\b\.?", "P"),
                          (r"(?<=[\d ])(z|utc|gmt)$", "Z"), (r"\d", "9")):
        s = F.regexp_replace(s, pattern, sign)
    return F.when((F.length(c.cast("string")) <= MAX_DATE_CHARS) & s.rlike("^[9ABPZt:/., +-]+$") & s.contains("9"), s)


@dataclass(frozen=True)
class DateRule:
    """Places of a date's parts among its runs of digits; -1: not there."""

    year: int
    month: int      # -1: the month is a name
    day: int
    either: bool    # day and month may be the other way round
    short: bool     # a year of two digits
    packed: bool    # yyyyMMdd in one run
    hour: int = -1
    second: int = -1
    fraction: int = -1
    half: bool = False
    zone: str = ""  # "Z", "one" or "two" runs of digits


_TIME = r"(?:[ t,]+(?P<h>9{1,2}):9{2}(?P<s>:9{2}(?P<f>[.,]9+)?)?(?P<p> ?P)?)?(?P<z> ?Z| ?[+-]9{2}:?9{2})?"
#: Date parts: pattern, then the order of year, month and day among its runs of digits (B: a name).
_DATES = [(r"9{4}(?P<sep>[-/. ])9{1,2}(?P=sep) ?9{1,2}", "ymd"), (r"9{1,2}(?P<sep>[-/. ])9{1,2}(?P=sep) ?9{4}", "dmy?"), (r"9{1,2}(?P<sep>[-/.])9{1,2}(?P=sep) ?9{2}", "dmy?s"),
          (r"9{8}", "packed"), (r"9{1,2}[-/. ]*B[-/., ]*9{4}", "dBy"), (r"9{1,2}[-/. ]*B[-/., ]*9{2}", "dBys"), (r"B[-/. ]*9{1,2},? ?[-/]?9{4}", "Bdy"),
          (r"9{4}[-/. ]B[-/. ]9{1,2}", "yBd"), (r"B[-/., ]*9{4}", "By"), (r"9{4}-9{1,2}", "ym")]


def rule_of(shape_text: str) -> DateRule | None:
    """How to read values of a shape, or nothing."""
    for pattern, order in _DATES:
        m = re.fullmatch(rf"(?:A,? ?)?(?P<d>{pattern})(?: ?A)?{_TIME}", shape_text)
        if not m or m["z"] and not m["h"]:
            continue
        runs = len(re.findall("9+", m["d"]))
        parts = order.replace("B", "").replace("?", "").replace("s", "") if order != "packed" else ""
        zone = "" if not m["z"] else "Z" if "Z" in m["z"] else "two" if ":" in m["z"] else "one"
        return DateRule(parts.find("y") if parts else 0, parts.find("m"), parts.find("d"), "?" in order, order.endswith("s"), order == "packed",
                        runs if m["h"] else -1, runs + 2 if m["s"] else -1, runs + 3 if m["f"] else -1, bool(m["p"]), zone)
    return None


def _run(s: Column, i: int) -> Column:
    return F.get(F.regexp_extract_all(s, F.lit(r"(\d+)"), F.lit(1)), F.lit(i))


def first_runs(c: Column) -> tuple[Column, Column]:
    """The first two runs of digits of a value as numbers (null when long)."""
    s = _plain(c)
    return tuple(F.when(F.length(_run(s, i)) <= 2, _run(s, i).cast("int")) for i in (0, 1))


def read_with(c: Column, rule: DateRule, day_first: bool) -> Column:
    """Values of a rule's shape as timestamps; null when no such day or time is.  With ``either`` the column's order
    is tried first, then the other."""
    s = _plain(c)
    part = lambda i: _run(s, i).cast("int") if i >= 0 else F.lit(1)
    if rule.packed:
        year, month, day = (F.substring(_run(s, 0), a, n).cast("int") for a, n in ((1, 4), (5, 2), (7, 2)))
    else:
        year, month, day = part(rule.year), part(rule.month), part(rule.day)
        if rule.short:
            year = F.when(year < 69, 2000 + year).otherwise(1900 + year)
        if rule.month < 0:
            name = F.substring(F.regexp_extract(s, _MONTH, 1), 1, 3)
            month = ((F.instr(F.lit(_MONTHS), name) - 1) / 3 + 1).cast("int")
    hour = part(rule.hour) if rule.hour >= 0 else F.lit(0)
    if rule.half:
        hour = F.when(hour.between(1, 12), hour % 12 + F.when(s.rlike(r"p\.?m"), 12).otherwise(0))
    minute = part(rule.hour + 1) if rule.hour >= 0 else F.lit(0)
    seconds = _run(s, rule.second) if rule.second >= 0 else F.lit("0")
    if rule.fraction >= 0:
        seconds = F.concat(seconds, F.lit("."), F.substring(_run(s, rule.fraction), 1, 6))
    seconds = seconds.cast("decimal(8,6)")

    def made(m: Column, d: Column) -> Column:
        if not rule.zone:
            return F.try_make_timestamp(years=year, months=m, days=d, hours=hour, mins=minute, secs=seconds)
        at = F.try_make_timestamp(years=year, months=m, days=d, hours=hour, mins=minute, secs=seconds, timezone=F.lit("UTC"))
        if rule.zone == "Z":
            return at
        sign = F.when(F.regexp_extract(s, r"([+-])\d{2}:?\d{2}$", 1) == "-", -1).otherwise(1)
        digits = F.regexp_replace(F.regexp_extract(s, r"[+-](\d{2}:?\d{2})$", 1), ":", "")
        return at - F.make_dt_interval(mins=sign * (F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")))

    if not rule.either:
        return made(month, day)
    first, second = (made(month, day), made(day, month)) if day_first else (made(day, month), made(month, day))
    return F.coalesce(first, second)
