"""Import cleaning: column names, null tokens, text normalisation, dates.

All rewrites are single projections; the only aggregates are the date
parse rates and the vote for a date format, one pass for every column.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.functions.dates import (DATE_SHARE_FOR_CATEGORY, PY_DATE_FORMATS, SPARK_DATE_FORMATS, first_runs,
                                      parse_with, read_with, rule_of, shape)
from tabsense.functions.numeric import col
from tabsense.functions.schema import ROW_ID, data_fields, is_numeric, is_temporal
from tabsense.functions.text import normalize_text, null_token


def snake_case_columns(df: DataFrame) -> DataFrame:
    """Rename columns to snake_case (schema only): lower case, letters, digits
    and underscores kept, runs of white space between them one underscore,
    everything else dropped.  A name that collides with an earlier one gets a
    ``_2``, ``_3`` ... suffix."""
    taken: dict[str, int] = {}

    def renamed(column: str) -> str:
        if column == ROW_ID:
            return column
        kept = filter(lambda ch: ch.isalnum() or ch == "_" or ch.isspace(), column.strip().lower())
        runs = ("_" if space else "".join(chars) for space, chars in groupby(kept, str.isspace))
        return "".join(runs)

    names = []
    for name in map(renamed, df.columns):
        taken[name] = taken.get(name, 0) + 1
        names.append(name if taken[name] == 1 else f"{name}_{taken[name]}")
    return df.toDF(*names)


def null_tokens(df: DataFrame) -> DataFrame:
    """Missing-value tokens -> null in every text column."""
    return df.withColumns({f.name: null_token(col(f.name)) for f in data_fields(df)
                           if isinstance(f.dataType, T.StringType)})


def uniformize_categories(df: DataFrame) -> DataFrame:
    """normalize_text on every text column (nulls stay null)."""
    return df.withColumns({f.name: normalize_text(col(f.name)) for f in data_fields(df)
                           if isinstance(f.dataType, T.StringType)})


def date_formats(df: DataFrame, cols: list[str]) -> dict[str, str | None]:
    """For each column the format (strptime notation) that parses most of its
    non-null values, if that is more than half of them; the earliest format
    of the list wins ties.  One aggregate over every value of all columns."""
    if not cols:
        return {}
    counts = [F.count(parse_with(F.trim(col(c).cast("string")), f)).alias(f"c{i}_f{k}")
              for i, c in enumerate(cols) for k, f in enumerate(SPARK_DATE_FORMATS)]
    r = df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(cols)], *counts).first()
    found = {}
    for i, c in enumerate(cols):
        parsed = [r[f"c{i}_f{k}"] for k in range(len(PY_DATE_FORMATS))]
        best = max(range(len(parsed)), key=lambda k: (parsed[k], -k))
        found[c] = PY_DATE_FORMATS[best] if parsed[best] > r[f"n{i}"] / 2 else None
    return found


def detect_date_format(df: DataFrame, c: str) -> str | None:
    """:func:`date_formats` of one column."""
    return date_formats(df, [c])[c]


def date_format_table(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, format) for the given text columns (format null when none)."""
    cols = cols if cols is not None else [f.name for f in data_fields(df) if isinstance(f.dataType, T.StringType)]
    return df.sparkSession.createDataFrame(list(date_formats(df, cols).items()), "column string, format string")


def _spark_format(py_fmt: str) -> str:
    return SPARK_DATE_FORMATS[PY_DATE_FORMATS.index(py_fmt)]


def free_dates(df: DataFrame, cols: list[str]) -> dict[str, Column]:
    """Expressions that read text columns as timestamps whatever their values
    look like: month names, two-digit years, times, am/pm, fractions, zones
    (as instants), weekdays.

    One aggregate counts the shapes of all columns (shapes of what can be a
    date are few); a rule is derived for each.  Whether 03/04 is a day and a
    month or the reverse is settled a column: by whichever place holds more
    values above 12, the day first when there are none; a value that has no
    such day is read the other way.
    """
    if not cols:
        return {}
    items = [F.struct(F.lit(c).alias("c"), shape(col(c)).alias("s"), *[x.alias(f"r{i}") for i, x in enumerate(first_runs(col(c)))]) for c in cols]
    known = (df.select(F.explode(F.array(*items)).alias("v")).where(F.col("v.s").isNotNull()).groupBy("v.c", "v.s")
             .agg(F.count_if(F.col("v.r0") > 12).alias("first"), F.count_if(F.col("v.r1") > 12).alias("second")))
    rules, votes = {c: [] for c in cols}, {c: 0 for c in cols}
    for r in known.collect():
        rule = rule_of(r["s"])
        if rule:
            rules[r["c"]].append((r["s"], rule))
            votes[r["c"]] += (r["first"] - r["second"]) if rule.either else 0
    out = {}
    for c in cols:
        by_rule: dict = {}
        for text, rule in rules[c]:
            by_rule.setdefault(rule, []).append(text)
        parts = [F.when(shape(col(c)).isin(texts), read_with(col(c), rule, votes[c] >= 0)) for rule, texts in by_rule.items()]
        out[c] = F.coalesce(*parts) if parts else F.lit(None).cast("timestamp")
    return out


def convert_date_columns(df: DataFrame) -> DataFrame:
    """Columns whose name contains ``date``: text is parsed with its
    dominant format (or freely, see :func:`free_dates`, when there is none);
    integers are parsed only as 8-digit ``yyyyMMdd``; failures become null."""
    dated = [f for f in data_fields(df) if "date" in f.name.lower()]
    formats = date_formats(df, [f.name for f in dated if isinstance(f.dataType, T.StringType)])
    exprs = {}
    free = free_dates(df, [c for c, fmt in formats.items() if not fmt])
    for c, fmt in formats.items():
        exprs[c] = parse_with(F.trim(col(c)), _spark_format(fmt)) if fmt else free[c]
    whole = [f.name for f in dated if is_numeric(f.dataType) and not isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if whole:
        eight = [F.count_if((col(c) >= 10000101) & (col(c) <= 99991231)) for c in whole]
        r = df.agg(*[F.count(col(c)) for c in whole], *eight).first()
        exprs |= {c: parse_with(col(c).cast("string"), "yyyyMMdd") for i, c in enumerate(whole) if r[i] and r[i] == r[len(whole) + i]}
    return df.withColumns(exprs) if exprs else df


def normalize_dates(df: DataFrame, share: float = DATE_SHARE_FOR_CATEGORY) -> DataFrame:
    """Date columns, and text columns with at least ``share`` of all rows
    parsable, become ``yyyy-MM-dd`` text (unparsable values -> null)."""
    fields = data_fields(df)
    texts = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    exprs = {f.name: F.date_format(col(f.name), "yyyy-MM-dd") for f in fields if is_temporal(f.dataType)}
    if texts:
        free = free_dates(df, texts)
        r = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(free[c]).alias(f"p{i}") for i, c in enumerate(texts)]).first()
        for i, c in enumerate(texts):
            if r["n"] and r[f"p{i}"] >= share * r["n"]:
                exprs[c] = F.date_format(free[c], "yyyy-MM-dd")
    return df.withColumns(exprs) if exprs else df


def clean_import(df: DataFrame, to_date_text: bool = False) -> DataFrame:
    """Names -> null tokens -> text normalisation -> null tokens again (a
    value that is blank after trimming) -> date conversion [-> yyyy-MM-dd
    text].  Tokens are matched before lower-casing so ``NA``/``None`` are
    caught too."""
    out = snake_case_columns(df)
    out = null_tokens(out)
    out = uniformize_categories(out)
    out = null_tokens(out)
    out = convert_date_columns(out)
    if to_date_text:
        out = normalize_dates(out)
    return out
