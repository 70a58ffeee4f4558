"""Text rules of import cleaning: null tokens, column names, accents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must equal the reference: the strings read as missing.
NULL_TOKENS = ["", " ", "NA", "NaN", "nan", "NULL", "null", "None"]

# What pandas' CSV reader takes as missing by default.
READER_NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                      "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def null_token(c: Column) -> Column:
    """The value, or null when it is one of the missing-value tokens."""
    return F.when(c.isin(NULL_TOKENS), F.lit(None).cast("string")).otherwise(c)


def _make_normalize_udf():
    """The Arrow UDF is built in a closure so that it is shipped to the
    Python workers by value: executors need no copy of this package."""
    import unicodedata as ud

    @F.pandas_udf(T.StringType())
    def normalize_text_udf(s: pd.Series) -> pd.Series:
        """Each distinct value of the batch once: decompose, leave out the
        combining marks, then lower and trim the whole column."""
        values = pd.Series(s.dropna().unique(), dtype=object)
        decomposed = values.str.normalize("NFKD")
        plain = decomposed.str.translate({i: None for text in decomposed for i in map(ord, text) if ud.combining(chr(i))})
        done = dict(zip(values, plain.str.lower().str.strip()))
        return pd.Series([done.get(v) for v in s], dtype=object)

    return normalize_text_udf


normalize_text_udf = _make_normalize_udf()


# characters Python's str.strip() removes in the ASCII range
_ASCII_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"


def normalize_text(c: Column) -> Column:
    """Accent-free, lower-case, trimmed text.  Pure-ASCII values are done in
    the JVM; the Arrow UDF works on the others only."""
    ascii_only = c.rlike(r"^[\x00-\x7F]*$")
    # a UDF runs on every row of a batch whatever the branch: give it nulls for the rows it need not see
    marked = normalize_text_udf(F.when(~ascii_only, c))
    return F.when(ascii_only, F.trim(F.lower(c), F.lit(_ASCII_SPACE))).otherwise(marked)
