"""Free date parsing by shapes against a table of cases."""

import datetime as dt

import pytest

from tabsense.operators import importing

CASES = [("2024-03-05", "2024-03-05"), ("5 March 2024", "2024-03-05"), ("05-Mar-2024", "2024-03-05"), ("March 5, 2024", "2024-03-05"), ("Mar 5th 2024", "2024-03-05"),
         ("Tuesday, March 5, 2024", "2024-03-05"), ("Tue 5 mar 24", "2024-03-05"), ("5.3.2024", "2024-03-05"), ("05/03/24", "2024-03-05"), ("05/03/70", "1970-03-05"),
         ("25/12/2023", "2023-12-25"), ("12/25/2023", "2023-12-25"), ("20240305", "2024-03-05"), ("2024/3/5", "2024-03-05"), ("2024-Mar-05", "2024-03-05"),
         ("sept 2023", "2023-09-01"), ("2023-09", "2023-09-01"), ("2024-03-05 14:07", "2024-03-05 14:07:00"), ("2024-03-05T14:07:09", "2024-03-05 14:07:09"),
         ("2024-03-05T14:07:09.25Z", "2024-03-05 14:07:09.25"), ("2024-03-05 14:07:09+02:00", "2024-03-05 12:07:09"), ("2024-03-05T14:07:09 -0530", "2024-03-05 19:37:09"),
         ("5 Mar 2024 2:07 pm", "2024-03-05 14:07:00"), ("3/5/2024 12:30 AM", "2024-05-03 00:30:00"), ("2024-03-05 14:07:09 UTC", "2024-03-05 14:07:09"),
         ("29 Feb 2023", None), ("31/31/2020", None), ("may", None), ("hello 5 world", None), ("12345", None), ("2024-03-05 25:00", None), ("13:45", None), ("", None),
         (None, None), ("1" * 60, None), ("5 Mar 2024 13:00 pm", None), ("99/99/9999", None)]


def parsed(spark, values, column="some_date"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"row_id long, {column} string")
    made = importing.free_dates(df, [column])[column]
    return [r["t"] for r in df.withColumn("t", made).orderBy("row_id").collect()]


def test_table_of_cases(spark):
    got = parsed(spark, [v for v, _ in CASES])
    for (value, want), t in zip(CASES, got):
        assert t == (dt.datetime.fromisoformat(want) if want else None), value


@pytest.mark.parametrize("values,want", [(["03/04/2024", "25/04/2024"], "2024-04-03"), (["03/04/2024", "04/25/2024"], "2024-03-04"),
                                         (["03/04/2024"], "2024-04-03"), (["03-04-24", "1-30-24"], "2024-03-04")])
def test_day_and_month_are_settled_by_the_column(spark, values, want):
    assert parsed(spark, values)[0] == dt.datetime.fromisoformat(want)


def test_convert_and_normalize(spark):
    mixed = ["5 March 2024", "2024-03-06", "Mar 7, 2024", "8/3/24", "nonsense"]
    df = spark.createDataFrame([(i, v, v) for i, v in enumerate(mixed)], "row_id long, sold_date string, other string")
    out = importing.convert_date_columns(df).orderBy("row_id").collect()
    assert [r["sold_date"] and r["sold_date"].day for r in out] == [5, 6, 7, 8, None] and out[0]["other"] == mixed[0]
    text = importing.normalize_dates(df).orderBy("row_id").collect()
    assert [r["other"] for r in text] == ["2024-03-05", "2024-03-06", "2024-03-07", "2024-03-08", None]
    assert importing.normalize_dates(df.limit(0)).count() == 0
