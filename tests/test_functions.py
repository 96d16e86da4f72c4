import html
import random

import pytest
from pyspark.sql import functions as F

from docaudit.functions import cells, dates, markup, text

c = F.col


def values(spark, inputs, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, t {kind}")
    return [r.u for r in df.select("i", fn(c("t")).alias("u")).orderBy("i").collect()]


def test_numbers(spark):
    given = ["$4,271.05", "4.271,05", "1 234.5", "1,23", "1,234", "1,234,56", "4.271", "1.234.567", "N/A", "-", "없음", " 5. ",
             "USD 90", "1,2.3", None, ".", "-5,00"]
    want = [4271.05, 4271.05, 1234.5, 1.23, 1234.0, None, 4.271, None, None, None, None, 5.0, 90.0, 12.3, None, None, -5.0]
    assert values(spark, given, text.to_number) == want


def test_dates(spark):
    given = ["2024-1-3", "2024/01/03", "03.01.2024", "31/12/2020", "12/31/2020", "2021-02-30", "Due after 30 days", "", None, " 2024-01-03 "]
    got = [str(x) if x else None for x in values(spark, given, dates.parse_date)]
    assert got == ["2024-01-03"] * 3 + ["2020-12-31"] * 2 + [None] * 4 + ["2024-01-03"]
    assert "Jan 03, 2024" in values(spark, ["2024-01-03"], dates.date_variants)[0]


def test_number_spellings_round_like_c(spark):
    random.seed(7)
    xs = [2.675, 0.125, 999999.5, 95611.45, 1234565.0, 0.005, -5.25, 0.0, 1e9 + 0.5]
    xs += [12345678901.125, 10000000000.005, 123456500000.0, 1e15 + 0.125, 2.0**53 + 2, 1e22, -9999995.0, 4503599627370495.5]
    xs += [round(random.uniform(0, 10 ** random.randint(0, 7)), random.randint(0, 4)) for _ in range(300)]
    for x, got in zip(xs, values(spark, xs, dates.number_variants, "double")):
        assert f"{x:.2f}" in got and f"{x:,.2f}" in got and f"{x:g}" in got
    assert [float(x) for x in values(spark, xs, dates.round_cents, "double")] == [round(x, 2) for x in xs]
    assert None not in values(spark, [1e25, 1e300, -1e30, 5e-324], dates.round_cents, "double")


@pytest.mark.parametrize("t", ["a &amp; b", "&#128; &#x41; &notit; &nosuch; x & y &lt", "&copyx &Aacute;z &#xD800; &#1; &#99999999999;",
                               "AT&T", "&amp;amp; &hellip;&#8364", "none", "&notin; &notinx", "&a"])
def test_entities(spark, t):
    assert values(spark, [t], markup.unescape_html) == [html.unescape(t)]


def test_cells(spark):
    given = ["€ 200", "$1,234.50", "USD 90", "5 pcs.", "598-31-5899", "Backhoe I", ""]
    assert values(spark, given, cells.is_number_cell) == [True] * 4 + [False] * 3
    assert values(spark, ["Exterior Protection (10)", "Dwarf Senna Qty. 2", "Rope x 3"], cells.embedded_quantities) == [[10.0, 10.0], [2.0], [3.0]]
    assert values(spark, ["7.", " 26 ", "12345", "1.5"], cells.item_number_cell) == [7, 26, None, None]
    rows = spark.createDataFrame([(["Total Station", "5"],), (["TOTAL:", "5"],), (["Sales Tax", "5"],)], "r array<string>")
    assert [r[0] for r in rows.select(cells.is_summary_row(c("r"))).collect()] == [False, True, True]


def test_lines(spark):
    assert values(spark, ["a\n", "a\r\nb\n\n", "", "x y"], text.text_lines) == [["a"], ["a", "b", ""], [], ["x", "y"]]


def test_many_entities_take_linear_time(spark):
    import time

    names = ["&amp;", "&hellip;", "&notit;", "&nosuch;", "&#65;", "&zwnj;", "&CounterClockwiseContourIntegral;"]
    took = {}
    for n in (20_000, 100_000):
        given = " ".join(random.Random(n).choices(names, k=n))
        df = spark.createDataFrame([(given,)], "t string")
        started = time.time()
        assert df.select(markup.unescape_html(c("t")).alias("u")).first().u == html.unescape(given)
        took[n] = time.time() - started
    assert took[100_000] < 60
