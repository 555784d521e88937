import datetime as dt

from disclosure_spark.operators import membership as MB
from disclosure_spark.operators import prices as PR
from tests.conftest import rows

D = dt.date


def prices_of(spark, *days, ticker="A", opens=None):
    data = [(d, ticker, (opens or {}).get(i, 10.0 + i), 11.0 + i) for i, d in enumerate(days)]
    return spark.createDataFrame(data, "date date, ticker string, open double, close double")


def reports_of(spark, *filed, ticker="A"):
    data = [(i, ticker, d, "10-K") for i, d in enumerate(filed)]
    return spark.createDataFrame(data, "report_id long, ticker string, filing_date date, form_type string")


WEEK = [D(2010, 1, 4), D(2010, 1, 5), D(2010, 1, 6), D(2010, 1, 7), D(2010, 1, 11)]


def test_label_edges(spark):
    filed = [D(2000, 1, 1), WEEK[0], D(2010, 1, 9), WEEK[1], WEEK[2], WEEK[3]]
    out = PR.label_price_change(reports_of(spark, *filed), prices_of(spark, *WEEK))
    got = {r["report_id"]: r["change_ratio"] for r in out.collect()}
    # long before the first day, on a day, then days 1 and 2; a window that runs out is left out
    assert got == {0: (13 - 10) / 10, 1: (13 - 10) / 10, 3: (14 - 11) / 11, 4: (15 - 12) / 12}


def test_label_unknown_ticker_and_zero_open(spark):
    assert PR.label_price_change(reports_of(spark, WEEK[0], ticker="B"), prices_of(spark, *WEEK)).count() == 0
    assert PR.label_price_change(reports_of(spark, WEEK[0]), prices_of(spark, *WEEK, opens={0: 0.0})).count() == 0


def test_label_direction_of_no_change(spark):
    flat = spark.createDataFrame(
        [(d, "A", 5.0, 5.0) for d in WEEK], "date date, ticker string, open double, close double"
    )
    out = PR.label_price_change(reports_of(spark, WEEK[0]), flat)
    assert rows(out, "change_ratio", "change_nominal") == [(0.0, "positive")]


def test_label_equals_lateral_form(spark):
    """The window form against a correlated top-3 per report on a random fixture with one hot ticker."""
    data = {}
    for i in range(400):
        ticker = "hot" if i % 3 == 0 else f"t{i % 7}"
        data[(ticker, D(2010, 1, 1) + dt.timedelta(days=i * 3 % 700))] = (i * 7 % 23 + 1.0, i * 5 % 19 + 1.0)
    days = spark.createDataFrame(
        [(d, t, o, c) for (t, d), (o, c) in data.items()], "date date, ticker string, open double, close double"
    )
    asked = [(i, "hot" if i % 2 else f"t{i % 9}", D(2010, 1, 1) + dt.timedelta(days=i * 11 % 720), "10-K") for i in range(300)]
    reports = spark.createDataFrame(asked, "report_id long, ticker string, filing_date date, form_type string")
    expected = []
    for i, ticker, filed, _ in asked:
        later = sorted((d, v) for (t, d), v in data.items() if t == ticker and d >= filed)[:3]
        if len(later) == 3:
            opened = later[0][1][0]
            expected.append((i, (later[2][1][1] - opened) / opened))
    assert rows(PR.label_price_change(reports, days), "report_id", "change_ratio") == sorted(expected, key=repr)


def test_insert_keeps_first_key(spark):
    old = spark.createDataFrame([("A", 1), ("B", 2)], "k string, v int")
    new = spark.createDataFrame([("A", 9), ("C", 5), ("C", 4)], "k string, v int")
    assert rows(PR.new_rows(new, old, ["k"])) == [("C", 4)]


def test_payloads(spark):
    good = '{"Time Series (Daily)": {"2010-01-04": {"1. open": "1.5", "2. high": "9", "4. close": "2.5"}}}'
    landed = spark.createDataFrame(
        [("A", 200, good), ("B", 200, '{"Error Message": "bad"}'), ("C", 200, '{"Note": "slow"}'), ("D", 500, good), ("E", 200, "x")],
        "ticker string, status int, body string",
    )
    parsed = PR.parse_payloads(landed)
    assert rows(PR.payload_prices(parsed)) == [(D(2010, 1, 4), "A", 1.5, 2.5)]
    assert rows(PR.payload_errors(parsed)) == [
        ("B", 200, "bad", "error"), ("C", 200, "", "note"), ("D", 500, "", "status"), ("E", 200, "", "no series"),
    ]


def test_membership_asof_edges(spark):
    members = spark.createDataFrame([(D(2004, 1, 1), 1), (D(2004, 4, 1), 2)], "snapshot_date date, cik long")
    filed = [(0, 1, D(2003, 12, 31)), (1, 1, D(2004, 1, 1)), (2, 1, D(2004, 3, 31)), (3, 1, D(2004, 4, 1)), (4, 2, D(2009, 1, 1))]
    filings = spark.createDataFrame(filed, "report_id long, cik long, filing_date date")
    assert rows(MB.filter_members(filings, members), "report_id") == [(1,), (2,), (4,)]


def test_build_membership(spark):
    wide = spark.createDataFrame(
        [("A (old)", "i", "n", "X", None, "X"), ("B", "i", "n", "X", "X", ""), ("Z", "i", "n", "", "X", "X")],
        ["Ticker", "ISIN Code", "Company Name", "31/12/2003", "30/09/2003", "31/12/2004"],
    )
    cik_map = spark.createDataFrame([(1, 10, "A"), (2, 11, "A"), (3, 20, "B")], "ord long, cik long, ticker string")
    got = rows(MB.build_membership(wide, cik_map))
    assert got == sorted([(D(2003, 12, 31), 10), (D(2003, 12, 31), 20), (D(2004, 12, 31), 10)], key=repr)
    assert rows(MB.unmatched_tickers(wide, cik_map)) == [("Z",)]
    assert rows(MB.build_membership(wide, cik_map, cap=1), "cik") == [(10,), (10,)]


def test_unknown_company_keeps_the_filing(spark):
    filings = spark.createDataFrame([(7,)], "cik long")
    cik_map = spark.createDataFrame([(1, 10, "A", "n")], "ord long, cik long, ticker string, name string")
    assert rows(MB.with_company(filings, cik_map)) == [(7, None, None)]


def test_filing_years_and_forms(spark):
    data = [(D(2003, 12, 31), "10-K"), (D(2004, 1, 1), "10-K"), (D(2018, 12, 31), "10-Q"), (D(2019, 1, 1), "10-Q"), (D(2010, 1, 1), "8-K")]
    kept = MB.select_filings(spark.createDataFrame(data, "filing_date date, form_type string"))
    assert rows(kept) == sorted(data[1:3], key=repr)
