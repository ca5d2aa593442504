"""Order book levels of both quote layouts."""

from barloom.sources import readers


def lines(spark, rows):
    return spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "id int, line string")


def test_comma_levels(spark):
    book = [f"{100 * k},{27 - k / 100}" for k in range(1, 6)] + [f"{200 * k},{27 + k / 100}" for k in range(1, 6)]
    good, bad = readers.parse_quote_lines(lines(spark, [
        'var hq_str_sz000001="x,1,2,26.9,4,5,26.99,27.01,9,10,' + ",".join(book) + ',2024-01-02,09:31:00,00";',
        'var hq_str_sz000002="x,1,2,26.9,4,5,6,7,9,10,,,abc,26.5' + ",0" * 16 + ',2024-01-02,09:31:00,00";',
        'var hq_str_hk00001="EN,x,1,2,3,4,5,0,0,0,0,77,8,0,0,0,0,2024/01/02,09:31";',
        'var hq_str_sz000003="x,1";',
    ]))
    got = {r["id"]: r for r in readers.book_columns(good).collect()}
    assert [(x["price"], x["volume"]) for x in got[0]["bids"]] == [(27 - k / 100, 100.0 * k) for k in range(1, 6)]
    assert (got[0]["bid1"], got[0]["ask1"], got[0]["bid_depth"], got[0]["ask_depth"]) == (26.99, 27.01, 1500.0, 3000.0)
    assert round(got[0]["spread"], 6) == 0.02 and got[0]["imbalance"] == -1 / 3
    assert got[1]["bid1"] == 26.5 and got[1]["ask1"] == 0 and got[1]["spread"] is None and got[1]["bid_depth"] == 0
    assert got[2]["bids"] == [] and got[2]["imbalance"] == 0
    assert [r["id"] for r in bad.collect()] == [3]


def test_tilde_levels(spark):
    book = [f"{27 - k / 100}~{100 * k}" for k in range(1, 6)] + [f"{27 + k / 100}~{200 * k}" for k in range(1, 6)]
    text = "51~name~002241~22.26~22.27~0.00~0~0~0~" + "~".join(book) + "~~20250509092233~-0.01~-0.04~23.1~21.9~x"
    good, bad = readers.parse_tilde_quotes(lines(spark, [f'v_sz002241="{text}";', f'v_r_hk09660="{text.replace("20250509092233", "2025/04/29 13:41:04")}";', 'v_sz1="1~2";', "nothing", None]))
    got = {r["id"]: r for r in readers.book_columns(good).collect()}
    assert (got[0]["code"], got[0]["name"], got[0]["price"], got[0]["pre_close"], got[0]["high"], got[0]["low"], got[0]["quote_date"]) == ("sz002241", "name", 22.26, 22.27, 23.1, 21.9, "2025-05-09")
    assert (got[0]["bid1"], got[0]["ask1"], got[0]["ask_depth"]) == (26.99, 27.01, 3000.0)
    assert got[1]["code"] == "hk09660" and got[1]["asks"] == [] and got[1]["quote_date"] == "2025-04-29"
    assert sorted(r["id"] for r in bad.collect()) == [2, 3, 4]
