from attestra.llm import urls


def test_rules_terms_and_odd_rows(spark):
    rows = [
        (1, "http://www.Example.com/en/1?x#y", "com/"), (2, "https://www.cheap-pills.example.org/x", ""), (3, None, ""), (4, "no scheme", ""),
        (5, "http://shop.org/free-bets", ""), (6, "http://freebets.org/", ""), (7, "http://a.net/es/?q", ""), (8, "http://x.com", ""),
        (9, "http://shop.org/free/free/free", ""), (10, "http://blog.EXAMPLE.com/en/", ""), (11, "http://" + "a" * 100_000 + ".org/casino", ""), (1, "http://notexample.com/en/", ""),
    ]
    got = [tuple(r) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, rule string")).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert got[0] == (1, "www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert [g[4] for g in got] == ["allow", "block", "allow", "allow", "block", "allow", "block", "allow", "allow", "block", "block", "allow"]
    assert got[2][1:4] == ("", "", None) and got[7][1:4] == ("x.com", "", None) and got[6][3] == "net/es/" and got[11][3] == "com/"
    assert urls.judge_urls(spark.createDataFrame([], "url string")).collect() == []


def test_terms_stand_alone_in_the_url_as_written(spark):
    shut = ["http://x.org/İcasino", "http://x.org/casinoİ", "http://x.org/i\u0307casino", "http://x.org/casino\u0301", "http://x.org/9casino", "http://x.org/éCASINO"]
    open_ = ["http://x.org/CASINO", "http://x.org/İ/casino", "http://x.org/_casino_", "http://x.org/ß.casino"]
    df = spark.createDataFrame([(k, u, "mine") for k, u in enumerate(shut + open_)], "page_id long, url string, _hits string")
    got = urls.judge_urls(df)
    assert [r.strict_terms for r in got.orderBy("page_id").collect()] == [0] * len(shut) + [1] * len(open_)
    assert [r.strict_terms for r in urls.judge_urls(df.select("url")).where("url like '%CASINO'").collect()] == [0, 1]
    assert {r._hits for r in got.collect()} == {"mine"}
