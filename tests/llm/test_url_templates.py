import duckdb

from corpusloom.llm import url_templates as U


def check(spark, tmp_path, rows, name):
    docs = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, host int")
    path = str(tmp_path / f"{name}.parquet")
    docs.write.parquet(path)
    got = U.judged(docs).select("page_id", "host", "path", "rule", "verdict", "template").collect()
    con = duckdb.connect()
    con.sql(f"create view pages as select page_id, url from '{path}/*.parquet'")
    want = con.sql(f"select page_id, host, path, rule, verdict, template from ({U.ORACLE})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    return {r.page_id: r for r in got}


def test_edge_urls(spark, tmp_path):
    rows = [
        (1, None), (2, ""), (3, "no scheme/en/"), (4, "http://EXAMPLE.com/en/x?y#z"), (5, "http://www.example.com/en/1"), (6, "http://notexample.com/en/1"),
        (7, "http://a.example.com"), (8, "http://a.net/es/1#top"), (9, "http://a.net?x=/es/"), (10, "x://y://z/a"), (11, "http://ÀB.org/É/*//a/b/c/d/e/f"), (12, "http://a.org/" + "q" * 50000), (1, None), (13, "http://com/"), (14, "http://net/fr/\n?x"),
    ]
    got = check(spark, tmp_path, rows, "edge")
    assert (got[1].host, got[1].path, got[1].rule) == ("", "", None)
    assert (got[4].host, got[4].path, got[4].rule, got[4].verdict) == ("example.com", "/en/x", "example.com/en/", "block")
    assert got[5].rule == "www.example.com/en/" and got[6].rule == "com/" and got[7].rule is None and got[8].rule == "net/es/" and got[9].rule is None
    assert (got[10].host, got[10].path) == ("y:", "//z/a") and got[13].rule == "com/" and got[14].rule == "net/fr/"
    assert got[11].host == "ÀB.org".replace("B", "b") and got[11].template == "/*" * 8
    assert U.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_templates_learn_from_labels(spark, tmp_path):
    rows = [(i, f"http://h{i % 3}.net/{('es', 'fr', 'de', 'en')[i % 4]}/{i}") for i in range(400)]
    rows += [(1000 + i, f"http://other.org/{('es', 'de')[i % 2]}/{i}") for i in range(40)]
    got = check(spark, tmp_path, rows, "learn")
    assert {got[i].template for i in range(400)} == {"/{es|fr}/*", "/de/*", "/en/*"}
    assert all(got[i].verdict == ("block" if i % 4 < 2 else "allow") for i in range(400))
    # no labels of their own: neither merged nor rejected
    assert {(got[1000 + i].template, got[1000 + i].verdict) for i in range(40)} == {("/es/*", "allow"), ("/de/*", "allow")}


def test_a_template_is_rejected_on_its_labels(spark, tmp_path):
    # under /shop, pages of one wildcard are labelled by rules below it, down to a sixth level
    rules = [("block", "h.org", "/shop/0"), ("allow", "h.org", "/help")]
    rows = [(i, f"http://h.org/shop/{i % 97:02d}/a/b/c/{('x', 'y')[i % 2]}/{i}") for i in range(970)] + [(2000 + i, f"http://h.org/help/{i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in U.judged(docs, rules).collect()}
    assert {got[i].template for i in range(970)} == {"/shop/*/a/b/c/{x|y}/*"}
    assert all(got[i].verdict == "block" and (got[i].rule is not None) == (i % 97 < 10) for i in range(970))
    path = str(tmp_path / "deep.parquet")
    docs.write.parquet(path)
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{path}/*.parquet'")
    want = con.sql(f"select page_id, host, path, rule, verdict, template from ({U.oracle(rules)})").fetchall()
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict, r.template)) for r in got.values())


def test_hot_hosts_and_paths(spark, tmp_path, monkeypatch):
    from corpusloom.llm import common

    monkeypatch.setattr(common, "HOT", 6)
    rows = [(i, f"http://h{i % 2}.net/{('es', 'de', 'en')[i % 3]}/{i % 9}") for i in range(200)] + [(500 + i, None) for i in range(60)] + [(700 + i, "http://big.org/same/path") for i in range(80)]
    got = check(spark, tmp_path, rows, "hot")
    assert got[500].template == "" and got[700].template == "/same/path" and len(got) == 340
