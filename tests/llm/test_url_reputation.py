import math

import duckdb

from runlens.llm import url_reputation as ur

URLS = [None, "", "no scheme", "://", "http://", "HTTP://A.Example.ORG/es/x?y#z", "http://example.org/en/12", "http://badexample.org/es/", "http://x.com/fr/1",
        "http://x.com/de/1", "http://x.com/fr", "http://x.com?fr/", "http://x.com#/de/", "ftp://a//b://c/d", "http://net/ü/é", "http://u@x.net:80/p\nq"]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(5, URLS[5], "h")], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([("x.net:80", 0)] * 40 + [("net", 1)] * 40, "host string, good int")
    got = {r["page_id"]: r for r in ur.judge_urls(df, outcomes).collect()}
    assert ur.judge_urls(df, outcomes).count() == len(URLS) + 1

    def cut(u):
        u = u or ""
        if "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        stop = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:stop] if end < stop else ""

    for i, u in enumerate(URLS):
        host, path = cut(u)
        fits = [(len(h + p), h + p, a) for a, h, p in ur.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, max(fits)[1] if fits else None), u
        if fits:
            assert got[i]["verdict"] == max(fits)[2]
    assert (got[14]["verdict"], got[15]["verdict"]) == ("allow", "block")


def test_shrinkage_by_hand(spark):
    outcomes = [("a.x.com", 1)] * 30 + [("a.x.com", 0)] * 10 + [("b.x.com", 0)] * 5 + [("c.y.com", 1)] * 3 + [("d.z.org", 0)] * 2
    levels, top, unseen = ur.reputations(spark.createDataFrame(outcomes, "host string, good int"))

    def shrink(groups, parents):
        terms = [(n, g, parents[p]) for n, g, p in groups.values()]
        plain, rest = sum(m * (1 - m) for *_, m in terms), sum(m * (1 - m) * (n - 1) for n, _, m in terms)
        rho = (sum((g - n * m) ** 2 / n for n, g, m in terms) - plain) / rest
        k = 1 / min(ur.RHO[1], max(ur.RHO[0], rho)) - 1
        return {key: (g + k * parents[p]) / (n + k) for key, (n, g, p) in groups.items()}, k

    assert math.isclose(top, 34 / 52)
    s, _ = shrink({"com": (48, 33, ""), "org": (2, 0, "")}, {"": top})
    d, _ = shrink({"x.com": (45, 30, "com"), "y.com": (3, 3, "com"), "z.org": (2, 0, "org")}, s)
    h, k = shrink({"a.x.com": (40, 30, "x.com"), "b.x.com": (5, 0, "x.com"), "c.y.com": (3, 3, "y.com"), "d.z.org": (2, 0, "z.org")}, d)
    assert math.isclose(unseen, k)
    for name, want in (("suffix", s), ("domain", d), ("host", h)):
        got = {r[name]: r["mean"] for r in levels[name].collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[x], want[x]) for x in want)


def test_no_labels_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://x.net/en/5")], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    (row,) = ur.judge_urls(pages, ur.labelled_outcomes(pages, labels)).collect()
    assert row["verdict"] == "block" and row["rule"] is None
    some = spark.createDataFrame([(5, 1, None), (5, 1, 0), (5, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in ur.labelled_outcomes(pages, some).collect()] == [("x.net", 1)]
    assert ur.judge_urls(pages.limit(0), ur.labelled_outcomes(pages, some)).collect() == []


def test_plan_has_no_python(spark):
    plan = ur.op5_url_reputation(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_sql(spark):
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    df = ur.op5_url_reputation(spark, "/root/testdata/sf0.01")
    assert sorted(map(tuple, df.collect()), key=str) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({ur.ORACLE})").fetchall(), key=str)
