from runlens.llm import language

EN = "the river and the stone are in the quiet market of the evening "
DE = "der fluss und die steine liegen nicht in dem stillen markt am abend "
FR = "la rivière et les pierres dans le marché tranquille du soir avec une lettre "


def training(docs_of):
    return docs_of([(i, t * 5, lang) for lang, t in (("en", EN), ("de", DE), ("fr", FR)) for i in range(10)])


def page(text, lang=None):
    return f"<html{'' if lang is None else f' lang={lang!r}'}><head><title>{EN}</title></head><body><p>{text}</p></body></html>"


def test_evidence(spark, docs_of):
    model = language.train(training(docs_of))
    assert model.langs == ["de", "en", "fr"]
    rows = [(1, "http://a.example.com/x", page(DE, "en")), (2, "http://b.example.de/", page("12 34")), (3, "http://c.example.com/fr/1", page("")),
            (4, None, None), (5, "http://a.example.com/", page("", "fr-CA")), (6, "http://a.example.com/", page(FR, "zz")), (6, "http://a.example.com/", page(FR, "zz"))]
    rows += [(100 + i, f"http://hot.example.org/{i}", page(FR)) for i in range(4)] + [(200, "http://hot.example.org/q", page("7"))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, lang string").repartition(3)
    got = language.identify_pages(df, model).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert [by[i]["lang"] for i in (1, 2, 3, 5, 6, 200)] == ["de", "de", "fr", "fr", "fr", "fr"]
    assert by[1]["declared"] == "en" and by[2]["text_lang"] is None and by[3]["address"] == "fr" and by[2]["address"] == "de"
    assert by[4]["lang"] == "fr"  # only the shares of all texts
    assert by[200]["confidence"] > by[4]["confidence"]
    assert all(0 < r["confidence"] <= 1 for r in got)
    assert language.identify_pages(df.limit(0), model).collect() == []


def test_host_shares_by_hand(spark):
    rows = [("a.x.com", "x.com", "com", [0.0, -1.0])] * 3 + [("b.x.com", "x.com", "com", [-1.0, 0.0]), ("c.y.com", "y.com", "com", None), ("d.z.org", "z.org", "org", None)]
    df = spark.createDataFrame(rows, "host string, domain string, suffix string, like array<double>")
    got = {r["host"]: r["shares"] for r in language.host_shares(df, 2, 2.0).collect()}
    top = [4 / 6, 2 / 6]
    com = [(3 + 2 * top[0]) / 6, (1 + 2 * top[1]) / 6]
    x = [(3 + 2 * com[0]) / 6, (1 + 2 * com[1]) / 6]
    for host, want in {"d.z.org": top, "c.y.com": com, "b.x.com": [(0 + 2 * x[0]) / 3, (1 + 2 * x[1]) / 3], "a.x.com": [(3 + 2 * x[0]) / 5, 2 * x[1] / 5]}.items():
        assert all(abs(p - q) < 1e-12 for p, q in zip(got[host], want))


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs.where("doc_id % 2 = 0"))
    rows = language.likelihoods(docs.where("doc_id % 2 = 1").select("lang", "text"), "text", model, "like").collect()
    right = [model.langs[r["like"].index(max(r["like"]))] == r["lang"] for r in rows if r["like"]]
    assert sum(right) / len(right) > 0.97


def test_keep_known(docs_of, edges):
    rows = [(i, t * 5, lang, "s") for lang, t in (("en", EN), ("de", DE), ("fr", FR)) for i in range(10)] + edges
    rows += [(50, DE * 20, "en", "s"), (51, EN, None, None), (52, "123", "fr", "t")]
    docs = docs_of(rows).withColumnRenamed("n_chars", "shares")
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(rows) - 1 and kept.where("doc_id = 50").count() == 0
    assert language.keep_known(docs_of([])).collect() == [] and language.keep_known(docs_of(edges)).count() == len(edges)
