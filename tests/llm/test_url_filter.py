from tally.llm import url_filter as uf
from tally.llm.queries import URL_RULES

PAGES = "page_id long, url string, html string"


def verdicts(spark, rows, rules=URL_RULES, edges=None):
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"])
            for r in uf.judge(spark.createDataFrame(rows, PAGES), rules, keep=["page_id"], edges=edges).collect()}


def test_rules(spark):
    rows = [(1, "http://A.Net/x", None), (2, "http://example.net/en/q?x=/de/", ""), (3, "https://m.EXAMPLE.com/de/1#t", ""),
            (4, "http://example.com/DE/1", ""), (5, "http://x.org/fr/", ""), (6, "http://org/fr", ""), (7, "http://notnet/", ""),
            (8, "http://sub.example.net/fr/", ""), (9, "http://a.net", ""), (10, "a.net/x", ""), (11, None, ""), (12, "x://y://a.net/", "")]
    assert verdicts(spark, rows) == {
        1: ("a.net", "/x", "net/", "block"), 2: ("example.net", "/en/q", "example.net/en/", "allow"),
        3: ("m.example.com", "/de/1", "example.com/de/", "block"), 4: ("example.com", "/DE/1", None, "allow"),
        5: ("x.org", "/fr/", "org/fr/", "allow"), 6: ("org", "/fr", None, "allow"), 7: ("notnet", "/", None, "allow"),
        8: ("sub.example.net", "/fr/", "net/", "block"), 9: ("a.net", "", None, "allow"), 10: ("", "", None, "allow"),
        11: ("", "", None, "allow"), 12: ("y:", "//a.net/", None, "allow")}


def test_blocks_reach_aliases_and_allows_come_first(spark):
    canon = '<LINK href="{0}" rel="Canonical">'
    rows = [(1, "http://a.net/x", canon.format("http://b.test/y")), (2, "http://b.test/y", ""), (3, "http://c.test/z?a=1#f",
            '<meta content="5; URL=http://b.test/y" http-equiv=Refresh>'), (4, "http://d.test/p/q", canon.format("r")),
            (5, "http://d.test/p/r", canon.format("//c.test/z?a=1")),
            (6, "http://example.net/en/1", canon.format("http://e.test/")), (7, "http://e.test", canon.format("http://f.net/")),
            (8, "http://g.test/", "<!-- " + canon.format("http://a.net/x") + " --><script>'" + canon.format("http://a.net/x") + "'</script>"),
            (9, "http://c.test/z?a=2", ""), (10, "http://h.test/", canon.format("mailto:x@a.net"))]
    got = {k: v[3] for k, v in verdicts(spark, rows).items()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "allow"}


def test_given_redirects_and_long_chains(spark):
    rows = [(i, f"http://s{i}.test/", "") for i in range(40)]
    edges = [(f"http://s{i}.test/", f"http://s{i + 1}.test/") for i in range(30)] + [("http://s30.test/", "http://z.net/")]
    got = {k: v[3] for k, v in verdicts(spark, rows, edges=spark.createDataFrame(edges, "src string, dst string")).items()}
    assert {k for k, v in got.items() if v == "block"} == set(range(31))


def test_odd_rows(spark):
    rows = [(None, None, None, 1), (2, "", "", 1), (2, "", "", 1), (3, "http://" + "a" * 50_000, "<link " * 5000, 1)]
    pages = spark.createDataFrame(rows, PAGES + ", component int")
    out = uf.judge(pages, URL_RULES)
    assert out.columns == [*pages.columns, "host", "path", "rule", "verdict"] and out.count() == 4
    assert uf.judge(pages.where("false"), URL_RULES).count() == 0
    assert uf.judge(pages, []).where("verdict = 'allow'").count() == 4
