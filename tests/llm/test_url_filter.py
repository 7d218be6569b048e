"""op13: SQL over pages that link to each other, and the defined cases by hand."""

import random

import pytest

from scriptorium.llm import url_filter
from scriptorium.llm.queries import ORACLE_SQL, QUERIES, URL_RULES
from tests.compare import difference

FORMS = ['<a href="https://{}/x">', "<A HREF='http://{}?q'>", "<a href=//{}/y >", '<a href = "HTTPS://{}#z">', '<link\nhref="//{}">', '<a data-href="ftp://{}/">']


@pytest.fixture(scope="module")
def linked(spark, tmp_path_factory):
    """Pages of 60 hosts that link to each other; the hosts of a farm are wholly blocked, others link to it only."""
    rng = random.Random(5)
    hosts = [f"h{k}.{d}" for k in range(20) for d in ("example.org", "Net", "x.com")]
    rows = []
    for k in range(600):
        host = rng.choice(hosts[:50]) if k % 3 else "m.hot.com"
        path = rng.choice(["/es/1", "/en/1", "/en/2", "/de/5", "/fr/", "", "/DE/"])
        links = "".join(rng.choice(FORMS).format(rng.choice(hosts)) for _ in range(rng.randrange(6)))
        rows.append((k, f"http://{host}{path}{rng.choice(['', '?a=/b', '#c'])}", f"<p>{links}<a href='/own'>"))
    rows += [(1000 + k, f"https://farm{k}.com/de/{k}", "<p>") for k in range(4)]
    rows += [(1100 + k, f"https://feeder{k}.net/", "".join(f"<a href='http://farm{i}.com/'>" for i in range(4))) for k in range(3)]
    rows += [(1200, "https://indirect.net/a", "<a href='http://feeder0.net/'>")]
    rows += [(2000, None, "<a href='http://farm0.com'>"), (2001, "no scheme/x", None), (2002, "://", ""), (2003, "x://a.org", None), (2003, "x://a.org", None), (None, "http://org/\nq", "<a href='//'>")]
    path = str(tmp_path_factory.mktemp("linked"))
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages")
    part = next(p for p in (tmp_path_factory.getbasetemp() / path.rsplit("/", 1)[1] / "pages").iterdir() if p.suffix == ".parquet")
    part.rename(f"{path}/pages.parquet")
    import duckdb

    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "benchmark", "labels", "conversations"):
        duckdb.sql(f"copy (select 1 as x) to '{path}/{t}.parquet'")
    return path


def test_equals_sql_on_linked_hosts(spark, linked):
    assert difference(spark, "op13", QUERIES["op13_url_filter"], ORACLE_SQL["op13_url_filter"], linked) is None
    rows = {r.page_id: r for r in QUERIES["op13_url_filter"](spark, linked).collect() if r.page_id is not None}
    assert all(rows[1000 + k].verdict == "block" and rows[1000 + k].rule == "com/de/" for k in range(4))
    assert all((rows[1100 + k].verdict, rows[1100 + k].rule) == ("block", None) for k in range(3))
    # Two steps away there is still some distrust, and nobody vouches for it.
    assert rows[1200].verdict == "block"
    assert all((rows[k].host, rows[k].path, rows[k].rule, rows[k].verdict) == ("", "", None, "allow") for k in (2000, 2001, 2002))
    assert (rows[2003].host, rows[2003].path, rows[2003].verdict) == ("a.org", "", "allow")


def test_partitions_change_nothing(spark, linked):
    pages = spark.read.parquet(f"{linked}/pages.parquet")
    want = sorted(map(repr, url_filter.judge_urls(pages, URL_RULES).collect()))
    assert sorted(map(repr, url_filter.judge_urls(pages.repartition(13), URL_RULES).collect())) == want


def test_trust_clears_and_rules_rank(spark):
    rules = [("allow", "good.org", "/"), ("block", "bad.org", "/"), ("block", "b.org", "/x"), ("allow", "org", "/x/yz"), ("allow", "b.org", "/t"), ("block", "b.org", "/t")]
    rows = [(1, "http://good.org/", "<a href='http://mixed.net'><a href='http://mixed.net'>"), (2, "http://bad.org/", ""), (3, "http://mixed.net/", "<a href='//bad.org'><a href='//good.org'>"), (4, "http://lost.net/", "<a href='//bad.org'>")]
    rows += [(5, "http://b.org/x/yz", ""), (6, "http://a.b.org/xq", ""), (7, "http://ab.org/xq", ""), (8, "http://b.org/t", "")]
    out = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert out == {1: ("good.org/", "allow"), 2: ("bad.org/", "block"), 3: (None, "allow"), 4: (None, "block"), 5: ("org/x/yz", "allow"), 6: ("b.org/x", "block"), 7: (None, "allow"), 8: ("b.org/t", "block")}


def test_edge_cases(spark):
    schema = "page_id long, url string, html string, host string, made string, bad_host string, Verdict string"
    rows = [(1, "http://" + "a." * 10_000 + "org/", "<a href='//x'>" * 50_000, "own", "own", "own", "own"), (2, None, None, None, None, None, None), (2, "", "", "", "", "", "")]
    pages = spark.createDataFrame(rows, schema)
    out = url_filter.judge_urls(pages, URL_RULES)
    assert out.columns == ["page_id", "url", "made", "bad_host", "host", "path", "rule", "verdict"]
    assert sorted((r.page_id, r.rule, r.verdict, r.made) for r in out.collect() if r.page_id == 1) == [(1, "org/", "allow", "own")] and out.count() == 3
    assert url_filter.judge_urls(pages, []).filter("rule is not null or verdict <> 'allow'").count() == 0
    assert url_filter.judge_urls(pages.limit(0), URL_RULES).count() == 0
