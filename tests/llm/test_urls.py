"""URL parts and rules against brute force, and the classifier on hosts it has not seen."""

import pytest

from corpuslab.llm import urls
from corpuslab.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme", "http://", "https://Www.EXAMPLE.com/en/1", "http://example.com/en/", "http://example.com/EN/", "http://a.b.example.com/en/x?y#z",
    "http://notexample.com/en/", "http://x.net/es/1", "http://x.net/es", "ftp://net/fr/", "http://x.net?/es/", "http://x.net#/es/", "http://X.NET/fr/a?b",
    "a://b://c/d", "http://ÄÖ.net/de/", "http://com", "http://com/", "http://xcom/", "://net/es/", "http://a.com/\nx", "http://user@x.net:80/es/",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        rest = rest[end:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    best = None
    for verdict, rule in URL_RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


@pytest.fixture(scope="module")
def model(spark):
    return urls.train(urls.labelled_urls(spark))


def test_parts_and_rules(spark, model):
    frame = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(URLS)], "page_id long, url string, host string, prediction double")
    for r in urls.judge(frame, model, URL_RULES).collect():
        host, path, best = brute(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[0])
        assert r.verdict == best[1] if best else r.verdict in ("allow", "block")
        if not host and not best:
            assert r.verdict == "allow"


def test_classifier_on_unseen_hosts(spark, model):
    bad = ["www.mega-casino.example.net", "free-poker.example.org", "adult-pics.example.com", "m.spam-net.example.org", "www.bets-today.example.net"]
    good = ["thand.example.net", "blog.erthe.example.org", "m.gardening.example.com", "www.city-news.example.org", "tionre.example.net"]
    frame = spark.createDataFrame([(f"https://{h}/de/77",) for h in bad + good], "url string")
    got = {r.host: r.verdict for r in urls.judge(frame, model, []).collect()}
    assert [got[h] for h in bad] == ["block"] * 5 and [got[h] for h in good] == ["allow"] * 5


def test_empty_table_and_repeated_rows(spark, model):
    frame = spark.createDataFrame([("http://a.net/x",), ("http://a.net/x",)], "url string")
    assert len({tuple(r) for r in urls.judge(frame, model, URL_RULES).collect()}) == 1
    assert urls.judge(frame.limit(0), model, URL_RULES).count() == 0


def test_bad_paths_under_neutral_hosts(spark, model):
    bad = ["https://www.example.org/adult-video/clip", "http://example.com/en/casino-games", "https://garden.example.net/spam-farm/12"]
    good = ["https://www.example.org/music-video/clip", "http://example.com/en/board-games", "https://garden.example.net/fish-farm/12"]
    frame = spark.createDataFrame([(u,) for u in bad + good], "url string")
    got = {r.url: r.verdict for r in urls.judge(frame, model, []).collect()}
    assert [got[u] for u in bad] == ["block"] * 3 and [got[u] for u in good] == ["allow"] * 3


def test_table_has_no_name_of_the_test_pages(spark, model):
    """Hosts of the pages share no name with the table; the made-up prose names pass, the hyphenated ones of
    bets, adult, spam, pills and trackers are blocked."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url")
    rows = urls.judge(pages, model, []).collect()
    parts = {part for r in rows for part in r.host.split(".")}
    assert not parts & {*urls.BLOCKED, *urls.ALLOWED}
    assert sum((r.verdict == "block") == ("-" in r.host) for r in rows) >= 0.99 * len(rows)
    assert all(r.verdict == "block" for r in rows if "ads-track" in r.host)
