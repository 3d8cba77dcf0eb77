import re

from veilgauge.llm import url_filter
from veilgauge.llm.queries import URL_RULES
from veilgauge.llm.url_filter import STRICT, VOCABULARY, filter_urls

URLS = ["http://WWW.Example.com/en/1", "https://a.example.com/en/x?q=porn", "http://example.com/fr/", "http://x.net/es/p", "http://x.net/ES/p", "http://xnet/es/", "http://example.com",
        "http://example.com?xxx", "http://blog.spam-farm.org/a", "http://b.org/free-casino", "http://b.org/freecasino", "http://b.org/cheap-free", "http://porn.org", "http://Porn1.org",
        "http://b.org/%70orn", "porn", "", None, "no scheme/porn", "a://b://c/xxx", "http://h#xxx", "http://b.org/free?free=free", "http://éporné.org", "http://b.org/\nporn", "ftp://net/fr/a#b"]


def plain(url):
    text = url or ""
    m = re.search(r"://([^/?#]*)([^?#]*)", text)
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    host, path = (m[1].translate(fold), m[2]) if m else ("", "")
    best = max((r for r in URL_RULES if (host == r[0].split("/")[0] or host.endswith("." + r[0].split("/")[0])) and path.startswith(r[0][r[0].index("/"):])), key=lambda r: len(r[0]), default=None)
    if best:
        return host, path, best[0], "allow" if best[1] else "block"
    low = text.translate(fold)
    hit = [t for t in VOCABULARY if re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", low)]
    soft = [t for t in hit if VOCABULARY[t] < STRICT]
    bad = len(hit) > len(soft) or (len(soft) >= 2 and sum(VOCABULARY[t] for t in soft) >= 3)
    return host, path, None, "block" if bad else "allow"


def test_every_url_as_a_plain_reading_judges_it(spark):
    rows = [(i, u) for i, u in enumerate(URLS)]
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=URL_RULES).select("page_id", "host", "path", "rule", "verdict").collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {i: plain(u) for i, u in rows}


def test_strict_needs_one_hit_and_soft_several_distinct(spark):
    df = spark.createDataFrame([("http://a.org/bet?bet&bet",), ("http://a.org/casino/bet",), ("http://a.org/bet/free",), ("http://a.org/xxx",)], "url string")
    got = [(r.verdict, r.soft_weight, r.occurrences) for r in filter_urls(df).collect()]
    assert got == [("allow", 1, 3), ("block", 3, 2), ("allow", 2, 2), ("block", 0, 1)]


def test_clashing_columns_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([("http://a.org/xxx", "mine", "other")] * 3, "url string, HOST string, kept_column string")
    got = filter_urls(df)
    assert [c for c in got.columns if c.lower() == "host"] == ["host"] and "kept_column" in got.columns
    assert [r.verdict for r in got.collect()] == ["block"] * 3
    assert filter_urls(df.limit(0)).count() == 0
    assert filter_urls(df, vocabulary={}).first().verdict == "allow"


def test_many_rules_are_judged_as_few(spark, monkeypatch):
    more = [(f"h{i}.example.net/p{i}/", bool(i % 2)) for i in range(800)] + [("h7.example.net/", False), ("net/", True), ("example.net/p", False)]
    urls = [*URLS, "http://h7.example.net/p7/x", "http://a.h7.example.net/p7", "http://h8.example.net/p8/", "http://example.net/p", "http://x.net/p", "http://h9.example.net/p8/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    many = [tuple(r) for r in filter_urls(df, rules=[*URL_RULES, *more]).select("url", "rule", "verdict").collect()]
    monkeypatch.setattr(url_filter, "EXPRESSION_RULES", 10 ** 6)
    few = [tuple(r) for r in filter_urls(df, rules=[*URL_RULES, *more[:40], *more[800:]]).select("url", "rule", "verdict").collect()]
    assert many == few and dict((u, r) for u, r, _ in many)["http://h7.example.net/p7/x"] == "h7.example.net/p7/"


def test_terms_are_folded_and_read_from_a_file(spark, tmp_path):
    (tmp_path / "terms").write_text("# weights\nBadWord\t10\n\ncasino\t2\n")
    vocabulary = url_filter.read_vocabulary(str(tmp_path / "terms"))
    assert vocabulary == {"BadWord": 10, "casino": 2}
    df = spark.createDataFrame([("http://a.org/badword",), ("http://a.org/BADWORD",), ("http://a.org/casino",)], "url string")
    assert [r.verdict for r in filter_urls(df, vocabulary=vocabulary).collect()] == ["block", "block", "allow"]
