import random
from collections import Counter

from graphloom.llm import urls

PAGES = "page_id long, url string, host string, tokens string, verdict string"


def _table(spark, rows):
    return spark.createDataFrame([(k, u, "h", "t", "v") for k, u in rows], PAGES).repartition(2)


def test_hosts_paths_and_listed_rules(spark):
    cases = [
        (1, "http://A.Example.ORG/es/x?y#z", "a.example.org", "/es/x", "example.org/es/"),
        (2, "https://example.org/en/12", "example.org", "/en/12", "example.org/en/1"),
        (3, "https://example.org/en/2", "example.org", "/en/2", "org/"),
        (4, "https://notexample.org/es/1", "notexample.org", "/es/1", "org/"),
        (5, "http://x.com/fr/a", "x.com", "/fr/a", "com/fr/"),
        (6, "http://com/de/", "com", "/de/", "com/de/"),
        (7, "http://x.com/de", "x.com", "/de", None),
        (8, "http://x.org", "x.org", "", None),
        (9, "http://x.org?a/b", "x.org", "", None),
        (10, "no scheme/org/", "", "", None),
        (11, None, "", "", None),
        (12, "a://b://c/d", "b:", "//c/d", None),
        (13, "http://ÄÖ.org/", "ÄÖ.org", "/", "org/"),
        (14, "", "", "", None),
    ]
    got = {r.page_id: r for r in urls.url_filter(_table(spark, [c[:2] for c in cases])).collect()}
    verdicts = dict((rule, v) for v, rule in urls.RULES)
    for k, _, host, path, rule in cases:
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        if rule:
            assert got[k].verdict == verdicts[rule]
    assert got[11].verdict == got[14].verdict == "allow"


def _many(n=3000):
    rng = random.Random(4)
    return [(i, f"http://{rng.choice(['www', 'm', 'blog'])}.{rng.choice(['aa', 'bb', 'cc'])}.example.{rng.choice(['org', 'com', 'net'])}/{rng.choice(['en', 'fr', 'de', 'es'])}/{rng.randrange(9999)}") for i in range(n)]


def test_mined_rules_by_brute_force(spark):
    rows = urls.parsed(_table(spark, _many()), "page_id", "url", urls.RULES).collect()
    labelled = [(set(r.tokens), r.verdict) for r in rows if r.verdict]
    frame = spark.createDataFrame([(list(t), v) for t, v in labelled], "tokens array<string>, verdict string")
    mined = urls.mine(frame, 0.05, 0.9)
    assert mined
    for rule in mined:
        fits = [v for t, v in labelled if set(rule.tokens) <= t]
        assert abs(fits.count("block") / len(fits) - rule.confidence) < 1e-9 and fits.count("block") >= 0.05 * len(labelled)
    got = urls.judged(spark.createDataFrame(rows), mined).collect()
    want = [r.verdict or ("block" if any(set(m.tokens) <= set(r.tokens) for m in mined) else "allow") for r in rows]
    assert Counter((r.k, r.verdict) for r in got) == Counter((r.k, v) for r, v in zip(rows, want, strict=True))


def test_held_out_labels(spark):
    rows = [r for r in urls.parsed(_table(spark, _many(6000)), "page_id", "url", urls.RULES).collect() if r.verdict]
    half = spark.createDataFrame([r for r in rows if r.k % 2])
    mined = urls.mine(half)
    right = [("block" if any(set(m.tokens) <= set(r.tokens) for m in mined) else "allow") == r.verdict for r in rows if r.k % 2 == 0]
    assert sum(right) >= 0.97 * len(right)


def test_one_kind_of_label_or_none(spark):
    assert urls.url_filter(_table(spark, [])).collect() == []
    got = urls.url_filter(_table(spark, [(1, "http://x.org/a"), (1, "http://x.org/a"), (None, "http://y.net/b")])).collect()
    assert sorted((r.verdict for r in got)) == ["allow"] * 3
