import re

import numpy as np
import pandas as pd

from cohortline.llm.queries import URL_RULES
from cohortline.llm.url_filter import build, judge_urls
from tests.llm.fixtures import SMALL

URLS = [None, "", "no scheme", "://", "http://", "http://Example.ORG/en/1", "http://example.org/en/2", "http://a.b.example.org/es/x?q#f", "https://xexample.org/es/",
        "http://m.com/fr/", "http://m.com/de/1", "http://com/fr/a", "http://org", "http://org?x=/es/", "http://a.org#/", "http://blog.casino-win.net/a",
        "http://x.blog.casino-win.net", "http://..com./de/", "ftp://a://b.org/es/", "http://example.org/en/1" + "9" * 5000, "http://é.com/fr/ü"]


def plain(url, listed):
    at = (url or "").find("://")
    rest = url[at + 3:] if url and at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    inside = lambda h: host == h or host.endswith("." + h)
    fits = [(len(h + p), v == "block", h + p, v) for v, h, p in URL_RULES if inside(h) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[2], max(fits)[3]
    return host, path, None, "block" if any(inside(h) for h in listed) else "allow"


def test_equals_plain_rules(spark):
    real = pd.read_parquet(f"{SMALL}/pages.parquet").url.tolist()
    listed = ["blog.casino-win.net", "ththth.example.net"] + [plain(u, [])[0] for u in real[:9]]
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS + real)] + [(3, URLS[7], "x", "y"), (None, URLS[7], "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, _keys string")
    got = judge_urls(pages, URL_RULES, spark.createDataFrame([(x,) for x in listed] + [(None,)], "h string"))
    want = sorted(((i, *plain(u, listed)) for i, u, *_ in rows), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(none, URL_RULES, spark.createDataFrame([], "h string")).count() == 0


def test_cascades_are_exact_in_parts(spark):
    names = spark.range(4000).selectExpr("concat('k', id) AS k")
    listed = names.filter("cast(substring(k, 2) AS long) % 3 = 0")
    cascades = build(names, listed, keys_per_cascade=500)
    assert len(cascades) == 3 and any(len(c.levels) > 1 for c in cascades)
    rows = names.selectExpr("k", "xxhash64(k) AS a", "xxhash64(1, k) AS b").toPandas()
    a, b = rows.a.to_numpy(), rows.b.to_numpy()
    hit = np.zeros(len(rows), bool)
    for part, cascade in enumerate(cascades):
        hit |= cascade.holds(a, b) & (a % 3 == part)
    assert (hit == (rows.k.str[1:].astype(int) % 3 == 0)).all()
