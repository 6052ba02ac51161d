"""Hard negatives and url filters against plain Python."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.llm import hard_negatives, reputation

VECTORS = "vec_id long, embedding array<float>, label int, row int, v int, place long, slot int, pivot int, score double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], label, 7, 1, 2, 3, 4, 0.5) for i, v, label in rows], VECTORS)


def brute_mined(rows, every, k=5, j=5):
    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q, label) in enumerate(rows):
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, v, strict=False)), o, lab) for n, (o, v, lab) in enumerate(rows) if n != at]
        for ps, p in sorted((s, o) for s, o, lab in scored if lab == label)[:k]:
            fit = sorted((s, o) for s, o, lab in scored if lab != label and 80 * -ps <= 100 * -s <= 100 * -ps)[:j]
            out += [(i, p, n + 1, o, -ps, -s) for n, (s, o) in enumerate(fit)]
    return sorted(out)


def mined(df, every=10, **more):
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % every == 0, **more).collect())


@pytest.mark.parametrize(("block_rows", "query_rows", "pivots"), [(1024, 16_384, 32), (7, 12, 3), (1, 100, 1)])
def test_mined_as_by_brute_force(spark, block_rows, query_rows, pivots):
    rnd = random.Random(3)
    centre = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [c + rnd.gauss(0, 0.4) for c in rnd.choice(centre)], rnd.randrange(3)) for i in range(200)]
    rows += [(300 + i, rows[20][1], i % 3) for i in range(40)]  # copies: ties by id
    rows += [(500, [0.0] * 6, 1), (510, [1e-3, 0, 0, 0, 0, 0], 2), (520, [-x for x in rows[0][1]], 0)]
    got = mined(vectors(spark, rows), block_rows=block_rows, query_rows=query_rows, pivots=pivots, sample_rows=50)
    assert got == brute_mined(rows, 10) and len(got) > 300


def test_rows_that_take_no_part_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 0.9], 1), (2, [0.95, 0.9], 2), (3, [1.0, nan], 2), (4, [1.0, inf], 2), (5, None, 2), (6, [1.0, 0.9], None), (7, [None, 1.0], 2), (None, [1.0, 0.9], 2)]
    want = [(0, 1, 1, 2, 256 * 256 + 256 * 230, 256 * 243 + 256 * 230)]
    assert mined(vectors(spark, rows)) == want == brute_mined(rows, 10)
    assert mined(vectors(spark, rows).limit(0)) == []
    assert mined(vectors(spark, rows).filter("vec_id > 0")) == []
    # Shorter vectors are filled up; an empty one is zero.
    short = [(0, [1.0, 0.0], 1), (1, [1.0], 1), (2, [0.9], 2), (3, [], 2)]
    assert mined(vectors(spark, short)) == [(0, 1, 1, 2, 65536, 256 * 230)]


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.9, 0.1], 2), (1, [0.9, 0.1], 2)]
    assert mined(vectors(spark, rows)) == brute_mined(rows, 10) and len(brute_mined(rows, 10)) == 4


def test_far_blocks_are_not_read(spark):
    rnd = random.Random(9)
    rows = [(i, [(i % 20) * 8 + rnd.gauss(0, 0.1), 200 - (i % 20) * 8 + rnd.gauss(0, 0.1)], rnd.randrange(2)) for i in range(2000)]
    d = hard_negatives.numeric(vectors(spark, rows), F.col("vec_id") == 0, 256, "vec_id", "embedding", "label")
    index = hard_negatives.build(d, pivots=20, block_rows=20)
    part = index.placed.filter("anchor").withColumn("place", F.lit(0).cast("long")).toArrow()
    b = hard_negatives._batch(index, part)
    hard_negatives._requests(b, np.arange(1), 5, True)
    found = hard_negatives._scanned(index, b, np.array([-1.0]), np.array([2000.0]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "pivot" in plan
    near = index.blocks.filter("pivot = 0").count()
    assert 0 < found.select("row").distinct().count() <= near * 20 < 2000


# --- url filters

PAGES = "page_id long, url string, html string, host int, path int, d string, bad int, views int, rule string, n long, y long"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "<p>", 1, 2, "x", 3, 4, "r", 5, 6) for i, u in enumerate(urls)], PAGES)


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_rule(host, path):
    found = [(r, v) for v, r in reputation.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(found, key=lambda x: len(x[0]), default=(None, None))


URLS = [
    None, "", "no scheme", "mailto:a@b.c", "http://", "HTTP://Example.COM/de/1", "http://example.com/de", "http://example.com/de/?x=/fr/", "http://a.b.example.net/en/5", "http://example.net/fr/2", "http://net/", "http://net",
    "http://org/fr/x", "http://x.org/fr/", "http://x.org/FR/", "http://notexample.com/de/9", "http://ÉCOLE.org/fr/#a/b", "http://x.net?/en/", "http://x.net#/en/", "a://b://c.net/d", "http://u:p@x.net:80/q", "http://x.net:80/",
    "http://x.com./y\nz?q", "://x.org/fr/\nfr", "http://" + "a" * 70_000 + ".net/en/", "http://example.net/en/" + "x" * 70_000 + "/12",
    "http://" + "." * 50_000 + "x", "http://" + "a.b" * 30_000 + "@c.org:1" + "." * 9,
]


def test_parts_and_rules_as_in_plain_python(spark):
    d = pages(spark, URLS)
    got = {r.page_id: r for r in reputation.judge(d, reputation.outcomes(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = plain_parts(u)
        rule, verdict = plain_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow"), u


def test_registered_domains(spark):
    cases = {"a.b.example.com": ("example.com", "com"), "example.com": ("example.com", "com"), "com": ("com", "com"), "": ("", ""), "www.x.co.uk": ("x.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"),
             "u:p@www.x.org:8080": ("x.org", "org"), "x.org.": ("x.org", "org"), "10.0.0.1:80": ("10.0.0.1", ""), "[::1]": ("[::1]", "")}
    d = spark.createDataFrame([(h,) for h in cases], "h string")
    got = {r.h: (r.a, r.b) for r in d.select("h", reputation.domain(F.col("h")).alias("a"), reputation.suffix(F.col("h")).alias("b")).collect()}
    assert got == cases


def plain_reputations(hosts):
    """host: (domain, suffix, n, y) -> host: lower bound, by the same rules on dictionaries."""
    n, y = (sum(v[i] for v in hosts.values()) for i in (2, 3))
    mean = y / n if n else 0.0

    def summed(key):
        out = defaultdict(lambda: [0, 0])
        for v in hosts.values():
            out[key(v)][0] += v[2]
            out[key(v)][1] += v[3]
        return out

    s, d = summed(lambda v: v[1]), summed(lambda v: v[:2])

    def rho(children):
        more = each = 0.0
        for group in children.values():
            group = [(a, b) for a, b in group if a]
            t, b = sum(a for a, _ in group), sum(b for _, b in group)
            if len(group) < 2 or not 0 < b < t:
                continue
            p = b / t
            n2, n3 = sum(a**2 for a, _ in group), sum(a**3 for a, _ in group)
            more += sum((c - a * p) ** 2 for a, c in group) - p * (1 - p) * (t - n2 / t)
            each += p * (1 - p) * (n2 - t - 2 * n3 / t + n2 / t + (n2 / t) ** 2)
        return min(0.5, max(0.002, more / each)) if each > 0 else 0.02

    families = [defaultdict(list) for _ in range(3)]
    for k, v in s.items():
        families[0][()].append(v)
    for k, v in d.items():
        families[1][k[1]].append(v)
    for v in hosts.values():
        families[2][v[:2]].append(v[2:])
    w = [1 / rho(f) - 1 for f in families]
    out = {}
    for h, (dom, suf, nh, yh) in hosts.items():
        (ns, ys), (nd, yd) = s[suf], d[dom, suf]
        m = (y - ys + mean) / (n - ns + 1)
        m = (w[0] * m + ys - yd) / (w[0] + ns - nd)
        m = (w[1] * m + yd - yh) / (w[1] + nd - nh)
        m = (w[2] * m + yh) / (w[2] + nh)
        out[h] = math.sin(max(0.0, math.asin(math.sqrt(m)) - 1.6448536269514722 / (2 * math.sqrt(w[2] + nh + 1)))) ** 2
    return out, mean


def test_reputation_blocks_bad_hosts_alone(spark):
    rnd = random.Random(4)
    urls, labels, hosts = [], [], {}
    for dom in range(12):
        for h in range(5):
            name = f"h{h}.site{dom}.{'com' if dom % 2 else 'info'}"
            share = 0.9 if (dom, h) == (3, 1) or dom == 7 else 0.1
            size = 0 if (dom, h) == (7, 4) else 2 if h == 0 else 60  # no label of its own
            for _ in range(size):
                labels.append((len(urls), 0 if rnd.random() < share else 1, None))
                urls.append(f"http://{name.upper()}/de/{len(urls)}.html")
            urls.append(f"http://{name}/none")
            got = [x for x in labels if x[0] < len(urls)][-size:] if size else []
            hosts[name] = (f"site{dom}.{'com' if dom % 2 else 'info'}", "com" if dom % 2 else "info", size, sum(1 - q for _, q, _ in got))
    d = pages(spark, urls)
    found = reputation.outcomes(d, spark.createDataFrame(labels + labels[:5] + [(None, 0, 1), (10**9, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int"))
    rows = reputation.judge(d, found).collect()
    bounds, mean = plain_reputations(hosts)
    for r in rows:
        assert r.n_labelled == hosts[r.host][2] and r.n_bad == hosts[r.host][3]
        assert abs(r.bound - bounds[r.host]) < 1e-6
        assert r.verdict == ("block" if bounds[r.host] > 1.5 * mean else "allow")
    blocked = {r.host for r in rows if r.verdict == "block"}
    assert blocked == {"h1.site3.com", *(f"h{h}.site7.com" for h in range(5))}  # the host without labels has its domain's


@pytest.mark.parametrize(("a", "b"), [(0.7, 40), (3, 30), (12.8, 17.2), (60, 300), (900, 100), (5, 5)])
def test_bound_is_near_the_exact_quantile(a, b):
    x = np.linspace(0, 1, 2_000_001)[1:-1]
    density = np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) - max(1e-300, 0) - ((a - 1) * np.log((a + 1e-9) / (a + b)) + (b - 1) * np.log(b / (a + b))))
    exact = x[np.searchsorted(np.cumsum(density) / density.sum(), 0.05)]
    mean = a / (a + b)
    got = math.sin(max(0.0, math.asin(math.sqrt(mean)) - reputation.Z / (2 * math.sqrt(a + b + 1)))) ** 2
    assert abs(got - exact) < 0.02


def test_no_pages(spark):
    d = pages(spark, URLS).limit(0)
    out = reputation.judge(d, reputation.outcomes(d, spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")))
    assert out.count() == 0 and out.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
