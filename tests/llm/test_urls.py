import re

from pyspark.sql import functions as F

from lexiloom.llm import urls


def brute_cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best


URLS = [
    None, "", "nothing", "http://", "HTTP://A.Example.NET/en/1?x#y", "http://example.net/en", "http://notexample.net/en/", "http://example.com/de/", "http://x.example.com/DE/", "https://a.org/fr/q", "https://org/fr/",
    "http://net", "http://net/", "http://x.net#/", "http://x.net?q=/en/", "a://b://c/d", "http://ÀÉ.Org/fr/ü", "http://user@Host:80/p\nq", "http://a.b.org/en/", "http://a.example.net/fr/", "http://deep.sub.example.net/en/x",
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, "q") for i, u in enumerate(URLS)] + [(3, URLS[3], "q"), (None, URLS[4], "q")], "page_id long, url string, rule string")
    none = spark.createDataFrame([], "page_id long, good int")
    out = urls.judge(df, none).collect()
    assert len(out) == len(URLS) + 2
    for r in out:
        url = URLS[4 if r.page_id is None else r.page_id]
        host, path = brute_cut(url)
        rule = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0]), url
        assert r.verdict == (rule[1] if rule else r.verdict) and r.verdict in ("allow", "block")
    assert urls.judge(df.limit(0), none).isEmpty()


def strength(groups):
    n, good = sum(a for a, _ in groups), sum(b for _, b in groups)
    p, nn = good / n, sum(a * a for a, _ in groups)
    spread = (sum(b * b / a for a, b in groups) - n * p * p - p * (1 - p) * (len(groups) - 1)) / (n - nn / n) if n > nn / n else 0
    return max(1.0, min(n, p * (1 - p) / spread - 1 if spread > 0 else n))


def test_reputation_is_brute_force(spark):
    data = {"a.x.com": (50, 5), "b.x.com": (4, 4), "c.y.com": (200, 190), "d.z.org": (1, 0), "": (3, 3), "only": (10, 1), "a.shop.co.uk": (9, 2), "b.other.co.uk": (20, 19), "co.uk": (2, 1)}
    hosts = [*data, "new.x.com", "new.w.net"]
    counts = spark.createDataFrame([(h, *data.get(h, (0, 0))) for h in hosts], "host string, n long, good long")
    got = {r.host: r for r in urls.reputation(counts).collect()}
    up = lambda h, k: ".".join(h.split(".")[-k - (h.split(".")[-2:] == ["co", "uk"]) :])
    level = lambda k: {d: tuple(sum(data[h][i] for h in data if up(h, k) == d) for i in (0, 1)) for d in {up(h, k) for h in data}}
    dom, suf = level(2), level(1)
    hk, dk, sk = strength(list(data.values())), strength(list(dom.values())), strength(list(suf.values()))
    overall = sum(g for _, g in data.values()) / sum(n for n, _ in data.values())
    for h in hosts:
        sn, sg = suf.get(up(h, 1), (0, 0))
        smean = (sg + sk * overall) / (sn + sk)
        dn, dg = dom.get(up(h, 2), (0, 0))
        dmean = (dg + dk * smean) / (dn + dk)
        n, g = data.get(h, (0, 0))
        mean = (g + hk * dmean) / (n + hk)
        bound = mean + 1.645 * (mean * (1 - mean) / (n + hk + 1)) ** 0.5
        assert abs(got[h].mean - mean) < 1e-9 and abs(got[h].bound - bound) < 1e-9, h
        assert abs(got[h].overall - overall) < 1e-9


def test_the_reputation_decides(spark):
    """A host that is credibly worse is blocked, so is one without outcomes below a bad domain; a new one passes."""
    hosts = {**{f"h{i}.good{i}.com": (30, 27) for i in range(20)}, "a.farm.net": (40, 2), "b.farm.net": (40, 1), "c.farm.net": (40, 3), "few.other.com": (2, 1)}
    urls_of = {h: f"http://{h}/q" for h in [*hosts, "new.farm.net", "new.else.com", "few.other.com"]}
    pages = [(i, u) for i, u in enumerate(urls_of.values())]
    marks = [(i, int(k < hosts[h][1])) for i, h in enumerate(urls_of) if h in hosts for k in range(hosts[h][0])]
    got = {r.host: r.verdict for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(marks, "page_id long, good int"), rules=[]).collect()}
    assert {h for h, v in got.items() if v == "block"} == {"a.farm.net", "b.farm.net", "c.farm.net", "new.farm.net"}
    long = spark.createDataFrame([(1, "http://" + "a." * 50_000 + "com/" + "x" * 1_000_000)], "page_id long, url string")
    assert urls.judge(long, spark.createDataFrame([(1, 1)], "page_id long, good int")).selectExpr("length(host)", "length(path)", "verdict").collect() == [(100_003, 1_000_001, "allow")]


def test_outcomes_come_from_the_number_in_the_path(spark):
    pages = spark.createDataFrame([(1, "http://h/en/7?x"), (2, "http://h/en/8.html"), (3, "http://h/none"), (4, None), (5, "http://h/99999999999999999999"), (1, "http://h/en/7")], "page_id long, url string")
    labels = spark.createDataFrame([(7, 1, 0), (8, 1, 1), (7, 1, None), (9, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, urls.page_outcomes(pages, labels).collect())) == [(1, 1), (2, 0)]
    assert urls.page_outcomes(pages, labels.filter(F.lit(False))).isEmpty()


def test_suffix_rules_of_any_length_with_wildcards_and_exceptions(spark):
    rules = ["com", "uk", "CO.uk", "*.ck", "!www.ck", "k12.ma.us", "us", "*.compute.cloud.example", "", None]
    wanted = {
        "www.shop.com": ("shop.com", "com"), "com": ("com", "com"), "a.b.co.uk": ("b.co.uk", "co.uk"), "x.uk": ("x.uk", "uk"), "a.foo.ck": ("a.foo.ck", "foo.ck"), "b.a.foo.ck": ("a.foo.ck", "foo.ck"),
        "www.ck": ("www.ck", "ck"), "a.www.ck": ("www.ck", "ck"), "school.k12.ma.us": ("school.k12.ma.us", "k12.ma.us"), "ma.us": ("ma.us", "us"), "h.z1.compute.cloud.example": ("h.z1.compute.cloud.example", "z1.compute.cloud.example"),
        "cloud.example": ("cloud.example", "example"), "localhost": ("localhost", "localhost"), "": ("", ""), "a..com": (".com", "com"),
    }
    hosts = spark.createDataFrame([(h, 4, 1) for h in wanted], "host string, n long, good long")
    table = spark.createDataFrame([(r,) for r in rules], "rule string")
    assert {r.host: (r.domain, r.suffix) for r in urls.with_parts(hosts, table).collect()} == wanted
    assert urls.reputation(hosts, suffixes=table).count() == len(wanted)
    assert {r.suffix for r in urls.with_parts(hosts, table.limit(0)).collect()} == {h.split(".")[-1] for h in wanted}
