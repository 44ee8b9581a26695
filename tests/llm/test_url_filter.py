import math
import re

from packetloom.llm import url_filter as uf
from packetloom.llm.registry import URL_RULES


def parse(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def suffix(host):
    parts = host.split(".")
    return ".".join(parts[-2:]) if ".".join(parts[-2:]) in uf.LONG_SUFFIXES else parts[-1]


def domain(host):
    return ".".join(host.split(".")[-(suffix(host).count(".") + 2) :])


def posterior(pages, labels, most=200.0):
    votes = {}
    for d, q, t in labels:
        if None not in (d, q, t):
            n, k = votes.get(d, (0, 0))
            votes[d] = n + 1, k + (q == 0 or t == 1)
    hosts = {}
    for p, u in pages:
        h = parse(u)[0]
        n, k = hosts.get(h, (0, 0))
        a, b = votes.get(p, (0, 0))
        hosts[h] = n + a, k + b

    def up(level, of):
        out = {}
        for c, (n, k) in level.items():
            a, b = out.get(of(c), (0, 0))
            out[of(c)] = a + n, b + k
        return out

    def shrink(level, of, means):
        extra = room = 0.0
        for c, (n, k) in level.items():
            m = means[of(c)]
            if n:
                extra += n * (k / n - m) ** 2 - m * (1 - m)
                room += m * (1 - m) * (n - 1)
        rho = min(max(extra / room if room else 0.5, 1 / (1 + most)), 0.5)
        s = 1 / rho - 1
        return {c: (s * means[of(c)] + k, s * (1 - means[of(c)]) + n - k) for c, (n, k) in level.items()}

    domains = up(hosts, domain)
    suffixes = up(domains, suffix)
    n, k = map(sum, zip(*suffixes.values(), strict=True))
    mean = lambda found: {c: a / (a + b) for c, (a, b) in found.items()}
    s = mean(shrink(suffixes, lambda c: "", {"": (k + 1) / (n + 2)}))
    d = mean(shrink(domains, suffix, s))
    return shrink(hosts, domain, d)


def brute(pages, labels):
    known = posterior(pages, labels) if pages else {}
    out = []
    for p, u in pages:
        host, path = parse(u)
        rule = rule_of(host, path)
        a, b = known[host]
        low = a / (a + b) - 1.645 * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
        out.append((p, host, path, rule.text if rule else None, rule.verdict if rule else "block" if low > 0.5 else "allow"))
    return sorted(out, key=str)


def run(spark, pages, labels):
    p = spark.createDataFrame([(*r, "h") for r in pages], "page_id long, url string, host string").repartition(3)
    found = uf.judge(p, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), URL_RULES)
    return sorted((tuple(r) for r in found.select("page_id", "host", "path", "rule", "verdict").collect()), key=str)


URLS = [
    "http://EXAMPLE.com/en/x", "https://www.example.com/en/a?b#c", "http://m.www.example.com/en/", "http://notexample.com/en/", "http://a.example.net/es/1", "http://net/fr/", "http://a.net/de/",
    "http://x.com", "http://x.com?q=/en/", "http://x.com/", "ftp://a.co.uk/y://z", "no scheme", "", None, "http:///path", "http://ÄB.org/é", "http://a.org/\nb",
]


def test_rules_and_parsing(spark):
    pages = list(enumerate(URLS)) + [(0, URLS[0]), (None, URLS[1]), (99, "http://long.org/" + "x" * 200_000)]
    assert run(spark, pages, []) == brute(pages, [])


def test_reputation(spark):
    pages = [(k, f"http://h{k % 9}.site{k % 4}.org/") for k in range(300)] + [(400 + k, "http://bad.site0.org/") for k in range(30)] + [(500 + k, "http://fine.biz/") for k in range(5)]
    labels = [(k, int(k % 3 > 0), 0) for k in range(0, 300, 2)] + [(400 + k, 0, k % 2) for k in range(30)] + [(400, 0, 1), (401, None, 1), (None, 0, 0)]
    got = run(spark, pages, labels)
    assert got == brute(pages, labels)
    assert {r[4] for r in got if r[1] == "bad.site0.org"} == {"block"} and {r[4] for r in got if r[1] == "fine.biz"} == {"allow"}


def test_empty(spark):
    assert run(spark, [], []) == []


def test_suffixes_are_an_argument(spark):
    hosts = ["a.b.co.nz", "b.co.nz", "co.nz", "nz", "", "x.y.z.github.io", "a.example.com", "host.k12.ca.us"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    known = ("co.nz", "github.io", "k12.ca.us")
    got = df.select("host", uf.suffix(df.host, known), uf.registered_domain(df.host, known)).collect()
    assert [tuple(r)[1:] for r in got] == [
        ("co.nz", "b.co.nz"), ("co.nz", "b.co.nz"), ("co.nz", "co.nz"), ("nz", "nz"), ("", ""), ("github.io", "z.github.io"), ("com", "example.com"), ("k12.ca.us", "host.k12.ca.us")
    ]
