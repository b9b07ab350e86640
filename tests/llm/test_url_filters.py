"""The URL filters against SQL on the given pages, and against SQL and a plain version on linked ones."""

import random
import re

import duckdb
from compare import SF, duck, same

from loomgraph.llm import queries, url_filters

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
SCHEMA = "page_id long, url string, html string, host string, rule string, verdict string, bad_host string"


#: Less than in production, so that the walks end sooner.
UNIT = 300


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain(pages):
    rows, links, count = [], set(), {}
    for page_id, url, html in pages:
        host, path = split(url)
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        rows.append((page_id, host, path, rule, verdict))
        if host:
            n = count.setdefault(host, {"n": 0, "allow": 0, "block": 0, None: 0})
            n["n"] += 1
            n[verdict] += 1
        for href in re.findall(r"""(?i)(?:^|[^A-Za-z0-9_-])href\s*=\s*["']?\s*([^"'>\s]+)""", html or ""):
            m = re.match(r"(?i)(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", href)
            if m and host and m[1] and m[1].lower() != host:
                links.add((host, m[1].lower()))
    trust, distrust = {}, {}
    for kind, into, pairs in (("allow", trust, links), ("block", distrust, {(b, a) for a, b in links})):
        at = {h: UNIT for h, n in count.items() if 2 * n[kind] > n["n"]}
        ahead = {}
        for a, b in pairs:
            ahead.setdefault(a, []).append(b)
        while at:
            nxt = {}
            for h, m in at.items():
                into[h] = into.get(h, 0) + m
                for to in ahead.get(h, []):
                    part = m * 85 // (100 * len(ahead[h]))
                    if part:
                        nxt[to] = nxt.get(to, 0) + part
            at = nxt
    return [(i, h, p, r, v or ("block" if distrust.get(h, 0) > trust.get(h, 0) else "allow")) for i, h, p, r, v in rows]


def linked():
    rng = random.Random(3)
    hosts = [f"h{i}.example.{t}" for i in range(12) for t in ("com", "net", "org")] + ["www.example.com", "a.www.example.com", "example.com"]
    pages = []
    for i in range(400):
        host = rng.choice(hosts)
        near = hosts[max(0, hosts.index(host) - 4) : hosts.index(host) + 5]
        hrefs = " ".join(rng.choice(['<a href="https://{}/x">', "<A HREF='//{}'>", "<a href=http://{}?q>", '<a title="x" href = "HTTPS://{}#top">', '<a href="/local/{}">', '<a data-href="https://{}/">']).format(rng.choice(near).upper() if i % 9 == 0 else rng.choice(near)) for _ in range(rng.randrange(3)))
        pages.append((i, f"http{'s' * (i % 2)}://{host.upper() if i % 5 == 0 else host}/{rng.choice(['en', 'es', 'fr', 'de'])}/{i}{rng.choice(['', '?a=/es/', '#x', '/'])}", f"<p>{hrefs}"))
    odd = [None, "", "no scheme", "://", "x://", "http://net/es/", "http://com", "http://com/", "http://xcom/a", "http://COM?/en/", "http://www.example.com/en/1", "http://example.com/en", "ftp://É.net/fr/x", "http://a.net:80/es/", "http://b.org/#://c.net/es/"]
    pages += [(1000 + i, u, None if i % 2 else "<a href=//spam.example.net>" + "x " * 50_000) for i, u in enumerate(odd)]
    return pages + [pages[0], (None, "http://n.net/fr/1", None)]


def test_given_pages_against_sql(spark):
    same(queries.QUERIES["op13_url_filters"](spark, SF), queries.SQL["op13_url_filters"], duck())


def test_linked_hosts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(url_filters, "UNIT", UNIT)
    pages = linked()
    df = spark.createDataFrame([(*p, "x", "x", "x", "x") for p in pages], SCHEMA).repartition(3)
    got = url_filters.judge(df).cache()
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = plain(pages)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
    assert {v for _, _, _, r, v in want if r is None} == {"allow", "block"}
    df.select("page_id", "url", "html").write.parquet(f"{tmp_path}/pages")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages/*.parquet')")
    same(got, queries.SQL["op13_url_filters"].replace("1000000", str(UNIT)), con)


def test_no_pages(spark):
    assert url_filters.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = url_filters.judge(spark.read.parquet(f"{SF}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
