import re

import numpy as np

from sorimill.llm import queries, url_lm
from tests.llm.data import by_id

ALPHA = url_lm.ALPHABET


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return re.sub("[A-Z]", lambda x: x.group().lower(), m[1]), m[2]


def rule(host, path):
    fits = []
    for kind, r in queries.URL_RULES:
        own, _, rest = r.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest):
            fits.append((len(r), r, kind))
    return max(fits, default=(0, None, None))[1:]


def test_every_page(spark):
    folder = "/root/testdata/sf0.01"
    got = by_id(queries.op5_urls(spark, folder), "page_id")
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        r = got[p.page_id]
        name, kind = rule(*host_path(p.url))
        assert (r["host"], r["path"], r["rule"]) == (*host_path(p.url), name)
        assert r["verdict"] == kind or (kind is None and r["verdict"] in ("allow", "block"))


def test_model_against_brute_force():
    urls = [b"http://ab.com/x1", b"http://ab.de/yy?q", "http://é.com/".encode()]
    counts = np.zeros(ALPHA**url_lm.ORDER, np.int64)
    for u in urls:
        np.add.at(counts, url_lm.cells(u), 1)
    logs = url_lm.log_model(counts).reshape((ALPHA,) * 4)
    assert np.allclose(np.exp(logs).sum(axis=-1), 1)
    seen = {}
    for u in urls:
        code = [39, 39, 39] + url_lm._CODES[np.frombuffer(u, np.uint8)].tolist()
        for i in range(3, len(code)):
            for k in range(4):
                own = seen.setdefault(tuple(code[i - k : i]), {})
                own[code[i]] = own.get(code[i], 0) + 1

    def p(context, c):
        less = 1 / ALPHA if not context else p(context[1:], c)
        own = seen.get(context) if context else seen[()]
        if context and own is None:
            return p(context[1:], c)
        if not context:
            return (own.get(c, 0) + len(own) / ALPHA) / (sum(own.values()) + len(own))
        return (own.get(c, 0) + len(own) * less) / (sum(own.values()) + len(own))

    for context, c in [((39, 39, 39), 7), ((7, 19, 19), 15), ((0, 1, 30), 2), ((5, 5, 5), 5), ((28, 2, 14), 12)]:
        assert abs(np.exp(logs[(*context, c)]) - p(context, c)) < 1e-12


def test_held_out_accuracy(spark):
    """Rules of one language's paths train; URLs of the same kinds under a host that no rule names are told apart."""
    rows = [(i, f"http://h{i % 7}.example.com/{'en' if i % 2 else 'fr'}/{i}") for i in range(400)]
    rows += [(1000 + i, f"http://k{i % 5}.other.info/{'en' if i % 2 else 'fr'}/{i}") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = by_id(url_lm.judge_urls(pages, [("block", "com/en/"), ("allow", "com/fr/")]), "page_id")
    right = sum(got[1000 + i]["verdict"] == ("block" if i % 2 else "allow") for i in range(40))
    assert right >= 38


def test_edges(spark):
    rows = [(1, None, "own"), (2, "", "own"), (3, "no scheme", "own"), (4, "HTTP://A.Com", "own"), (4, "HTTP://A.Com", "own"), (None, "x://y?a#b" + "z" * 100_000, "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, Host string")
    got = url_lm.judge_urls(pages, queries.URL_RULES)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "score", "verdict"]
    assert [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in sorted(got.collect(), key=lambda r: r.page_id or 0)] == [
        (None, "y", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.com", "", None, "allow"), (4, "a.com", "", None, "allow")
    ]
    assert url_lm.judge_urls(pages.limit(0), queries.URL_RULES).count() == 0
    assert url_lm.judge_urls(pages, []).where("rule is null").count() == 6


def test_verdicts_against_brute_force(spark):
    """Scores and the cut by counting contexts in dictionaries, over all labelled URLs."""
    folder = "/root/testdata/sf0.01"
    urls = [(p.page_id, p.url or "") for p in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    got = by_id(url_lm.judge_urls(spark.read.parquet(f"{folder}/pages.parquet"), queries.URL_RULES), "page_id")
    kinds = {i: rule(*host_path(u))[1] for i, u in urls}
    counts = np.zeros((2, ALPHA**url_lm.ORDER), np.int64)
    for i, u in urls:
        if kinds[i]:
            np.add.at(counts[int(kinds[i] == "allow")], url_lm.cells(u.encode()), 1)
    ratio = url_lm.log_model(counts[1]) - url_lm.log_model(counts[0])
    scores = {i: float(ratio[url_lm.cells(u.encode())].mean()) if u else 0.0 for i, u in urls}
    assert all(abs(got[i]["score"] - s) < 1e-4 for i, s in scores.items())
    free = [(got[i]["score"], got[i]["verdict"]) for i, _ in urls if not kinds[i]]
    allowed, blocked = [s for s, v in free if v == "allow"], [s for s, v in free if v == "block"]
    assert not allowed or not blocked or min(allowed) > max(blocked)  # one cut for all


def test_histograms(spark):
    rows = [(f"http://h{i % 13}.com/{i}", i % 2, i % 3 % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "u string, fold int, allowed int").repartition(5)
    import zlib

    got = np.zeros((4, ALPHA**url_lm.ORDER), np.int64)
    for r in url_lm._count(df).collect():
        own = np.frombuffer(zlib.decompress(r.n), np.int64)
        got[r.part, r.block * url_lm.BLOCK : (r.block + 1) * url_lm.BLOCK] += own
    want = np.zeros_like(got)
    for u, f, a in rows:
        np.add.at(want[2 * f + a], url_lm.cells(u.encode()), 1)
    assert (got == want).all()
