import hashlib
import re
from collections import defaultdict

import numpy as np

from sorimill.llm import line_dedup, queries
from tests.llm.data import by_id, documents


def key(line):
    return re.sub("[A-Z]", lambda m: m.group().lower(), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))


def brute(rows):
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(d)
    last = {k: max((d for d in ds if d is not None), default=None) for k, ds in held.items() if len(ds) >= 5}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if key(x) not in last or d == last[key(x)]]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def run(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in line_dedup.drop_repeated_lines(df).collect()), key=str)


def test_every_document(spark):
    folder = "/root/testdata/sf0.01"
    got = by_id(queries.op7_lines(spark, folder))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = brute(docs)
    assert sum(n for _, _, n, _ in want) > 0
    for d, n, dropped, text in want:
        assert (got[d]["n_lines"], got[d]["n_dropped"], got[d]["kept_sha256"]) == (n, dropped, hashlib.sha256(text.encode()).hexdigest())


LONG = "this line is long enough to count: " + "é" * 5  # 40 code points


def test_edges(spark, monkeypatch):
    rows = [(i, f"{LONG}\nown {i}\n \t{LONG.upper().replace('É', 'é')}\v") for i in range(6)]
    rows += [(10, None), (11, ""), (12, "\n\n"), (3, rows[3][1]), (None, LONG), (20, LONG[:-1]), (21, "x" * 3_000_000 + "\n" + LONG)]
    df = documents(spark, rows, "n_lines")
    assert run(df) == brute(rows)
    assert {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(df).collect()}[10] is None
    assert line_dedup.drop_repeated_lines(df).columns == ["doc_id", "lang", "source", "n_chars", "text", "n_lines", "n_dropped"]
    assert run(df.limit(0)) == []
    # a full filter and a join by shuffle give the same
    monkeypatch.setattr(line_dedup, "PLACES", -1)
    monkeypatch.setattr(line_dedup, "_masks", lambda h, words: (np.zeros(len(h), np.int64), np.ones(len(h), np.uint64)))
    assert run(df) == brute(rows)


def test_four_documents_keep_their_lines(spark):
    rows = [(i, LONG) for i in range(4)] + [(3, LONG + " "), (3, LONG)]
    assert run(documents(spark, rows)) == brute(rows)
    assert sum(r[2] for r in brute(rows)) == 0


def test_the_second_filter_misses_nothing(spark):
    rows = [(i, f"{'line number':>30} {i % 300:>20}") for i in range(900)]
    df = documents(spark, rows).repartition(7).select("text")
    words = line_dedup.BLOCK
    twice = np.zeros(words, np.uint64)
    import zlib

    import xxhash

    for r in line_dedup._merged(line_dedup._fill(df, 20, words)).collect():
        twice[r["block"] * words : (r["block"] + 1) * words] = np.frombuffer(zlib.decompress(r["twice"]), np.uint64)
    seen = [next(iter(line_dedup.keys(t.encode(), 20))) for _, t in rows]
    i, mask = line_dedup._masks(np.array([xxhash.xxh64_intdigest(k) for k in seen], np.uint64), words)
    assert (twice[i] & mask == mask).all()
