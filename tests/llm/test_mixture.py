import math
import re
from collections import Counter, defaultdict

import pytest

from sorimill.llm import mixture, queries
from tests.llm.data import documents, words


def brute_targets(sizes):
    """Reshare the excess until no target is above three times its source."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, rest, free = {}, float(sum(sizes.values())), set(order)
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 3 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
        free -= over
        rest = max(rest, 0.0)
    return target


def check(rows, got, slack=0.02):
    size = [(d, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for d, t, s in rows]
    totals = Counter()
    for _, n, s in size:
        totals[s] += n
    target = brute_targets(dict(totals))
    assert sorted(map(str, size)) == sorted(str((r.doc_id, r["size"], r.source)) for r in got)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == totals[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert abs(n - target[s]) <= max(2 * 128, slack * target[s]), (s, n, target[s])


def test_every_document(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = queries.op10_mix(spark, folder).collect()
    check([(r.doc_id, r.text, r.source) for r in docs.collect()], got)
    again = queries.op10_mix(spark, folder).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_slots_are_whole_passes(spark):
    docs = documents(spark, [(i, words(i, 300), f"s{i % 5}") for i in range(60)])
    mix = mixture.plan_mix(docs, block=16, shard_slots=50)
    sources = {r.source: r for r in mix.sources.collect()}
    times = defaultdict(Counter)
    shards = Counter()
    for r in mix.slots.collect():
        times[r.source][r.block] += 1
        shards[r.shard] += 1
    for s, r in sources.items():
        assert sum(times[s].values()) == r.quota
        n = [times[s][b] for b in range(r.blocks)]
        assert max(n) - min(n) <= 1 and set(times[s]) <= set(range(r.blocks))
    assert set(list(shards.values())[:-1]) <= {50, shards[max(shards)]}
    pieces = mixture.mixed_pieces(mix).collect()
    by_slot = Counter()
    for p in pieces:
        by_slot[p.shard, p.source, p.pass_no, p.block] += p.words
        assert p.first_word >= 0
    assert len(by_slot) == sum(r.quota for r in sources.values()) and max(by_slot.values()) == 16


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 100, 1601, 10_007])
def test_permutations(spark, n):
    from pyspark.sql import functions as F

    got = spark.range(n).select(mixture._permuted(F.col("id"), F.lit(n).cast("long"), [F.lit(1), F.lit(2)]).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(n))
    assert n < 100 or [r.p for r in got] != list(range(n))


def test_edges(spark):
    rows = [(1, None, "b"), (2, "", "a"), (None, words(1, 400), None), (4, words(2, 500), "é"), (4, words(2, 500), "é"), (5, words(3, 5000), "z"), (6, "w", "c"), (7, None, "d")]
    docs = documents(spark, rows, "target")
    check(rows, mixture.taken_words(mixture.plan_mix(docs)).collect())
    empty = mixture.taken_words(mixture.plan_mix(docs.limit(0)))
    assert empty.count() == 0
    none = mixture.taken_words(mixture.plan_mix(docs.where("text is null or text = ''"))).collect()
    assert [(r["size"], r.target, r.taken) for r in none] == [(0, 0.0, 0)] * 3


def test_many_sources_and_one_repeated_id(spark, monkeypatch):
    monkeypatch.setattr(mixture, "SPAN", 2)
    monkeypatch.setattr(mixture, "BUCKET_ROWS", 20)
    rows = [(i, words(i, 30), f"s{i % 150:03}") for i in range(600)]
    rows += [(7, words(10_000 + i, 40), "hot") for i in range(800)] + [(None, words(20_000, 40), "hot")] * 50
    docs = documents(spark, rows)
    got = mixture.taken_words(mixture.plan_mix(docs, block=16, shard_slots=40)).collect()
    check(rows, got, slack=0.2)
    again = mixture.taken_words(mixture.plan_mix(docs.repartition(3), block=16, shard_slots=40)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_running_sums(spark, monkeypatch):
    monkeypatch.setattr(mixture, "SPAN", 8)
    rows = [(k, i, (i * 7) % 5) for k in ("a", None) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    for keys in (["k"], []):
        some = df if keys else df.where("k is null")
        for r in mixture._running(some, keys, "i", "v", "upto").collect():
            assert r.upto == sum((i * 7) % 5 for i in range(r.i + 1))
