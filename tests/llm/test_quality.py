import math
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from sorimill.llm import quality, queries
from tests.llm.data import by_id, documents, words


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", " ", "\n", "\t", "é\u00a0", "#", "a b a b a b a b a ", "\x85", "|"]), max_size=30))
def test_measures(parts):
    text = "".join(parts)
    assert quality.measures(text.encode()) == brute(text)


def test_every_document(spark, sf_dir):
    got = by_id(queries.op4_quality(spark, sf_dir))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        r, want = got[d.doc_id], brute(d.text or "")
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_held_out_accuracy(spark):
    """Half of the labels are withheld; the verdict must find them."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = quality.judge(docs, labels.where("doc_id % 2 = 0"), keep=["doc_id"]).where("not base_failed")
    rows = judged.join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("quality").agg({"*": "count", "kept": "max"}).collect()
    assert {r.quality for r in rows} == {0, 1}
    right = {r.quality: r.right for r in judged.join(labels.where("doc_id % 2 = 1"), "doc_id").selectExpr("quality", "double(kept) as k").groupBy("quality").avg("k").withColumnRenamed("avg(k)", "right").collect()}
    assert right[1] > 0.98 and right[0] < 0.1


def test_ratio_against_brute_force(spark):
    import math

    rows = [(i, words(i, 40)) for i in range(6)]
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "doc_id long, quality int")
    got = by_id(quality.judge(documents(spark, rows), labels))
    corpus, good = Counter(), Counter()
    for i, t in rows:
        b = quality.buckets(t.encode()).tolist()
        corpus.update(b)
        good.update(b * (i < 2))

    def p(c, b):
        more = quality.PRIOR * sum(c.values()) / quality.BUCKETS
        return (c[b] + more) / (sum(c.values()) + more * quality.BUCKETS)

    for i, t in rows:
        b = quality.buckets(t.encode()).tolist()
        want = sum(math.log(p(good, x) / p(corpus, x)) for x in b) / len(b)
        assert abs(got[i]["score"] - want) < 1e-9


def test_edges(spark):
    good = words(1, 60)
    rows = [(1, None), (2, ""), (None, good), (4, good), (4, good), (5, "word " * 200_000), (6, " \n\t")]
    labels = spark.createDataFrame([(4, 1), (4, None), (None, 0), (7, 0)], "doc_id long, quality int")
    df = documents(spark, rows, "Score kept")
    judged = quality.judge(df, labels).collect()
    assert [(r.doc_id, r.kept) for r in sorted(judged, key=lambda r: (r.doc_id or 0, r.n_words))] == [(None, True), (1, False), (2, False), (4, True), (4, True), (5, False), (6, False)]
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and {r.Score for r in kept.collect()} == {"own"} and kept.count() == 3
    assert quality.judge(df.limit(0), labels).count() == 0
    assert quality.judge(df, labels.limit(0)).where("kept").count() == 3


def test_every_label_counts(spark):
    """If all documents are trusted, the trusted model is the corpus, however many labels there are."""
    docs = documents(spark, [(i, words(i, 3)) for i in range(20_500)])
    judged = quality.judge(docs, docs.selectExpr("doc_id", "1 as quality"), keep=["doc_id"])
    assert judged.where("score <> 0").count() == 0


def test_labels_beyond_the_broadcast(spark, sf_dir, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    want = by_id(quality.judge(docs, labels, keep=["doc_id"]))
    monkeypatch.setattr(quality, "small", lambda df: df)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert by_id(quality.judge(docs, labels, keep=["doc_id"])) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_threshold_against_brute_force(spark):
    rng = random.Random(4)
    for n, labels in ((400, [0, 1, 2]), (40, [0, 1]), (1, [0, 1]), (30, [1])):
        rows = [(round(rng.gauss(0.4 * (q == 1), 1), 1), q, rng.randint(1, 3)) for q in (rng.choice(labels) for _ in range(n))]
        at = sorted({s for s, _, _ in rows})
        good, bad = (sum(k for _, q, k in rows if q == of) for of in (1, 0))
        want = -math.inf
        if good and bad:
            right = [min(1 - sum(k for s, q, k in rows if q == 1 and s < x) / good, sum(k for s, q, k in rows if q == 0 and s < x) / bad) for x in at]
            k = right.index(max(right))
            want = (at[k - 1] + at[k]) / 2 if k else -math.inf
        assert quality.best_threshold(spark.createDataFrame(rows, "score double, label int, n long")) == want
