from collections import Counter

import numpy as np

import corpus_pipeline
from sorimill.llm import decontam, quality
from tests.llm.data import documents
from tests.llm.test_decontam import brute as leaks
from tests.llm.test_lines import brute as lines
from tests.llm.test_simhash import brute_print, shingles


def test_stages_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        ids = {r["doc_id"] for r in before}
        after = corpus_pipeline.cut(stage(spark, docs, folder))
        kept = {r.doc_id: r for r in after.collect()}
        assert set(kept) <= ids and len(kept) == after.count()
        if name != "mix_sources":
            assert after.columns == columns
        if name == "quality_rules":
            labels = spark.read.parquet(f"{folder}/labels.parquet")
            assert set(kept) == {r.doc_id for r in quality.judge(docs, labels).where("kept").collect()}
        elif name == "dedup_lines":
            assert {(d, r.text) for d, r in kept.items()} == {(d, t) for d, _, _, t in lines([(r["doc_id"], r["text"]) for r in before])}
            assert all(r.n_chars == len(r.text) for r in kept.values())
        elif name == "dedup_documents":
            # by true similarity, which the stage verifies; not by limits of the fingerprints that it once used
            assert set(kept) == one_of_each([(r["doc_id"], r["text"]) for r in before])
        elif name == "decontaminate":
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert set(kept) == ids - {d for d, _ in leaks([(r["doc_id"], r["text"]) for r in before], bench)}
        else:
            assert set(kept) == ids and all(0 <= r.taken <= 3 * r["size"] for r in kept.values())
            assert abs(sum(r.taken for r in kept.values()) - sum(r["size"] for r in kept.values())) < 0.02 * sum(r["size"] for r in kept.values())
        docs = after


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, None), (4, "few words"), (4, "few words"), (5, "long " * 50_000)]
    for docs in (documents(spark, rows), documents(spark, rows).limit(0), documents(spark, rows, "score places hash uid target")):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            out.collect()
            if stage is not corpus_pipeline.mix_sources:
                assert out.columns == docs.columns


def test_bench_share_is_a_parameter(spark):
    bench = spark.createDataFrame([(0, "a b c d e f g h i j k l m n o p q r s t")], "item_id long, text string")
    docs = documents(spark, [(1, "a b c d e f g h i j k")])
    assert decontam.find_leaks(docs, bench).count() == 0
    assert decontam.find_leaks(docs, bench, share=0.3).count() == 1


def one_of_each(rows):
    """Least id of each group linked by three-word fingerprints or a similarity of 0.8 of five-word shingles."""
    prints, sets = np.array([brute_print(t or "") for _, t in rows], np.uint64), [shingles(t or "") for _, t in rows]
    root, holders = list(range(len(rows))), {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        common = Counter(j for x in sets[i] for j in holders.get(x, ()))
        for x in sets[i]:
            holders.setdefault(x, []).append(i)
        like = [j for j, n in common.items() if n >= 0.8 * len(sets[i] | sets[j])]
        for j in like + np.flatnonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= 3).tolist():
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return set(least.values())


def test_near_stage_by_true_similarity(spark):
    """Of documents linked by three-word fingerprints or a true similarity of 0.8, one stays."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.dedup_documents(spark, docs, folder).collect()}
    assert kept == one_of_each([(r.doc_id, r.text) for r in docs.collect()]) and 709 in kept and 944 not in kept
