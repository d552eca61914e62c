"""Quality rules with a hashed n-gram likelihood ratio.

Tokens are runs of letters and digits and runs of other signs. Their 1- and
2-grams are hashed into ``BUCKETS`` buckets; a token doubled is one 2-gram, whatever
the token, as repetition says the same of a text in any vocabulary. Two multinomials are counted: one
over every document, one over those that labels trust. A document's score is
the mean over its n-grams of log p_trusted - log p_corpus, both smoothed by
``PRIOR``. The labelled rows are dealt to two folds; each is scored by the model
of the other fold's trusted rows, as a document is that nobody labelled. The
threshold, one number for all documents, is the one that best separates these
scores (largest smaller class accuracy; ties: the lowest cut). A document is kept if
it fails no base rule and scores at least that by the model of both folds.

Counts cover the whole corpus and every label, as a sum of one histogram for each
task, and the threshold every labelled row, by running sums in ranges of scores.
The table of labels is broadcast up to the limits of ``common.small``; beyond, the
same join shuffles texts. Nothing is bounded but the histogram, whose size is fixed.

Defined cases: a null or empty text has no words, fails the base rule and
scores 0; null ids are unlabelled; an id with several labels takes the lowest;
repeated rows count and are judged each; without labels of both kinds the
threshold is minus infinity (the base rules alone decide); an empty table gives
an empty table; columns of the input that clash with the results give way.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_ROWS, append_columns, as_bytes, cut, small

BITS = 13
BUCKETS = 1 << BITS
#: Added to each bucket's count before dividing, as a share of the mean count.
PRIOR = 0.2
FOLDS = 2
WINDOW = 8

_TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff \t-\r]+")
_SYMBOLS = b"#*$%&|<>"

FIELDS = [
    T.StructField("n_words", T.LongType(), False),
    T.StructField("word_chars", T.LongType(), False),
    T.StructField("n_symbols", T.LongType(), False),
    T.StructField("n_dup_lines", T.LongType(), False),
    T.StructField("n_repeat_words", T.LongType(), False),
    T.StructField("score", T.DoubleType(), False),
]


def buckets(text: bytes) -> np.ndarray:
    """Buckets of the 1- and 2-grams of a text."""
    tokens = _TOKEN.findall(text.lower())
    one = np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (one[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    two[one[:-1] == one[1:]] = 1  # a word said twice in a row is one feature, whatever the word
    mixed = np.concatenate([one * np.uint64(0xD6E8FEB86659FD93), (two ^ (two >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)])
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


_POWERS = np.array([pow(0x5851F42D4C957F2D, k, 1 << 64) for k in range(WINDOW)], np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of eight that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = h[:n] * _POWERS[0]
    for k in range(1, WINDOW):
        w = w + h[k : k + n] * _POWERS[k]
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def measures(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8"))
    return len(words), chars, sum(map(text.count, [bytes([x]) for x in _SYMBOLS])), repeated_lines(text), repeated_words(words)


def _labelled(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    return labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.min(label).alias("__quality"))


def count_ngrams(rows: DataFrame) -> DataFrame:
    """(bucket, corpus, trusted_0, trusted_1) from (text, quality, fold); one histogram for each task."""
    names = ["corpus", *(f"trusted_{k}" for k in range(FOLDS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((1 + FOLDS, BUCKETS), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                part = whole.slice(at, SLICE_ROWS)
                for t, q, fold in zip(as_bytes(part.column(0)), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    own = np.bincount(buckets(t), minlength=BUCKETS)
                    counts[0] += own
                    if q == 1:
                        counts[1 + fold] += own
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(c[at]) for c in counts)], names=["bucket", *names])

    counts = rows.mapInArrow(run, "bucket int, " + ", ".join(f"{n} long" for n in names))
    return counts.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names])


def log_ratios(counts: DataFrame) -> list[np.ndarray]:
    """log p_trusted - log p_corpus of each bucket: for each fold by the other's
    rows, then by all. At most BUCKETS rows reach the driver."""
    whole = np.zeros((1 + FOLDS, BUCKETS))
    for bucket, *n in counts.collect():
        whole[:, bucket] = n

    def logs(x):
        x = x + PRIOR * max(x.sum(), 1.0) / BUCKETS
        return np.log(x / x.sum())

    trusted = whole[1:].sum(axis=0)
    return [logs(t) - logs(whole[0]) if t.any() else np.zeros(BUCKETS) for t in (*(trusted - whole[1 + k] for k in range(FOLDS)), trusted)]


def best_threshold(scored: DataFrame) -> float:
    """The cut, halfway between two scores, that best separates good (1) from bad (0) rows of (score, label, n).

    Scores are dealt by ranges; the driver gets the sums of each range, and the best cut.
    """
    good, bad = (F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(name) for k, name in ((1, "good"), (0, "bad")))
    by_score = cut(scored.groupBy("score").agg(good, bad))
    ranges = cut(by_score.repartitionByRange("score").withColumn("part", F.spark_partition_id()))
    sums = ranges.groupBy("part").agg(F.max("score").alias("high"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()
    all_good, all_bad = sum(r["good"] for r in sums), sum(r["bad"] for r in sums)
    if not all_good or not all_bad:
        return -math.inf
    offsets, so_far = [], (None, 0, 0)
    for r in sorted(sums, key=lambda r: r["high"]):
        offsets.append((r["part"], *so_far))
        so_far = (r["high"], so_far[1] + r["good"], so_far[2] + r["bad"])
    offsets = scored.sparkSession.createDataFrame(offsets, "part int, high double, good_below long, bad_below long")
    order = Window.partitionBy("part").orderBy("score")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    below = lambda name: F.col(f"{name}_below") + F.coalesce(F.sum(name).over(before), F.lit(0))
    right = F.least(1 - below("good") / F.lit(float(all_good)), below("bad") / F.lit(float(all_bad)))
    cuts = ranges.join(F.broadcast(offsets), "part").select("score", F.coalesce(F.lag("score").over(order), "high").alias("last"), right.alias("right"))
    best = cuts.agg(F.max_by(F.struct("score", "last"), F.struct("right", -F.col("score"))).alias("best")).first()["best"]
    return -math.inf if best["last"] is None else (best["last"] + best["score"]) / 2


def judge(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", keep: list[str] | None = None
) -> DataFrame:
    """Add the measures, ``score``, ``base_failed`` and ``kept`` to every document."""
    spark = docs.sparkSession
    given = small(cut(_labelled(labels, doc_id, label)))
    marked = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(given, "__id", "left")
    marked = marked.select("__text", "__quality", F.pmod(F.xxhash64("__id"), F.lit(FOLDS)).cast("int").alias("__fold"))
    ratios = spark.sparkContext.broadcast(log_ratios(count_ngrams(marked)))

    def make():
        models = ratios.value

        def run(texts, folds=None):
            which = folds.to_pylist() if folds is not None else [FOLDS] * len(texts)
            rows = []
            for t, fold in zip(as_bytes(texts), which):
                b = buckets(t)
                rows.append((*measures(t), float(models[fold][b].mean()) if len(b) else 0.0))
            return list(zip(*rows)) or [[] for _ in FIELDS]

        return run

    at = append_columns(marked.where("__quality is not null"), ["__text", "__fold"], FIELDS, make, ["__quality"]).select("score", "__quality", *_failed())
    by_score = at.where("not base_failed").groupBy("score", F.col("__quality").alias("label")).agg(F.count("*").alias("n"))
    least = best_threshold(by_score)
    taken = {"base_failed", "kept"}
    carried = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    out = append_columns(docs, [text], FIELDS, make, carried)
    return out.select("*", *_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(least)))


def _failed():
    return [((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed")]


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that stay, with their own columns."""
    hidden = {f.name for f in FIELDS} | {"base_failed", "kept"}
    if any(c.lower() in hidden for c in docs.columns):
        renamed = docs.select(*[F.col(f"`{c}`").alias(f"__own_{c}") if c.lower() in hidden else F.col(f"`{c}`") for c in docs.columns])
        judged = judge(renamed, labels, **options).where("kept")
        return judged.select(*[F.col(f"`__own_{c}`").alias(c) if c.lower() in hidden else F.col(f"`{c}`") for c in docs.columns])
    return judge(docs, labels, **options).where("kept").select(*[F.col(f"`{c}`") for c in docs.columns])
