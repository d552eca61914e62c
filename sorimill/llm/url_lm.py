"""URL filters: longest-matching rules, then a character language-model ratio.

URLs are strings over ``ALPHABET`` (digits are one letter, other signs
another). Two variable-order Markov models, of accepted and of rejected URLs,
predict each character from up to three before it: at each order the observed
frequencies are mixed with the next shorter context's prediction, weighted by
the number of different characters seen there (Witten-Bell), down to a uniform
start. A URL's score is the mean over its characters of the difference of the
logarithms. The threshold is calibrated on folds of the labelled URLs that the
model of the calibration hasn't seen; it maximises the smaller class accuracy
(the lowest such cut, halfway between two scores).

Labelled URLs are those that a rule decides; all of them are counted, in the
cluster. Counts have at most 40**4 cells for each class, whatever the corpus.

Defined cases: null and URLs without ``://`` have an empty host and path; an
empty URL scores 0; when no rule decides a URL of each kind, the threshold is
minus infinity and the method allows; repeated rows count and are judged each;
an empty table gives an empty table; clashing columns give way.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_ROWS, append_columns, as_bytes

ALPHABET = 40
ORDER = 4
FOLDS = 2
#: Cells that are summed at a time.
BLOCK = 40_000

_CODES = np.full(256, 39, np.int64)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz"):
    _CODES[ord(_c)] = _CODES[ord(_c.upper())] = _i
for _c in "0123456789":
    _CODES[ord(_c)] = 26
for _i, _c in enumerate("/.-_?=&#:%~@"):
    _CODES[ord(_c)] = 27 + _i


def cells(url: bytes) -> np.ndarray:
    """For each character the cell of its three predecessors and itself; starts are padded."""
    code = np.concatenate([np.full(ORDER - 1, 39, np.int64), _CODES[np.frombuffer(url, np.uint8)]])
    n = len(url)
    cell = code[:n].copy()
    for k in range(1, ORDER):
        cell = cell * ALPHABET + code[k : k + n]
    return cell


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of the last character of each cell given the others."""
    shape = (ALPHABET,) * ORDER
    full = counts.reshape(shape).astype(float)
    p = np.full(ALPHABET, 1 / ALPHABET)
    for order in range(ORDER):
        seen = full.sum(axis=tuple(range(ORDER - 1 - order)))  # order predecessors and the character
        total, kinds = seen.sum(axis=-1, keepdims=True), (seen > 0).sum(axis=-1, keepdims=True)
        shorter = np.broadcast_to(p, seen.shape)
        mixed = (seen + kinds * shorter) / np.maximum(total + kinds, 1)
        p = np.where(total > 0, mixed, shorter)
    return np.log(p).reshape(-1)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.instr(url, "://"), F.lit(0)) > 0
    tail = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(tail, r"(?s)^([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(rest, host).otherwise(""), F.when(rest, path).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does."""
    name = verdict = None
    for kind, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        own, slash, start = rule.partition("/")
        fits = (host == own) | F.endswith(host, F.lit("." + own))
        fits = fits & F.startswith(path, F.lit(slash + start))
        name = F.when(fits, F.lit(rule)) if name is None else name.when(fits, F.lit(rule))
        verdict = F.when(fits, F.lit(kind)) if verdict is None else verdict.when(fits, F.lit(kind))
    return (name, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _count(rows: DataFrame) -> DataFrame:
    """(part, block, n): counts of the cells of (url, fold, allowed), a compressed row for each block of cells.

    Part is fold and kind. Each task fills one histogram for each part; blocks of
    them, sparse, are shuffled and summed.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for b in batches:
            part = b.column(1).to_numpy(zero_copy_only=False) * 2 + b.column(2).to_numpy(zero_copy_only=False)
            urls = as_bytes(b.column(0))
            for p in np.unique(part):
                own = counts.setdefault(int(p), np.zeros(ALPHABET**ORDER, np.int64))
                for at in np.array_split(np.flatnonzero(part == p), max(1, len(urls) // SLICE_ROWS)):
                    if len(at):
                        cell, n = np.unique(np.concatenate([cells(urls[i]) for i in at]), return_counts=True)
                        own[cell] += n
        for p, own in counts.items():
            for block in range(0, len(own), BLOCK):
                at = np.flatnonzero(own[block : block + BLOCK])
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p], pa.int32()), pa.array([block // BLOCK], pa.int32())] + [pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.int32), own[block + at])],
                        names=["part", "block", "at", "n"],
                    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(BLOCK, np.int64)

        def done():
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in now] + [pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["part", "block", "n"])

        for batch in batches:
            for part, block, at, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (part, block) != now:
                    if now:
                        yield done()
                    now, total = (part, block), np.zeros(BLOCK, np.int64)
                total[np.frombuffer(at, np.int32)] += np.frombuffer(n, np.int64)
        if now:
            yield done()

    sparse = rows.mapInArrow(fill, "part int, block int, at binary, n binary")
    return sparse.repartition("part", "block").sortWithinPartitions("part", "block").mapInArrow(merge, "part int, block int, n binary")


def _scored(df: DataFrame, url: str, tables, keep: list[str], fold: str | None = None) -> DataFrame:
    def make():
        ratio = tables.value

        def run(urls, folds=None):
            which = folds.to_pylist() if folds is not None else [0] * len(urls)
            return [[float(ratio[f][cells(u)].mean()) if u else 0.0 for u, f in zip(as_bytes(urls), which)]]

        return run

    return append_columns(df, [url, fold] if fold else [url], [T.StructField("score", T.DoubleType(), False)], make, keep)


def judge_urls(df: DataFrame, rules: list[tuple[str, str]], *, url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """Add host, path, rule, score and verdict ("allow" or "block") to every row."""
    spark = df.sparkSession
    taken = {"host", "path", "rule", "score", "verdict"}
    carried = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    host, path = host_and_path(F.col("__url"))
    ruled = df.select(*[F.col(f"`{c}`") for c in carried], F.col(url).alias("__url"))
    ruled = ruled.withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = ruled.withColumn("rule", rule).withColumn("__verdict", verdict)
    fold = F.pmod(F.xxhash64("__url"), F.lit(FOLDS)).cast("int")
    labelled = ruled.where("rule is not null").select("__url", fold.alias("fold"), (F.col("__verdict") == "allow").cast("int").alias("allowed"))
    counts = np.zeros((FOLDS, 2, ALPHABET**ORDER), np.int64)
    for r in _count(labelled).collect():  # at most 4 x 64 compressed blocks of 40,000 cells
        own = np.frombuffer(zlib.decompress(r["n"]), np.int64)
        counts[r["part"] // 2, r["part"] % 2, r["block"] * BLOCK : r["block"] * BLOCK + BLOCK] = own[: ALPHABET**ORDER - r["block"] * BLOCK]
    whole = counts.sum(axis=0)

    def ratio(c):
        return (log_model(c[1]) - log_model(c[0])).astype(np.float32)

    folds = spark.sparkContext.broadcast([ratio(whole - counts[f]) for f in range(FOLDS)] if whole.any() else [np.zeros(ALPHABET**ORDER, np.float32)] * FOLDS)
    unseen = _scored(labelled, "__url", folds, ["allowed"], "fold").groupBy("allowed", F.round("score", 3).alias("score")).agg(F.count("*").alias("n"))
    least = _threshold([(r["score"], r["allowed"], r["n"]) for r in unseen.collect()])  # scores in steps of a thousandth
    final = spark.sparkContext.broadcast([ratio(whole)])
    out = _scored(ruled, "__url", final, [*carried, "host", "path", "rule", "__verdict"])
    by_model = F.when(F.col("score") >= F.lit(least), "allow").otherwise("block")
    return out.withColumn("verdict", F.coalesce("__verdict", by_model)).drop("__verdict")


def _threshold(scored: list[tuple[float, int, int]]) -> float:
    total = [sum(n for _, a, n in scored if a == k) for k in (0, 1)]
    if not all(total):
        return -math.inf
    at = [{}, {}]
    for s, a, n in scored:
        at[a][s] = at[a].get(s, 0) + n
    best, least, blocked, lost, before = -1.0, -math.inf, 0, 0, -math.inf
    for s in sorted({*at[0], *at[1]}):
        right = min(blocked / total[0], 1 - lost / total[1])
        if right > best:
            best, least = right, (before + s) / 2
        before = s
        blocked += at[0].get(s, 0)
        lost += at[1].get(s, 0)
    return least
