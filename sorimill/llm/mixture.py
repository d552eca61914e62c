"""Mixing sources to target weights, in DataFrame functions only.

1. Each source's documents, in the order of a hash of id and text, are one stream
   of words, packed into blocks of ``block`` words (the last may be shorter).
   Offsets come from levels of running sums: within small hash buckets of a
   source, within spans of its buckets, then over the spans. So no task sorts a
   whole hot source, nor all its buckets or shards. Only the sources themselves,
   a row for each, meet in one task.
2. Targets fill the total by weight, none above ``cap`` times its source.
3. For each output shard, ``shard_slots`` draws of a keyed hash give its
   multinomial counts by source. Draws beyond a source's quota of blocks go, in
   order, to the sources that are short, so totals are exact.
4. The j-th slot of a source takes block perm(j mod n), where perm is a keyed
   Feistel permutation of its n blocks, another one for each pass. A block is
   thus taken as often as any other of its source, give or take one.
5. Slots and documents meet by (source, block index).

Everything follows from ids, sizes, sources and the seed: reruns agree.

Defined cases: a null or empty text has size 0 and is never taken; a null
source is a source, the last one; null and repeated ids are rows of their own;
if all sizes are 0, targets are 0 and nothing is taken; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, small, words_of

#: Documents in a bucket of a running sum, about.
BUCKET_ROWS = 500
#: Buckets, or shards, whose sums make one of the next level.
SPAN = 1024
#: Steps of the draw's lookup table.
STEPS = 4096


@dataclass
class Mix:
    """sources: source, source_size, target, blocks, quota. slots: shard, source,
    pass_no, block. pieces: uid, source, block, words of a document in a block.
    documents: uid, doc_id, source, size."""

    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame
    documents: DataFrame


def _running(df: DataFrame, keys: list[str], order: str, value: str, output: str) -> DataFrame:
    """Add the sum of ``value`` over a key's rows up to each, by ``order``, a whole number from 0 on.

    Summed within spans of the order, then over the spans, so that no task gets all rows of a key.
    """
    key = [F.col(k) for k in keys]
    df = df.withColumn("__span", F.floor(F.col(order) / SPAN).cast("long"))
    spans = df.groupBy(*key, "__span").agg(F.sum(value).alias("__held"))
    over = W.partitionBy(*key).orderBy("__span").rowsBetween(W.unboundedPreceding, 0)
    spans = spans.withColumn("__before", F.sum("__held").over(over) - F.col("__held")).drop("__held").alias("t")
    inner = W.partitionBy(*key, "__span").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumn(output, F.sum(value).over(inner)).alias("r")
    same = F.col("r.__span") == F.col("t.__span")
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}"))
    own = [F.col(f"r.{c}") for c in df.columns if c != "__span"]
    return rows.join(spans, same).select(*own, (F.col(f"r.{output}") + F.col("t.__before")).alias(output))


def _targets(totals: DataFrame, cap: float, block: int) -> DataFrame:
    """Water filling: sources in the order of cap by weight; rank is by code point, null last."""
    every = W.partitionBy()
    t = totals.withColumn("rank", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())))
    t = t.withColumn("weight", 1 + (F.col("rank") - 1) % 3).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    t = t.withColumn("ratio", F.col("most") / F.col("weight")).withColumn("all", F.sum("source_size").over(every))
    upto = every.orderBy("ratio").rangeBetween(W.unboundedPreceding, W.currentRow)
    t = t.withColumn("filled", F.sum("most").over(upto) + F.col("ratio") * (F.sum("weight").over(every) - F.sum("weight").over(upto)))
    t = t.withColumn("capped", F.col("filled") <= F.col("all"))
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)
    rest = F.col("all") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(every), F.lit(0.0))
    t = t.withColumn("level", rest / free)
    t = t.withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(F.col("weight") * F.col("level")))
    t = t.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    quota = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * F.col("blocks"))).otherwise(0).cast("long")
    t = t.withColumn("quota", quota)
    t = t.withColumn("high", F.sum("quota").over(every.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)))
    return t.select("rank", "source", "source_size", "target", "blocks", "quota", (F.col("high") - F.col("quota")).alias("low"), "high")


def _permuted(j: Column, n: Column, key: list[Column]) -> Column:
    """A keyed permutation of 0..n-1: Feistel over a x b >= n, walking on while outside."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def once(x):
        def turn(acc, k):
            left = F.pmod(acc["l"] + F.pmod(F.xxhash64(*key, k, acc["r"]), a), a)
            right = F.pmod(acc["r"] + F.pmod(F.xxhash64(*key, k, acc["l"]), b), b)
            return F.struct(
                F.when(k % 2 == 0, left).otherwise(acc["l"]).alias("l"), F.when(k % 2 == 0, acc["r"]).otherwise(right).alias("r")
            )

        start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, b).alias("r"))
        turns = F.array(*[F.lit(k) for k in range(6)])
        return F.aggregate(turns, start, turn, lambda acc: acc["l"] * b + acc["r"])

    # at most a - 1 values lie outside, so 40 steps are certain up to 1600 blocks
    # and fail with a chance of n**-20 beyond
    return F.aggregate(F.sequence(F.lit(1), F.lit(40)), once(j), lambda x, _: F.when(x < n, x).otherwise(once(x)))


def plan_mix(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    block: int = 128,
    cap: float = 3.0,
    shard_slots: int = 4096,
    seed: int = 20,
) -> Mix:
    """Size, target and place everything; texts are read once, for their sizes."""
    sized = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.size(words_of(F.col(text))).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("order"),  # repeated ids don't fall together
    )
    sized = cut(sized)
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = cut(_targets(totals, cap, block))
    facts = sources.agg(F.sum("quota"), F.sum("source_size")).first()
    n_slots = facts[0] or 0
    n_buckets = max(1, sized.count() // BUCKET_ROWS)

    placed = sized.withColumn("bucket", F.pmod("order", F.lit(n_buckets)))
    of_bucket = placed.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    of_bucket = _running(of_bucket, ["source"], "bucket", "held", "upto")
    of_bucket = of_bucket.select("source", "bucket", (F.col("upto") - F.col("held")).alias("before")).alias("b")
    inner = W.partitionBy("source", "bucket").orderBy("order", "doc_id", "size", "uid").rowsBetween(W.unboundedPreceding, 0)
    placed = placed.withColumn("within", F.sum("size").over(inner) - F.col("size")).alias("p")
    same = F.col("p.source").eqNullSafe(F.col("b.source")) & (F.col("p.bucket") == F.col("b.bucket"))
    placed = placed.join(of_bucket, same).select("p.uid", "p.source", "p.size", (F.col("within") + F.col("before")).alias("at"))
    full = placed.where("size > 0")
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    pieces = full.select("uid", "source", "size", "at", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("at"), F.col("block") * block)
    end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    pieces = pieces.select("uid", "source", "block", (end - begin).alias("words"), (begin - F.col("at")).alias("from"))

    # multinomial counts by shard
    spark = docs.sparkSession
    step = max(1, -(-n_slots // STEPS))
    tasks = max(1, min(2000, n_slots // 100_000 + 1))
    draws = spark.range(0, n_slots, 1, tasks).select(
        F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "id"), F.lit(max(1, n_slots))).alias("v")
    )
    table = sources.where("quota > 0").select(
        "rank", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / step), F.floor((F.col("high") - 1) / step))).alias("step")
    )
    drawn = draws.withColumn("step", F.floor(F.col("v") / step)).join(small(table), "step").where("v >= low and v < high")
    counts = cut(drawn.groupBy("shard", "rank").agg(F.count("*").alias("drawn")))

    quotas = sources.select("rank", "quota")
    kept = _running(counts, ["rank"], "shard", "drawn", "upto").join(quotas, "rank")
    kept = kept.select("shard", "rank", F.greatest(F.lit(0), F.least("drawn", F.col("quota") - F.col("upto") + F.col("drawn"))).alias("taken"), "drawn")
    short = kept.groupBy("shard").agg((F.sum("drawn") - F.sum("taken")).alias("n")).where("n > 0")
    short = _running(short, [], "shard", "n", "upto")
    short = short.select("shard", F.explode(F.expr("sequence(upto - n, upto - 1)")).alias("unit"))
    used = kept.groupBy("rank").agg(F.sum("taken").alias("used"))
    left = quotas.join(used, "rank", "left").select("rank", (F.col("quota") - F.coalesce("used", F.lit(0))).alias("n")).where("n > 0")
    left = _running(left, [], "rank", "n", "upto")
    left = left.select("rank", F.explode(F.expr("sequence(upto - n, upto - 1)")).alias("unit"))
    moved = short.join(left, "unit").groupBy("shard", "rank").agg(F.count("*").alias("taken"))
    final = kept.select("shard", "rank", "taken").unionByName(moved).groupBy("shard", "rank").agg(F.sum("taken").alias("taken")).where("taken > 0")

    # slots: the j-th of a source takes block perm(j mod n) of pass j div n
    final = _running(final, ["rank"], "shard", "taken", "upto").repartition(tasks, "shard", "rank")
    slots = final.select("shard", "rank", F.explode(F.expr("sequence(upto - taken, upto - 1)")).alias("j"))
    slots = slots.join(sources.select("rank", "source", "blocks"), "rank")
    slots = slots.withColumn("pass_no", F.floor(F.col("j") / F.col("blocks"))).withColumn("slot", F.pmod("j", "blocks"))
    taken = _permuted(F.col("slot"), F.col("blocks"), [F.lit(seed), F.col("rank"), F.col("pass_no")])
    slots = cut(slots.select("shard", "source", "pass_no", taken.alias("block")))
    return Mix(sources, slots, pieces, sized)


def mixed_pieces(mix: Mix) -> DataFrame:
    """The mix itself: for each slot, the runs of words of the documents in its block."""
    s, p = mix.slots.alias("s"), mix.pieces.alias("p")
    same = F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.block") == F.col("p.block"))
    d = mix.documents.select(F.col("uid").alias("u"), "doc_id")
    out = s.join(p, same).join(d, F.col("p.uid") == F.col("u"))
    return out.select("s.shard", "s.source", "s.pass_no", "s.block", "doc_id", F.col("p.from").alias("first_word"), "p.words")


def taken_words(mix: Mix) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every document."""
    times = mix.slots.groupBy("source", "block").agg(F.count("*").alias("times")).alias("t")
    p = mix.pieces.alias("p")
    same = F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.block") == F.col("t.block"))
    taken = p.join(times, same).groupBy(F.col("p.uid").alias("uid")).agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    docs = mix.documents.join(taken, "uid", "left").alias("d")
    s = small(mix.sources.select("source", "source_size", "target")).alias("s")
    out = docs.join(s, F.col("d.source").eqNullSafe(F.col("s.source")))
    return out.select("d.doc_id", "d.source", "d.size", "s.source_size", "s.target", F.coalesce("d.taken", F.lit(0)).cast("long").alias("taken"))
