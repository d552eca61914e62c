"""Line de-duplication with two Bloom filters.

A first pass hashes the keys of long lines into two filters: keys seen at least
once and at least twice (each counted once a document). Each task fills its own
pair; pairs are merged block by block of words in the cluster, where a bit set
once in two of them is set twice. A second pass tests each line against the
second filter, which never misses a repeat. Only the suspected lines, as
128-bit digests with their document's id, are shuffled, counted exactly and,
if confirmed in at least ``least`` documents, lose all places but those in the
largest id. Texts are moved only if the places to drop are too many to
broadcast.

The filter has ``bits`` bits for each 41 bytes of text (no more long lines fit),
at most ``MOST_WORDS`` words of 64 bits, 64 MB. Beyond that it fills up: more
lines are suspected and shuffled, and the result stays the same.

Defined cases: a null or empty text is one empty line; a null id is a document,
smaller than any other; rows that repeat an id are one document, and all of
them keep the lines kept there; an empty table gives an empty table; columns
named n_lines or n_dropped give way.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_ROWS, append_columns, as_bytes, cut, null_first_less, small

MOST_WORDS = 1 << 23
#: Words of a filter that are merged at a time.
BLOCK = 1 << 14
#: Places to drop that are broadcast, at most.
PLACES = 2_000_000


def keys(text: bytes, length: int) -> dict[bytes, list[int]]:
    """Places of each key of at least ``length`` code points."""
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate(text.split(b"\n")):
        if len(line) >= length:
            key = line.strip().lower()
            if len(key) >= length and (key.isascii() or len(key.decode("utf-8")) >= length):
                found.setdefault(key, []).append(i)
    return found


def _masks(h: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.uint64(1)
    mask = one << (h >> np.uint64(58)) | one << (h >> np.uint64(52) & np.uint64(63)) | one << (h >> np.uint64(46) & np.uint64(63))
    return (h & np.uint64(words - 1)).astype(np.int64), mask


def _fill(rows: DataFrame, length: int, words: int) -> DataFrame:
    """(block, at, once, twice): the words of each task's filters that aren't empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        h64 = xxhash.xxh64_intdigest
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                h = np.array([h64(k) for t in as_bytes(whole.column(0).slice(at, SLICE_ROWS)) for k in keys(t, length)], np.uint64)
                h, n = np.unique(h, return_counts=True)
                i, mask = _masks(h, words)
                again = (n > 1) | (once[i] & mask == mask)
                np.bitwise_or.at(twice, i[again], mask[again])
                np.bitwise_or.at(once, i, mask)
        filled = np.flatnonzero(once)
        cuts = np.searchsorted(filled, np.arange(0, words + BLOCK, BLOCK))
        for b in np.flatnonzero(np.diff(cuts)):
            i = filled[cuts[b] : cuts[b + 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(b)], pa.int32())] + [pa.array([x.tobytes()], pa.binary()) for x in ((i - b * BLOCK).astype(np.int32), once[i], twice[i])],
                names=["block", "at", "once", "twice"],
            )

    return rows.mapInArrow(run, "block int, at binary, once binary, twice binary")


def _merged(parts: DataFrame) -> DataFrame:
    """(block, twice): the second filter of the whole corpus, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = -1, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], names=["block", "twice"])

        for batch in batches:
            for block, at, o, t in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if block != now:
                    if now >= 0 and twice.any():
                        yield done()
                    now, once, twice = block, np.zeros(BLOCK, np.uint64), np.zeros(BLOCK, np.uint64)
                i, o, t = np.frombuffer(at, np.int32), np.frombuffer(o, np.uint64), np.frombuffer(t, np.uint64)
                twice[i] |= t | (once[i] & o)
                once[i] |= o
        if now >= 0 and twice.any():
            yield done()

    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block int, twice binary")


def _suspects(rows: DataFrame, length: int, words: int, second) -> DataFrame:
    """(doc_id, text_hash, key, places) of each line whose key may repeat."""
    schema = T.StructType(
        [rows.schema["doc_id"], rows.schema["text_hash"], T.StructField("key", T.BinaryType()), T.StructField("places", T.ArrayType(T.IntegerType()))]
    )
    types = [pa.binary(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = second.value
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE_ROWS):
                part = whole.slice(start, SLICE_ROWS)
                row, key, places = [], [], []
                for r, t in enumerate(as_bytes(part.column(2))):
                    for k, at in keys(t, length).items():
                        row.append(r)
                        key.append(k)
                        places.append(at)
                if not row:
                    continue
                i, mask = _masks(np.fromiter(map(xxhash.xxh64_intdigest, key), np.uint64, len(key)), words)
                hit = np.flatnonzero(twice[i] & mask == mask)
                own = pa.array([row[x] for x in hit], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(own), part.column(1).take(own)]
                    + [pa.array(v, type=t) for v, t in zip(([xxhash.xxh3_128_digest(key[x]) for x in hit], [places[x] for x in hit]), types)],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema)


def places_to_drop(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 40, least: int = 5, bits: int = 8) -> DataFrame:
    """(doc_id, text_hash, places): line numbers that each document loses."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words = BLOCK
    while words < MOST_WORDS and words * 64 < total // (length + 1) * bits:
        words *= 2
    twice = np.zeros(words, np.uint64)
    for r in _merged(_fill(rows.select("text"), length, words)).toLocalIterator():  # at most MOST_WORDS words in all
        twice[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(zlib.decompress(r["twice"]), np.uint64)
    found = cut(_suspects(rows, length, words, spark.sparkContext.broadcast(twice)))
    by_doc = found.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
    confirmed = by_doc.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= least)
    confirmed = cut(confirmed.select("key", "last"))
    gone = found.join(small(confirmed), "key").where(null_first_less(F.col("doc_id"), F.col("last")))
    return gone.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("places")).alias("places"))


def drop_repeated_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, **options) -> DataFrame:
    """Replace each text by its kept lines; add n_lines (before) and n_dropped."""
    gone = cut(places_to_drop(docs, doc_id=doc_id, text=text, **options))
    if (gone.agg(F.sum(F.size("places"))).first()[0] or 0) <= PLACES:
        gone = F.broadcast(gone)
    carried = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_lines", "n_dropped")]
    d, g = docs.alias("d"), gone.alias("g")
    same = F.col(f"d.`{doc_id}`").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64(F.col(f"d.`{text}`")) == F.col("g.text_hash"))
    names = [*carried, *([] if text in carried else [text])]
    both = d.join(g, same, "left").select(*[F.col(f"d.`{c}`") for c in names], F.col("g.places").alias("__places"))

    def make():
        def run(texts, places):
            out, n_lines, n_dropped = [], [], []
            for t, was, gone in zip(as_bytes(texts), texts.is_null().to_pylist(), places.to_pylist()):
                n = t.count(b"\n") + 1
                lost = set(gone or ())
                n_lines.append(n)
                n_dropped.append(len(lost))
                if lost:
                    t = b"\n".join(x for i, x in enumerate(t.split(b"\n")) if i not in lost)
                out.append(None if was else t)
            return [pa.array(out, pa.binary()).cast(pa.string()), n_lines, n_dropped]

        return run

    fields = [T.StructField(text, T.StringType()), T.StructField("n_lines", T.LongType(), False), T.StructField("n_dropped", T.LongType(), False)]
    made = append_columns(both, [text, "__places"], fields, make, [c for c in carried if c != text])
    return made.select(*[F.col(f"`{c}`") for c in carried if c != text], F.col(f"`{text}`"), "n_lines", "n_dropped")
