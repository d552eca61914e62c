"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints of 64 bits are split into blocks. If two differ in at most
``BITS`` = 3 bits, at least three of six blocks are equal, so they share one of
the 20 keys made of three blocks. Equal fingerprints are first merged into one
class, so groups of exact copies of any size cost one row. Classes meet by key;
within a key the Hamming distance is verified and each class is linked to the
smallest one of its part of the group. Keys of more than ``GROUP`` classes are
found first, by counting, and compared in random parts of that size. Components of
these links show which classes need no comparison with one another any more: in a
dense group all but a few have one root. If the others are at most ``GROUP``, they
are compared with every part, which grows linearly with the group. If they are
more, the key's remaining bits are split in the same way again. Since the key's own
bits are equal, any close pair in it shares one of the finer keys. After the third
level at most 10 bits remain, and parts meet by chunks, so tasks are bounded and no
pair is lost.

Links are then joined to components by alternating large and small stars over
written tables; nothing of the corpus is gathered on the driver.

``keep_one`` also links texts whose five-word shingles are similar (0.8 or more),
which differ in more bits than keys of shingles can look up. Their distinct word
pairs agree more: fingerprints of these are split into nine blocks, and those
that differ in at most ``NEAR_BITS`` = 6 bits surely share a key of three, those
of up to ``NEAR_MOST`` bits mostly. Texts that have such a neighbour get a
fingerprint of 512 bits over five-word shingles and meet by key once more; two
are linked there if at most ``WIDE_BITS`` bits differ. At a similarity of 0.8,
multisets have a cosine of 8/9, so 77.5 of 512 bits are expected to differ, with
a deviation of 8; the limit lies one and a third deviations above. Links are thus
sure for almost equal texts and likely from 0.8 on, not exact there.

With ``exact``, as in the pipeline, links are the pairs of texts whose sets of
SHINGLE words have a Jaccard similarity of 0.8 or more. Candidates share one of
``BANDS`` keys of ``BAND`` MinHash values each. That depends on the similarity
alone, not on where the edits are: a pair at 0.8 is missed with a probability of
(1 - 0.8 ** 4) ** 24, 3 in a million. Each is then verified on the hashed sets.
Candidates meet the smallest text of their key first; afterwards all pairs of a key
that components hold apart are compared, whatever the key's size. They meet by
sketches of parity: each shingle flips one bit of some four for each shingle of the
set, so two sketches never differ in more bits than the sets do in shingles. A pair
that differs in too many bits is surely not similar; the others are verified. Pairs
become rows only if they pass, and of those only some forests that span a key's
components, until no pair is left that joins two of them and wasn't verified.

Defined cases: a null, empty or blank text has fingerprint zero, linked like any
other; null ids are smaller than none (a component's id is its smallest non-null
id, null if it has none); rows that repeat an id are one document each; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, as_bytes, cut, small

BITS = 3
BLOCKS = 6
#: The same for fingerprints of distinct word pairs; as neighbours count those of up to NEAR_MOST bits.
NEAR_BITS = 6
NEAR_BLOCKS = 9
NEAR_MOST = 10
#: Fingerprints over SHINGLE words of WIDE x 64 bits, and how many may differ.
SHINGLE = 5
WIDE = 8
WIDE_BITS = 88
#: Of a part of a group, so many are compared with all others at a time by these.
WIDE_ROWS = 32
#: Keys of BAND MinHash values that a text has for exact links.
BANDS = 24
BAND = 4
#: Of the pairs of a key that pass the sketches, so many forests are verified at first; twice as many each time.
FORESTS = 8
#: Keys are compared in pairs of parts, some (n / PART) ** 0.5 of them.
PART = 64
#: Classes of a key that are compared in one piece, at most.
GROUP = 8192
#: Of these, so many are compared with all others at a time.
ROWS = 256
#: Shingles turned into bits at a time.
CHUNK = 1 << 16
#: Rounds after which star contraction gives up; it needs about log(n).
ROUNDS = 60

FINGERPRINT = T.StructField("fingerprint", T.LongType(), False)


def _majority(text: bytes, shingle: int, lanes: int = 1, distinct: bool = False) -> bytes:
    """Bits set in over half the hashes of a text's shingles, 64 for each lane.

    The first lane takes the hashes as they are, others mix them anew.
    """
    words = text.lower().split()
    if not words:
        return bytes(8 * lanes)
    n = max(1, len(words) - shingle + 1)
    h, join = xxhash.xxh64_intdigest, b" ".join
    ones = np.zeros((lanes, 64), np.int64)
    once = list({join(words[i : i + shingle]) for i in range(n)}) if distinct else None
    n = len(once) if distinct else n
    for at in range(0, n, CHUNK):
        span = range(at, min(n, at + CHUNK))
        part = np.fromiter((h(once[i] if distinct else join(words[i : i + shingle]), 42) for i in span), np.uint64, len(span))
        for k in range(lanes):
            x = part + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)
            for turn in range(2 if k else 0):
                x = (x ^ (x >> np.uint64(30 + turn))) * np.uint64(0xBF58476D1CE4E5B9)
            x = x ^ (x >> np.uint64(31)) if k else x
            bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[k] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits((2 * ones > n).astype(np.uint8), axis=1, bitorder="little").tobytes()


def fingerprint(text: bytes, shingle: int) -> int:
    """Signed 64-bit SimHash of the words of a UTF-8 text, A-Z lower-cased."""
    return int.from_bytes(_majority(text, shingle), "little", signed=True)


def pairs_fingerprint(text: bytes) -> int:
    """The same of the distinct pairs of words next to each other."""
    return int.from_bytes(_majority(text, 2, distinct=True), "little", signed=True)


def wide_fingerprint(text: bytes) -> bytes:
    """SimHash of WIDE x 64 bits over SHINGLE words."""
    return _majority(text, SHINGLE, WIDE)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the runs of SHINGLE words; a shorter text is one run."""
    words = text.lower().split()
    size = min(len(words), SHINGLE)
    n = len(words) - size + 1 if words else 0
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    x = np.full(n, size, np.uint64)
    for k in range(size):
        x = (x ^ h[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return np.unique(x)


_TURNS = np.random.default_rng(42).integers(0, 1 << 32, (3, BANDS * BAND), np.uint64)
_TIMES, _PLUS = (_TURNS[0] | np.uint64(1)).astype(np.uint32), _TURNS[1].astype(np.uint32)
_JOIN = _TURNS[0].reshape(BANDS, BAND) << np.uint64(32) | _TURNS[2].reshape(BANDS, BAND) | np.uint64(1)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingles, none of an empty one."""
    if not len(shingles):
        return np.empty(0, np.int64)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(BANDS * BAND, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(low, (x[at : at + 1024, None] * _TIMES + _PLUS).min(axis=0), out=low)
    key = np.arange(BANDS, dtype=np.uint64)
    for part, by in zip(low.reshape(BANDS, BAND).T.astype(np.uint64), _JOIN.T):
        key = (key ^ part) * by
        key ^= key >> np.uint64(32)
    return (key * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def parity_sketch(shingles: np.ndarray) -> bytes:
    """Four bits or more for each shingle, flipped once by each; the number of bits is a power of two."""
    bits = 256
    while bits < 4 * len(shingles):
        bits *= 2
    at = ((shingles >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Rows of sketches as those of fewer words, which differ in no more bits."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _maybe_similar(size: np.ndarray, sketch: list[bytes], label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the pairs of different labels that sizes and sketches allow to be similar, in pieces; each once.

    Similar sets differ in at most a ninth of the sum of their sizes. Their sizes
    differ by a quarter at most, so one sketch has no more than twice the words of the other.
    """
    width = np.array([len(x) // 8 for x in sketch])
    for w in np.unique(width):
        own, wider = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        words = lambda at, k: np.frombuffer(b"".join(sketch[i] for i in at), np.uint64).reshape(len(at), int(k))
        full = np.concatenate([words(own, w), _folded(words(wider, 2 * w), w)])
        at, brief = np.r_[own, wider], _folded(full, 4)
        n, of = size[at], label[at]
        for s in range(0, len(own), ROWS):
            e = min(s + ROWS, len(own))
            most = n[s:e, None] + n[None, s:]
            fit = (of[s:e, None] != of[None, s:]) & (9 * np.abs(n[s:e, None] - n[None, s:]) <= most)
            fit[:, : e - s] &= np.triu(np.ones((e - s, e - s), bool), 1)
            bits = np.zeros(fit.shape, np.int64)
            for k in range(4):
                bits += np.bitwise_count(brief[s:e, None, k] ^ brief[None, s:, k])
            i, j = np.nonzero(fit & (9 * bits <= most))
            step = max(1, (1 << 21) // int(w))
            for c in range(0, len(i), step):
                x, y = i[c : c + step] + s, j[c : c + step] + s
                near = 9 * np.bitwise_count(full[x] ^ full[y]).sum(axis=1, dtype=np.int64) <= n[x] + n[y]
                if near.any():
                    yield at[x[near]], at[y[near]]


def add_fingerprint(df: DataFrame, text: str = "text", shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Add the column ``fingerprint`` (a signed long)."""

    def make():
        return lambda column: [pa.array([fingerprint(t, shingle) for t in as_bytes(column)], pa.int64())]

    return append_columns(df, [text], [FINGERPRINT], make, keep)


def _finer(mask: int, blocks: int = BLOCKS, bits: int = BITS) -> list[int]:
    """Keys below a key: its bits and all but ``bits`` of the blocks of the others."""
    free = [i for i in range(64) if not mask >> i & 1]
    parts = [sum(1 << int(i) for i in part) for part in np.array_split(free, blocks)]
    return [mask | sum(parts[k] for k in kept) for kept in combinations(range(blocks), blocks - bits)]


def _keyed(rows: DataFrame, blocks: int = BLOCKS, bits: int = BITS) -> DataFrame:
    """(mask, fp, ...) to (key, mask, fp, ...) for every finer key."""
    schema = T.StructType([T.StructField("key", T.LongType()), *rows.schema.fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[int]] = {}
        for batch in batches:
            masks = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for m in np.unique(masks):
                below = known.setdefault(int(m), _finer(int(m), blocks, bits))
                own = batch.filter(pa.array(masks == m))
                fps = own.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                for mask in below:
                    k = np.uint64(mask)
                    with np.errstate(over="ignore"):  # a hash of mask and masked bits; equal pairs stay equal
                        key = ((fps & k) ^ (k * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
                        key ^= key >> np.uint64(32)
                        key *= np.uint64(0xD6E8FEB86659FD93)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(fps), k).view(np.int64)), *own.columns[1:]], names=names)

    return rows.mapInArrow(run, schema)


def _stars(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links of one group: each fingerprint with the first one of its part."""
    found, open_ = [], fps
    while len(open_) > 1:
        part, rest, edge = [], open_[1:], open_[:1]
        while len(edge) and len(rest):
            near = np.zeros(len(rest), bool)
            for at in range(0, len(edge), ROWS):
                near |= (np.bitwise_count(edge[at : at + ROWS, None] ^ rest[None, :]) <= BITS).any(axis=0)
            edge, rest = rest[near], rest[~near]
            part.append(edge)
        found += [(int(open_[0]), int(x)) for p in part for x in p]
        open_ = rest
    return found


def _linked(keyed: DataFrame) -> DataFrame:
    """Links within keys; rows must hold at most GROUP classes to a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_key = np.empty(0, np.int64)
        kept_fp = np.empty(0, np.uint64)

        def groups(key, fp):
            cuts = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(key)]
            out = []
            pairs = ends - starts == 2
            a, b = fp[starts[pairs]], fp[starts[pairs] + 1]
            near = np.bitwise_count(a ^ b) <= BITS
            out += zip(a[near].tolist(), b[near].tolist())
            for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
                out += _stars(fp[s:e])
            pair = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["u", "v"])

        for batch in batches:
            key = np.r_[kept_key, batch.column(0).to_numpy(zero_copy_only=False)]
            fp = np.r_[kept_fp, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)]
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))  # the last group may go on in the next batch
            kept_key, kept_fp = key[last:], fp[last:]
            if last:
                yield groups(key[:last], fp[:last])
        if len(kept_key):
            yield groups(kept_key, kept_fp)

    placed = keyed.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    return placed.mapInArrow(run, "u long, v long")


def _parted(hot: DataFrame, spread: DataFrame | None = None) -> DataFrame:
    """Rows of keys of ``n`` rows with a key for each part of about GROUP of them.

    With ``spread``, (key, top, m): the ``m`` rows of other labels than ``top`` are
    also cut into chunks, and every part meets every chunk.
    """
    own = [c for c in hot.columns if c not in ("n", "label")]
    seed = [F.col(c) for c in own if c in ("key", "fp", "node")]
    hot = hot.withColumn("__part", F.pmod(F.xxhash64(*seed), F.ceil(F.col("n") / GROUP)))
    if spread is None:
        return hot.withColumn("key", F.xxhash64("key", "__part")).select(*own)
    hot = hot.join(small(spread), "key").withColumn("__chunks", F.ceil(F.col("m") / GROUP))
    hot = hot.withColumn("__chunk", F.pmod(F.xxhash64(*seed, F.lit(1)), F.col("__chunks")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    met = F.transform(upto(F.col("__chunks")), lambda c: F.struct(c.alias("chunk"), F.col("__part").alias("part")))
    others = F.filter(upto(F.ceil(F.col("n") / GROUP)), lambda p: p != F.col("__part"))
    met = F.when(F.col("label") == F.col("top"), met).otherwise(F.concat(met, F.transform(others, lambda p: F.struct(F.col("__chunk").alias("chunk"), p.alias("part")))))
    return hot.withColumn("__at", F.explode(met)).withColumn("key", F.xxhash64("key", "__at.chunk", "__at.part")).select(*own)


def _by_key(rows: DataFrame, linked, blocks: int, bits: int, node: str = "fp", settled=None, split: bool = True) -> DataFrame:
    """``linked`` of the keyed rows (mask, fp, ...).

    Keys of over GROUP rows are compared in parts first. By ``settled``, what was
    found gives (node, root), and rows of one root need no comparison any more. If a
    key has at most GROUP rows beside those of its largest root, these meet every
    part; else its rows go on with finer keys, at the last level by chunks. Finer keys
    keep pairs of ``bits``; where ``linked`` accepts more, ``split`` must be off, so
    that parts meet by chunks at once.
    """
    settled = settled or components
    found, hot_found, free = [], None, 64
    while True:
        keyed = _keyed(rows, blocks, bits)
        free -= free // blocks * (blocks - bits)
        counts = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP))
        if counts.isEmpty():
            found.append(linked(keyed))
            break
        found.append(linked(keyed.join(small(counts.select("key")), "key", "left_anti")))
        hot = cut(keyed.join(small(counts), "key"))
        here = cut(linked(_parted(hot)).distinct())
        found.append(here)
        hot_found = here if hot_found is None else hot_found.unionByName(here).distinct()
        roots = cut(settled(hot_found).select(F.col("node").alias("__node"), F.col("root").cast("string").alias("__root")))
        label = F.coalesce("__root", F.col(node).cast("string")).alias("label")
        hot = hot.join(small(roots), F.col(node) == F.col("__node"), "left").select(*hot.columns, label)
        sizes = hot.groupBy("key", "label").agg(F.count("*").alias("c"))
        sizes = sizes.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("top"), (F.sum("c") - F.max("c")).alias("m"))
        sizes = cut(sizes.where("m > 0"))
        last = not split or free < 2 * blocks
        few = sizes if last else sizes.where(F.col("m") <= GROUP)
        found.append(linked(_parted(hot, few)))
        many = sizes.select("key").subtract(few.select("key"))
        if last or many.isEmpty():
            break
        rows = cut(hot.join(small(many), "key", "left_semi").drop("key", "n", "label"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return cut(out.distinct())


def links(classes: DataFrame) -> DataFrame:
    """(u, v): links among distinct fingerprints ``fp`` that span their components."""
    return _by_key(classes.select(F.lit(0).cast("long").alias("mask"), "fp"), _linked, BLOCKS, BITS)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns behind the key, of each group of two rows or more; batches are sorted by key."""
    kept: pa.Table | None = None

    def of(table: pa.Table):
        key = table.column(0).to_numpy()
        edges = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
        columns = [c.combine_chunks() for c in table.columns[1:]]
        for s, e in zip(edges[:-1], edges[1:]):
            if e - s > 1:
                yield [c.slice(s, e - s).to_numpy(zero_copy_only=False) for c in columns]

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([kept, table]) if kept is not None else table
        if table.num_rows:
            key = table.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # the last group may go on in the next batch
            yield from of(table.slice(0, last))
            kept = table.slice(last)
    if kept is not None:
        yield from of(kept)


def _with_neighbours(keyed: DataFrame) -> DataFrame:
    """``fp`` of those that have another one within NEAR_MOST bits in their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (fp,) in _groups(batches):
            bits, near = fp.view(np.uint64), np.zeros(len(fp), bool)
            for at in range(0, len(fp), ROWS):
                near[at : at + ROWS] = (np.bitwise_count(bits[at : at + ROWS, None] ^ bits[None, :]) <= NEAR_MOST).sum(axis=1) > 1
            if near.any():
                yield pa.RecordBatch.from_arrays([pa.array(fp[near])], names=["fp"])

    return keyed.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "fp long")


def _similar(keyed: DataFrame) -> DataFrame:
    """(u, v): links of nodes within NEAR_MOST and WIDE_BITS in their key that span its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, node, wide in _groups(batches):
            bits = fp.view(np.uint64)
            wide = np.frombuffer(b"".join(wide), np.uint64).reshape(-1, WIDE)
            open_, found = np.arange(len(fp)), []
            while len(open_) > 1:
                first, edge, rest = open_[0], open_[:1], open_[1:]
                while len(edge) and len(rest):
                    near = np.zeros(len(rest), bool)
                    for at in range(0, len(edge), WIDE_ROWS):
                        part, far = edge[at : at + WIDE_ROWS], np.flatnonzero(~near)
                        i, j = np.nonzero(np.bitwise_count(bits[part, None] ^ bits[None, rest[far]]) <= NEAR_MOST)
                        close = np.bitwise_count(wide[part[i]] ^ wide[rest[far[j]]]).sum(axis=1, dtype=np.int64) <= WIDE_BITS
                        near[far[j[close]]] = True
                    edge, rest = rest[near], rest[~near]
                    found += [(node[first], node[x]) for x in edge if node[x] != node[first]]
                open_ = rest
            if found:
                u, v = np.array(found, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    placed = keyed.select("key", "fp", "node", "wide").repartition("key").sortWithinPartitions("key", "fp", "node")
    return placed.mapInArrow(run, "u long, v long")


def _near_prints(rows: DataFrame) -> DataFrame:
    """``fp`` of (mask, fp) that have a neighbour."""
    seen = lambda found: found.select(F.col("fp").alias("node"), F.lit("seen").alias("root"))
    return _by_key(rows, _with_neighbours, NEAR_BLOCKS, NEAR_BITS, settled=seen, split=False)


def similar_links(prints: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v): links among fingerprints of texts that are similar by their shingles.

    ``prints`` has text_hash, fingerprint and pairs_print; ``docs`` has text_hash and text.
    """
    mask = F.lit(0).cast("long").alias("mask")
    spots = cut(prints.groupBy(F.col("pairs_print").alias("fp"), F.col("fingerprint").alias("node")).agg(F.min("text_hash").alias("text_hash")))
    fps = cut(spots.groupBy("fp").agg(F.count("*").alias("n")))
    near = _near_prints(fps.select(mask, "fp"))
    near = cut(near.unionByName(fps.where("n > 1").select("fp")).distinct())
    near = cut(spots.join(small(near), "fp").select(mask, "fp", "node", "text_hash"))

    def make():
        return lambda column: [[wide_fingerprint(t) for t in as_bytes(column)]]

    texts = docs.join(small(near.select("text_hash").distinct()), "text_hash", "left_semi")
    wide = append_columns(texts, ["text"], [T.StructField("wide", T.BinaryType(), False)], make, ["text_hash"])
    wide = wide.groupBy("text_hash").agg(F.min("wide").alias("wide"))  # repeated texts have it once
    return _by_key(cut(near.join(wide, "text_hash").select("mask", "fp", "node", "wide")), _similar, NEAR_BLOCKS, NEAR_BITS, "node", split=False)


def _forests(keyed: DataFrame, forests: int) -> DataFrame:
    """(a, u, b, v): pairs that may be similar, texts and fingerprints; ``a`` is null where there are more.

    ``keyed`` has key, text_hash, fp, label, size, sketch and known, the texts that this one
    needn't meet. Of a key's pairs, ``forests`` forests without common pairs, each of which spans what the last one left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, fp, label, size, sketch, known in _groups(batches):
            met = {(int(a), int(b)) for a, others in zip(text, known) for b in (others if others is not None else ())}
            _, node = np.unique(label, return_inverse=True)
            roots = [np.arange(node.max() + 1) for _ in range(forests)]
            found, more = [], False

            def find(root, x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for i, j in _maybe_similar(size, list(sketch), node):
                last = roots[-1]
                while (last[last] != last).any():
                    last[:] = last[last]
                # nodes that one forest holds together are together in all forests before it
                new = last[node[i]] != last[node[j]]
                more |= not new.all()
                for x, y in zip(i[new].tolist(), j[new].tolist()):
                    if (int(text[x]), int(text[y])) in met:
                        continue
                    for root in roots:
                        a, b = find(root, node[x]), find(root, node[y])
                        if a != b:
                            root[max(a, b)] = min(a, b)
                            found.append((x, y) if text[x] < text[y] else (y, x))
                            break
                    else:
                        more = True
            x, y = np.array(found, np.int64).reshape(-1, 2).T
            columns = [pa.array(c[at].astype(np.int64)) for at in (x, y) for c in (text, fp)]
            if more:
                columns = [pa.concat_arrays([c, pa.array([None], pa.int64())]) for c in columns]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays(columns, names=["a", "u", "b", "v"])

    placed = keyed.select("key", "text_hash", "fp", "label", "size", "sketch", "known").repartition("key").sortWithinPartitions("key", "text_hash")
    return placed.mapInArrow(run, "a long, u long, b long, v long")


def exact_links(prints: DataFrame, docs: DataFrame, edges: DataFrame) -> DataFrame:
    """(u, v): links among fingerprints of texts of a Jaccard similarity of 0.8 or more, beside ``edges``.

    ``prints`` has text_hash, fingerprint and bands; ``docs`` has text_hash and text.
    With ``edges`` they span the components of all such pairs.
    """
    texts = prints.select("text_hash", "fingerprint", "bands").dropDuplicates(["text_hash"])
    rows = cut(texts.select("text_hash", F.col("fingerprint").alias("fp"), F.explode("bands").alias("key")))
    counts = cut(rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("text_hash", "fp")).alias("first")).where("n > 1"))
    rows = cut(rows.join(small(counts), "key"))

    def make():
        def run(column):
            sets = [shingle_set(t) for t in as_bytes(column)]
            return [pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array(map(parity_sketch, sets), pa.binary())]

        return run

    met = cut(rows.select("text_hash").distinct())
    fields = [T.StructField("shingles", T.ArrayType(T.LongType()), False), T.StructField("sketch", T.BinaryType(), False)]
    sets = append_columns(docs.join(small(met), "text_hash", "left_semi"), ["text"], fields, make, ["text_hash"])
    sets = cut(sets.dropDuplicates(["text_hash"]))
    sketches = sets.select("text_hash", F.size("shingles").cast("long").alias("size"), "sketch")

    def verified(pairs: DataFrame) -> DataFrame:
        """Of (a, u, b, v), texts and fingerprints, those that are similar."""
        one, two = (sets.select(F.col("text_hash").alias(x), F.col("shingles").alias(f"{x}s")) for x in "ab")
        both = cut(pairs.distinct()).join(one, "a").join(two, "b")
        both = both.withColumn("common", F.size(F.array_intersect("as", "bs")))
        return cut(both.where(9 * F.col("common") >= 4 * (F.size("as") + F.size("bs"))).select("u", "v").distinct())

    first = rows.where("first.text_hash <> text_hash and first.fp <> fp")
    stars = verified(first.select(F.col("first.text_hash").alias("a"), F.col("first.fp").alias("u"), F.col("text_hash").alias("b"), F.col("fp").alias("v")))
    found, known, forests = stars, None, FORESTS
    while True:
        roots = cut(components(edges.unionByName(found)))
        apart = rows.join(small(roots), F.col("fp") == F.col("node"), "left").select("key", "text_hash", "fp", "n", F.coalesce("root", "fp").alias("label"))
        mixed = apart.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
        apart = cut(apart.join(small(cut(mixed)), "key", "left_semi"))
        texts = cut(sketches.join(small(cut(apart.select("text_hash").distinct())), "text_hash", "left_semi"))
        if known is None:
            texts = texts.withColumn("known", F.lit(None).cast("array<bigint>"))
        else:
            ways = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
            texts = texts.join(ways.groupBy(F.col("a").alias("text_hash")).agg(F.collect_list("b").alias("known")), "text_hash", "left")
        parts = F.greatest(F.ceil(F.sqrt(F.col("n") / PART)), F.ceil(F.col("n") / GROUP))
        part = F.pmod(F.xxhash64("text_hash"), F.col("parts"))
        others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: (p != F.col("part")) | (F.col("parts") == 1))
        dealt = apart.withColumn("parts", parts).withColumn("part", part).withColumn("other", F.explode(others))
        dealt = dealt.withColumn("key", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")))
        pairs = cut(_forests(dealt.join(texts, "text_hash"), forests))
        new = cut(pairs.where("a is not null").distinct())
        found = cut(found.unionByName(verified(new)).distinct())
        if new.isEmpty() or pairs.where("a is null").isEmpty():
            return found
        known = new.select("a", "b") if known is None else cut(known.unionByName(new.select("a", "b")))
        forests *= 2


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the smallest of its component."""
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(ROUNDS):
        if edges.isEmpty():
            break
        # large star: every larger neighbour of u is linked to the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        lower = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(lower.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        same = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        was = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        edges = after
        if tuple(same) == tuple(was):
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _named(docs: DataFrame, doc_id: str, text: str, shingle: int, similar: bool = False, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Written tables: (doc_id, text_hash, fingerprint) of the documents, (fp, root) of their classes."""
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    if exact:
        fields = [FINGERPRINT, T.StructField("bands", T.ArrayType(T.LongType()), False)]

        def make():
            return lambda column: [
                pa.array([fingerprint(t, shingle) for t in as_bytes(column)], pa.int64()),
                pa.array([band_keys(shingle_set(t)) for t in as_bytes(column)], pa.list_(pa.int64())),
            ]

        prints = cut(append_columns(ids, ["text"], fields, make, ["doc_id", "text_hash"]))
    elif similar:
        fields = [FINGERPRINT, T.StructField("pairs_print", T.LongType(), False)]

        def make():
            return lambda column: [
                pa.array([fingerprint(t, shingle) for t in as_bytes(column)], pa.int64()),
                pa.array([pairs_fingerprint(t) for t in as_bytes(column)], pa.int64()),
            ]

        prints = cut(append_columns(ids, ["text"], fields, make, ["doc_id", "text_hash"]))
    else:
        prints = cut(add_fingerprint(ids, "text", shingle, ["doc_id", "text_hash"]))
    classes = cut(prints.select(F.col("fingerprint").alias("fp")).distinct())
    edges = links(classes)
    if exact:
        edges = edges.unionByName(exact_links(prints, ids.select("text_hash", "text"), edges))
    elif similar:
        edges = edges.unionByName(similar_links(prints, ids.select("text_hash", "text")))
    roots = components(edges)
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return prints, cut(named)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document."""
    prints, named = _named(docs, doc_id, text, shingle)
    least = prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least"))
    least = least.join(named, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = cut(named.join(least, "root").select(F.col("fp").alias("fingerprint"), "component_id"))
    return prints.join(by_print, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, exact: bool = False) -> DataFrame:
    """One document of each component, that with the smallest id, with all its columns.

    Links are those of the fingerprints and those of similar five-word shingles,
    by their fingerprints or, with ``exact``, by their Jaccard similarity.
    A document of null id stays only if its component has no other; of rows
    that repeat the kept id and text, one stays. Whole documents are only
    moved if those that go are too many to broadcast, or for repeated rows.
    """
    prints, named = _named(docs, doc_id, text, shingle, similar=not exact, exact=exact)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    by_print = prints.groupBy(F.col("fingerprint").alias("fp")).agg(best.alias("best"))
    by_root = by_print.join(named, "fp").groupBy("root").agg(F.min("best").alias("best"))
    best = named.join(by_root, "root").select(F.col("fp").alias("fingerprint"), "best.doc_id", "best.text_hash").alias("b")
    p = prints.alias("p")
    stays = F.col("p.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("p.text_hash") == F.col("b.text_hash"))
    placed = cut(p.join(best, F.col("p.fingerprint") == F.col("b.fingerprint")).select("p.doc_id", "p.text_hash", stays.alias("stays")))
    key = ["doc_id", "text_hash"]

    def of(kind: DataFrame, how: str, d: DataFrame) -> DataFrame:
        same = F.col(f"d.`{doc_id}`").eqNullSafe(F.col("k.doc_id")) & (F.xxhash64(F.coalesce(F.col(f"d.`{text}`"), F.lit(""))) == F.col("k.text_hash"))
        return d.alias("d").join(small(kind).alias("k"), same, how)

    kept = of(cut(placed.where("not stays").select(*key).distinct()), "left_anti", docs)
    again = cut(placed.where("stays").groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key))
    if again.isEmpty():
        return kept
    once = of(again, "left_semi", kept).withColumn("__hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    return of(again, "left_anti", kept).unionByName(once.dropDuplicates([doc_id, "__hash"]).drop("__hash"))
