"""A user lexicon: surface forms with fixed readings, matched leftmost and longest.

Entries are checked on the way in and their readings are read once by the rules. Up
to MAX_INLINE of them become an alternative of the scan: an earlier start wins, and
where both start at once the lexicon does. More of them are looked up by an automaton
in Arrow batches, and the same order decides between them and the scan's tokens. An
entry never reaches into protected structure.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.composed import nfc
from ..functions.numbers import let
from . import normalize as n

MAX_KEY, MAX_VALUE, MAX_ENTRIES, MAX_TOTAL, MAX_INLINE = 256, 4096, 100_000, 10_000_000, 5_000
MATCHES = "array<struct<start:int,end:int,key:string,value:string>>"


def check_entries(
    entries: Mapping[str, str], *, max_key: int = MAX_KEY, max_value: int = MAX_VALUE, max_entries: int = MAX_ENTRIES, max_total: int = MAX_TOTAL
) -> dict[str, str]:
    """The entries in NFC; raises ValueError for what can't be an entry."""
    for name, limit in (("max_key", max_key), ("max_value", max_value), ("max_entries", max_entries), ("max_total", max_total)):
        n.positive(name, limit)
    if not isinstance(entries, Mapping):
        raise ValueError("a lexicon is a mapping of strings")
    if len(entries) > max_entries:
        raise ValueError(f"a lexicon has at most {max_entries} entries")
    out: dict[str, str] = {}
    for pair in entries.items():
        for text, most in zip(pair, (max_key, max_value)):
            if not isinstance(text, str) or not text or len(text) > most:
                raise ValueError(f"lexicon text must be 1 to {most} characters: {text!r:.40}")
            if any(unicodedata.category(c) in ("Cc", "Cf", "Cs") for c in text):
                raise ValueError(f"lexicon text holds control characters: {text!r:.40}")
        key, value = (unicodedata.normalize("NFC", x) for x in pair)
        if key in out:
            raise ValueError(f"key given twice: {key}")
        out[key] = value
    if sum(len(k) + len(v) for k, v in out.items()) > max_total:
        raise ValueError(f"a lexicon has at most {max_total} characters")
    return out


def compiled(spark: SparkSession, entries: Mapping[str, str]) -> dict[str, str]:
    """Checked entries, their readings read once; raises ValueError where that isn't final."""
    entries = check_entries(entries)
    odd = {v for v in entries.values() if not re.fullmatch(r"[가-힣 ]*", v)}
    if odd:
        rows = spark.createDataFrame([(v,) for v in odd], "v string").select("v", n.normalize(F.col("v"), max_length=MAX_VALUE).alias("s"))
        rows = rows.select("v", "s", n.convert(F.col("s"), max_length=n.GROWTH * MAX_VALUE).alias("r"))
        unsound = rows.where((F.col("r.normalized_text") != F.col("s")) | ~F.col("r.complete")).limit(1).collect()
        if unsound:
            raise ValueError(f"a reading must be final: {unsound[0]['v']!r:.40}")
        said = {r["v"]: r["s"] for r in rows.select("v", "s").collect()}  # at most MAX_ENTRIES short texts
        entries = {k: said.get(v, v) for k, v in entries.items()}
    return entries


def read_lexicon(spark: SparkSession, path: str) -> dict[str, str]:
    """A lexicon from a JSON object of strings; at most MAX_ENTRIES come to the driver."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    rows = text.select(F.explode("m")).limit(MAX_ENTRIES + 1).collect()
    return check_entries({r["key"]: r["value"] for r in rows})


def pattern(keys) -> str:
    """Longest first; no letter or digit may touch a key, nor Hangul its Hangul ends."""

    def one(key: str) -> str:
        left = "(?<![A-Za-z0-9가-힣])" if "가" <= key[0] <= "힣" else "(?<![A-Za-z0-9])"
        right = "(?![A-Za-z0-9가-힣])" if "가" <= key[-1] <= "힣" else "(?![A-Za-z0-9])"
        return left + re.escape(key) + right

    return "|".join(one(k) for k in sorted(keys, key=lambda k: (-len(k), k)))


def inline(entries: Mapping[str, str]) -> tuple[str, Column]:
    """(pattern, readings) of entries that go into the scan."""
    entries = compiled(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), entries)
    if len(entries) > MAX_INLINE:
        raise ValueError(f"more than {MAX_INLINE} entries: use with_matches() and normalize_matched()")
    first = "".join(sorted({re.escape(k[0]) for k in entries}))
    return f"(?=[{first}])(?:{pattern(entries)})", F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def normalize_with(text: Column, entries: Mapping[str, str]) -> Column:
    """normalize() with the entries' readings in place of their surface forms."""
    return n.normalize(text, lexicon=check_entries(entries))


def find_matches(text: str, automaton) -> list[tuple[int, int, str, str]]:
    """Leftmost longest entries of an automaton (key to (key, value)) that no letter, digit or syllable touches."""

    def open_(c: str, at: int) -> bool:
        other = text[at : at + 1] if at >= 0 else ""
        return not (other and (other.isascii() and other.isalnum() or "가" <= c <= "힣" and "가" <= other <= "힣"))

    found = sorted((end + 1 - len(key), -len(key), key, value) for end, (key, value) in automaton.iter(text))
    out, free = [], 0
    for start, size, key, value in found:
        if start >= free and open_(key[0], start - 1) and open_(key[-1], start - size):
            out.append((start, start - size, key, value))
            free = start - size
    return out


def with_matches(df: DataFrame, text: str, entries: Mapping[str, str], output: str = "matches") -> DataFrame:
    """Add the entries found in a column's composed text: (start, end, key, value); null for null.

    The entries, at most MAX_ENTRIES short texts, are broadcast; each task builds one automaton.
    """
    import ahocorasick

    spark = df.sparkSession
    given = spark.sparkContext.broadcast(compiled(spark, entries))
    carried = [c for c in df.columns if c != output]
    schema = T.StructType([df.schema[c] for c in carried] + T._parse_datatype_string(f"`{output}` {MATCHES}").fields)
    made = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("key", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for k, v in given.value.items():
            automaton.add_word(k, (k, v))
        if len(automaton):
            automaton.make_automaton()
        for batch in batches:
            rows = [None if t is None else find_matches(t, automaton) if len(automaton) else [] for t in batch.column(len(carried)).to_pylist()]
            dicts = [None if r is None else [dict(zip(("start", "end", "key", "value"), x)) for x in r] for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array(dicts, made)], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in carried], nfc(F.col(text)).alias("__nfc")).mapInArrow(run, schema)


def normalize_matched(text: Column, matches: Column) -> Column:
    """normalize() with the readings of the entries found by ``with_matches``."""

    def of(x: Column) -> Column:
        found, whole = x["matches"], x["text"]

        def merged(stream: Column) -> Column:
            def placed(at: Column) -> Column:
                fields = lambda start, end, first, spoken: F.struct(start.alias("start"), first.alias("rank"), end.alias("end"), spoken.alias("spoken"))
                base = F.transform(stream, lambda s, i: F.struct(s["kind"].alias("kind"), F.get(at, i).alias("start"), F.length(n.unguarded(s["token"])).alias("size"), n.unguarded(s["spoken"]).alias("spoken")))
                walls = F.filter(base, lambda b: b["kind"] == "protected")
                own = F.transform(F.filter(base, lambda b: b["kind"] != "gap"), lambda b: fields(b["start"], b["start"] + b["size"], F.when(b["kind"] == "protected", -1).otherwise(1), b["spoken"]))
                free = F.filter(found, lambda m: ~F.exists(walls, lambda w: (w["start"] < m["end"]) & (m["start"] < w["start"] + w["size"])))
                given = F.transform(free, lambda m: fields(m["start"], m["end"], F.lit(0), m["value"]))
                start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

                def step(acc: Column, m: Column) -> Column:
                    # what starts inside an accepted piece is passed over; its rest is copied
                    text_before = F.substring(whole, acc["at"] + 1, m["start"] - acc["at"])
                    return F.when(m["start"] < acc["at"], acc).otherwise(F.struct(m["end"].alias("at"), F.concat(acc["out"], text_before, m["spoken"]).alias("out")))

                done = lambda acc: F.concat(acc["out"], F.substring(whole, acc["at"] + 1, F.length(whole)))
                return F.aggregate(F.array_sort(F.concat(own, given)), start, step, done)

            return let(n._starts(stream), placed)

        return let(n.spoken_tokens(whole), merged)

    return let(F.struct(nfc(n.checked(text)).alias("text"), matches.alias("matches")), lambda x: F.when(x["text"].isNotNull(), of(x)))


def lookup(df: DataFrame, key: str, lexicon: DataFrame, output: str = "reading") -> DataFrame:
    """Whole-value lookup of a column in a lexicon table (key, value), of any size."""
    entries = lexicon.select(F.col("key").alias("__key"), F.col("value").alias(output)).dropDuplicates(["__key"])
    return df.join(entries, F.col(key) == F.col("__key"), "left").drop("__key")


def unstable_entries(lexicon: DataFrame) -> DataFrame:
    """Entries whose reading the rules would change again; a sound lexicon has none."""
    return lexicon.where(n.normalize(F.col("value")) != F.col("value"))
