"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts become words in lower case without punctuation, read in three ways: as they
are; as templates with typed placeholders for numbers, units behind a number, and
names (capitalised words inside a sentence); and as templates where every
capitalised word is a placeholder, as a name may open a sentence. Windows of
``window`` words of each reading are hashed and joined with those of the benchmark
items. A window equal as it is is a copy, whatever its case and punctuation. One
equal as a template counts only if, in the whole copy that it belongs to (windows of
the item near each other and in order, whatever the length of what is replaced), every
value of the item is replaced by one value throughout, and no two names by the same
one: a re-parameterised question. An item is found in a document when at
least ``share`` of its windows, or ``run`` of them, are, in any reading.

A name replaced by one of more words, or fewer, counts as inconsistent.

Only the windows' hashes are exploded; the words at the placeholders are looked
up again for the few windows that joined. The benchmark's windows are broadcast
if their number is below the checked limit, else the join shuffles.

Defined cases: null and empty texts have no windows, on either side; an item of
fewer words than ``window`` is one window of its own length; a window with
fewer than ``literals`` plain words (all, for an item that short) counts only as
a copy, with its own values; null ids stay null; rows that repeat an id and text
are one document, rows that repeat only an id are reported under it each; an
empty table on either side gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, small

#: Unit words behind a number, in English, German, French and Spanish.
UNITS = sorted(
    set(
        (
            "kg g mg lb lbs oz ton tons km m cm mm mi mile miles ft foot feet inch inches yard yards l ml liter liters litre litres "
            "gallon gallons second seconds sec minute minutes min hour hours hr day days week weeks month months year years "
            "dollar dollars cent cents euro euros percent degree degrees mph kmh watt watts volt volts byte bytes mb gb kilo kilos "
            "kilogramm gramm tonne tonnen meter metern zentimeter kilometer kilometern millimeter sekunde sekunden minuten stunde stunden "
            "tag tage tagen woche wochen monat monate monaten jahr jahre jahren prozent grad "
            "kilogramme kilogrammes gramme grammes tonnes mètre mètres centimètre centimètres kilomètre kilomètres seconde secondes heure heures "
            "jour jours semaine semaines mois an ans année années degré degrés "
            "kilogramo kilogramos gramo gramos tonelada toneladas metro metros centímetro centímetros kilómetro kilómetros litro litros "
            "segundo segundos minuto minutos hora horas día días semana semanas mes meses año años dólar dólares grado grados"
        ).split()
    )
)
#: Number words from two on, in the same languages.
NUMBERS = sorted(
    set(
        (
            "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "
            "thirty forty fifty sixty seventy eighty ninety hundred thousand "
            "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend "
            "deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille "
            "dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil"
        ).split()
    )
)

#: Marks in front of a capitalised word: inside a sentence; anywhere else, where it may be a name.
NAME, MAYBE = "\u0001", "\u0002"

#: Hashes of the benchmark's windows that are part of the plan, at most; more are joined with all windows.
INLINE = 20_000
#: Windows found by their template that are broadcast to look up their words, at most.
SLOTTED = 200_000


def _tokens(text: Column) -> Column:
    """Words in lower case; a name has NAME in front, another capitalised word MAYBE."""
    # each pattern begins with a rare character, so that most places fail at once
    t = F.when(F.contains(text, F.lit(NAME)) | F.contains(text, F.lit(MAYBE)), F.regexp_replace(text, "[\u0001\u0002]", " ")).otherwise(text)
    t = F.regexp_replace(t, r"\p{Lu}(?=\p{Ll})(?<=[\p{Ll}\p{Nd},;:] .)", NAME + "$0")
    t = F.regexp_replace(t, r"\p{Lu}(?=\p{Ll})(?<![^\x00\x02-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F].)", MAYBE + "$0")
    t = F.lower(t)
    t = F.regexp_replace(t, r"[.,](?=[0-9])(?<=[0-9].)", "")
    t = F.regexp_replace(t, r"[0-9](?=[a-z])", "$0 ")
    return F.filter(F.split(t, r"[\x00\x03-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _is_number(w: Column) -> Column:
    return ((w >= "0") & (w < ":")) | w.isin(NUMBERS)


def _slots(marked: Column, words: Column) -> Column:
    """For each token its placeholder, or null for a plain word."""
    return F.transform(
        marked,
        lambda w, i: F.when(_is_number(F.get(words, i)), F.lit("<num>"))
        .when(F.get(words, i).isin(UNITS) & (i > 0) & _is_number(F.get(words, i - 1)), F.lit("<unit>"))
        .when(F.startswith(w, F.lit(NAME)), F.lit("<name>")),
    )


def _templates(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, tokens, and for each reading its slots and h: the hash of each word.

    Reading 0 has no slots, 1 has them for names inside sentences, 2 for every capitalised word.
    """
    df = df.select(*keys, _tokens(F.col(text)).alias("marked"))
    df = df.select(*keys, "marked", F.transform("marked", lambda w: F.translate(w, NAME + MAYBE, "")).alias("tokens"))
    df = df.select(*keys, "marked", "tokens", _slots(F.col("marked"), F.col("tokens")).alias("slots1"))
    any_name = F.zip_with("marked", "slots1", lambda w, s: F.coalesce(s, F.when(F.startswith(w, F.lit(MAYBE)), F.lit("<name>"))))
    df = df.select(*keys, "tokens", "slots1", any_name.alias("slots2"), F.transform("tokens", lambda w: F.xxhash64(w)).alias("h0"))
    slotted = [F.zip_with("h0", f"slots{r}", lambda h, s: F.when(s.isNull(), h).otherwise(F.xxhash64(s))).alias(f"h{r}") for r in (1, 2)]
    return df.select("*", *slotted)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(h: str, size: int) -> Column:
    """Hashes of the windows of ``size`` words of ``h``, in order; null if there are none.

    Hashes of 1, 2, 4 .. words are made of two of the length before; those that ``size``
    consists of make up a window's.
    """

    def doubled(blocks: Column, k: int) -> Column:
        return F.transform(blocks, lambda v, i: F.xxhash64(v, F.get(blocks, i + k)))

    def made(blocks: Column, k: int, left: int, so_far: Column | None, done: int) -> Column:
        """``blocks`` are of k words; ``so_far`` are windows of the ``done`` last words wanted, ``left`` is what else."""
        if left & 1:
            taken = blocks if so_far is None else F.transform(blocks, lambda v, i: F.xxhash64(v, F.get(so_far, i + k)))
            so_far, done = taken, done + k
        if left > 1:
            if so_far is None:
                return _let(doubled(blocks, k), lambda x: made(x, 2 * k, left >> 1, None, done))
            both = F.struct(doubled(blocks, k).alias("b"), so_far.alias("s"))
            return _let(both, lambda x: made(x["b"], 2 * k, left >> 1, x["s"], done))
        return so_far

    n = F.size(h) - (size - 1)
    return F.when(n > 0, F.slice(_let(F.col(h), lambda x: made(x, 1, size, None, 0)), F.lit(1), n))


def find_leaks(
    docs: DataFrame,
    bench: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 8,
    literals: int = 4,
    share: float = 0.5,
    run: int = 6,
) -> DataFrame:
    """(doc_id, text_hash, item_id, windows, found, score) of each item found in a document."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = bench.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    items = _templates(items, "text", ["item_id"]).where(F.size("h0") > 0)
    # at most ``window`` rows: the lengths of windows that occur
    sizes = [r[0] for r in items.select(F.least(F.size("h0"), F.lit(window))).distinct().collect()]
    parts = None
    for size in sizes:
        some = items.where(F.least(F.size("h0"), F.lit(window)) == size)
        for r in range(3):
            own = some.select("*", F.posexplode(_windows(f"h{r}", size)).alias("ipos", "hash"))
            at = lambda c: F.slice(c, F.col("ipos") + 1, F.lit(size))
            own = own.select(
                "item_id",
                "hash",
                "ipos",
                F.lit(r).alias("reading"),
                F.lit(size).alias("size"),
                (F.size("h0") - size + 1).alias("windows"),
                at(f"slots{max(r, 1)}").alias("islots"),
                at("tokens").alias("itokens"),
                *([(at(f"h{r}") != at(f"h{r - 1}")).alias("differs")] if r else []),
            )
            if r:  # where a reading has no slots of its own, the one before has the window
                own = own.where(F.col("differs") & (F.size(F.filter("islots", lambda s: s.isNull())) >= min(size, literals))).drop("differs")
            parts = own if parts is None else parts.unionByName(own)
    if parts is None:
        nothing = docs.where("false").crossJoin(items.where("false").select("item_id"))  # of the ids' own types, without rows
        return nothing.select("doc_id", F.lit(0).cast("long").alias("text_hash"), "item_id", F.lit(0).cast("long").alias("windows"), F.lit(0).cast("long").alias("found"), F.lit(0.0).alias("score"))
    parts = cut(parts)

    keyed = docs.where(F.col("text").isNotNull()).withColumn("text_hash", F.xxhash64("text"))
    hashed = _templates(keyed, "text", ["doc_id", "text_hash"])
    known = parts.groupBy("hash").agg(F.min("reading").alias("least"), F.max("reading").alias("most")).limit(INLINE + 1).collect()
    # at most INLINE numbers of the benchmark: those of windows as they are, those of templates
    plain, slotted_ = ([F.lit(r["hash"]) for r in known if keep(r)] for keep in (lambda r: r["least"] == 0, lambda r: r["most"] > 0))
    places = None
    for size in sizes:
        for r in range(3):
            every, values = _windows(f"h{r}", size), slotted_ if r else plain
            place = lambda h, i: F.struct(i.alias("pos"), h.alias("hash"))
            if len(known) > INLINE:
                every = F.transform(every, place)
            elif values:  # only windows that the benchmark has become rows
                every = F.filter(F.transform(every, lambda h, i: F.when(h.isin(values), place(h, i))), lambda x: x.isNotNull())
            else:
                continue
            every = F.coalesce(every, F.expr("cast(array() as array<struct<pos:int,hash:bigint>>)"))
            places = every if places is None else F.concat(places, every)
    # readings without slots of their own have the same hash, which is probed once
    exploded = hashed.select("doc_id", "text_hash", F.explode(F.array_distinct(places)).alias("w")).select("doc_id", "text_hash", "w.pos", "w.hash")
    probe = parts.select("hash", "item_id", "ipos", "size", "windows", "reading")
    hits = cut(exploded.join(small(probe), "hash").drop("hash").dropDuplicates(["doc_id", "text_hash", "item_id", "pos", "ipos", "reading"]))
    hits = hits.withColumn("shift", F.col("pos") - F.col("ipos"))

    good = hits.where("reading = 0")
    slotted = hits.where("reading > 0")
    if not slotted.isEmpty():
        # hits of one document and item, in order, are copies: a new one begins far off, or back at the item's begin
        pair = W.partitionBy("doc_id", "text_hash", "item_id", "reading").orderBy("pos", "ipos")
        ahead = F.col("pos") - F.lag("pos").over(pair) > F.col("windows") + 2 * F.col("size")
        back = F.lag("ipos").over(pair) - F.col("ipos") >= F.greatest(F.lit(1), F.floor(F.col("windows") / 2))
        slotted = slotted.withColumn("copy", F.sum(F.when(ahead | back, 1).otherwise(0)).over(pair))
        slotted = cut(slotted.select("doc_id", "text_hash", "item_id", "pos", "size", "ipos", "windows", "shift", "reading", "copy"))
        # only documents with such hits are cut into words again
        own = cut(slotted.select("doc_id", "text_hash").distinct())
        same = lambda x, y: F.col(f"{x}.doc_id").eqNullSafe(F.col(f"{y}.doc_id")) & (F.col(f"{x}.text_hash") == F.col(f"{y}.text_hash"))
        d = keyed.alias("t").join(small(own).alias("o"), same("t", "o"), "left_semi").dropDuplicates(["doc_id", "text_hash"])
        d = _templates(d, "text", ["doc_id", "text_hash"]).select("doc_id", "text_hash", "tokens").alias("d")
        l = small(slotted, SLOTTED).alias("l")
        same = same("d", "l")
        seen = d.join(l, same).select(*[F.col(f"l.{c}") for c in slotted.columns], F.expr("slice(tokens, l.pos + 1, l.size)").alias("dtokens"))
        seen = seen.alias("s").join(
            small(parts.where("reading > 0").select(F.col("item_id").alias("i"), F.col("ipos").alias("p"), F.col("reading").alias("r"), "islots", "itokens")),
            F.col("s.item_id").eqNullSafe(F.col("i")) & (F.col("s.ipos") == F.col("p")) & (F.col("s.reading") == F.col("r")),
        )
        both = F.zip_with("itokens", "dtokens", lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        values = F.filter(
            F.zip_with(both, "islots", lambda v, s: F.when(s.isNotNull(), F.struct(v["x"].alias("x"), v["y"].alias("y"), s.alias("slot")))), lambda v: v.isNotNull()
        )
        line = ["doc_id", "text_hash", "item_id", "copy", "reading"]
        pairs = cut(seen.select(*line, F.explode(values).alias("v")).select(*line, "v.x", "v.y", "v.slot").distinct())
        # one value for each of the item's, and no two of its names for one of the document's
        one = pairs.groupBy(*line, "x").agg((F.min("y") != F.max("y")).alias("split"))
        two = pairs.where("slot = '<name>'").groupBy(*line, "y").agg((F.min("x") != F.max("x")).alias("split"))
        torn = one.select(*line, "split").unionByName(two.select(*line, "split")).where("split").select(*line).distinct().alias("k")
        s = slotted.alias("h")
        on = [F.col(f"h.{c}").eqNullSafe(F.col(f"k.{c}")) for c in line]
        good = good.unionByName(s.join(torn, on[0] & on[1] & on[2] & on[3] & on[4], "left_anti").select("h.*").select(*good.columns))

    found = good.groupBy("doc_id", "text_hash", "item_id", "windows", "ipos").agg(F.lit(1).alias("one"))
    found = found.groupBy("doc_id", "text_hash", "item_id").agg(F.max("windows").cast("long").alias("windows"), F.count("*").alias("found"))
    found = found.withColumn("score", F.col("found") / F.col("windows"))
    return found.where((F.col("found") >= run) | (F.col("score") >= share)).select("doc_id", "text_hash", "item_id", "windows", "found", "score")


def drop_leaks(docs: DataFrame, bench: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    leaks = cut(find_leaks(docs, bench, doc_id=doc_id, text=text, **options).select("doc_id", "text_hash").distinct())
    d, l = docs.alias("d"), small(leaks).alias("l")
    same = F.col(f"d.`{doc_id}`").eqNullSafe(F.col("l.doc_id")) & (F.xxhash64(F.col(f"d.`{text}`")) == F.col("l.text_hash"))
    return d.join(l, same, "left_anti")
