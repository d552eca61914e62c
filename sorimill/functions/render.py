"""Readings of tokens: a token's kind and parts in, its spoken form out.

A reading is null where the token has to stay as written.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import grammar as g
from . import tables as t
from .numbers import facts, let, read_history, read_integer, read_phone_digits, scaled, spell_letters, table, words


def lookup(values: dict, key: Column) -> Column:
    return F.element_at(table(values), key)


def among(key: Column, values) -> Column:
    return F.array_contains(words(values), key)


_SPEED_KINDS = {k: v[0] for k, v in t.SPEED_UNITS.items()}
#: How a unit is said behind its number; of speeds only what stands there.
_SPOKEN_UNITS = t.UNIT_READINGS | {k: v[1] for k, v in t.SPEED_UNITS.items()}


def unit_facts(unit: Column) -> Column:
    """What the readings ask about a unit, as a struct."""
    return F.struct(
        unit.alias("unit"),
        lookup(_SPEED_KINDS, unit).alias("speed"),
        F.coalesce(lookup(_SPOKEN_UNITS, unit), unit).alias("name"),
        F.element_at(table(t.UNIT_READINGS), unit).alias("alone"),
        among(unit, t.NATIVE_COUNTERS).alias("native"),
        among(unit, t.CURRENCY_WORDS).alias("money"),
    )


def _plain(f: Column) -> Column:
    """Whether a number can be read at all: no ambiguous zero, at most ten digits."""
    return f["ok"] & ~f["zero"] & ~f["long"]


def say_number(f: Column, word: Column | str = "", long: bool = False) -> Column:
    fine = f["ok"] & ~f["zero"]
    return F.when(fine if long else fine & ~f["long"], F.concat(f["sino"], F.lit(word) if isinstance(word, str) else word))


def say_quantity(spoken: Column, unit: Column, more: Column | str = "", speed: bool = True) -> Column:
    """A spoken number with its unit (unit_facts); a speed's kind goes first."""
    more = F.lit(more) if isinstance(more, str) else more
    out = F.concat(spoken, more, F.lit(" "), unit["name"])
    return F.concat(F.when(unit["speed"].isNull(), "").otherwise(F.concat(unit["speed"], F.lit(" "))), out) if speed else out


def _special_month(f: Column, unit: Column) -> Column:
    """유월 and 시월, else null."""
    month = F.regexp_replace(f["digits"], "^0+(?=.)", "")
    hit = (unit["unit"] == "월") & f["ok"] & (f["sign"] == "") & (f["fraction"] == "")
    return F.when(hit & (month == "6"), "유월").when(hit & (month == "10"), "시월")


def say_unit(f: Column, unit: Column, speed: bool = True, sino: bool = False) -> Column:
    """A number before a unit: June and October, 첫 번째, native or Sino-Korean."""
    spoken = f["sino"] if sino else F.when(unit["native"], f["native"]).otherwise(f["sino"])
    fine = _plain(f) & ~(unit["money"] & f["thousand"])
    if sino:
        return F.when(fine, say_quantity(spoken, unit, speed=speed))
    first = (unit["unit"] == "번째") & (f["digits"] == "1") & (f["fraction"] == "")
    return F.coalesce(_special_month(f, unit), F.when(fine, F.when(first, "첫 번째").otherwise(say_quantity(spoken, unit, speed=speed))))


def say_side(f: Column, scaled_f: Column, unit: Column, speed: bool = True) -> Column:
    """One end of a range."""
    name = unit["unit"]
    return (
        F.when(name.isin("%", "％"), say_number(f, " 퍼센트"))
        .when(name.isin("%p", "%P"), say_number(f, " 퍼센트포인트"))
        .when(name.isin("만원", "억원", "조원"), F.when(~f["thousand"], say_number(scaled_f, " 원", long=True)))
        .otherwise(say_unit(f, unit, speed))
    )


def say_fraction(a: Column, b: Column) -> Column:
    fine = a["ok"] & b["ok"] & (a["fraction"] == "") & (b["fraction"] == "") & ~a["zero"] & ~b["zero"] & ~b["digits"].rlike("^0*$")
    return F.when(fine, F.concat(b["sino"], F.lit("분의 "), a["sino"]))


def _digits(x: Column) -> Column:
    """The groups of digits in a text."""
    return F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0))


_TENS = ["", "십", *(d + "십" for d in t.SINO_DIGITS[2:])]
_TO_99 = [t.SINO_DIGITS[0], *(_TENS[n // 10] + (t.SINO_DIGITS[n % 10] if n % 10 else "") for n in range(1, 100))]


def _small(number: Column) -> Column:
    """0 to 99, Sino-Korean."""
    return F.get(words(_TO_99), number)


def _joined(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def say_time(clock: Column) -> Column:
    """A clock time; hours of 1 to 12 are native."""
    native = [t.NATIVE_TENS[n // 10] + t.NATIVE_ONES[n % 10] for n in range(13)]

    def say(x: Column) -> Column:
        half, h = x["half"], F.get(x["n"], F.lit(0))
        m, s = (F.coalesce(F.get(x["n"], F.lit(i)), F.lit(0)) for i in (1, 2))
        given = F.size(x["n"])
        fine = (m <= 59) & (s <= 59) & F.when(half != "", h.between(1, 12)).otherwise((h < 24) | ((h == 24) & (m + s == 0)))
        hour = F.when(h.between(1, 12), F.get(words(native), h)).otherwise(_small(h))
        spoken = _joined(
            F.when(half != "", F.concat(half, F.lit(" "))).otherwise(""), hour, " 시",
            F.when(given > 1, _joined(" ", _small(m), " 분")).otherwise(""),
            F.when(given > 2, _joined(" ", _small(s), " 초")).otherwise(""),
        )
        return F.when(fine, spoken)

    numbers = F.transform(_digits(clock), lambda d: d.cast("int"))
    return let(F.struct(F.regexp_extract(clock, "^오[전후]", 0).alias("half"), numbers.alias("n")), say)


def say_moment(text: Column, particle: bool) -> Column:
    """A clock time with what is written behind it: nothing, or a particle."""
    behind = g.compiled("[{particle}]") if particle else ""
    pattern = f"^(?!.*[0-9][ \t]*시간)({g.compiled('{clock}')})({behind})$"
    return F.when(text.rlike(pattern), F.concat(say_time(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)))


def _month(m: Column) -> Column:
    return F.when(m == 6, "유월").when(m == 10, "시월").otherwise(F.concat(_small(m), F.lit(" 월")))


def _real(year: Column | str, month: Column, day: Column) -> Column:
    """Whether a date exists."""
    text = F.concat_ws("-", F.lit(year) if isinstance(year, str) else year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd").isNotNull()


def _part(n: Column, i: int) -> Column:
    return F.get(n, F.lit(i))


def say_date(x: Column) -> Column:
    """A calendar date that exists."""

    def say(n: Column) -> Column:
        y, m, d = (_part(n, i) for i in range(3))
        return F.when((y != "0000") & _real(y, m, d), _joined(read_integer(y), " 년 ", _month(m.cast("int")), " ", _small(d.cast("int")), " 일"))

    return let(_digits(x), say)


def say_month_day(x: Column) -> Column:
    """A day that some year has."""

    def say(n: Column) -> Column:
        m, d = (_part(n, i) for i in range(2))
        return F.when(_real("2000", m, d), _joined(_month(m.cast("int")), " ", _small(d.cast("int")), " 일"))

    return let(_digits(x), say)


def say_year_month(x: Column) -> Column:
    def say(n: Column) -> Column:
        m = _part(n, 1).cast("int")
        fine = (F.size(n) == 1) | m.between(1, 12)
        return F.when(fine, _joined(read_integer(_part(n, 0)), " 년", F.when(F.size(n) == 1, "").otherwise(_joined(" ", _month(m)))))

    return let(_digits(x), say)


def say_month(x: Column) -> Column:
    return let(x.cast("int"), lambda m: F.when(m.between(1, 12), _month(m)))


def say_phone(number: Column) -> Column:
    groups = F.regexp_extract_all(number, F.lit("[0-9]+"), F.lit(0))
    spoken = F.array_join(F.transform(groups, read_phone_digits), " ")
    return F.concat(F.when(F.startswith(number, F.lit("+")), "플러스 ").otherwise(""), spoken)


def say_acronym(token: Column) -> Column:
    return F.coalesce(lookup(t.CONVENTIONAL_READINGS, token), spell_letters(token))


def reading(r: Column) -> tuple[Column, Column]:
    """(spoken, rule) of a token with its parts p, the facts a, b, sa, sb of its numbers and ua, ub of its units."""
    p, a, b, sa, sb, ua, ub, token, kind = (r[x] for x in ("p", "a", "b", "sa", "sb", "ua", "ub", "token", "kind"))
    two = f"^{g.compiled('{particle}{particle}')}$"
    known = (p["tail"] == "") | among(p["tail"], t.PARTICLES) | (~token.rlike("[ \t]") & p["tail"].rlike(two))
    end = F.when(ub["native"], a["alone"]).otherwise(a["sino"])
    prefix = F.when(ub["speed"].isNotNull(), F.concat(ub["speed"], F.lit(" "))).otherwise("")
    with_unit = F.concat(prefix, end, F.lit("에서 "), say_side(b, sb, ub, speed=False), p["tail"])
    span = (
        F.when(p["bu"] == "", F.concat(say_number(a), F.lit("에서 "), say_number(b)))
        .when((p["bu"] != "시") & a["ok"] & ~a["zero"], with_unit)
    )
    is_fraction = p["b"] != ""
    number = F.when(p["bu"] != "", F.when(~a["long"] & ~a["thousand"], say_number(sa, long=True))).otherwise(say_number(a))
    quantity = (
        F.when(is_fraction, F.when(p["au"] != "mmHg", say_quantity(say_fraction(a, b), ua)))
        .when((p["bu"] == "") & (p["x"] == ""), say_unit(a, ua))
        .otherwise(say_quantity(number, ua, p["x"]))
    )
    quantity_rule = (
        F.when(is_fraction, "fraction_unit")
        .when((p["bu"] != "") & (p["x"] != ""), "scaled_approximate_unit")
        .when(p["bu"] != "", "scaled_unit")
        .when(p["x"] != "", "approximate_unit")
        .when(ua["speed"].isNotNull(), "speed_unit")
        .otherwise("number_sino_unit")
    )
    sign, code = lookup(t.CURRENCY_SIGNS, p["x"]), lookup(t.CURRENCY_CODES, p["x"])

    def money(unit):
        return F.when(((p["bu"] == "") | (p["bu"] == unit)) & ~a["thousand"], say_number(a, F.concat(F.lit(" "), unit)))

    counted = F.when(_special_month(a, ua).isNotNull(), "month_exception").when(ua["native"], "number_native_counter").otherwise("number_sino_unit")
    unit_name = ua["alone"]
    sino = F.lit("number.sino")
    scaled_money = F.when(~a["thousand"], F.concat(say_number(sa, " 원", long=True), p["tail"]))
    rows: dict[str, tuple[Column, Column | str]] = {
        "range_both": (F.concat(say_side(a, sa, ua), F.lit("에서 "), say_side(b, sb, ub), p["tail"]), "range_dual_unit"),
        "time_range": (F.concat(say_moment(p["x"], False), F.lit("에서 "), say_moment(p["tail"], True)), "clock_range"),
        "phone": (F.concat(say_phone(p["x"]), p["tail"]), "phone"),
        "emergency": (F.concat(read_phone_digits(p["x"]), p["tail"]), "emergency_number"),
        "time": (F.concat(say_time(p["x"]), p["tail"]), "clock_time"),
        "korean_date": (F.concat(say_date(p["x"]), p["tail"]), "calendar_date"),
        "date": (F.concat(say_date(p["x"]), p["tail"]), "calendar_date"),
        "month_day": (F.concat(say_month_day(p["x"]), p["tail"]), "calendar_month_day"),
        "year_month": (F.concat(say_year_month(p["x"]), p["tail"]), "calendar_year_month"),
        "month": (F.concat(say_month(p["x"]), p["tail"]), "calendar_month"),
        "ordinal": (F.when(known, F.concat(F.lit("제 "), say_unit(a, ua, sino=True), p["tail"])), "ordinal_context"),
        "numbered_item": (say_unit(a, ua, sino=True), "number_ordinal_sino"),
        "history": (F.concat(read_history(p["x"]), p["tail"]), "historical_date"),
        "currency": (F.when(sign.isNotNull(), money(sign)), "currency_prefix"),
        "iso_currency": (F.when(code.isNotNull(), money(code)), "currency_iso"),
        "scaled_currency": (scaled_money, "currency_scaled"),
        "scaled_range": (F.when(~a["thousand"] & ~b["thousand"] & sa["ok"], F.concat(sa["sino"], F.lit("에서 "), say_number(sb, " 원", long=True), p["tail"])), "range_scaled_currency"),
        "range": (span, F.when(p["bu"] == "", "range_number").when(ub["speed"].isNotNull(), "range_speed").otherwise("range_unit")),
        "standalone_unit_symbol": (F.concat(unit_name, p["tail"]), "standalone_unit_symbol"),
        "quantity_unit": (quantity, quantity_rule),
        "exponent": (F.when(a["ok"] & b["ok"], F.concat(a["sino"], F.lit("의 "), b["sino"], F.lit("승"))), "math_exponent"),
        "fraction": (say_fraction(a, b), "fraction"),
        "percentage": (say_number(a, F.when(F.lower(p["au"]) == "%p", " 퍼센트포인트").otherwise(" 퍼센트")), "percentage"),
        "number_hangul_unit": (F.when(known, F.concat(say_unit(a, ua), p["tail"])), counted),
        # 만 behind a decimal may be a scale
        "number_suffix": (F.when(~((p["tail"] == "만") & (a["fraction"] != "")), F.concat(say_number(a), p["tail"])), sino),
        "number_punctuation": (F.concat(say_number(a), p["tail"]), sino),
        "number": (say_number(a), sino),
        "decimal": (say_number(a), sino),
        "indefinite_unit": (F.concat(p["x"], F.lit(" "), unit_name), "indefinite_unit"),
        "unit_per": (F.concat(unit_name, F.lit("당"), p["tail"]), "unit_per"),
        "acronym": (say_acronym(token), F.when(lookup(t.CONVENTIONAL_READINGS, token).isNotNull(), "english_acronym_exception").otherwise("english_initialism")),
        "jamo": (lookup(t.JAMO_NAMES, token), "jamo_name"),
    }
    # these texts stand as they are, and that is their reading
    whole = {"gap", "protected", "version", "filename"}
    octets = F.forall(F.split(token, r"\."), lambda o: o.cast("int") <= 255)
    spoken = F.when(kind.isin(*whole), token).when(kind == "ipv4", F.when(octets, token))
    rule = None
    for name, (value, rule_name) in rows.items():
        spoken = spoken.when(kind == name, value)
        rule_name = F.lit(rule_name) if isinstance(rule_name, str) else rule_name
        rule = F.when(kind == name, rule_name) if rule is None else rule.when(kind == name, rule_name)
    version = F.when(rule == "range_unit", ".v2").otherwise(".v1")
    return F.concat(spoken, p["glue"]), F.concat(F.lit("normalizer."), rule, version)


def in_context(r: Column) -> Column:
    """(number, unit, site, default, behind, length) where context may change how a number is read, else null.

    ``behind`` is what stands behind the number once spoken, ``length`` that of the token without a stop.
    """
    p, kind = r["p"], r["kind"]
    bare = kind.isin("number", "number_suffix", "number_punctuation")
    plain = (kind == "quantity_unit") & (p["b"] == "") & (p["bu"] == "") & (p["x"] == "")
    month = (p["au"] == "월") & p["a"].isin("6", "10")
    first = (p["au"] == "번째") & (p["a"] == "1")
    counted = ((kind == "number_hangul_unit") & ~month & ~first) | plain
    asks = p["a"].rlike("^(?:0|[1-9][0-9]{0,9})$") & (bare | (counted & ~among(p["au"], t.CONTEXT_FREE_UNITS)))
    behind = F.when(bare, F.concat(p["tail"], p["glue"])).otherwise(F.concat(F.lit(" "), r["ua"]["name"], p["tail"], p["glue"]))
    stop = F.when(F.concat(p["tail"], p["glue"]).rlike("[.,]$"), 1).otherwise(0)
    return F.when(
        asks,
        F.struct(
            p["a"].alias("number"),
            F.when(bare, "").otherwise(p["au"]).alias("unit"),
            F.when(bare, "bare").otherwise("unit").alias("site"),
            F.when(~bare & r["ua"]["native"], "native").otherwise("sino").alias("default"),
            behind.alias("behind"),
            (F.length(r["token"]) - stop).alias("length"),
        ),
    )


def facts_of(p: Column) -> list[Column]:
    scale = lambda u: F.substring(u, 1, 1)
    # of a quantity, bu is the scale word in front of the unit
    a_scale = F.when(p["au"].isin("만원", "억원", "조원", *t.SCALES), scale(p["au"])).when(p["bu"].isin(*t.SCALES), p["bu"])
    b_scale = F.when(p["bu"].isin("만원", "억원", "조원", *t.SCALES), scale(p["bu"]))
    return [
        facts(p["a"]).alias("a"),
        facts(p["b"]).alias("b"),
        F.when(a_scale.isNotNull(), facts(scaled(p["a"], a_scale))).alias("sa"),
        F.when(b_scale.isNotNull(), facts(scaled(p["b"], b_scale))).alias("sb"),
        unit_facts(p["au"]).alias("ua"),
        unit_facts(p["bu"]).alias("ub"),
    ]
