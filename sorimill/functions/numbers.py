"""Numerals: reading digit strings as Catalyst expressions.

Digits stay strings throughout, so 32 digits and trailing zeros survive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as t

VALID = r"^[+\-−]?(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.[0-9]+)?$"


def words(values) -> Column:
    """A constant array of words, as one expression that is folded once."""
    return F.split(F.lit(";".join(values)), ";")


def table(values: dict) -> Column:
    """A constant map of words, as one expression that is folded once."""
    return F.str_to_map(F.lit(";".join(f"{k}={v}" for k, v in values.items())), F.lit(";"), F.lit("="))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once and named, not copied into each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _place(power: str) -> Column:
    return words("" if d == 0 else power if d == 1 and power else t.SINO_DIGITS[d] + power for d in range(10))


_NATIVE = ["", *((t.NATIVE_TENS[n // 10] + t.NATIVE_ONES[n % 10]) if n != 20 else "스무" for n in range(1, 100))]
_ALONE = ["", *(t.NATIVE_TENS[n // 10] + t.NATIVE_ALONE[n % 10] for n in range(1, 100))]


def bare(number: Column) -> Column:
    """Integer digits without sign and commas."""
    return F.translate(F.regexp_extract(number, r"^[+\-−]?([0-9,]*)", 1), ",", "")


def read_integer(digits: Column) -> Column:
    """Sino-Korean reading of up to 32 digits; leading zeros don't count."""
    powers = words(reversed(t.LARGE_POWERS))

    def of(padded: Column) -> Column:
        def chunk(i: Column) -> Column:
            def small(four: Column) -> Column:
                spoken = F.concat(*[F.get(_place(p), F.substring(four, k + 1, 1).cast("int")) for k, p in enumerate(t.SMALL_POWERS)])
                spoken = F.when((i == len(t.LARGE_POWERS) - 2) & (four == "0001"), "").otherwise(spoken)
                return F.when(four == "0000", "").otherwise(F.concat(spoken, F.get(powers, i)))

            return let(F.substring(padded, i * 4 + 1, F.lit(4)), small)

        # only the chunks that hold digits
        first = F.floor((F.lit(32) - F.greatest(F.lit(1), F.length(F.ltrim(padded, F.lit("0"))))) / 4).cast("int")
        return F.array_join(F.transform(F.sequence(first, F.lit(len(t.LARGE_POWERS) - 1)), chunk), "")

    return let(let(F.lpad(digits, 32, "0"), of), lambda spoken: F.when(spoken == "", t.SINO_DIGITS[0]).otherwise(spoken))


def spell_digits(digits: Column, names: str, gap: str) -> Column:
    return F.array_join(F.split(F.translate(digits, "0123456789", names), ""), gap)


def read_phone_digits(digits: Column) -> Column:
    """Digit by digit with blanks; zero is 공."""
    return spell_digits(digits, t.PHONE_DIGITS, " ")


read_digitwise = read_phone_digits


def facts(number: Column) -> Column:
    """All that the renderers ask about a number, as a struct; ``ok`` is false for a malformed one.

    sino, native (before a counter) and alone (without one) are its readings;
    ``zero`` says that a leading zero makes it ambiguous, ``long`` that it has more
    than ten digits, ``thousand`` that its fraction may be a group of thousands.
    """

    def split(n: Column) -> Column:
        return F.struct(bare(n).alias("digits"), F.regexp_extract(n, r"\.([0-9]+)$", 1).alias("fraction"), F.regexp_extract(n, r"^([+\-−])", 1).alias("sign"))

    def read(p: Column) -> Column:
        signed = F.when(p["sign"] == "", "").when(p["sign"] == "+", "플러스 ").otherwise("마이너스 ")
        tail = F.when(p["fraction"] != "", F.concat(F.lit(" 점 "), spell_digits(p["fraction"], t.SINO_DIGITS, " "))).otherwise("")
        zero = (F.length(p["digits"]) > 1) & F.startswith(p["digits"], F.lit("0"))
        small = (p["sign"] == "") & (p["fraction"] == "") & ~zero & (F.length(p["digits"]) <= 2) & (p["digits"] != "0")
        return F.struct(*[p[f].alias(f) for f in ("digits", "fraction", "sign")], F.concat(signed, read_integer(p["digits"]), tail).alias("sino"), zero.alias("zero"), F.when(small, p["digits"].cast("int")).alias("n"))

    def made(p: Column) -> Column:
        def native(readings: list[str]) -> Column:
            return F.coalesce(F.get(words(readings), p["n"]), p["sino"])

        return F.struct(
            (F.length(p["digits"]) <= 32).alias("ok"),
            p["digits"].alias("digits"),
            p["sign"].alias("sign"),
            p["fraction"].alias("fraction"),
            (p["zero"] & (p["fraction"] == "")).alias("zero"),
            (F.length(p["digits"]) > 10).alias("long"),
            (F.length(p["fraction"]) == 3).alias("thousand"),
            p["sino"].alias("sino"),
            native(_NATIVE).alias("native"),
            native(_ALONE).alias("alone"),
        )

    found = let(number, lambda n: F.when(n.rlike(VALID), let(let(split(n), read), made)))
    return let(found, lambda f: F.when(f["ok"], f))


def read_sino(number: Column) -> Column:
    return facts(number)["sino"]


def read_native(number: Column) -> Column:
    """1 to 99 as they stand before a counter, others Sino-Korean."""
    return facts(number)["native"]


def read_native_alone(number: Column) -> Column:
    return facts(number)["alone"]


def read_history(date: Column) -> Column:
    """The first group as a number, the digits of the others one by one, joined."""
    groups = F.split(date, "[.·]")
    rest = F.array_join(F.slice(groups, 2, 9), "")
    return F.concat(read_integer(F.get(groups, F.lit(0))), F.translate(rest, "0123456789", t.SINO_DIGITS))


def scaled(number: Column, scale: Column) -> Column:
    """The number times the power of ten that a scale word names; no floats."""

    def split(n: Column) -> Column:
        power = F.element_at(table(t.SCALES), scale).cast("int")
        fraction = F.regexp_extract(n, r"\.([0-9]+)$", 1)
        return F.struct(F.regexp_extract(n, r"^([+\-−])", 1).alias("sign"), F.concat(bare(n), fraction).alias("digits"), (F.length(fraction) - power).alias("rest"))

    def moved(p: Column) -> Column:
        more = F.greatest(p["rest"], F.lit(0))
        at = F.length(p["digits"]) - more
        whole = F.concat(F.substring(p["digits"], F.lit(1), at), F.repeat(F.lit("0"), F.greatest(-p["rest"], F.lit(0))))
        whole = let(F.ltrim(whole, F.lit("0")), lambda w: F.when(w == "", "0").otherwise(w))
        tail = F.when(p["rest"] > 0, F.concat(F.lit("."), F.substring(p["digits"], at + 1, more))).otherwise("")
        return F.concat(p["sign"], whole, tail)

    return let(number, lambda n: F.when(n.rlike(VALID), let(split(n), moved)))


def spell_letters(word: Column) -> Column:
    """Names of the letters of a Latin word; others are skipped."""
    return F.array_join(F.transform(F.split(F.lower(word), ""), lambda c: F.element_at(table(t.LETTER_NAMES), c)), "")
