"""Number-context classifier: three-class softmax over sparse binary features.

What an analyzer says of the words around a number decides whether it is read with
native or Sino-Korean numerals or digit by digit. Tokens come in as a column of
(form, tag, start, end) in code points of the text; the model comes from JSON.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import phonology
from ..functions.numbers import let

CLASSES = ("native", "sino", "digitwise")
#: Where a number may be read in which way beside its default.
ALLOWED = {"unit": CLASSES, "bare": ("digitwise",)}
NEVER = 1.01
#: Longer numbers count as so many digits.
LONGEST = 8
#: So many content words are taken, from so many tokens.
CONTENT, NEAR = 2, 8

_MODELS: dict[str, dict] = {}


def _is_number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def parse_model(text: str) -> dict:
    """A model from JSON: classes, bias, weights and thresholds; raises ValueError if unsound."""
    model = json.loads(text)
    if not isinstance(model, dict):
        raise ValueError("a model is a JSON object")
    if model.get("schema_version") != 2 or model.get("feature_version") != 3 or tuple(model.get("classes", ())) != CLASSES:
        raise ValueError("unknown model version or classes")
    weights, thresholds = model.get("weights"), model.get("thresholds")
    if not isinstance(weights, dict) or not isinstance(thresholds, dict):
        raise ValueError("weights and thresholds must be objects")
    rows = [model.get("bias", ()), *weights.values()]
    if any(len(r) != 3 or not all(map(_is_number, r)) for r in rows):
        raise ValueError("weights must be three finite numbers")
    if not set(thresholds) <= set(CLASSES) or not all(isinstance(sites, dict) for sites in thresholds.values()):
        raise ValueError("thresholds go by class and site")
    if any(not _is_number(v) or not 0 <= v <= NEVER for sites in thresholds.values() for v in sites.values()):
        raise ValueError("thresholds must lie between 0 and 1")
    return model


def load_model(spark: SparkSession, path: str) -> dict:
    """The model of a JSON file, read once in a session of the driver."""
    if path not in _MODELS:
        _MODELS[path] = parse_model(spark.read.text(path, wholetext=True).first()[0])
    return _MODELS[path]


def fits(text: Column, tokens: Column) -> Column:
    """Whether there are tokens and they are as the text has them."""
    return phonology.fits(text, tokens) & F.coalesce(F.size(tokens) > 0, F.lit(False))


def _named(prefix: str, token: Column) -> Column:
    return F.concat(F.lit(prefix), token["form"], F.lit("/"), token["tag"])


def content_words(tokens: Column, backwards: bool = False) -> Column:
    """The nearest content words among the next tokens; particles and endings are none."""
    near = F.slice(F.reverse(tokens) if backwards else tokens, 1, NEAR)
    return F.slice(F.filter(near, lambda x: ~x["tag"].rlike("^[JE]")), 1, CONTENT)


def features(tokens: Column, text: Column, start: Column, end: Column, context_end: Column, unit: Column) -> Column:
    """Features of the number between ``start`` and ``end``; ``context_end`` is behind its unit and particle."""
    size = F.least(end - start, F.lit(LONGEST)).cast("string")

    def of(x: Column) -> Column:
        behind, after, before = x["behind"], x["after"], x["before"]
        tail, following, previous = F.get(behind, F.size(behind) - 1), F.get(after, F.lit(0)), F.get(before, F.size(before) - 1)
        surface = F.substring(text, start + 1, end - start)
        small = surface.rlike("^[0-9]{1,2}$")
        has_unit = unit != ""
        value = surface.cast("int").cast("string")
        words = x["words"]
        head = _named("", F.get(words, F.lit(0)))
        ranked = lambda prefix, found: F.transform(found, lambda w, i: F.concat(F.lit(prefix), (i + 1).cast("string"), F.lit("="), _named("", w)))
        some = F.array(
            F.concat(F.lit("len="), size),
            F.when(has_unit, F.concat(F.lit("u="), unit)),
            F.when(small, F.concat(F.lit("v="), value)),
            F.when(small & has_unit, F.concat(F.lit("uv="), unit, F.lit(":"), value)),
            _named("sf=", tail),
            F.concat(F.lit("st="), tail["tag"]),
            F.when(following.isNull(), "eos=1"),
            _named("nf=", following),
            F.concat(F.lit("nt="), following["tag"]),
        )
        pairs = F.array(F.when(has_unit, F.concat(F.lit("un="), unit, F.lit("|"), head)), F.concat(F.lit("ln="), size, F.lit("|"), head))
        last = F.array(F.when(previous.isNull(), "bos=1"), _named("pf=", previous), F.concat(F.lit("pt="), previous["tag"]))
        every = F.concat(some, ranked("nc", words), pairs, last, ranked("pc", content_words(before, True)))
        return F.filter(every, lambda f: f.isNotNull())

    sides = F.struct(
        F.filter(tokens, lambda x: (x["start"] >= end) & (x["start"] < context_end)).alias("behind"),
        F.filter(tokens, lambda x: x["start"] >= F.greatest(end, context_end)).alias("after"),
        F.filter(tokens, lambda x: x["end"] <= start).alias("before"),
        content_words(F.filter(tokens, lambda x: x["start"] >= F.greatest(end, context_end))).alias("words"),
    )
    return let(sides, of)


def _softmax(s: Column) -> Column:
    e = F.transform(s, lambda x: F.exp(x - F.array_max(s)))
    return let(e, lambda v: F.transform(v, lambda x: x / (F.get(v, F.lit(0)) + F.get(v, F.lit(1)) + F.get(v, F.lit(2)))))


def _bias(model: dict) -> Column:
    return F.array(*[F.lit(float(b)) for b in model["bias"]])


def probabilities(feats: Column, model: dict) -> Column:
    """Class probabilities of an array of features, summed in the features' order.

    The weights become a literal of the plan: meant for some thousand features. For
    more, join them as a table with ``probabilities_by_join``.
    """
    if not model["weights"]:
        return _softmax(_bias(model))
    weights = F.create_map(*[x for k, v in model["weights"].items() for x in (F.lit(k), F.array(*[F.lit(float(w)) for w in v]))])
    score = F.aggregate(feats, _bias(model), lambda acc, f: F.coalesce(F.zip_with(acc, F.element_at(weights, f), lambda a, w: a + w), acc))
    return let(score, _softmax)


def probabilities_by_join(df: DataFrame, key: str, feats: str, weights: DataFrame, bias: list[float]) -> DataFrame:
    """(key, probabilities) of rows whose key is unique; ``weights`` is a table (feature, weights), of any size.

    A row's features, some twenty, are summed in their order.
    """
    each = df.select(key, F.posexplode_outer(feats).alias("pos", "feature")).join(weights, "feature", "left")
    found = each.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("weights").isNotNull(), F.struct("pos", "weights")))).alias("w"))
    start = F.array(*[F.lit(float(b)) for b in bias])
    score = F.aggregate("w", start, lambda acc, x: F.zip_with(acc, x["weights"], lambda a, w: a + w))
    return found.select(key, let(score, _softmax).alias("probabilities"))


def choose(feats: Column, site: Column | str, default: Column | str, model: dict) -> Column:
    """The reading that overrides the default, or null: best class, allowed at the site, over its threshold."""
    site = F.lit(site) if isinstance(site, str) else site
    limits = F
    for s, allowed in ALLOWED.items():
        limits = limits.when(site == s, F.array(*[F.lit(float(model["thresholds"].get(c, {}).get(s, NEVER)) if c in allowed else 2.0) for c in CLASSES]))
    names = F.array(*[F.lit(c) for c in CLASSES])

    def pick(p: Column) -> Column:
        at = F.array_position(p, F.array_max(p)).cast("int") - 1
        best = F.get(names, at)
        return F.when((best != default) & (F.array_max(p) >= F.get(limits, at)), best)

    return let(probabilities(feats, model), pick)


def decide(feats: Column, site: str, default: str, model: dict) -> Column:
    """``choose`` for a site and default known beforehand."""
    return choose(feats, site, default, model)
