import re

import pytest

from sorimill.llm import license_scan, queries
from tests.llm.data import by_id, documents

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def split(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    w = split(text)
    found = []
    for phrase, label in BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_every_document(spark, folder):
    folder = f"/root/testdata/{folder}"
    got = by_id(queries.op6_licenses(spark, folder))
    for d in spark.read.parquet(f"{folder}/documents.parquet").collect():
        r = got[d.doc_id]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(d.text or "")
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1 or not r["n_base"])


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


SCANNER = license_scan.Scanner(license_scan.NOTICES)


def fuzzy(text):
    return {(license_scan.NOTICES[k].label, first, errors) for k, first, _, errors, _ in SCANNER.find(license_scan.folded(text.encode()))}


def test_edits_are_found_and_counted():
    assert ("lgpl", 2, 1) in fuzzy("under the GNU Leser General Public License")
    assert ("mpl", 0, 2) in fuzzy("Mozila Publc License")
    assert ("all-rights-reserved", 0, 1) in fuzzy("Al rights reserved.")
    assert not fuzzy("nothing to see: the general public may read this apache tale by cc")


def test_every_edited_notice_is_found():
    """Pigeonhole: any notice with up to its number of edits inside words is found."""
    import random

    rng = random.Random(5)
    for n in (x for x in license_scan.NOTICES if x.errors):
        for _ in range(20):
            text = list(n.phrase)
            for _ in range(n.errors):
                at = rng.randrange(1, len(text))
                kind = rng.choice("sid")
                if kind == "s":
                    text[at] = "q"
                elif kind == "i":
                    text.insert(at, "q")
                else:
                    del text[at]
            text = " ".join("".join(text).split())
            if edits(text, n.phrase) <= n.errors:
                assert any(x[0] == n.label for x in fuzzy(f"one two {text} three")), (n, text)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "MIT license mit\nLICENSE"), (3, "MIT license mit\nLICENSE"), (None, "CC-BY"), (5, "émit license"), (6, "a " * 300_000 + "Apache License")]
    df = documents(spark, rows, "notices")
    got = sorted(license_scan.find_notices(df).collect(), key=lambda r: (r.doc_id or 0))
    assert [[(m.label, m.first_word, m.words, m.value) for m in r.notices] for r in got] == [
        [("cc-by", 0, 2, "cc by")],
        [],
        [],
        [("mit", 0, 2, "mit license"), ("mit", 2, 2, "mit license")],
        [("mit", 0, 2, "mit license"), ("mit", 2, 2, "mit license")],
        [],
        [("apache", 300_000, 2, "apache license")],
    ]
    assert license_scan.find_notices(df.limit(0)).count() == 0
