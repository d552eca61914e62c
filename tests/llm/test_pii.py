import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sorimill.llm import pii, queries
from tests.llm.data import by_id, documents

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    def digits(m):
        return re.sub("[^0-9]", "", m.group())

    spans = [("email", m) for m in EMAIL.finditer(text)]
    spans += [("ip", m) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    spans += [("card", m) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    spans += [("phone", m) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(((k, m.start(), m.end()) for k, m in spans), key=lambda s: (s[1], pii.KINDS.index(s[0])))


def base(text):
    return [s for s in pii.find(text, AUTOMATON) if s[0] in pii.KINDS[:4]]


AUTOMATON = pii.automaton()
PIECES = ["a", "b.c", "@", ".", "1", "23", "4111111111111111", "4111 1111 1111 1111", "255", "256", "0", "-", " ", "+", "+1 (555) 010-9999", "(", ")", "é", "://", "u:p@h.de", "[at]", "IBAN", "\n", "x@y.z"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_base_spans_equal_the_patterns(parts):
    text = "".join(parts)
    assert base(text) == brute(text)


def test_every_document_equals_the_patterns(spark, sf_dir):
    found = by_id(queries.op1_pii(spark, sf_dir))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        want, got = brute(d.text or ""), found[d.doc_id]
        assert [got[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(s[0] == k for s in want) for k in pii.KINDS[:4]]
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_anchors_add_spans():
    def kinds(text):
        return [(k, text[a:b]) for k, a, b in pii.find(text, AUTOMATON) if k not in pii.KINDS[:4]]

    assert kinds("see ftp://joe:pw@host.example/x") == [("login", "joe:pw@host.example")]
    assert kinds("joe [at] mail.example") == [("obfuscated", "joe [at] mail.example")]
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00 and more") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("IBAN: DE88370400440532013000") == []  # wrong check digits
    assert kinds("account no 12-345678") == [("account", "12-345678")]
    assert kinds("accountable 12345678, konto") == []


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "x@y.de"), (3, "x@y.de"), (None, "1.2.3.4"), (5, "w " * 200_000 + "z@y.de")]
    df = documents(spark, rows, "pii")
    got = pii.find_pii(df).collect()
    assert sorted(len(r.pii) for r in got) == [0, 0, 1, 1, 1, 1]
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "pii"}
    assert max(r.pii[0].end for r in got if r.pii) == 400_006
    assert pii.find_pii(df.limit(0)).count() == 0
