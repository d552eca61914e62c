import random
import re

from sorimill.llm import decontam
from tests.llm.data import documents, words


def found(spark, docs, items, **options):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontam.find_leaks(documents(spark, docs), bench, **options).collect()}


QUESTION = "If Anna buys 12 apples for 3 dollars and gives Anna another 12 kg of plums, how many apples are there in all?"


def test_copies_and_parameters(spark):
    clean = words(1, 200)
    docs = [
        (1, clean),
        (2, f"{clean}\n{QUESTION}"),
        (3, "So then. " + QUESTION.replace("Anna", "Boris").replace("12", "77").replace("3 dollars", "5 dollars")),
        (4, QUESTION.replace("12 apples", "4 apples").replace("gives Anna", "gives Boris")),  # one value, two replacements
        (5, QUESTION.upper().replace(" ", "!! ").replace("ANNA", "Anna")),
    ]
    got = found(spark, docs, [(7, QUESTION), (8, words(2, 30))])
    assert (2, 7) in got and (3, 7) in got and (1, 7) not in got
    assert (4, 7) not in got
    assert not {d for d, i in got if i == 8}


def test_punctuation_and_case_of_plain_words(spark):
    item = words(3, 40)
    noisy = re.sub(r"(\w+)", r"\1%%%", item).upper()
    half = " ".join(item.split()[:25])
    few = " ".join(item.split()[:9])
    got = found(spark, [(1, f"{words(4, 50)} {noisy}"), (2, half), (3, few), (4, words(5, 300))], [(0, item)])
    assert got == {(1, 0), (2, 0)}


def test_edges(spark):
    item = words(6, 20)
    docs = [(1, None), (2, ""), (None, item), (4, item), (4, item), (5, "x " * 100_000 + item)]
    items = [(0, item), (1, None), (2, ""), (3, "just three words"), (None, words(7, 12))]
    assert found(spark, docs, items) == {(None, 0), (4, 0), (5, 0)}
    assert found(spark, [(1, "here are just three words.")], items) == {(1, 3)}
    assert found(spark, docs[:0], items) == set()
    assert found(spark, docs, items[:0]) == set()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = documents(spark, docs, "item_id windows")
    kept = decontam.drop_leaks(df, bench)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, None), (2, "")]


def brute(docs, items, window=8):
    """Plain copies only: both sides in the same words, no slots in these tables' items."""

    def tokens(t):
        t = re.sub(r"(?<=[0-9])[.,](?=[0-9])", "", (t or "").lower())
        t = re.sub(r"(?<=[0-9])(?=[a-z])", " ", t)
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t) if w]

    index = {}
    sizes = {}
    for i, t in items:
        w = tokens(t)
        sizes[i] = len(w) - window + 1
        for k in range(sizes[i]):
            index.setdefault(tuple(w[k : k + window]), set()).add((i, k))
    out = set()
    for d, t in docs:
        w, hit = tokens(t), {}
        for k in range(len(w) - window + 1):
            for i, at in index.get(tuple(w[k : k + window]), ()):
                hit.setdefault(i, set()).add(at)
        out |= {(d, i) for i, places in hit.items() if len(places) >= 6 or len(places) / sizes[i] >= 0.5}
    return out


def test_tables_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert want and got == want


def test_names_that_open_sentences(spark):
    item = "Tom has 5 apples. Tom buys 3 more at noon. Tom gives 2 to a friend. Tom eats 1 apple. How many apples are left?"
    other = item.replace("Tom", "Bob").replace("5", "9")
    torn = item.replace("Tom", "Bob", 2).replace("Tom", "Eve")  # one name, two replacements
    assert found(spark, [(1, other), (2, torn), (3, "Well. " + other)], [(0, item)]) == {(1, 0), (3, 0)}


def test_copies_in_other_case_and_punctuation(spark):
    names = "if you see Anna and Boris at Prague with Clara"
    text = "The river runs low. Olga waits by the bridge; Peter brings two boats. They leave, and Rita stays behind."
    docs = [
        (1, names.replace(" ", "\n")),
        (2, names.title()),
        (3, re.sub("[.,;]", "", text)),
        (4, text.upper()),
        (5, text.title().replace(" ", "\n")),
        (6, text.lower()),
    ]
    assert found(spark, docs, [(0, names), (1, text)]) == {(1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 1)}


def test_items_of_few_plain_words(spark):
    items = [
        (0, "What is 12 + 7 * 3 - 4 / 2 ?"),
        (1, "Compute 3 x 14 + 15 x 92 - 65 x 35 + 89 x 79 = ?"),
        (2, "Convert 12 km 30 m 5 cm to 7 mm 9 ft"),
    ]
    docs = [(i, f"here it says: {t} and so on") for i, t in items]
    docs += [(i + 10, re.sub("[0-9]+", lambda m: str(int(m.group()) + 1), t)) for i, t in items]  # other values: too little to go by
    assert found(spark, docs, items) == {(0, 0), (1, 1), (2, 2)}


NAMES = "Anna Boris Clara David Emma Felix Greta Henry Irene Jonas Karla Louis Marta Nils Olga Peter Rita Simon Tanja Uwe Vera Willi".split()


def question(i, first, second, n):
    thing, place, tree = (words(9000 + 3 * i + k, 1) for k in range(3))
    return (
        f"{first} keeps {n[0]} {thing} behind the {place}. Before noon {first} gives {n[1]} of them to {second} near the old {tree}. Then {second} walks {n[2]} km "
        f"along the river, and {first} finds {n[3]} more {thing} under a stone. How many {thing} does {first} have when {second} comes back?"
    )


def test_generated_variants(spark):
    rng = random.Random(7)
    items, docs = [], []
    for i in range(60):
        a, b, c, d = rng.sample(NAMES, 4)
        low = lambda: rng.sample(range(2, 100), 4)  # noqa: E731  # four values, so that each slot has its own
        items.append((i, question(i, a, b, low())))
        filler = words(500 + i, 60)
        docs.append((i, f"{filler}. {question(i, c, d, low())} {filler}"))  # consistent: other names and numbers
        whole = question(i, "Zoe", d, low())
        docs.append((200 + i, whole.replace("Zoe", "Paul", 1).replace("Zoe", "Mary Ann", 1)))  # one name, three replacements
        docs.append((300 + i, question(i, c, c, low())))  # two names, one replacement
        docs.append((400 + i, question(i, c, d, low()) + "\n" + question(i, b, a, low())))  # two variants, one behind the other
    got = found(spark, docs, items)
    for start, least, most in ((0, 60, 60), (400, 60, 60), (200, 0, 0), (300, 0, 0)):
        n = sum((start + i, i) in got for i in range(60))
        assert least <= n <= most, (start, n)


def test_units_and_numbers_in_four_languages(spark):
    items = [
        (0, "Der Bauer verkauft am Morgen 12 Kilometer Stoff und gibt dem Nachbarn danach noch 3 Kilometer davon für den langen Weg"),
        (1, "La fermière vend ce matin douze kilos de pommes et donne ensuite trois kilos de ces fruits à la vieille voisine du village"),
        (2, "El granjero vende esta mañana 12 kilos de manzanas y luego regala 3 kilos de esas frutas a la vieja vecina del pueblo"),
    ]
    docs = [
        (0, items[0][1].replace("12", "40").replace("3", "7").replace("Kilometer", "Meter")),
        (1, items[1][1].replace("douze", "vingt").replace("trois", "9").replace("kilos", "tonnes")),
        (2, items[2][1].replace("12", "quince").replace("3", "ocho").replace("kilos", "gramos")),
        (3, items[2][1].replace("12", "15").replace("3 kilos", "8 gramos").replace("manzanas", "peras")),  # one unit, two replacements
    ]
    assert found(spark, docs, items) == {(0, 0), (1, 1), (2, 2)}


def test_types_of_ids(spark):
    bench = spark.createDataFrame([("q1", words(6, 20))], "item_id string, text string")
    docs = spark.createDataFrame([("a", words(6, 20))], "doc_id string, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()] == [("a", "q1")]
    empty = decontam.find_leaks(docs, bench.limit(0))
    assert dict(empty.dtypes)["doc_id"] == dict(empty.dtypes)["item_id"] == "string" and empty.count() == 0
