import random
import re

import numpy as np
import pytest
import xxhash

from sorimill.llm import queries, simhash
from tests.llm.data import documents, words


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """Smallest id of each component, for a list of (id, fingerprint)."""
    fps = sorted({f for _, f in prints})
    a = np.array(fps, np.uint64)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3):
            root[find(fps[i + 1 + j])] = find(f)
    least = {}
    for d, f in prints:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [(d, f, least.get(find(f))) for d, f in prints]


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_similar(rows, bits):
    """Ids that stay of (id, text): links of 3 bits, or of ``bits`` by word pairs and WIDE_BITS by shingles."""
    texts = [(t or "").encode() for _, t in rows]
    wide = np.frombuffer(b"".join(map(simhash.wide_fingerprint, texts)), np.uint64).reshape(-1, simhash.WIDE)
    two = np.array(list(map(simhash.pairs_fingerprint, texts)), np.int64).view(np.uint64)
    three = np.array([brute_print(t or "") for _, t in rows], np.uint64)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        near = np.bitwise_count(three[i] ^ three[:i]) <= 3
        near |= (np.bitwise_count(two[i] ^ two[:i]) <= bits) & (np.bitwise_count(wide[i] ^ wide[:i]).sum(axis=1, dtype=int) <= simhash.WIDE_BITS)
        for j in np.flatnonzero(near):
            root[find(i)] = find(int(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return set(least.values())


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.random()}"
    return " ".join(w)


def test_similar_texts_are_found(spark):
    """Of texts of a similarity of 0.8 or more to another at least 95 in 100 go; below 0.6 none does."""
    rng, rows = random.Random(3), []
    for k in range(300):
        text = words(k, rng.randint(60, 900))
        n = len(text.split())
        rows += [(2 * k, text), (2 * k + 1, edited(rng, text, max(1, round(n * rng.choice([0.004, 0.01, 0.018, 0.06, 0.1])))))]
    kept = {r.doc_id for r in simhash.keep_one(documents(spark, rows)).collect()}
    near, gone = 0, 0
    for (_, a), (d, b) in zip(rows[::2], rows[1::2]):
        x, y = shingles(a), shingles(b)
        like = len(x & y) / len(x | y)
        if like >= 0.8:
            near, gone = near + 1, gone + (d not in kept)
        elif like < 0.6:
            assert d in kept
    assert near > 100 and gone >= 0.95 * near
    assert {2 * k for k in range(300)} <= kept


@pytest.mark.parametrize("group", [300, 40])
def test_dense_groups_of_similar_texts(spark, monkeypatch, group):
    """Edits of two texts, far more than a key may hold: sure links are all kept, others stay within the limits."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng, rows = random.Random(group), []
    for k in range(2):
        text = words(k, 300)
        rows += [(len(rows) + i, edited(rng, text, rng.choice([4, 8, 40]))) for i in range(400)]
    kept = {r.doc_id for r in simhash.keep_one(documents(spark, rows)).collect()}
    assert brute_similar(rows, simhash.NEAR_MOST) <= kept <= brute_similar(rows, simhash.NEAR_BITS)
    assert 2 <= len(kept) < 700


def run(df):
    return sorted(((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)


def test_every_document(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = brute_components([(r.doc_id, brute_print(r.text or "")) for r in docs])
    got = {(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in queries.op9_simhash(spark, folder).collect()}
    assert got == set(want) and len({c for _, _, c in want}) < len(want)


def near(rng, center, n, bits):
    out = {center}
    while len(out) < n:
        x = rng.choice(tuple(out)) if rng.random() < 0.5 else center
        for b in rng.sample(range(64), rng.randint(1, bits)):
            x ^= 1 << b
        out.add(x)
    return out


@pytest.mark.parametrize("group", [8192, 20])
def test_links_lose_nothing(spark, monkeypatch, group):
    """Chains, dense groups and singles; with a small GROUP, keys are split twice."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(group)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(4):
        fps |= near(rng, rng.getrandbits(64), 120, 4)
    chain = rng.getrandbits(64)
    for b in range(0, 64, 3):
        chain ^= 7 << b if b < 62 else 1 << b
        fps.add(chain)
    fps |= {x << 40 & (1 << 64) - 1 for x in range(200)}  # many share most bits
    fps = sorted(fps)
    classes = spark.createDataFrame([(f - (1 << 64) * (f >> 63),) for f in fps], "fp long").repartition(5)
    roots = {r.node: r.root for r in simhash.components(simhash.links(classes)).collect()}
    signed = lambda f: f - (1 << 64) * (f >> 63)
    want = brute_components([(i, f) for i, f in enumerate(fps)])
    groups, mine = {}, {}
    for i, f, c in want:
        groups.setdefault(c, set()).add(f)
        mine.setdefault(roots.get(signed(f), signed(f)), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_finer_keys_share_a_key_for_every_close_pair():
    rng = random.Random(1)
    masks = simhash._finer(0)
    assert len(masks) == 20
    for _ in range(2000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(not diff & m for m in masks)
        m = next(m for m in masks if not diff & m)
        assert any(not diff & k for k in simhash._finer(m))


def test_edges(spark):
    rows = [(4, None), (2, ""), (9, " \n"), (None, ""), (5, "one two"), (5, "one two"), (6, "ONE\ttwo"), (None, "alone here"), (7, "w v u " * 100_000), (8, "É a b"), (1, "é a b")]
    df = documents(spark, rows, "Fingerprint")
    assert run(df) == sorted(brute_components([(d, brute_print(t or "")) for d, t in rows]), key=str)
    assert run(df.limit(0)) == []
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("2", ""), ("5", "one two"), ("None", "alone here"), ("7", "w v u " * 100_000), ("8", "É a b"), ("1", "é a b")])


def likeness(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_blocks_are_found_by_true_similarity(spark):
    """Appended, cut, swapped and scattered edits: a copy goes if and only if its Jaccard similarity is 0.8 or more."""
    rng, rows = random.Random(11), []
    for k in range(240):
        w = words(k, rng.randint(150, 600)).split()
        n = round(len(w) * rng.choice([0.08, 0.1, 0.15, 0.19, 0.22, 0.27]))
        at = rng.randrange(len(w) - n)
        new = words(10_000 + k, n).split()
        shape = k % 4
        if shape == 0:
            other = w + new
        elif shape == 1:
            other = w[:at] + w[at + n :]
        elif shape == 2:
            other = w[:at] + new[: n // 2] + w[at + n // 2 :]
        else:
            other = edited(rng, " ".join(w), max(1, n // 8)).split()
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    kept = {r.doc_id for r in simhash.keep_one(documents(spark, rows), exact=True).collect()}
    three = {d: brute_print(t) for d, t in rows}
    like = {2 * k + 1: likeness(rows[2 * k][1], rows[2 * k + 1][1]) for k in range(240)}
    gone = {d for d, x in like.items() if x >= 0.8 or (three[d] ^ three[d - 1]).bit_count() <= 3}
    assert kept == {d for d, _ in rows} - gone
    assert sum(0.8 <= x < 0.9 for x in like.values()) > 50 and sum(0.6 < x < 0.8 for x in like.values()) > 40


@pytest.mark.parametrize("group", [8192, 20])
def test_exact_links_do_not_depend_on_group_size(spark, monkeypatch, group):
    """Dense keys give the components of true similarity, whatever GROUP is."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng, rows = random.Random(5), []
    for k in range(2):
        text = words(k, 200)
        rows += [(len(rows) + i, edited(rng, text, rng.choice([1, 2, 3, 5]))) for i in range(100)]
    kept = {r.doc_id for r in simhash.keep_one(documents(spark, rows), exact=True).collect()}
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets, prints = [shingles(t) for _, t in rows], [brute_print(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert kept == {find(i) for i in range(len(rows))}


def test_hot_keys_keep_pairs_of_more_bits(spark, monkeypatch):
    """Neighbours of 7 to 10 bits are the same however many rows share their keys."""
    rng, fps = random.Random(8), set()
    top = rng.getrandbits(24) << 40
    for _ in range(150):
        x = top | rng.getrandbits(40)
        fps |= {x, x ^ sum(1 << b for b in rng.sample(range(40), rng.randint(7, 10)))}
    rows = spark.createDataFrame([(0, f - (1 << 64) * (f >> 63)) for f in sorted(fps)], "mask long, fp long")
    got = []
    for group in (8192, 20):
        monkeypatch.setattr(simhash, "GROUP", group)
        got.append({r.fp for r in simhash._near_prints(rows).collect()})
    assert len(got[0]) > 200 and got[0] == got[1]


def test_sketches_pass_every_similar_pair():
    """Sketches reject no pair of a similarity of 0.8, of any size, and most of those a little below."""
    rng, sets = np.random.default_rng(3), []
    for n in (1, 2, 5, 63, 64, 65, 150, 500, 4000):
        base = rng.integers(0, 1 << 63, 2 * n, np.uint64)
        for gone in (0, 0.05, 0.1, 0.11, 0.12, 0.2, 0.3):
            k = int(gone * n)
            sets += [np.unique(np.r_[base[k:n], base[n : n + k]]), np.unique(base[k:n]), np.unique(base[: n + k])]
    sketches, sizes = [simhash.parity_sketch(x) for x in sets], np.array(list(map(len, sets)))
    got = [(min(a, b), max(a, b)) for i, j in simhash._maybe_similar(sizes, sketches, np.arange(len(sets))) for a, b in zip(i.tolist(), j.tolist())]
    like = {(i, j): len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) for j in range(len(sets)) for i in range(j)}
    assert len(got) == len(set(got)) and {p for p, x in like.items() if x >= 0.8} <= set(got)
    assert not [p for p in got if like[p] < 0.5 and sizes[list(p)].min() > 100]


@pytest.mark.parametrize("forests", [8, 1])
def test_texts_that_are_almost_similar_make_few_pairs(spark, monkeypatch, forests):
    """A large group of a similarity of 0.6 to 0.8: pairs to verify grow with its texts, not with their square, and no link is lost."""
    monkeypatch.setattr(simhash, "FORESTS", forests, raising=False)
    made, cut = [], simhash.cut

    def counted(df, *rest):
        out = cut(df, *rest)
        made.append(out.count() if out.columns == ["a", "u", "b", "v"] else 0)
        return out

    monkeypatch.setattr(simhash, "cut", counted)
    rng, text = random.Random(2), words(1, 200)
    rows = [(i, edited(rng, text, rng.choice([4, 5, 6]))) for i in range(300)]
    rows += [(300 + i, edited(rng, rows[rng.randrange(300)][1], rng.choice([1, 2, 4]))) for i in range(60)]
    kept = {r.doc_id for r in simhash.keep_one(documents(spark, rows), exact=True).collect()}
    sets, prints, root = [shingles(t) for _, t in rows], [brute_print(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert kept == {find(i) for i in range(len(rows))} and 200 < len(kept) < 360
    assert sum(made) < 20 * len(rows)
