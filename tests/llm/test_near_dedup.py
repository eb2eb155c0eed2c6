import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import near_dedup as nd
from sparkloom.llm.scratch import Scratch, shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, percent=85, size=5):
    sets = defaultdict(list)
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i].append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = {i: i for i in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, s) for i, several in sets.items() if i is not None for s in several if s]
    for a in range(len(flat)):
        for b in range(a):
            (i, x), (j, y) = flat[a], flat[b]
            if 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return Counter((i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, several in sets.items() for s in several)


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in nd.near_duplicates(df, **more).collect()) == by_hand(rows, **more)


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.6:
            w = list(r.choice(rows)[1].split())
            for _ in range(r.choice([0, 1, 1, 2, 4, 8])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        else:
            w = [r.choice(vocabulary) for _ in range(r.choice([6, 30, 120, 400]))]
        rows.append((i * 3, " ".join(w)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_equals_all_pairs(spark, seed):
    check(spark, corpus(seed))


def test_odd_rows(spark):
    check(spark, [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  B"), (6, "a b c"), (None, "a b"), (None, None), (7, "É x"), (8, "é x"), (9, "one two three four five six"), (9, "seven eight nine ten eleven"), (10, "seven eight nine ten eleven"), (11, "one two three four five six"), (4, "a b")])


def test_empty_table_extra_columns_and_long_text(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = " ".join(f"t{k}" for k in range(60_000))
    df = spark.createDataFrame([(1, long, 5, "k"), (2, long + " end", 6, "k")], "doc_id long, text string, component_id int, kept string")
    assert sorted(tuple(r) for r in nd.near_duplicates(df).collect()) == [(1, 59996, 1, True), (2, 59997, 1, False)]
    assert sorted((r.doc_id, r.component_id, r.kept) for r in nd.keep_one_of_each(df).collect()) == [(1, 5, "k")]


def test_hub_in_a_group_of_dissimilar_copies(spark):
    """Every copy is linked with the base alone: the star's center has to be found."""
    r = random.Random(5)
    base = [f"b{k}" for k in range(200)]
    rows = [(500, " ".join(base))]
    for i in range(40):
        w = list(base)
        at = r.randrange(0, 190)
        for k in range(3):
            w[(at + 60 * k) % 200] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    check(spark, rows)


def members_of(spark, docs):
    """(digest, rep, n, component) of each class, as near_duplicates() makes them, every class a component of its own."""
    sig = docs.mapInArrow(nd._signatures(5), "doc_id long, n_shingles long, digest binary, bands array<bigint>")
    return sig.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")).withColumn("component", F.xxhash64("digest"))


def test_prefix_candidates_lose_nothing(spark):
    rows = corpus(9, 50)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    members = members_of(spark, docs)
    sets, reps = {}, {x.rep for x in members.collect()}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    got = {(r.a, r.b) for r in nd._prefix_candidates(docs, members, 85, 5, Scratch(spark, "test")).collect()}
    want = {(a, b) for a in reps for b in reps if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert want <= got


def test_prefix_candidates_of_repeated_doc_ids(spark):
    """A doc_id with several texts is several sets: the common words of one don't push the rare ones of another out of its prefix."""
    r = random.Random(12)
    base = [[f"k{j}_{k}" for k in range(60)] for j in range(6)]
    rows = [(1, " ".join(b)) for b in base] + [(10 + j, " ".join(b[:-1] + ["other"])) for j, b in enumerate(base)]
    rows += [(50 + j, " ".join(r.choice(base)[:30] + [f"z{j}_{k}" for k in range(40)])) for j in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.a, x.b) for x in nd._prefix_candidates(docs, members_of(spark, docs), 85, 5, Scratch(spark, "test")).collect()}
    assert {(1, 10 + j) for j in range(6)} <= got
    check(spark, rows)


def test_keep_one_of_each(spark):
    text = " ".join(f"t{k}" for k in range(50))
    rows = [(1, text, "a", "x"), (2, text + " end", "b", "y"), (None, text, "c", "z"), (None, None, "d", None), (3, "b", "e", "q"), (3, "a", "f", "r"), (3, "a", "f", "r"), (4, None, "g", "s"), (5, "", "h", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _near_id string, kept string")
    got = nd.keep_one_of_each(df)
    assert got.columns == df.columns
    assert Counter(tuple(x) for x in got.collect()) == Counter([rows[0], rows[2], rows[3], rows[5], rows[7], rows[8]])
    assert nd.keep_one_of_each(df.where("false")).count() == 0


def test_no_local_folder_on_a_cluster(spark):
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *_: "")})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_dir(Elsewhere)


def test_components(spark):
    r = random.Random(2)
    edges = [(a, b) for a, b in ((r.randrange(80), r.randrange(80)) for _ in range(60)) if a != b] + [(100 + k, 101 + k) for k in range(20)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = {x.node: x.component for x in nd.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_band_agreement_estimates_similarity():
    r = np.random.default_rng(1)
    for n in (30, 1000):
        same = []
        for _ in range(30):
            common, own = r.integers(0, 2**63, n).astype(np.uint64), r.integers(0, 2**63, (2, n // 10)).astype(np.uint64)
            a, b = (nd.one_permutation(np.sort(np.concatenate([common, x]))) for x in own)
            same.append((a == b).mean())
        assert abs(np.mean(same) - n / (n + 2 * (n // 10))) < 0.05


def test_links_do_not_depend_on_the_bitmap(spark, monkeypatch):
    """A bitmap that is full lets every document through: more work, the same components."""
    r = random.Random(12)
    base = [" ".join(f"w{r.randrange(900)}" for _ in range(60)) for _ in range(30)]
    texts = base + [t.rsplit(" ", 2)[0] for t in base[:15]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, nd.near_duplicates(docs).collect()))
    monkeypatch.setattr(nd, "LEAST_BITS", 32)
    monkeypatch.setattr(nd, "MOST_BITS", 32)
    assert sorted(map(tuple, nd.near_duplicates(docs).collect())) == want and any(not w[3] for w in want)


def test_one_row_of_equal_texts(spark):
    """Rows alike in doc_id and text: the same one at any order and partitioning."""
    rows = [(1, "a b c d e f", x, {"k": x}) for x in ("z", "m", "b", "q")]
    schema = "doc_id long, text string, note string, more map<string,string>"
    for order in (rows, rows[::-1]):
        for n in (1, 3):
            assert [r.note for r in nd.keep_one_of_each(spark.createDataFrame(order, schema).repartition(n)).collect()] == ["b"]
