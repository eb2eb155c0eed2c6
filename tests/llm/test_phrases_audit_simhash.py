"""Phrase collocations, the filter audit and SimHash near-duplicates against brute force, with odd rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from sparkloom.llm import collocations as co, filter_audit as fa, simhash as sh

DOCS = "doc_id long, text string, lang string, source string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def pieces(text):
    out = [[]]
    word = ""
    for c in lower(text) + "\n":
        if c in ".,;:!?\n\x0b\x0c\r \t":
            if word:
                out[-1].append(word)
            word = ""
            if c not in " \t":
                out.append([])
        else:
            word += c
    return out


def brute_phrases(rows, least, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        for words in pieces(text):
            n[lang or "und"] += len(words)
            for i in range(len(words)):
                for m in range(1, 5):
                    if i + m <= len(words):
                        f[lang or "und"][tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            if any(100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items() if len(q) > len(p)):
                continue
            score, _, l, r = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -score) for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def odd_texts(rng, n, vocabulary, longest=60):
    words = [f"{'É' * (k % 3)}W{k}" for k in range(vocabulary)]
    gaps = [" "] * 8 + ["  ", "\t", ". ", ",", "\n", ";\x0b", "!?"]
    return ["".join(w + rng.choice(gaps) for w in rng.choices(words, k=rng.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize("shard,block", [(co.SHARD, co.BLOCK), (200, 7), (1 << 20, 50)])
def test_phrase_counts_equal_a_sliding_window(shard, block, monkeypatch):
    monkeypatch.setattr(co, "SHARD", shard)
    monkeypatch.setattr(co, "BLOCK", block)
    import pyarrow as pa

    rng = random.Random(5)
    texts = [*odd_texts(rng, 40, 4), "", None, " . ", "a b c d e", "x" * 500, "Q q q q q q", ". a b . c", "a"]
    langs = [rng.choice(["en", "de"]) for _ in texts]
    got, totals = Counter(), Counter()
    for batch in co._blocks(16)([pa.RecordBatch.from_pydict({"text": texts[i : i + 7], "lang": langs[i : i + 7]}, pa.schema([("text", pa.string()), ("lang", pa.string())])) for i in range(0, len(texts), 7)]):
        for r in batch.to_pylist():
            for x in co.open_blocks(r["phrases"], r["counts"]).to_pylist():
                (got if x["phrase"] != "\n" else totals)[r["lang"], x["phrase"][:-1]] += x["f_sum"]
    want = Counter()
    for text, lang in zip(texts, langs, strict=True):
        for words in pieces(text):
            want.update((lang, " ".join(words[i : i + m])) for i in range(len(words)) for m in range(1, 5) if i + m <= len(words))
    assert got == want
    assert {k[0]: v for k, v in totals.items()} == {lang: sum(len(p) for t, x in zip(texts, langs, strict=True) if x == lang for p in pieces(t)) for lang in ("en", "de")}


def test_one_phrase_always_lands_in_one_part():
    import pyarrow as pa

    where = defaultdict(set)
    for texts in (["a b c d. x y"], ["x y", "b c a b c d"], ["c d, x y a b c"]):
        for batch in co._blocks(64)([pa.RecordBatch.from_pydict({"text": texts, "lang": ["en"] * len(texts)})]):
            for r in batch.to_pylist():
                for x in co.open_blocks(r["phrases"], r["counts"]).to_pylist():
                    where[x["phrase"]].add(r["p"])
    assert all(len(p) == 1 for p in where.values())


@pytest.mark.parametrize("top", [2000, 5])
def test_collocations_equal_brute_force(spark, top):
    rng = random.Random(11)
    rows = [(k, t, rng.choice(["en", "de", None]), "s") for k, t in enumerate(odd_texts(rng, 300, 9))]
    rows += [(-1, None, "en", None), (-2, "", None, ""), (-3, " .\n", "fr", "x"), (-4, "very long " * 3000, "en", "x")] + [(-5, "the same words come here again and again", "de", "x")] * 12
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in co.collocations(docs.withColumnsRenamed({"source": "phrase"}), least=8, top=top).collect())
    assert got == brute_phrases(rows, 8, top) and len(got) > 10


def test_scores_pass_64_bits(spark):
    """Counts near 2**62 keep exact scores."""
    a = 2**61 + 1
    got = spark.createDataFrame([(a, a, a + 2)], "a long, l long, r long").selectExpr("cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r) as score").first().score
    assert got == 2_000_000 * a // (2 * a + 2)


def test_collocations_of_an_empty_table(spark):
    assert co.collocations(spark.createDataFrame([], DOCS)).collect() == []


# ---------------------------------------------------------------- filter audit

ORDERS = [o for o, step, *_ in fa._steps() if step == 1]


def fails(doc_id, text, rows):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    text = text or ""
    upper = sum("A" <= c <= "Z" for c in text)
    copy = doc_id is not None and any((t or "") == text and i is not None and i < doc_id for i, t, *_ in rows)
    return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * upper > 2 * len(text), "D": any(c in "#$%&*|" for c in text), "E": copy}


def brute_audit(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    failed = [(src or "", d, fails(d, t, rows)) for d, t, _, src in rows]
    out = {}
    for part in {p for p, *_ in failed}:
        mine = [(d, f) for p, d, f in failed if p == part]
        sums, table = Counter(), {}
        for order in ORDERS:
            alive = mine
            for step, x in enumerate(order, 1):
                here, alive = [y for y in alive if y[1][x]], [y for y in alive if not y[1][x]]
                sums[x] += len(here)
                every = sum(f[x] for _, f in mine)
                table[order, step] = [len(alive), len(here), every - len(here), sum(f[x] and sum(f.values()) == 1 for _, f in mine), sum(d in good for d, _ in here), sum(d in toxic for d, _ in here)]
        out |= {(part, o, s): (*v, sums[o[s - 1]]) for (o, s), v in table.items()}
    return out


def test_audit_equals_all_orders_by_hand(spark):
    rng = random.Random(3)
    plain = [" ".join(f"w{rng.randrange(400)}" for _ in range(300)) for _ in range(4)]
    texts = [*plain, plain[0], "short", "SHOUTING " * 250, "a $ " * 150, "again and " * 120, None, "", " ".join(f"é{k}" for k in range(200)), "\x0bx\x0cy " * 200, "x" * 50_000]
    rows = [(rng.choice([*range(20), None]), rng.choice(texts), "en", rng.choice(["a", "b", "", None])) for _ in range(60)] + [(7, plain[1], "en", "a"), (7, plain[1], "en", "a"), (3, plain[1], "en", "only")]
    labels = [(k % 15, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(25)] + [(None, 1, 1)]
    got = fa.audit_filters(spark.createDataFrame(rows, DOCS).withColumnsRenamed({"lang": "digest"}), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()} == brute_audit(rows, labels)
    assert len(ORDERS) == 120


def test_audit_of_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit_filters(spark.createDataFrame([], DOCS), labels).collect() == []
    one = fa.audit_filters(spark.createDataFrame([(1, None, None, None)], DOCS), labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and all(r.kept + r.removed == (1 if r.filter_order.index("A") >= r.step - 1 else 0) for r in one)


# ---------------------------------------------------------------- SimHash


def brute_fingerprint(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in lower(text)).split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, most=4):
    left, out = set(range(len(values))), {}
    while left:
        seen, front = set(), {min(left)}
        while front:
            seen |= front
            left -= front
            front = {j for j in left if any((values[i] ^ values[j]).bit_count() <= most for i in front)}
        out |= dict.fromkeys(seen, min(seen))
    return [out[k] for k in range(len(values))]


def test_fingerprints_equal_brute_force():
    import pyarrow as pa

    rng = random.Random(2)
    texts = [*odd_texts(rng, 60, 12), None, "", " \t", "one", "A b", "a B c d", "x " * 70_000, "w" * 3000]
    assert list(sh.fingerprints(pa.array(texts, pa.string()))) == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("most", [4, 2, 0])
def test_links_equal_all_pairs(spark, most):
    """Random words, chains and dense balls around centers, some across the ring's end, some that only a chain of links joins."""
    rng = random.Random(most)
    values = [rng.getrandbits(64) for _ in range(300)]
    for center in values[:12]:
        at = center
        for _ in range(25):
            at = rng.choice([center, at])
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                at ^= 1 << b
            values.append(at)
    values += [0, (1 << 64) - 1, 1, 0xF, 0x1F, *(values[20] ^ ((0b11 << 62) | (0b11 << k)) for k in range(60))]
    values = sorted(set(values))
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    from sparkloom.llm.scratch import Scratch

    found = {r.node: r.component for r in sh.links_of(spark.createDataFrame([(v,) for v in signed], "fp long"), most, Scratch(spark, "t")).collect()}
    want = brute_components(values, most)
    groups, got = defaultdict(set), defaultdict(set)
    for k, v in enumerate(signed):
        groups[want[k]].add(v)
        got[found.get(v, v)].add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_exploded_keys_are_not_broadcast(spark):
    """A table of 5 or 70 keys for each fingerprint is far larger than Spark takes it to be: small as it looks, the driver never gets it."""
    from sparkloom.llm.scratch import Scratch

    plans = []

    class Watched(Scratch):
        def put(self, df, name, replace=False):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().put(df, name, replace)

    scratch = Watched(spark, "t")
    nodes = scratch.put(spark.createDataFrame([(k * k << 7,) for k in range(300)], "fp long"), "nodes")
    assert sh.links_of(nodes, 4, scratch).count()
    keyed = [p for p in plans if "key#" in p]
    assert len(keyed) > 1 and not any("Broadcast" in p for p in keyed)


def test_every_pair_within_the_limit_keeps_a_chain(spark):
    """Pigeonring: whatever up to 4 bits differ, one start's chains keep their budgets; a key of that start is looked up."""
    rng = random.Random(9)
    flips = [0, *(sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))) for _ in range(4000))]
    x = rng.getrandbits(64)
    rows = [tuple(np.array([x, x ^ f], np.uint64).view(np.int64).tolist()) for f in flips]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(rows)], "k int, fp long, other long")
    kept = sh._kept(df.select("k", F_col("other").alias("fp"))).withColumnRenamed("fp", "other")
    hit = sh._looked_up(df.select("k", "fp")).join(kept, ["k", "key"]).where(sh._chain_holds("fp", "other", "key", 4))
    assert hit.select("k").distinct().count() == len(flips)


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_simhash_duplicates(spark):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(20)]
    texts = [*base, *base[:5]]
    for t in base[:10]:
        words = t.split(" ")
        for _ in range(3):
            words[rng.randrange(400)] = "changed"
            texts.append(" ".join(words))
    texts += [None, "", " ", "a", "A", "a b c d", "q " * 20_000]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in sh.simhash_duplicates(spark.createDataFrame(rows, DOCS).withColumnsRenamed({"lang": "fp", "source": "key"})).collect()}
    values = [brute_fingerprint(t) for t in texts]
    assert [got[k].fingerprint for k in range(len(texts))] == [f"{v:016x}" for v in values]
    assert [got[k].component_id for k in range(len(texts))] == brute_components(values)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_simhash_ids(spark):
    """Null ids are no names; a doc_id of two texts links them; repeated rows stay."""
    rows = [(None, "alone is this text here", "", ""), (None, "x y z", "", ""), (9, "x y z", "", ""), (9, "other words than those before", "", ""), (4, "other words than those before", "", ""), (4, "other words than those before", "", "")]
    got = [(r.doc_id, r.component_id, r.kept) for r in sh.simhash_duplicates(spark.createDataFrame(rows, DOCS)).collect()]
    assert Counter(got) == Counter([(None, None, True), (None, 4, True), (9, 4, False), (9, 4, False), (4, 4, True), (4, 4, True)])
    assert sh.simhash_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    with pytest.raises(ValueError):
        sh.links_of(spark.createDataFrame([Row(fp=1)]), 5, None)
