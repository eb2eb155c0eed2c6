"""Quality, toxicity and URL models: statistics against brute force, held-out accuracy, odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import quality as q, toxicity as tox, url_filter as uf
from sparkloom.llm.sampling import labelled_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(x):
    x = x or ""
    w = WORD.findall(x)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    mark = [False] * len(w)
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            mark[i : i + 3] = [True] * 3
    seen, dup = set(), 0
    for line in x.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, sum(mark)]


def test_statistics():
    r = random.Random(4)
    texts = ["".join(r.choice("ab \n\té#|xy") for _ in range(r.choice([0, 1, 5, 60, 900]))) for _ in range(400)] + [None, "", "\n", "a\n", "a\n\na\na", "é é\né é\n", " \n \n"]
    assert q.statistics(pa.array(texts))[:, :5].tolist() == [by_hand(t) for t in texts]
    assert q.statistics(pa.array([], pa.string())).shape[0] == 0


def prose(r, n=80):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(n)).capitalize() + "."


def shouting(r):
    return " ".join(w.upper() + "!!" for w in prose(r).split())


@pytest.fixture(scope="module")
def judged(spark):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(700):
        bad, toxic = i % 5 == 0, i % 4 == 1
        text = shouting(r) if bad else prose(r)
        if toxic and not bad:
            w = text.split()
            for _ in range(r.randrange(2, 9)):
                w.insert(r.randrange(len(w)), r.choice(["zounds", "gadzooks", "drattery", "poxish", "grobian", "grobianly"]))
            text = " ".join(w)
        rows.append((i, text, 9))
        if i < 500:
            labels.append((i, 0 if bad else 1, int(toxic and not bad)))
    rows += [(1000, None, 1), (1001, "", 1), (1002, "word " * 60, 1), (None, prose(r), 1), (3, rows[3][1], 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_held_out(judged):
    docs, labels = judged
    got = q.quality_verdicts(docs, labels).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.doc_id is not None and 500 <= r.doc_id < 700]
    assert np.mean([r.kept == (r.doc_id % 5 != 0) for r in held]) > 0.97
    odd = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id >= 1000}
    assert all(r.base_failed and not r.kept for r in odd.values()) and odd[1002].n_repeat_words == 60
    kept = Counter(r.doc_id for r in q.keep_good(docs, labels).collect())
    assert kept == Counter(r.doc_id for r in got if r.kept)


def test_quality_without_labels(spark, judged):
    docs, labels = judged
    got = q.quality_verdicts(docs, labels.where("false")).collect()
    assert all(r.kept == (not r.base_failed) for r in got)
    assert q.quality_verdicts(docs.where("false"), labels).count() == 0


def test_quality_is_fitted_on_all_labelled_rows(spark):
    """Counts of leaves and the threshold against brute force over 9,000 labelled documents, more than were once sampled; however they are dealt."""
    from sparkloom.llm.scratch import Scratch

    words = "concat_ws(' ', transform(sequence(1, 60), x -> substr(md5(concat(id, '-', x)), 1, 2 + (x + id) % 5)))"
    docs = spark.range(9000).selectExpr("id as doc_id", f"if(id % 50 = 0, concat_ws(' ', transform(split({words}, ' '), x -> concat(upper(x), '!'))), {words}) as text")
    labels = spark.range(9000).selectExpr("id as doc_id", "int(id % 50 <> 0) as quality")
    scratch = Scratch(spark, "t")
    counts = q.counted(docs, scratch)
    forest, threshold = q.fit(counts, labels, scratch)
    rows = counts.selectExpr("*", f"pmod(xxhash64(doc_id, {q.SEED}), 2) as role").collect()
    s = np.array([[r[c] for c in q._COUNTS] for r in rows])
    bad, role = np.array([r.doc_id % 50 == 0 for r in rows]), np.array([r.role for r in rows])
    x, usable = q.ratios(s), ~q.base_failed(s)
    train = x[usable & ~bad & (role == 0)]
    inside = np.array([np.bincount(leaf, minlength=q.LEAVES) for leaf in forest.leaves(train)])
    assert inside.sum() == q.TREES * len(train) and len(train) > 4000
    path = forest.path
    forest.counted(inside.astype(float))
    assert np.array_equal(path, forest.path)
    good, caught = np.sort(forest.score(x[usable & ~bad & (role == 1)]))[::-1], forest.score(x[usable & bad])
    limit = good[int(q.LEAVE * len(good))]
    assert threshold == (limit + caught[caught > limit].min()) / 2 and (caught > threshold).mean() > 0.97
    again, same = q.fit(counts.repartition(7), labels, scratch)
    assert same == threshold and np.array_equal(again.path, forest.path) and np.array_equal(again.cut, forest.cut)


def test_kth_largest(spark):
    values = [*np.random.default_rng(0).random(300).tolist(), *[0.25] * 40, *(0.5 + k * 2.0**-50 for k in range(20))]
    scores = spark.createDataFrame([(v,) for v in values], "score double").cache()
    assert [q.kth_largest(scores, k) for k in (0, 140, 150, 359)] == [sorted(values)[::-1][k] for k in (0, 140, 150, 359)]


def test_toxicity_held_out(judged):
    docs, labels = judged
    got = tox.toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.doc_id is not None and 500 <= r.doc_id < 700]
    assert np.mean([r.toxic == (r.doc_id % 4 == 1 and r.doc_id % 5 != 0) for r in held]) > 0.97
    # the labels are two grades: the expected severity is the probability
    assert all(0 <= r.severity <= 1 and r.severity == r.p_toxic and r.grade in (0, 1) for r in got)
    assert Counter(r.doc_id for r in tox.remove_toxic(docs, labels).collect()) == Counter(r.doc_id for r in got if not r.toxic)


def test_toxicity_odd(spark, judged):
    docs, labels = judged
    assert not any(r.toxic for r in tox.toxicity(docs, labels.where("toxic = 0")).collect())
    assert tox.toxicity(docs.where("false"), labels).count() == 0


def test_labels_are_sampled_by_document(spark):
    """One label whose doc_id 5,000 rows carry gives one row; the bound holds for rows, whatever the labels' number."""
    docs = spark.range(5000).selectExpr("1L as doc_id", "concat('text ', id) as text").unionByName(spark.range(2, 400).selectExpr("id as doc_id", "cast(id as string) as text"))
    labels = spark.range(1, 400).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    labels = labels.union(labels).union(spark.sql("select cast(null as bigint), 1"))
    for n in (8, 100, 1000):
        got = labelled_texts(docs, labels, "toxic", n).collect()
        assert len(got) == len({r.doc_id for r in got}) == min(n, 399)
        assert all(r.text == ("text 0" if r.doc_id == 1 else str(r.doc_id)) and r.toxic == r.doc_id % 2 for r in got)
    assert {r.doc_id for r in labelled_texts(docs, labels.repartition(7), "toxic", 8).collect()} == {r.doc_id for r in labelled_texts(docs, labels, "toxic", 8).collect()}


def test_grades_of_severity_held_out(spark):
    """Labels of four grades: shared weights, three ordered thresholds, expected severity near the grade of unseen rows."""
    r = random.Random(2)
    mild, harsh = ["zounds", "drattery", "poxish"], ["grobian", "gadzooks", "villainy"]
    rows, labels = [], []
    for i in range(900):
        grade, w = i % 4, prose(r).split()
        for term in (mild if grade == 1 else harsh if grade > 1 else []) + (mild if grade == 3 else []):
            w.insert(r.randrange(len(w)), term)
        rows.append((i, " ".join(w)))
        labels.append((i, grade))
    got = {x.doc_id: x for x in tox.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels[:700], "doc_id long, toxic int")).collect()}
    assert np.mean([got[i].grade == g for i, g in labels[700:]]) > 0.7  # three in four by chance are wrong
    assert np.mean([abs(got[i].severity - g) for i, g in labels[700:]]) < 0.4
    assert np.mean([got[i].toxic == (g > 0) for i, g in labels[700:]]) > 0.97


def test_long_and_repeated_texts_are_scored_whole(spark, judged):
    docs, labels = judged
    r = random.Random(6)
    long = prose(r, 60_000)
    insults = " ".join(f"{prose(r, 30)} zounds gadzooks drattery poxish grobian grobianly" for _ in range(1500))
    extra = spark.createDataFrame([(2000, long, 1), (2001, long + " " + insults, 1), (2002, "ab#" * 300_000, 1), (2003, insults, 1), (2003, insults, 1)], docs.schema)
    every = docs.unionByName(extra)
    got = [(x.doc_id, x.toxic) for x in tox.toxicity(every, labels).collect() if x.doc_id is not None and x.doc_id >= 2000]
    assert sorted(got) == [(2000, False), (2001, True), (2002, False), (2003, True), (2003, True)]
    words = {x.doc_id: x for x in q.quality_verdicts(every, labels).collect() if x.doc_id in (2000, 2002)}
    assert words[2000].n_words == 60_000 and words[2002].n_symbols == 300_000 and words[2002].base_failed


def test_gradient_and_optimum():
    """The fit's gradient against differences, and its optimum against small steps in any direction."""
    r = np.random.default_rng(0)
    rows, columns = r.integers(0, 60, 400), r.integers(0, 8, 400)
    values, grade = r.normal(size=400), np.resize([0, 1, 2, 3], 60)
    seen = {}

    def grab(f, x, **_):
        seen.update(f=f, x=x)
        return minimise(f, x)

    minimise, tox.minimise = tox.minimise, grab
    try:
        w, theta = tox.fit_ordinal(rows, columns, values, grade, 8)
    finally:
        tox.minimise = minimise
    x = r.normal(size=len(seen["x"])) * 0.3
    f = seen["f"]
    for k in range(len(x)):
        e = np.eye(len(x))[k] * 1e-6
        assert f(x)[1][k] == pytest.approx((f(x + e)[0] - f(x - e)[0]) / 2e-6, abs=1e-5)
    best = minimise(f, seen["x"])
    assert all(f(best)[0] <= f(best + d)[0] + 1e-6 for d in r.normal(size=(200, len(best))) * 0.05)
    assert (np.diff(theta) > 0).all() and np.allclose(w, best[:8])


def test_thresholds_are_ordered():
    r = np.random.default_rng(0)
    grade = np.repeat([0, 1, 2, 3], 50)
    lists = [r.choice(10, g * 2 + 1, replace=False) for g in grade]
    rows, columns = np.repeat(np.arange(200), [len(x) for x in lists]), np.concatenate(lists)
    w, theta = tox.fit_ordinal(rows, columns, np.ones(len(rows)), grade, 10)
    assert (np.diff(theta) > 0).all()
    z = np.array([w[x].sum() for x in lists])
    assert np.mean(np.searchsorted(theta, z) == grade) > 0.9


def test_best_cut():
    z, bad = np.array([0.0, 1.0, 2.0, 5.0, 6.0]), np.array([False, False, False, True, True])
    assert tox.best_cut(z, bad) == 3.5
    assert tox.best_cut(np.array([0.0, 1.0]), np.array([False, False])) > 1
    r = random.Random(1)
    for _ in range(200):
        z, bad = np.array([float(r.randrange(9)) for _ in range(12)]), np.array([r.random() < 0.4 for _ in range(12)])
        wrong = lambda c: int(((z >= c) != bad).sum())
        got = tox.best_cut(z, bad)
        assert wrong(got) == min(wrong(c) for c in np.arange(-1, 10, 0.5))


URLS = [
    ("http://a.b.COM/x", "a.b.com", "/x", "com/", "allow"), ("https://www.example.com/en/1?q#f", "www.example.com", "/en/1", "www.example.com/en/", "allow"), ("https://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"),
    ("https://xexample.com/en/", "xexample.com", "/en/", "com/", "allow"), ("http://h.net/es/a", "h.net", "/es/a", "net/es/", "block"), ("http://net/fr/", "net", "/fr/", "net/fr/", "block"), ("http://h.net?x=/fr/", "h.net", "", None, None),
    ("http://e.com", "e.com", "", None, None), ("no scheme.com/", "", "", None, None), ("", "", "", None, None), (None, "", "", None, None), ("x://É.org/ü?", "É.org", "/ü", None, None),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(k, u[0], "z") for k, u in enumerate(URLS)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in uf.url_verdicts(df).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == verdict if verdict else got[k].verdict in ("allow", "block")
    assert uf.url_verdicts(df.where("false")).count() == 0


def test_boosted_trees_learn():
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = uf.boost(x[:400], y[:400])
    assert ((m.log_odds(x[400:]) > 0) == y[400:]).mean() > 0.9


def test_url_model_held_out(spark):
    r = random.Random(8)
    rows = [(k, f"http://h{k}.com/{'/'.join('abc' for _ in range(k % 3))}") if k % 2 else (k, f"http://h{k}.net/es/{r.randrange(10**9)}?a=1&b=2&c=3") for k in range(400)]
    held = [(1000 + k, f"http://q{k}.org/{r.randrange(10**9)}?a=1&b=2&c={k}") for k in range(50)] + [(2000 + k, f"http://q{k}.org/abc/abc") for k in range(50)]
    got = {x.page_id: x.verdict for x in uf.url_verdicts(spark.createDataFrame(rows + held, "page_id long, url string")).collect()}
    assert np.mean([got[k] == ("block" if k < 2000 else "allow") for k, _ in held]) > 0.9


def test_url_model_learns_other_labels_than_the_suffix(spark):
    """Labels that depend on digits and parameters only: every suffix has both verdicts, hosts of the judged urls are new."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 9)))

    def url(bad):
        path = "/".join([word(), *(str(r.randrange(10**7)) for _ in range(2))] if bad else [word() for _ in range(3)])
        return f"http://{word()}{r.randrange(99)}.{r.choice(['one', 'two', 'three'])}.{r.choice(['com', 'org'])}/{path}" + ("?a=1&b=2&c=3" if bad else r.choice(["", "?a=1"]))

    labelled = spark.createDataFrame([(url(k % 2), "block" if k % 2 else "allow") for k in range(600)], "url string, verdict string")
    pages = [(k, url(k % 2)) for k in range(200)]
    got = {x.page_id: x.verdict for x in uf.url_verdicts(spark.createDataFrame(pages, "page_id long, url string"), [], labelled=labelled).collect()}
    assert np.mean([got[k] == ("block" if k % 2 else "allow") for k, _ in pages]) > 0.95
    assert uf.fit(uf._parts(labelled, "verdict")).held_out > 0.95


def test_rates_are_of_other_folds():
    suffix, fold, y = np.array([1, 1, 1, 2, 2, 3]), np.array([0, 0, 1, 1, 2, 3]), np.array([1.0, 0, 0, 0, 1, 1])
    x = uf._with_rates(np.zeros((6, 1)), suffix[:, None], fold, y)
    for k in range(6):
        mine = fold != fold[k]
        share = y[mine].mean()
        w = np.where(y[mine] == 1, 0.5 / share, 0.5 / (1 - share))
        at = suffix[mine] == suffix[k]
        want = ((w * y[mine])[at].sum() + 0.5 * uf.PRIOR_ROWS) / (w[at].sum() + uf.PRIOR_ROWS) if at.any() else 0.5
        assert x[k, 1] == pytest.approx(want)


def test_url_samples_are_of_distinct_urls(spark):
    """300 rows of one url count as one: verdicts of held-out urls don't depend on the copies, whatever the sample."""
    rows = [(0, "http://copy.com/a")] * 300 + [(k, f"http://h{k}.net/es/{k}?a=1&b=2") if k % 2 else (k, f"http://h{k}.com/abc") for k in range(200)]
    held = [(1000 + k, f"http://q{k}.org/es/{k}?a=1&b=2") for k in range(20)] + [(2000 + k, f"http://q{k}.org/abc") for k in range(20)]
    for sample in (100, 150, 20000):
        got = {x.page_id: x.verdict for x in uf.url_verdicts(spark.createDataFrame(rows + held, "page_id long, url string"), sample=sample).collect()}
        assert np.mean([got[k] == ("block" if k < 2000 else "allow") for k, _ in held]) > 0.9


def test_very_long_and_repeated_urls(spark):
    long = "https://m.example.com/en/" + "x" * 1_000_000 + "?" + "a=1&" * 1000
    df = spark.createDataFrame([(1, long), (1, long), (2, "http://" + "a." * 5000 + "net/es/")], "page_id long, url string")
    got = uf.url_verdicts(df).collect()
    assert [(r.page_id, r.verdict) for r in got] == [(1, "block"), (1, "block"), (2, "block")] and got[0] == got[1]
    assert got[0].path == long[len("https://m.example.com") : long.index("?")]
