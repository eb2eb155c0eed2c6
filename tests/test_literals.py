"""Words that patterns require: a text without them never matches."""

import random
import re

import pytest

from sparkloom.functions import dims
from sparkloom.operators import nodes as no
from sparkloom.operators.literals import required


@pytest.mark.parametrize("pattern,words", [
    (r"(os\.system|popen)\s*\(", {"os.system", "popen"}), (r"acl\s*=\s*\"(open|closed)\"", {"open", "closed"}), (r"(?i)Eval|x*", None), (r"[ab]+\d?", None), (r"(ab|abc)x", {"ab"}), (r"a{2,}(Bc)?", {"a"}), ("(", None), (r"\p{L}foo", None),
    (r"(?<!x)word", {"word"}), (r"É+abc", {"abc"}),
])
def test_required(pattern, words):
    got = required(pattern)
    assert got == (words and frozenset(words))


def test_no_match_without_a_word():
    rng = random.Random(8)
    bits = ["open", "(", " ", "=", "exec", "os.", "system", '"', "password", "abcdefgh", "query", ".", "raw", "token", "0.0.0.0/0", "[", "cidr_blocks", "false", "encrypted", "'"]
    for r in dims.CATALOG:
        words = required(r[5])
        for _ in range(400):
            text = "".join(rng.choices(bits, k=10))
            if re.search(r[5], text):
                assert words is None or any(w in text.lower() for w in words), (r[5], text)


def test_hits_equal_each_pattern_on_each_line(spark):
    rng = random.Random(3)
    bits = ["open(", "x ", "cursor.execute(", "\n", "os.system(", "password = 'abcdefgh'", ".query(", "re.compile(", "eval", "é", "PICKLE.LOADS", "pickle.loads(", '"Action": "*"']
    texts = [("".join(rng.choices(bits, k=rng.randrange(12))), rng.choice(["python", "java", None])) for _ in range(80)] + [(None, "python"), ("", "go")]
    files = spark.createDataFrame([(f"f{k}", t, x) for k, (t, x) in enumerate(texts)], "file_path string, text string, language string")
    catalog = dims.frame(spark, "catalog")
    want = sorted((f"f{k}", i, r[1], r[2], r[3], x == r[0]) for k, (t, x) in enumerate(texts) for i, line in enumerate((t or "").split("\n"), 1) for r in dims.CATALOG if re.search(r[5], line))
    assert sorted(map(tuple, no.pattern_hits(files, catalog).collect())) == [w[:5] for w in want]
    assert sorted(map(tuple, no.pattern_hits(files, catalog, language="language").collect())) == [w[:5] for w in want if w[5]]
    more = catalog.union(spark.createDataFrame([("any", "digits", "CWE-0", "LOW", "", "[0-9]", "")], catalog.schema))
    assert {r.vuln_type for r in no.pattern_hits(files.selectExpr("'f' as file_path", "'1' as text"), more).collect()} == {"digits"}
