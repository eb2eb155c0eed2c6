"""The block scanner against a stack, on random texts and sources of several languages."""

import random
import time

import numpy as np
import pytest

from sparkloom.operators import blocks as bl

PAIR = {"}": "{", ")": "(", "]": "["}


def with_stacks(text, language):
    """Character by character: one stack for each kind of bracket; strings and comments are passed over by hand."""
    stacks, out, i, line, col = {"{": [], "(": [], "[": []}, {}, 0, 1, 0
    quotes = {"javascript": "\"'`", "java": "\"'", "go": "\"'`", "hcl": '"'}[language]
    mode = None
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        step = 1
        if mode is None:
            if two == "//" or (language == "hcl" and c == "#"):
                mode = "line"
            elif two == "/*":
                mode, step = "block", 2
            elif c in quotes:
                mode = c
            elif c in "{([":
                up = stacks[c][-1] if stacks[c] else None
                out[i] = [c, i, len(text), line, None, col, len(stacks[c]), up, False]
                stacks[c].append(i)
            elif c in "})]" and stacks[PAIR[c]]:
                o = stacks[PAIR[c]].pop()
                out[o][2], out[o][4], out[o][8] = i + 1, line, True
        elif mode == "line":
            mode = None if c == "\n" else mode
        elif mode == "block":
            if two == "*/":
                mode, step = None, 2
        elif c == "\\" and i + 1 < len(text):
            step = 2
        elif c == mode or (c == "\n" and mode != "`"):
            mode = None
        for x in text[i : i + step]:
            line, col = (line + 1, 0) if x == "\n" else (line, col + 1)
        i += step
    for r in out.values():
        r[4] = line if r[4] is None else r[4]
    return sorted(tuple(r) for r in out.values())


@pytest.mark.parametrize("language", ["javascript", "java", "go", "hcl"])
def test_spans_equal_a_stack(language):
    rng = random.Random(len(language))
    for _ in range(300):
        text = "".join(rng.choices(["{", "}", "(", ")", "[", "]", "\n", " a", ";", '"', "'", "`", "\\", "/", "*", "//", "/*", "*/", "#", "É", "if ("], [5, 5, 3, 3, 2, 2, 4, 6, 2, 1, 1, 1, 1, 1, 1, 0.5, 0.5, 1, 0.5, 1, 1], k=rng.randrange(120)))
        assert sorted(tuple(r[:9]) for r in bl.bracket_spans(text, language)) == with_stacks(text, language), text


def test_brackets_of_any_sequence():
    rng = random.Random(1)
    for _ in range(300):
        opener = np.array([rng.random() < rng.choice([0.2, 0.5, 0.8]) for _ in range(rng.randrange(1, 60))])
        partner, depth = bl.match_brackets(opener)
        above, stack, want, up = bl.parents(opener, depth), [], [-1] * len(opener), [-1] * len(opener)
        for k, o in enumerate(opener):
            if o:
                up[k] = stack[-1] if stack else -1
                stack.append(k)
            elif stack:
                j = stack.pop()
                want[k], want[j] = j, k
        assert partner.tolist() == want
        assert above.tolist() == up


def test_deep_and_long_texts_are_linear():
    began = time.time()
    assert sum(1 for _ in bl.bracket_spans("{" * 60_000 + "}" * 60_000, "java")) == 60_000
    assert sum(1 for _ in bl.bracket_spans("/* " * 200_000 + '"' * 9, "java")) == 0
    assert time.time() - began < 5


SOURCES = {
    "java": 'package a; // {\npublic class Foo extends Bar {\n  int add(int a, int b) throws X { if (a > b) { return a; } else { return b; } }\n  void run() { for (;;) { try { go("}"); } catch (E e) { } finally { } } }\n}\n',
    "javascript": "function f(a) { return a.map(x => { return {y: x} }) }\nconst o = { p: 1 }\nclass K { constructor() { while (true) { } } }\n",
    "go": "func (s *S) Name(x int) error {\n\tswitch x { }\n\tfunc() { }()\n}\ntype T struct { }\n",
    "rust": "impl Foo { fn bar<'a>(&self, c: char) -> u8 { match c { '{' => 1, _ => 2 } } }\nmod m { }\n",
}
WANT = {
    "java": [("CLASS", "Foo"), ("FUNCTION", "add"), ("IF", ""), ("IF", ""), ("FUNCTION", "run"), ("LOOP", ""), ("TRY", ""), ("CATCH", ""), ("FINALLY", "")],
    "javascript": [("FUNCTION", "f"), ("LAMBDA", ""), ("BLOCK", ""), ("ASSIGN", ""), ("CLASS", "K"), ("FUNCTION", "constructor"), ("LOOP", "")],
    "go": [("FUNCTION", "Name"), ("IF", ""), ("LAMBDA", ""), ("CLASS", "T")],
    "rust": [("CLASS", "Foo"), ("FUNCTION", "bar"), ("IF", ""), ("MODULE", "m")],
}


def test_structure_nodes(spark):
    rows = [(f"x.{k}", v, k.upper()) for k, v in SOURCES.items()] + [("big", "{" * 3000, "java"), ("none", None, "java"), ("what", "{}", "cobol"), ("null", "{}", None), ("open", "void f() {\n\n", "c"), ("empty", "", "c")]
    got = bl.structure_nodes(spark.createDataFrame(rows, "file_path string, text string, language string"), max_bytes=2000).orderBy("file_path", "start").collect()
    for k, want in WANT.items():
        assert [(r.t, r.name) for r in got if r.file_path == f"x.{k}" and r.t != "PROGRAM"] == want
    top = {r.file_path: r for r in got if r.t == "PROGRAM"}
    assert {k: r.attributes for k, r in top.items() if r.attributes} == {"big": "rejected", "what": "unsupported", "null": "unsupported"}
    (f,) = [r for r in got if r.file_path == "open" and r.t != "PROGRAM"]
    assert (f.t, f.name, f.line, f.end_line, f.attributes) == ("FUNCTION", "f", 1, 3, "unclosed")
    assert len([r for r in got if r.file_path in ("big", "none", "empty", "what", "null")]) == 5
    inner = {r.start: r for r in got if r.file_path == "x.java"}
    assert all(inner[r.parent_start].depth == r.depth - 1 for r in inner.values() if r.parent_start is not None)


def test_no_files(spark):
    assert bl.structure_nodes(spark.createDataFrame([], "file_path string, text string, language string")).collect() == []
