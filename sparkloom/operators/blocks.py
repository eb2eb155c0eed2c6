"""Structure of bracketed languages: spans and parents of brackets by depth prefix sums, and nodes from the heads of blocks.

No grammar is needed: strings and comments are passed over, and each kind of bracket is matched by the running sum of its openers and
closers. A closer that nothing opened lowers the sum's floor, so what follows still matches; an opener that nothing closes runs to the
end of its file. One pass over Arrow batches, no shuffle: a worker holds a batch's files, and files above ``max_bytes`` are not opened.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.text import node_id
from ..shipping import ship

#: Languages whose blocks are brackets, and how their strings and comments look.
_COMMON = r"//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/|/\*[\s\S]*|\"(?:[^\"\\\n]|\\[\s\S])*\"?"
TOKENS = {
    **dict.fromkeys(("c", "cpp", "java", "csharp", "kotlin", "scala", "php", "swift"), _COMMON + r"|'(?:[^'\\\n]|\\[\s\S])*'?"),
    **dict.fromkeys(("javascript", "typescript", "go"), _COMMON + r"|'(?:[^'\\\n]|\\[\s\S])*'?|`(?:[^`\\]|\\[\s\S])*`?"),
    "rust": _COMMON + r"|'(?:[^'\\\n]|\\[^\n])'",
    "hcl": r"#[^\n]*|" + _COMMON,
}
TOKENS["terraform"] = TOKENS["hcl"]
_OPENS, _CLOSES = "{([", "})]"
SPANS = "file_path string, bracket string, start long, stop long, line long, end_line long, col long, depth int, parent_start long, closed boolean, head string"

#: What a block is by the text before it: (pattern, node type, group of the name or 0), the first that fits.
HEADS = [
    (r"\btype\s+([A-Za-z_]\w*)\s+(?:struct|interface)\s*$", "CLASS", 1),
    (r"\b(?:class|interface|struct|enum|trait|impl|record)\s+([A-Za-z_$][\w$]*)", "CLASS", 1),
    (r"\b(?:namespace|module|package|mod)\s+([A-Za-z_$][\w$.:]*)", "MODULE", 1),
    (r"^(?:else|if|unless|switch|match|select)\b|\bmatch\b[^;()]*$", "IF", 0),
    (r"^(?:\w+:\s*)?(?:for|while|do|foreach|loop)\b", "LOOP", 0),
    (r"^try\b", "TRY", 0),
    (r"^(?:catch|except|rescue)\b", "CATCH", 0),
    (r"^finally\b", "FINALLY", 0),
    (r"\b(?:function|func|fn|fun|def)\b\s*\*?\s*(?:\([^()]*\)\s*)?([A-Za-z_$][\w$]*)", "FUNCTION", 1),
    (r"=>\s*$|\b(?:function|func)\s*\([^()]*\)\s*$", "LAMBDA", 0),
    (r"([A-Za-z_$~][\w$]*)\s*(?:<[^<>]*>)?\s*\([^;{}]*\)[^;{}()=]*$", "FUNCTION", 1),
    (r"=\s*(?:new\b[^;]*)?$", "ASSIGN", 0),
]


def match_brackets(opener: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(partner, depth) of a sequence of openers (True) and closers: a partner's index or -1, an opener's depth from 0 (closers: their opener's).

    The running sum of +1 and -1, lifted by its lowest value so far, is the depth with unmatched closers left out. Openers and closers of
    one depth alternate, so a stable sort by depth puts partners side by side.
    """
    step = np.where(opener, 1, -1)
    sums = np.cumsum(step)
    floor = np.minimum(np.minimum.accumulate(sums), 0) if len(sums) else sums
    depth = sums - floor - opener  # an opener's depth is that before it, a closer's that after it
    before = np.concatenate([[0], floor[:-1]])
    lost = ~opener & (floor < before)
    partner = np.full(len(opener), -1)
    at = np.flatnonzero(~lost)
    order = at[np.argsort(depth[at], kind="stable")]
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        pair = (depth[a] == depth[b]) & opener[a] & ~opener[b]
        partner[a[pair]], partner[b[pair]] = b[pair], a[pair]
    return partner, np.where(lost, -1, depth)


def parents(opener: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """For each opener the index of the last opener before it that is one less deep, else -1; -1 for closers."""
    n = len(opener)
    opens = np.flatnonzero(opener)
    keys = np.sort(depth[opens] * (n + 1) + opens)
    out = np.full(n, -1)
    inner = opens[depth[opens] > 0]
    out[inner] = keys[np.searchsorted(keys, (depth[inner] - 1) * (n + 1) + inner) - 1] % (n + 1)
    return out


def bracket_spans(text: str, language: str) -> Iterator[tuple]:
    """(bracket, start, stop, line, end_line, col, depth, parent_start, closed, head) of every opener; offsets and columns in code points."""
    found = [(m.start(), m.group()) for m in re.finditer(TOKENS[language] + r"|[{}()\[\];]", text) if m.group() in _OPENS + _CLOSES + ";"]
    if not found:
        return
    places = np.array([p for p, _ in found])
    newlines = np.array([m.start() for m in re.finditer("\n", text)], np.int64)
    last_line = len(newlines) + 1
    line = np.searchsorted(newlines, places) + 1
    starts = np.concatenate([[0], newlines + 1])
    chars = np.array([c for _, c in found])
    # a head begins behind a brace, or behind a semicolon outside parentheses
    round_ = (chars == "(").astype(int) - (chars == ")")
    sums = np.cumsum(round_)
    inside = sums - np.minimum(np.minimum.accumulate(sums), 0) > 0
    ends = places[(chars == "{") | (chars == "}") | ((chars == ";") & ~inside)]
    for o, c in zip(_OPENS, _CLOSES, strict=True):
        mine = np.flatnonzero((chars == o) | (chars == c))
        opener = chars[mine] == o
        partner, depth = match_brackets(opener)
        above = parents(opener, depth)
        for k in np.flatnonzero(opener):
            i, p = mine[k], partner[k]
            start, closed = int(places[i]), p >= 0
            head = ""
            if o == "{":
                e = int(np.searchsorted(ends, start)) - 1
                head = " ".join(text[int(ends[e]) + 1 if e >= 0 else 0 : start].split())
            yield (
                o, start, int(places[mine[p]]) + 1 if closed else len(text), int(line[i]), int(line[mine[p]]) if closed else last_line, start - int(starts[line[i] - 1]),
                int(depth[k]), int(places[mine[above[k]]]) if above[k] >= 0 else None, bool(closed), head,
            )


def _scan(max_bytes: int):
    names = [x.strip().split()[0] for x in SPANS.split(",")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.string()]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                where, text, language = (batch.column(k)[i].as_py() for k in range(3))
                if not text or language not in TOKENS or batch.column(3)[i].as_py() > max_bytes:
                    continue
                rows = [(where, *r) for r in bracket_spans(text, language)]
                for j in range(0, len(rows), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[j : j + 20_000]], kinds[k]) for k in range(len(names))], names)

    return run


def spans(files: DataFrame, max_bytes: int = 5 << 20) -> DataFrame:
    """Every bracket's span in files (file_path, text, language): file_path, bracket, start, stop, line, end_line, col, depth, parent_start, closed, head.

    start and stop are code points, stop behind the closer; parent_start is the opener of the same kind around it; head is the text between the
    last ``;``, ``{`` or ``}`` and a brace, in one line. Null and empty texts, other languages, and files above max_bytes give no rows.
    """
    ship(files.sparkSession)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return files.select(F.col("file_path").cast("string"), F.col("text").cast("string").alias("text"), F.lower("language").alias("language"), size.alias("size")).mapInArrow(_scan(max_bytes), SPANS)


def structure_nodes(files: DataFrame, max_bytes: int = 5 << 20) -> DataFrame:
    """Nodes of bracketed sources: file_path, node_id, t, name, line, col, end_line, depth, parent_start, start, attributes.

    One PROGRAM node for each file, then a node for each brace by its head: CLASS, MODULE, FUNCTION, LAMBDA, IF, LOOP, TRY, CATCH, FINALLY, ASSIGN,
    else BLOCK. A file that is too large keeps its PROGRAM node, whose attributes say ``rejected``; one of another language says ``unsupported``.
    """
    found = spans(files, max_bytes).where("bracket = '{'")
    kind, name = F.lit("BLOCK"), F.lit("")
    for pattern, t, group in reversed(HEADS):
        hit = F.col("head").rlike(pattern)
        kind, name = F.when(hit, t).otherwise(kind), F.when(hit, F.regexp_extract("head", pattern, group) if group else F.lit("")).otherwise(name)
    body = found.select("file_path", kind.alias("t"), name.alias("name"), "line", "col", "end_line", (F.col("depth") + 1).alias("depth"), "parent_start", "start", F.when(F.col("closed"), F.lit("")).otherwise("unclosed").alias("attributes"))
    text, language = F.coalesce(F.col("text"), F.lit("")), F.lower("language")
    state = F.when(F.octet_length(text) > max_bytes, "rejected").when(~F.coalesce(language.isin(*TOKENS), F.lit(False)), "unsupported").otherwise("")
    null = F.lit(None).cast("long")
    top = files.select("file_path", F.lit("PROGRAM").alias("t"), F.lit("").alias("name"), F.lit(1).cast("long").alias("line"), F.lit(0).cast("long").alias("col"), (F.length(F.regexp_replace(text, "[^\n]+", "")) + 1).cast("long").alias("end_line"), F.lit(0).alias("depth"), null.alias("parent_start"), null.alias("start"), state.alias("attributes"))
    return top.unionByName(body).withColumn("node_id", node_id(F.col("file_path"), F.col("line"), F.col("col"), F.col("t")))
