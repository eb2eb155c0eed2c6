"""From text to nodes: lines, regex node extraction, language detection and routing, type normalisation, name extraction, classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dims
from ..functions.text import WORD, bound, extension, first_match, node_id
from .literals import may_match, required

FUNCTION_LINE = r"^(?:async\s+)?(?:def|function|func|fn)\s+[A-Za-z0-9_]+\s*\("
IMPORT_LINE = r"^(?:import|from|#include|use\s|require\s)"
CALL = r"([A-Za-z0-9_]+)\s*\("


def lines(files: DataFrame, path: str = "file_path", text: str = "text") -> DataFrame:
    """file_path, line (from 1), content; one generator over each text, no shuffle."""
    return files.select(F.col(path).alias("file_path"), F.posexplode(F.split(F.col(text), "\n")).alias("p", "content")).select("file_path", (F.col("p") + 1).alias("line"), "content")


def fallback_nodes(files: DataFrame, path: str = "file_path", text: str = "text") -> DataFrame:
    """FUNCTION, CALL and IMPORT nodes by line: node_id, file_path, ord, node_type, line, col, end_col, raw_text.

    Blank lines and lines that start with # give nothing; a FUNCTION line gives nothing else; a CALL's column is its number within the
    line. Line, call and import nodes come from one pass: each line makes an array of nodes that is exploded.
    """
    src = lines(files, path, text).withColumn("s", F.trim(F.regexp_replace("content", r"^\s+|\s+$", ""))).where((F.col("s") != "") & ~F.col("s").startswith("#"))
    kind = "struct<node_type:string,col:int,end_col:int,raw_text:string>"

    def node(node_type: str, col: Column, end: Column, raw: Column) -> Column:
        return F.struct(F.lit(node_type).alias("node_type"), col.cast("int").alias("col"), end.cast("int").alias("end_col"), raw.alias("raw_text"))

    calls = F.transform(F.regexp_extract_all("s", F.lit(CALL), F.lit(1)), lambda x, i: node("CALL", i, i + F.length(x), x))
    none = F.array().cast(f"array<{kind}>")
    imported = F.when(F.col("s").rlike(IMPORT_LINE), F.array(node("IMPORT", F.lit(0), F.length("s"), F.left("s", F.lit(200))))).otherwise(none)
    found = F.when(F.col("s").rlike(FUNCTION_LINE), F.array(node("FUNCTION", F.lit(0), F.length("content"), F.left("s", F.lit(200))))).otherwise(F.concat(calls, imported))
    out = src.select("file_path", "line", F.posexplode(found).alias("ord", "n")).select("file_path", "line", "ord", "n.*")
    return out.withColumn("node_id", node_id(F.col("file_path"), F.col("line"), F.col("col"), F.col("node_type")))


def classify_call(name: Column) -> tuple[Column, Column]:
    """(label, cwe): sinks before sources, else NONE and empty."""
    return tuple(first_match(*((name.rlike(p), label if k == 0 else cwe) for p, label, cwe in dims.CALL_PATTERNS), otherwise="NONE" if k == 0 else "") for k in (0, 1))


def language_by_extension(path: Column, extensions: dict[str, str] = dims.EXTENSIONS) -> Column:
    table = F.create_map(*(F.lit(x) for pair in extensions.items() for x in pair))
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("unknown"))


def detect_language(path: Column, text: Column) -> tuple[Column, Column, Column]:
    """(language, confidence, method): extension 1.0, shebang 0.85, content hints (weight * up to three matches, summed, 1.0 at most), else unknown."""
    by_name = language_by_extension(path, dims.PARSER_EXTENSIONS)
    order: list[str] = list(dict.fromkeys(h[1] for h in dims.CONTENT_HINTS))
    score = lambda language: reduce(lambda a, b: a + b, (F.least(F.regexp_count(text, F.lit(p)), F.lit(3)) * w for p, x, w in dims.CONTENT_HINTS if x == language))
    # of equal scores the language that is listed first
    scores = F.array(*(F.struct(F.round(F.least(F.coalesce(score(x), F.lit(0.0)), F.lit(1.0)), 6).alias("score"), F.lit(-k).alias("place"), F.lit(x).alias("language")) for k, x in enumerate(order)))
    first = F.split(F.coalesce(text, F.lit("")), "\n", 2)[0]
    shebang = lambda x: first_match((~x.startswith("#!"), "unknown"), (x.rlike("python[23]?"), "python"), (x.rlike(r"\bts-node\b"), "typescript"), (x.rlike(r"\bnode\b"), "javascript"), otherwise="unknown")
    seen = F.struct(by_name.alias("named"), bound(first, shebang).alias("banged"), F.array_max(scores).alias("best"))

    def answer(language: Column, confidence: Column, method: str) -> Column:
        return F.struct(language.alias("language"), confidence.alias("confidence"), F.lit(method).alias("method"))

    found = bound(seen, lambda x: first_match(
        (x["named"] != "unknown", answer(x["named"], F.lit(1.0), "extension")), (x["banged"] != "unknown", answer(x["banged"], F.lit(0.85), "shebang")), (x["best"]["score"] > 0, answer(x["best"]["language"], x["best"]["score"], "content")), otherwise=answer(F.lit("unknown"), F.lit(0.0), "none"),
    ))
    return found["language"], found["confidence"], found["method"]


def route_backend(language: Column, available: list[str]) -> Column:
    """The language's primary backend if it is available, else its fallback, else the regex fallback."""
    rules = []
    for name, backends in dims.BACKENDS.items():
        rules += [(language == name, b) for b in backends if b in available][:1]
    return first_match(*rules, otherwise="fallback") if rules else F.lit("fallback")


def route_by_capability(files: DataFrame, capabilities: DataFrame, last: str = "fallback") -> DataFrame:
    """Adds backend: the first available one for a file's language by capabilities (backend, language, available, rank), else ``last``.

    The table says what a session has found out about its backends; an equi join with a dimension. Of equal ranks the lesser name counts.
    """
    able = capabilities.where("available").groupBy("language").agg(F.min(F.struct("rank", "backend")).alias("_b"))
    return files.join(able, "language", "left").withColumn("backend", F.coalesce("_b.backend", F.lit(last))).drop("_b")


def normalize_types(nodes: DataFrame, type_map: DataFrame, guess: bool = True) -> DataFrame:
    """Adds node_type: the map's (language, raw_type), else, with guess, the first keyword group contained, else UNKNOWN.

    The graph layer guesses (``type_map``), the parser layer has a map of its own and does not (``parser_type_map``). An equi join with a
    dimension, which Spark broadcasts as long as it is small.
    """
    rows = type_map.select(F.col("language").alias("_l"), F.col("raw_type").alias("_t"), F.col("node_type").alias("_n"))
    low = F.lower("raw_type")
    rest = first_match(*((low.rlike(words), t) for words, t in dims.TYPE_KEYWORDS), otherwise="UNKNOWN") if guess else F.lit("UNKNOWN")
    j = nodes.join(rows, (F.lower("language") == F.col("_l")) & (F.col("raw_type") == F.col("_t")), "left")
    return j.withColumn("node_type", F.coalesce("_n", rest)).drop("_l", "_t", "_n")


# Function heads by language, one capture each, bounded so that no line takes long; and calls.
_PLAIN = r"^\s{0,8}(?:async\s+)?function\s+([A-Za-z0-9_]+)\s*\("
_ARROW = r"^\s{0,8}(?:export\s+)?(?:const|let|var)\s+([A-Za-z0-9_]+)\s*=\s*(?:async\s+)?\("
FUNCTION_HEADS = {
    "python": [r"^\s{0,8}(?:async\s+)?def\s+([A-Za-z0-9_]+)\s*\("],
    "java": [r"^\s{0,8}(?:(?:public|private|protected|static|final|synchronized|abstract|native)\s+){0,6}[A-Za-z0-9_][A-Za-z0-9_.<>\[\]]{0,64}\s+([A-Za-z0-9_]+)\s*\("],
    "javascript": [_PLAIN, _ARROW],
    "typescript": [_PLAIN, _ARROW],
    "tsx": [_ARROW, _PLAIN],
    "rust": [r"^\s{0,8}(?:pub\s+)?(?:async\s+)?fn\s+([A-Za-z0-9_]+)\s*[<(]"],
    "go": [r"^func\s+(?:\([A-Za-z0-9_]{1,32}\s+\*?[A-Za-z0-9_]{1,64}\)\s+)?([A-Za-z0-9_]+)\s*\("],
    "c": [r"^(?:[A-Za-z0-9_][A-Za-z0-9_\s\*]{0,32})\s+([A-Za-z0-9_]+)\s*\([^;]{0,256}\)\s*\{"],
    "cpp": [r"^(?:[A-Za-z0-9_][A-Za-z0-9_\s\*:<>]{0,48})\s+([A-Za-z0-9_]+)\s*\([^;]{0,256}\)(?:\s*const)?\s*\{"],
    "terraform": [r'^resource\s+"([^"]{1,128})"\s+"[^"]{1,128}"', r'^(?:variable|output|module|provider)\s+"([^"]{1,128})"'],
}
BOUNDED_CALL = r"\b([A-Za-z0-9_.]{1,128})\s*\("


def parser_scan(files: DataFrame, registry: DataFrame, max_text: int = 2000) -> DataFrame:
    """The parser layer's scan without a grammar: PROGRAM of each file, FUNCTION by its language's heads, CALL where the annotator gives a label.

    files: file_path, language, text. A call's column is where its match starts, found as the length of what stands before it. Gives node_id,
    file_path, node_type, name, line, col, end_col, depth, parent_id, raw_text, label, confidence, cwe, pass.
    """
    from .annotate import annotate

    src = files.select("file_path", "language", F.posexplode(F.split("text", "\n")).alias("p", "content")).withColumn("line", F.col("p") + 1)
    head = first_match(*((F.col("language") == x, F.coalesce(*(F.nullif(F.regexp_extract("content", p, 1), F.lit("")) for p in patterns))) for x, patterns in FUNCTION_HEADS.items()), otherwise=F.lit(None).cast("string"))
    functions = src.withColumn("name", head).where("name is not null").select("file_path", "language", "line", F.lit(0).alias("col"), F.length("content").alias("end_col"), F.lit("FUNCTION").alias("node_type"), "name", "content")
    # each match is found from the end of the one before it on
    place = """aggregate(calls, named_struct('out', cast(array() as array<struct<m:string,at:int>>), 'next', 1), (acc, m) -> named_struct(
        'out', concat(acc.out, array(named_struct('m', m, 'at', locate(m, content, acc.next)))), 'next', locate(m, content, acc.next) + length(m)), acc -> acc.out)"""
    called = src.where(~((F.col("language") == "python") & F.col("content").rlike(r"^\s{0,8}#"))).withColumn("calls", F.regexp_extract_all("content", F.lit(rf"({BOUNDED_CALL})"), F.lit(1)))
    calls = called.select("file_path", "language", "line", "content", F.explode(F.expr(place)).alias("c")).select(
        "file_path", "language", "line", (F.col("c.at") - 1).alias("col"), (F.col("c.at") - 1 + F.length("c.m")).alias("end_col"), F.lit("CALL").alias("node_type"), F.regexp_extract("c.m", r"^([A-Za-z0-9_.]+)", 1).alias("name"), "content"
    ).where(F.length("name") >= 2)
    program = files.select("file_path", "language", F.lit(0).alias("line"), F.lit(0).alias("col"), F.lit(0).alias("end_col"), F.lit("PROGRAM").alias("node_type"), F.col("file_path").alias("name"), F.col("text").alias("content"))
    every = program.unionByName(functions).unionByName(calls).withColumns({
        "node_id": node_id(F.col("file_path"), F.col("line"), F.col("col"), F.col("node_type")), "raw_text": F.left("content", F.lit(max_text)),
        "depth": first_match((F.col("node_type") == "PROGRAM", F.lit(0)), (F.col("node_type") == "FUNCTION", F.lit(1)), otherwise=F.lit(2)),
        "parent_id": F.when(F.col("node_type") != "PROGRAM", node_id(F.col("file_path"), F.lit(0), F.lit(0), F.lit("PROGRAM"))),
    }).drop("content")
    return annotate(every, registry).where("node_type <> 'CALL' or label <> 'NONE'")


def catalog_hits(nodes: DataFrame, catalog: DataFrame) -> DataFrame:
    """node_id, vuln_type, cwe, severity for each node and row of the catalog of its language whose node types and pattern it meets and none of whose sanitizers it holds.

    nodes: node_id, language, node_type, raw_text. A pattern is met by its expression, or by one of its keywords where the catalog has them. The
    catalog is a dimension: an equi join on the language, which Spark broadcasts while it is small.
    """
    words = F.col("keywords") if "keywords" in catalog.columns else F.array().cast("array<string>")
    rows = catalog.select("vuln_type", "cwe", "severity", F.col("language").alias("_l"), F.split("node_types", ",").alias("_types"), "pattern", words.alias("_words"), F.filter(F.split("sanitizers", ","), lambda x: x != "").alias("_safe"))
    met = F.expr("regexp_like(raw_text, pattern)") | F.exists("_words", lambda x: F.col("raw_text").contains(x))
    hit = nodes.join(rows, F.col("language") == F.col("_l")).where(F.array_contains("_types", F.col("node_type"))).where(met).where(~F.exists("_safe", lambda x: F.col("raw_text").contains(x)))
    return hit.select("node_id", "vuln_type", "cwe", "severity")


def to_graph_schema(parsed: DataFrame) -> DataFrame:
    """The graph layer's columns from the parser layer's nodes; what a parser doesn't give is empty, 0 or, for the type, UNKNOWN."""
    have = set(parsed.columns)

    def take(name: str, default, kind: str) -> Column:
        return (F.coalesce(F.col(name).cast(kind), F.lit(default).cast(kind)) if name in have else F.lit(default).cast(kind)).alias(name)

    first = parsed.withColumnRenamed("line", "start_line") if "line" in have and "start_line" not in have else parsed
    have = set(first.columns)
    columns = [take(*c) for c in (("node_id", "", "string"), ("node_type", "UNKNOWN", "string"), ("language", "unknown", "string"), ("file_path", "", "string"), ("start_line", 0, "int"), ("end_line", 0, "int"), ("start_col", 0, "int"), ("end_col", 0, "int"), ("raw_text", "", "string"), ("normalized_text", "", "string"))]
    return first.select(*columns, (F.coalesce("parent_id", F.lit("")) if "parent_id" in have else F.lit("")).alias("parent_function"))


def of_types(nodes: DataFrame, *types: str) -> DataFrame:
    """Nodes of these types; the filter reaches the scan."""
    return nodes.where(F.col("node_type").isin(list(types)))


def labelled(nodes: DataFrame, label: str, least: float = 0.0) -> DataFrame:
    """Nodes of a label, for one of SOURCE, SINK, SANITIZER, SENSITIVE, of some confidence."""
    return nodes.where((F.col("label") == label) & (F.col("confidence") >= least))


def extract_name(node_type: Column, raw: Column) -> Column:
    """A node's name by its type: what is called, defined, imported, assigned, or the first identifier."""
    ident = r"([A-Za-z_][A-Za-z0-9_]*)"
    return first_match(
        (node_type == "FUNCTION", F.regexp_extract(raw, r"(?:def|function|func|fn)\s+" + ident, 1)),
        (node_type == "CLASS", F.regexp_extract(raw, r"(?:class|struct|interface|trait)\s+" + ident, 1)),
        (node_type == "CALL", F.regexp_extract(raw, r"^([A-Za-z0-9_.]+)", 1)),
        (node_type == "IMPORT", F.regexp_extract(raw, r"(?:import|from|include|use|require)\s+[\"'<(]*([A-Za-z0-9_./:]+)", 1)),
        (node_type == "ASSIGN", F.trim(F.substring_index(raw, "=", 1))),
        (node_type.isin("CONFIG_KEY", "BLOCK"), F.trim(F.substring_index(raw, ":", 1))),
        otherwise=F.regexp_extract(raw, ident, 1),
    )


def extract_value(node_type: Column, raw: Column) -> Column:
    """A literal's text, or what follows the first ``=``; else null."""
    return F.when(node_type == "LITERAL", raw).when(node_type.isin("ASSIGN", "AUGMENTED_ASSIGN") & raw.contains("="), F.trim(F.regexp_extract(raw, r"(?s)=(.*)$", 1)))


# Where the parser layer finds names of functions and classes, by language; the first pattern that is found gives it.
FUNCTION_NAMES = {
    "python": [r"def\s+(\w+)\s*\(", r"async\s+def\s+(\w+)\s*\("],
    "java": [r"(?:public|private|protected|static|\s)+\s+\w+\s+(\w+)\s*\("],
    "javascript": [r"function\s+(\w+)\s*\(", r"(?:const|let|var)\s+(\w+)\s*="],
    "typescript": [r"function\s+(\w+)\s*\(", r"(?:const|let|var)\s+(\w+)\s*="],
    "tsx": [r"function\s+(\w+)\s*\(", r"(?:const|let|var)\s+(\w+)\s*="],
    "rust": [r"fn\s+(\w+)\s*[<\(]"],
    "go": [r"func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\s*\("],
    "c": [r"\b(\w+)\s*\([^)]*\)\s*\{"],
    "cpp": [r"(?:\w+::)?(\w+)\s*\([^)]*\)\s*(?:const)?\s*\{"],
}
CLASS_NAMES = {
    "python": [r"class\s+(\w+)"],
    "java": [r"(?:class|interface|enum)\s+(\w+)"],
    "javascript": [r"class\s+(\w+)"],
    "rust": [r"(?:struct|impl|trait|enum)\s+(\w+)"],
    "go": [r"type\s+(\w+)"],
}
ASSIGNED = r"^\s*([\w.]+)\s*(?::\s*\w+\s*)?(?:\+|-|\*|/|%|&|\||\^|<<|>>)?="
HCL_HEAD = r'^(?:resource|provider|variable|data|module)\s+"([^"]+)"\s*(?:"([^"]+)")?'


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group's text, null where there is none; words are Unicode words."""
    return F.nullif(F.regexp_extract(text, f"(?U){pattern}", group), F.lit(""))


def parser_name(node_type: Column, raw: Column, language: Column) -> Column:
    """A node's name in the parser layer, by type and language; null where a type has none or its text doesn't show it."""
    text = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")

    def of(tables: dict[str, list[str]]) -> Column:
        return first_match(*((F.lower(language) == k, F.coalesce(*(_found(raw, p) for p in patterns))) for k, patterns in tables.items()))

    dotted = _found(text, r"^([\w.]+)")
    called = F.coalesce(_found(text, r"^([\w.]+)\s*\("), F.when(dotted.contains(".") | dotted.rlike(r"(?U)^[^\W\d]\w*$"), dotted))
    return first_match(
        (node_type == "FUNCTION", of(FUNCTION_NAMES)),
        (node_type == "CLASS", of(CLASS_NAMES)),
        (node_type == "CALL", called),
        (node_type.isin("IDENTIFIER", "IMPORT", "ATTRIBUTE"), text),
        (node_type.isin("ASSIGN", "AUGMENTED_ASSIGN"), _found(raw, ASSIGNED)),
        (node_type.isin("RESOURCE", "PROVIDER", "VARIABLE"), F.nullif(F.concat_ws(".", _found(raw, HCL_HEAD), _found(raw, HCL_HEAD, 2)), F.lit(""))),
        (node_type == "CONFIG_KEY", F.regexp_replace(F.regexp_replace(F.substring_index(raw, "=", 1), r"(?U)^\s+|\s+$", ""), '^"+|"+$', "")),
    )


def parser_value(node_type: Column, raw: Column) -> Column:
    """A node's value in the parser layer: a literal's text, and of a configuration value what follows the first ``=``, or all of it."""
    trim = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    return F.when(node_type == "LITERAL", trim(raw)).when(node_type == "CONFIG_VALUE", trim(F.regexp_replace(raw, r"^[^=]*=", "")))


def token_sequence(nodes: DataFrame, limit: int = 512) -> DataFrame:
    """file_path, pos (from 0), token, node_id: the first four words of each node in order, or one sentinel; the first ``limit`` of each file.

    Nodes come with file_path, ord, node_id, raw_text. The running count over nodes needs a file's nodes sorted, not its tokens.
    """
    from pyspark.sql import Window

    words = F.filter(F.split(F.coalesce("raw_text", F.lit("")), r"[ \t\r\n]+"), lambda w: w != "")
    with_words = nodes.withColumn("w", F.when(F.size(words) > 0, F.slice(words, 1, 4)).otherwise(F.array(F.lit("[EMPTY]"))))
    before = F.coalesce(F.sum(F.size("w")).over(Window.partitionBy("file_path").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = with_words.withColumn("before", before).where(F.col("before") < limit)
    return placed.select("file_path", "node_id", "before", F.posexplode("w").alias("i", "token")).select("file_path", (F.col("before") + F.col("i")).cast("long").alias("pos"), "token", "node_id").where(F.col("pos") < limit)


def pattern_hits(files: DataFrame, catalog: DataFrame, path: str = "file_path", text: str = "text", language: str | None = None) -> DataFrame:
    """file_path, line, vuln_type, cwe, severity for each line and catalog row whose pattern is found in it.

    The catalog is a dimension of tens of rows: it is collected into one expression. A text is first searched for the words that the
    patterns require; only texts that hold one are cut into lines, and a line meets the expressions of which it holds a word. With the
    name of a language column, a file meets the patterns of its own language only. A pattern that requires no word meets every line.
    """
    rows = catalog.select("language", "vuln_type", "cwe", "severity", "pattern").orderBy("language", "vuln_type", "pattern").collect()
    words = [required(r["pattern"]) for r in rows]
    every = sorted(set().union(*(w or () for w in words)))
    low = F.lower(F.col(text))
    kept = files
    if all(words) and every:
        # a word that holds another is not looked for
        kept = files.where(reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in every if not any(x != w and x in w for x in every))))
    extra = [language] if language else []
    split = kept.select(F.col(path).alias("file_path"), *extra, F.posexplode(F.split(F.col(text), "\n")).alias("p", "content")).select("file_path", *extra, (F.col("p") + 1).alias("line"), "content", F.lower("content").alias("_low"))
    if all(words) and every:
        split = split.where(reduce(lambda a, b: a | b, (F.contains("_low", F.lit(w)) for w in every if not any(x != w and x in w for x in every))))

    def test(r) -> Column:
        found = may_match(F.col("_low"), r["pattern"]) & F.col("content").rlike(r["pattern"])
        return (F.col(language) == r["language"]) & found if language else found

    hit = F.array_compact(F.array(*(F.when(test(r), F.struct(*(F.lit(r[c]).alias(c) for c in ("vuln_type", "cwe", "severity")))) for r in rows)))
    return split.select("file_path", "line", F.explode(hit).alias("h")).select("file_path", "line", "h.*")


__all__ = ["WORD", "catalog_hits", "classify_call", "detect_language", "extract_name", "extract_value", "fallback_nodes", "labelled", "language_by_extension", "lines", "normalize_types", "of_types", "parser_name", "parser_scan", "parser_value", "pattern_hits", "route_backend", "route_by_capability", "to_graph_schema", "token_sequence"]
