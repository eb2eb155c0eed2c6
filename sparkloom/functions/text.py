"""Scalar text functions as column expressions: sanitizers, limits, identifiers, names, redaction. All JVM-side, none is a UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Characters that sanitizers strip.
BIDI = "‪‫‬‭‮⁦⁧⁨⁩‏‎"
ZERO_WIDTH = "​‌‍‏﻿­"
VALIDATOR_BIDI = BIDI + "﻿"
VALIDATOR_ZERO_WIDTH = "​‌‍⁠﻿"
SPACES_ZS = "               　"

WORD = r"[A-Za-z0-9_]"


def node_id(file: Column, line: Column, col: Column, node_type: Column) -> Column:
    """First 16 hex digits of SHA-256 of file:line:col:type."""
    return F.substring(F.sha2(F.concat_ws(":", file, line.cast("string"), col.cast("string"), node_type), 256), 1, 16)


def edge_id(src: Column, dst: Column, edge_type: Column, arrow: str = ":") -> Column:
    """Of src:dst:type, or with arrow "->" of the parser layer's src->dst:type."""
    return F.substring(F.sha2(F.concat(src, F.lit(arrow), dst, F.lit(":"), edge_type), 256), 1, 16)


def ordered_digest(parts: Column, separator: str = "\n") -> Column:
    """SHA-256 of an aggregated array of strings in sorted order."""
    return F.sha2(F.array_join(F.array_sort(parts), separator), 256)


def strip_chars(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def sanitize_for_model(text: Column, limit: int = 1024) -> Column:
    """Source text made safe for a prompt: invisible and control characters out, comments, strings and large numbers replaced, lines trimmed."""
    t = strip_chars(text, "".join(dict.fromkeys(BIDI + ZERO_WIDTH)))
    for pattern, new in (
        (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""),
        (r"(?s)/\*.*?\*/", " [COMMENT] "),
        (r'(?s)""".*?"""', "[STRING_LITERAL]"),
        (r"(?s)'''.*?'''", "[STRING_LITERAL]"),
        (r'"(?:[^"\\]|\\.)*"', "[STRING_LITERAL]"),
        (r"'(?:[^'\\]|\\.)*'", "[STRING_LITERAL]"),
        (r"`(?:[^`\\]|\\.)*`", "[STRING_LITERAL]"),
        (r"(#|//)[^\n]*", "[COMMENT]"),
        (r"\b[0-9]{5,}\b", "[NUMBER]"),
        (r"[ \t]+", " "),
    ):
        t = F.regexp_replace(t, pattern, new)
    lines = F.filter(F.transform(F.split(t, r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    t = F.array_join(lines, "\n")
    return F.coalesce(F.when(F.length(t) > limit, F.concat(F.left(t, F.lit(limit)), F.lit(" [TRUNCATED]"))).otherwise(t), F.lit(""))


def sanitize_short(text: Column, limit: int = 512) -> Column:
    """NUL and bidi characters out, other control characters to spaces, cut at the limit."""
    t = F.regexp_replace(strip_chars(F.regexp_replace(text, r"\x00", ""), BIDI), r"[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    return F.left(t, F.lit(limit))


def raw_fragment(content: Column, start: Column, stop: Column, limit: int = 2000) -> Column:
    """Bytes [start, stop) of a binary column as text, malformed bytes as U+FFFD, bidi characters out."""
    piece = F.substring(content, start + 1, stop - start).cast("string")
    return F.left(strip_chars(F.make_valid_utf8(piece), BIDI), F.lit(limit))


def assigned_name(text: Column) -> Column:
    """The last identifier left of the first ``=``, type annotation dropped; else empty."""
    left = F.regexp_replace(F.split(text, "=")[0], r"\s*:.*$", "")
    return F.coalesce(F.try_element_at(F.regexp_extract_all(left, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)), F.lit(-1)), F.lit(""))


def member_base(text: Column) -> Column:
    return F.regexp_extract(text, r"([A-Za-z_][A-Za-z0-9_]*)", 1)


def name_variants(name: Column) -> Column:
    """Array of lookup names in order of precedence: as is, lower case, last segment, its lower case; without repeats."""
    last = F.substring_index(name, ".", -1)
    return F.array_distinct(F.array(name, F.lower(name), last, F.lower(last)))


def redact(text: Column) -> Column:
    """Credentials out of URLs, 500 characters at most."""
    return F.left(F.regexp_replace(text, r"(https?://)[^@\s/]+@", "$1[REDACTED]@"), F.lit(500))


def darken(colour: Column, by: int = 40) -> Column:
    """#rrggbb with each channel less by so much, 0 at least."""

    def channel(at: int) -> Column:
        value = F.conv(F.substring(colour, at, 2), 16, 10).cast("int") - by
        return F.lpad(F.lower(F.hex(F.greatest(value, F.lit(0)))), 2, "0")

    return F.concat(F.lit("#"), channel(2), channel(4), channel(6))


def extension(path: Column) -> Column:
    """Lower-cased suffix of the last path part without its dot; empty for none and for names that only start with a dot."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"^.+\.([^.]+)$", 1))


def bound(value: Column, f) -> Column:
    """f of a value that is evaluated once, however often f uses it; keeps generated code small."""
    return F.transform(F.array(value), f)[0]


def any_of(text: Column, words: list[str], where: str) -> Column:
    """Whether text contains, starts or ends with one of the words."""
    tests = {"in": lambda w: text.contains(w), "start": lambda w: text.startswith(w), "end": lambda w: text.endswith(w)}
    return reduce(lambda a, b: a | b, (tests[k](w) for w in words for k in where.split("|")))


def first_match(*rules: tuple[Column, Column | str], otherwise=None) -> Column:
    """CASE over (condition, value) in order."""
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    c = F.when(rules[0][0], value(rules[0][1]))
    for condition, v in rules[1:]:
        c = c.when(condition, value(v))
    return c.otherwise(value(otherwise)) if otherwise is not None else c
