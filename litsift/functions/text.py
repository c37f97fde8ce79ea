"""Regular-expression evidence, counts and snippets as column expressions.

Patterns are Python regular expressions, matched without case and with Unicode classes. Counts and sentence evidence are
native expressions where Java has the same pattern; other patterns, window evidence and snippets run Python's re over Arrow
batches. A null or blank text has no evidence, a count of 0 and an empty snippet.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

EVIDENCE = "array<struct<text:string,field:string,matched_term:string>>"


#: What Python and Java read differently, or only one of them reads: flags in a group, conditionals, comments, vertical
#: white space, and escapes of classes in a class.
UNLIKE = re.compile(r"\(\?(?![:=!>]|<[=!]|P[<=])|\\v|\\[0-9]{2}")


def nested_class(pattern: str) -> bool:
    """Whether a character class holds [ or && or an escaped b, which Java reads in another way."""
    within, i = False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if within and pattern[i + 1 : i + 2] == "b":
                return True
            i += 2
            continue
        if within:
            if c == "[" or pattern.startswith("&&", i):
                return True
            within = c != "]"
        elif c == "[":
            within = True
            i += 1 + pattern.startswith("^", i + 1)
            if pattern.startswith("]", i):  # a plain ] in Python
                return True
            continue
        i += 1
    return False


def java(pattern: str) -> str | None:
    """The pattern in Java's dialect, None where Java has no such pattern; a malformed one raises re.error."""
    groups = re.compile(pattern, re.IGNORECASE).groupindex
    if UNLIKE.search(pattern) or nested_class(pattern) or any(c.casefold() != c.lower() for c in pattern):  # letters such as sharp s have pairs of their own in each
        return None
    out = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<g{groups[m[1]]}>", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\k<g{groups[m[1]]}>", out)
    out = "(?iUd)" + out.replace("\\Z", "\\z")
    context = SparkContext._active_spark_context
    if context is None:
        return None
    try:
        context._jvm.java.util.regex.Pattern.compile(out)
    except (Py4JJavaError, IllegalArgumentException):
        return None
    return out


def by_python(text: Column, kind: str, of: Callable[[re.Pattern, str], Any], pattern: str) -> Column:
    """of(pattern, text) for each text that isn't null, in Arrow batches."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = re.compile(pattern, re.IGNORECASE)
        for texts in batches:
            yield texts.map(lambda t: of(found, t))

    return run(text)


def matches(text: Column | str, pattern: str) -> Column:
    """Whether a text has a match; a null text counts as empty."""
    text, p = text_or_empty(text), java(pattern)
    return text.rlike(p) if p else by_python(text, "boolean", lambda found, t: found.search(t) is not None, pattern)


def text_or_empty(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def blank(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " ")) == ""


def count_matches(text: Column | str, pattern: str) -> Column:
    """Matches that don't overlap; 0 for a malformed pattern."""
    try:
        p = java(pattern)
    except re.error:
        return F.lit(0)
    text = text_or_empty(text)
    count = F.regexp_count(text, F.lit(p)) if p else by_python(text, "int", lambda found, t: sum(1 for _ in found.finditer(t)), pattern)
    return F.when(blank(text), F.lit(0)).otherwise(count)


def sentences(text: Column | str) -> Column:
    """Parts between sentence ends, trimmed; the ends themselves are left out but for the last."""
    return F.transform(F.split(text_or_empty(text), "(?U)[.!?]+\\s+", -1), lambda s: F.regexp_replace(s, "(?U)^\\s+|\\s+$", ""))


def sentence_evidence(text: Column | str, pattern: str, field: str) -> Column:
    """Each distinct sentence with a match, and its first match."""
    p = java(pattern)
    if p is None:
        return python_evidence(text_or_empty(text), pattern, field)
    hits = F.array_distinct(F.filter(sentences(text), lambda s: (s != "") & s.rlike(p)))
    return F.transform(hits, lambda s: F.struct(s.alias("text"), F.lit(field).alias("field"), F.regexp_extract(s, p, 0).alias("matched_term")))


def python_evidence(text: Column, pattern: str, field: str) -> Column:
    """sentence_evidence by Python's re."""

    def of(found: re.Pattern, t: str) -> list[dict]:
        parts = dict.fromkeys(p.strip() for p in re.split(r"[.!?]+\s+", t))
        return [{"text": p, "field": field, "matched_term": m[0]} for p in parts if p and (m := found.search(p))]

    return by_python(text, EVIDENCE, of, pattern)


def window_evidence(text: Column | str, pattern: str, field: str, window_size: int = 5) -> Column:
    """Each match with up to window_size words on either side, once per distinct text; 0 keeps all words before it."""
    found = re.compile(pattern, re.IGNORECASE)

    def around(t: str | None) -> list[dict]:
        out: dict[str, dict] = {}
        starts: list[int] = []
        ends: list[int] = []
        for m in found.finditer(t) if t and t.strip() else ():
            if not starts:  # where the words are, once a text
                spans = [w.span() for w in re.finditer(r"\S+", t)]
                starts, ends = [a for a, _ in spans], [b for _, b in spans]
            i, j = bisect_left(starts, m.start()), bisect_right(ends, m.end())
            before = [t[starts[k] : min(ends[k], m.start())] for k in range(max(0, i - window_size) if window_size else 0, i)]
            after = [t[max(starts[k], m.end()) : ends[k]] for k in range(j, min(len(ends), j + window_size))]
            whole = " ".join([*before, m[0], *after])
            out.setdefault(whole, {"text": whole, "field": field, "matched_term": m[0]})
        return list(out.values())

    @F.pandas_udf(EVIDENCE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(around, na_action=None)

    return run(F.col(text) if isinstance(text, str) else text)


def snippets(text: Column | str, pattern: str, max_length: int = 200, around: int = 20, most: int = 3) -> Column:
    """The first matches with some characters on either side, joined and cut to max_length; '' for a malformed pattern."""
    try:
        found = re.compile(pattern, re.IGNORECASE)
    except re.error:
        return F.lit("")

    def shown(t: str | None) -> str:
        if not t or not t.strip():
            return ""
        parts = []
        for m in found.finditer(t):
            parts.append(f"...{t[max(0, m.start() - around) : m.end() + around].strip()}...")
            if len(parts) == most:
                break
        return " | ".join(parts)[:max_length]

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(shown, na_action=None)

    return run(F.col(text) if isinstance(text, str) else text)


def all_evidence(fields: list[str], pattern: str, unit: str = "sentence", window_size: int = 5) -> Column:
    """Evidence of all fields in their order; any unit but 'window' means sentences."""
    each = [window_evidence(f, pattern, f, window_size) if unit == "window" else sentence_evidence(f, pattern, f) for f in fields]
    return F.concat(*each) if each else F.array().cast(EVIDENCE)


def evidence_display(evidence: Column) -> Column:
    return F.array_join(F.transform(evidence, lambda e: F.concat(e["field"], F.lit(": "), e["text"])), "; ")


def combined_text(columns: list[str]) -> Column:
    """For sampling: fields joined by one space, null as an empty field."""
    return F.concat_ws(" ", *(text_or_empty(c) for c in columns))


def model_text(columns: list[str], sep: str = " ") -> Column:
    """For modelling: fields joined by the separator between spaces, null as the text nan."""
    return F.concat_ws(f" {sep} ", *(F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns))


def tokens(text: Column | str, max_length: int) -> Column:
    """The first max_length words, for models; a null text has none."""
    return F.slice(F.filter(F.split(text_or_empty(text), "(?U)\\s+", -1), lambda w: w != ""), 1, max_length)
