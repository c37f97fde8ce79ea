import random
import re

import pytest
from pyspark.sql import functions as F

from litsift.functions import text as T
from litsift.operators import screening

PATTERNS = [
    "a{,2}", "[[(]", r"(?a:\w+)", "(a)?b(?(1)c|d)", "[a&&b]", r"(?P<a_b>x)(?P<ab>y)(?P=a_b)", r"[]a]", r"[^]a]+", r"[\b]", r"a++b", r"(?#no)ab", "(?x) a b", r"\x41\u00e9", r"\bthe\b", r".$", r"^b", "a.b", r"\d+(?=%)", r"(?<!n)ot",
    r"a|é", "x*", r"[a-c[]", r"\v", r"\Aab", r"b\Z", r"((a)(b))\3", "(?s:a.b)", "{", "a{1,2}?", r"\N{LATIN SMALL LETTER A}", r"[\w.]+@\w+", "ß", "k", "(?:ab)+",
]
TEXTS = ["aab bc bd a&b [x(y) xyx XYX ]", "The other THE\nend b", "a\rb a\u2028b a\nb ab%12%", "é É K ſ ß ẞ not ot", "", None, "  ", "bab\n", "\x08\x0b{ a{,2}", "me.you@site A\u00e9"]


def counted(p, t):
    return len(list(re.finditer(p, t, re.IGNORECASE))) if t and t.strip() else 0


def test_every_pattern_counts_as_in_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")
    got = df.select("id", *(T.count_matches("t", p).alias(f"c{i}") for i, p in enumerate(PATTERNS))).collect()
    for r in got:
        assert {p: r[f"c{i}"] for i, p in enumerate(PATTERNS)} == {p: counted(p, TEXTS[r["id"]]) for p in PATTERNS}
    native = [p for p in PATTERNS if T.java(p)]
    assert {r"\bthe\b", ".$", "a.b", "(?:ab)+", r"(?P<a_b>x)(?P<ab>y)(?P=a_b)"} <= set(native) and not {"[a&&b]", "a{,2}", "(?a:\\w+)"} & set(native)


def test_evidence_and_flags_of_patterns_that_java_lacks(spark):
    df = spark.createDataFrame([(0, "One a&b here. None there! a&b again.  One a&b here. "), (1, None), (2, "b")], "id long, t string")
    rows = df.orderBy("id").select(T.sentence_evidence("t", "[a&&b]&", "t").alias("x"), T.sentence_evidence("t", "[&]b", "t").alias("y")).collect()
    assert [[(e["text"], e["matched_term"]) for e in r["x"]] for r in rows] == [[("One a&b here", "a&"), ("a&b again", "a&")], [], []]
    assert [[e["text"] for e in r["y"]] for r in rows] == [[e["text"] for e in r["x"]] for r in rows]
    flags = screening.criteria_flags(df, "t", {"p": "[a&&b]", "q": "one"}).orderBy("id").collect()
    assert [(r["p"], r["q"], r["meets_all_criteria"]) for r in flags] == [(1, 1, 1), (0, 0, 0), (1, 0, 0)]
    with pytest.raises(re.error):
        T.sentence_evidence("t", "(", "t")


def test_required_literals():
    of = screening.required_literals
    assert of(r"\brandom(?:ised|ized)\b") in (frozenset({"random"}), frozenset({"randomi"})) and of("abc|def?") == {"abc", "de"}
    assert of("a.b") is None and of("(?:cat)*") is None and of("ab(?=cd)") == {"ab"} and of("é+long") == {"long"} and of("(?i)XYZ+") == {"xy"}


def test_many_criteria_equal_the_plain_flags(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdekis", k=rng.randint(2, 6))) for _ in range(300)]
    patterns = {f"p{i}": rng.choice([r"\b{}\b", "{}|{}", "{}.?{}", "(?:{})+x*", "x*", "[{}]"]).replace("{}", "%s") for i in range(200)}
    patterns = {k: p.replace("%s", "{}").format(*rng.sample(words, p.count("%s"))) for k, p in patterns.items()}
    texts = [" ".join(rng.choices(words, k=40)).replace("k", rng.choice("kK\u212a")).replace("s", rng.choice("sS\u017f")).replace("i", rng.choice("iI\u0130\u0131")) for _ in range(40)] + [None, "", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = screening.screen_many(df, "t", patterns)
    assert got.columns == ["id", "t", *patterns, "meets_all_criteria"]
    for r in got.collect():
        t = texts[r["id"]] or ""
        assert {k: r[k] for k in patterns} == {k: int(re.search(p, t, re.I) is not None) for k, p in patterns.items()}
    assert screening.screen_many(df, "t", {}).where(F.col("meets_all_criteria") == 1).count() == len(texts)
