"""Screening by criteria: flags, evidence and semantic scores in one lazy projection."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsift.functions import text as T

Encoder = Callable[[list[str]], np.ndarray]
SCORE = "struct<individual_scores:array<double>,mean_score:double,max_score:double,count:int>"
FIELDS = ("abstract", "keywords", "title")


def hashed_encoder(texts: list[str], size: int = 256) -> np.ndarray:
    """The offline default: word counts hashed to a fixed number of places."""
    from zlib import crc32

    out = np.zeros((len(texts), size))
    for row, t in zip(out, texts, strict=True):
        for word in t.lower().split():
            row[crc32(word.encode()) % size] += 1
    return out


def semantic_scores(evidence: Column, description: str, encoder: Encoder = hashed_encoder) -> Column:
    """Cosine of each piece of evidence with the criterion; zeros without evidence. The criterion is encoded once a batch."""

    @F.pandas_udf(SCORE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        goal = np.asarray(encoder([description]))[0]
        for rows in batches:
            lists = [[] if r is None else list(r) for r in rows]
            flat = [t for r in lists for t in r]
            x = np.asarray(encoder(flat)) if flat else np.zeros((0, len(goal)))
            norm = np.linalg.norm(x, axis=1) * np.linalg.norm(goal)
            cosine = np.divide(x @ goal, norm, out=np.zeros(len(x)), where=norm > 0)
            parts = np.split(cosine, np.cumsum([len(r) for r in lists])[:-1]) if lists else []
            yield pd.DataFrame({"individual_scores": [p.tolist() for p in parts], "mean_score": [float(p.mean()) if len(p) else 0.0 for p in parts], "max_score": [float(p.max()) if len(p) else 0.0 for p in parts], "count": [len(p) for p in parts]})

    return run(F.transform(evidence, lambda e: e["text"]))


def regex_screen(df: DataFrame, criteria: dict[str, dict], fields: list[str] | None = None, unit: str = "sentence", window_size: int = 5, encoder: Encoder | None = hashed_encoder) -> DataFrame:
    """The input's other columns, five columns a criterion (flag, _evidence, _semantic_scores, _semantic_mean, _semantic_max), and meets_all_criteria.

    criteria: name to {"pattern", "description"}, or a list of patterns. Fields that the table lacks are left out. Without
    an encoder score columns are null. With no criterion every row meets all.
    """
    if not isinstance(criteria, dict):
        criteria = {f"criterion_{i + 1}": {"pattern": p, "description": p} for i, p in enumerate(criteria)}
    used = [f for f in fields or FIELDS if f in df.columns]
    found = df.withColumns({f"_ev_{c}": T.all_evidence(used, spec["pattern"], unit, window_size) for c, spec in criteria.items()})
    if encoder is not None:
        found = found.withColumns({f"_sc_{c}": semantic_scores(F.col(f"_ev_{c}"), spec.get("description", spec["pattern"]), encoder) for c, spec in criteria.items()})
    made: dict[str, Column] = {}
    for c in criteria:
        score = F.col(f"_sc_{c}") if encoder is not None else F.lit(None).cast(SCORE)
        made |= {
            c: (F.size(f"_ev_{c}") > 0).cast("int"), f"{c}_evidence": T.evidence_display(F.col(f"_ev_{c}")), f"{c}_semantic_scores": score["individual_scores"],
            f"{c}_semantic_mean": score["mean_score"], f"{c}_semantic_max": score["max_score"],
        }
    meets = reduce(lambda a, b: a & b, [F.size(f"_ev_{c}") > 0 for c in criteria], F.lit(True)).cast("int")
    other = [c for c in df.columns if c not in made and c != "meets_all_criteria"]
    return found.select(*other, *(v.alias(k) for k, v in made.items()), meets.alias("meets_all_criteria"))


def screening_summary(screened: DataFrame, criteria: list[str]) -> DataFrame:
    """One row a criterion, and one for all together: matched and percent (0 for an empty table)."""
    names = [*criteria, "meets_all_criteria"]
    sums = screened.agg(F.count("*").alias("_n"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names))
    long = sums.unpivot(["_n"], list(names), "criterion", "matched")
    return long.select("criterion", "matched", F.when(F.col("_n") > 0, 100 * F.col("matched") / F.col("_n")).otherwise(F.lit(0.0)).alias("percent"))


def criteria_flags(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Only 0/1 flags over one text column, without evidence: stays in generated code where Java has the patterns."""
    flags = {c: T.matches(text, p).cast("int") for c, p in patterns.items()}
    meets = reduce(lambda a, b: a & b, [f == 1 for f in flags.values()], F.lit(True)).cast("int")
    return df.withColumns(flags | {"meets_all_criteria": meets})


#: Letters beside A-Z that a pattern without case takes for one of a-z.
FOLDED = str.maketrans({"\u017f": "s", "\u0131": "i", "\u0130": "i", "\u212a": "k"})


def required_literals(pattern: str) -> frozenset[str] | None:
    """Texts in lower case, one of which is in every match; None where no such set is found. Only ASCII, of two letters or more."""

    def of(parts) -> list[frozenset[str]]:
        """Sets of which a match needs one text each."""
        out, run = [], ""
        for kind, value in [*parts, (None, None)]:
            name = str(kind)
            if name == "LITERAL" and value < 128:
                run += chr(value).lower()
                continue
            if len(run) > 1:
                out.append(frozenset([run]))
            run = ""
            if name == "SUBPATTERN":
                out += of(value[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                out += of(value[2])
            elif name == "BRANCH":
                each = [of(b) for b in value[1]]
                if all(each):
                    out.append(frozenset().union(*(best(e) for e in each)))
        return out

    def best(sets: list[frozenset[str]]) -> frozenset[str]:
        """The set whose shortest text is longest."""
        return max(sets, key=lambda s: (min(map(len, s)), -len(s)))

    found = of(re._parser.parse(pattern, re.IGNORECASE))
    return best(found) if found else None


def screen_many(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """criteria_flags() for hundreds of patterns: one scan of a text by an automaton over the literals that matches need tells which patterns to try.

    Patterns without such a literal are always tried. The rows are those of criteria_flags().
    """
    import ahocorasick

    names = list(patterns)
    literals = [required_literals(p) for p in patterns.values()]
    always = [i for i, x in enumerate(literals) if x is None]
    of: dict[str, list[int]] = {}
    for i, x in enumerate(literals):
        for t in x or ():
            of.setdefault(t, []).append(i)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = [re.compile(p, re.IGNORECASE) for p in patterns.values()]
        automaton = ahocorasick.Automaton()
        for t, which in of.items():
            automaton.add_word(t, tuple(which))
        if of:
            automaton.make_automaton()
        for texts in batches:
            out = []
            for t in texts:
                asked = {i for _, which in automaton.iter(t.translate(FOLDED).lower()) for i in which} if of else set()
                out.append(sorted(i for i in (*always, *asked) if compiled[i].search(t)))
            yield pd.Series(out, dtype=object)

    found = df.withColumn("_found", run(T.text_or_empty(text)))
    flags = {c: F.array_contains("_found", i).cast("int") for i, c in enumerate(names)}
    return found.withColumns(flags | {"meets_all_criteria": (F.size("_found") == len(names)).cast("int")}).drop("_found")
