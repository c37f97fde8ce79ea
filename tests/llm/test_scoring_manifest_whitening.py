import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from litsift.llm import bpe, lm, merkle, packing, quality, queries, whitening

NAMES = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def plain_tree(nodes):
    """The root, and each leaf's (place, run) level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, i in enumerate(at):
            paths[k].append((i % 16, level[i // 16 * 16 : i // 16 * 16 + 16]))
        at = [i // 16 for i in at]
        level = [sha("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
    return level[0], paths


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[4])))
        built[s] = own, *plain_tree([leaf_of(r, r[4]) for r in own])
    root, over = plain_tree([built[s][1] for s in order])
    out = []
    for s, top in zip(order, over, strict=True):
        own, subroot, paths = built[s]
        for r, path in zip(own, paths, strict=True):
            path, text = path + top, r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            h = leaf_of(r, text)
            for k, run in path:
                h = sha("".join([*run[:k], h, *run[k + 1 :]]))
            out.append((r[0], leaf_of(r, r[4]), subroot, root, sha("".join(x for k, run in path for j, x in enumerate(run) if j != k)), h, h == root))
    return sorted(out, key=str)


def manifest_of(spark, rows):
    return sorted((tuple(r) for r in merkle.tampered(spark.createDataFrame(rows, NAMES).withColumns({c: F.lit("mine") for c in ("g", "leaf", "at", "part", "row", "path", "k")})).collect()), key=str)


@pytest.mark.parametrize("size", [7, 1000])
def test_merkle_against_brute_force(spark, monkeypatch, size):
    """A source over many partitions and 4,096 leaves, lone leaves, runs of one, nulls, ids and rows that repeat."""
    monkeypatch.setattr(merkle, "ROWS", size)
    rng = random.Random(size)
    rows = [(i, "big" if i % 3 else rng.choice([None, "", "ä", "b:1", "c"]), rng.choice(["en", None]), rng.choice([None, i]), rng.choice(["Text É A", "", None, "lower"])) for i in range(600 if size == 7 else 7000)]
    rows += [(None, "big", None, None, None)] * 3 + [(5, "big", "en", 1, "Same")] * 40 + [(5, "big", "en", 1, "other"), (9, "lone", "en", 2, "X" * 50_000)] + [(i, f"s{i:03}", None, 0, "T") for i in range(300)]
    got = manifest_of(spark, rows)
    assert got == plain_manifest(rows) and not all(r[-1] for r in got)


def test_merkle_small_tables(spark):
    one = [(1, None, None, None, "Abc")]
    assert manifest_of(spark, one) == plain_manifest(one)
    assert manifest_of(spark, []) == []
    for n in (16, 17, 257):
        rows = [(i, "s", "l", i, "T") for i in range(n)]
        assert manifest_of(spark, rows) == plain_manifest(rows)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"x": F.lit("mine"), "i": F.lit(1), "n": F.lit(2), "label": F.lit(0)})


def plain_whitening(rows, dims):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] + [1_000_000] * (dims - len(v)) for _, v in good], dtype=object)
    n, s = len(x), x.sum(axis=0)
    top = x * n - s
    c = top.astype(np.longdouble) / n
    v = c.T @ c / n
    e, p = np.linalg.eigh(v.astype(float))
    return [i for i, _ in good], n, (top**2).sum(axis=1), c, e[::-1], p[:, ::-1], v


def test_whitening_against_plain_form(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(6, 6)) * np.array([30, 10, 3, 1, 0.3, 0.1])
    rows = [(int(i), (rng.normal(size=6) @ mix.T + 5000).tolist()) for i in range(500)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (900, [1.0, 2.0]), (901, []), (902, None), (903, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (904, [float("nan")] * 6), (905, [float("inf")] * 6)]
    ids, n, deviation, c, e, p, v = plain_whitening(rows, 6)
    for parts in (1, 4):
        got = whitening.whiten(vectors(spark, rows).repartition(parts)).toPandas()
        assert len(got) == n * 6 and set(got["n"]) == {n} and got["vec_id"].isna().sum() == 6
        w = np.asarray(c, dtype=float) @ p / np.sqrt(e)
        key = sorted((int(d), k) for k, d in enumerate(deviation))
        own = got.pivot_table(index=["deviation"], columns="component", values="whitened", aggfunc="first")
        for d, k in key:
            assert np.abs(own.loc[d].to_numpy()) == pytest.approx(np.abs(w[k]), abs=1e-8)
        first = got[got.component == 1].whitened.to_numpy()
        assert abs(first.mean()) < 1e-9 and got["identity_error"].iloc[0] < 1e-9
        assert got.groupby("component").explained.first().to_numpy() == pytest.approx(e / float(np.trace(v)), rel=1e-9)


def test_whitening_edges(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0 and whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [0.5, 2.0])])).collect()
    assert len(one) == 2 and all(r["deviation"] == 0 and r["whitened"] is None and r["identity_error"] is None and r["explained"] == 0 for r in one)
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 3.0, -float(i)]) for i in range(5)])).toPandas()
    assert flat[flat.component == 1].whitened.notna().all() and flat[flat.component > 1].whitened.isna().all() and flat.identity_error.max() < 1e-12
    wide = whitening.whiten(vectors(spark, [(i, [float((i * k) % 7) for k in range(40)]) for i in range(90)])).toPandas()
    assert set(wide.component) == set(range(1, 33))


def test_covariance_keeps_what_doubles_lose():
    rng = np.random.default_rng(0)
    high = rng.normal(size=(5000, 3)) * np.array([1e8, 1.0, 1e-6])
    got = whitening.products(high, None)
    exact = [[sum((int(math.ldexp(a, 80)) * int(math.ldexp(b, 80)) for a, b in zip(high[:, i].tolist(), high[:, j].tolist(), strict=True)), 0) for j in range(3)] for i in range(3)]
    for i in range(3):
        for j in range(3):
            found = int(math.ldexp(float(got[0][i, j]), 160)) + int(math.ldexp(float(got[1][i, j]), 160))
            scale = math.sqrt(exact[i][i] * exact[j][j])
            assert abs(found - exact[i][j]) <= 1e-17 * scale
    s, e = whitening.two_sum(np.array([1e16]), np.array([1.5]))
    assert int(s[0]) + e[0] == 10**16 + 1.5


def documents_made(n, seed=1):
    """Texts of two kinds with words of their own, and odd rows."""
    rng = random.Random(seed)
    kinds = [[f"{p}{i}" for i in range(80)] for p in ("un", "ver")]
    return [(i, " ".join(rng.choices(kinds[i % 2], k=rng.randint(5, 60))) + ("\tThe  End\n" if i % 5 else f" rare{i} É" + "z" * 100)) for i in range(n)]


def scored(spark, rows):
    return lm.language_scores(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("r"), "word": F.lit("w"), "n": F.lit(1), "ids": F.lit(2)}))


def base_of(rows):
    words = lambda t: (t or "").encode().lower().split()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not out(i) for w in [*words(t), b""])
    n, whole = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
    return Counter((i, out(i), len(words(t)) + 1, sum(w in c for w in [*words(t), b""]), n, round(sum(math.log10((c[w] + 0.1) / whole) for w in [*words(t), b""]), 6)) for i, t in rows)


@pytest.mark.parametrize("held", [1 << 18, 40, 0])
def test_language_scores_base_is_exact_and_held_out_rows_gain(spark, monkeypatch, held):
    """Also where the dictionary holds few of the words, or none."""
    monkeypatch.setattr(lm, "WORDS", held)
    rows = documents_made(500) + [(1000, None), (1001, ""), (1002, " \t"), (None, "un1 un2"), (3, "un1 un2"), (3, "un1 un2"), (1003, "w" * 300_000 + " a")]
    got = scored(spark, rows).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == base_of(rows)
    if held > 40:
        new = [r for r in got if r["held_out"]]
        assert len(new) > 30 and sum(r["score"] for r in new) > sum(r["base_score"] for r in new) + 0.05 * sum(r["n_tokens"] for r in new)


def test_language_scores_are_normalised():
    """All symbols after a context, and within a class all its words and one unknown, add up to 1."""
    rng = np.random.default_rng(3)
    w = lm.Weights.start()
    w.q, w.b = rng.normal(size=w.q.shape).astype(np.float32), rng.normal(size=lm.OUTPUTS).astype(np.float32)
    mass = rng.random(lm.OUTPUTS)
    x = w.r[rng.integers(0, lm.OUTPUTS, 12)]
    p = np.exp(w.predicted(x) @ w.q.T + w.b + np.log(mass / mass.sum()))
    plain = [sum(w.c[j] * x[lm.CONTEXT + k - 1 - j] for j in range(lm.CONTEXT)) for k in range(12 - lm.CONTEXT)]
    assert w.predicted(x) == pytest.approx(np.array(plain), rel=1e-4) and (p / p.sum(axis=1, keepdims=True)).sum(axis=1) == pytest.approx(1.0)


def test_language_model_climbs_the_noise_contrastive_likelihood():
    rng = np.random.default_rng(2)
    w = lm.Weights.start()
    symbols = rng.integers(0, lm.OUTPUTS, (4, lm.RUN + lm.CONTEXT)).astype(np.uint16)
    real = (rng.random((4, lm.RUN)) < 0.8).astype(np.float32)
    noise = rng.integers(0, lm.OUTPUTS, lm.NOISE).astype(np.uint16)

    def likelihood(r, q, b, c):
        total = 0.0
        for s, known in zip(symbols, real, strict=True):
            for k in range(lm.RUN):
                if known[k]:
                    p = sum(c[j] * r[s[lm.CONTEXT + k - 1 - j]] for j in range(lm.CONTEXT))
                    z = lambda t: float(p @ q[t] + b[t] - math.log(lm.NOISE))  # noqa: B023, E731
                    total += -math.log1p(math.exp(-z(s[lm.CONTEXT + k]))) - sum(math.log1p(math.exp(z(t))) for t in noise)
        return total

    before = [a.astype(float) for a in (w.r, w.q, w.b, w.c)]
    base = likelihood(*before)
    w.step(symbols, real, noise)
    after = [w.r, w.q, w.b, w.c]
    for i in range(4):  # AdaGrad's first step follows the sign of the slope
        moved = np.abs(after[i] - before[i])
        at = np.unravel_index(moved.argmax(), moved.shape)
        probe = [a.copy() for a in before]
        probe[i][at] += 1e-4
        assert np.sign(likelihood(*probe) - base) == np.sign(after[i][at] - before[i][at])


def test_language_scores_edges(spark):
    assert scored(spark, []).count() == 0
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = scored(spark, [(out, "only held out")]).collect()
    assert [(x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 9)) for x in r] == [(4, 0, 0, 0.0)] and math.isfinite(r[0]["score"])


def test_pipeline_keeps_different_texts_of_one_id(spark):
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    rows, texts = [], set()
    for k in range(12):
        a, b = text(), text()
        texts |= {a, b}
        rows += [(2 * k, a), (2 * k + 1, a), (2 * k + 1, b)]
    rows += [(None, rows[0][1]), (500, ""), (501, None), (None, "alone " + text()), rows[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_chars": F.length("text"), "row": F.lit("mine"), "component_id": F.lit(3)})
    out = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert out.columns == docs.columns
    got = out.collect()
    assert Counter(r["text"] for r in got if r["text"] and not r["text"].startswith("alone")) == Counter(texts) and len(got) == 24 + 3
    assert {(r["doc_id"], r["text"]) for r in got} >= {(2 * k, rows[3 * k][1]) for k in range(12)} and all(r["row"] == "mine" for r in got)


def test_quality_limits_follow_the_length_without_steps():
    for points in (quality.UPPER, quality.LOWER):
        values = [quality.limit(points, n) for n in range(0, 300_000, 7)]
        assert max(abs(a - b) for a, b in zip(values, values[1:])) < 0.02 and values == sorted(values, reverse=True)
    assert all(quality.limit(quality.LOWER, n) < quality.limit(quality.UPPER, n) for n in range(0, 300_000, 7))
    assert quality.limit(quality.UPPER, 1_069) > 0.65  # a licence text of that length has 0.63


def test_bpe_and_packing_take_rows_without_an_id_and_repeated_rows(spark):
    rows = [(None, "one two"), (None, "one two"), (None, None), (3, "x " * 3000), (3, "x " * 3000), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "ids": F.lit(2), "piece": F.lit(3)})
    got = Counter((r["doc_id"], r["n_tokens"]) for r in bpe.digest(docs, queries.tokenizer_path()).collect())
    n = {k: next(t for i, t in got if i == k) for k in (3, 4)}
    assert sum(got.values()) == 6 and got[3, n[3]] == 2 and n[4] == 0 and got[None, 0] == 1 and max(v for (i, _), v in got.items() if i is None) == 2
    pieces = packing.pack_documents(docs, queries.tokenizer_path()).collect()
    long = [r for r in pieces if r["doc_id"] == 3]
    assert sum(r["length"] for r in long) == 2 * (n[3] + 1) and Counter(r["piece"] for r in long) == Counter({k: 2 for k in range(-(-(n[3] + 1) // 1024))})
    assert sum(r["doc_id"] is None for r in pieces) == 3 and len({(r["sequence_id"], r["offset"]) for r in pieces}) == len(pieces)
    empty = docs.where("false")
    assert bpe.digest(empty, queries.tokenizer_path()).count() == packing.pack_documents(empty, queries.tokenizer_path()).count() == 0
