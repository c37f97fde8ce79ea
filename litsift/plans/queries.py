"""Queries over the shared tables, one for each operator, and the SQL that gives the same rows.

documents are the records: doc_id the id, text the abstract, its first 80 characters the title, lang and source the
keywords. (doc_id * 37) % 1000 / 1000 stands for a model's probability, labels.quality for a reviewer's label.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litsift.config import Config
from litsift.functions import scalars
from litsift.functions import text as T
from litsift.operators import active, audit, features, metrics, model, sampling, screening, stopping

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CRITERIA = {"a": r"\bthe\b", "b": r"(?:and|und|eau)"}
SQL_A, SQL_B = (f"regexp_matches(text, '{p}', 'i')" for p in CRITERIA.values())
P_SQL = "((doc_id * 37) % 1000) / 1000.0::DOUBLE"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def probability() -> Column:
    return (F.col("doc_id") * 37 % 1000) / F.lit(1000.0)


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents with the pseudo-probability and the prediction at 0.5."""
    return read(spark, d, "labels").withColumn("p", probability()).withColumn("pred", (F.col("p") > 0.5).cast("int"))


SCORED = f"(SELECT *, {P_SQL} AS p, CASE WHEN {P_SQL} > 0.5 THEN 1 ELSE 0 END AS pred FROM labels)"
RATES = """tp + fp + tn + fn AS n, tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS "precision",
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END, 6) AS specificity, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1"""
COUNTS = "count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y <> 1 AND pred = 1) AS fp, count(*) FILTER (y <> 1 AND pred <> 1) AS tn, count(*) FILTER (y = 1 AND pred <> 1) AS fn"


def rounded(df: DataFrame) -> DataFrame:
    out = df.withColumn("n", F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "specificity", "f1")})


# --- screening ---


@query(f"SELECT doc_id, {SQL_A}::INT AS a, {SQL_B}::INT AS b, ({SQL_A} AND {SQL_B})::INT AS meets_all_criteria FROM documents")
def screen_criteria(spark, d):
    return screening.criteria_flags(read(spark, d, "documents"), "text", CRITERIA).select("doc_id", "a", "b", "meets_all_criteria")


@query(f"SELECT lang, count(*) AS n, sum({SQL_A}::INT)::BIGINT AS a, sum({SQL_B}::INT)::BIGINT AS b, sum(({SQL_A} AND {SQL_B})::INT)::BIGINT AS met FROM documents GROUP BY lang")
def screen_all_by_lang(spark, d):
    flags = screening.criteria_flags(read(spark, d, "documents"), "text", CRITERIA)
    return flags.groupBy("lang").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("meets_all_criteria").alias("met"))


@query(r"""WITH s AS (SELECT doc_id, trim(s) AS s FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]+\s+')) AS s FROM documents)),
e AS (SELECT DISTINCT doc_id, regexp_replace(s, '^\s+|\s+$', '', 'g') AS text FROM s WHERE regexp_matches(s, '\bthe\b', 'i'))
SELECT doc_id, count(*) AS n_evidence, sum(length(text))::BIGINT AS chars, min(md5(text)) AS first_md5, max(md5(text)) AS last_md5 FROM e WHERE text <> '' GROUP BY doc_id""")
def sentence_evidence(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.explode(T.sentence_evidence("text", CRITERIA["a"], "text")).alias("e"))
    md5 = F.md5(F.col("e.text"))
    return docs.groupBy("doc_id").agg(F.count("*").alias("n_evidence"), F.sum(F.length("e.text")).alias("chars"), F.min(md5).alias("first_md5"), F.max(md5).alias("last_md5"))


#: Parts between matches and the matches, from which their places follow.
PARTS = lambda pattern, text="text": f"string_split_regex({text}, '(?i){pattern}') AS p, regexp_extract_all({text}, '(?i){pattern}') AS m"
LAST_WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda w: w <> '')[-5:]"
FIRST_WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda w: w <> '')[1:5]"


@query(f"""WITH s AS (SELECT doc_id, text, {PARTS(CRITERIA['b'])} FROM documents), u AS (SELECT doc_id, text, unnest(range(1, len(m) + 1)) AS k, p, m FROM s),
x AS (SELECT doc_id, text, k, m[k] AS hit, list_sum(list_transform(p[1:k], lambda w: length(w)))::BIGINT + coalesce(list_sum(list_transform(m[1:k - 1], lambda w: length(w))), 0)::BIGINT AS start FROM u),
e AS (SELECT doc_id, k, hit, array_to_string(list_concat(list_concat({LAST_WORDS.format('substr(text, 1, start)')}, [hit]), {FIRST_WORDS.format('substr(text, start + length(hit) + 1)')}), ' ') AS text FROM x)
SELECT doc_id, text, 'text' AS field, arg_min(hit, k) AS matched_term FROM e GROUP BY doc_id, text""")
def window_evidence(spark, d):
    return read(spark, d, "documents").select("doc_id", F.explode(T.window_evidence("text", CRITERIA["b"], "text")).alias("e")).select("doc_id", "e.*")


def snippets_sql(text: str, pattern: str) -> str:
    """The first three matches with 20 characters on either side, from lists p and m."""
    before = {1: "p[1]", 2: "p[1] || m[1] || p[2]", 3: "p[1] || m[1] || p[2] || m[2] || p[3]"}
    each = [f"CASE WHEN len(m) >= {k} THEN '...' || regexp_replace(right({b}, 20) || m[{k}] || substr({text}, length({b}) + length(m[{k}]) + 1, 20), '^\\s+|\\s+$', '', 'g') || '...' END" for k, b in before.items()]
    return f"substr(concat_ws(' | ', {', '.join(each)}), 1, 200)"


@query(f"SELECT doc_id, {snippets_sql('text', CRITERIA['a'])} AS snippets FROM (SELECT doc_id, text, {PARTS(CRITERIA['a'])} FROM documents)")
def snippets(spark, d):
    return read(spark, d, "documents").select("doc_id", T.snippets("text", CRITERIA["a"]).alias("snippets"))


@query()
def regex_screen(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.col("text").alias("abstract"), F.substring("text", 1, 80).alias("title"), F.concat_ws(" ", "lang", "source").alias("keywords"))
    return screening.regex_screen(docs, {k: {"pattern": p, "description": f"criterion {k}"} for k, p in CRITERIA.items()}).drop("abstract")


@query(f"""WITH c AS (SELECT count(*) AS n, sum({SQL_A}::INT) AS a, sum({SQL_B}::INT) AS b, sum(({SQL_A} AND {SQL_B})::INT) AS m FROM documents)
SELECT 'a' AS criterion, a::BIGINT AS matched, round(100 * a / n, 6) AS percent FROM c UNION ALL SELECT 'b', b::BIGINT, round(100 * b / n, 6) FROM c UNION ALL SELECT 'meets_all_criteria', m::BIGINT, round(100 * m / n, 6) FROM c""")
def screening_summary(spark, d):
    out = screening.screening_summary(screening.criteria_flags(read(spark, d, "documents"), "text", CRITERIA), list(CRITERIA))
    return out.withColumn("percent", F.round("percent", 6))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '(?i){CRITERIA['a']}'))::INT AS a_count, len(regexp_extract_all(text, '(?i){CRITERIA['b']}'))::INT AS b_count FROM documents")
def pattern_counts(spark, d):
    return read(spark, d, "documents").select("doc_id", T.count_matches("text", CRITERIA["a"]).alias("a_count"), T.count_matches("text", CRITERIA["b"]).alias("b_count"))


@query("""SELECT q.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM embeddings q, (SELECT embedding FROM embeddings WHERE vec_id = 0) c""")
def semantic_similarity(spark, d):
    rows = read(spark, d, "embeddings")
    goal = rows.where("vec_id = 0").select(F.col("embedding").alias("goal")).limit(1)
    return rows.crossJoin(F.broadcast(goal)).select("vec_id", F.round(scalars.cosine(F.col("embedding"), F.col("goal")), 6).alias("score"))  # goal is one row


TYPED = """(SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'NA' WHEN 1 THEN 'abc' WHEN 2 THEN ' 12 ' ELSE n_chars::VARCHAR || '.5' END AS raw, CASE quality WHEN 1 THEN 'Yes' ELSE CASE WHEN toxic = 1 THEN 'Maybe' ELSE 'No' END END AS answer FROM documents JOIN labels USING (doc_id))"""


@query(f"SELECT doc_id, try_cast(trim(raw) AS DOUBLE) AS number, CASE answer WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 ELSE -1 END::INT AS flag, CASE answer WHEN 'Yes' THEN 'Yes' WHEN 'No' THEN 'No' ELSE '' END AS answer FROM {TYPED} WHERE try_cast(trim(raw) AS DOUBLE) IS NOT NULL")
def typed_records(spark, d):
    """Lenient numbers, Yes and No as 1 and 0 and back, and rows without a number dropped."""
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    case = F.col("doc_id") % 5
    raw = F.when(case == 0, "NA").when(case == 1, "abc").when(case == 2, " 12 ").otherwise(F.concat(F.col("n_chars").cast("string"), F.lit(".5")))
    answer = F.when(F.col("quality") == 1, "Yes").when(F.col("toxic") == 1, "Maybe").otherwise("No")
    out = rows.select("doc_id", scalars.to_number(raw).alias("number"), scalars.yes_no(answer).alias("flag"))
    out = out.withColumns({"answer": F.coalesce(scalars.to_yes_no(F.col("flag")), F.lit("")), "flag": F.coalesce("flag", F.lit(-1))})
    return out.na.drop(subset=["number"])


@query(f"SELECT doc_id, {P_SQL} AS quality_prob, ({P_SQL} > 0.5)::INT AS quality, {P_SQL} > 0.3 AND {P_SQL} < 0.7 AS quality_uncertain, 1 - {P_SQL} / 2 AS toxic_prob, (1 - {P_SQL} / 2 > 0.5)::INT AS toxic, 1 - {P_SQL} / 2 > 0.3 AND 1 - {P_SQL} / 2 < 0.7 AS toxic_uncertain FROM documents")
def unpacked_labels(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.array(probability(), 1 - probability() / 2).alias("probabilities"))
    rows = rows.withColumn("predictions", F.transform("probabilities", lambda p: (p > 0.5).cast("int")))
    return model.unpack_labels(rows, ["quality", "toxic"]).drop("probabilities", "predictions")


@query("""SELECT vec_id, round((a[1] * (vec_id % 2) + b[1] + c[1] * (vec_id % 3 % 2)) / (vec_id % 2 + 1 + vec_id % 3 % 2), 5) AS first, round((a[32] * (vec_id % 2) + b[32] + c[32] * (vec_id % 3 % 2)) / (vec_id % 2 + 1 + vec_id % 3 % 2), 5) AS last
FROM (SELECT vec_id, embedding[1:32]::DOUBLE[] AS a, embedding[17:48]::DOUBLE[] AS b, embedding[33:64]::DOUBLE[] AS c FROM embeddings)""")
def pooled_embeddings(spark, d):
    """The masked mean of three vectors of a row."""
    parts = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 17, 32), F.slice("embedding", 33, 32))
    mask = F.array(F.col("vec_id") % 2, F.lit(1).cast("long"), F.col("vec_id") % 3 % 2)
    pooled = read(spark, d, "embeddings").select("vec_id", scalars.masked_mean(parts, mask).alias("v"))
    return pooled.select("vec_id", F.round(F.col("v")[0], 5).alias("first"), F.round(F.col("v")[31], 5).alias("last"))


# --- sampling and splits ---


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '|42'), doc_id) AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN r <= n * 8 // 10 THEN 'train' WHEN r <= n * 9 // 10 THEN 'val' ELSE 'test' END AS split FROM r""")
def split_assign(spark, d):
    return sampling.with_split(read(spark, d, "documents").select("doc_id"), "doc_id")


@query("""WITH s AS (SELECT quality, count(*) AS c FROM labels GROUP BY quality), o AS (SELECT quality, coalesce(sum(c) OVER (ORDER BY quality::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT doc_id, ((before + row_number() OVER (PARTITION BY l.quality ORDER BY md5(doc_id || '|42'), doc_id) - 1) % 5)::INT AS fold FROM labels l JOIN o ON l.quality = o.quality""")
def kfold_assign(spark, d):
    return sampling.with_folds(read(spark, d, "labels"), "doc_id", ["quality"]).select("doc_id", "fold")


STRATA = f"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '(?i){CRITERIA['a']}')) AS score FROM documents),
e AS (SELECT list_sort(list_distinct([quantile_cont(score, 0.0), quantile_cont(score, 0.2), quantile_cont(score, 0.4), quantile_cont(score, 0.6), quantile_cont(score, 0.8), quantile_cont(score, 1.0)])) AS e FROM c),
s AS (SELECT doc_id, score, CASE WHEN len(e) < 2 THEN 'uniform' ELSE (['very_low', 'low', 'medium', 'high', 'very_high'])[greatest(1, len(list_filter(e[1:len(e) - 1], lambda x: score > x)))] END AS strata FROM c, e)"""


@query(STRATA + " SELECT doc_id, score::INT AS score, strata FROM s")
def pattern_score_strata(spark, d):
    docs = read(spark, d, "documents").select("doc_id", T.count_matches("text", CRITERIA["a"]).alias("score"))
    return sampling.with_strata(docs, "score")


@query(STRATA + """, r AS (SELECT *, row_number() OVER (PARTITION BY strata ORDER BY md5(doc_id || '|42'), doc_id) AS r, count(*) OVER (PARTITION BY strata) AS n FROM s)
SELECT doc_id, strata FROM r WHERE r <= round_even(0.2 * n, 0)""")
def stratified_sample(spark, d):
    docs = read(spark, d, "documents").select("doc_id", T.count_matches("text", CRITERIA["a"]).alias("score"))
    return sampling.sample_by_score(docs, "doc_id", "score", 0.2).select("doc_id", "strata")


CODED = f"""WITH d AS (SELECT doc_id, title, concat_ws(' ', title, text, '') AS whole FROM (SELECT doc_id, substr(text, 1, 80) AS title, text FROM documents)),
c AS (SELECT *, len(regexp_extract_all(whole, '(?i){CRITERIA['a']}')) AS na, len(regexp_extract_all(whole, '(?i){CRITERIA['b']}')) AS nb, na + nb AS score FROM d),
e AS (SELECT list_sort(list_distinct([quantile_cont(score, 0.0), quantile_cont(score, 0.2), quantile_cont(score, 0.4), quantile_cont(score, 0.6), quantile_cont(score, 0.8), quantile_cont(score, 1.0)])) AS e FROM c),
s AS (SELECT c.*, CASE WHEN len(e) < 2 THEN 0 ELSE greatest(1, len(list_filter(e[1:len(e) - 1], lambda x: score > x))) END AS strata FROM c, e),
r AS (SELECT *, row_number() OVER (PARTITION BY strata ORDER BY md5(doc_id || '|42'), doc_id) AS r, count(*) OVER (PARTITION BY strata) AS n FROM s),
k AS (SELECT * FROM r WHERE r <= round_even(0.2 * n, 0)),
a AS (SELECT doc_id, {snippets_sql('whole', CRITERIA['a'])} AS x FROM (SELECT doc_id, whole, {PARTS(CRITERIA['a'], 'whole')} FROM k)),
b AS (SELECT doc_id, {snippets_sql('whole', CRITERIA['b'])} AS x FROM (SELECT doc_id, whole, {PARTS(CRITERIA['b'], 'whole')} FROM k))
SELECT k.doc_id, title, NULL::VARCHAR AS keywords, na::INT AS a_pattern_count, a.x AS a_pattern_snippets, nb::INT AS b_pattern_count, b.x AS b_pattern_snippets, '' AS a, '' AS b, '' AS notes, '' AS coder_id, '' AS coding_date
FROM k JOIN a ON k.doc_id = a.doc_id JOIN b ON k.doc_id = b.doc_id"""


@query(CODED)
def coding_sample(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.substring("text", 1, 80).alias("title"), F.col("text").alias("abstract"), F.lit(None).cast("string").alias("keywords"))
    return sampling.create_stratified_sample(docs, CRITERIA, "doc_id").drop("abstract")


@query(STRATA + " SELECT strata, count(*) AS n, round(count(*) / (SELECT count(*) FROM s), 6) AS share FROM s GROUP BY strata")
def strata_distribution(spark, d):
    docs = read(spark, d, "documents").select("doc_id", T.count_matches("text", CRITERIA["a"]).alias("score"))
    return sampling.strata_distribution(sampling.with_strata(docs, "score")).withColumn("share", F.round("share", 6))


# --- features ---


@query("""SELECT source AS value, (row_number() OVER (ORDER BY n DESC, source) + 1)::INT AS "index" FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source HAVING count(*) >= 5)""")
def vocab_build(spark, d):
    return features.vocabulary(read(spark, d, "documents"), "source")


@query("""WITH v AS (SELECT lang, row_number() OVER (ORDER BY count(*) DESC, lang) + 1 AS i FROM documents WHERE doc_id % 7 <> 0 AND lang IS NOT NULL GROUP BY lang HAVING count(*) >= 150)
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE coalesce(i, 1) END::INT AS code FROM documents d LEFT JOIN v ON d.lang = v.lang""")
def cat_encode(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("lang"))
    fitted = features.fit_transforms(docs, features.ColumnSpec(categorical_cols=("lang",)), rare_threshold=150)
    return docs.select("doc_id", features.encode("lang", fitted.vocabularies["lang"]).alias("code"))


NUM = "(SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"


def poly_sql(coefficients: tuple[float, ...], x: str) -> str:
    out = repr(coefficients[0]) + "::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def probit_sql(p: str, most: float = 5.199337582605575) -> str:
    tail = lambda x: f"({poly_sql(scalars.PROBIT_C, f'sqrt(-2 * ln({x}))')} / {poly_sql(scalars.PROBIT_D, f'sqrt(-2 * ln({x}))')})"
    r = f"(({p} - 0.5) * ({p} - 0.5))"
    middle = f"({poly_sql(scalars.PROBIT_A, r)} * ({p} - 0.5) / {poly_sql(scalars.PROBIT_B, r)})"
    return f"greatest(-{most}, least({most}, CASE WHEN {p} <= 0 THEN -{most} WHEN {p} >= 1 THEN {most} WHEN {p} < {scalars.PROBIT_LOW} THEN {tail(p)} WHEN {p} > {1 - scalars.PROBIT_LOW} THEN -{tail(f'(1 - {p})')} ELSE {middle} END))"


def quantile_sql(value: str) -> str:
    """Among 1,000 quantiles q, v stands after the last quantile up to it (r) and after the last one below it (l); the mean of both places."""
    place = lambda k: f"(CASE WHEN {k} = 0 THEN 0 WHEN {k} = 1000 THEN 1 ELSE ({k} - 1 + (v - q[{k}]) / (q[{k} + 1] - q[{k}])) / 999 END)"
    return f"""WITH m AS (SELECT median(value) AS m, quantile_cont({value}, list_transform(range(1000), lambda i: i / 999)) AS q FROM {NUM}),
n AS (SELECT event_id, {value.replace('value', 'coalesce(value, m)')} AS v, q FROM {NUM}, m),
p AS (SELECT event_id, v, q, len(list_filter(q, lambda z: z <= v)) AS r, len(list_filter(q, lambda z: z < v)) AS l FROM n),
u AS (SELECT event_id, 0.5 * ({place('r')} + {place('l')}) AS p FROM p)
SELECT event_id, round({probit_sql('p')}, 6) AS x FROM u"""


def numeric(spark: SparkSession, d: str, kind: str) -> DataFrame:
    rows = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    p = features.fit_numeric(rows, {"value": kind})["value"]
    return rows.select("event_id", F.round(features.apply_numeric("value", p), 6).alias("x"))


@query(f"SELECT event_id, round(coalesce(value, m) - low, 6) AS x FROM {NUM}, (SELECT median(value) AS m, min(value) AS low FROM {NUM})")
def num_min(spark, d):
    return numeric(spark, d, "min")


@query(f"SELECT event_id, round(coalesce(value, m) / high, 6) AS x FROM {NUM}, (SELECT median(value) AS m, max(value) AS high FROM {NUM})")
def num_max(spark, d):
    return numeric(spark, d, "max")


@query(f"SELECT event_id, round(coalesce(value, m) - a, 6) AS x FROM {NUM}, (SELECT median(value) AS m, avg(value) AS a FROM {NUM})")
def num_mean(spark, d):
    return numeric(spark, d, "mean")


@query(f"SELECT event_id, round((coalesce(value, m) - m) / (h - l), 6) AS x FROM {NUM}, (SELECT median(value) AS m, quantile_cont(value, 0.25) AS l, quantile_cont(value, 0.75) AS h FROM {NUM})")
def num_robust(spark, d):
    return numeric(spark, d, "robust")


@query(quantile_sql("value"))
def num_quantile(spark, d):
    return numeric(spark, d, "quantile")


@query(quantile_sql("ln(1 + value)"))
def num_log1p(spark, d):
    return numeric(spark, d, "log1p")


# --- active learning ---


@query(f"SELECT doc_id, {P_SQL} AS p FROM documents ORDER BY abs({P_SQL} - 0.5), doc_id LIMIT 20")
def al_uncertainty(spark, d):
    return active.select_query_batch(read(spark, d, "documents").select("doc_id", probability().alias("p")), "p", "doc_id")


@query(f"SELECT doc_id, {P_SQL} AS p FROM documents ORDER BY md5(doc_id || '|42'), doc_id LIMIT 20")
def al_random(spark, d):
    return active.select_query_batch(read(spark, d, "documents").select("doc_id", probability().alias("p")), "p", "doc_id", "random")


@query(f"SELECT doc_id, {P_SQL} AS p FROM documents ORDER BY {P_SQL} DESC, doc_id LIMIT 20")
def al_relevance(spark, d):
    return active.select_query_batch(read(spark, d, "documents").select("doc_id", probability().alias("p")), "p", "doc_id", "max_relevance")


@query(f"""WITH b AS (SELECT doc_id FROM documents ORDER BY abs({P_SQL} - 0.5), doc_id LIMIT 20)
SELECT doc_id, {P_SQL} AS model_probability, ({P_SQL} >= 0.5)::INT AS model_prediction FROM documents WHERE doc_id IN (SELECT doc_id FROM b)""")
def review_batch(spark, d):
    docs = read(spark, d, "documents").select("doc_id", probability().alias("p"))
    return active.create_review_batch(docs, active.select_query_batch(docs, "p", "doc_id"), "p", "doc_id").select("doc_id", "model_probability", "model_prediction")


@query("SELECT doc_id, coalesce(human_label, -1) AS human_label FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN toxic END ELSE quality END AS human_label FROM labels)")
def merge_labels(spark, d):
    rows = read(spark, d, "labels").select("doc_id", F.col("quality").alias("human_label"))
    batch = read(spark, d, "labels").where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("toxic")).alias("human_label"))
    return active.merge_human_labels(rows, batch, "doc_id").withColumn("human_label", F.coalesce("human_label", F.lit(-1)))  # -1: cleared


@query(f"SELECT doc_id, {P_SQL} > 0.3 AND {P_SQL} < 0.7 AS uncertain FROM documents")
def flag_uncertain(spark, d):
    return read(spark, d, "documents").select("doc_id", scalars.flag_uncertain(probability()).alias("uncertain"))


@query(f"SELECT doc_id, ({P_SQL} > 0.3 AND {P_SQL} < 0.7) OR (1 - {P_SQL} / 2 > 0.3 AND 1 - {P_SQL} / 2 < 0.7) AS any_uncertain FROM documents")
def multi_label_flags(spark, d):
    ps = F.array(probability(), 1 - probability() / 2)
    return read(spark, d, "documents").select("doc_id", F.exists(scalars.flag_uncertain_each(ps), lambda x: x).alias("any_uncertain"))


# --- metrics ---


@query(f"SELECT {RATES} FROM (SELECT {COUNTS} FROM (SELECT quality AS y, pred FROM {SCORED}))")
def metrics_single(spark, d):
    return rounded(metrics.binary_metrics(scored(spark, d), "quality", "pred"))


TWO = f"(SELECT 'quality' AS label, quality AS y, pred FROM {SCORED} UNION ALL SELECT 'toxic', toxic, 1 - pred FROM {SCORED})"


@query(f"SELECT label, {RATES} FROM (SELECT label, {COUNTS} FROM {TWO} GROUP BY label)")
def metrics_multi(spark, d):
    rows = scored(spark, d).select(F.array("quality", "toxic").alias("y"), F.array(F.col("pred"), 1 - F.col("pred")).alias("p"))
    return rounded(metrics.multi_label_metrics(rows, "y", "p", ["quality", "toxic"])).drop("i")


@query(f"""SELECT round(avg(f1), 6) AS macro_f1, round((SELECT avg((y <> pred)::INT) FROM {TWO}), 6) AS hamming_loss
FROM (SELECT CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM (SELECT label, {COUNTS} FROM {TWO} GROUP BY label))""")
def metrics_multi_summary(spark, d):
    rows = scored(spark, d).select(F.array("quality", "toxic").alias("y"), F.array(F.col("pred"), 1 - F.col("pred")).alias("p"))
    return metrics.multi_label_summary(rows, "y", "p").select(F.round("macro_f1", 6).alias("macro_f1"), F.round("hamming_loss", 6).alias("hamming_loss"))


@query(f"""WITH r AS (SELECT quality AS y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM {SCORED})
SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y <> 1)), 6) AS auc FROM r""")
def roc_auc(spark, d):
    return metrics.roc_auc(scored(spark, d), "quality", "p").select(F.round("auc", 6).alias("auc"))


@query(f"""WITH g AS (SELECT p, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality <> 1) AS neg FROM {SCORED} GROUP BY p)
SELECT p AS threshold, round(sum(neg) OVER (ORDER BY p DESC) / sum(neg) OVER (), 6) AS fpr, round(sum(pos) OVER (ORDER BY p DESC) / sum(pos) OVER (), 6) AS tpr FROM g""")
def roc_points(spark, d):
    return metrics.roc_points(scored(spark, d), "quality", "p").select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(f"SELECT quality AS label, count(*) FILTER (pred = 0) AS predicted_0, count(*) FILTER (pred = 1) AS predicted_1 FROM {SCORED} GROUP BY quality")
def confusion(spark, d):
    return metrics.confusion_matrix(scored(spark, d), "quality", "pred")


@query(f"""WITH c AS (SELECT {COUNTS} FROM (SELECT quality AS y, pred FROM {SCORED})),
e AS (SELECT '0' AS class, tn AS hit, tn + fn AS said, tn + fp AS support FROM c UNION ALL SELECT '1', tp, tp + fp, tp + fn FROM c),
f AS (SELECT class, CASE WHEN said = 0 THEN 0 ELSE hit / said END AS "precision", CASE WHEN support = 0 THEN 0 ELSE hit / support END AS recall, CASE WHEN said + support = 0 THEN 0 ELSE 2 * hit / (said + support) END AS f1, support FROM e),
r AS (SELECT * FROM f UNION ALL SELECT 'macro avg', avg("precision"), avg(recall), avg(f1), sum(support) FROM f
UNION ALL SELECT 'weighted avg', sum("precision" * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f)
SELECT class, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM r""")
def classification_report(spark, d):
    return metrics.classification_report(scored(spark, d), "quality", "pred").withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"SELECT (count(*) - sum(quality)) / greatest(sum(quality), 1) AS pos_weight FROM {SCORED}")
def positive_weight(spark, d):
    return metrics.positive_weight(scored(spark, d), "quality")


@query(f"""SELECT round(avg(-CASE WHEN quality = 1 THEN ln(q) ELSE ln(1 - q) END), 6) AS loss FROM (SELECT quality, greatest(1e-12, least(1 - 1e-12, p)) AS q FROM {SCORED})""")
def log_loss(spark, d):
    return metrics.log_loss(scored(spark, d), "quality", "p").select(F.round("loss", 6).alias("loss"))


@query(f"SELECT round(100 * avg((pred = quality)::INT), 6) AS accuracy FROM {SCORED}")
def accuracy_percent(spark, d):
    return metrics.accuracy_percent(scored(spark, d), "quality", "p").select(F.round("accuracy", 6).alias("accuracy"))


# --- audit and stopping ---


KAPPA = f"""SELECT n AS total, hit AS agreed, round(hit / n, 6) AS agreement_rate, round((hit / n - e) / (1 - e), 6) AS kappa
FROM (SELECT tp + fp + tn + fn AS n, tp + tn AS hit, ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / ((tp + fp + tn + fn) * (tp + fp + tn + fn)) AS e FROM (SELECT {COUNTS} FROM (SELECT quality AS y, pred FROM {SCORED})))"""


@query(KAPPA)
def reviewer_kappa(spark, d):
    return metrics.agreement(scored(spark, d), "quality", "pred").withColumns({c: F.round(c, 6) for c in ("agreement_rate", "kappa")})


def log_of(spark: SparkSession, d: str) -> DataFrame:
    """An audit log of all documents, with the labels of those that have one."""
    docs = read(spark, d, "documents").select("doc_id", probability().alias("p")).withColumn("pred", (F.col("p") > 0.5).cast("int"))
    log = audit.log_batch(docs, "doc_id", "pred", "p").withColumn("seq", F.col("record_id").cast("long"))
    events = read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("record_id"), F.col("quality").alias("human_label"), F.lit("r1").alias("reviewer_id"), F.lit("").alias("notes"), F.col("doc_id").alias("at"))
    return audit.update_labels(log, events, "seq", "at")


LOG = f"(SELECT d.doc_id, {P_SQL.replace('doc_id', 'd.doc_id')} AS p, ({P_SQL.replace('doc_id', 'd.doc_id')} > 0.5)::INT AS pred, quality AS human FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@query(f"""SELECT count(*) AS total, count(*) FILTER (pred = 1) AS included, count(*) FILTER (pred = 0) AS excluded, count(*) FILTER (p > 0.3 AND p < 0.7) AS uncertain,
count(*) FILTER (human IS NOT NULL) AS human_reviewed, count(*) FILTER (human <> pred) AS human_overrides FROM {LOG}""")
def audit_summary(spark, d):
    return audit.decision_summary(log_of(spark, d))


@query(f"SELECT doc_id::VARCHAR AS record_id, pred AS model_prediction, human AS human_label FROM {LOG} WHERE human <> pred")
def audit_disagreements(spark, d):
    return audit.disagreements(log_of(spark, d)).select("record_id", "model_prediction", "human_label")


@query(f"""WITH s AS (SELECT count(*) AS total, count(*) FILTER (pred = 1) AS included, count(*) FILTER (pred = 0) AS excluded, count(*) FILTER (p > 0.3 AND p < 0.7) AS uncertain,
count(*) FILTER (human IS NOT NULL) AS reviewed, count(*) FILTER (human <> pred) AS overrides, count(*) FILTER (human = pred) AS agreed,
count(*) FILTER (human = 1) AS h1, count(*) FILTER (human IS NOT NULL AND pred = 1) AS p1 FROM {LOG}),
e AS (SELECT *, (h1 * p1 + (reviewed - h1) * (reviewed - p1)) / (reviewed * reviewed) AS chance FROM s), k AS (SELECT *, (agreed / reviewed - chance) / (1 - chance) AS kappa FROM e)
SELECT unnest(['M8', 'M8', 'M8', 'M8', 'M9', 'M9', 'R1', 'R1', 'R1', 'R2', 'R2', 'R2', 'R2']) AS section,
unnest(['human_reviewed', 'human_overrides', 'agreement_kappa', 'kappa_interpretation', 'total_screened', 'uncertain_flagged', 'model_included', 'model_excluded', 'human_overrides', 'compared', 'agreed', 'agreement_rate', 'kappa']) AS "key",
unnest([reviewed::VARCHAR, overrides::VARCHAR, round(kappa, 6)::VARCHAR, CASE WHEN kappa < 0 THEN 'poor' WHEN kappa <= 0.2 THEN 'slight' WHEN kappa <= 0.4 THEN 'fair' WHEN kappa <= 0.6 THEN 'moderate' WHEN kappa <= 0.8 THEN 'substantial' ELSE 'almost perfect' END,
total::VARCHAR, uncertain::VARCHAR, included::VARCHAR, excluded::VARCHAR, overrides::VARCHAR, reviewed::VARCHAR, agreed::VARCHAR, round(agreed / reviewed, 6)::VARCHAR, round(kappa, 6)::VARCHAR]) AS "value" FROM k""")
def prisma_report(spark, d):
    """The figures of the report; its fixed texts are left out."""
    return audit.prisma_report(log_of(spark, d), Config()).where(F.col("section").isin("M8", "M9", "R1", "R2") & (F.col("key") != "description"))


HISTORY = """(SELECT doc_id, review, row_number() OVER w AS total_screened, sum(y) OVER w AS total_relevant, row_number() OVER w - coalesce(max(CASE WHEN y = 1 THEN n END) OVER w, 0) AS consecutive_irrelevant
FROM (SELECT doc_id, doc_id % 4 AS review, toxic AS y, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) AS n FROM labels) WINDOW w AS (PARTITION BY review ORDER BY doc_id))"""


@query(f"SELECT doc_id, review, total_screened, total_relevant::BIGINT AS total_relevant, consecutive_irrelevant FROM {HISTORY}")
def stopping_history(spark, d):
    rows = read(spark, d, "labels").select("doc_id", (F.col("doc_id") % 4).alias("review"), "toxic")
    return stopping.stopping_history(rows, "toxic", ["doc_id"], ["review"]).drop("toxic")


@query(f"""SELECT doc_id, review, CASE WHEN phase = 'random' THEN CASE WHEN total_screened / n >= 0.1 THEN 'active' ELSE phase END ELSE 'quality_check' END AS phase
FROM (SELECT *, count(*) OVER (PARTITION BY review) AS n, (['random', 'active', 'switch', 'quality_check'])[1 + doc_id % 4] AS phase FROM {HISTORY})""")
def phase_transition(spark, d):
    rows = read(spark, d, "labels").select("doc_id", (F.col("doc_id") % 4).alias("review"), "toxic")
    h = stopping.stopping_history(rows, "toxic", ["doc_id"], ["review"]).withColumn("phase", F.element_at(F.array(*(F.lit(x) for x in ("random", "active", "switch", "quality_check"))), (F.col("doc_id") % 4 + 1).cast("int")))
    total = h.groupBy("review").agg(F.count("*").alias("n"))
    return h.join(total, "review").select("doc_id", "review", stopping.next_phase(F.col("phase"), F.col("n")).alias("phase"))


WILSON = "((r / s + 1.96 * 1.96 / (2 * s)) - 1.96 * sqrt((r / s * (1 - r / s) + 1.96 * 1.96 / (4 * s)) / s)) / (1 + 1.96 * 1.96 / s)"


@query(f"""WITH h AS (SELECT review, max(total_screened)::DOUBLE AS s, max(total_relevant)::DOUBLE AS r, arg_max(consecutive_irrelevant, total_screened) AS c FROM {HISTORY} GROUP BY review),
e AS (SELECT *, CASE WHEN r = 0 THEN 0 ELSE least(r / ({WILSON} * 2 * s), 1) END AS recall FROM h)
SELECT review, 'active' AS phase, s::BIGINT AS total_screened, r::BIGINT AS total_relevant, 0.5::DOUBLE AS screened_pct, round(recall, 4) AS estimated_recall, round(0.5 - (1 - recall), 4) AS wss,
c AS consecutive_irrelevant, CASE WHEN c >= 5 THEN 'stop' ELSE 'continue' END AS recommendation FROM e""")
def stopping_report(spark, d):
    """Each review's report as if its labels were half of its records."""
    rows = read(spark, d, "labels").select("doc_id", (F.col("doc_id") % 4).alias("review"), "toxic")
    last = stopping.stopping_history(rows, "toxic", ["doc_id"], ["review"]).groupBy("review").agg(F.max("total_screened").alias("total_screened"), F.max("total_relevant").alias("total_relevant"), F.max_by("consecutive_irrelevant", "total_screened").alias("consecutive_irrelevant"))
    states = last.withColumns({"phase": F.lit("active"), "total": 2 * F.col("total_screened")})
    report = stopping.stopping_report(states.select("phase", "total_screened", "total_relevant", "consecutive_irrelevant", "total", "review"), 2 * F.col("total_screened"), Config(safe_consecutive_irrelevant=5))
    return report.join(states.select("review", "total_screened", "total_relevant", "consecutive_irrelevant").distinct(), ["total_screened", "total_relevant", "consecutive_irrelevant"])


@query(f"""SELECT doc_id, review, round((n - total_screened) / n - (1 - total_relevant / m), 6) AS wss FROM (SELECT *, count(*) OVER (PARTITION BY review) AS n, max(total_relevant) OVER (PARTITION BY review) AS m FROM {HISTORY}) WHERE m > 0""")
def wss_curve(spark, d):
    rows = read(spark, d, "labels").select("doc_id", (F.col("doc_id") % 4).alias("review"), "toxic")
    h = stopping.stopping_history(rows, "toxic", ["doc_id"], ["review"])
    total = h.groupBy("review").agg(F.count("*").alias("n"), F.max("total_relevant").alias("m")).where("m > 0")
    return h.join(total, "review").select("doc_id", "review", F.round(scalars.work_saved(F.col("n"), F.col("total_screened"), F.col("total_relevant") / F.col("m")), 6).alias("wss"))


# --- models ---


def training(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "labels").join(read(spark, d, "documents"), "doc_id")


#: The default rate is meant for the last steps of a large encoder; a network from scratch needs a larger one.
RATE = 2e-3
SPEC = features.ColumnSpec(text_cols=("text",), categorical_cols=("lang", "source"), numeric_cols=("n_chars",), label_col=("quality", "toxic"))


@query()
def model_predictions(spark, d):
    """Fitted on the training split, applied to all labelled documents, calibrated on the validation split."""
    train, val = (part.persist() for part in sampling.split_data(training(spark, d), "doc_id")[:2])
    try:
        ready, fitted = features.preprocess(train, SPEC, {"n_chars": "log1p"})
        fit = model.fit(ready, 2)
        temperature = model.calibrate(fit, features.preprocess(val, SPEC, fitted=fitted)[0])
    finally:
        train.unpersist()
        val.unpersist()
    rows, _ = features.preprocess(training(spark, d), SPEC, fitted=fitted)
    return fit.predict(rows, temperature=temperature).select("doc_id", F.round(F.col("probabilities")[0], 6).alias("quality_prob"), F.col("predictions")[0].alias("quality"), F.round(F.col("probabilities")[1], 6).alias("toxic_prob"), F.col("predictions")[1].alias("toxic"))


@query()
def training_history(spark, d):
    """One network for both labels with learnt category tables, trained with early stopping on the validation split."""
    train, val = (part.persist() for part in sampling.split_data(training(spark, d), "doc_id")[:2])
    try:
        ready, fitted = features.preprocess(train, SPEC, {"n_chars": "log1p"})
        checked, _ = features.preprocess(val, SPEC, fitted=fitted)
        return model.train(ready, checked, 2, Config(learning_rate=RATE), kind="mlp", id_col="doc_id")[1]
    finally:
        train.unpersist()
        val.unpersist()


@query()
def cv_summary(spark, d):
    """Five folds of ten epochs, all in the same scans."""
    folds, _ = model.cross_validate(training(spark, d), "doc_id", SPEC, {"n_chars": "robust"}, Config(learning_rate=RATE))
    return model.cv_summary(folds)
