"""Line dedup by a log-template tree, in DataFrame functions only.

A line is compared by its shape: runs of digits are a variable field ("0"), white space between tokens is one blank.

1. Whole lines: a shape that stands in `min_docs` documents is a template, one of at least LONG_TOKENS tokens without
   digits from `long_min_docs` documents on, since no chance repeats so long a line.
2. The tree has a fixed depth: a line's number of tokens, then its leading tokens. As the leading tokens may hold a field
   themselves, a line with room for f fields is cut into f + 1 parts, and each part names a leaf: two lines that differ in
   at most f positions meet in one leaf at least.
3. In a leaf, a position with `min_docs` different tokens or more is open; there, a token becomes a wildcard unless most of
   the leaf's documents have it. The line with its wildcards, one to f of them, is a generalised template; it recurs if it
   stands in `min_docs` documents. Lines of fewer than 4 tokens have no room for fields, up to 5 tokens for one, up to 11
   for two, longer ones for three.
4. Every line of a recurring template is dropped but in the first document (smallest id) that has it, so the corpus loses
   no passage altogether.

Counts are combined by key before and after each shuffle, whatever the partitions; keys that hold many rows are salted.
Whole lines are named by 128 bits of hash, leaves and their tokens by 64; generalised templates are compared as text.

Edge cases: a null text stays null and has no lines; blank lines belong to no template and stay; texts are taken whole at
any length; documents with a null id are neither counted nor changed; of the lines of one row, equal ones count once, and
all are dropped or none; rows with the same id count one by one for whole lines, once for generalised templates, and are
treated alike; an empty table gives an empty result; extra columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsift.llm.common import cut, salted_join

MIN_DOCS = 5
#: Whole lines of at least so many tokens without digits recur from LONG_MIN_DOCS documents on.
LONG_TOKENS = 20
LONG_MIN_DOCS = 2
#: Fields that a line of at least so many tokens has room for.
FIELDS = {4: 1, 6: 2, 12: 3}
PARTS = 1 + max(FIELDS.values())
WILD = "\n"  # no token holds a line end


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def shapes_of(text: Column) -> Column:
    """The shape of each line of a text."""
    def split(plain: Column) -> Column:
        # most texts have only single blanks, and searches are cheaper than a pattern
        odd = F.contains(plain, F.lit("  ")) | F.contains(plain, F.lit("\t")) | F.contains(plain, F.lit("\x0b")) | F.contains(plain, F.lit("\x0c")) | F.contains(plain, F.lit("\r"))
        return F.transform(lines_of(F.when(odd, F.regexp_replace(plain, "[\\x09\\x0B-\\x0D ]+", " ")).otherwise(plain)), lambda x: F.trim(x))

    once = F.array(F.regexp_replace(F.coalesce(text, F.lit("")), "[0-9]+", "0"))  # a lambda's argument is computed once
    return F.get(F.transform(once, split), F.lit(0))


def n_tokens(shape: Column) -> Column:
    return F.octet_length(shape) - F.octet_length(F.replace(shape, F.lit(" "), F.lit(""))) + 1


def fields(n: Column) -> Column:
    out = F.lit(0)
    for least, room in FIELDS.items():
        out = F.when(n >= least, room).otherwise(out)
    return out


def edge(n: Column, i: Column) -> Column:
    """The number of tokens before part i."""
    return F.floor(n * i / (fields(n) + 1)).cast("int")


def leaf(shape: Column, n: Column, i: int) -> Column:
    """The leaf that part i of a line names; null if the line has no such part."""
    begin, end = edge(n, F.lit(i)), edge(n, F.lit(i + 1))
    part = F.call_function("substring_index", F.call_function("substring_index", shape, F.lit(" "), end), F.lit(" "), begin - end)
    return F.when((fields(n) > 0) & (fields(n) >= i), F.xxhash64(n, F.lit(i), part))


def spot(leaf: Column, at: Column, token: Column) -> Column:
    """A token at its place in a leaf."""
    return F.xxhash64(leaf, at, token)


def name(shape: Column) -> Column:
    return F.struct(F.xxhash64(shape).alias("a"), F.xxhash64(F.lit("b"), shape).alias("b"))


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, a, b, long, l0, l1, ...) for each shape of each document; texts are split here and once more where they change."""
    n, shape = F.col("n"), F.col("shape")
    each = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.explode(F.array_distinct(shapes_of(F.col("text")))).alias("shape")).where(shape != "").withColumn("n", n_tokens(shape))
    figures = F.when(F.contains(shape, F.lit("0")), F.regexp_count(shape, F.lit("0[^ ]*"))).otherwise(0)
    long = F.when(n >= LONG_TOKENS, n - figures >= LONG_TOKENS).otherwise(False)
    return each.select("doc_id", name(shape).alias("k"), long.alias("long"), *(leaf(shape, n, i).alias(f"l{i}") for i in range(PARTS))).select("doc_id", "k.*", "long", *(f"l{i}" for i in range(PARTS)))


def recurring(rows: DataFrame, min_docs: int, long_min_docs: int, merge: bool) -> DataFrame:
    """(doc_id, gone, near): names of whole lines that a document loses, and (a, b, n) of lines for the leaves.

    Lines in `min_docs` documents or more are near in their first document only, which is enough to know their text.
    """
    counted = cut(rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("long").alias("long"), *(F.max(f"l{i}").alias(f"l{i}") for i in range(PARTS))))
    again = (F.col("n") >= min_docs) | (F.col("long") & (F.col("n") >= long_min_docs))
    known = counted.where(again).select("a", "b", "n", "first", F.lit(False).alias("near"))
    if merge:
        leaves = counted.where("l0 is not null").select("a", "b", "n", F.when(again, F.col("first")).alias("first"), F.explode(F.array(*(f"l{i}" for i in range(PARTS)))).alias("leaf")).where("leaf is not null")
        crowded = cut(leaves.groupBy("leaf").agg(F.count("*").alias("lines")).where(F.col("lines") >= min_docs))
        found = salted_join(leaves, crowded, ["leaf"], "a", "lines").groupBy("a", "b").agg(F.max("n").alias("n"), F.max("first").alias("first"), F.lit(True).alias("near"))
        known = known.union(found).groupBy("a", "b").agg(F.max("n").alias("n"), F.max("first").alias("first"), F.max("near").alias("near"))
    hits = salted_join(rows.select("doc_id", "a", "b"), cut(known), ["a", "b"], "doc_id", "n")
    gone = F.col("doc_id") > F.col("first")
    near = F.col("near") & ((F.col("n") < min_docs) | (F.col("doc_id") == F.col("first")))
    return hits.where(F.coalesce(gone, F.lit(False)) | near).groupBy("doc_id").agg(F.collect_set(F.when(gone, F.struct("a", "b"))).alias("gone"), F.collect_set(F.when(near, F.struct("a", "b", "n"))).alias("near"))


def generalised(lines: DataFrame, min_docs: int) -> DataFrame:
    """(doc_id, more): shapes of lines that a document loses by generalised templates; from (doc_id, shape, n)."""
    each = lines.groupBy("shape").agg(F.max("n").alias("n")).withColumn("tokens", n_tokens(F.col("shape"))).withColumn("line", F.xxhash64("shape"))
    parts = [F.struct(F.lit(i).alias("i"), leaf(F.col("shape"), F.col("tokens"), i).alias("leaf")) for i in range(PARTS)]
    placed = each.select("line", "shape", "n", "tokens", F.explode(F.array(*parts)).alias("p")).select("line", "shape", "n", "tokens", "p.*").where("leaf is not null")
    crowded = cut(placed.groupBy("leaf").agg(F.count("*").alias("lines")).where(F.col("lines") >= min_docs))
    placed = salted_join(placed, crowded, ["leaf"], "line", "lines")
    outside = (F.col("at") < edge(F.col("tokens"), F.col("i"))) | (F.col("at") >= edge(F.col("tokens"), F.col("i") + 1))  # a leaf's own part is alike in its lines
    spots = placed.select("leaf", "i", "n", "tokens", F.posexplode(F.split("shape", " ", -1)).alias("at", "token")).where(outside)
    spots = spots.select("leaf", "n", "at", fields(F.col("tokens")).alias("room"), spot(F.col("leaf"), F.col("at"), F.col("token")).alias("token"))
    kinds = spots.groupBy("leaf", "at", "token").agg(F.sum("n").alias("docs"), F.count("*").alias("lines"), F.max("room").alias("room"))
    spread = kinds.groupBy("leaf", "at").agg(F.count("*").alias("kinds"), F.sum("docs").alias("whole"), F.max("docs").alias("top"), F.max_by("token", "docs").alias("token"), F.sum("lines").alias("lines"), F.max("room").alias("room"))
    usual = 2 * F.col("top") > F.col("whole")  # one token at most, which is no wildcard
    opened = spread.where(F.col("kinds") >= min_docs).groupBy("leaf").agg(F.max("room").alias("room"), F.max("lines").alias("lines"), F.count_if(~usual).alias("blind"), F.collect_list(F.struct("at", F.when(usual, F.col("token")).alias("usual"))).alias("open"))
    # where more positions than there is room for have no token that most documents have, every line has too many wildcards
    opened = cut(opened.where("blind <= room").select("leaf", "room", "lines", "open"))
    words = F.array(F.split("shape", " ", -1))  # a lambda's argument is computed once
    wild = lambda w: F.filter("open", lambda x: x["usual"].isNull() | (spot(F.col("leaf"), x["at"], F.get(w, x["at"])) != x["usual"]))
    holes = salted_join(placed.select("line", "leaf", "shape"), opened, ["leaf"], "line", "lines").select("line", "room", F.get(F.transform(words, wild), F.lit(0))["at"].alias("holes"))
    holes = holes.where((F.size("holes") > 0) & (F.size("holes") <= F.col("room"))).select("line", F.array_sort("holes").alias("holes")).distinct()
    masked = F.array_join(F.transform(F.split("shape", " ", -1), lambda t, at: F.when(F.array_contains("holes", at), WILD).otherwise(t)), " ")
    named = each.join(holes, "line").select("shape", masked.alias("template")).distinct()
    held = cut(lines.join(named, "shape").select("doc_id", "shape", "template", "n"))
    counted = held.groupBy("doc_id", "template").agg(F.max("n").alias("n")).groupBy("template").agg(F.count("*").alias("docs"), F.max("n").alias("n"), F.min("doc_id").alias("first"))
    templates = cut(counted.where(F.greatest("docs", "n") >= min_docs).select("template", "docs", "first"))
    lost = salted_join(held.select("doc_id", "shape", "template"), templates, ["template"], "doc_id", "docs").where(F.col("doc_id") > F.col("first"))
    return lost.groupBy("doc_id").agg(F.collect_set("shape").alias("more"))


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, long_min_docs: int = LONG_MIN_DOCS, merge: bool = True) -> DataFrame:
    """The input's columns with text shortened, and n_lines and n_dropped (long). Without merge, whole lines only."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)  # extra columns may have any names
    i, t = names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lost = recurring(cut(line_rows(texts)), min_docs, long_min_docs, merge)
    if merge:
        lost = cut(lost)
        own = F.col("k")
        match = F.filter("near", lambda x: (x["a"] == own["a"]) & (x["b"] == own["b"]))
        wanted = texts.join(lost.where(F.size("near") > 0).select("doc_id", "near"), "doc_id")
        lines = wanted.select("doc_id", "near", F.explode(F.array_distinct(shapes_of(F.col("text")))).alias("shape")).where("shape <> ''").withColumn("k", name(F.col("shape")))
        lines = lines.select("doc_id", "shape", F.get(match, F.lit(0))["n"].alias("n")).where("n is not null").distinct()
        more = generalised(cut(lines), min_docs)
        lost = lost.select("doc_id", "gone").join(more, "doc_id", "full")
    else:
        lost = lost.withColumn("more", F.array().cast("array<string>"))
    lost = lost.select(F.col("doc_id").alias("lost_id"), F.coalesce("gone", F.array().cast("array<struct<a:bigint,b:bigint>>")).alias("gone"), F.coalesce("more", F.array().cast("array<string>")).alias("more"))
    lost = lost.where((F.size("gone") > 0) | (F.size("more") > 0))
    joined = plain.join(lost, F.col(i).cast("long") == F.col("lost_id"), "left")
    dropped = lambda x: (x["shape"] != "") & (F.array_contains("gone", name(x["shape"])) | F.array_contains("more", x["shape"]))
    pairs = F.arrays_zip(lines_of(F.col(t)).alias("line"), shapes_of(F.col(t)).alias("shape"))
    left = F.when(F.col("lost_id").isNotNull(), F.transform(F.filter(pairs, lambda x: ~dropped(x)), lambda x: x["line"]))
    n_lines = F.when(F.col(t).isNull(), F.lit(0)).otherwise(F.size(lines_of(F.col(t))))
    out = joined.select(*names, left.alias("left"), n_lines.cast("long").alias("n_lines"))
    kept = {n: F.col(n) for n in names} | {t: F.when(F.col("left").isNull(), F.col(t)).otherwise(F.array_join("left", "\n"))}
    n_dropped = F.when(F.col("left").isNull() | F.col(t).isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("left"))
    return out.select(*(c.alias(docs.columns[k]) for k, c in enumerate(kept.values())), F.col("n_lines"), n_dropped.cast("long").alias("n_dropped"))


def digest(docs: DataFrame) -> DataFrame:
    """Per row doc_id, n_lines, n_dropped and the digest of the text that is left."""
    out = drop_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: DuckDB SQL for digest() over the documents table; leaves and tokens are compared as they are.
SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
    text IS NULL AS nil FROM documents
), s AS (
  SELECT *, trim(regexp_replace(regexp_replace(line, '[0-9]+', '0', 'g'), '[\x09\x0B-\x0D ]+', ' ', 'g'), ' ') AS shape FROM l
), u AS (SELECT DISTINCT doc_id, shape FROM s WHERE shape <> ''),
c AS (SELECT shape, string_split(shape, ' ') AS w, count(*) AS n, min(doc_id) AS first FROM u GROUP BY shape),
r AS (
  SELECT *, n >= 5 OR (n >= 2 AND len(list_filter(w, lambda x: NOT contains(x, '0'))) >= 20) AS again, len(w) AS k,
    CASE WHEN len(w) >= 12 THEN 4 WHEN len(w) >= 6 THEN 3 ELSE 2 END AS parts FROM c
), p AS (
  SELECT shape, w, n, k, parts, unnest(range(parts)) AS i FROM r WHERE k >= 4
), f AS (
  SELECT *, w[k * i // parts + 1:k * (i + 1) // parts] AS part FROM p
), t AS (
  SELECT shape, n, k, parts, i, part, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM f
), kinds AS (
  SELECT k, i, part, pos, token, sum(n) AS docs FROM t GROUP BY k, i, part, pos, token
), v AS (
  SELECT *, count(*) OVER (PARTITION BY k, i, part, pos) >= 5 AND 2 * docs <= sum(docs) OVER (PARTITION BY k, i, part, pos) AS wild FROM kinds
), m AS (
  SELECT t.shape, t.i, string_agg(CASE WHEN wild THEN chr(10) ELSE t.token END, ' ' ORDER BY t.pos) AS template
  FROM t JOIN v USING (k, i, part, pos, token) GROUP BY t.shape, t.i, t.parts HAVING count(*) FILTER (wild) BETWEEN 1 AND t.parts - 1
), h AS (SELECT DISTINCT u.doc_id, u.shape, m.template FROM u JOIN m USING (shape)),
g AS (SELECT template, min(doc_id) AS first FROM h GROUP BY template HAVING count(DISTINCT doc_id) >= 5),
x AS (
  SELECT h.doc_id, h.shape FROM h JOIN g USING (template) WHERE h.doc_id > g.first
  UNION SELECT u.doc_id, u.shape FROM u JOIN r USING (shape) WHERE r.again AND u.doc_id > r.first
)
SELECT s.doc_id, count(*) FILTER (NOT nil) AS n_lines, count(*) FILTER (x.shape IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(s.line, chr(10) ORDER BY s.pos) FILTER (x.shape IS NULL), '')) AS kept_sha256
FROM s LEFT JOIN x ON s.doc_id = x.doc_id AND s.shape = x.shape GROUP BY s.doc_id
"""
