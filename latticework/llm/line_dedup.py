"""Line dedup by a template tree of fixed depth (built-in column functions only).

Every line descends a tree: its token count, its `DEPTH` leading tokens (variable tokens as `<*>`), then its leaf. The lines of a leaf are
split by the agreement of their other tokens: a line belongs to the template of its whole masked content, and to those in which one
of `SEGMENTS` equal parts of the rest (of single tokens, where there are no more) is a variable field. Lines that differ in that
field only share the template, whatever stands there; a template has three constant tokens at least, so lines of one to three tokens
have no field. A template that occurs in `min_docs` documents or more is recurring: its first occurrence (lowest doc_id, text hash, line number; documents without
an id in the order of another hash) stays, every other one is dropped, in all documents. Repeats inside one document only are left alone.
The pipeline's stage drops a document that has lost lines and has no word left.

Only fixed-size keys (95-bit hash, doc_id, text hash, line number) are shuffled to find templates, not line texts, and they are
pre-aggregated before the shuffle; the join with recurring keys has one row per key on its small side, so a very common line
is split by adaptive skew handling.

Defined results: a null text has no lines and stays null; an empty text stays empty; a document is a doc_id (null, too) with its
text, so different texts of one doc_id are different documents, and rows equal in both are one (their lines keep). All input columns are
returned, whatever their names (n_dropped gets `_` added if it is taken); texts that lose no line are returned unchanged; a line of any length is
one line; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, materialise, table, words_of

DEPTH = 2
SEGMENTS = 3
MIN_DOCS = 2
#: A token with a digit is variable.
VARIABLE = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"


def _keys(line, depth: int):
    """Template keys of a line, 95 bits each: the exact one, then one per variable segment. 5e12 keys of a web-sized corpus have an equal pair by
    chance with probability 3e-4."""
    tokens = words_of(F.when(line.rlike("[0-9]"), F.regexp_replace(line, VARIABLE, "<*>")).otherwise(line))

    def key(seed: int, *parts):
        return F.struct(F.xxhash64(F.lit(seed), *parts).alias("k1"), F.xxhash64(F.lit(~seed), *parts).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("k2"))

    def of(t):
        n = F.size(t)
        rest = n - depth
        head = F.slice(t, 1, depth)

        parts = F.least(rest, F.lit(SEGMENTS))

        def segment(j: int):
            a, b = (F.floor(rest * k / parts).cast("int") for k in (j, j + 1))
            return key(j + 1, n, head, F.slice(t, depth + 1, a), F.slice(t, depth + 1 + b, rest - b))

        exact = key(0, t)
        wild = [F.array(exact, *[segment(j) for j in range(k)]) for k in range(SEGMENTS + 1)]
        out = F.when(n == 0, F.array().cast("array<struct<k1:bigint,k2:int>>")).when(n < max(4, depth + 1), wild[0])
        for k in range(1, SEGMENTS):
            out = out.when(rest == k, wild[k])
        return out.otherwise(wild[SEGMENTS])

    # every token is hashed once; the keys combine these numbers
    hashed = F.transform(tokens, lambda x: F.xxhash64(x))
    return F.get(F.transform(F.array(hashed), of), F.lit(0))


def _document(id_col: str, text_col: str) -> list[Column]:
    """What tells documents apart: the doc_id (another hash of the text where it is null) and a hash of the text."""
    text = F.col(text_col)
    return [F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.lit(1), text)).alias("d"), F.xxhash64(text).alias("m")]


def occurrences(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", depth: int = DEPTH) -> DataFrame:
    """d, m, line_no, k1, k2: the templates of each line."""
    lines = docs.select(*_document(id_col, text_col), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    keys = lines.where(F.length(F.trim("line")) > 0).select("d", "m", "line_no", F.explode(_keys(F.col("line"), depth)).alias("key"))
    return keys.select("d", "m", "line_no", "key.k1", "key.k2")


def recurring(occ: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """k1, k2, first: the templates that occur in min_docs documents or more, and where each occurs first."""
    first = F.min(F.struct("d", "m", "line_no")).alias("first")
    if min_docs == 2:  # the first place has the lowest d and, if there is only one d, the lowest m
        seen = occ.groupBy("k1", "k2").agg(first, F.max("d").alias("d"), F.max("m").alias("m"))
        return seen.where("d <> first.d OR m <> first.m").select("k1", "k2", "first")
    in_doc = occ.groupBy("k1", "k2", "d", "m").agg(F.min("line_no").alias("line_no"))
    return in_doc.groupBy("k1", "k2").agg(first, F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("k1", "k2", "first")


def dropped(occ: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """d, m, lines: the line numbers that each document loses."""
    hits = occ.join(recurring(occ, min_docs), ["k1", "k2"])
    away = (F.col("m") != F.col("first.m")) | (F.col("d") != F.col("first.d")) | (F.col("line_no") != F.col("first.line_no"))
    return hits.where(away).groupBy("d", "m").agg(F.collect_set("line_no").alias("lines"))


def dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_docs: int = MIN_DOCS, depth: int = DEPTH, n_as: str = "n_dropped") -> DataFrame:
    """The input with the dropped lines taken out of the text, plus n_as."""
    # read twice, by the search for templates and by the look-up of each line
    occ = materialise(occurrences(docs, text_col, id_col, depth), "line-keys")
    gone = dropped(occ, min_docs)
    d, m = _document(id_col, text_col)
    joined = docs.join(gone, (d == gone["d"]) & (m == gone["m"]), "left")
    lines, old = gone["lines"], docs[text_col]
    text = F.when(lines.isNull() | old.isNull(), old).otherwise(F.array_join(F.filter(F.split(old, "\n"), lambda x, i: ~F.array_contains(lines, i)), "\n"))
    out = [text.alias(text_col) if c == text_col else docs[c] for c in docs.columns]
    return joined.select(*out, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(free_name(docs.columns, n_as)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take recurring lines out of the texts; documents that lost lines and have no word left go."""
    done = dedup(docs)
    n = F.col(done.columns[-1])
    left = F.size(words_of(F.col("text"))) > 0
    out = done.where((n == 0) | left)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(n > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


SQL = r"""
WITH l AS (
  SELECT doc_id, g - 1 AS line_no, string_split(text, chr(10))[g] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS g FROM documents WHERE text IS NOT NULL)),
t AS (SELECT doc_id, line_no,
        regexp_extract_all(regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[^\x20\x09-\x0D]+') AS t FROM l),
n AS (SELECT *, len(t) AS n, len(t) - 2 AS r, least(len(t) - 2, 3) AS s FROM t WHERE len(t) >= 1),
k AS (
  SELECT doc_id, line_no, '-1|' || array_to_string(t, ' ') AS key FROM n
  UNION ALL
  SELECT doc_id, line_no, j || '|' || n || '|' || array_to_string(t[1:2], ' ') || '|'
      || array_to_string(t[3 : 2 + (r * j // s)], ' ') || '|' || array_to_string(t[3 + (r * (j + 1) // s) : n], ' ')
  FROM n, (SELECT unnest([0, 1, 2]) AS j) WHERE n >= 4 AND j < s),
f AS (SELECT key, min((doc_id, line_no)) AS first FROM k GROUP BY key HAVING min(doc_id) <> max(doc_id)),
g AS (SELECT DISTINCT k.doc_id, k.line_no FROM k JOIN f USING (key) WHERE (k.doc_id, k.line_no) <> f.first),
o AS (SELECT l.doc_id, string_agg(CASE WHEN g.doc_id IS NULL THEN line END, chr(10) ORDER BY line_no) AS text, count(g.doc_id) AS n_dropped
      FROM l LEFT JOIN g USING (doc_id, line_no) GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text, coalesce(n_dropped, 0)::BIGINT AS n_dropped
FROM documents d LEFT JOIN o USING (doc_id)
"""
