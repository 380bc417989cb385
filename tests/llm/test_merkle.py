"""The manifest against a plain loop over the same rows, proofs folded by hashlib."""

import hashlib
import random

import duckdb
import pytest

from pyspark.sql import functions as F

from latticework.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, g string, path int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text=None):
    values = [row[0], row[3], row[2], row[4], row[1] if text is None else text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(digests, arity):
    """Top digest and, per leaf, the siblings of each level as (left, right)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for k, path in enumerate(paths):
            run = level[at[k] // arity * arity :][:arity]
            s = at[k] % arity
            path.append(("".join(run[:s]), "".join(run[s + 1 :])))
            at[k] //= arity
        level = [H(*level[k : k + arity]) for k in range(0, len(level), arity)]
    return level[0], paths


def brute(rows, arity):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: sorted((r[0] is not None, r[0] or 0, leaf(r)) for r in groups[g]) for g in names}
    tops = {g: climb([x[2] for x in trees[g]], arity) for g in names}
    root, upper = climb([tops[g][0] for g in names], arity)
    return sorted((str(x[1]) if x[0] else "None", x[2], tops[g][0], root, str(tops[g][1][k] + upper[i])) for i, g in enumerate(names) for k, x in enumerate(trees[g]))


def rows_of(n, seed=1):
    rng = random.Random(seed)
    texts = [None, "", "é Ünï ZZ", "A" * 300_000, "plain text"]
    sources = [None, "", "hot", "hot", "hot", "é", "z", "Z", "lone"]
    out = [(rng.choice([None, *range(n)]), rng.choice(texts), rng.choice([None, "en"]), rng.choice(sources[:-1]), rng.choice([None, 5]), "x", "y", 1) for _ in range(n)]
    return out + [(7, "one", "en", "lone", 3, "x", "y", 1)] + out[:3]


@pytest.mark.parametrize(("n", "arity"), [(300, 16), (40, 2), (60, 3), (1, 16)])
def test_against_loop(spark, n, arity):
    rows = rows_of(n)
    found = M.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), "source", "doc_id", M.FIELDS, arity=arity).collect()
    got = sorted((str(r.id), r.leaf, r.subroot, r.root, str([(x.left, x.right) for x in r.path])) for r in found)
    assert got == brute(rows, arity)
    for r in found:
        d = r.leaf
        for x in r.path:
            d = H(x.left, d, x.right)
        assert d == r.root


def test_one_group_and_none(spark):
    rows = [(k, f"t{k}", None, None, k, "x", "y", 1) for k in range(17)]
    found = M.manifest(spark.createDataFrame(rows, SCHEMA), "source", "doc_id", M.FIELDS).collect()
    assert {r.root for r in found} == {r.subroot for r in found} and len(found) == 17
    assert [len(r.path) for r in sorted(found, key=lambda r: r.id)] == [2] * 17  # the last run has one node
    assert M.manifest(spark.createDataFrame([], SCHEMA), "source", "doc_id", M.FIELDS).collect() == []


def test_query_with_odd_rows(spark, tmp_path):
    """Nulls, repeated rows and ids, long texts, clashing names: the same as the SQL; changed texts are found, others are not accused."""
    spark.createDataFrame(rows_of(200, 5), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(str, map(tuple, M.query(spark, str(tmp_path)).select(*cols).collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(map(str, con.sql(M.SQL).select(*map(duckdb.ColumnExpression, cols)).fetchall()))
    assert "False" in str(got) and "True" in str(got)


def test_real_documents(spark, sf_dir):
    done = M.query(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0) & F.col("text").rlike("[A-Z]")
    wrong = done.join(docs.select("doc_id", changed.alias("changed")), "doc_id").where("verified = changed")
    assert wrong.count() == 0 and done.count() == docs.count()
