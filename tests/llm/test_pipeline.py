"""The pipeline: stages in order, decisions take effect, brute force over a small fixture."""

import hashlib
import re

import corpus_pipeline
from latticework.llm import bpe, decontaminate, line_dedup, ngram_join, quality_rules
from latticework.llm.common import materialise
from latticework.llm.queries import ORACLE_SQL, QUERIES

from .test_ngram_join import brute


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "decontaminate", "bpe"]
    assert {f"op{k}" for k in range(1, 14)} == {n.split("_")[0] for n in QUERIES if n.startswith("op")} and set(ORACLE_SQL) <= set(QUERIES)


def test_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [" ".join(re.findall(r"[^\W_]+", r.text.lower())) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert 0 < len(out) < docs.count() and len({r.doc_id for r in out}) == len(out)

    kept = {r.doc_id for r in quality_rules.stage(spark, docs, sf_dir).collect()}
    book = {r.doc_id: r.failed for r in quality_rules.ledger(docs).collect()}
    assert kept == {k for k, failed in book.items() if not failed}

    one = materialise(quality_rules.stage(spark, docs, sf_dir), "test")
    two = materialise(line_dedup.stage(spark, one, sf_dir), "test")
    assert two.columns == docs.columns
    rows = {r.doc_id: r for r in two.collect()}
    lines = [x for r in rows.values() for x in set(r.text.split("\n")) if len(x.split()) >= 4]
    assert len(lines) == len(set(lines))

    ids = sorted(rows)
    _, label, _ = brute([rows[k].text for k in ids])
    three = materialise(ngram_join.stage(spark, two, sf_dir), "test")
    left = {r.doc_id: r for r in three.collect()}
    assert set(left) == {ids[k] for k in set(label)} and three.columns == docs.columns

    four = {r.doc_id: r for r in decontaminate.stage(spark, three, sf_dir).collect()}
    clean = lambda t: not any(b in " ".join(re.findall(r"[^\W_]+", t.lower())) for b in bench)
    assert all(clean(r.text) for r in four.values()) and set(four) <= set(left)
    assert {r.doc_id for r in out} == set(four)

    tok = bpe.tokenizer(bpe.public_path("word_bpe_49k.json"))
    for r in out[:50]:
        ids = tok.encode(four[r.doc_id].text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids == ids and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_stages_take_any_rows(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "plain words that make a text of more than twenty words so that the rules let it pass and go on to the next stage"
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", "x", "y", 0), (2, text, "en", "s", 1), (2, text, "en", "s", 1), (None, text, "en", "s", 1)], schema)
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, sf_dir), "test")


def test_different_texts_with_one_id_stay(spark):
    words = [f"{c}{k}" for c in "abcdef" for k in range(30)]
    one, two, three, four = (" ".join(words[k : k + 30]) for k in (0, 30, 60, 90))
    near = four + " and more"
    rows = [(None, one), (None, two), (7, three), (7, four), (8, near), (8, one), (None, one), (9, two + " then some")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 5):
        got = sorted((r.doc_id or 99, r.text) for r in ngram_join.stage(spark, docs.repartition(parts), "").collect())
        assert got == sorted([(8, one), (9, two + " then some"), (7, three), (7, four)])
    links = sorted((r.doc_id or 99, r.n_class_links) for r in ngram_join.join(docs).collect())
    assert links == [(7, 0), (7, 1), (8, 0), (8, 1), (9, 1), (99, 0), (99, 0), (99, 1)]
