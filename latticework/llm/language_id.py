"""Language ID by words first, then by shorter and shorter character n-grams.

The model has the log frequency of each known word per language, and of the n-grams (4, 3, 2, 1 characters, with the word's
rim marked) of those words. A known word adds its log frequencies; an unseen word adds the mean over its known
4-grams, or, if it has none, 3-grams, and so on. The language with the highest sum wins; the score is its share
after a softmax of the mean per word, scaled by at most `SURE` words.

Bound (a documented parameter): the model is fitted on `FIT_DOCS` different labelled rows at most, those of the lowest hashes of id, text and language, and knows all their words;
so what is broadcast does not grow with the corpus. Prediction reads whole texts.

Defined results: a null text, or one without letters, is `und` with score 0; a null lang is not learned; no labelled
documents at all give `und` for all; of languages with equal sums the first by name is taken; texts of any length are read whole; an empty table
gives no rows; repeated rows and null ids give a row each; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

FIT_DOCS = 6_000
LONGEST = 4
SURE = 12
#: Entries of a task's table of unseen words.
KEPT = 200_000
WORD = r"\p{L}+"
_word = regex.compile(WORD)


def held_out(id_col="doc_id"):
    """True for the rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


class Model:
    """Log frequencies of words and n-grams, a row of languages each."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        self.langs = sorted({lang for lang, _, _ in rows})
        at = {x: k for k, x in enumerate(self.langs)}
        counts: dict[str, np.ndarray] = {}
        grams: list[dict[str, np.ndarray]] = [{} for _ in range(LONGEST + 1)]
        for lang, word, n in rows:
            counts.setdefault(word, np.zeros(len(at)))[at[lang]] += n
        for word, n in counts.items():
            for size in range(1, LONGEST + 1):
                for g in self.grams(word, size):
                    own = grams[size].setdefault(g, np.zeros(len(at)))
                    own += np.sqrt(n)  # a few very frequent words must not rule the n-grams
        # names and one matrix each: what is broadcast are a few arrays
        self.words, self.logs = self._logs(counts)
        self.parts = [self._logs(x) for x in grams]
        self.index: list[dict[str, int]] | None = None
        self.none = np.zeros(len(at), np.float32)

    @staticmethod
    def grams(word: str, size: int) -> list[str]:
        marked = f"^{word}$"
        return [marked[k : k + size] for k in range(len(marked) - size + 1)] if size > 1 else list(word)

    def _logs(self, counts: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
        if not counts:
            return [], np.zeros((0, len(self.langs)), np.float32)
        table_ = np.array(list(counts.values()))
        logs = np.log((table_ + 0.5) / (table_.sum(0) + 0.5 * len(table_))).astype(np.float32)
        # what all languages share says nothing and would only weigh long texts
        return list(counts), logs - logs.max(1, keepdims=True)

    def unseen(self, word: str) -> np.ndarray:
        if self.index is None:
            self.index = [{g: k for k, g in enumerate(names)} for names, _ in self.parts]
        for size in range(LONGEST, 0, -1):
            own = self.index[size]
            known = [own[g] for g in self.grams(word, size) if g in own]
            if known:
                return self.parts[size][1][known].mean(0) * np.float32(2)
        return self.none


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on labelled rows; `docs` holds none that is held out."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    hashed = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.lit(11), F.col(id_col), F.col(text_col), F.col(lang_col)).alias("h"))
    last = hashed.select("h").distinct().orderBy("h").limit(FIT_DOCS).agg(F.max("h")).first()[0]
    chosen = hashed.where(F.col("h") <= F.lit(last).cast("long")).groupBy("h").agg(F.first("text").alias("text"), F.first("lang").alias("lang"))  # equal rows count once
    words = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("word"))
    rows = words.groupBy("lang", "word").count().toArrow().sort_by([("word", "ascending"), ("lang", "ascending")])
    return Model(list(zip(rows["lang"].to_pylist(), rows["word"].to_pylist(), rows["count"].to_pylist())))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row; only the text decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        # rows of a matrix: known words first, then the unseen ones met so far
        index: dict[str, int] = {}
        matrix = np.zeros((len(m.words) + KEPT + 1, max(len(m.langs), 1)), np.float32)

        def learn_known() -> None:
            index.clear()
            index.update(zip(m.words, range(len(m.words))))
            if m.words:
                matrix[: len(m.words)] = m.logs

        def at(word: str) -> int:
            if len(index) >= len(matrix) - 1:
                learn_known()
            index[word] = k = len(index)
            matrix[k] = m.unseen(word)
            return k

        learn_known()
        for b in it:
            langs, scores = [], []
            for t in b.column(1).to_pylist():
                found = Counter(_word.findall(t.lower())) if t and m.langs else None
                if not found:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                logs = np.zeros(len(m.langs), np.float64)
                words = list(found)
                for p in range(0, len(words), 10_000):  # a table that is emptied half-way must not mix its rows
                    part = words[p : p + 10_000]
                    if len(index) + len(part) >= len(matrix):
                        learn_known()
                    rows = [index[w] if w in index else at(w) for w in part]
                    logs += np.array([found[w] for w in part], np.float64) @ matrix[rows]
                n = sum(found.values())
                p = logs / n * min(n, SURE)
                p = np.exp(p - p.max())
                best = int(p.argmax())
                langs.append(m.langs[best])
                scores.append(float(p[best] / p.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(batches, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
