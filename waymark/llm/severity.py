"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade >= k) = sigmoid(w.x - t_k) with one weight vector and ordered thresholds t_1 < t_2
< ...; x marks which words of a learned vocabulary a text holds. The result is the
expected grade, the sum of these probabilities.

Labels are binary, so training grades come from them: 0 for a clean document; a toxic one
has 1, 2 or 3 by the tertile of its number of vocabulary words that toxic documents favour.
"""

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Scratch, slices, without

GRADES = 4
TOKEN = re.compile(r"\w+")


def words_of(text: str | None) -> set[str]:
    return set(TOKEN.findall(text.lower())) if text else set()


class Model(NamedTuple):
    words: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, text: str | None) -> tuple[float, float]:
        """(expected grade, probability of grade 1 or more)."""
        at = [self.words[w] for w in self.words.keys() & words_of(text)]
        p = 1 / (1 + np.exp(self.thresholds - np.sort(self.weights[at]).sum()))
        return float(p.sum()), float(p[0])


def _word_rows(docs: DataFrame) -> DataFrame:
    """(word, toxic) for each distinct word of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            each = [sorted(words_of(t)) for t in part.column(0).to_pylist()]
            at = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in each]))
            yield pa.RecordBatch.from_arrays([pa.array([w for x in each for w in x], pa.string()), part.column(1).take(at)], names=["word", "toxic"])

    return docs.select("text", "toxic").mapInArrow(run, "word string, toxic int")


def _loss(eta: np.ndarray, t: np.ndarray, grade: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean of -log P(grade), and its slopes by eta and by the thresholds.

    With a_k = P(grade >= k), a_0 = 1 and a_GRADES = 0, a row of grade y has the probability
    a_y - a_(y+1); so the slope by eta is a_y + a_(y+1) - 1, and each threshold at the edge of
    its grade moves that edge alone.
    """
    n, rows = len(eta), np.arange(len(eta))
    inner = 1 / (1 + np.exp(np.clip(t - eta[:, None], -40, 40)))
    a = np.hstack([np.ones((n, 1)), inner, np.zeros((n, 1))])
    low, high = a[rows, grade], a[rows, grade + 1]
    p = np.maximum(low - high, 1e-15)
    edge = a * (1 - a)
    g_t = np.zeros(GRADES + 1)
    np.add.at(g_t, grade, edge[rows, grade] / p / n)
    np.add.at(g_t, grade + 1, -edge[rows, grade + 1] / p / n)
    return float(-np.log(p).mean()), (low + high - 1) / n, g_t[1:-1]


def _fit(at: list[list[int]], grade: np.ndarray, size: int, l2: float = 1e-4, steps: int = 800) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that make the grades likeliest: gradient steps with per-weight scaling, shorter towards the end."""
    row = np.repeat(np.arange(len(at)), [len(x) for x in at])
    col = np.array([i for x in at for i in x], np.int64)
    w, first, gaps = np.zeros(size), 1.0, np.zeros(GRADES - 2)
    moment, scale = np.zeros(size + GRADES - 1), np.zeros(size + GRADES - 1)
    for step in range(1, steps + 1):
        t = first + np.r_[0, np.cumsum(np.exp(gaps))]
        eta = np.bincount(row, w[col], len(at))
        _, g_eta, g_t = _loss(eta, t, grade)
        g_gaps = np.array([g_t[k + 1 :].sum() for k in range(GRADES - 2)]) * np.exp(gaps)
        g = np.r_[np.bincount(col, g_eta[row], size) + l2 * w, g_t.sum(), g_gaps]
        moment = 0.9 * moment + 0.1 * g
        scale = 0.99 * scale + 0.01 * g * g
        move = 0.1 * (1 - step / (steps + 1)) * (moment / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.99**step)) + 1e-9)
        w, first, gaps = w - move[:size], first - move[size], gaps - move[size + 1 :]
    return w, first + np.r_[0, np.cumsum(np.exp(gaps))]


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, vocabulary: int = 512, min_g2: float = 15.0) -> Model:
    """Fit on at most `max_labelled` labelled documents, those with the smallest hash of the id.

    Their ids are chosen first and sent to the tasks (8 bytes each), so no text of the others
    is shuffled; the sample is written once and read by each step.

    The vocabulary are the words, in five or more of them, most unevenly spread over toxic
    and clean ones (G2 statistic). Labels of unknown documents and null labels are ignored.
    Without both kinds of label every severity is 0.
    """
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull())
    scratch = Scratch(docs.sparkSession, "severity")
    marks = scratch.write(marks.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_labelled))
    sample = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    sample = scratch.write(sample)
    total = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    if not bad or not good:
        return Model({}, np.zeros(0), np.full(GRADES - 1, np.inf))
    n = F.lit(bad + good).cast("double")
    counts = _word_rows(sample).groupBy("word").agg(F.sum("toxic").alias("p"), F.count("*").alias("c")).where("c >= 5")
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    p, c = F.col("p").cast("double"), F.col("c").cast("double")
    g2 = 2 * (part(p, c * bad / n) + part(c - p, c * good / n) + part(bad - p, (n - c) * bad / n) + part(good - c + p, (n - c) * good / n))
    found = counts.withColumn("g2", g2).where(F.col("g2") >= min_g2).orderBy(F.desc("g2"), "word").limit(vocabulary).collect()
    words = {r["word"]: i for i, r in enumerate(found)}
    favoured = np.array([r["p"] * good > (r["c"] - r["p"]) * bad for r in found], bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            at = [sorted(words[w] for w in words.keys() & words_of(t)) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), part.column(1)], names=["at", "toxic"])

    rows = sample.mapInArrow(run, "at array<int>, toxic int").collect()  # bounded: max_labelled rows, vocabulary entries
    rows = sorted((r["toxic"], r["at"]) for r in rows)
    toxic = np.array([r[0] for r in rows])
    hits = np.array([int(favoured[r[1]].sum()) for r in rows])
    low, high = np.quantile(hits[toxic == 1], [1 / 3, 2 / 3])
    grade = np.where(toxic == 1, 1 + (hits > low) + (hits > high), 0)
    return Model(words, *_fit([r[1] for r in rows], grade, len(words)))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds `severity` (expected grade, 0 to 3) and `toxic` (grade 1 or more is likelier than not) to `docs`.

    Whole texts; a null or empty text scores like one without any vocabulary word. Columns
    of these names are replaced. No shuffle.
    """
    base = without(docs, "severity", "toxic")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            got = [model.severity(t) for t in part.column(part.schema.get_field_index(text)).to_pylist()]
            more = [pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] >= 0.5 for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "severity", "toxic"])

    return base.mapInArrow(run, f"{schema}, severity double, toxic boolean")
