"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from porescreen.llm.common import text_of

#: The model is fitted on so many labelled documents at most, those with the smallest hash of their id.
FIT_ROWS = 8000
BUCKETS = 1 << 18
#: Terms have a weight if they are in so many fitted documents, and if their shares among toxic and other ones differ
#: by so many standard errors; without this the many terms of a long text are learnt by heart.
LEAST_DOCUMENTS, LEAST_ERRORS = 3, 3.0
FACTORS, EPOCHS, BATCH, RATE, DECAY, SEED = 4, 12, 64, 0.1, 1e-4, 7
THRESHOLD = 0.3
_WORDS = re.compile(r"\w+").findall


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def word_terms(word: str) -> tuple[int, ...]:
    """Hashed terms of a word: itself and its first letters, which tell forms of a word that were not fitted."""
    terms = {"w " + word, *(f"{n} {word[:n]}" for n in (3, 4, 5) if len(word) > n)}
    return tuple(sorted(zlib.crc32(t.encode("utf-8", "replace")) % BUCKETS for t in terms))


def text_terms(text: str, known: dict[str, tuple[int, ...]]) -> np.ndarray:
    """The distinct terms of a whole text; ``known`` remembers words and is emptied when it is large."""
    found = []
    for word in set(_WORDS(text.lower())):
        terms = known.get(word)
        if terms is None:
            if len(known) > 300_000:
                known.clear()
            terms = known[word] = word_terms(word)
        found += terms
    return np.unique(np.array(found, np.int64))


class FactorizationMachine:
    """logit = b + sum of w[i] + sum over pairs of v[i].v[j], over the terms i, j that a text holds."""

    def __init__(self, terms: np.ndarray, bias: float):
        self.terms, self.bias = terms, bias
        self.w = np.zeros(len(terms))
        self.v = np.random.default_rng(SEED).normal(0, 0.01, (len(terms), FACTORS))

    def columns(self, terms: np.ndarray) -> np.ndarray:
        """Places of those terms that have weights."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return at[self.terms[at] == terms] if len(self.terms) else at[:0]

    def logit(self, at: np.ndarray) -> float:
        v = self.v[at]
        return self.bias + self.w[at].sum() + 0.5 * (v.sum(axis=0) ** 2 - (v * v).sum(axis=0)).sum()

    def fit(self, rows: list[np.ndarray], labels: np.ndarray) -> None:
        """Logistic loss by AdaGrad; the order of the rows is fixed by the seed."""
        order, sums = np.random.default_rng(SEED), [np.full_like(self.w, 1e-8), np.full_like(self.v, 1e-8), 1e-8]
        for _ in range(EPOCHS):
            for batch in np.array_split(order.permutation(len(rows)), max(1, len(rows) // BATCH)):
                used = [rows[i] for i in batch]
                flat, inverse = np.unique(np.concatenate(used), return_inverse=True)
                owner = np.repeat(np.arange(len(used)), [len(u) for u in used])
                v = self.v[flat][inverse]
                total = np.stack([np.bincount(owner, v[:, f], len(used)) for f in range(FACTORS)], axis=1)
                squares = np.bincount(owner, (v * v).sum(axis=1), len(used))
                logits = self.bias + np.bincount(owner, self.w[flat][inverse], len(used)) + 0.5 * ((total**2).sum(axis=1) - squares)
                slope = 1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels[batch]
                pull = slope[owner]
                gw = np.bincount(inverse, pull, len(flat)) + DECAY * self.w[flat]
                inner = pull[:, None] * (total[owner] - v)
                gv = np.stack([np.bincount(inverse, inner[:, f], len(flat)) for f in range(FACTORS)], axis=1) + DECAY * self.v[flat]
                sums[0][flat] += gw * gw
                sums[1][flat] += gv * gv
                sums[2] += slope.sum() ** 2
                self.w[flat] -= RATE * gw / np.sqrt(sums[0][flat])
                self.v[flat] -= RATE * gv / np.sqrt(sums[1][flat])
                self.bias -= RATE * slope.sum() / np.sqrt(sums[2])


def telling_terms(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The terms whose presence tells toxic from other documents beyond chance."""
    terms, n = np.unique(np.concatenate(rows), return_counts=True)
    toxic = np.zeros(len(terms))
    found, hits = np.unique(np.concatenate([r for r, y in zip(rows, labels) if y]), return_counts=True)
    toxic[np.searchsorted(terms, found)] = hits
    ones, zeros = labels.sum(), len(labels) - labels.sum()
    share = n / len(labels)
    error = np.sqrt(share * (1 - share) * (1 / ones + 1 / zeros))
    apart = np.abs(toxic / ones - (n - toxic) / zeros) >= LEAST_ERRORS * error
    return terms[(n >= LEAST_DOCUMENTS) & apart & (error > 0)].astype(np.int64)


def _terms_in_tasks(batches):
    known = {}
    for batch in batches:
        terms = [text_terms(t, known).astype(np.int32).tobytes() for t in text_of(batch)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("toxic"), pa.array(terms, pa.binary())], ["doc_id", "toxic", "terms"])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> FactorizationMachine:
    """Fit on at most ``fit_rows`` labelled documents that are not held out; only ``toxic`` and the text are read.

    Labels that are null or neither 0 nor 1 are left out; of several labels of a document the largest counts, of
    several rows of a document any one. Without labels of both kinds the model is a constant.
    """
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    chosen = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
    fitted = texts.mapInArrow(_terms_in_tasks, "doc_id long, toxic int, terms binary").dropDuplicates(["doc_id"])
    found = sorted(fitted.collect(), key=lambda r: r["doc_id"])
    y = np.array([r["toxic"] for r in found], float)
    if not len(y) or y.min() == y.max():
        return FactorizationMachine(np.zeros(0, np.int64), _log_odds(y.sum() / (len(y) + 1.0)))
    terms = [np.frombuffer(r["terms"], np.int32) for r in found]
    model = FactorizationMachine(telling_terms(terms, y), _log_odds(y.mean()))
    model.fit([model.columns(t.astype(np.int64)) for t in terms], y)
    return model


def _log_odds(share: float) -> float:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return float(np.log(share / (1 - share)))


def with_scores(docs: DataFrame, model: FactorizationMachine, text_column: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, 0 to 1; null texts score as empty ones, by the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS terms at most

    def run(batches):
        machine, known = shared.value, {}

        def places(word):
            at = known.get(word)
            if at is None:
                if len(known) > 300_000:
                    known.clear()
                at = known[word] = tuple(machine.columns(np.unique(np.array(word_terms(word), np.int64))).tolist())
            return at

        for batch in batches:
            scores = []
            for text in text_of(batch, text_column):
                at = {p for word in set(_WORDS(text.lower())) for p in places(word)}
                logit = machine.logit(np.array(sorted(at), np.int64))
                scores.append(float(1 / (1 + np.exp(-np.clip(logit, -500, 500)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, `{name}` double")


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, also of repeated ones and those without an id."""
    scored = with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not predicted toxic, with their columns."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return with_scores(docs, fit(docs, labels), name=name).where(F.col(name) < threshold).drop(name)
