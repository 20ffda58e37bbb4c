"""Toxicity by class-conditional Kneser-Ney models (operator 9).

Each class (toxic, ordinary) is an interpolated Kneser-Ney model over lower-cased words, a hierarchy of three levels:

    P_c(w) = max(N_c(w) - D_c, 0) / K_c  +  L_c P(w)       L_c = D_c T_c / K_c
    P(w)   = max(N(w) - D, 0) / K        +  L / (V + 1)    L   = D V / K

Counts are continuation counts: ``N_c(w)`` is the number of *texts* of class ``c`` that hold ``w``, however often, and ``N(w)``, the count of the
backoff that both classes share, is the number of *classes* that hold it (1 or 2). ``K`` are sums of counts, ``T_c`` and ``V`` numbers of
different words. The one word more that ``V + 1`` counts stands for all unknown ones. Each level's absolute discount is
estimated from its counts of counts, ``n1 / (n1 + 2 n2)``, and taken off every count. A rare expression thus rests on
the shared backoff, which says the same in both classes, while one in many texts of a class weighs by their number.

Evidence of a text is the difference of both log-likelihoods, normalised by length: over the whole text, and over its most toxic passage
of ``PASSAGE`` words. A logistic regression turns it into a score. It is fitted on the same texts that are counted, each
scored by the model without it (leave one out: its own words count one text less).

Contexts of words were tried and left out. With a bigram level P_c(w|u) over these, in which a context that one text alone
holds gives any chance pair a likelihood ratio of thousands, held-out rows of a 10,000-row table are told apart worse (README).
The model is learnt from at most ``max_docs`` labelled texts a class, which bounds it whatever the corpus.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.shared import materialize, ship

#: Labelled texts a class that the model learns from, those with the smallest hashes of their ids.
MAX_DOCS = 4000
#: Words of the passage that the evidence looks for.
PASSAGE = 1
#: Rows of counts that leave a Python worker at once.
SLICE = 1 << 17
FOLDS = 5
RIDGE = 1e-4

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of letters and non-ASCII bytes, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def hashed(text: str | None) -> np.ndarray:
    """The words' 64-bit hashes, by which counts are kept."""
    digest = xxhash.xxh3_64_intdigest
    found = words(text)
    return np.fromiter((digest(w) for w in found), np.uint64, len(found)).view(np.int64)


def discount(n1: float, n2: float) -> float:
    """From the numbers of words that are counted once and twice; half a word added to each keeps it between 0 and 1."""
    return (n1 + 0.5) / (n1 + 2 * n2 + 1.5)


@dataclass
class Model:
    """Counts of each known word by class (0 ordinary, 1 toxic), sorted by hash, what they add up to, and the regression."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros((2, 0), np.int32))
    total: tuple[float, float] = (1.0, 1.0)
    discounts: tuple[float, float] = (0.5, 0.5)
    rest: tuple[float, float] = (1.0, 1.0)
    shared_total: float = 1.0
    shared_discount: float = 0.5
    slopes: tuple[float, float] = (0.0, 0.0)
    offset: float = -20.0
    ratios: np.ndarray | None = None

    def shared(self, classes: np.ndarray) -> np.ndarray:
        """``P`` of words that so many classes hold."""
        v = len(self.keys)
        return np.maximum(classes - self.shared_discount, 0) / self.shared_total + self.shared_discount * v / self.shared_total / (v + 1)

    def likelihood(self, label: int, counts: np.ndarray, types_less: int = 0) -> np.ndarray:
        """``P_c`` of words with these counts (a row a class); ``types_less``: of how many words the class has lost one text."""
        own = np.maximum(counts[label] - self.discounts[label], 0) / max(self.total[label] - types_less, 1)
        return own + self.rest[label] * self.shared((counts > 0).sum(axis=0))

    def ratio(self, counts: np.ndarray, own: int | None = None, types: int = 0) -> np.ndarray:
        """Logarithms of toxic over ordinary likelihood; with ``own``, a text of that class and so many different words is not counted."""
        if own is not None:
            counts = counts.copy()
            counts[own] -= 1
        return np.log(self.likelihood(1, counts, types * (own == 1))) - np.log(self.likelihood(0, counts, types * (own == 0)))

    def prepare(self) -> Model:
        """Ratios of all known words; the last is that of unknown ones."""
        self.ratios = self.ratio(np.concatenate((self.counts, np.zeros((2, 1), np.int32)), axis=1)).astype(np.float32) if len(self.keys) else np.zeros(1, np.float32)
        return self

    def places(self, text: str | None) -> np.ndarray:
        """Of each word its place in the tables, that after the last one if it is unknown."""
        found = hashed(text)
        if not len(self.keys):
            return np.zeros(len(found), np.int64)
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        return np.where(self.keys[at] == found, at, len(self.keys))

    def evidence(self, text: str | None, own: int | None = None) -> tuple[float, float]:
        """Length-normalised difference of log-likelihoods of the text, and of its most toxic passage; an unknown word's for no words."""
        at = self.places(text)
        if not len(at):
            at = np.array([len(self.keys)])
            own = None
        each = self.ratios[at].astype(float) if own is None else self.ratio(self.counts[:, at], own, len(np.unique(at)))
        if len(each) <= PASSAGE:
            return float(each.mean()), float(each.mean())
        sums = np.cumsum(each)
        best = max(float(sums[PASSAGE - 1]), float((sums[PASSAGE:] - sums[:-PASSAGE]).max()))
        return float(each.mean()), best / PASSAGE

    def score(self, text: str | None) -> float:
        x = self.evidence(text)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slopes[0] * x[0] + self.slopes[1] * x[1] + self.offset))))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model may learn from; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, max_docs: int) -> tuple[DataFrame, dict[int, int]]:
    """``(toxic, body)`` of the sampled labelled rows, equal texts once; and each class's number of labelled rows."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg(F.max(label).cast("int").alias("l_class"))
    known = known.where(~held_out("l_id"))
    totals = {r["l_class"]: r["count"] for r in known.groupBy("l_class").count().collect()}
    order = (F.xxhash64("l_id"), F.col("l_id"))
    chosen = known.where("l_class = 1").orderBy(*order).limit(max_docs).union(known.where("l_class = 0").orderBy(*order).limit(max_docs))
    rows = docs.select(F.col(id_col).alias("d_id"), F.col(text).alias("body"))
    # at most 2 * max_docs ids of 12 bytes: a proven bound
    sampled = rows.join(F.broadcast(chosen), rows["d_id"] == chosen["l_id"]).where("body is not null")
    sampled = sampled.groupBy(F.xxhash64("body").alias("h"), F.length("body").alias("n")).agg(F.max("l_class").alias("toxic"), F.max_by("body", "d_id").alias("body"))
    return materialize(sampled.select("toxic", "body"), "toxicity-sample"), totals


def _count(sample: DataFrame) -> DataFrame:
    """``(w, o, t)``: in how many ordinary and toxic texts each word stands."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from veilframe.llm.toxicity import SLICE, hashed as cut

        for pdf in batches:
            stood = (Counter(), Counter())
            for toxic, body in zip(pdf["toxic"], pdf["body"], strict=True):
                stood[int(toxic)].update(np.unique(cut(body)).tolist())
            left = iter(stood[0].keys() | stood[1].keys())
            while part := list(islice(left, SLICE)):
                yield pd.DataFrame({"w": part, "o": [stood[0][w] for w in part], "t": [stood[1][w] for w in part]})

    return materialize(sample.mapInPandas(each, "w long, o long, t long").groupBy("w").agg(F.sum("o").cast("int").alias("o"), F.sum("t").cast("int").alias("t")), "toxicity-words")


def assemble(keys: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> Model:
    """The model of counts by word: sums and discounts of each level."""
    order = np.argsort(keys)
    counts = np.stack([ordinary, toxic]).astype(np.int32)[:, order]
    model = Model(keys=keys[order], counts=counts)
    total = counts.sum(axis=1, dtype=np.int64)
    model.total = tuple(float(max(x, 1)) for x in total)
    model.discounts = tuple(discount(float((c == 1).sum()), float((c == 2).sum())) for c in counts)
    model.rest = tuple(d * float((c > 0).sum()) / k if n else 1.0 for d, c, k, n in zip(model.discounts, counts, model.total, total, strict=True))
    classes = (counts > 0).sum(axis=0)
    model.shared_total = float(max(classes.sum(), 1))
    model.shared_discount = discount(float((classes == 1).sum()), float((classes == 2).sum()))
    return model.prepare()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_docs: int = MAX_DOCS) -> Model:
    """Learn from the labelled rows that are not held out.

    Without labelled texts of both classes there is nothing to compare: every score is 0 then, so that no text is rejected without evidence. Labels other than 0 and 1, null ids and null texts are left out; of several labels
    of an id, and of equal texts, the toxic one counts.
    """
    ship(docs.sparkSession)
    sample, totals = _sample(docs, labels, id_col, text, label, max_docs)
    n = {c: totals.get(c, 0) for c in (0, 1)}
    if not n[0] or not n[1]:
        return Model(offset=-500.0).prepare()
    # hashes and two counts of the words of a sample of bounded size reach the driver
    found = _count(sample).toPandas()
    model = assemble(found["w"].to_numpy(np.int64), found["o"].to_numpy(), found["t"].to_numpy())
    _calibrate(model, sample, n)
    return model


def _calibrate(model: Model, sample: DataFrame, n: dict[int, int]) -> None:
    """Logistic regression of the label on each sampled text's evidence by the model without that text.

    Rows weigh what their class has in the whole of the labels.
    """
    shared = sample.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def without_it(bodies: pd.Series, toxic: pd.Series) -> pd.Series:
        known = shared.value
        return pd.Series([list(known.evidence(x, int(y))) for x, y in zip(bodies, toxic, strict=True)], dtype="object")

    judged = sample.select("toxic", without_it("body", "toxic").alias("x")).collect()
    shared.unpersist()
    x, y = np.array([r["x"] for r in judged], float).reshape(-1, 2), np.array([r["toxic"] for r in judged], float)
    if not 0 < y.sum() < len(y):
        model.offset = -500.0
        return
    share = n[1] / (n[0] + n[1])
    model.offset = math.log(share / (1 - share))
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    middle, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([(x - middle) / scale, np.ones(len(x))])
    beta = np.array([0.0, 0.0, model.offset])
    ridge = np.array([RIDGE, RIDGE, 1e-6]) * len(x)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (y - p)) - ridge * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    slopes = np.maximum(beta[:2], 0.0) / scale
    model.slopes, model.offset = (float(slopes[0]), float(slopes[1])), float(beta[2] - slopes @ middle)


def toxicity_score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A column with the score (0 to 1) of every whole text; null and empty texts get that of an unknown word."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(bodies: pd.Series) -> pd.Series:
        known = shared.value
        return pd.Series([known.score(x) for x in bodies], dtype="float64")

    return score(F.col(text))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, held_out, score, predicted)``, a row for each row of ``docs``.

    Only id and text are read, so other columns may have any name. Repeated rows get equal scores; a very long text is scored whole, in
    time linear in its words; empty tables give empty ones.
    """
    model = train(docs, labels, id_col, text)
    scored = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), toxicity_score(docs, model, text).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
