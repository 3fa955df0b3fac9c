"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Texts are lower-cased, runs of anything but letters become one blank, and n-grams of one to three characters are hashed
to ``FEATURES`` places. Document frequencies are counted over all training documents. The weights are fitted on a
bounded sample (``PER_LANGUAGE`` documents of each language) by follow-the-regularised-leader with elastic-net
penalties; a part of the sample that the fit doesn't see calibrates the temperature of the probabilities.

Defined results: ``und`` with score 0 for a null text, a text without a letter, and if there is nothing to learn from;
a null doc_id is never learned from; columns named score or lang_pred are replaced; repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import table

FEATURES = 2**15
ORDERS = (1, 2, 3)
#: The fit sees at most so many documents of a language, of which one in CALIBRATE serves for calibration alone.
PER_LANGUAGE, CALIBRATE = 500, 5
#: Languages that are learned at most, the most frequent first: with them the model has a bound.
LANGUAGES = 256
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.5
UNKNOWN = "und"
PREDICTION = "lang_pred string, score double"
#: A document whose most likely language has less than this is rejected by the pipeline.
REJECT_BELOW = 0.3


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def _counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of a text's n-grams; empty if it has no letter."""
    none = np.zeros(0, np.int32), np.zeros(0, np.float32)
    if not text:
        return none
    c = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return none
    keep = letter.copy()
    keep[:-1] |= letter[1:]  # one blank before each run of letters
    c = np.where(letter, c, 32)[keep].astype(np.uint64)
    c = np.r_[np.uint64(32), c, np.uint64(32)]
    total = np.zeros(FEATURES, np.int64)
    h = np.zeros(len(c), np.uint64)
    for n in ORDERS:
        h = h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(n)
        mixed = h * np.uint64(0xBF58476D1CE4E5B9)
        total += np.bincount((mixed >> np.uint64(64 - 15)).astype(np.int64), minlength=FEATURES)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at].astype(np.float32)


def _weigh(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(count)) * idf[at]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequency of each place over all rows, and their number; FEATURES rows reach the driver at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            for t in b.column(0):
                at, _ = _counts(t.as_py())
                total[at] += 1
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1].astype(np.int32)), pa.array(np.r_[total[at], n])], names=["at", "n"])

    rows = docs.select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(FEATURES + 1, np.int64)
    df[rows.column("at").to_numpy()] = rows.column("n").to_numpy()  # -1 is the last place
    return df[:-1], int(df[-1])


class Model:
    """Languages, weights (a row a language), biases, temperature and inverse document frequencies."""

    def __init__(self, languages: list[str], idf: np.ndarray):
        self.languages, self.idf = languages, idf
        self.z = np.zeros((len(languages), FEATURES + 1))
        self.n = np.zeros_like(self.z)
        self.temperature = 1.0
        self.weights: np.ndarray | None = None

    def _w(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        """One step of follow the regularised leader on the places that the document has, bias included."""
        at, x = np.r_[at, FEATURES], np.r_[x, 1.0]
        w = self._w(at)
        p = softmax(w @ x)
        p[y] -= 1
        g = p[:, None] * x
        n = self.n[:, at]
        self.z[:, at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[:, at] = n + g * g

    def finish(self) -> None:
        self.weights = self._w(np.arange(FEATURES + 1)).astype(np.float32)
        del self.z, self.n

    def logits(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.weights[:, at] @ _weigh(at, count, self.idf) + self.weights[:, FEATURES]

    def calibrate(self, held: list[tuple[np.ndarray, int]]) -> None:
        """The temperature with the least log loss on documents that the fit hasn't seen, by golden sections.

        The truth counts as (n + 1) / (n + 2), n documents being seen, so that a sample without errors doesn't ask for 0.
        """
        if not held:
            return
        scores, truth = np.array([s for s, _ in held]), np.array([y for _, y in held])

        n, k = scores.shape
        target = np.full((n, k), 1 / (n + 2) / max(1, k - 1))
        target[np.arange(n), truth] = (n + 1) / (n + 2) if k > 1 else 1.0

        def loss(log_t: float) -> float:
            s = scores / np.exp(log_t)
            s -= s.max(axis=1, keepdims=True)
            return float(np.mean(np.log(np.exp(s).sum(axis=1)) - (target * s).sum(axis=1)))

        lo, hi, g = np.log(0.05), np.log(20), (np.sqrt(5) - 1) / 2
        for _ in range(40):
            a, b = hi - g * (hi - lo), lo + g * (hi - lo)
            lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
        self.temperature = float(np.exp((lo + hi) / 2))

    def predict(self, text: str | None) -> tuple[str, float]:
        at, count = _counts(text)
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(at, count) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(min(1.0, p[k]))


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max())
    return e / e.sum()


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(training: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model from rows with doc_id, text and lang. Nothing but the sample's n-gram counts reaches the driver."""
    training = training.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    most = training.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    totals = {r["lang"]: r["count"] for r in most.collect()}
    if not totals:
        return Model([], np.zeros(FEATURES))
    df, n = document_frequencies(training)
    idf = np.log((1 + n) / (1 + df)) + 1
    model = Model(sorted(totals), idf)
    share = F.create_map(*[x for k, v in sorted(totals.items()) for x in (F.lit(k), F.lit(min(1.0, per_language / v)))])[F.col("lang")]
    chance = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(3)), F.lit(1_000_000)) / 1_000_000
    training = training.filter(F.col("lang").isin(*totals))
    sample = training.filter(chance < share).select("doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counted = [_counts(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([a for a, _ in counted], pa.list_(pa.int32())), pa.array([c for _, c in counted], pa.list_(pa.float32()))], names=["doc_id", "lang", "at", "n"])

    rows = sample.mapInArrow(run, "doc_id long, lang string, at array<int>, n array<float>").toArrow()
    rng = np.random.default_rng(5)
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    order = order[rng.permutation(len(order))]
    place = {k: i for i, k in enumerate(model.languages)}
    langs = rows.column("lang").to_pylist()
    seen: dict[str, int] = dict.fromkeys(place, 0)
    fitted, apart = [], []
    for i in order.tolist():
        at = rows.column("at")[i].values.to_numpy()
        if not len(at) or seen[langs[i]] >= per_language:
            continue
        seen[langs[i]] += 1
        (apart if seen[langs[i]] % CALIBRATE == 0 else fitted).append((at, rows.column("n")[i].values.to_numpy(), place[langs[i]]))
    weighed = [(at, _weigh(at, c, idf), y) for at, c, y in fitted]
    for _ in range(EPOCHS):
        for k in rng.permutation(len(weighed)).tolist():
            model.learn(*weighed[k])
    model.finish()
    model.calibrate([(model.logits(at, c), y) for at, c, y in apart])
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs (which has a text) with lang_pred and score. The model is bounded by languages x FEATURES."""
    docs = docs.drop("lang_pred", "score")
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            found = [m.predict(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, {PREDICTION}")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows of docs with held_out, lang_pred and score; learned from the rows that are not held out."""
    return predict(docs.withColumn("held_out", held_out()), fit(docs.filter(~held_out()).select("doc_id", "text", "lang"), per_language))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit(docs.filter(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
