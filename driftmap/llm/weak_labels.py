"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document. Documents are
counted by their votes, at most 3 ** labellers rows, and expectation-maximisation over these
counts, which cover all documents, estimates the share of good documents and how often each
labeller gives each vote on good and on bad ones; nothing is set by hand but a first guess,
the majority of a document's votes. The posterior of a document's votes is its label. A
logistic scorer on hashed words and word shapes is trained on a bounded sample of posterior
labels, in an order that follows from the texts, then scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmap.llm import words as w
from driftmap.llm.quality_rules import text_counts
from driftmap.llm.tables import settle

LABELLERS = ("symbols", "plain", "repeats", "echoes", "capitals", "shouts", "bars", "lines", "length", "word_length", "stops")
#: About this many documents, by hash, train the scorer.
TRAIN_DOCUMENTS = 8_000
DIMENSIONS = 1 << 14
#: EM ends when no posterior moves by more than this.
TOLERANCE = 1e-9
EPOCHS = 6
KEEP_SCORE = 0.5
GOOD, BAD, NONE = 1, 0, 2

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58] = 48
_CLASS[65:91] = 65
_CLASS[97:123] = 97
_CLASS[128:] = 97


def _above(value: np.ndarray, bad: float, good: float) -> np.ndarray:
    """Bad above the one limit, good below the other, no vote between them."""
    return np.where(value > bad, BAD, np.where(value < good, GOOD, NONE))


def votes(x: w.Words) -> np.ndarray:
    """A row of votes for each document, by the order of LABELLERS."""
    c = text_counts(x)
    n = np.maximum(c["n_words"], 1)
    per = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[x.bounds])
    by_word = lambda flags: np.bincount(x.doc[flags], minlength=len(n)) / n
    upper, lower = (x.data >= 65) & (x.data <= 90), (x.data >= 97) & (x.data <= 122)
    letters = np.concatenate([[0], np.cumsum(upper | lower | (x.data >= 128))])
    size, ends = x.end - x.start, x.data[x.end - 1] if len(x.end) else np.zeros(0, np.uint8)
    stop = (ends == 0x2E) | (ends == 0x2C)
    h = x.hashes(w.LOWER_VALUE)
    echo = np.zeros(len(h), bool)
    echo[1:] = (h[1:] == h[:-1]) & (x.doc[1:] == x.doc[:-1])
    chars = c["word_chars"] / n
    rows = (
        _above(c["n_symbols"] / n, 0.3, 0.05),
        _above(1 - by_word(letters[x.end] - letters[x.start] + stop == size), 0.4, 0.2),
        _above(c["n_repeat_words"] / n, 0.3, 0.1),
        _above(by_word(echo), 0.3, 0.1),
        _above(per(upper) / np.maximum(per(upper) + per(lower), 1), 0.4, 0.15),
        _above(by_word(ends == 0x21), 0.15, 0.05),
        _above(by_word((size == 1) & (ends == 0x7C)), 0.15, 0.05),
        _above(c["n_dup_lines"] / np.maximum(per(x.data == 10) + 1, 1), 0.5, 0.2),
        np.where(c["n_words"] < 30, BAD, GOOD),
        np.where((chars < 2) | (chars > 16), BAD, np.where((chars > 3.5) & (chars < 9), GOOD, NONE)),
        _above(-by_word(stop), -0.02, -0.04),
    )
    return np.stack(rows, 1)


def _vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = 3 ** np.arange(len(LABELLERS))
    for b in batches:
        for lo, hi, x in w.batches(b.column("text")):
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array((votes(x) * powers).sum(1))], ["doc_id", "votes"])


def estimate(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: the posterior of good for each, and rates[labeller, class, vote].

    One document is added to each vote of each labeller and class, and to each class, so
    that no rate is 0; nothing else holds the estimates.
    """
    post = np.where((patterns == GOOD).sum(1) > (patterns == BAD).sum(1), 0.9, 0.1)
    hot = np.stack([patterns == v for v in (BAD, GOOD, NONE)], 2).astype(float)
    while True:
        prior = ((post * counts).sum() + 1) / (counts.sum() + 2)
        rates = np.stack([np.einsum("p,pkv->kv", p * counts, hot) + 1 for p in (1 - post, post)], 1)
        rates /= rates.sum(2, keepdims=True)
        logs = np.einsum("pkv,kyv->py", hot, np.log(rates)) + np.log([1 - prior, prior])
        before, post = post, 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        if np.abs(post - before).max(initial=0) <= TOLERANCE:
            return post, rates


def features(x: w.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed lower-cased words and word shapes of all documents: document, index, weight; a document's squared weights sum to 1."""
    kinds = _CLASS[x.data]
    keep = ~w.SPACE[x.data]
    if len(keep):
        same = np.zeros(len(keep), bool)
        same[1:] = kinds[1:] == kinds[:-1]
        same[x.start] = False
        keep &= ~same
    at = np.concatenate([[0], np.cumsum(keep)])
    shapes = w.run_hash(w.BYTE_VALUE[kinds[keep]], at[x.start], at[x.end])
    half = np.uint64(DIMENSIONS // 2)
    index = np.concatenate([x.hashes(w.LOWER_VALUE) % half, shapes % half + half]).astype(np.int64)
    key = np.concatenate([x.doc, x.doc]) * DIMENSIONS + index
    key, n = np.unique(key, return_counts=True)
    doc, weight = key // DIMENSIONS, np.sqrt(n)
    norm = np.sqrt(np.bincount(doc, weight * weight, minlength=len(x.bounds) - 1))
    return doc, key % DIMENSIONS, weight / norm[doc]


def train(texts: pa.Array, posterior: np.ndarray) -> np.ndarray:
    """Weights of the scorer, by stochastic gradient steps over distinct texts in the order of their hashes."""
    docs, names = [], []
    for _, _, x in w.batches(texts):
        d, i, v = features(x)
        edge = np.searchsorted(d, np.arange(len(x.bounds)))
        docs += [(i[a:z], v[a:z]) for a, z in zip(edge[:-1], edge[1:], strict=True)]
        names.append(w.run_hash(w.BYTE_VALUE[x.data], x.bounds[:-1], x.bounds[1:]))
    weights = np.zeros(DIMENSIONS + 1)
    if docs:
        order = np.argsort(np.concatenate(names))
        share = np.clip(posterior[order].mean(), 0.02, 0.98)
        cost = np.where(posterior >= 0.5, 0.5 / share, 0.5 / (1 - share))
        rng = np.random.default_rng(7)
        for epoch in range(EPOCHS):
            for k in order[rng.permutation(len(order))]:
                i, v = docs[k]
                p = 1 / (1 + np.exp(-np.clip(weights[i] @ v + weights[-1], -30, 30)))
                g = 0.5 / (1 + epoch) * cost[k] * (posterior[k] - p)
                weights[i] += g * v
                weights[-1] += 0.2 * g
    return weights


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(list(batches), pa.schema([("text", pa.string()), ("posterior", pa.float64())]))  # TRAIN_DOCUMENTS, about
    weights = train(rows["text"].combine_chunks(), rows["posterior"].to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array([weights.tolist()], pa.list_(pa.float64()))], ["weights"])


def _score(batches: Iterator[pa.RecordBatch], weights: np.ndarray, posterior: dict[int, float]) -> Iterator[pa.RecordBatch]:
    powers = 3 ** np.arange(len(LABELLERS))
    for b in batches:
        for lo, hi, x in w.batches(b.column("text")):
            d, i, v = features(x)
            z = np.bincount(d, weights[i] * v, minlength=hi - lo) + weights[-1]
            score = np.where(np.diff(x.first) > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
            post = np.array([posterior[int(k)] for k in (votes(x) * powers).sum(1)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(x.first)), pa.array(post), pa.array(score), pa.array(score >= KEEP_SCORE)], ["doc_id", "n_words", "posterior", "score", "kept"])


def accuracies(rates: np.ndarray) -> dict[str, tuple[float, float]]:
    """How often each labeller is right, where it votes, on bad and on good documents."""
    said = rates[:, :, :2]
    said = said / said.sum(2, keepdims=True)
    return {name: (float(said[k, 0, 0]), float(said[k, 1, 1])) for k, name in enumerate(LABELLERS)}


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, posterior, score, kept for each row of docs.

    Null, empty and blank texts have score 0 and aren't kept. Repeated rows stay; rows of
    equal text have equal scores, however the rows are dealt. Other columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    voted = base.mapInArrow(_vote_rows, "doc_id bigint, votes bigint")
    rows = sorted(voted.groupBy("votes").count().collect())  # at most 3 ** len(LABELLERS)
    codes = np.array([r["votes"] for r in rows], np.int64)
    counts = np.array([r["count"] for r in rows], float)
    patterns = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    post = estimate(patterns, counts)[0] if len(rows) else np.zeros(0)
    posterior = dict(zip(codes.tolist(), post.tolist(), strict=True))
    share = min(1.0, TRAIN_DOCUMENTS / max(1.0, counts.sum()))
    sample = base.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 3 ** np.arange(len(LABELLERS))
        for b in batches:
            for lo, hi, x in w.batches(b.column("text")):
                p = [posterior.get(int(k), 0.5) for k in (votes(x) * powers).sum(1)]
                yield pa.RecordBatch.from_arrays([b.column("text").slice(lo, hi - lo), pa.array(p, pa.float64())], ["text", "posterior"])

    labelled = sample.filter("text is not null").dropDuplicates(["text"]).mapInArrow(label, "text string, posterior double")
    trained = settle(labelled.repartition(1).mapInArrow(_train, "weights array<double>"), "weights").first()
    weights = np.array(trained["weights"]) if trained else np.zeros(DIMENSIONS + 1)
    return base.mapInArrow(lambda it: _score(it, weights, posterior), "doc_id bigint, n_words bigint, posterior double, score double, kept boolean")


def op8_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
