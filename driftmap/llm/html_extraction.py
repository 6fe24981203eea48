"""Main text of pages by a recurrent block labeller.

Every leaf block of a page is a vector: hashed tokens of its tag path, hashed words, and a few
measures. A bidirectional LSTM reads the blocks of a whole page in both directions and labels
each as of the article or not. It is trained here, in one task, on TRAIN_PAGES labelled pages
of many layouts (page_layouts), with a fixed seed; the weights (about 0.2 MB) go to the tasks.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmap.llm import words as w
from driftmap.llm.html_blocks import Page, parse
from driftmap.llm.page_layouts import labelled_pages

PATH_BUCKETS, PATH_WIDTH = 2048, 16
WORD_BUCKETS, WORD_WIDTH = 2048, 12
MEASURES, HIDDEN = 8, 24
WIDTH = PATH_WIDTH + WORD_WIDTH + MEASURES
TRAIN_PAGES, EPOCHS, BATCH, SEED = 1200, 8, 40, 13
#: Padded blocks of a batch of pages, and steps whose gates are computed at once.
BATCH_BLOCKS, STEPS = 16_384, 4096
Weights = dict[str, np.ndarray]
_trained: dict[tuple[int, int], bytes] = {}


class Features:
    """The blocks of some pages: path tokens and words as runs of buckets, and measures."""

    def __init__(self, pages: list[Page]):
        self.sizes = np.array([len(p.blocks) for p in pages], np.int64)
        blocks = [b for p in pages for b in p.blocks]
        paths, start = [], [0]
        for p in pages:
            paths += p.paths
            start.append(start[-1] + len(p.paths))
        known: dict[str, int] = {}
        self.path = np.array([start[i] + b.path for i, p in enumerate(pages) for b in p.blocks], np.int64)
        self.path_tokens = np.array([known[t] if t in known else known.setdefault(t, xxhash.xxh64_intdigest(t) % PATH_BUCKETS) for tokens in paths for t in tokens], np.int64)
        self.path_counts = np.array([len(tokens) for tokens in paths], np.int64)
        buckets, counts, marks = [], [np.zeros(0, np.int64)], [np.zeros((0, 3))]
        for _, _, data, bounds in w.slices(pa.array([b.text for b in blocks], pa.large_string())):
            x = w.split(data, bounds)
            buckets.append((x.hashes(w.LOWER_VALUE) % np.uint64(WORD_BUCKETS)).astype(np.int16))
            counts.append(np.diff(x.first))
            runs = [np.concatenate([[0], np.cumsum(np.isin(data, list(m)))]) for m in (b".,;:!?", b"0123456789", bytes(range(65, 91)))]
            marks.append(np.stack([r[bounds[1:]] - r[bounds[:-1]] for r in runs], 1))
        self.words = np.concatenate(buckets) if buckets else np.zeros(0, np.int16)
        self.word_counts = np.concatenate(counts)
        n = self.word_counts.astype(float)
        size = np.array([len(b.text) for b in blocks], float)
        linked = np.array([b.linked for b in blocks], float)
        at = np.concatenate([np.arange(s) / max(s, 1) for s in self.sizes]) if len(blocks) else size
        mark = np.concatenate(marks) / np.maximum(n, 1)[:, None]
        self.measures = np.stack([np.log1p(n) / 3, linked / np.maximum(size, 1), *np.minimum(mark, 4).T, at, n < 4, size / np.maximum(n, 1) / 10], 1).astype(np.float32)
        self.measures[:, 7] = np.minimum(self.measures[:, 7], 3)

    def mean_words(self, table: np.ndarray) -> np.ndarray:
        """The mean vector of each block's words, by slices of words."""
        out = np.zeros((len(self.word_counts), table.shape[1]), np.float32)
        end = np.cumsum(self.word_counts)
        lo = 0
        while lo < len(end):
            first = end[lo] - self.word_counts[lo]
            hi = max(lo + 1, int(np.searchsorted(end, first + (1 << 18), "right")))
            if hi == lo + 1:  # one block of any length
                for at in range(first, end[lo], 1 << 18):
                    out[lo] += table[self.words[at : min(at + (1 << 18), end[lo])]].sum(0)
            else:
                some = np.flatnonzero(self.word_counts[lo:hi])
                out[lo + some] = np.add.reduceat(table[self.words[first : end[hi - 1]]], (end - self.word_counts)[lo + some] - first, axis=0)
            lo = hi
        return out / np.maximum(self.word_counts, 1)[:, None]

    def mean_paths(self, table: np.ndarray) -> np.ndarray:
        if not len(self.path_counts):
            return np.zeros((0, table.shape[1]), np.float32)
        sums = np.add.reduceat(table[self.path_tokens], np.cumsum(self.path_counts) - self.path_counts, axis=0)
        return (sums / np.sqrt(self.path_counts)[:, None])[self.path]

    def vectors(self, weights: Weights) -> np.ndarray:
        return np.concatenate([self.mean_paths(weights["path"]), self.mean_words(weights["word"]), self.measures], 1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gates(g: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    h = HIDDEN
    i, f, o, n = _sigmoid(g[:, :h]), _sigmoid(g[:, h : 2 * h]), _sigmoid(g[:, 2 * h : 3 * h]), np.tanh(g[:, 3 * h :])
    c = f * c + i * n
    return i, f, o, n, c, o * np.tanh(c)


def _read(x: np.ndarray, weights: Weights, side: str, keep: list | None = None) -> np.ndarray:
    """The states of one direction after each step of x (steps, pages, WIDTH); keep gathers what learning needs."""
    steps, n, _ = x.shape
    out = np.empty((steps, n, HIDDEN), np.float32)
    h = c = np.zeros((n, HIDDEN), np.float32)
    for lo in range(0, steps, STEPS):
        part = x[lo : lo + STEPS]
        g = part @ weights["in" + side] + weights["bias" + side]
        for t in range(len(part)):
            before = h, c
            *gates, c, h = _gates(g[t] + h @ weights["re" + side], c)
            out[lo + t] = h
            if keep is not None:
                keep.append((*before, *gates, c))
    return out


def _turned(sizes: np.ndarray, steps: int) -> np.ndarray:
    """The step that each step becomes when every page is read backwards; padding stays."""
    at = np.arange(steps)[:, None]
    return np.where(at < sizes, sizes - 1 - at, at)


def _padded(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x as (steps, pages, width), and the steps and pages of its rows."""
    page = np.repeat(np.arange(len(sizes)), sizes)
    step = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((int(sizes.max()), len(sizes), x.shape[1]), np.float32)
    out[step, page] = x
    return out, step, page


def probabilities(features: Features, weights: Weights) -> np.ndarray:
    """Of each block, that it is of the article."""
    out = np.zeros(int(features.sizes.sum()), np.float32)
    vectors, first = features.vectors(weights), np.cumsum(features.sizes) - features.sizes
    order = np.argsort(features.sizes, kind="stable")
    order = order[features.sizes[order] > 0]
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and features.sizes[order[hi]] * (hi + 1 - lo) <= BATCH_BLOCKS:
            hi += 1
        pages, lo = order[lo:hi], hi
        sizes = features.sizes[pages]
        rows = w.ragged(np.arange(len(vectors)), first[pages], sizes)
        x, step, page = _padded(vectors[rows], sizes)
        turn, cols = _turned(sizes, len(x)), np.arange(len(pages))
        ahead = _read(x, weights, "+")[step, page]
        back = _read(x[turn, cols], weights, "-")[turn[step, page], page]
        out[rows] = _sigmoid(np.concatenate([ahead, back, vectors[rows]], 1) @ weights["out"] + weights["out_bias"])[:, 0]
    return out


def _learn_direction(x: np.ndarray, weights: Weights, side: str, keep: list, down: np.ndarray, grads: Weights) -> np.ndarray:
    """Add a direction's gradients, given those of its states, and return the one of x."""
    d_x = np.empty_like(x)
    d_h = d_c = np.zeros_like(down[0])
    for t in range(len(x) - 1, -1, -1):
        h0, c0, i, f, o, n, c = keep[t]
        d_h = d_h + down[t]
        tc = np.tanh(c)
        d_c = d_c + d_h * o * (1 - tc * tc)
        g = np.concatenate([d_c * n * i * (1 - i), d_c * c0 * f * (1 - f), d_h * tc * o * (1 - o), d_c * i * (1 - n * n)], 1)
        grads["in" + side] += x[t].T @ g
        grads["re" + side] += h0.T @ g
        grads["bias" + side] += g.sum(0)
        d_x[t], d_h, d_c = g @ weights["in" + side].T, g @ weights["re" + side].T, d_c * f
    return d_x


def gradients(features: Features, labels: np.ndarray, weights: Weights) -> tuple[float, Weights]:
    """The mean cross entropy over blocks, and its gradients."""
    vectors, sizes = features.vectors(weights), features.sizes
    x, step, page = _padded(vectors, sizes)
    turn, cols = _turned(sizes, len(x)), np.arange(len(sizes))
    keeps: tuple[list, list] = ([], [])
    ahead = _read(x, weights, "+", keeps[0])[step, page]
    xb = x[turn, cols]
    back = _read(xb, weights, "-", keeps[1])[turn[step, page], page]
    joined = np.concatenate([ahead, back, vectors], 1)
    p = _sigmoid(joined @ weights["out"] + weights["out_bias"])[:, 0]
    loss = float(-np.mean(np.log(np.where(labels, p, 1 - p) + 1e-9)))
    grads = {k: np.zeros_like(v) for k, v in weights.items()}
    d = ((p - labels) / len(p)).astype(np.float32)[:, None]
    grads["out"], grads["out_bias"] = joined.T @ d, d.sum(0)
    d = d @ weights["out"].T
    down = np.zeros((2, *x.shape[:2], HIDDEN), np.float32)
    down[0, step, page] = d[:, :HIDDEN]
    down[1, turn[step, page], page] = d[:, HIDDEN : 2 * HIDDEN]
    d_x = _learn_direction(x, weights, "+", keeps[0], down[0], grads)[step, page] + d[:, 2 * HIDDEN :]
    d_x = d_x + _learn_direction(xb, weights, "-", keeps[1], down[1], grads)[turn[step, page], page]
    d_path = np.zeros((len(features.path_counts), PATH_WIDTH), np.float32)
    np.add.at(d_path, features.path, d_x[:, :PATH_WIDTH])
    np.add.at(grads["path"], features.path_tokens, np.repeat(d_path / np.sqrt(features.path_counts)[:, None], features.path_counts, 0))
    n = features.word_counts
    np.add.at(grads["word"], features.words, np.repeat(d_x[:, PATH_WIDTH : PATH_WIDTH + WORD_WIDTH] / np.maximum(n, 1)[:, None], n, 0))
    return loss, grads


def initial(seed: int) -> Weights:
    rng = np.random.default_rng(seed)
    made = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    weights = {"path": made(0.3, PATH_BUCKETS, PATH_WIDTH), "word": made(0.3, WORD_BUCKETS, WORD_WIDTH)}
    for side in "+-":
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1
        weights |= {"in" + side: made(WIDTH**-0.5, WIDTH, 4 * HIDDEN), "re" + side: made(HIDDEN**-0.5, HIDDEN, 4 * HIDDEN), "bias" + side: bias}
    return weights | {"out": made(0.1, 2 * HIDDEN + WIDTH, 1), "out_bias": np.zeros(1, np.float32)}


def fit(pages: int = TRAIN_PAGES, seed: int = SEED) -> Weights:
    """Weights after EPOCHS passes of Adam over labelled pages, their path and word tokens hidden at random so that no single name decides."""
    made = labelled_pages(pages, seed)
    parsed = [parse(source) for source, _ in made]
    truth = [np.array([main for _, main in leaves]) for _, leaves in made]
    weights, rng = initial(seed), np.random.default_rng(seed)
    first, second, step = ({k: np.zeros_like(v) for k, v in weights.items()}, {k: np.zeros_like(v) for k, v in weights.items()}, 0)
    filled = [i for i, p in enumerate(parsed) if p.blocks]
    filled.sort(key=lambda i: len(parsed[i].blocks))
    for epoch in range(EPOCHS):
        starts = np.arange(0, len(filled), BATCH)
        rng.shuffle(starts)
        for lo in starts:
            some = filled[lo : lo + BATCH]
            pages_now = [parsed[i]._replace(paths=[tuple(t for t in path if rng.random() > 0.05) or ("none",) for path in parsed[i].paths]) for i in some]
            _, grads = gradients(Features(pages_now), np.concatenate([truth[i] for i in some]), weights)
            step += 1
            rate = 0.012 * (1 - 0.97 * epoch / (EPOCHS - 1))
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                weights[k] = weights[k] - (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return weights


def _train(batches: Iterator[pa.RecordBatch], pages: int, seed: int) -> Iterator[pa.RecordBatch]:
    if sum(len(b) for b in batches):
        file = io.BytesIO()
        np.savez(file, **fit(pages, seed))
        yield pa.RecordBatch.from_arrays([pa.array([file.getvalue()], pa.binary())], ["weights"])


def trained(spark: SparkSession, pages: int = TRAIN_PAGES, seed: int = SEED) -> Weights:
    """The labeller's weights, fitted in a task once in a driver's life."""
    if (pages, seed) not in _trained:
        _trained[pages, seed] = bytes(spark.range(0, 1, 1, 1).mapInArrow(partial(_train, pages=pages, seed=seed), "weights binary").first()[0])
    return dict(np.load(io.BytesIO(_trained[pages, seed])))


def _extract(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, bounds in w.slices(b.column("html")):
            pages = [parse(data[s:e].tobytes().decode("utf-8", "replace")) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
            main = probabilities(Features(pages), weights) >= 0.5
            end = np.cumsum([len(p.blocks) for p in pages])
            texts = ["\n".join(x.text for x, m in zip(p.blocks, main[e - len(p.blocks) : e], strict=True) if m) for p, e in zip(pages, end, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id").slice(lo, hi - lo), b.column("url").slice(lo, hi - lo), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages: the blocks labelled as the article, one in a line.

    White space (as Python splits it, so with no-break spaces) inside a block becomes one space.
    Null and empty html give an empty text, as do pages without article blocks. Markup may be
    unclosed or nested wrongly; unclosed comments, scripts and tags run to the end. Elements
    deeper than 512 count as siblings. Ids and urls are handed on, nulls and repeats too;
    other columns are ignored; an empty table gives no rows.
    """
    weights = weights or trained(pages.sparkSession)
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(partial(_extract, weights=weights), f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
