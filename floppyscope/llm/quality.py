"""Quality rules: a hashed n-gram logistic regression with calibrated probabilities.

Words and character n-grams are hashed into one weight vector. The model is fitted on
labelled rows, its scores are calibrated by Platt scaling on rows that were held back from
the fit, and documents are scored in Arrow batches against a fixed threshold.
"""

from __future__ import annotations

import contextlib
import ctypes
import warnings
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floppyscope.llm.common import LOWER, SPACE, in_batches, mix, span_hashes, string_chunks, table, word_spans, written
from floppyscope.llm.decontaminate import small

#: Symbols that count_base counts.
SYMBOLS = "#*$%&|<>"
#: Rows of labelled text that the fit uses at most, chosen by a hash of the id.
MAX_FIT_ROWS = 3_000
BITS = 18


@dataclass(frozen=True)
class QualityModel:
    """Weights of the hashed n-grams, an intercept and the calibration p = 1 / (1 + exp(-(a s + b)))."""

    weights: np.ndarray
    intercept: float
    a: float
    b: float

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.a * score + self.b, -500, 500)))


def _grams(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Indexes of hashed n-grams and their row bounds, by kind: words, word pairs, runs of 3 and 5 bytes."""
    low = LOWER[data]
    shift = np.uint64(64 - bits)
    starts, ends, first = word_spans(low, offsets, SPACE)
    words = span_hashes(low, starts, ends)
    index, bounds = [(words >> shift).astype(np.int64)], [first]
    pairs = mix(words[:-1] * np.uint64(3) + words[1:]) if len(words) > 1 else words[:0]
    # A word said twice in a row is one feature, whichever the word, so that doublings are learnt of words that no
    # labelled row doubles: of 1,400 held-out rows at sf0.1, 0.07 of the bad ones passed with it and 0.21 without.
    pairs[words[:-1] == words[1:]] = np.uint64(0)
    # A pair belongs to the row of its first word; the last word of a row starts none.
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    same = rows[:-1] == rows[1:] if len(rows) > 1 else np.zeros(0, bool)
    index.append((pairs[same] >> shift).astype(np.int64))
    bounds.append(np.concatenate([[0], np.cumsum(np.bincount(rows[:-1][same], minlength=len(first) - 1))]))
    for n in (3, 5):
        if len(low) < n:
            index.append(np.zeros(0, np.int64))
            bounds.append(np.zeros(len(offsets), np.int64))
            continue
        code = np.zeros(len(low) - n + 1, np.uint64)
        for k in range(n):
            code = code * np.uint64(257) + low[k : len(low) - n + 1 + k]
        code = code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        inside = np.ones(len(code), bool)
        for k in range(1, n):  # runs that cross into the next row
            cut = offsets[1:-1] - k
            inside[cut[(cut >= 0) & (cut < len(code))]] = False
        keep = np.flatnonzero(inside)
        index.append((code[keep] >> shift).astype(np.int64))
        bounds.append(np.searchsorted(keep, offsets))
    return index, bounds


def _row_means(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(1, np.diff(bounds))


def scores(data: np.ndarray, offsets: np.ndarray, model: QualityModel, bits: int = BITS) -> np.ndarray:
    """Uncalibrated scores: for each kind of n-gram the mean weight, added up."""
    out = np.full(len(offsets) - 1, float(model.intercept))
    for k, (index, bounds) in enumerate(zip(*_grams(data, offsets, bits))):
        out += _row_means(model.weights[k][index], bounds)
    return out


#: For each kind of n-gram the distinct n-grams of one text, their times and how many there are in all.
Counted = list[tuple[np.ndarray, np.ndarray, int]]


def counted(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> list[Counted]:
    """The counted n-grams of every row."""
    rows: list[Counted] = [[] for _ in range(len(offsets) - 1)]
    for index, bounds in zip(*_grams(data, offsets, bits)):
        for i, row in enumerate(rows):
            gram, times = np.unique(index[bounds[i] : bounds[i + 1]], return_counts=True)
            row.append((gram.astype(np.int32), times.astype(np.uint32), int(bounds[i + 1] - bounds[i])))
    return rows


def fit(texts: list[str], good: list[int], bits: int = BITS, rounds: int = 40, l2: float = 1e-6) -> QualityModel:
    """``fit_counted`` of whole texts."""
    rows = (row for _a, _b, data, offsets in string_chunks(pa.array(texts, pa.large_string())) for row in counted(data, offsets, bits))
    return fit_counted(rows, good, bits, rounds, l2)


def fit_counted(rows: Iterable[Counted], good: list[int], bits: int = BITS, rounds: int = 40, l2: float = 1e-6) -> QualityModel:
    """Fits by full-batch gradient steps with a step size per weight (AdaGrad); every fifth
    row is held back for the calibration. With one class only, the model scores its share."""
    y = np.asarray(good, np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 1.0
        logit = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return QualityModel(np.zeros((4, 1 << bits), np.float32), 0.0, 1.0, logit)
    held = np.arange(len(y)) % 5 == 4
    size = 1 << bits
    parts = []  # (first row, end row, kind, row, n-gram, times, n-grams of each row) of a run of rows: eight bytes an entry
    rows, a = iter(rows), 0
    while some := list(islice(rows, 64)):
        for k in range(4):
            gram, times = (np.concatenate([r[k][i] for r in some]) for i in (0, 1))
            few = np.uint16 if times.max(initial=0) < 1 << 16 else np.uint32
            row = np.repeat(np.arange(len(some), dtype=np.uint16), [len(r[k][0]) for r in some])
            parts.append((a, a + len(some), k, row, gram, times.astype(few), np.maximum(1, [r[k][2] for r in some])))
        a += len(some)
    weight = np.where(y == 1, 0.5 / max(1, (y[~held] == 1).sum()), 0.5 / max(1, (y[~held] == 0).sum())) * ~held
    w, intercept, gw, gb = np.zeros((4, size)), 0.0, np.full((4, size), 1e-12), 1e-12

    def scored() -> np.ndarray:
        s = np.full(len(y), intercept)
        for a, b, k, row, gram, times, counts in parts:
            s[a:b] += np.bincount(row, times * w[k][gram], b - a) / counts
        return s

    for _ in range(rounds):
        error = weight * (1 / (1 + np.exp(-np.clip(scored(), -500, 500))) - y)
        g = l2 * w
        for a, b, k, row, gram, times, counts in parts:
            g[k] += np.bincount(gram, times * (error[a:b] / counts)[row], size)
        gw += g * g
        gb += error.sum() ** 2
        w -= 0.5 * g / np.sqrt(gw)
        intercept -= 0.1 * error.sum() / np.sqrt(gb)
    s = scored()
    slope, shift = _platt(s[held], y[held]) if 0 < y[held].sum() < held.sum() else (1.0, 0.0)
    return QualityModel(w.astype(np.float32), float(intercept), slope, shift)


def _platt(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the calibration by Newton steps on smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = s.std() or 1.0
    x, a, b = s / scale, 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        v = p * (1 - p) + 1e-9
        ga, gb = ((p - t) * x).sum(), (p - t).sum()
        haa, hab, hbb = (v * x * x).sum() + 1e-6, (v * x).sum(), v.sum() + 1e-6
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
    return float(max(a, 0.0) / scale), float(b)


def fit_on_labels(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> QualityModel:
    """The model of the documents that have a label: at most ``max_rows`` of them, those with
    the least hash of the id, then of the text (a documented bound of the fit alone), each with
    its whole text. Rows without an id, a text or a quality label are left out, as are labels
    of other documents; an id labelled more than once counts with its least label. If no label
    is left, every document gets the same score, with a warning. Workers count the n-grams; the
    driver sees counts and no text."""

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in string_chunks(batch.column(3)):
                found = counted(data, offsets)
                packed = [pa.array([b"".join(r[k][i].tobytes() for k in range(4)) for r in found], pa.binary()) for i in (0, 1)]
                sizes = [pa.array([[v for r in row for v in (len(r[0]), r[2])] for row in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[a:b] for i in range(3)), *packed, *sizes], ["doc_id", "content", "quality", "grams", "times", "sizes"])

    order = (F.xxhash64("doc_id"), "doc_id", "content")
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("content"), "text")
    # First which rows are both labelled and there, then the bound: labels of other documents change nothing.
    there = texts.select("doc_id", "content").join(small(marked), "doc_id")
    chosen = written(there.orderBy(*order).limit(max_rows), "fit-rows")
    rows = (
        texts.join(F.broadcast(chosen.distinct()), ["doc_id", "content"])  # at most max_rows rows of three integers
        .select(F.col("doc_id").cast("long"), "content", F.col("quality").cast("long"), "text")
    )
    schema = "doc_id long, content long, quality long, grams binary, times binary, sizes array<long>"
    features = written(in_batches(rows).mapInArrow(run, schema), "fit-counts")
    keys = [(r["doc_id"], r["content"], r["quality"]) for r in chosen.orderBy(*order).collect()]
    if not keys and not labels.isEmpty():
        warnings.warn("no label belongs to a document with text: every document gets the same score", stacklevel=2)
    left = Counter(key[:2] for key in keys)

    def in_order() -> Iterator[Counted]:
        for r in features.orderBy(*order).toLocalIterator():
            key = (r["doc_id"], r["content"])
            if left[key]:  # of equal rows as many as were chosen
                left[key] -= 1
                yield _unpacked(r["grams"], r["times"], r["sizes"])

    model = fit_counted(in_order(), [int(key[2] > 0) for key in keys])
    _give_back()
    return model


def _give_back() -> None:
    """Hands memory of the fit that is free back to the system, where the C library can do so."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _unpacked(grams: bytes, times: bytes, sizes: list[int]) -> Counted:
    cuts = np.cumsum(sizes[::2])[:-1]
    parts = (np.split(np.frombuffer(v, t), cuts) for v, t in ((grams, np.int32), (times, np.uint32)))
    return list(zip(*parts, sizes[1::2]))


def count_base(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one text."""
    words = text.translate(_TO_SPACE).split(" ") if _OTHER_SPACE(text) else text.split(" ")
    words = [w for w in words if w]
    n = len(words)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    duplicates = 0
    if "\n" in text:
        seen: set[str] = set()
        for line in text.split("\n"):
            if line in seen:
                duplicates += 1
            elif line.strip(" \t\n\x0b\x0c\r"):
                seen.add(line)
    repeated = 0
    if n >= 6:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len(set(windows)) < len(windows):
            times: dict[tuple, int] = {}
            for w in windows:
                times[w] = times.get(w, 0) + 1
            end = 0
            for i, w in enumerate(windows):
                if times[w] > 1:
                    repeated += i + 5 - max(i, end)
                    end = i + 5
    return n, chars, symbols, duplicates, repeated


_TO_SPACE = {c: " " for c in (9, 10, 11, 12, 13)}


def _OTHER_SPACE(text: str) -> bool:
    return "\n" in text or "\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text


SCORED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, p_good double, kept boolean"


def score_documents(documents: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """The counts, the base verdict, the calibrated probability and ``kept`` of every row.

    A null text counts as empty: no words, so the base verdict fails it. Repeated rows are
    scored each. An empty table gives an empty result.
    """
    share = documents.sparkSession.sparkContext.broadcast(model)  # 2**18 weights of four kinds: 4 MB

    def run(batches):
        m = share.value
        for batch in batches:
            texts, p = batch.column(1), []
            counts = [count_base(t or "") for t in texts.to_pylist()]
            for _a, _b, data, offsets in string_chunks(texts):
                p.append(m.probability(scores(data, offsets, m)))
            c = np.array(counts, np.int64).reshape(-1, 5)
            p_good = np.concatenate(p) if p else np.zeros(0)
            failed = (c[:, 0] < 10) | (100 * c[:, 4] > 20 * c[:, 0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c[:, k]) for k in range(5)), pa.array(failed), pa.array(p_good), pa.array(~failed & (p_good >= threshold))],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "p_good", "kept"],
            )

    return in_batches(documents.select("doc_id", "text")).mapInArrow(run, SCORED)


def keep_good(documents: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents``, with all their columns, that ``score_documents`` would keep."""
    share = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches):
        m = share.value
        for batch in batches:
            texts = batch.column(at)
            keep = []
            for a, b, data, offsets in string_chunks(texts):
                counts = [count_base(t or "") for t in texts[a:b].to_pylist()]
                good = m.probability(scores(data, offsets, m)) >= threshold
                keep += [bool(g) and c[0] >= 10 and 100 * c[4] <= 20 * c[0] for g, c in zip(good, counts)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return in_batches(documents).mapInArrow(run, documents.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score_documents(documents, fit_on_labels(documents, table(spark, sf_dir, "labels")))
