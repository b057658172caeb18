"""Language-model scores from a log-frequency Bloom filter.

Word and word-pair counts of the training rows are quantised on a log scale, and each n-gram
is put into one Bloom filter once for every level up to its own. The filter is broadcast; a
count is found again by probing level after level until one is missing. Probabilities are
smoothed with a Dirichlet prior: p(w | v) = (c(v w) + mu p(w)) / (c(v) + noise + mu), where
noise is the count that chance hits of the filter are expected to add over all w, and
mu = MU + 10 noise. Counts are the middles of their levels, so that the probabilities after a
word add up to one as nearly as levels tell counts, and no nearer.

The filter grows with the training text, BITS_PER_BYTE for each of its bytes, up to MAX_BYTES
(the proven bound of what is broadcast). Past that bound nothing is left out, but probes hit
by chance more often. The base score is exact at every size: counts of the most frequent
words, MAX_HEAD at most, are broadcast, and rarer words are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floppyscope.llm.common import LOWER, SPACE, in_batches, mix, span_hashes, string_chunks, table, word_spans, written

#: The filter is cut into segments of 2**SEGMENT_BITS bits; an n-gram's probes stay in one.
SEGMENT_BITS = 21
BITS_PER_BYTE = 1.5
MAX_BYTES = 256 << 20
PROBES = 5
#: Levels are log LOG_BASE of the count.
LOG_BASE = 1.5
MAX_LEVEL = 108  # that of 2**63
MU = 300.0
#: Words whose exact counts are broadcast at most: 16 bytes each.
MAX_HEAD = 3_000_000
#: Words whose probed counts a worker remembers at most; then it starts anew.
SEEN = 400_000
#: N-grams that a task holds before it hands them on, or adds them up.
HELD = 1_000_000
#: Bytes of training text for each part of the n-grams, one of which a task adds up at a time.
PART_BYTES = 64 << 20
#: Bytes of a segment that travel as one row.
PIECE = 1 << 12

END = np.uint64(0x5BF0A8B1457695A7)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed words of each row, lower-cased in A-Z, each row closed by END; and the bounds of rows."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets, SPACE)
    out = np.insert(span_hashes(low, starts, ends), first[1:], END)
    return out, first + np.arange(len(first))


def pairs(words: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before it. END precedes the first of every row."""
    before = np.concatenate([[END], words[:-1]])
    return mix(before * np.uint64(0xD1342543DE82EF95) + words)


def segment_of(grams: np.ndarray, segments: int) -> np.ndarray:
    return ((grams >> np.uint64(33)) % np.uint64(segments)).astype(np.int64)


def _hash(grams: np.ndarray, level: int) -> np.ndarray:
    """The hash of each n-gram at a level, from which its places are taken."""
    return mix(grams ^ mix(np.full(1, level, np.uint64) * _GOLD))


def _place(g: np.ndarray, k: int) -> np.ndarray:
    """The k-th place in the segment: all places of a hash lie in one line of 64 bytes, so that
    probes after the first find it in the processor's cache."""
    lines = np.uint64((1 << SEGMENT_BITS - 9) - 1)
    return ((g & lines) << np.uint64(9) | g >> np.uint64(SEGMENT_BITS - 9 + 9 * k) & np.uint64(511)).astype(np.int64)


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(LOG_BASE) + 1e-9).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level; 0 for level 0, 1 for level 1."""
    return np.where(levels > 1, (LOG_BASE ** (levels - 1) + LOG_BASE**levels) / 2, levels)


def fill_segment(grams: np.ndarray, counts: np.ndarray) -> bytes:
    """One segment that holds the n-grams at every level up to that of their count."""
    bits = np.zeros(1 << SEGMENT_BITS, bool)
    levels = level_of(counts)
    for j in range(1, int(levels.max(initial=0)) + 1):
        g = _hash(grams[levels >= j], j)
        for k in range(PROBES):
            bits[_place(g, k)] = True
    return np.packbits(bits, bitorder="little").tobytes()


@dataclass(frozen=True)
class LanguageModel:
    """``bits``: all segments in one array; ``head``: sorted hashes of frequent words with
    their counts, complete down to the count ``floor``; ``total`` and ``distinct`` tokens."""

    bits: np.ndarray
    head: np.ndarray
    head_counts: np.ndarray
    floor: int
    total: int
    distinct: int
    words: DataFrame | None = None  # all exact counts, for those that the head doesn't hold

    @cached_property
    def noise(self) -> float:
        """Counts that chance hits add over all words after a given one. A word passes a level
        by chance with the share of set bits in a line to the power of PROBES, climbs on while
        it does so, and gains the step between the counts of two levels each time."""
        if not len(self.bits):
            return 0.0
        share = np.bitwise_count(self.bits.view(np.uint64)).reshape(-1, 8).sum(axis=1) / 512
        many = np.bincount((share * 512).astype(np.int64), minlength=513)  # lines by set bits
        passed = (np.arange(513) / 512.0) ** PROBES
        steps = np.diff(count_of(np.arange(MAX_LEVEL + 1)))
        gained = sum(passed**j * step for j, step in enumerate(steps, 1))
        return self.distinct * float((many * gained).sum() / many.sum())

    def quantised(self, grams: np.ndarray) -> np.ndarray:
        """Counts by repeated membership probes: the level before the first that is missing."""
        levels = np.zeros(len(grams), np.int64)
        segments = len(self.bits) << 3 >> SEGMENT_BITS
        base = segment_of(grams, segments) << SEGMENT_BITS
        active = np.arange(len(grams))
        for j in range(1, MAX_LEVEL + 1):
            # Each probe is made for those only that passed the ones before it.
            g = _hash(grams[active], j)
            for k in range(PROBES):
                at = base[active] + _place(g, k)
                hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                active, g = active[hit], g[hit]
            if not len(active):
                break
            levels[active] = j
        return count_of(levels)

    def quantised_words(self, words: np.ndarray) -> np.ndarray:
        """``quantised`` of sorted words, each probed once by a worker: frequent words have many levels."""
        found = np.full(len(words), -1.0)
        for known, counts in self._seen:
            at = np.minimum(np.searchsorted(known, words), len(known) - 1)
            hit = known[at] == words
            found[hit] = counts[at[hit]]
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = self.quantised(words[new])
            self._remember(words[new], found[new])
        return found

    @cached_property
    def _seen(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sorted words with their counts: runs of falling length, few of them."""
        return []

    def _remember(self, words: np.ndarray, counts: np.ndarray) -> None:
        seen = self._seen
        seen.append((words, counts))
        while len(seen) > 1 and 2 * len(seen[-1][0]) > len(seen[-2][0]):
            (a, x), (b, y) = seen.pop(), seen.pop()
            at = np.searchsorted(b, a)
            seen.append((np.insert(b, at, a), np.insert(y, at, x)))
        if sum(len(k) for k, _ in seen) > SEEN:
            seen.clear()

    def exact(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the words that the head holds, and whether it holds them."""
        if not len(self.head):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.head, words), len(self.head) - 1)
        held = self.head[at] == words
        return np.where(held, self.head_counts[at], 0), held

    def base_log(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def token_logs(self, words: np.ndarray) -> np.ndarray:
        """log10 p of every token after the one before it."""
        unique, inverse = np.unique(words, return_inverse=True)
        one = self.quantised_words(unique)[inverse]
        both, back = np.unique(pairs(words), return_inverse=True)
        two = self.quantised(both)[back]
        start = self.quantised(np.array([END]))
        context = np.concatenate([start, one[:-1]])
        prior = (one + 0.5) / (self.total + 0.5 * (self.distinct + 1))
        mu = MU + 10 * self.noise
        return np.log10((two + mu * prior) / (context + self.noise + mu))


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of all parts with their counts added up."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return _group(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def _group(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    if not len(grams):
        return grams, counts
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.add.reduceat(counts, first)


def part_of(grams: np.ndarray, segments: int, slices: int) -> np.ndarray:
    """The part of each n-gram: its segment of the filter, cut into slices by other bits."""
    return segment_of(grams, segments) * slices + (mix(grams) % np.uint64(slices)).astype(np.int64)


def _emit(parts: list[tuple[np.ndarray, np.ndarray]], kind: int, segments: int, slices: int) -> pa.RecordBatch:
    """One row for each part: its n-grams seen once, then the others with their counts."""
    grams, counts = _sum(parts)
    part = part_of(grams, segments, slices)
    order = np.argsort(part, kind="stable")
    grams, counts, part = grams[order], counts[order], part[order]
    bounds = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part))
    rows = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        g, c = grams[a:b], counts[a:b]
        many = c > 1
        rows.append((int(part[a]), kind, g[~many].tobytes(), g[many].tobytes(), c[many].astype(np.uint64).tobytes()))
    columns = list(zip(*rows)) if rows else [()] * 5
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["part", "kind", "once", "many", "counts"])


FILLED = ["piece", "bits", "word", "times"]


def is_held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 1. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 1, F.lit(False))


def train(rows: DataFrame) -> LanguageModel:
    """Counts the words and word pairs of every row's ``text`` (null: empty) and builds the filter.

    Tasks count what they read and hand on packed counts by part of the n-grams; there are more
    parts the more text there is, and a task adds up one at a time, fills its segment of the
    filter and hands on the exact word counts. Segments that several parts filled are united
    piece by piece. A frequent word is one entry of each task, so no part is hot.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = int(min(MAX_BYTES << 3, max(1, BITS_PER_BYTE * size)) / (1 << SEGMENT_BITS)) + 1
    slices = int(size / PART_BYTES / segments) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        held = [0, 0]
        for batch in batches:
            for _a, _b, data, offsets in string_chunks(batch.column(0)):
                words, _ = tokens(data, offsets)
                for kind, grams in enumerate((words, pairs(words))):
                    unique, times = np.unique(grams, return_counts=True)
                    parts[kind].append((unique, times))
                    held[kind] += len(unique)
                    if held[kind] > HELD:
                        parts[kind] = [_sum(parts[kind])]
                        held[kind] = len(parts[kind][0][0])
                        if held[kind] > HELD // 2:
                            yield _emit(parts[kind], kind, segments, slices)
                            parts[kind], held[kind] = [], 0
        for kind in (0, 1):
            if parts[kind]:
                yield _emit(parts[kind], kind, segments, slices)

    def filled(part: int, kinds: list[list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        whole = [_sum(k) for k in kinds]
        words, times = whole[0]
        bits = fill_segment(np.concatenate([w[0] for w in whole]), np.concatenate([w[1] for w in whole]))
        pieces = [bits[a : a + PIECE] for a in range(0, len(bits), PIECE)]
        at = np.arange(len(pieces)) + part // slices * len(pieces)
        n, m = len(pieces), len(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(pieces, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], FILLED)
        if m:
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(words.view(np.int64)), pa.array(times)], FILLED)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kinds, held = None, [[], []], [0, 0]
        for batch in batches:
            for part, kind, once, many, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    if now is not None:
                        yield from filled(now, kinds)
                    now, kinds, held = part, [[], []], [0, 0]
                g, m = np.frombuffer(once, np.uint64), np.frombuffer(many, np.uint64)
                kinds[kind] += [(g, np.ones(len(g), np.int64)), (m, np.frombuffer(counts, np.int64))]
                held[kind] += len(g) + len(m)
                if held[kind] > HELD and held[kind] > 2 * len(kinds[kind][0][0]):
                    kinds[kind] = [_sum(kinds[kind])]
                    held[kind] = len(kinds[kind][0][0])
        if now is not None:
            yield from filled(now, kinds)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = None, None
        for batch in batches:
            for at, more in zip(*(c.to_pylist() for c in batch.columns)):
                if at == now:
                    bits |= np.frombuffer(more, np.uint8)
                    continue
                if now is not None:
                    yield pa.RecordBatch.from_pydict({"piece": [now], "bits": [bits.tobytes()]})
                now, bits = at, np.frombuffer(more, np.uint8).copy()
        if now is not None:
            yield pa.RecordBatch.from_pydict({"piece": [now], "bits": [bits.tobytes()]})

    counted = in_batches(rows.select("text")).mapInArrow(count, "part long, kind int, once binary, many binary, counts binary")
    dealt = counted.repartition("part").sortWithinPartitions("part")
    parts = written(dealt.mapInArrow(fill, "piece long, bits binary, word long, times long"), "lm-parts")
    pieces = parts.where("bits IS NOT NULL").select("piece", "bits")
    if slices > 1:
        pieces = pieces.repartition("piece").sortWithinPartitions("piece").mapInArrow(unite, "piece long, bits binary")
    words = parts.where("word IS NOT NULL").select("word", "times")
    by_size = words.groupBy(F.floor(F.log2("times")).alias("size")).agg(F.count("*").alias("words"), F.sum("times").alias("tokens")).collect()  # 64 rows at most
    total, distinct = sum(r["tokens"] for r in by_size), sum(r["words"] for r in by_size)
    floor, left = 1, MAX_HEAD
    for r in sorted(by_size, key=lambda r: -r["size"]):
        left -= r["words"]
        if left < 0:
            floor = 1 << r["size"] + 1
            break
    head = words.where(F.col("times") >= floor).toArrow()  # MAX_HEAD rows at most
    keys = head["word"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    bits = np.zeros(segments << SEGMENT_BITS - 3, np.uint8)
    for r in pieces.toLocalIterator():
        bits[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(r["bits"], np.uint8)
    return LanguageModel(bits, keys[order], head["times"].to_numpy()[order], floor, total, distinct, words)


RESULT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def score(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per row of ``documents``: counts of tokens, the exact base score and the model's.

    A null text counts as empty: one token, its end. Repeated rows are scored each.
    """
    words = model.words
    share = documents.sparkSession.sparkContext.broadcast(replace(model, words=None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row = share.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b, data, offsets in string_chunks(batch.column(2)):
                stream, bounds = tokens(data, offsets)
                lengths = np.diff(bounds)
                rows = np.repeat(np.arange(b - a), lengths)
                unique, inverse = np.unique(stream, return_inverse=True)
                counts, held = m.exact(unique)
                known = held if m.floor > 1 else counts > 0
                logs = np.where(held | (m.floor == 1), m.base_log(counts), 0.0)
                sums = [np.bincount(rows, v, b - a) for v in (logs[inverse], known[inverse].astype(float), m.token_logs(stream))]
                rare = np.flatnonzero(~held[inverse]) if m.floor > 1 else np.zeros(0, np.int64)
                slot, times = np.unique(rows[rare] * len(unique) + inverse[rare], return_counts=True)
                bounds = np.searchsorted(slot // max(1, len(unique)), np.arange(b - a + 1))
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(v)) for v in (unique[slot % max(1, len(unique))].view(np.int64), times)]
                columns = [pa.array(row + np.arange(b - a)), batch.column(0)[a:b], batch.column(1)[a:b], pa.array(lengths), pa.array(sums[1].astype(np.int64)), pa.array(sums[0]), pa.array(sums[2]), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "words", "times"])
                row += b - a

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, words array<long>, times array<long>"
    out = in_batches(documents.select("doc_id", is_held_out().alias("held_out"), "text")).mapInArrow(run, schema)
    if model.floor > 1:
        out = written(out, "lm-scores")
        rare = out.select("row", F.explode(F.arrays_zip(F.col("words").alias("word"), F.col("times").alias("n"))).alias("r")).select("row", "r.word", "r.n")
        found = rare.join(words, "word", "left")
        log = F.log10((F.coalesce("times", F.lit(0)) + 0.5) / F.lit(model.total + 0.5 * (model.distinct + 1)))
        rest = found.groupBy("row").agg(F.sum(F.col("n") * log).alias("more"), F.sum(F.when(F.col("times").isNotNull(), F.col("n"))).alias("more_known"))
        out = out.drop("words", "times").join(rest, "row", "left")
        out = out.withColumn("base_score", F.col("base_score") + F.coalesce("more", F.lit(0.0))).withColumn("n_known", F.col("n_known") + F.coalesce("more_known", F.lit(0)))
    return out.withColumn("train_tokens", F.lit(model.total).cast("long")).select(*RESULT)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score(documents, train(documents.where(~is_held_out())))
