"""Near-duplicates by SimHash, found with deletion-variant signatures.

Two fingerprints that differ in at most 4 bits differ in at most one bit of one of three
segments. Each distinct fingerprint is indexed under its three segments and under every
segment with one bit left out; an equality join on these keys brings linked fingerprints
together, and the bits are compared. A bucket hands on a spanning forest of its links, never
its pairs. Components grow by alternating stars, with a written table for each round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floppyscope.llm.common import LOWER, SPACE, discard, in_batches, scratch_path, string_chunks, table, word_spans, written
from floppyscope.llm.decontaminate import BROADCAST_BYTES, ROW_BYTES, small

WORDS = 4
MAX_BITS = 4
#: First bit and end of each segment; one more than MAX_BITS // 2, so that one differs by a bit at most.
SEGMENTS = ((0, 21), (21, 42), (42, 64))
#: Rows of a bucket up to which all distances are taken in one pass over neighbours.
SMALL = 48
#: Rows of a bucket beyond which it is split into blocks, each pair of which is a bucket.
HOT = 20_000
#: Edges of a node beyond which it joins by broadcast.
HUB = 100
#: One in so many fingerprints is counted to find such buckets.
SAMPLE = 64


def _shingle_spans(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words joined by one blank, the spans of shingles in them, and the bounds of rows."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets, SPACE)
    space = SPACE[low]
    low[space] = 32
    keep = ~space
    keep[ends[ends < len(low)]] = True  # one separator after each word
    place = np.concatenate([[0], np.cumsum(keep)])
    starts, ends = place[starts], place[ends]
    n = np.diff(first)
    many = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(many)])
    row = np.repeat(np.arange(len(n)), many)
    at = first[:-1][row] + np.arange(len(row)) - bounds[:-1][row]
    return low[keep].tobytes(), starts[at], ends[at + np.minimum(n, words)[row] - 1], bounds


def fingerprints(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The fingerprint of each row: a bit is 1 if over half the shingles' XXH64 (seed 42) have it; 0 without words."""
    joined, starts, ends, bounds = _shingle_spans(data, offsets, words)
    out = np.zeros(len(offsets) - 1, np.uint64)
    if not len(starts):
        return out
    xxh64 = xxhash.xxh64_intdigest
    h = np.fromiter((xxh64(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    rows = np.flatnonzero(np.diff(bounds))
    n = np.diff(bounds)[rows]
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, bounds[:-1][rows], axis=0, dtype=np.int64)
    out[rows] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint_rows(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, fp) of every row of ``rows`` (id of any type, text); a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints(data, offsets, words) for _a, _b, data, offsets in string_chunks(batch.column(1))]
            fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    kind = rows.schema["id"].dataType.simpleString()
    return in_batches(rows.select("id", "text")).mapInArrow(run, f"id {kind}, fp long")


def variants(fp: np.ndarray) -> np.ndarray:
    """Keys of each fingerprint: three segments whole, then 64 segments with one bit left out."""
    keys = np.empty((len(fp), 3 + 64), np.uint64)
    for s, (a, b) in enumerate(SEGMENTS):
        part = fp >> np.uint64(a) & np.uint64((1 << b - a) - 1)
        keys[:, s] = part | np.uint64(64 + s) << np.uint64(32)
        for j in range(a, b):
            keys[:, 3 + j] = part & ~np.uint64(1 << j - a) | np.uint64(j) << np.uint64(32)
    return keys


def _roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """For each of n nodes the least node that it hangs together with by the links a - b."""
    label = np.arange(n) if label is None else label
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _near(x: np.ndarray, y: np.ndarray, bits: int, words: bool = False) -> np.ndarray:
    """Whether fingerprints are at most ``bits`` apart; ``words``: the first axis holds the words of each."""
    n = np.bitwise_count(x ^ y)
    return (n.sum(0, dtype=np.uint16) if words else n) <= bits


def link_large(fp: np.ndarray, bits: int = MAX_BITS) -> np.ndarray:
    """Roots of one large bucket. A few pivots gather what lies around them; only members
    outside the largest gathering are then compared with all others, block by block.
    The last axis of ``fp`` is the members; fingerprints of several words have one before it."""
    n, words = fp.shape[-1], fp.ndim > 1
    label = np.arange(n)
    for p in range(8):
        out = np.flatnonzero(label != np.bincount(label).argmax()) if p else np.arange(n)
        if not len(out):
            return label
        pivot = out[len(out) // 2]
        near = np.flatnonzero(_near(fp, fp[..., pivot, None], bits, words))
        label = _roots(n, np.full(len(near), pivot), near, label)
    out = np.flatnonzero(label != np.bincount(label).argmax())
    step = max(1, (1 << 21) // fp.size)
    for k in range(0, len(out), step):
        some = out[k : k + step]
        i, j = np.nonzero(_near(fp[..., some, None], fp[..., None, :], bits, words))
        label = _roots(n, some[i], j, label)
    return label


def link_members(key: np.ndarray, fp: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places (child, root) that span the components of every bucket; ``key`` is sorted."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(first)
    out_a, out_b = [], []
    many = size > 1
    small = np.flatnonzero(np.repeat(many & (size <= SMALL), size))
    k, f = key[small], fp[..., small]
    label = np.arange(len(k))
    at = np.arange(len(k))
    for d in range(1, SMALL):
        at = at[at < len(k) - d]
        at = at[k[at] == k[at + d]]
        if not len(at):
            break
        near = at[_near(f[..., at], f[..., at + d], bits, fp.ndim > 1)]
        if len(near):
            label = _roots(len(k), near, near + d, label)
    child = np.flatnonzero(label != np.arange(len(k)))
    out_a.append(small[child])
    out_b.append(small[label[child]])
    for b in np.flatnonzero(size > SMALL).tolist():
        label = link_large(fp[..., first[b] : first[b + 1]], bits)
        child = np.flatnonzero(label != np.arange(len(label)))
        out_a.append(first[b] + child)
        out_b.append(first[b] + label[child])
    return np.concatenate(out_a), np.concatenate(out_b)


def link_buckets(key: np.ndarray, fp: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, fp) that span the components of every bucket; ``key`` is sorted."""
    child, root = link_members(key, fp, bits)
    return fp[child], fp[root]


def links(distinct: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b), a > b, whose components are those of all fingerprints at most ``bits`` apart."""
    if bits > MAX_BITS:
        raise ValueError("three segments find fingerprints that differ in up to 4 bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for a in range(0, len(all_fp), 8192):
                fp = all_fp[a : a + 8192]
                keys = variants(fp)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fp, keys.shape[1]).view(np.int64))], ["key", "fp"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            x, y = link_buckets(key, fp, bits)
            pair = np.unique(np.stack([np.maximum(x.view(np.int64), y.view(np.int64)), np.minimum(x.view(np.int64), y.view(np.int64))]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            held.append((k, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            rows += len(k)
            if rows < 1 << 18 or held[0][0][0] == k[-1]:
                continue
            key, fp = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
            yield out(key[:cut], fp[:cut])
            held, rows = [(key[cut:], fp[cut:])], len(key) - cut
        if rows:
            yield out(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))

    keyed = _split_hot(distinct.select("fp"), lambda df: df.mapInArrow(spread, "key long, fp long"))
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(join, "a long, b long").distinct()


def _split_hot(fps: DataFrame, spread: Callable[[DataFrame], DataFrame], fp: str = "fp", others: tuple[str, ...] = ()) -> DataFrame:
    """The index (key, ``fp``, ``others``) of ``fps``, in which a row of a hot bucket goes to every pair of blocks that
    holds its own. Any two rows of a bucket still meet, so a sample may tell what is hot."""
    some = spread(fps.where(F.pmod(F.xxhash64(fp), F.lit(SAMPLE)) == 0)).groupBy("key").agg(F.count("*").alias("n"))
    hot = written(some.where(F.col("n") * SAMPLE > HOT).select("key", F.ceil(F.col("n") * SAMPLE / HOT).cast("int").alias("blocks")), "hot-buckets")
    keyed = spread(fps)
    if hot.isEmpty():
        return keyed
    own = F.pmod(F.xxhash64(fp, F.lit(1)), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(own, o) * F.col("blocks") + F.greatest(own, o))
    part = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(None).cast("int"))).otherwise(pairs)).alias("part")
    rows = keyed.join(small(hot), "key", "left").select("key", fp, *others, part)
    # Two keys that fall together by chance are compared more, and nothing else.
    return rows.select(F.when(F.col("part").isNull(), F.col("key")).otherwise(F.xxhash64("key", "part")).alias("key"), fp, *others)


def _with_least(edges: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """``edges`` (a, b) with the ``least`` of their a, a broadcast join as long as few nodes are left.
    Beyond that a node of many edges would be a hot key of the join; there are few such nodes, by
    count, so theirs is a broadcast join still."""
    if least.count() <= BROADCAST_BYTES // ROW_BYTES:
        return edges.join(F.broadcast(least.select("a", "least")), "a")
    many = max(HUB, 2 * n_edges * ROW_BYTES // BROADCAST_BYTES + 1)  # so at most BROADCAST_BYTES // ROW_BYTES nodes have more
    hubs = least.where(F.col("n") > many).select("a", F.col("least").alias("hub_least"))
    if hubs.isEmpty():
        return edges.join(least.select("a", "least"), "a")
    rest = least.where(F.col("n") <= many).select("a", "least")
    found = edges.join(F.broadcast(hubs), "a", "left")
    others = found.where("hub_least IS NULL").select("a", "b").join(rest, "a")
    return found.where("hub_least IS NOT NULL").select("a", "b", F.col("hub_least").alias("least")).unionByName(others)


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node a of ``edges`` (a > b) that isn't the least of its component, with that least b.

    Alternating large and small stars. Each half of a round is a written table, and so are the
    least neighbours that it joins: as one plan a round would read its edges some sixty times.
    A round's tables replace those of the one before, and the driver sees one count and one
    hash of them.
    """
    spark = edges.sparkSession
    path = scratch_path(spark, "links")
    edges = written(edges, "links", path)
    n, seen, last = edges.count(), None, [path]

    def least_of(stars: DataFrame) -> DataFrame:
        return stars.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n"))

    while True:
        paths = [scratch_path(spark, "links") for _ in range(4)]
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(least_of(both), "least", paths[0])
        large = _with_least(both.where("b > a"), least, 2 * n).select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
        large = written(large, "large-stars", paths[1])
        # A node now has an edge for each star that it was in, equal ones among them; the least of them takes the others on.
        low = written(least_of(large), "low", paths[2])
        small = _with_least(large, low, 2 * n).where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = written(small.unionByName(low.select("a", F.col("least").alias("b"))).distinct(), "links", paths[3])
        now = tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
        discard(spark, last + paths[:3])
        if now == seen:
            return edges
        last, seen, n = paths[3:], now, now[0]


def near_duplicates(rows: DataFrame, words: int = WORDS, bits: int | None = None) -> DataFrame:
    """(id, fingerprint, component_id) of every row of ``rows`` (id, text).

    ``bits`` that links may differ in are MAX_BITS for shingles of WORDS words. Shingles of other
    lengths are linked by their exact similarity (``similar``) if ``bits`` isn't given.
    Ids can be of any type with an order. ``component_id`` is the least id that is reached over links. Rows without words have the
    fingerprint zero and link like others. A null id gets the least id of its component, or
    null if none has one; repeated rows come out as often as they went in.
    """
    if bits is None:
        if words != WORDS:
            from floppyscope.llm.similar import similar

            return similar(rows, words)
        bits = MAX_BITS
    found = written(fingerprint_rows(rows, words), "fingerprints")
    distinct = written(found.groupBy("fp").agg(F.min("id").alias("least_id")), "distinct-fingerprints")
    star = components(links(distinct, bits))
    rooted = distinct.join(star, distinct.fp == star.a, "left").select("fp", "least_id", F.coalesce("b", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = written(rooted.join(least, "root").select("fp", "component_id"), "classes")
    return found.join(classes, "fp").select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return near_duplicates(documents.select(F.col("doc_id").alias("id"), "text")).withColumnRenamed("id", "doc_id")
