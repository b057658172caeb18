"""Near-duplicates by the share of common shingles: SimHash brings candidates, whole sets decide.

A SimHash of SEGMENTS segments of BITS bits is made of each set of shingles; every shingle
counts once. Candidates agree in all but one bit of some segment: each half of a segment is a
bucket, whose members are indexed under the deletion variants of the other half, and CHECK_BITS
of CHECK words are compared. A bit differs with a chance of some 0.15 at a similarity of 0.8
(the angle between the sets over pi), so a pair at 0.8 is missed by all segments with a chance
of 0.000002; for sets of a dozen shingles, where majorities are coarse, that is up to 0.00002.
Sets of four and five shingles, of which one can hold the other, are indexed as they are as well.
A bucket hands on a spanning forest, never its pairs; the components of these links are compared
by whole sets of shingles, and only what reaches the similarity is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floppyscope.llm.common import LOWER, SPACE, in_batches, mix, span_hashes, string_chunks, word_spans, written
from floppyscope.llm.decontaminate import small
from floppyscope.llm.simhash import _roots, _split_hot, components, link_members

#: Least similarity of a link, as a fraction.
SIMILAR = (4, 5)
#: Segments of the fingerprint, and bits of one, an even number.
SEGMENTS, BITS = 70, 20
#: 64-bit words of the fingerprint.
FP_WORDS = -(-SEGMENTS * BITS // 64)
#: Words that members of a bucket are compared by, and bits that may differ in them. At 0.8 more differ with a
#: chance under 0.000001 (0.00001 for four shingles against five), in two strangers fewer with 0.000001.
CHECK, CHECK_BITS = 3, 62
#: Shingles of a component beyond which it is split into blocks, each pair of which is compared.
HOT = 2_000_000

_ODD = np.uint64(0xD1342543DE82EF95)
_KEYS = mix(np.arange(1, 2 * FP_WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, -1)
#: Shingles whose bits a byte can count, and shingles that are counted in one pass.
RUN, PASS = 255, 1024


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed shingles of each row, sorted, and the bounds of rows. A row with
    fewer words has one shingle of them all, one without words none."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets, SPACE)
    word = span_hashes(low, starts, ends)
    n = np.diff(first)
    many = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(many)])
    row = np.repeat(np.arange(len(n)), many)
    at = first[:-1][row] + np.arange(len(row)) - bounds[:-1][row]
    length = np.minimum(n, words)[row]
    h = np.zeros(len(row), np.uint64)
    for k in range(words):
        h = np.where(length > k, mix(h * _ODD + word[np.minimum(at + k, len(word) - 1)]), h) if len(row) else h
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(n)))])


def fingerprints(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """FP_WORDS words of SimHash for each set (rows with shingles only): a bit is 1 if over half the shingles have it."""
    full = np.flatnonzero(np.diff(bounds))
    n = np.diff(bounds)[full]
    if not len(full):
        return np.zeros((0, FP_WORDS), np.uint64)
    many = -(-n // RUN)
    first = np.cumsum(many) - many
    starts = np.repeat(bounds[full], many) + RUN * (np.arange(many.sum()) - np.repeat(first, many))
    ends = np.append(starts[1:], len(h))
    ones = np.empty((len(starts), FP_WORDS * 64), np.uint8)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + PASS, "right")))
        some = h[starts[a] : ends[b - 1], None]
        hashed = mix((some ^ _KEYS[0]) * (_KEYS[1] | np.uint64(1)))
        # Eight counters of a byte to a word.
        bits = np.unpackbits(hashed.view(np.uint8), axis=1, bitorder="little").view(np.uint64)
        ones[a:b] = np.add.reduceat(bits, starts[a:b] - starts[a], axis=0).view(np.uint8)
        a = b
    ones = np.add.reduceat(ones, first, axis=0, dtype=np.uint32) if (many > 1).any() else ones.astype(np.uint32)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64)


def signatures(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """A key of each row's set (0 if empty), and its prints: none for an empty set, else the words of
    the fingerprint and, for sets of four and five shingles, the keys of all their subsets of four."""
    n = np.diff(bounds)
    full = np.flatnonzero(n)
    mixed = mix(h ^ _ODD)
    sums = np.zeros(len(n), np.uint64)
    if len(full):
        sums[full] = np.add.reduceat(mixed, bounds[:-1][full])
    out = np.where(n > 0, mix(sums + n.astype(np.uint64)), np.uint64(0))
    prints = [np.zeros(0, np.uint64)] * len(n)
    for i, words in zip(full.tolist(), fingerprints(h, bounds)):
        prints[i] = words
    for i in np.flatnonzero((n == 4) | (n == 5)).tolist():
        left_out = mixed[bounds[i] : bounds[i + 1]] if n[i] == 5 else np.zeros(1, np.uint64)
        prints[i] = np.concatenate([prints[i], mix(sums[i] - left_out + np.uint64(4))])
    return out, prints


def segments(words: np.ndarray) -> np.ndarray:
    """The segments of fingerprints (a row each)."""
    out = np.empty((len(words), SEGMENTS), np.uint64)
    for s in range(SEGMENTS):
        k, shift = divmod(s * BITS, 64)
        out[:, s] = words[:, k] >> np.uint64(shift)
        if shift + BITS > 64:
            out[:, s] |= words[:, k + 1] << np.uint64(64 - shift)
    return out & np.uint64((1 << BITS) - 1)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each set's prints a row for each half of each segment: the bucket of the half, the other half and the words to compare."""
    half = BITS // 2
    names = ["key", "other", *(f"c{k}" for k in range(CHECK))]
    side = np.arange(2 * SEGMENTS, dtype=np.uint64) << np.uint64(half)
    for batch in batches:
        prints = batch.column(0)
        flat = prints.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        size = np.asarray(prints.value_lengths())
        at = np.cumsum(size) - size
        words = flat[at[:, None] + np.arange(FP_WORDS)]
        found = segments(words)
        low, high = found & np.uint64((1 << half) - 1), found >> np.uint64(half)
        key = np.concatenate([low, high], axis=1) | side
        row = np.repeat(np.arange(len(size)), size - FP_WORDS)  # of subsets; their keys are large, so they meet no half
        inner = np.arange(len(flat)) - np.repeat(at, size)
        keys = np.concatenate([key.ravel(), flat[inner >= FP_WORDS]])
        other = np.concatenate([np.concatenate([high, low], axis=1).ravel(), np.zeros(len(row), np.uint64)]).astype(np.int16)
        row = np.concatenate([np.repeat(np.arange(len(size)), key.shape[1]), row])
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(other), *(pa.array(words[row, k].view(np.int64)) for k in range(CHECK))], names)


def variants(bucket: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Keys of members of numbered buckets: the other half with one bit left out, for each bit."""
    bit = np.arange(BITS // 2)
    return ((bucket[:, None] << 8 | bit) << 16) | (other[:, None] & ~(1 << bit))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (first words) that span the components of all buckets (sorted by key) read together."""

    def out(parts: list[np.ndarray]) -> pa.RecordBatch:
        key, other, fp = parts[0], parts[1].astype(np.int64), np.stack(parts[2:]).view(np.uint64)
        bucket = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
        keys = variants(bucket, other).ravel()
        order = np.argsort(keys)
        member = order // (BITS // 2)
        child, root = link_members(keys[order], fp[:, member], CHECK_BITS)
        # Each node with the least that it hangs together with here, so that buckets hand on the same links of a large group.
        nodes, at = np.unique(fp[0].view(np.int64)[np.concatenate([member[child], member[root]])], return_inverse=True)
        label = _roots(len(nodes), at[: len(child)], at[len(child) :])
        apart = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(nodes[label[apart]])], ["a", "b"])

    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        rows += batch.num_rows
        if rows < 1 << 16 or held[0][0][0] == held[-1][0][-1]:
            continue
        parts = [np.concatenate(p) for p in zip(*held)]
        cut = int(np.searchsorted(parts[0], parts[0][-1]))  # the last bucket may go on in the next batch
        yield out([p[:cut] for p in parts])
        held, rows = [[p[cut:] for p in parts]], rows - cut
    if rows:
        yield out([np.concatenate(p) for p in zip(*held)])


def link_sets(sets: list[np.ndarray]) -> np.ndarray:
    """Roots of sorted sets, linked where the similarity reaches SIMILAR. A few pivots gather what
    lies around them; only members outside the largest gathering are compared with all others."""
    by_size = np.argsort([len(s) for s in sets], kind="stable")
    n = np.array([len(sets[i]) for i in by_size])
    bounds = np.concatenate([[0], np.cumsum(n)])
    unique, codes = np.unique(np.concatenate([sets[i] for i in by_size]), return_inverse=True)
    mark = np.zeros(len(unique), bool)
    num, den = SIMILAR

    def near(p: int) -> np.ndarray:
        a, b = int(np.searchsorted(den * n, num * n[p])), int(np.searchsorted(num * n, den * n[p], "right"))
        own = codes[bounds[p] : bounds[p + 1]]
        mark[own] = True
        common = np.add.reduceat(mark[codes[bounds[a] : bounds[b]]], bounds[a:b] - bounds[a], dtype=np.int64)
        mark[own] = False
        return a + np.flatnonzero(den * common >= num * (n[a:b] + n[p] - common))

    label = np.arange(len(n))
    for p in range(8):
        out = np.flatnonzero(label != np.bincount(label).argmax()) if p else label.copy()
        if not len(out):
            break
        pivot = int(out[len(out) // 2])
        found = near(pivot)
        label = _roots(len(n), np.full(len(found), pivot), found, label)
    for pivot in np.flatnonzero(label != np.bincount(label).argmax()).tolist():
        found = near(pivot)
        label = _roots(len(n), np.full(len(found), pivot), found, label)
    out = np.empty(len(n), np.int64)
    out[by_size] = by_size[label]
    return out


def _signed(rows: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in string_chunks(batch.column(2)):
                h, bounds = shingles(data, offsets, words)
                key, prints = signatures(h, bounds)
                ends = np.concatenate([[0], np.cumsum([len(p) for p in prints])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prints).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(key.view(np.int64)), lists], ["id", "content", "set", "prints"])

    kind = rows.schema["id"].dataType.simpleString()
    return in_batches(rows.select("id", "content", "text")).mapInArrow(run, f"id {kind}, content long, set long, prints array<long>")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that span the components of every bucket (sorted bucket, set, hashes)."""
    last, nodes, sets = None, [], []

    def out() -> pa.RecordBatch:
        at = np.array(nodes, np.int64)
        root = at[link_sets(sets)] if len(at) > 1 else at
        apart = at != root
        pair = np.maximum(at, root)[apart], np.minimum(at, root)[apart]
        return pa.RecordBatch.from_arrays([pa.array(p) for p in pair], ["a", "b"])

    for batch in batches:
        for bucket, node, hashes in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != last:
                if len(nodes) > 1:
                    yield out()
                last, nodes, sets = bucket, [], []
            nodes.append(node)
            sets.append(np.frombuffer(hashes, np.uint64))
    if len(nodes) > 1:
        yield out()


def similar(rows: DataFrame, words: int) -> DataFrame:
    """(id, fingerprint, component_id) of every row of ``rows`` (id, text), as ``near_duplicates``
    gives them, with links between texts that share SIMILAR of their distinct shingles. Texts
    without words are alike and like no other."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in string_chunks(batch.column(2)):
                h, bounds = shingles(data, offsets, words)
                packed = [h[bounds[i] : bounds[i + 1]].tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(np.diff(bounds)), pa.array(packed, pa.binary())], ["set", "root", "size", "hashes"])

    rows = rows.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("content"), "text")
    found = written(_signed(rows, words), "signatures")
    distinct = written(found.groupBy("set").agg(F.min("id").alias("least_id"), F.min("content").alias("content"), F.first("prints").alias("prints")), "distinct-sets")
    checks = [f"c{k}" for k in range(CHECK)]
    spread = "key long, other short, " + ", ".join(f"{c} long" for c in checks)
    prints = distinct.where(F.size("prints") > 0).select("prints", F.element_at("prints", 1).alias("c0"))
    keyed = _split_hot(prints, lambda df: df.mapInArrow(_indexed, spread), "c0", ("other", *checks[1:])).select("key", "other", *checks)
    # Sets of one first word are one node here; whatever falls together is compared.
    linked = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_linked, "a long, b long")
    # Tasks differ in the least that they know of a large group; all that a node was given go to the least of them.
    given = linked.groupBy("a").agg(F.collect_set("b").alias("b")).select("a", "b", F.array_min("b").alias("least"))
    star = components(given.select(F.explode(F.concat(F.array("a"), F.array_remove("b", F.col("least")))).alias("a"), F.col("least").alias("b")).distinct())
    node = F.element_at("prints", 1)
    groups = distinct.where(F.size("prints") > 0).select("set", "content", node.alias("node")).join(star, F.col("node") == F.col("a"), "left").select("set", "content", F.coalesce("b", "node").alias("root"))
    shared = written(groups.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root"), "shared-roots")
    members = written(groups.join(small(shared), "root").select("set", "root", "content"), "candidates")
    texts = rows.select("content", "text").join(small(members), "content").dropDuplicates(["set"]).select("set", "root", "text")
    sets = written(in_batches(texts).mapInArrow(whole, "set long, root long, size long, hashes binary"), "sets")
    weight = sets.groupBy("root").agg(F.sum("size").alias("n")).where(F.col("n") > HOT)
    hot = written(weight.select("root", F.ceil(F.col("n") / HOT).cast("int").alias("blocks")), "hot-sets")
    own = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(own, o) * F.col("blocks") + F.greatest(own, o))
    part = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(None).cast("int"))).otherwise(pairs)).alias("part")
    parted = sets.join(small(hot), "root", "left").select("root", "set", "hashes", part)
    bucket = F.when(F.col("part").isNull(), F.col("root")).otherwise(F.xxhash64("root", "part")).alias("bucket")
    linked = parted.select(bucket, "set", "hashes").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_compared, "a long, b long").distinct()
    star = components(linked)
    rooted = distinct.join(star, distinct.set == star.a, "left").select("set", "least_id", F.coalesce("b", "set").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = written(rooted.join(least, "root").select("set", "component_id"), "classes")
    first = F.when(F.size("prints") > 0, F.element_at("prints", 1)).otherwise(F.lit(0).cast("long"))
    return found.join(classes, "set").select("id", F.lpad(F.lower(F.hex(first)), 16, "0").alias("fingerprint"), "component_id")
