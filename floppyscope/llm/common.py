"""What the operators share: scratch tables, row keys and vectorised views of text.

Text views work on the UTF-8 bytes of an Arrow string column, so a batch of documents is
split into words with a few numpy passes and no Python loop over words.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes; its 64-bit intermediates are eight times as large.
CHUNK_BYTES = 1 << 18
#: The same where distinct pieces are looked up, of which larger runs hold relatively fewer.
WIDE_BYTES = 1 << 20

_local_scratch: dict[str, str] = {}
#: Paths of the scratch tables of this process.
_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    That folder is ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given. Where both
    are unset, a temporary folder of this process stands in for it, on a local master only:
    elsewhere each executor would write to its own disk, and reads would miss those files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _local_scratch.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="floppyscope-"))
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch tables that nothing will read again."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        if path in _scratch:
            _scratch.remove(path)


def clean(spark: SparkSession) -> None:
    """Deletes all scratch tables that this process has written. Results that read them must
    have been used or written by then; a long-lived session calls this between queries."""
    discard(spark, list(_scratch))


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` as a table written once to the shared folder; its lineage ends there, so a
    lost executor costs a reread and never a recomputation."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that Spark hands to Python at once, so that a worker holds some megabytes of text.
BATCH_ROWS = 1_000


def in_batches(rows: DataFrame) -> DataFrame:
    """``rows``, with Arrow batches of BATCH_ROWS at most from now on in this session."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key of the row's content. Rows equal in id and text share it and get equal results."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("\x00")), F.coalesce(F.col(text), F.lit("")))


# ---------------------------------------------------------------- vectorised text


def byte_table(members: str | bytes) -> np.ndarray:
    """A lookup of 256 booleans, true for the given bytes."""
    t = np.zeros(256, bool)
    t[list(members if isinstance(members, bytes) else members.encode("latin-1"))] = True
    return t


#: White space that ends a word: U+0020 and U+0009 to U+000D.
SPACE = byte_table(b" \t\n\x0b\x0c\r")
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def string_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Views (first row, end row, bytes, offsets) of runs of rows with up to ``limit`` bytes.

    A null counts as the empty text. A longer text is a run of its own; none is cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, wide, n + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that ``separator`` doesn't hold, and for each
    row the index of its first run (one more entry than rows). Runs never cross rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = ~separator[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(word[1:], word[:-1], out=edge[1:-1])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    inside = word[at[:-1]]
    starts, ends = at[:-1][inside], at[1:][inside]
    return starts, ends, np.searchsorted(starts, offsets)


#: Two primes under 2**31 and a base for each; a hash of bytes is a pair of polynomials modulo them.
PRIMES = (2147483647, 2147483629)
BASES = (1220703125, 1676531827)
#: Bytes up to which sums of (byte + 1) * power stay under 2**64.
EXACT_BYTES = 1 << 24
_tables: dict[int, list[np.ndarray]] = {}


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    t = np.ones(n, np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        t[have : have + more] = t[:more] * np.uint64(pow(base, have, prime)) % np.uint64(prime)
        have += more
    return t.astype(np.uint32)


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of each base and of its inverse; kept for runs of usual size only."""
    size = next((kept for kept in (CHUNK_BYTES + 1024, WIDE_BYTES + 1024) if n <= kept), n)
    if size in _tables:
        return _tables[size]
    made = [_powers(x, p, size) for b, p in zip(BASES, PRIMES) for x in (b, pow(b, -1, p))]
    if size <= WIDE_BYTES + 1024:
        _tables[size] = made
    return made


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, alike wherever the bytes stand.

    Two polynomials modulo primes under 2**31 make 62 bits, which are then spread with the
    length. A polynomial modulo a power of two would take some regular texts for equal.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    tables = _power_tables(len(data) + 1)
    letters = data.astype(np.uint64)
    letters += np.uint64(1)
    out = []
    for k, prime in enumerate(map(np.uint64, PRIMES)):
        power, inverse = tables[2 * k], tables[2 * k + 1]
        terms = letters * power[: len(data)]
        if len(data) > EXACT_BYTES:
            terms %= prime
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        out.append((sums[ends] - sums[starts]) % prime * inverse[starts] % prime)
    return mix((out[0] << np.uint64(31) | out[1]) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def same_bytes(data: np.ndarray, starts: np.ndarray, other: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether ``lengths`` bytes of ``data`` from ``starts`` equal those of ``other`` from ``at``,
    for each span. The spans of ``data`` stand in order and don't overlap."""
    out = np.ones(len(starts), bool)
    ends = np.cumsum(lengths)
    a = 0
    while a < len(starts):  # some megabytes at a time
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + WIDE_BYTES, "right")))
        n = lengths[a:b]
        unlike = np.flatnonzero(_joined(data, starts[a:b], n) != other[ragged(at[a:b], n)])
        if len(unlike):
            out[a + np.searchsorted(np.cumsum(n), unlike, "right")] = False
        a = b
    return out


def _joined(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of spans that stand in order: a view of ``data``, less what lies between them."""
    ends = starts + lengths
    view = data[starts[0] : ends[-1]]
    gaps = starts[1:] - ends[:-1]
    if not gaps.any():
        return view
    kept = np.ones(len(view), bool)
    kept[ragged(ends[:-1] - starts[0], gaps)] = False
    return view[kept]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start .. start + length - 1 of every span, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
