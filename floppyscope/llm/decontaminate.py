"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every WINDOW consecutive hashes of GRAM words the least is kept as a fingerprint, so a
shared run of GRAM + WINDOW - 1 = 10 words always shares a fingerprint. Fingerprints of
documents are joined with those of the benchmark; documents with a hit are read again and the
hits extended to all windows of ten words. Items of fewer words are one window of their own
length, for which every window of that length of a document is a fingerprint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floppyscope.llm.common import row_key, table, written

SPAN = 10
GRAM = 5
WINDOW = SPAN - GRAM + 1
#: Bytes of a side that is broadcast at most; beyond that the join shuffles. A row without lists takes ROW_BYTES at most.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 80

#: What stands between words, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def _grams(words: Column, n: int) -> Column:
    """Hashes of every ``n`` consecutive words; none if there are fewer."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.slice(words, i, n)))).otherwise(F.array().cast("array<bigint>"))


def fingerprints(words: Column) -> Column:
    """The least of every WINDOW consecutive gram hashes, each once; none below SPAN words."""
    least = lambda g: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(g) - (WINDOW - 1)), lambda i: F.array_min(F.slice(g, i, WINDOW))))
    return F.when(F.size(words) >= SPAN, let(_grams(words, GRAM), least)).otherwise(F.array().cast("array<bigint>"))


def _prints(words: Column, short: list[int]) -> Column:
    """(n, f) of a text: fingerprints with n = SPAN, and all windows of the short lengths."""

    def tagged(n: int, hashes: Column) -> Column:
        return F.transform(hashes, lambda f: F.struct(F.lit(n).alias("n"), f.alias("f")))

    kinds = [tagged(SPAN, fingerprints(words)), *(tagged(n, F.array_distinct(_grams(words, n))) for n in short)]
    return F.concat(*kinds) if short else kinds[0]


def _windows(words: Column, n: Column) -> Column:
    """Every window of ``n`` words with its place: two independent hashes of 64 and 32 bits."""
    window = lambda i: let(F.slice(words, i, n), lambda w: F.struct(i.alias("p"), F.xxhash64(w).alias("h"), F.hash(w).alias("h2")))
    return F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), window)


def small(df: DataFrame, size: Column | None = None) -> DataFrame:
    """``df``, marked for broadcast if it is proved to be small: by its count of rows, or by the
    sum of ``size``, the bytes of a row, where rows hold lists."""
    if size is None:
        fits = df.limit(BROADCAST_BYTES // ROW_BYTES + 1).count() <= BROADCAST_BYTES // ROW_BYTES
    else:
        fits = (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES
    return F.broadcast(df) if fits else df


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): words, words in windows of ``benchmark``
    (item_id, text), items hit and their digest.

    Null texts have no words; an item without words hits nothing. Items with a null id hit
    words but aren't counted or listed. Repeated rows come out as often as they went in. An
    empty benchmark hits nothing. ``key`` is row_key of the row; rows are told apart by id and key.
    """
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where("size(w) > 0").withColumn("n", F.least(F.lit(SPAN), F.size("w")))
    items = written(items, "items")
    short = sorted(r["n"] for r in items.where(F.col("n") < SPAN).select("n").distinct().collect())  # 1 to 9
    item_prints = items.select(F.explode(_prints(F.col("w"), [])).alias("s")).select("s.n", "s.f")
    whole = items.where(F.col("n") < SPAN).select("n", F.xxhash64("w").alias("f"))
    item_prints = written(item_prints.unionByName(whole).distinct().withColumn("hit", F.lit(True)), "item-prints")

    # One pass over all documents: a row for each fingerprint, which adds up to one row for each text.
    parsed = documents.select("doc_id", row_key().alias("key"), let(words_of(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), _prints(w, short).alias("prints"))).alias("d"))
    spread = parsed.select("doc_id", "key", F.col("d.n_words").alias("n_words"), F.posexplode_outer("d.prints").alias("at", "s"))
    found = spread.select("doc_id", "key", "n_words", F.coalesce("at", F.lit(0)).alias("at"), "s.n", "s.f").join(small(item_prints), ["n", "f"], "left")
    rows = found.groupBy("key", "doc_id").agg(F.max("n_words").cast("long").alias("n_words"), F.count_if(F.col("at") == 0).alias("copies"), F.coalesce(F.max("hit"), F.lit(False)).alias("near"))
    rows = written(rows, "decontaminate")

    item_windows = items.select("item_id", "n", F.explode(_windows(F.col("w"), F.col("n"))).alias("s"))
    item_windows = item_windows.groupBy("n", "s.h", "s.h2").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    item_windows = written(item_windows, "item-windows")
    near = rows.where("near").select(F.struct("doc_id", "key").alias("other")).distinct()
    texts = documents.select(F.struct("doc_id", row_key().alias("key")).alias("id"), "text")
    texts = texts.join(small(near), F.col("id").eqNullSafe(F.col("other")), "left_semi")
    lengths = F.explode(F.array(*map(F.lit, [*short, SPAN]))).alias("n")
    windows = texts.select("id", words_of(F.col("text")).alias("w")).select("id", "w", lengths).where(F.size("w") >= F.col("n"))
    windows = windows.select("id", "n", F.explode(_windows(F.col("w"), F.col("n"))).alias("s")).select("id", "n", "s.p", "s.h", "s.h2")
    hits = windows.join(small(item_windows), ["n", "h", "h2"]).groupBy("id").agg(F.collect_set(F.struct("p", "n")).alias("spans"), F.collect_set("items").alias("items"))
    cover = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("hit"), F.lit(1).alias("next")),
        lambda s, x: F.struct((s["hit"] + x["p"] + x["n"] - F.greatest(x["p"], F.least(s["next"], x["p"] + x["n"]))).alias("hit"), F.greatest(s["next"], x["p"] + x["n"]).alias("next")),
        lambda s: s["hit"].cast("long"),
    )
    hits = hits.select("id", cover.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    out = rows.join(hits, F.struct("doc_id", "key").eqNullSafe(F.col("id")), "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(
        "key",
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


_WORDS_SQL = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda x: x <> '')"

ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS_SQL} AS w FROM documents),
i AS (SELECT item_id, w, least({SPAN}, len(w)) AS n FROM (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM i)),
dw AS (SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS s
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
hits AS (SELECT r, p, n, item_id FROM dw JOIN iw USING (n, s)),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN ids USING (r)
"""
