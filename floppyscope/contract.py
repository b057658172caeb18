"""Queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floppyscope.functions import binary, charsets, content, disk, names, timing
from floppyscope.operators import relational as ops

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL under ``name``."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def rows_of(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def url_path(url: str = "url") -> Column:
    """Host and path of a URL as one slash-separated path, without query and fragment."""
    return F.regexp_replace(F.col(url), r"^[a-z]+://|[?#].*$", "")


# ------------------------------------------------------------------ aggregation, top-k


@query(
    "ext_breakdown",
    """SELECT d.source, x.description, count(*) AS files, sum(d.n_chars)::BIGINT AS total
       FROM documents d LEFT JOIN (VALUES ('src0', 'main feed'), ('src1', 'first mirror')) x(source, description) USING (source)
       GROUP BY ALL""",
)
def ext_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = rows_of(spark, "source string, description string", [("src0", "main feed"), ("src1", "first mirror")])
    return ops.totals_by(table(spark, sf_dir, "documents"), "source", "n_chars", words)


@query("largest_files", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 12")
def largest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.largest(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 12)


@query(
    "largest_per_group",
    """SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id)::INT AS rank
       FROM documents QUALIFY rank <= 3""",
)
def largest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.largest(table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), "n_chars", "doc_id", 3, "lang")


@query(
    "volume_stats",
    """SELECT l_returnflag AS volume, count(*) AS entries, count(DISTINCT l_orderkey) AS files, sum(l_quantity::DECIMAL(18,2))::DECIMAL(28,2) AS bytes,
              count(*) FILTER (WHERE l_linenumber = 1) AS heads, bool_and(l_discount <= 0.1) AS clean FROM lineitem GROUP BY l_returnflag""",
)
def volume_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("volume")).agg(
        F.count("*").alias("entries"),
        F.count_distinct("l_orderkey").alias("files"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(28,2)").alias("bytes"),
        F.count_if(F.col("l_linenumber") == 1).alias("heads"),
        F.bool_and(F.col("l_discount") <= 0.1).alias("clean"),
    )


@query(
    "dir_summary",
    r"""WITH p AS (SELECT string_split(regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g'), '/') AS parts, length(html) AS size FROM pages),
       a AS (SELECT parts, size, unnest(range(1, len(parts))) AS d FROM p)
       SELECT array_to_string(parts[:d], '/') AS directory, count(*) FILTER (WHERE d = len(parts) - 1) AS own_files, count(*) AS all_files, sum(size)::BIGINT AS bytes
       FROM a GROUP BY 1""",
)
def dir_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(url_path().alias("path"), F.char_length("html").cast("long").alias("size"))
    return ops.directory_totals(pages, "path", "size")


@query(
    "glob_keepset",
    r"""WITH p AS (SELECT string_split(regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g'), '/') AS parts FROM pages)
       SELECT DISTINCT array_to_string(parts[:d], '/') AS path FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS d FROM p WHERE regexp_full_match(parts[-1], '1.*5'))""",
)
def glob_keepset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.keep_set(table(spark, sf_dir, "pages").select(url_path().alias("path")), "path", "1*5")


@query(
    "ext_of_path",
    r"""WITH p AS (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/\\]*$') AS name FROM pages)
       SELECT page_id, CASE WHEN contains(name, '.') AND name NOT LIKE '%.' THEN lower(regexp_extract(name, '[^.]*$')) END AS ext,
              regexp_extract(name, '^[^.]*') AS stem FROM p""",
)
def ext_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", names.extension(path).alias("ext"), names.stem(path).alias("stem"))


@query("cross_links", "SELECT l_orderkey, l_linenumber, count(*) AS refs FROM lineitem GROUP BY ALL HAVING count(*) >= 2")
def cross_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.multiply_used(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("lost_clusters", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def lost_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.unreferenced(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey")


_KIND_SQL = """CASE WHEN entry = 0 THEN 'Free' WHEN entry BETWEEN 2 AND 4079 THEN CASE WHEN entry < 1002 THEN 'Next' ELSE 'OutOfRange' END
       WHEN entry BETWEEN 4080 AND 4086 THEN 'Reserved' WHEN entry = 4087 THEN 'Bad' ELSE 'End' END"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.pmod(F.col("l_partkey") * 37, F.lit(4096)).cast("int").alias("entry")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", entry).withColumn("kind", disk.pointer_kind(F.lit("FAT12"), "entry", F.lit(1000)))


@query("pointer_classify", f"WITH e AS (SELECT (l_partkey * 37) % 4096 AS entry FROM lineitem) SELECT {_KIND_SQL} AS kind, count(*) AS entries FROM e GROUP BY 1")
def pointer_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("entries"))


@query("bad_pointers", f"WITH e AS (SELECT l_orderkey, ((l_partkey * 37) % 4096)::INT AS entry FROM lineitem) SELECT l_orderkey, entry FROM e WHERE {_KIND_SQL} = 'OutOfRange'")
def bad_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).where("kind = 'OutOfRange'").select("l_orderkey", "entry")


@query(
    "fat12_unpack",
    """WITH b AS (SELECT p_partkey, (p_partkey * 7 + 1) % 256 AS b0, (p_partkey * 13 + 5) % 256 AS b1, (p_partkey * 29 + 11) % 256 AS b2 FROM part)
       SELECT p_partkey, (((b1 << 8) | b0) & 4095)::INT AS even_entry, ((((b2 << 8) | b1)) >> 4)::INT AS odd_entry FROM b""",
)
def fat12_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    hexed = [F.lpad(F.hex((key * a + b) % 256), 2, "0") for a, b in ((7, 1), (13, 5), (29, 11))]
    packed = table(spark, sf_dir, "part").select("p_partkey", F.unhex(F.concat(*hexed)).alias("fat"))
    return packed.select("p_partkey", disk.fat12_entry("fat", F.lit(0)).alias("even_entry"), disk.fat12_entry("fat", F.lit(1)).alias("odd_entry"))


@query(
    "chain_walk",
    """WITH RECURSIVE n AS (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER w AS next, row_number() OVER w AS k FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
       c AS (SELECT o_custkey, o_orderkey AS cluster, next, 0 AS step FROM n WHERE k = 1
             UNION ALL SELECT n.o_custkey, n.o_orderkey, n.next, c.step + 1 FROM c JOIN n ON n.o_orderkey = c.next WHERE c.step < 64)
       SELECT o_custkey, cluster, step::INT AS step FROM c""",
)
def chain_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from floppyscope.operators.chains import walk

    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    links = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lead("o_orderkey").over(order).alias("next"), (F.row_number().over(order) == 1).alias("head"))
    return walk(links, "o_custkey", "o_orderkey", "next", "head").withColumnRenamed("node", "cluster")


@query(
    "fragmentation",
    """WITH s AS (SELECT o_custkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS step FROM orders),
       f AS (SELECT o_custkey, bool_or(coalesce(step, 1) <> 1) AS fragmented FROM s GROUP BY 1)
       SELECT count(*) AS files, count(*) FILTER (WHERE fragmented) AS fragmented, (1000 * count(*) FILTER (WHERE fragmented)) // count(*) AS permille FROM f""",
)
def fragmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    per_file = ops.fragmented(orders, "o_custkey", "at", "o_orderkey")
    bad = F.count_if(F.col("fragmented"))
    return per_file.agg(F.count("*").alias("files"), bad.alias("fragmented"), F.floor(bad * 1000 / F.count("*")).alias("permille"))


@query(
    "sector_map",
    """SELECT kind, count(*) AS sectors, min(lba) AS first FROM (SELECT lba, CASE WHEN lba < 1 THEN 'Reserved' WHEN lba < 7 THEN 'Fat' WHEN lba < 14 THEN 'RootDir' ELSE 'Data' END AS kind
       FROM range(0, 1440) r(lba)) GROUP BY kind""",
)
def sector_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    sectors = spark.range(1440).select(F.col("id").alias("lba"))
    return sectors.groupBy(disk.sector_kind(F.col("lba"), 1, 7, 14).alias("kind")).agg(F.count("*").alias("sectors"), F.min("lba").alias("first"))


# ------------------------------------------------------------------ order-dependent


@query(
    "locate_asof",
    """SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (ORDER BY ts, event_id) AS signup FROM events""",
)
def locate_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("ts", "event_id", "event_type")
    marks = events.where("event_type = 'signup'").select("ts", "event_id", F.col("event_id").alias("signup"))
    return ops.last_before(events, marks, "ts", "event_id", "signup", timeless_last=True).select("event_id", "signup")


@query(
    "journal_replay",
    """SELECT k AS user_id, coalesce(v, 'none') AS event_type FROM (SELECT unnest(range(0, greatest(200, (SELECT coalesce(max(user_id), 0) + 1 FROM events)))) AS k) r LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS v FROM events GROUP BY user_id) e ON e.user_id = r.k""",
)
def journal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    greatest = events.agg(F.max("user_id")).first()[0]
    return ops.replay(events, "user_id", "event_id", "event_type", 0, max(200, (greatest or 0) + 1), F.lit("none"))


@query(
    "tape_files",
    """WITH b AS (SELECT conv_id, turn, role, text, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS file FROM conversations)
       SELECT conv_id, file::BIGINT AS file, max(text) FILTER (WHERE role = 'user') AS name, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role <> 'user'), '') AS content
       FROM b WHERE file > 0 GROUP BY conv_id, file""",
)
def tape_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.islands(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user", "text")


@query(
    "tape_payload",
    "SELECT role, count(*) AS blocks, sum(octet_length(encode(text)))::BIGINT AS bytes FROM conversations GROUP BY role",
)
def tape_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("blocks"), F.sum(F.octet_length("text")).alias("bytes"))


@query(
    "dup_keys",
    """SELECT p_partkey, CASE WHEN k = 0 THEN p_name ELSE p_name || '.' || k END AS key
       FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS k FROM part)""",
)
def dup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.unique_names(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey").select("p_partkey", "key")


@query(
    "tree_flatten",
    """WITH t AS (SELECT [r_regionkey::BIGINT] AS path, r_name AS name FROM region
       UNION ALL SELECT [n_regionkey, n_nationkey], n_name FROM nation
       UNION ALL SELECT [n_regionkey, n_nationkey, c_custkey], c_name FROM customer JOIN nation ON c_nationkey = n_nationkey)
       SELECT array_to_string(path, '/') AS path, len(path)::INT - 1 AS depth, repeat('  ', len(path) - 1) || name AS line, row_number() OVER (ORDER BY path) AS ord FROM t""",
)
def tree_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_regionkey").cast("long").alias("r"), "n_name")
    levels = [
        table(spark, sf_dir, "region").select(F.array(F.col("r_regionkey").cast("long")).alias("path"), F.col("r_name").alias("name")),
        nation.select(F.array("r", "n").alias("path"), F.col("n_name").alias("name")),
        table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n")).select(F.array("r", "n", "c_custkey").alias("path"), F.col("c_name").alias("name")),
    ]
    return ops.numbered(ops.tree_order(levels), ["path"], "ord").select(F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "depth", "line", "ord")


@query(
    "type_ahead",
    """SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE 's%' ORDER BY (p_partkey < 100)::INT, p_partkey LIMIT 1""",
)
def type_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ring_search(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", 100, "S")


@query(
    "match_step",
    """WITH h AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part WHERE p_name LIKE '%ring%')
       SELECT a.p_partkey, b.p_partkey AS next, c.p_partkey AS previous FROM h a JOIN h b ON b.i = (a.i + 1) % a.n JOIN h c ON c.i = (a.i - 1 + a.n) % a.n""",
)
def match_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ring_neighbours(table(spark, sf_dir, "part").where(F.col("p_name").contains("ring")).select("p_partkey"), "p_partkey")


@query(
    "recent_merge",
    """WITH l AS (SELECT user_id, event_type, max((ts, event_id)) AS at0 FROM events GROUP BY ALL)
       SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY at0 DESC)::INT AS rank FROM l QUALIFY rank <= 3""",
)
def recent_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.recent(table(spark, sf_dir, "events"), "user_id", "event_type", [F.col("ts"), F.col("event_id")], 3)


@query(
    "session_prefix",
    """WITH g AS (SELECT user_id, event_id, ts, (coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000, true))::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
       SELECT user_id, event_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM g""",
)
def session_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sessions(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", 3600).select("user_id", "event_id", "session")


@query(
    "track_report",
    """SELECT l_orderkey AS track, count(*) AS sectors, arg_min(l_quantity, (l_linenumber, l_partkey, l_suppkey, l_quantity)) AS first_size, count(*) FILTER (WHERE l_returnflag = 'R') AS bad,
              count(*) = 7 AND bool_and(l_linestatus = 'O') AS standard, CASE WHEN max(l_linenumber) = 1 THEN 1 ELSE 2 END AS sides FROM lineitem GROUP BY l_orderkey""",
)
def track_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("track")).agg(
        F.count("*").alias("sectors"),
        F.min_by("l_quantity", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).alias("first_size"),
        F.count_if(F.col("l_returnflag") == "R").alias("bad"),
        ((F.count("*") == 7) & F.bool_and(F.col("l_linestatus") == "O")).alias("standard"),
        F.when(F.max("l_linenumber") == 1, 1).otherwise(2).alias("sides"),
    )


@query(
    "companion",
    """SELECT a.p_partkey, b.companion_kind, b.companion FROM part a JOIN (SELECT p_brand, lower(p_name) AS n, p_type AS companion_kind, min(p_partkey) AS companion FROM part
       WHERE p_type IN ('ECONOMY', 'PROMO') GROUP BY ALL) b ON a.p_brand = b.p_brand AND lower(a.p_name) = b.n""",
)
def companion(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_type")
    return ops.companions(part, "p_brand", "p_name", "p_type", "p_partkey", ["ECONOMY", "PROMO"]).select("p_partkey", "companion_kind", "companion")


@query(
    "multidisk_split",
    """WITH s AS (SELECT o_custkey, unnest([3, 2]) AS size, bool_and(o_orderkey >= 0) AS ok, count(*) AS total FROM orders GROUP BY o_custkey),
       f AS (SELECT o_custkey, size, total // size AS slices FROM s WHERE ok AND total >= 2 * size AND total % size = 0)
       SELECT o_custkey, size::INT AS size, slices::BIGINT AS slices FROM f QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY size DESC) = 1""",
)
def multidisk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("index", F.lit(1))
    counted = orders.groupBy("o_custkey").agg(F.count("*").alias("total"), F.bool_and(F.col("o_orderkey") >= 0).alias("ok"))
    return ops.split_candidates(counted, "o_custkey", [3, 2], F.col("total"), F.col("ok"), "index")


@query(
    "dos_version",
    """SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') OR bool_or(o_orderstatus = 'F' AND o_totalprice > 400000) OR bool_or(o_orderkey % 100 = 0) AS dos2 FROM orders GROUP BY 1""",
)
def dos_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    any_of = F.bool_or(F.col("o_orderpriority") == "1-URGENT") | F.bool_or((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000)) | F.bool_or(F.col("o_orderkey") % 100 == 0)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(any_of.alias("dos2"))


@query(
    "mig_fold",
    """WITH w AS (SELECT user_id, list((event_id * 7) % 256 ORDER BY event_id) AS m, list((event_id * 13) % 256 ORDER BY event_id) AS v FROM events GROUP BY user_id)
       SELECT user_id, list_reduce(list_transform(range(1, len(m) + 1), lambda i: m[i] * 256 + v[i]), lambda r, x: ((r & (255 - x // 256)) | ((x % 256) & (x // 256))), 0::BIGINT)::INT AS register FROM w""",
)
def mig_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id"))).alias("w"))
    number = lambda x, k: (x["event_id"] * k % 256).cast("int")
    return writes.select("user_id", F.aggregate("w", F.lit(0), lambda r, x: binary.masked_write(r, number(x, 7), number(x, 13))).alias("register"))


# ------------------------------------------------------------------ search and scalar functions


@query(
    "byte_search",
    """SELECT p_partkey, list_filter(range(0, length(p_name)), lambda i: lower(p_name[i + 1:i + 2]) = 'in')::INT[] AS places, len(list_filter(range(0, length(p_name)), lambda i: p_name[i + 1:i + 1] = 'e'))::INT AS e_count
       FROM part""",
)
def byte_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", content.find_all("p_name", "IN", ignore_case=True).alias("places"), F.size(content.find_bytes(F.encode("p_name", "UTF-8"), b"e")).alias("e_count"))


@query(
    "listing_search",
    """SELECT doc_id, i::INT AS place, length(text[:i]) - length(replace(text[:i], chr(10), '')) AS line FROM (SELECT doc_id, text, unnest(list_filter(range(0, length(text)), lambda i: text[i + 1:i + 8] = 'Licensed')) AS i
       FROM documents WHERE contains(text, 'Licensed'))""",
)
def listing_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "documents").where(F.col("text").contains("Licensed")).select("doc_id", "text", F.explode(content.find_all("text", "Licensed")).alias("place"))
    before = F.substring("text", F.lit(1), F.col("place"))
    return hits.select("doc_id", "place", (F.char_length(before) - F.char_length(F.translate(before, "\n", ""))).cast("long").alias("line"))


@query(
    "hex_dump",
    """SELECT p_partkey, upper(printf('%06x', a)) AS address, array_to_string(list_transform(range(1, length(s) + 1), lambda i: hex(encode(s[i:i]))), ' ') AS bytes, rpad(s, 4, ' ') AS shown
       FROM (SELECT p_partkey, a, p_name[a + 1:a + 4] AS s FROM (SELECT p_partkey, p_name, unnest(range(0, length(p_name), 4)) AS a FROM part))""",
)
def hex_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    from floppyscope.operators.hexrows import hex_rows

    data = table(spark, sf_dir, "part").select("p_partkey", F.encode("p_name", "UTF-8").alias("data"))
    return hex_rows(data, "p_partkey", "data", 4).select("p_partkey", "address", "bytes", "shown")


@query("checksums", "SELECT doc_id, sha1(text) AS sha1 FROM documents")
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", binary.sha1_hex(F.encode("text", "UTF-8")).alias("sha1"))


@query(
    "crc32_rows",
    """SELECT r_regionkey, upper(printf('%08x', xor(list_reduce(list_transform(range(1, length(r_name) + 1), lambda i: ascii(r_name[i:i])::BIGINT), lambda crc, b:
       list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(crc, b)), 4294967295::BIGINT), 4294967295))) AS crc FROM region""",
)
def crc32_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select("r_regionkey", binary.crc32_hex(F.encode("r_name", "UTF-8")).alias("crc"))


@query(
    "crc16",
    """SELECT p_partkey, list_reduce(list_transform(range(1, length(p_name) + 1), lambda i: ascii(p_name[i:i])::BIGINT), lambda crc, b:
       list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 40961) ELSE c >> 1 END, xor(crc, b)), 0::BIGINT)::INT AS arc,
       list_reduce(list_transform(range(1, length(p_name) + 1), lambda i: ascii(p_name[i:i])::BIGINT), lambda crc, b:
       list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, i: CASE WHEN c & 32768 <> 0 THEN xor((c << 1) & 65535, 4129) ELSE (c << 1) & 65535 END, xor(crc, b << 8)), 65535::BIGINT)::INT AS ccitt FROM part""",
)
def crc16(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode("p_name", "UTF-8")
    return table(spark, sf_dir, "part").select("p_partkey", binary.crc16_arc(data).alias("arc"), binary.crc16_ccitt(data).alias("ccitt"))


@query(
    "charset_stats",
    r"""WITH b AS (SELECT lang, unnest(list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || h[2 * i - 1:2 * i])::INT)) AS b FROM (SELECT lang, hex(encode(text)) AS h FROM documents)),
       s AS (SELECT lang, count(*) FILTER (WHERE b >= 128) AS high, count(*) FILTER (WHERE b BETWEEN 161 AND 223) AS kana, count(*) FILTER (WHERE b >= 224) AS hira FROM b GROUP BY lang)
       SELECT lang, high, kana, hira, CASE WHEN kana >= 2 AND 5 * (kana + hira) >= 3 * high THEN 'Japanese' ELSE 'International' END AS verdict FROM s""",
)
def charset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from floppyscope.operators.charsets import detect_by

    data = table(spark, sf_dir, "documents").select("lang", F.encode("text", "UTF-8").alias("data"))
    return detect_by(data, "lang", "data")


@query(
    "text_sniff",
    r"""SELECT doc_id, regexp_full_match(text, '(?s)[\t\n\f\r\x{1B}\x{20}-\x{7E}\x{80}-\x{10FFFF}]*') AND contains(text, chr(10)) AS is_text FROM documents""",
)
def text_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", content.looks_like_text(F.encode("text", "UTF-8")).alias("is_text"))


@query(
    "control_safe",
    f"""SELECT doc_id, translate(text, {' || '.join(f'chr({c})' for c in (*range(1, 32), 127))} || '/:*?"<>|' || chr(92), {' || '.join(f'chr({0x2400 + c})' for c in range(1, 32))} || chr(9249) || '________') AS safe FROM documents""",
)
def control_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", names.safe_component("text").alias("safe"))


@query(
    "dos_time",
    """WITH d AS (SELECT o_orderkey, ((year(o_orderdate) - 1980) << 9) | (month(o_orderdate) << 5) | day(o_orderdate) AS packed FROM orders)
       SELECT o_orderkey, packed::INT AS packed, make_timestamp((packed >> 9) + 1980, (packed >> 5) & 15, packed & 31, 0, 0, 0.0) AS unpacked FROM d""",
)
def dos_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = disk.pack_dos(F.col("o_orderdate"))
    packed = table(spark, sf_dir, "orders").select("o_orderkey", words["date"].alias("packed"), words["time"].alias("time"))
    return packed.select("o_orderkey", "packed", disk.unpack_dos(F.col("packed"), F.col("time")).alias("unpacked"))


@query(
    "attr_flags",
    """SELECT p_partkey, (CASE WHEN p_partkey & 16 <> 0 THEN 'd' ELSE '-' END) || (CASE WHEN p_partkey & 1 <> 0 THEN 'r' ELSE '-' END) || (CASE WHEN p_partkey & 2 <> 0 THEN 'h' ELSE '-' END)
       || (CASE WHEN p_partkey & 4 <> 0 THEN 's' ELSE '-' END) || (CASE WHEN p_partkey & 32 <> 0 THEN 'a' ELSE '-' END) AS flags FROM part""",
)
def attr_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", names.attribute_flags(F.col("p_partkey")).alias("flags"))


def _hex_rows(spark: SparkSession, rows: list[str]) -> DataFrame:
    return rows_of(spark, "id int, hex string", list(enumerate(rows))).select("id", F.unhex("hex").alias("data"))


#: Two boot sectors (up to their heads field) and one that is none.
BOOT = ["EBFE90" + "41" * 8 + "0002020100027000A005F90300090002000000", "EBFE90" + "41" * 8 + "0002020100027000D002F802000900010000", "00" * 32]
_BOOT_SQL = ", ".join(f"({k}, '{h}')" for k, h in enumerate(BOOT))
_U8 = "('0x' || h[{0} * 2 + 1:{0} * 2 + 2])::INT"


def _u16(k: int) -> str:
    return f"({_U8.format(k)} + 256 * {_U8.format(k + 1)})"


@query(
    "bpb_parse",
    f"""WITH f AS (SELECT id, {_u16(11)} AS bps, {_U8.format(13)} AS spc, {_u16(14)} AS reserved, {_U8.format(16)} AS fats, {_u16(17)} AS roots, {_u16(22)} AS spf FROM (VALUES {_BOOT_SQL}) b(id, h)),
        g AS (SELECT *, reserved + fats * spf + (roots * 32 + 511) // 512 AS data_start FROM f WHERE bps = 512 AND spc > 0 AND fats > 0 AND spf > 0)
        SELECT id, spc, spf, data_start::INT AS data_start, ((1440 - data_start) // spc)::INT AS clusters, CASE WHEN (1440 - data_start) // spc >= 4085 AND ((1440 - data_start) // spc + 2) * 2 <= spf * 512 THEN 'FAT16' ELSE 'FAT12' END AS fat_type FROM g""",
)
def bpb_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _hex_rows(spark, BOOT).withColumn("bpb", disk.boot_record("data")).where("bpb IS NOT NULL")
    areas = disk.layout(F.col("bpb"), F.lit(1440))
    return found.select("id", "bpb.spc", "bpb.spf", areas["data_start"].alias("data_start"), areas["clusters"].alias("clusters"), areas["fat_type"].alias("fat_type"))


#: The four slots of a partition table, in falling order of their first sectors; one is empty.
SLOTS = [(0x06, 300, 100), (0x0E, 200, 50), (0x00, 0, 0), (0x01, 1, 90)]


def _mbr() -> str:
    table_hex = "".join("00" * 4 + f"{t:02X}" + "00" * 3 + a.to_bytes(4, "little").hex() + n.to_bytes(4, "little").hex() for t, a, n in SLOTS)
    return "00" * 0x1BE + table_hex + "55AA"


@query(
    "partition_parse",
    "SELECT slot::INT AS slot, type::INT AS type, lba::BIGINT AS lba, sectors::BIGINT AS sectors, row_number() OVER (ORDER BY lba)::INT AS n FROM (VALUES "
    + ", ".join(f"({k}, {t}, {a}, {n})" for k, (t, a, n) in enumerate(SLOTS))
    + ") s(slot, type, lba, sectors) WHERE type <> 0 AND lba <> 0 AND sectors <> 0",
)
def partition_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = _hex_rows(spark, [_mbr()]).select("id", F.inline(disk.partition_entries("data"))).where("type <> 0 AND lba <> 0 AND sectors <> 0")
    return slots.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("lba", "slot"))).drop("id")


@query("view_routing", "SELECT page_id, CASE WHEN regexp_full_match(regexp_replace(url, '[?#].*$', ''), '.*\\.bas') THEN 'basic' ELSE 'hex' END AS view FROM pages")
def view_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", content.view_of(F.regexp_replace("url", "[?#].*$", "")).alias("view"))


_GRID = [(n, spf, tail) for n in (368_640, 737_280, 1000) for spf in (2, 3, 5) for tail in (True, False)]


@query(
    "size_fix",
    "SELECT length::INT AS length, spf::INT AS spf, zero_tail, CASE WHEN length NOT IN (368640, 737280) OR spf NOT IN (2, 3) THEN 'none' WHEN (spf = 2) = (length = 368640) THEN 'none' WHEN spf = 3 THEN 'pad' WHEN zero_tail THEN 'truncate' ELSE 'none' END AS fix FROM (VALUES "
    + ", ".join(f"({n}, {s}, {str(z).lower()})" for n, s, z in _GRID)
    + ") g(length, spf, zero_tail)",
)
def size_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = rows_of(spark, "length int, spf int, zero_tail boolean", _GRID)
    declared = F.when(F.col("spf") == 2, disk.SIZE_360K).when(F.col("spf") == 3, disk.SIZE_720K)
    whole = F.col("length").isin(disk.SIZE_360K, disk.SIZE_720K)
    fix = F.when(~whole | declared.isNull() | (declared == F.col("length")), "none").when(declared > F.col("length"), "pad").when(F.col("zero_tail"), "truncate").otherwise("none")
    return grid.withColumn("fix", fix)


@query("palette_math", "SELECT v, ((((r << 5) | (r << 2) | (r >> 1)) << 16) | (((g << 5) | (g << 2) | (g >> 1)) << 8) | ((b << 5) | (b << 2) | (b >> 1)))::INT AS rgb FROM (SELECT v, (v >> 6) & 7 AS r, (v >> 3) & 7 AS g, v & 7 AS b FROM range(0, 512) t(v))")
def palette_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(512).select(F.col("id").alias("v"), disk.expand_rgb333(F.col("id").cast("int")).alias("rgb"))


@query(
    "yjk_math",
    "SELECT y::INT AS y, j::INT AS j, k::INT AS k, least(greatest(y + j, 0), 31)::INT AS r, least(greatest(y + k, 0), 31)::INT AS g, least(greatest((5 * y - 2 * j - k + 2) >> 2, 0), 31)::INT AS b FROM range(0, 32) a(y), range(-32, 32, 8) c(j), range(-32, 32, 8) d(k)",
)
def yjk_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    chroma = F.explode(F.sequence(F.lit(-32), F.lit(24), F.lit(8)))
    grid = spark.range(32).select(F.col("id").cast("int").alias("y"), chroma.alias("j")).select("y", "j", chroma.alias("k"))
    return grid.select("y", "j", "k", *(v.cast("int").alias(c) for c, v in disk.yjk_rgb(F.col("y"), F.col("j"), F.col("k")).items()))


@query("chs", "SELECT lba, (lba // 18)::INT AS track, ((lba // 9) % 2)::INT AS head, (lba % 9)::INT AS sector, ((lba * 513) // 512)::BIGINT AS at_sector, ((lba * 513) % 512)::BIGINT AS inner_offset FROM range(0, 1440) t(lba)")
def chs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lba = F.col("lba")
    place, at = disk.chs_of_lba(lba, 9, 2), disk.locate_offset(lba * 513)
    return spark.range(1440).select(F.col("id").alias("lba")).select("lba", *(v.alias(c) for c, v in place.items()), at["sector"].alias("at_sector"), at["inner"].alias("inner_offset"))


_VERSIONS = [("v1.2.3", "1.2.2"), ("1.10.0", "1.9.9"), ("1.2.3-beta", "1.2.3"), ("1.2", "1.0.0"), ("2.0.0", "x"), ("1.2.3", "1.2.4")]


@query(
    "version_cmp",
    "WITH v AS (SELECT a, b, list_transform(string_split(regexp_extract(a, '^v?([0-9]+\\.[0-9]+\\.[0-9]+)', 1), '.'), lambda x: try_cast(x AS BIGINT)) AS x, list_transform(string_split(regexp_extract(b, '^v?([0-9]+\\.[0-9]+\\.[0-9]+)', 1), '.'), lambda x: try_cast(x AS BIGINT)) AS y FROM (VALUES "
    + ", ".join(f"('{a}', '{b}')" for a, b in _VERSIONS)
    + ") t(a, b)) SELECT a, b, len(x) = 3 AND len(y) = 3 AND x > y AS newer FROM v",
)
def version_cmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, "a string, b string", _VERSIONS).withColumn("newer", names.is_newer("a", "b"))


_BYTES = ["00", "FF", "80FF", "7F80", "010203", "FFFFFFFF", "78563412", "DEADBEEF00"]


@query(
    "inspect_ints",
    f"""WITH x AS (SELECT id, h, len(h) // 2 AS n, {_U8.format(0)} AS u8, CASE WHEN len(h) >= 4 THEN {_u16(0)} END AS u16, CASE WHEN len(h) >= 6 THEN {_u16(0)} + 65536 * {_U8.format(2)} END AS u24,
        CASE WHEN len(h) >= 8 THEN {_u16(0)}::BIGINT + 65536::BIGINT * {_u16(2)} END AS u32 FROM (VALUES {", ".join(f"({k}, '{h}')" for k, h in enumerate(_BYTES))}) b(id, h))
        SELECT id, u8, CASE WHEN u8 > 127 THEN u8 - 256 ELSE u8 END AS i8, h[1:2] AS hex, lpad(bin(u8), 8, '0') AS bits, u16, CASE WHEN u16 > 32767 THEN u16 - 65536 ELSE u16 END AS i16, u24, u32 FROM x""",
)
def inspect_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex_rows(spark, _BYTES).select("id", *(v.alias(c) for c, v in binary.inspect("data").items()))


_SLOT_GRID = [(a, c, s) for a in (0x20, 0x60, 0x10) for c in (0, 1, 2, 714, 715) for s in (0, 730_112, 730_113)]


@query(
    "reject_reasons",
    "SELECT coalesce(reason, 'valid') AS reason, count(*) AS slots FROM (SELECT CASE WHEN a & 192 <> 0 THEN 'attribute' WHEN c = 1 OR c > 714 THEN 'cluster' WHEN s > 713 * 1024 THEN 'size' END AS reason FROM (VALUES "
    + ", ".join(f"({a}, {c}, {s})" for a, c, s in _SLOT_GRID)
    + ") t(a, c, s)) GROUP BY 1",
)
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = rows_of(spark, "a int, c int, s long", _SLOT_GRID)
    reason = disk.reject_reason(F.col("a"), F.col("c"), F.col("s"), F.lit(713), 1024)
    return slots.groupBy(F.coalesce(reason, F.lit("valid")).alias("reason")).agg(F.count("*").alias("slots"))


@query(
    "short_names",
    r"""SELECT p_partkey, CASE WHEN s = '' THEN 'FILE' ELSE s END AS short FROM (SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z0-9_]', '', 'g')[:8] AS s FROM part)""",
)
def short_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", names.short_name("p_name").alias("short"))


@query(
    "truncate_names",
    "SELECT p_partkey, CASE WHEN length(p_name) > 8 THEN p_name[:7] || '…' ELSE p_name END AS shown FROM part",
)
def truncate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", names.truncate("p_name", 8).alias("shown"))


@query(
    "geometry_of_length",
    """SELECT n * 512 AS length, CASE WHEN n = 720 THEN 1 WHEN n = 1440 OR n >= 1440 THEN 2 ELSE 1 END AS sides,
       CASE WHEN n = 720 THEN 80 WHEN n = 1440 THEN 80 ELSE ceil(ceil(n / (CASE WHEN n >= 1440 THEN 2 ELSE 1 END)) / 9)::INT END AS tracks FROM range(1, 3000, 7) t(n)""",
)
def geometry_of_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = spark.range(1, 3000, 7).select((F.col("id") * 512).alias("length"))
    return lengths.withColumn("g", disk.geometry(F.col("length"))).select("length", "g.sides", "g.tracks")


_FCBS = ["00" + b"HELLO   TXT".hex() + "00" * 10, "08" + b"GAME       ".hex() + "00" * 8, "09" + b"BAD     TXT".hex() + "00" * 10, "00" + b"        TXT".hex() + "00" * 10, "0041"]


@query("fcb_parse", "SELECT * FROM (VALUES (0, 0, 'HELLO.TXT'), (1, 8, 'GAME')) t(id, drive, name)")
def fcb_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex_rows(spark, _FCBS).withColumn("f", content.fcb_header("data")).where("f IS NOT NULL").select("id", "f.drive", "f.name")


@query(
    "volume_paths",
    r"""WITH p AS (SELECT page_id, 'P' || (page_id % 5) || '/' || regexp_extract(url, '[^/]*$') AS path FROM pages)
       SELECT page_id, CASE WHEN page_id % 5 > 0 THEN regexp_extract(path, '^P([0-9]+)/(.*)$', 1)::INT END AS n, CASE WHEN page_id % 5 > 0 THEN regexp_extract(path, '^P([0-9]+)/(.*)$', 2) END AS rest FROM p""",
)
def volume_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("P"), (F.col("page_id") % 5).cast("string"), F.lit("/"), F.regexp_extract("url", "[^/]*$", 0))
    found = table(spark, sf_dir, "pages").select("page_id", content.volume_of_path(path).alias("v"))
    return found.select("page_id", "v.n", "v.rest")  # P0 names no volume: null


_NAMES = ["80", "41B142", "E986", "C1", "07410A7F"]


@query("charset_decode", "SELECT * FROM (VALUES (0, 'Ç', '▂'), (1, 'AãB', 'A±B'), (2, 'Θå', 'И▎'), (3, '▚', 'а'), (4, chr(7) || 'A' || chr(10) || chr(127), chr(7) || 'A' || chr(10) || chr(127))) t(id, international, russian)")
def charset_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hex_rows(spark, _NAMES).select("id", charsets.name_of_bytes("data").alias("name"))
    return rows.select("id", charsets.shown_name("name", "International").alias("international"), charsets.shown_name("name", "Russian").alias("russian"))


@query("control_legend", "SELECT * FROM (VALUES (4, 7, 'beep'), (4, 10, 'line feed'), (4, 127, 'delete')) t(id, code, effect)")
def control_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hex_rows(spark, _NAMES).select("id", charsets.name_of_bytes("data").alias("name"))
    return rows.select("id", F.inline(charsets.control_effects("name")))


@query(
    "cursor_moves",
    """WITH n AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS i, count(*) OVER () AS n FROM part), s AS (SELECT *, p_partkey::VARCHAR AS path FROM n)
       SELECT a.path, u.path AS up, d.path AS down, x.path AS page_up, y.path AS page_down, (SELECT path FROM s WHERE i = 1) AS home, (SELECT path FROM s WHERE i = n) AS "end", a.path AS "left"
       FROM s a JOIN s u ON u.i = greatest(a.i - 1, 1) JOIN s d ON d.i = least(a.i + 1, a.n) JOIN s x ON x.i = greatest(a.i - 20, 1) JOIN s y ON y.i = least(a.i + 20, a.n)""",
)
def cursor_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("path"))
    return ops.navigate(rows, "p_partkey", "path", 20)


@query(
    "free_host_names",
    """WITH e AS (SELECT r_name || '.TXT' AS n, r_regionkey AS k FROM region), x AS (SELECT n FROM e WHERE k < 4 UNION SELECT replace(n, '.TXT', ' (2).TXT') FROM e WHERE k IN (1, 2) UNION SELECT replace(n, '.TXT', ' (3).TXT') FROM e WHERE k = 2)
       SELECT n AS name, CASE k WHEN 4 THEN n WHEN 0 THEN replace(n, '.TXT', ' (2).TXT') WHEN 3 THEN replace(n, '.TXT', ' (2).TXT') WHEN 1 THEN replace(n, '.TXT', ' (3).TXT') ELSE replace(n, '.TXT', ' (4).TXT') END AS target FROM e""",
)
def free_host_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region").select(F.concat("r_name", F.lit(".TXT")).alias("name"), "r_regionkey")
    with_number = lambda k: F.replace("name", F.lit(".TXT"), F.lit(f" ({k}).TXT")).alias("name")
    there = region.where("r_regionkey < 4").select("name").union(region.where("r_regionkey IN (1, 2)").select(with_number(2))).union(region.where("r_regionkey = 2").select(with_number(3)))
    return ops.free_names(region.select("name"), there, "name")


@query("throttle", "SELECT event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 86400000000 AS due FROM events")
def throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", timing.due("user_id", "ts", "event_id", 86_400).alias("due"))


@query("hold_rates", "SELECT doc_id, CASE WHEN held < 0.35::DOUBLE THEN 0 ELSE 20 + 130 * least(greatest((held - 0.35::DOUBLE) / 2, 0), 1) END::DOUBLE AS rate FROM (SELECT doc_id, n_chars % 400 / 128::DOUBLE AS held FROM documents)")
def hold_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.col("n_chars") % 400 / F.lit(128.0)
    return table(spark, sf_dir, "documents").select("doc_id", timing.hold_rate(held).alias("rate"))
