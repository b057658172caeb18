"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line goes if an earlier line equals it, or, from MIN_CHARS characters on, differs from it by
one edit. Equal lines meet under a hash of the line. For the others every line emits its
deletion variants as hashed keys: each character left out in turn, and the line itself read
as the variant of a longer one. Two lines one substitution apart share the variant of that
place; two lines one insertion apart share a variant of the longer with the shorter itself.
Lines under one key are joined to the earliest of them, and the edit distance is verified.

Emitting every variant of every line would cost the square of its length, so
* a variant's key is the exclusive or of position-wise hashes, counted from the left before the
  place and from the right after it, which prefix sums give in one step for each character;
* only lines go so far that share all but one segment with another line: first of two
  segments, then of SEGMENTS. A pair one edit apart always does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floppyscope.llm.common import row_key, table, written
from floppyscope.llm.decontaminate import ROW_BYTES, let, small

#: Characters from which a line can have a near-duplicate; shorter lines must be equal.
MIN_CHARS = 20
SEGMENTS = 32
#: Letters of a line that are put in order together.
PART = 512
#: What is cut off around a line, and what a blank line consists of.
BLANK = " \t\r"


def _segment_keys(line: Column, n: Column, segments: int) -> Column:
    """Hashes of a line without one segment, for the cuts of its own length and of one less.

    If two lines are one edit apart and the shorter has m characters, cut at j m / segments,
    then what precedes some segment and what follows it are equal in both.
    """

    def key(less: int, j: Column) -> Column:
        m = n - less
        a, b = F.floor(m * j / segments).cast("int"), F.floor(m * (j + 1) / segments).cast("int")
        # xxhash64 passes over a null.
        before = F.when(j > 0, F.substring(line, F.lit(1), a))
        after = F.when(j + 1 < segments, F.substring(line, n - m + b + 1, n))
        return F.xxhash64(m, j, before, after)

    if segments <= 2:  # every line comes here: one expression for each key, compiled
        return F.array(*(key(less, F.lit(j)) for less in (0, 1) for j in range(segments)))
    # Few lines come here, and a plan of that many expressions costs the driver more.
    each = F.sequence(F.lit(0), F.lit(segments - 1))
    return F.concat(F.transform(each, lambda j: key(0, j)), F.transform(each, lambda j: key(1, j)))


def _lines(rows: DataFrame) -> DataFrame:
    """(doc_id, row, n, line) of every line of ``rows`` that isn't blank; blanks around it are cut off."""
    lines = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return lines.withColumn("line", F.btrim("line", F.lit(BLANK))).where("line <> ''")


def _shared(rows: DataFrame) -> DataFrame:
    """The keys of ``rows`` (key, h) that lines of different hashes have."""
    return rows.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key")


def _on_row(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """A join on the row's id and key; ``other`` has one row for each."""
    other = other.withColumnsRenamed({"doc_id": "other_id", "row": "other_row"})
    return rows.join(other, rows["doc_id"].eqNullSafe(other["other_id"]) & (rows["row"] == other["other_row"]), how)


def _left(p: Column, letter: Column) -> Column:
    """Hash of a letter at a place counted from the left."""
    return F.xxhash64(F.lit(1), p.cast("int"), letter)


def _right(p: Column, letter: Column, chars: Column) -> Column:
    """Hash of a letter at the same place counted from the right."""
    return F.xxhash64(F.lit(2), (chars - p).cast("int"), letter)


def _parts(letters: Column, chars: Column) -> Column:
    """A line in parts of PART letters, each with the exclusive or of all that precede it, and
    those of the whole line: so a long line is worked on in many places."""
    zero = F.lit(0).cast("bigint")

    def total(k: Column) -> Column:
        places = F.sequence(k * PART, F.least((k + 1) * PART, chars) - 1)

        def add(s: Column, p: Column) -> Column:
            c = F.get(letters, p)
            return F.struct(s["l"].bitwiseXOR(_left(p, c)).alias("l"), s["r"].bitwiseXOR(_right(p, c, chars)).alias("r"))

        return F.aggregate(places, F.struct(zero.alias("l"), zero.alias("r")), add)

    def gather(s: Column, k: Column) -> Column:
        here = F.struct(k.alias("k"), s["left"].alias("lefts"), s["right"].alias("rights"), F.slice(letters, k * PART + 1, F.least(F.lit(PART), chars - k * PART)).alias("letters"))
        return let(total(k), lambda t: F.struct(s["left"].bitwiseXOR(t["l"]).alias("left"), s["right"].bitwiseXOR(t["r"]).alias("right"), F.concat(s["parts"], F.array(here)).alias("parts")))

    none = F.array().cast("array<struct<k:int,lefts:bigint,rights:bigint,letters:array<string>>>")
    numbers = F.sequence(F.lit(0), F.ceil(chars / PART).cast("int") - 1)
    return F.aggregate(numbers, F.struct(zero.alias("left"), zero.alias("right"), none.alias("parts")), gather)


def _near(rows: DataFrame, distinct: DataFrame) -> DataFrame:
    """(h, h2, first) of every distinct line that has an earlier one at one edit's distance,
    and the place ``first`` of the earliest such line."""
    halves = distinct.where(F.size("halves") > 0).select("h", "h2", "place", F.explode("halves").alias("key"))
    shared = written(_shared(halves), "halves")
    # One place of each line that shares a half; its text is read again there, and nowhere else.
    half = written(halves.join(small(shared), "key", "left_semi").groupBy("h", "h2").agg(F.min("place").alias("place")), "half-shared")
    wanted = half.groupBy("place.doc_id", "place.row").agg(F.collect_list(F.struct("h", "h2", "place")).alias("wanted"))
    cut = lambda x: F.btrim(x, F.lit(BLANK))
    taken = let(F.split("text", "\n", -1), lambda parts: F.transform("wanted", lambda x: F.struct(x["h"].alias("h"), x["h2"].alias("h2"), x["place"].alias("place"), cut(F.get(parts, x["place"]["n"])).alias("line"))))
    some = _on_row(rows, small(wanted, F.size("wanted") * ROW_BYTES), "inner").select(F.inline(taken))
    some = some.dropDuplicates(["h", "h2"])  # repeated rows give their lines repeatedly
    some = written(some.withColumn("chars", F.char_length("line")), "half-shared-lines")
    keyed = some.select("h", "h2", F.explode(_segment_keys(F.col("line"), F.col("chars"), SEGMENTS)).alias("key"))
    few = written(keyed.join(_shared(keyed), "key", "left_semi").select("h", "h2").distinct(), "candidates")
    few = some.join(few, ["h", "h2"], "left_semi")

    parts = few.select("h", "h2", "place", "chars", let(F.split("line", ""), lambda c: _parts(c, F.col("chars"))).alias("t"))
    spread = parts.select("h", "h2", "place", "chars", "t.left", "t.right", F.inline("t.parts"))
    letters = spread.select("h", "h2", "place", "chars", "k", "lefts", "rights", "right", F.posexplode("letters").alias("q", "c")).withColumn("p", F.col("k") * PART + F.col("q"))
    letters = letters.withColumns({"own_left": _left(F.col("p"), F.col("c")), "own_right": _right(F.col("p"), F.col("c"), F.col("chars"))})
    before = Window.partitionBy("h", "h2", "k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.bit_xor(c).over(before), F.lit(0))
    letters = letters.select("h", "h2", "place", "chars", "p", "own_right", F.col("lefts").bitwiseXOR(upto("own_left")).alias("lefts"), F.col("right").bitwiseXOR(F.col("rights")).bitwiseXOR(upto("own_right")).alias("rest"))
    # "rest" covers the letters from p on, counted from the right.
    longer = F.struct((F.col("chars") - 1).alias("m"), F.col("lefts").bitwiseXOR(F.col("rest").bitwiseXOR(F.col("own_right"))).alias("v"), F.lit(True).alias("cut"))
    itself = F.struct(F.col("chars").alias("m"), F.col("lefts").bitwiseXOR(F.col("rest")).alias("v"), F.lit(False).alias("cut"))
    variants = letters.select("h", "h2", "place", "p", F.explode(F.array(longer, itself)).alias("s")).select("h", "h2", "place", "p", "s.m", "s.v", "s.cut")
    # A line ends after its last letter, too: there a longer line may have one more.
    ends = parts.select("h", "h2", "place", F.col("chars").alias("p"), F.col("chars").alias("m"), F.col("t.left").alias("v"), F.lit(False).alias("cut"))
    variants = written(variants.unionByName(ends), "variants")
    first = variants.groupBy("p", "m", "v").agg(F.min(F.when(F.col("cut"), F.col("place"))).alias("cut_first"), F.min("place").alias("any_first"), F.min("h").alias("a"), F.max("h").alias("b"))
    met = variants.join(first.where("a <> b"), ["p", "m", "v"])
    # Two lines that hold the same variant whole are equal; so those are joined to cut ones only.
    earlier = F.when(F.col("cut"), F.col("any_first")).otherwise(F.col("cut_first"))
    pairs = met.select("h", "h2", "place", earlier.alias("first")).where("first < place").groupBy("h", "h2").agg(F.min("first").alias("first"))
    lines_of = some.select(F.col("place").alias("first"), F.col("line").alias("other"))
    checked = pairs.join(some.select("h", "h2", "line"), ["h", "h2"]).join(lines_of, "first")
    return checked.where(F.levenshtein("line", "other", 1) >= 0).select("h", "h2", "first")


def dedup(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(document, n_lines, n_removed) of every row of ``documents``: all its columns as one
    struct, with ``text`` cut down to the lines that stay, and counts of lines (not blank).

    Earlier is by doc_id (null first), then by a hash of the text, then by the line. A line
    goes by an earlier one whether or not that one goes itself; lines of fewer than
    ``min_chars`` characters go by equal ones only. Blank lines stay. A null text stays null;
    no row is dropped. Rows are told apart by content, never by their place, which changes with
    the cluster; of rows equal in id and text the first in the order of all columns counts, and
    the others lose every line.
    """
    rows = documents.select(F.struct("*").alias("document"), "doc_id", row_key().alias("row"))
    texts = rows.select("doc_id", "row", "document.text")
    n = F.char_length("line")
    halves = F.when(n >= min_chars, _segment_keys(F.col("line"), n, 2)).otherwise(F.array().cast("array<bigint>"))
    lines = written(_lines(texts).select("doc_id", "row", "n", F.xxhash64("line").alias("h"), F.hash("line").alias("h2"), halves.alias("halves")), "lines")
    # A very common line is one row from here on.
    place = F.struct("doc_id", "row", "n")
    distinct = written(lines.groupBy("h", "h2").agg(F.min(place).alias("place"), F.count("*").alias("times"), F.first("halves").alias("halves")), "distinct-lines")
    near = written(_near(texts, distinct), "near-lines")
    many = distinct.where("times > 1").select("h", "h2", F.col("place").alias("kept"))
    # Of equal lines all but the first go; of a line near an earlier one all go.
    known = many.join(near.select("h", "h2", F.lit(True).alias("near")), ["h", "h2"], "full")
    known = written(known.select("h", "h2", F.when(F.col("near"), F.lit(None)).otherwise(F.col("kept")).alias("kept")), "known-lines")
    gone = lines.join(small(known), ["h", "h2"]).where(F.col("kept").isNull() | (F.struct("doc_id", "row", "n") != F.col("kept")))
    gone = written(gone.groupBy("doc_id", "row").agg(F.collect_set("n").alias("gone")), "gone-lines")

    twins = written(rows.groupBy("doc_id", "row").agg(F.count("*").alias("times")).where("times > 1").select("doc_id", "row"), "twins")
    again = F.lit(False)
    if not twins.isEmpty():
        rows = _without_twins(rows, twins)
        again = F.col("again")
    out = _on_row(rows, small(gone, F.size("gone") * 4 + ROW_BYTES), "left")

    def cut(parts):
        filled = F.transform(parts, lambda x: F.btrim(x, F.lit(BLANK)) != "")
        stays = lambda x, i: F.when(again, F.btrim(x, F.lit(BLANK)) == "").otherwise(F.col("gone").isNull() | ~F.array_contains("gone", i))
        kept = F.when(~again & F.col("gone").isNull(), F.col("document.text")).otherwise(F.array_join(F.filter(parts, stays), "\n"))
        return F.struct(kept.alias("text"), F.size(F.filter(filled, lambda x: x)).cast("long").alias("n_lines"))

    out = out.withColumn("cut", F.when(F.col("document.text").isNotNull(), let(F.split("document.text", "\n", -1), cut)))
    zero = F.lit(0).cast("long")
    n_lines = F.coalesce("cut.n_lines", zero)
    removed = F.when(again, n_lines).otherwise(F.greatest(F.coalesce(F.size("gone"), F.lit(0)), F.lit(0)).cast("long"))
    return out.select(F.col("document").withField("text", F.col("cut.text")).alias("document"), n_lines.alias("n_lines"), removed.alias("n_removed"))


def _without_twins(rows: DataFrame, twins: DataFrame) -> DataFrame:
    """``rows`` with ``again``: whether an equal row, by id and text, comes before. Copies that
    agree in all columns are counted before they are shuffled, and dealt out again."""
    listed = small(twins.withColumn("twin", F.lit(True)))
    marked = _on_row(rows, listed, "left").select(*rows.columns, F.coalesce("twin", F.lit(False)).alias("twin"))
    alone = marked.where("NOT twin").select(*rows.columns, F.lit(False).alias("again"))
    counted = written(marked.where("twin").groupBy("doc_id", "row", "document").agg(F.count("*").alias("copies")), "twin-rows")
    first = counted.groupBy("doc_id", "row").agg(F.min(F.struct(F.xxhash64("document"), "document")).alias("first"))
    lead = _on_row(counted, small(first, F.octet_length("first.document.text") + F.lit(1024)), "inner")
    copies = lead.select(*rows.columns, F.col("document").eqNullSafe(F.col("first.document")).alias("leads"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return alone.unionByName(copies.select(*rows.columns, (~F.col("leads") | (F.col("copy") > 1)).alias("again")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("document.*", "n_lines", "n_removed")


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
l AS (SELECT r, n, trim(parts[n], ' ' || chr(9) || chr(13)) AS line, parts[n] AS raw
      FROM (SELECT r, parts, unnest(range(1, len(parts) + 1)) AS n FROM (SELECT r, string_split(text, chr(10)) AS parts FROM d))),
u AS (SELECT line, min((r, n)) AS place FROM l WHERE line <> '' GROUP BY line),
v AS (SELECT line, place, length(line) AS k, unnest(range(0, length(line) + 1)) AS p FROM u WHERE length(line) >= {MIN_CHARS}),
w AS (SELECT DISTINCT line, place, CASE WHEN p = 0 THEN line ELSE line[:p - 1] || line[p + 1:] END AS variant FROM v),
near AS (SELECT DISTINCT a.line FROM w a JOIN w b ON a.variant = b.variant AND b.place < a.place WHERE levenshtein(a.line, b.line) <= 1),
k AS (SELECT l.*, line <> '' AS filled, line <> '' AND ((l.r, l.n) <> u.place OR near.line IS NOT NULL) AS gone
      FROM l LEFT JOIN u USING (line) LEFT JOIN near USING (line)),
g AS (SELECT r, string_agg(raw, chr(10) ORDER BY n) FILTER (WHERE NOT coalesce(gone, false)) AS kept,
             count(*) FILTER (WHERE filled) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed FROM k GROUP BY r)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM d LEFT JOIN g USING (r)
"""
