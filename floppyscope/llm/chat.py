"""Preference formatting of chosen and rejected conversations, in DataFrame functions.

The longest common prefix of turns is rendered once as the prompt; what follows on either
side is a completion with the spans that a loss counts: the text of the assistant's turns and
the marker that ends it. All else is masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floppyscope.llm.common import table

#: Markers of a rendered turn: role, text and end.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))), "")


def _spans(turns: Column) -> Column:
    """start:end of what counts in the rendered turns, in characters, comma-joined."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        a = s["at"] + len(OPEN) + F.char_length(t["role"]) + len(CLOSE)
        b = a + F.char_length(t["text"]) + len(END) - 1
        span = F.when(t["role"] == TRAINED, F.array(F.concat_ws(":", a, b))).otherwise(F.array().cast("array<string>"))
        return F.struct((b + 1).alias("at"), F.concat(s["out"], span).alias("out"))

    return F.array_join(F.aggregate(turns, start, step, lambda s: s["out"]), ",")


def preference_pairs(turns: DataFrame) -> DataFrame:
    """One row per pair of ``turns`` (pair_id, chosen boolean, turn, role, text).

    Turns are read in the order of their number (null first), equal numbers by role and text;
    repeated turns are repeated. Turns are equal if role and text are. A null role or text
    counts as empty; "<|" within them is parted, so that no text can pose as a marker. A side
    without turns has an empty completion and shares no prefix; a null ``chosen`` counts as
    rejected. A turn without a pair id belongs with no other and comes out as a row of its own,
    so such turns are never gathered. A conversation is one row, so it has to fit into one.
    Columns beyond these five are not read.
    """
    safe = {c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("<|"), F.lit("< |")) for c in ("role", "text")}
    turns = turns.withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    sides = turns.select("pair_id", "chosen", F.struct("turn", *(v.alias(c) for c, v in safe.items())).alias("t"))
    pairs = sides.where("pair_id IS NOT NULL").groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("chosen"), F.col("t")))).alias("c"),
        F.array_sort(F.collect_list(F.when(~F.col("chosen"), F.col("t")))).alias("r"),
    )
    none = F.filter(F.array("t"), lambda t: F.lit(False))
    alone = sides.where("pair_id IS NULL").select("pair_id", F.when(F.col("chosen"), F.array("t")).otherwise(none).alias("c"), F.when(F.col("chosen"), none).otherwise(F.array("t")).alias("r"))
    pairs = pairs.unionByName(alone)
    n = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", 1, n), F.slice("r", 1, n), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    apart = F.array_position(same, F.lit(False)).cast("int")
    pairs = pairs.withColumn("n_common", F.when(apart == 0, n).otherwise(apart - 1))
    rest = {side: F.slice(side, F.col("n_common") + 1, F.size(side) - F.col("n_common")) for side in ("c", "r")}
    pairs = pairs.select("pair_id", "n_common", F.slice("c", 1, F.col("n_common")).alias("p"), rest["c"].alias("c"), rest["r"].alias("r"))
    return pairs.select(
        "pair_id",
        F.col("n_common").cast("long").alias("n_common"),
        _render(F.col("p")).alias("prompt"),
        _render(F.col("c")).alias("chosen"),
        _spans(F.col("c")).alias("chosen_spans"),
        _render(F.col("r")).alias("rejected"),
        _spans(F.col("r")).alias("rejected_spans"),
    )


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2 k (chosen) and 2 k + 1 (rejected) as pair k; the table has no preferences of its own."""
    turns = table(spark, sf_dir, "conversations")
    pair = F.shiftright(F.col("conv_id").cast("long"), 1)  # a shift rounds down, below zero as well
    return preference_pairs(turns.select(pair.alias("pair_id"), F.coalesce(F.col("conv_id") % 2 == 0, F.lit(True)).alias("chosen"), "turn", "role", "text"))


_REST = """
SELECT pair_id, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY i) AS body,
       string_agg((begins + length(role) + 5)::VARCHAR || ':' || (begins + length(role) + 5 + length(text) + 7)::VARCHAR, ',' ORDER BY i) FILTER (WHERE role = 'assistant') AS spans
FROM (SELECT *, coalesce(sum(length(role) + length(text) + 13) OVER (PARTITION BY pair_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins
      FROM t JOIN k USING (pair_id) WHERE side = {side} AND i > n_common)
GROUP BY pair_id
"""

ORACLE_SQL = f"""
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, replace(coalesce(role, ''), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT pair_id, least(coalesce(max(i) FILTER (WHERE side = 0), 0), coalesce(max(i) FILTER (WHERE side = 1), 0)) AS n,
             least(n, coalesce((SELECT min(a.i) - 1 FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.i = b.i AND a.side = 0 AND b.side = 1
                                WHERE a.pair_id = t.pair_id AND (a.role <> b.role OR a.text <> b.text)), n)) AS n_common FROM t GROUP BY pair_id),
p AS (SELECT pair_id, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY i) AS prompt FROM t JOIN k USING (pair_id) WHERE side = 0 AND i <= n_common GROUP BY pair_id),
c AS ({_REST.format(side=0)}),
r AS ({_REST.format(side=1)})
SELECT k.pair_id, n_common::BIGINT AS n_common, coalesce(prompt, '') AS prompt, coalesce(c.body, '') AS chosen, coalesce(c.spans, '') AS chosen_spans,
       coalesce(r.body, '') AS rejected, coalesce(r.spans, '') AS rejected_spans
FROM k LEFT JOIN p USING (pair_id) LEFT JOIN c USING (pair_id) LEFT JOIN r USING (pair_id)
UNION ALL
SELECT NULL, 0, '', '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10),
       CASE WHEN role = 'assistant' THEN (length(role) + 5)::VARCHAR || ':' || (length(role) + 5 + length(text) + 7)::VARCHAR ELSE '' END, '', ''
FROM (SELECT replace(coalesce(role, ''), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations WHERE conv_id IS NULL)
"""
