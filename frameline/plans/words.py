"""Queries over texts: normalisers, strict parsers, languages, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decoding as D
from ..functions import english as E
from ..functions import languages as N
from ..functions import text as X
from ..operators import chunks
from ..sources import timeline as T
from .registry import query


@query("txt_1_folded")
def txt_1(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", X.folded(F.col("text"), keep=".%$").alias("folded"))


@query("txt_2_unfolded")
def txt_2(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", X.unfolded(F.col("text")).alias("plain"))


@query("txt_3_split_letters")
def txt_3_split(spark, sf_dir):
    return T.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.normalised(split_letters=True)("text").alias("letters"))


@query("txt_4_numbers")
def txt_4(spark, sf_dir):
    return T.table(spark, sf_dir, "conversations").select("conv_id", "turn", E.numbers(F.lower("text")).alias("digits"))


#: A few spellings; the full table is the user's.
SPELLINGS = {"colour": "color", "centre": "center", "the": "THE", "and": "AND", "organise": "organize"}
_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in SPELLINGS.items())


@query(
    "txt_5_respelled",
    f"WITH m(w, to_) AS (VALUES {_VALUES}), t AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '[\\s\\x1C-\\x1F]+'), lambda w: w <> '') AS ws FROM conversations), u AS (SELECT conv_id, turn, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM t) SELECT t.conv_id, t.turn, coalesce(r.out_, '') AS respelled FROM t LEFT JOIN (SELECT conv_id, turn, string_agg(coalesce(to_, u.w), ' ' ORDER BY i) AS out_ FROM u LEFT JOIN m ON m.w = u.w GROUP BY 1, 2) r USING (conv_id, turn)",
    views=False,
)
def txt_5(spark, sf_dir):
    return T.table(spark, sf_dir, "conversations").select("conv_id", "turn", E.respelled(F.col("text"), SPELLINGS).alias("respelled"))


@query("jon_15_looked_up", f"WITH m(w, to_) AS (VALUES {_VALUES}) SELECT w, to_, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[\\s\\x1C-\\x1F]+')) AS w FROM conversations) JOIN m USING (w) GROUP BY 1, 2", views=False)
def jon_15(spark, sf_dir):
    """The words that a table of spellings replaces, as a join with the table."""
    table = spark.createDataFrame(list(SPELLINGS.items()), "w string, to_ string")
    words = T.table(spark, sf_dir, "conversations").select(F.explode(F.split(X.squeezed(F.col("text")), " ")).alias("w"))
    return words.join(F.broadcast(table), "w").groupBy("w", "to_").agg(F.count("*").alias("n"))


@query("txt_6_english")
def txt_6(spark, sf_dir):
    return T.table(spark, sf_dir, "conversations").select("conv_id", "turn", E.english("text", SPELLINGS).alias("normal"))


@query("txt_9_strict_values", "SELECT clip_id, frame_idx, k % 2 = 0 AS flag, CASE WHEN k % 3 <> 0 THEN k END AS whole, CASE WHEN k % 3 <> 1 THEN k / 8.0::DOUBLE END AS number FROM sv_base")
def txt_9(spark, sf_dir):
    k = F.col("k")
    flag = F.when(k % 2 == 0, "True").otherwise("False")
    whole, number = F.when(k % 3 == 0, "None").otherwise(k.cast("string")), F.when(k % 3 == 1, "None").otherwise((k / 8.0).cast("string"))
    return T.base(spark, sf_dir).select("clip_id", "frame_idx", X.strict_boolean(flag).alias("flag"), X.optional_number(whole).alias("whole"), X.optional_number(number, "double").alias("number"))


@query(
    "txt_11_languages",
    "WITH n(code, name) AS (VALUES " + ", ".join(f"('{c}', '{n}')" for c, n in N.NAMES.items()) + ") SELECT lang, name, code, count(*) AS n FROM documents LEFT JOIN n ON n.code = lower(lang) GROUP BY 1, 2, 3",
    views=False,
)
def txt_11(spark, sf_dir):
    """Documents by language: the name of the code, and the code of the name."""
    rows = T.table(spark, sf_dir, "documents").select("lang", N.name_of(F.lower("lang")).alias("name"))
    return N.with_code(rows, "name").groupBy("lang", "name", "code").agg(F.count("*").alias("n"))


WORDS = ["a", " b", "c ", "dd", " e"]


@query("txt_12_rendered_times", f", t AS (SELECT clip_id, frame_idx, [k % 7, 5 + k, k % 5, 5 + frame_idx] AS ts FROM sv_base) SELECT clip_id, frame_idx, array_to_string(list_transform(ts, lambda t: CASE WHEN t >= 5 THEN '<|' || printf('%.2f', (t - 5) * 0.02::DOUBLE) || '|>' ELSE ({WORDS})[t + 1] END), '') AS text FROM t")
def txt_12(spark, sf_dir):
    k = F.col("k")
    tokens = F.array(k % 7, k + 5, k % 5, F.col("frame_idx") + 5)
    return T.base(spark, sf_dir).select("clip_id", "frame_idx", D.rendered(tokens, 5, F.array(*map(F.lit, WORDS))).alias("text"))


@query("txt_14_names", "SELECT page_id, regexp_replace(list_extract(string_split(url, '/'), -1), '(.)\\.[^.]*$', '\\1') AS stem, printf('%08d', CAST(page_id AS BIGINT)) AS name FROM pages", views=False)
def txt_14(spark, sf_dir):
    return T.table(spark, sf_dir, "pages").select("page_id", X.stem(F.col("url")).alias("stem"), X.frame_name(F.col("page_id")).alias("name"))


@query("top_12_numeric_order", "SELECT page_id, row_number() OVER (ORDER BY CAST(nullif(regexp_extract(url, '(\\d+)', 1), '') AS BIGINT) NULLS FIRST, page_id) AS place FROM pages", views=False)
def top_12(spark, sf_dir):
    """All pages by the number in their name, as numbers and not as text."""
    number = F.nullif(F.regexp_extract("url", r"(\d+)", 1), F.lit("")).cast("bigint")
    rows = T.table(spark, sf_dir, "pages").select("page_id", number.alias("number"))
    return chunks.in_order(rows, [F.asc_nulls_first("number"), F.asc("page_id")]).select("page_id", "place")
