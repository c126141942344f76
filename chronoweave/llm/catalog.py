"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import entity_match, leakage, packing, quality, splitting
from chronoweave.runtime import Workspace, read_table


def p3_matches(spark: SparkSession, folder: str) -> DataFrame:
    with Workspace(spark, "p3") as ws:
        return entity_match.match(*(read_table(spark, folder, t) for t in ("nodes", "aliases", "recon_nodes")), ws)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_matches(spark, folder).select("node_id", "recon_id")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.pieces(read_table(spark, folder, "chunks"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_pieces(spark, folder).select("chunk_id", "forced").distinct()


P5_FOUND_SQL = """
select distinct id chunk_id, cast(list_max(list_transform(regexp_split_to_array(text, '[ \\t\\n]'), lambda x: length(x))) > 1200 as integer) forced
from chunks where length(text) > 1200
"""

#: Where the public vocabularies lie on this machine and on every executor.
VOCABULARY = os.environ.get("CHRONOWEAVE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    with Workspace(spark, "p7") as ws:
        return packing.fill(read_table(spark, folder, "documents"), ws, VOCABULARY)


def p7_room(spark: SparkSession, folder: str) -> DataFrame:
    return packing.room(p7_fill(spark, folder))


def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and items of which a passage stands in them with at most two words of fifteen edited."""
    return leakage.leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_leaks(spark, folder).where("whole and n_words >= 15").select("doc_id", "item_id").distinct()


_WORDS = r"""regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(replace(replace({x}, '&nbsp;', ' '), '&amp;', '&'), '[\x{AD}\x{34F}\x{61C}\x{180E}\x{200B}\x{200C}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]', '', 'g'), '</?[A-Za-z][^<>@]{0,80}>', '', 'g'), '-\n', '', 'g')), '[\p{L}\p{N}]+')"""
P8_FOUND_SQL = f"""
with d as (select doc_id id, {_WORDS.replace('{x}', 'text')} w from documents where text is not null), i as (select item_id id, {_WORDS.replace('{x}', 'passage')} w from eval_items where passage is not null),
g as (select id, array_to_string(list_slice(w, k, k + 14), ' ') s from i, unnest(range(1, len(w) - 13)) t(k)), h as (select id, array_to_string(list_slice(w, k, k + 14), ' ') s from d, unnest(range(1, len(w) - 13)) t(k))
select distinct h.id doc_id, g.id item_id from h join g using (s)
"""


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """Which test items leaked, and into how many documents."""
    return p8_leaks(spark, folder).groupBy("item_id").agg(F.count_if(F.col("whole")).alias("n_whole"), F.count_if(~F.col("whole")).alias("n_edited"), F.min("edits").alias("least_edits"))


def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return quality.statistics(read_table(spark, folder, "documents"))


def p9_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The plain statistics of every text."""
    return p9_statistics(spark, folder).select("doc_id", "n_words", *[F.round(c, 9).alias(c) for c in ("mean_word_length", "symbol_share", "end_punctuation_share")])


_BLANK = r"[\t-\r\x1c-\x20\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
P9_COUNTS_SQL = rf"""
with d as (select doc_id, text, regexp_replace(text, '{_BLANK}', '', 'g') solid, list_filter(regexp_split_to_array(text, '{_BLANK}+'), lambda x: x <> '') w,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{_BLANK}+|{_BLANK}+$', '', 'g')), lambda x: x <> '') lines from documents where trim(translate(text, chr(10) || chr(9) || chr(13), '   ')) <> '')
select doc_id, len(w)::double n_words, round(length(solid) / len(w), 9) mean_word_length, round(length(regexp_replace(solid, '[\p{{L}}\p{{N}}_]', '', 'g')) / length(solid), 9) symbol_share,
  round(len(list_filter(lines, lambda x: regexp_matches(right(x, 4), '[.!?…:]["''”’)\]]*$'))) / len(lines), 9) end_punctuation_share from d
"""


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    with Workspace(spark, "p9") as ws:
        return ws.put(quality.outlier_scores(ws.put(quality.keyed_statistics(read_table(spark, folder, "documents"))), ws), keep=True)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    with Workspace(spark, "p9") as ws:
        return ws.put(quality.no_prose(read_table(spark, folder, "documents"), ws).select("doc_id"), keep=True)


QUERIES = {f.__name__: f for f in (p3_found, p3_matches, p5_found, p5_pieces, p7_fill, p7_room, p8_found, p8_leaks, p8_items, p9_found, p9_scores, p9_statistics, p9_counts)}
SQL = {"p5_found": P5_FOUND_SQL, "p8_found": P8_FOUND_SQL, "p9_counts": P9_COUNTS_SQL}
