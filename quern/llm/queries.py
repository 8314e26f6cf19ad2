"""Queries p5, p8, p9 and p10 over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import folded_name
from ..plans.data_queries import instant_of
from ..plans.instant_sql import instants
from ..sources.tables import table
from . import languages, leakage, nearest, tokenizer

#: 36 hours in microseconds.
P5_TOLERANCE = 36 * 3600 * 1_000_000


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    instant = instant_of(spark, d)

    def side(name: str, key: str, to: str) -> DataFrame:
        return table(spark, d, name).select(folded_name(F.col("EmployeeName")).alias("entity"), instant(F.col("UpdateDate"), F.col("feed")).alias("at"), F.col(key).alias(to))

    return nearest.pair_nearest(side("employees", "emp_row", "left_key"), side("employee_info", "info_row", "right_key"), P5_TOLERANCE)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pairs(spark, d).select(F.col("left_key").alias("emp_row"), F.col("right_key").alias("info_row"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """How many texts come back from their ids as they were (null as empty)."""
    docs = table(spark, d, "documents")
    back = tokenizer.decode(tokenizer.encode(docs)).select("doc_id", F.xxhash64("text").alias("after"))
    both = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("before")).join(back, "doc_id")
    return both.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("before") == F.col("after")).alias("n_equal"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Items that leaked, and into how many documents."""
    return p9_leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max(F.col("words") / F.col("item_words")).alias("most"))


def p9_without_spans(spark: SparkSession, d: str) -> DataFrame:
    """All documents, without the passages of items."""
    return leakage.without_spans(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items"))


def p9_without_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents that leak no item."""
    return leakage.without_documents(table(spark, d, "documents").select("doc_id", "text"), p9_leaks(spark, d))


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    return languages.identify(table(spark, d, "documents")).select("doc_id", "segment", "lang", "confidence")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    found = languages.identify(table(spark, d, "documents"))
    label = F.regexp_extract(F.lower(languages.strip(F.col("label"))), r"^([^-_]*)", 1)
    return found.where((F.col("segment") > 0) | ~label.eqNullSafe(F.col("lang"))).select("doc_id", "segment", "lang")


QUERIES = {f.__name__: f for f in (p5_found, p8_ids, p8_round_trip, p9_found, p9_report, p9_without_spans, p9_without_documents, p10_found, p10_languages)}



def _words(c: str) -> str:
    plain = rf"lower(regexp_replace({c}, '[\x{{200B}}\x{{AD}}\x{{200C}}\x{{200D}}\x{{2060}}\x{{FEFF}}]', '', 'g'))"
    return rf"list_filter(regexp_split_to_array({plain}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


_P9 = f"""
    with items as (select item_id, {_words('text')} as w from eval_items),
        docs as (select doc_id, {_words('text')} as w from documents),
        grams as (select item_id, len(w) as n, i, w[i : i + 4] as g from items, lateral (select unnest(range(1, len(w) - 3)) as i)),
        windows as (select distinct doc_id, w[i : i + 4] as g from docs, lateral (select unnest(range(1, len(w) - 3)) as i)),
        hits as (select doc_id, item_id, n, unnest(range(i, i + 5)) as p from windows join grams using (g))
    select doc_id, item_id, count(distinct p) as words, any_value(n) as item_words from hits group by 1, 2 having count(distinct p) >= 0.25 * any_value(n)"""
_INVISIBLE = r"[\x{200B}\x{AD}\x{200C}\x{200D}\x{2060}\x{FEFF}]"
#: Texts in parts, words and what is between them; a word goes with the run of a shared n-gram that it lies in, what follows it with the run that goes on behind it.
_P9_SPANS = rf"""
    with items as (select {_words('text')} as w from eval_items),
        grams as (select distinct w[i : i + 4] as g from items, lateral (select unnest(range(1, len(w) - 3)) as i)),
        docs as (select doc_id, text, {_words('text')} as w, regexp_extract_all(text, '[\p{{L}}\p{{N}}](?:{_INVISIBLE}*[\p{{L}}\p{{N}}])*|[^\p{{L}}\p{{N}}]+') as parts from documents),
        hits as (select doc_id, i from (select doc_id, i, w[i : i + 4] as g from docs, lateral (select unnest(range(1, len(w) - 3)) as i)) semi join grams using (g)),
        words as (select distinct doc_id, unnest(range(i, i + 5)) as k, true as is_word from hits union select distinct doc_id, unnest(range(i, i + 4)), false from hits),
        cut as (select doc_id, unnest(parts) as part, unnest(range(1, len(parts) + 1)) as j from docs where doc_id in (select doc_id from hits)),
        placed as (select *, regexp_matches(part, '^[\p{{L}}\p{{N}}]') as is_word, sum(case when regexp_matches(part, '^[\p{{L}}\p{{N}}]') then 1 else 0 end) over (partition by doc_id order by j) as k from cut),
        kept as (select doc_id, string_agg(part, '' order by j) as text from (select * from placed anti join words using (doc_id, k, is_word)) group by doc_id)
    select doc_id, text from documents where doc_id not in (select doc_id from hits)
    union all select doc_id, coalesce(kept.text, '') from (select distinct doc_id from hits) left join kept using (doc_id)"""
_NAME = r"""nullif(trim(regexp_replace(lower("EmployeeName"), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')), '')"""
_P5_SIDES = "a as (select * from {0}), b as (select * from {1})".format(
    *(instants(f'(select {key}, {_NAME} as name, "UpdateDate" as text, feed from {name})') for name, key in (("employees", "emp_row"), ("employee_info", "info_row")))
)
#: SQL that gives the same rows. p8_ids and p10 aren't expressible; they are tested by public encoders and accuracy.
ORACLES = {
    "p5_found": f"""with {_P5_SIDES} select emp_row, info_row from a join b on a.name = b.name and abs(a.utc_micros - b.utc_micros) <= {P5_TOLERANCE}
        qualify row_number() over (partition by emp_row order by abs(a.utc_micros - b.utc_micros), info_row) = 1""",
    "p8_round_trip": "select count(*) as n_docs, count(*) as n_equal from documents",
    "p9_found": f"select doc_id, item_id from ({_P9})",
    "p9_without_spans": _P9_SPANS,
    "p9_without_documents": f"select doc_id, text from documents where doc_id not in (select doc_id from ({_P9}))",
    "p9_report": f"select item_id, count(*) as n_docs, max(words / item_words) as most from ({_P9}) group by 1",
}
