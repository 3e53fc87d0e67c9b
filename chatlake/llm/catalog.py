"""The queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm import ann, bpe, langid, licenses, packing, pages, phrases, quality, repeats, rules, simhash, spelling, toxicity
from chatlake.llm.common import fold, read_table
from chatlake.session import prepare

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(prepare(spark), sf_dir, "documents").withColumn("held_out", fold("doc_id", 3) == 1)
    model = quality.train(docs, docs.where("not held_out"), read_table(spark, sf_dir, "labels"))
    return quality.score(docs, model, "doc_id", "held_out")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(prepare(spark), sf_dir, "documents").withColumn("held_out", fold("doc_id", 5) == 0)
    model = langid.train(docs.where("not held_out"))
    return langid.predict(docs, model, "doc_id", "held_out")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(prepare(spark), sf_dir, "documents"))
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(prepare(spark), sf_dir, "embeddings")
    return ann.search(rows, F.col("id") % 20 == 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(prepare(spark), sf_dir, "documents").withColumn("held_out", fold("doc_id", 5) == 0)
    model = toxicity.train(docs.where("not held_out"), read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, "doc_id", "held_out")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(read_table(prepare(spark), sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(prepare(spark), sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.decode(bpe.encode(read_table(prepare(spark), sf_dir, "documents")))
    return tokens.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(read_table(prepare(spark), sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read_table(prepare(spark), sf_dir, "documents"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(prepare(spark), sf_dir, "pages")
    return pages.extract(rows, pages.train(rows))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(prepare(spark), sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(read_table(prepare(spark), sf_dir, "documents"))


def _quality_rules_sql() -> str:
    """The same counts by exploding, and exact quartiles by rank."""
    names = list(rules.MARGINS)
    quartiles = ", ".join(
        f"max({n}) filter (where r_{n} = greatest(1, ceil(0.25 * c))) as a_{n}, "
        f"max({n}) filter (where r_{n} = greatest(1, ceil(0.75 * c))) as b_{n}"
        for n in names
    )
    ranks = ", ".join(f"row_number() over (partition by lv order by {n}) as r_{n}" for n in names)
    inside = " and ".join(
        f"{n} between a_{n} - greatest((b_{n} - a_{n}) * {rules.SPREAD}, {m}) "
        f"and b_{n} + greatest((b_{n} - a_{n}) * {rules.SPREAD}, {m})"
        for n, m in rules.MARGINS.items()
    )
    return rf"""
with words as (
  select doc_id, lang, source, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ln
  from documents
), places as (
  select doc_id, p, w[p] || chr(10) || w[p + 1] || chr(10) || w[p + 2] as g
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as p from words)
), twice as (
  select doc_id, p from (select doc_id, p, count(*) over (partition by doc_id, g) as c from places) where c > 1
), covered as (
  select doc_id, count(distinct q) as n_repeat_words
  from (select doc_id, unnest([p, p + 1, p + 2]) as q from twice) group by doc_id
), counts as (
  select doc_id, lang, source, len(w)::bigint as n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         (len(ln) - len(list_distinct(ln)))::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(ln) as n_lines
  from words left join covered using (doc_id)
), shares as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
         case when word_chars > 0 then n_symbols / word_chars else 0.0 end as symbol_share,
         case when n_lines > 0 then n_dup_lines / n_lines else 0.0 end as dup_line_share,
         case when n_words > 0 then n_repeat_words / n_words else 0.0 end as repeat_share,
         case when n_words > 0 then word_chars / n_words else 0.0 end as mean_word_chars
  from counts
), leveled as (
  select *, unnest([[coalesce('v' || lang, 'n'), coalesce('v' || source, 'n')],
                    [coalesce('v' || lang, 'n')], []::varchar[]]) as lv
  from shares where n_words > 0
), ranked as (
  select *, count(*) over (partition by lv) as c, {ranks} from leveled
), limits as (
  select lv, max(c) as c, {quartiles} from ranked group by lv
), wanted as (
  select distinct lang, source, unnest([1, 2, 3]) as pos,
         unnest([[coalesce('v' || lang, 'n'), coalesce('v' || source, 'n')],
                 [coalesce('v' || lang, 'n')], []::varchar[]]) as lv
  from shares where n_words > 0
), chosen as (
  select * from wanted join limits using (lv) where c >= {rules.MIN_GROUP} or pos = 3
  qualify row_number() over (partition by lang, source order by pos) = 1
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and coalesce({inside}, true) as kept
from shares s left join chosen c on s.lang is not distinct from c.lang and s.source is not distinct from c.source
"""


def _phrases_sql() -> str:
    """Every n-gram of one to three words counted for itself."""
    return rf"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(
    translate(coalesce(text, ''), '{phrases.UPPER}', '{phrases.LOWER}'), '[.,;:!?\x0A-\x0D]')) as p
  from documents
), words as (
  select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from pieces
), places as (
  select lang, w, unnest(range(1, len(w) + 1)) as i from words
), grams as (
  select lang, w, i, unnest(range(1, {phrases.MAX_WORDS + 1})) as m from places
), f as (
  select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase, count(*) as f
  from grams where i + m - 1 <= len(w) group by all
), candidates as (
  select lang, m, phrase, string_split(phrase, ' ') as w, f as a from f where m > 1 and f >= {phrases.MIN_COUNT}
), cuts as (
  select *, unnest(range(1, m)) as k from candidates
), scored as (
  select c.lang, c.phrase, c.a, c.k, x.f as l, y.f as r,
         (1000000::hugeint * c.a * c.a) // (x.f::hugeint * y.f) as score
  from cuts c
  join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:c.k], ' ') and x.m = c.k
  join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.k + 1:c.m], ' ') and y.m = c.m - c.k
  qualify row_number() over (partition by c.lang, c.phrase order by score, c.k) = 1
), inner_grams as (
  select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase, a as longer
  from candidates where m = 3
), covering as (
  select lang, phrase, max(longer) as longer from inner_grams group by all
), totals as (
  select lang, count(*) as n from places group by lang
)
select s.lang, row_number() over (partition by s.lang order by s.score desc, s.a desc, s.phrase) as rank,
       s.phrase, s.a, s.l, s.r, t.n, s.score::bigint as score
from scored s left join covering c using (lang, phrase) join totals t on t.lang = s.lang
where c.longer is null or 100 * c.longer < {phrases.INSIDE} * s.a
qualify rank <= {phrases.TOP}
"""


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_language": op2_language,
    "op3_packing": op3_packing,
    "op4_neighbours": op4_neighbours,
    "op5_toxicity": op5_toxicity,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_simhash": op7_simhash,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_licenses": op9_licenses,
    "op10_quality_rules": op10_quality_rules,
    "op11_html_text": op11_html_text,
    "op12_spelling": op12_spelling,
    "op13_phrases": op13_phrases,
}

CHECKS: dict[str, str] = {
    "op10_quality_rules": _quality_rules_sql(),
    "op13_phrases": _phrases_sql(),
}
