"""Registered queries of this subpackage, each over its whole table, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hazegrid.llm import align, decontam, lm, maintext, mixing, packing, pii, quality, simhash, tokcount, trie, urlfilter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


@query
def op10_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return quality.judge(docs).drop("class_distance", "word_distance", "word_limit")


@query
def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op9_spaced_seed_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontam.overlaps(docs, items)


@query
def op2_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.shares_taken(docs).select("doc_id", "size", "source_size", "target", "taken")


@query
def op8_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.packed_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokcount.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/"))


@query
def op4_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages", "page_id", "url"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return urlfilter.judge_urls(pages, labels, URL_RULES).drop("rate", "lower_bound")


@query
def op7_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query
def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op3_logistic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.main_texts(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.turns_of(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return trie.prefix_trie(trie.with_shared_heads(turns))


@query
def op13_cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return align.alignments(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL["op10_quality_divergence"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, lang FROM documents),
own AS (
  SELECT lang FROM d WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= {quality.LANG_SHARE} * (SELECT count(*) FROM d)),
w AS (
  SELECT r, doc_id, t, CASE WHEN lang IN (FROM own) THEN lang ELSE '' END AS l, {_WORDS.format('t')} AS words,
    {_WORDS.format(_LOWER.format('t'))} AS lowered FROM d),
lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
grams AS (
  SELECT r, i, words[i:i + {quality.WINDOW - 1}] AS g
  FROM (SELECT r, words, unnest(range(1, len(words) - {quality.WINDOW - 2})) AS i FROM w WHERE len(words) > {quality.WINDOW})),
again AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
repeats AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest(range(i, i + {quality.WINDOW})) AS p FROM again) GROUP BY r),
base AS (
  SELECT w.r, doc_id, l, t, lowered, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r)),
classes AS (
  SELECT r, l, k, len(regexp_replace(t, pattern, '', 'g'))::DOUBLE AS n FROM base CROSS JOIN (VALUES
    (0, '[^a-z]'), (1, '[^A-Z]'), (2, '[^0-9]'), (3, '[^\x20\x09-\x0D]'),
    (4, '[a-zA-Z0-9\x20\x09-\x0D#*$%&|<>]|[^\x00-\x7F]'), (5, '[\x00-\x7F]'), (6, '[^#*$%&|<>]')) AS p(k, pattern)),
class_ref AS (SELECT l, k, sum(n) AS n FROM classes GROUP BY l, k),
class_js AS (
  SELECT r, CASE WHEN min(a) = 0 THEN 1 ELSE sqrt(greatest(0, sum(
      CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) END AS js
  FROM (
    SELECT r, a, CASE WHEN a = 0 THEN 0 ELSE c.n / a END AS p, f.n / b AS q
    FROM (SELECT *, sum(n) OVER (PARTITION BY r) AS a FROM classes) c
    JOIN (SELECT *, sum(n) OVER (PARTITION BY l) AS b FROM class_ref) f USING (l, k)) GROUP BY r),
all_words AS (SELECT r, l, unnest(lowered) AS word FROM base),
totals AS (SELECT l, sum(n_words)::DOUBLE AS total FROM base GROUP BY l),
word_ref AS (
  SELECT l, word, count(*)::DOUBLE AS n, any_value(total) AS total FROM all_words JOIN totals USING (l) GROUP BY l, word
  HAVING count(*) >= {quality.COMMON_SHARE} * any_value(total)),
bins AS (
  SELECT l, word, n / total AS q FROM word_ref
  UNION ALL SELECT l, NULL, (t.total - coalesce(sum(n), 0)) / t.total FROM totals t LEFT JOIN word_ref USING (l) GROUP BY l, t.total),
sizes AS (SELECT l, count(*) AS k FROM bins GROUP BY l),
found AS (SELECT r, l, word, count(*)::DOUBLE AS n FROM all_words SEMI JOIN word_ref USING (l, word) GROUP BY r, l, word),
shares AS (
  SELECT b.r, b.n_words, s.q, CASE WHEN b.n_words = 0 THEN 0 ELSE
    coalesce(CASE WHEN s.word IS NULL THEN b.n_words - coalesce(o.n, 0) ELSE f.n END, 0) / b.n_words END AS p
  FROM base b JOIN bins s USING (l) LEFT JOIN found f ON f.r = b.r AND f.word = s.word
    LEFT JOIN (SELECT r, sum(n) AS n FROM found GROUP BY r) o ON o.r = b.r),
word_js AS (
  SELECT r, CASE WHEN min(n_words) = 0 THEN 1 ELSE sqrt(greatest(0, sum(
      CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) END AS js
  FROM shares GROUP BY r),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (n_words < {quality.MIN_WORDS} OR (c.js <= {quality.CHAR_LIMIT}
    AND v.js <= sqrt({quality.WORD_LIMIT ** 2} + {quality.NOISE} * (k - 1) / (8 * n_words * ln(2))))) AS kept
FROM judged JOIN class_js c USING (r) JOIN word_js v USING (r) JOIN sizes USING (l)"""


_TOKENS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '')"
_AT = "unnest(range(0, len(words) - 7)) AS pos"


def _masked(mask: str) -> str:
    return "concat_ws(' ', " + ", ".join(f"words[pos + {i + 1}]" for i, c in enumerate(mask) if c == "1") + ")"


_EQUAL = [f"(CASE WHEN d.pos + {k} >= 0 AND i.pos + {k} >= 0 AND d.words[d.pos + {k + 1}] = i.words[i.pos + {k + 1}] THEN 1 ELSE 0 END)"
          for k in range(-5, 13)]
_WINDOWS = ", ".join(f"CASE WHEN i.pos + {k} >= 0 AND i.pos + {k + 13} <= len(i.words) THEN {' + '.join(_EQUAL[k + 5:k + 18])} END" for k in range(-5, 1))

ORACLE_SQL["op9_spaced_seed_overlaps"] = f"""
WITH items AS (
  SELECT min(item_id) AS item_id, words FROM (SELECT item_id, {_TOKENS} AS words FROM benchmark) WHERE len(words) >= 8 GROUP BY words),
docs AS (SELECT doc_id, {_TOKENS} AS words FROM documents),
i AS (SELECT item_id, words, pos, unnest([{', '.join(f"'{m}' || {_masked(x)}" for m, x in enumerate(decontam.MASKS))}]) AS seed
  FROM (SELECT item_id, words, {_AT} FROM items)),
places AS (SELECT doc_id, words, {_AT} FROM docs WHERE len(words) >= 8),
d AS (SELECT doc_id, words, pos, unnest([{', '.join(f"'{m}' || {_masked(x)}" for m, x in enumerate(decontam.MASKS))}]) AS seed FROM places),
hits AS (
  SELECT doc_id, item_id, least(len(i.words), 13)::BIGINT AS window_tokens,
    CASE WHEN len(i.words) < 13 THEN {' + '.join(_EQUAL[1:17])} ELSE greatest({_WINDOWS}) END::BIGINT AS matched
  FROM d JOIN i USING (seed))
SELECT doc_id, item_id, max(matched)::BIGINT AS matched, max(window_tokens)::BIGINT AS window_tokens, count(*)::BIGINT AS n_hits
FROM (
  SELECT * FROM hits WHERE matched >= CASE WHEN window_tokens < 13 THEN window_tokens ELSE 11 END
  UNION ALL
  SELECT doc_id, item_id, k AS matched, k AS window_tokens FROM (
    SELECT doc_id, item_id, d.words AS dw, i.words AS iw, len(i.words) AS k, unnest(range(0, len(d.words) - len(i.words) + 1)) AS p
    FROM docs d, (SELECT min(item_id) AS item_id, words FROM (SELECT item_id, {_TOKENS} AS words FROM benchmark) WHERE len(words) BETWEEN 1 AND 7 GROUP BY words) i)
  WHERE dw[p + 1:p + k] = iw)
GROUP BY doc_id, item_id"""


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


_LONGEST = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
_RULE = " ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for _, h, p in _LONGEST)
_RULED = " ".join(f"WHEN {_fits(h, p)} THEN '{v}'" for v, h, p in _LONGEST)


def _strength(units: str) -> str:
    low, high = urlfilter.STRENGTHS
    rho = "sum((bad - n * prior) ** 2 - n * prior * (1 - prior)) / nullif(sum(n * prior * (1 - prior) * (n - 1)), 0)"
    return f"(SELECT CASE WHEN r IS NULL OR r <= 0 THEN {high} ELSE least({high}, greatest({low}, 1 / r - 1)) END FROM (SELECT {rho} AS r FROM {units}))"


ORACLE_SQL["op4_host_reputation"] = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
raw AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM cut),
rows AS (
  SELECT page_id, {_LOWER.format('h')} AS host, regexp_extract(substr(rest, len(h) + 1), '^[^?#]*') AS path FROM raw),
known AS (SELECT doc_id, max(greatest(toxic, 1 - quality)) AS bad FROM labels GROUP BY doc_id),
bare AS (
  SELECT host, bad, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS b
  FROM rows LEFT JOIN known ON page_id = doc_id),
parts AS (
  SELECT host, bad, b, string_split(b, '.') AS l, regexp_matches(b, '^[0-9.]+$') OR starts_with(b, '[') AS address FROM bare),
twos AS (SELECT *, array_to_string(l[-2:], '.') AS last2 FROM parts),
named AS (
  SELECT host, bad, CASE WHEN address THEN '' WHEN last2 IN {urlfilter.DOUBLE_SUFFIXES} THEN last2 ELSE l[-1] END AS suffix,
    CASE WHEN address THEN b WHEN last2 IN {urlfilter.DOUBLE_SUFFIXES} THEN array_to_string(l[-3:], '.') ELSE last2 END AS domain FROM twos),
hosts AS (SELECT host, domain, suffix, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM named GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, coalesce((SELECT sum(bad) / nullif(sum(n), 0) FROM hosts), 0) AS prior FROM hosts GROUP BY suffix),
sp AS (SELECT suffix, (k * prior + bad) / (k + n) AS prior FROM s, (SELECT {_strength('s')} AS k)),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(prior) AS prior FROM hosts JOIN sp USING (suffix) GROUP BY domain, suffix),
dp AS (SELECT domain, suffix, (k * prior + bad) / (k + n) AS prior FROM d, (SELECT {_strength('d')} AS k)),
h AS (SELECT host, n, bad, prior FROM hosts JOIN dp USING (domain, suffix)),
hp AS (SELECT host, k * prior + bad AS a, k * (1 - prior) + n - bad AS b FROM h, (SELECT {_strength('h')} AS k)),
fame AS (SELECT host, a / (a + b) - {urlfilter.Z} * sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) AS bound FROM hp)
SELECT page_id, host, path, CASE {_RULE} END AS rule,
  CASE {_RULED} WHEN bound > {urlfilter.LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM rows JOIN fame USING (host)"""
