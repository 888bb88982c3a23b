"""The registered queries of the text operators and their SQL, each over its whole table."""

from __future__ import annotations

import public_tokenizers

from datarights.llm.common import KEY, LOWER, UPPER, documents, labels
from datarights.llm.decontaminate import NOT_WORD, contamination
from datarights.llm.exact import exact_groups
from datarights.llm.filter_audit import audit_filters
from datarights.llm.html_wrappers import extract_main_text
from datarights.llm.interpolation import score_texts
from datarights.llm.log_templates import drop_recurring_lines
from datarights.llm.minhash import near_groups
from datarights.llm.packing import pack
from datarights.llm.planes import token_files
from datarights.llm.quality import fit_quality, score_quality
from datarights.llm.recompress import remove_repeats
from datarights.llm.registry import ORACLES, QUERIES, query
from datarights.llm.spelling import spelling_forms
from datarights.llm.toxicity import fit_toxicity, score_toxicity

__all__ = ["ORACLES", "QUERIES"]


@query("op1_wrappers")
def op1(spark, sf_dir):
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("op2_minhash")
def op2(spark, sf_dir):
    return near_groups(documents(spark, sf_dir))


@query("op3_exact_dedup", f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t.x) AS text_sha256 FROM t JOIN g USING (x)""")
def op3(spark, sf_dir):
    return exact_groups(documents(spark, sf_dir))


@query("op9_toxicity")
def op9(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return score_toxicity(docs, fit_toxicity(docs, labels(spark, sf_dir)))


@query("op10_pattern_packing")
def op10(spark, sf_dir):
    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_interpolation")
def op4(spark, sf_dir):
    return score_texts(documents(spark, sf_dir))


@query("op5_quality")
def op5(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return score_quality(docs, fit_quality(docs, labels(spark, sf_dir)))


@query("op6_recompression")
def op6(spark, sf_dir):
    return remove_repeats(documents(spark, sf_dir))


@query("op7_log_templates")
def op7(spark, sf_dir):
    return drop_recurring_lines(documents(spark, sf_dir)).drop("kept")


@query("op8_decontaminate", f"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NOT_WORD}'), lambda w: w <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NOT_WORD}'), lambda w: w <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[s:s + 12] AS p FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS s FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(p) AS n FROM win),
pl AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM dw, lens WHERE len(w) >= n),
hit AS (SELECT a.doc_id, a.s, a.n, win.item_id FROM (SELECT doc_id, n, s, w[s:s + n - 1] AS p FROM pl) a JOIN win USING (p)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS q FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)""")
def op8(spark, sf_dir):
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("item_ids", *KEY)


@query("op11_gram_spelling")
def op11(spark, sf_dir):
    return spelling_forms(documents(spark, sf_dir))


@query("op12_bit_planes")
def op12(spark, sf_dir):
    return token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op13_filter_audit", """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS lowest FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  (CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END)
  || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN lowest < doc_id THEN 'E' ELSE '' END) AS fails FROM w LEFT JOIN l USING (doc_id)),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS c, left(filter_order, step - 1) AS before FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o)),
r AS (SELECT part, filter_order, step, c,
  coalesce(sum(n) FILTER (translate(fails, before || c, '') = fails), 0) AS kept,
  coalesce(sum(n) FILTER (contains(fails, c) AND translate(fails, before, '') = fails), 0) AS removed,
  coalesce(sum(n) FILTER (contains(fails, c) AND translate(fails, before, '') <> fails), 0) AS redundant,
  coalesce(sum(n) FILTER (fails = c), 0) AS unique_fails,
  coalesce(sum(good) FILTER (contains(fails, c) AND translate(fails, before, '') = fails), 0) AS good_lost,
  coalesce(sum(toxic) FILTER (contains(fails, c) AND translate(fails, before, '') = fails), 0) AS toxic_lost
  FROM cells, s GROUP BY part, filter_order, step, c)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM r""")
def op13(spark, sf_dir):
    return audit_filters(documents(spark, sf_dir), labels(spark, sf_dir))
