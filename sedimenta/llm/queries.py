"""The queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

_WHERE = {
    "op1_toxicity": "toxicity",
    "op2_decontamination": "decontamination",
    "op3_pieces": "pieces",
    "op4_quality": "quality",
    "op5_hilbert_shards": "sharding",
    "op6_substring_dedup": "substrings",
    "op7_language": "language",
    "op8_token_files": "tokenfiles",
    "op9_simhash": "simhash",
    "op10_suffix_tree": "suffixtree",
    "op11_embedding_dedup": "vectors",
    "op12_ranked_search": "search",
    "op13_filter_audit": "audit",
}


def _pipeline(spark, sf_dir):
    return import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict:
    return {name: getattr(import_module(f"sedimenta.llm.{module}"), name) for name, module in _WHERE.items()} | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op6_substring_dedup": OP6_SQL, "op12_ranked_search": OP12_SQL, "op13_filter_audit": OP13_SQL}


_OP2_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_OP2_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_OP2_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.g = dw.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
        string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
firsts AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT win.doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN firsts USING (g) WHERE win.doc_id > firsts.m)),
k AS (SELECT d.doc_id, i, d.w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) d ANTI JOIN gone ON gone.doc_id = d.doc_id AND gone.p = d.i),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_OP12_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
WITH d AS (SELECT doc_id, {_OP12_TERMS.format("coalesce(text, '')")} AS w FROM documents),
whole AS (SELECT count(*) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY doc_id, n, t),
df AS (SELECT t, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, whole GROUP BY t, big_n),
q AS (SELECT item_id, t, count(*) AS qtf FROM (SELECT item_id, unnest({_OP12_TERMS.format("coalesce(text, '')")}) AS t FROM benchmark) GROUP BY item_id, t),
scored AS (SELECT item_id, doc_id, CAST(sum(qtf * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l)))) AS BIGINT) AS score
           FROM q JOIN df USING (t) JOIN tf USING (t), whole GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

OP13_SQL = r"""
WITH w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id
           FROM (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents)),
flags AS (SELECT doc_id, part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t) AS c,
          regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > first_id, false) AS e FROM w),
judged AS (SELECT part, [a, b, c, d, e] AS fails, quality = 1 AS good, toxic = 1 AS bad FROM flags LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)),
f AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (SELECT [x1.i, x2.i, x3.i, x4.i, x5.i] AS o FROM f x1, f x2, f x3, f x4, f x5 WHERE len(list_distinct([x1.i, x2.i, x3.i, x4.i, x5.i])) = 5),
steps AS (SELECT o, i AS step, o[i] AS fi, o[1:i - 1] AS prior FROM orders, f),
hits AS (SELECT part, o, step, fi, fails[fi] AS failing, len(list_filter(prior, lambda p: fails[p])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS k, good, bad FROM judged, steps),
sums AS (SELECT part, o, step, fi, count(*) FILTER (NOT failing AND NOT gone) AS kept, count(*) FILTER (failing AND NOT gone) AS removed, count(*) FILTER (failing AND gone) AS redundant,
         count(*) FILTER (failing AND k = 1) AS unique_fails, count(*) FILTER (failing AND NOT gone AND good) AS good_lost, count(*) FILTER (failing AND NOT gone AND bad) AS toxic_lost FROM hits GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, fi) AS BIGINT) AS shapley FROM sums
"""
