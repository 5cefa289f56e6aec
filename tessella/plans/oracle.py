"""DuckDB SQL for the registered queries, put together from common table expressions."""

from __future__ import annotations

from tessella.functions.words import ADDRESS_STOP, GENERIC, LEGAL, SCRIPTS, STATES, STREET, TLD
from tessella.operators import features
from tessella.operators.scoring import GATE, PREFILTER, TOP_K, Weights


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


def fold(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower(coalesce({x}, ''))), '[^0-9a-z]+', ' ', 'g'))"


def toks(x: str) -> str:
    return f"list_filter(string_split({fold(x)}, ' '), lambda t: t <> '')"


def as_set(x: str) -> str:
    return f"list_sort(list_distinct({x}))"


def grams(ch: str) -> str:
    """Trigrams from a list of characters."""
    return f"CASE WHEN len({ch}) = 0 THEN [] WHEN len({ch}) < 3 THEN [array_to_string({ch}, '')] ELSE list_distinct(list_transform(range(1, len({ch}) - 1), lambda i: {ch}[i] || {ch}[i + 1] || {ch}[i + 2])) END"


def chars(x: str) -> str:
    return f"list_filter(string_split({x}, ''), lambda c: c <> '')"


def common(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))::DOUBLE"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0.0::DOUBLE END"


def jaccard(a: str, b: str) -> str:
    return ratio(common(a, b), f"len({a}) + len({b}) - {common(a, b)}")


def dice(a: str, b: str) -> str:
    return ratio(f"2 * {common(a, b)}", f"len({a}) + len({b})")


def containment(a: str, b: str) -> str:
    return ratio(common(a, b), f"least(len({a}), len({b}))")


DOCUMENTS = r"""
records AS MATERIALIZED (
  SELECT 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id, regexp_extract(coalesce(text, ''), '^[^.\n]*') AS business_name,
         substr(coalesce(text, ''), length(regexp_extract(coalesce(text, ''), '^[^.\n]*')) + 1) AS business_address, coalesce(lang, '') AS country
  FROM documents
)"""
PARTS = """
records AS MATERIALIZED (
  SELECT 'S' || (p_partkey % 3 + 1) || '-' || p_partkey AS entity_id, p_name AS business_name, p_brand || ' ' || p_type || ' ' || p_size AS business_address, 'US' AS country FROM part
)"""

STATE_STEP = "CASE " + " ".join(f"WHEN country = '{c}' THEN list_transform(street, lambda t: coalesce({_map(m)}[t], t))" for c, m in STATES.items()) + " ELSE street END"

NORM = f"""
raw AS MATERIALIZED (
  SELECT *, {toks("business_name")} AS nt, {toks("business_address")} AS atoks, list_transform({toks("business_address")}, lambda t: coalesce({_map(STREET)}[t], t)) AS street,
         replace({fold("business_name")}, ' ', '') AS squashed FROM records
), stepped AS MATERIALIZED (
  SELECT *, {STATE_STEP} AS stated, list_filter(nt, lambda t: t NOT IN {_list(LEGAL)}) AS core0,
         regexp_replace(squashed, '({"|".join(TLD)})$', '') AS short FROM raw
), cored AS MATERIALIZED (
  SELECT *, CASE WHEN len(core0) > 0 THEN core0 ELSE nt END AS core FROM stepped
), ordered AS MATERIALIZED (
  SELECT *, CASE WHEN len(list_filter(core, lambda t: t NOT IN {_list(GENERIC)})) > 0 THEN list_filter(core, lambda t: t NOT IN {_list(GENERIC)}) ELSE core END AS distinctive,
         list_filter(stated, lambda t: t NOT IN {_list(ADDRESS_STOP)}) AS addr_list FROM cored
), norm AS MATERIALIZED (
  SELECT entity_id, CAST(substr(entity_id, 2, 1) AS INTEGER) AS source, country, {as_set("core")} AS nc, {as_set("distinctive")} AS nd, {as_set("addr_list")} AS addr_toks,
         {as_set("list_filter(atoks, lambda t: regexp_matches(t, '[0-9]') AND length(t) <= 8)")} AS numbers,
         CASE WHEN length(short) >= 4 THEN short ELSE squashed END AS nsq FROM ordered
)"""

STATS = """
tokens AS MATERIALIZED (
  SELECT entity_id, source, 'n' AS channel, unnest(nc) AS token FROM norm UNION ALL SELECT entity_id, source, 'a', unnest(addr_toks) FROM norm
), df AS MATERIALIZED (
  SELECT channel, token, count(*) AS df FROM tokens WHERE source <> 1 AND length(token) >= 3 GROUP BY channel, token
), n AS MATERIALIZED (
  SELECT greatest(1, count(*)) AS n_docs FROM norm WHERE source <> 1
), weighed AS MATERIALIZED (
  SELECT t.entity_id, t.source, t.channel, t.token, coalesce(df, 0) AS df, CASE WHEN df IS NULL THEN ln(n_docs) ELSE ln(n_docs / (df + 1)) END AS idf
  FROM tokens AS t LEFT JOIN df USING (channel, token), n
), rare AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY entity_id, channel ORDER BY df, token) AS r FROM weighed WHERE length(token) >= 3
)"""


def keys(df_cap: int = 60) -> str:
    return f"""
blocking AS MATERIALIZED (
  SELECT DISTINCT k.entity_id, norm.source, norm.country, k.family, k.t1, k.t2 FROM (
    SELECT entity_id, 'a' AS family, token AS t1, '' AS t2 FROM rare WHERE channel = 'a' AND r <= 3 AND df <= {df_cap}
    UNION ALL SELECT entity_id, 'n', token, '' FROM rare WHERE channel = 'n' AND r <= 2 AND df <= {df_cap}
    UNION ALL SELECT x.entity_id, 'x', x.token, y.token FROM rare AS x JOIN rare AS y USING (entity_id) WHERE x.channel = 'n' AND x.r <= 2 AND y.channel = 'a' AND y.r <= 2
    UNION ALL SELECT x.entity_id, CASE x.channel WHEN 'a' THEN 'y' ELSE 'z' END, x.token, y.token FROM rare AS x JOIN rare AS y USING (entity_id, channel) WHERE x.r = 1 AND y.r = 2
    UNION ALL SELECT d.entity_id, 'd', d.m, r.token FROM (SELECT entity_id, unnest(numbers[1:2]) AS m FROM norm) AS d JOIN rare AS r USING (entity_id) WHERE r.channel = 'a' AND r.r = 1
  ) AS k JOIN norm USING (entity_id)
)"""


def pairs(max_posting: int = 200) -> str:
    return f"""
posting AS MATERIALIZED (
  SELECT country, family, t1, t2, entity_id AS s1_id FROM (SELECT *, count(*) OVER (PARTITION BY country, family, t1, t2) AS size FROM blocking WHERE source = 1) WHERE size <= {max_posting}
), pairs AS MATERIALIZED (
  SELECT DISTINCT p.s1_id, b.entity_id AS target_id FROM posting AS p JOIN blocking AS b USING (country, family, t1, t2) WHERE b.source <> 1
)"""


TOTALS = """
totals AS MATERIALIZED (
  SELECT entity_id, coalesce(sum(idf) FILTER (channel = 'n'), 0) AS sum_n, coalesce(sum(idf) FILTER (channel = 'a'), 0) AS sum_a,
         coalesce(sum(idf * idf) FILTER (channel = 'n'), 0) AS square_n, coalesce(sum(idf * idf) FILTER (channel = 'a'), 0) AS square_a FROM weighed GROUP BY entity_id
), shared AS MATERIALIZED (
  SELECT s1_id, target_id, coalesce(sum(x.idf) FILTER (x.channel = 'n'), 0) AS both_n, coalesce(sum(x.idf) FILTER (x.channel = 'a'), 0) AS both_a,
         coalesce(sum(x.idf * x.idf) FILTER (x.channel = 'n'), 0) AS bothsq_n, coalesce(sum(x.idf * x.idf) FILTER (x.channel = 'a'), 0) AS bothsq_a
  FROM pairs JOIN weighed AS x ON x.entity_id = s1_id JOIN weighed AS y ON y.entity_id = target_id AND y.channel = x.channel AND y.token = x.token GROUP BY s1_id, target_id
), joined AS MATERIALIZED (
  SELECT pairs.s1_id, pairs.target_id, p.nc AS p_nc, p.nd AS p_nd, p.addr_toks AS p_addr, p.numbers AS p_num, p.nsq AS p_nsq, q.nc AS q_nc, q.nd AS q_nd, q.addr_toks AS q_addr, q.numbers AS q_num, q.nsq AS q_nsq,
         coalesce(both_n, 0) AS both_n, coalesce(both_a, 0) AS both_a, coalesce(bothsq_n, 0) AS bothsq_n, coalesce(bothsq_a, 0) AS bothsq_a,
         coalesce(a.sum_n, 0) + coalesce(b.sum_n, 0) AS sum_n, coalesce(a.sum_a, 0) + coalesce(b.sum_a, 0) AS sum_a, coalesce(a.square_n, 0) * coalesce(b.square_n, 0) AS square_n, coalesce(a.square_a, 0) * coalesce(b.square_a, 0) AS square_a
  FROM pairs JOIN norm AS p ON p.entity_id = s1_id JOIN norm AS q ON q.entity_id = target_id
  LEFT JOIN totals AS a ON a.entity_id = s1_id LEFT JOIN totals AS b ON b.entity_id = target_id LEFT JOIN shared ON shared.s1_id = pairs.s1_id AND shared.target_id = pairs.target_id
)"""

W = Weights()
A_WJAC = f"CASE WHEN {common('p_addr', 'q_addr')} > 0 AND sum_a - both_a > 0 THEN both_a / (sum_a - both_a) ELSE 0.0::DOUBLE END"
N_WJAC = f"CASE WHEN {common('p_nc', 'q_nc')} > 0 AND sum_n - both_n > 0 THEN both_n / (sum_n - both_n) ELSE 0.0::DOUBLE END"
SCORED = f"""
gated AS MATERIALIZED (
  SELECT * FROM (SELECT *, {jaccard("p_nc", "q_nc")} AS jn, {jaccard("p_addr", "q_addr")} AS ja FROM joined) WHERE jn >= {GATE} OR ja >= {GATE}
), spelled AS MATERIALIZED (
  SELECT *, {chars("p_nsq")} AS p_nch, {chars("q_nsq")} AS q_nch, {chars("array_to_string(p_addr, ' ')")} AS p_ach, {chars("array_to_string(q_addr, ' ')")} AS q_ach FROM gated
), gram AS MATERIALIZED (
  SELECT *, {grams("p_nch")} AS p_ng, {grams("q_nch")} AS q_ng, {grams("p_ach")} AS p_ag, {grams("q_ach")} AS q_ag FROM spelled
), alike AS MATERIALIZED (
  SELECT *, {N_WJAC} AS n_wjac, {containment("p_nd", "q_nd")} AS nd_cont, {dice("p_ng", "q_ng")} AS n_gram_dice, {A_WJAC} AS a_wjac, {dice("p_ag", "q_ag")} AS a_gram_dice,
         {containment("p_num", "q_num")} AS num_score, len(p_num) > 0 AND len(q_num) > 0 AS has_num, len(p_addr) > 0 AND len(q_addr) > 0 AS has_addr FROM gram
), scored AS MATERIALIZED (
  SELECT *, round((CASE WHEN has_addr THEN {W.addr}::DOUBLE * ({W.addr_idf}::DOUBLE * a_wjac + {W.addr_grams}::DOUBLE * a_gram_dice) ELSE 0 END + CASE WHEN has_num THEN {W.num}::DOUBLE * num_score ELSE 0 END
         + {W.name}::DOUBLE * ({W.name_idf}::DOUBLE * n_wjac + {W.name_contained}::DOUBLE * nd_cont + {W.name_grams}::DOUBLE * n_gram_dice))
         / (CASE WHEN has_addr THEN {W.addr}::DOUBLE ELSE 0 END + CASE WHEN has_num THEN {W.num}::DOUBLE ELSE 0 END + {W.name}::DOUBLE)
         * [{", ".join(f"{x}::DOUBLE" for x in W.trust)}][2 + CASE WHEN has_addr THEN 2 ELSE 0 END + CASE WHEN has_num THEN 4 ELSE 0 END], 6) AS score FROM alike
), ranked AS MATERIALIZED (
  SELECT *, score AS prob FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, target_id) AS rank FROM scored WHERE score >= {PREFILTER}) WHERE rank <= {TOP_K}
)"""

TRUTH = f"""
named AS MATERIALIZED (
  SELECT entity_id, country, {fold("business_name")} AS name FROM records
), truth AS MATERIALIZED (
  SELECT a.entity_id AS s1_id, a.country, coalesce(b.matched, []) AS matched FROM named AS a
  LEFT JOIN (SELECT country, name, list_sort(list(entity_id)) AS matched FROM named WHERE entity_id NOT LIKE 'S1-%' AND length(name) >= 20 GROUP BY country, name) AS b USING (country, name)
  WHERE a.entity_id LIKE 'S1-%'
), links AS MATERIALIZED (
  SELECT s1_id, unnest(list_distinct(matched)) AS target_id FROM truth
)"""

F_BETA = "CASE WHEN t = 0 THEN CASE WHEN p = 0 THEN 1.0 ELSE 0.0 END WHEN p = 0 OR tp = 0 THEN 0.0 ELSE 1.25::DOUBLE * tp / (0.25::DOUBLE * t + p) END::DOUBLE"
ENTITY = f"""
picked AS MATERIALIZED (
  SELECT s1_id, list_sort(list(target_id)) AS ids FROM ranked WHERE score >= 0.5 GROUP BY s1_id
), entity AS MATERIALIZED (
  SELECT *, {F_BETA} AS f FROM (
    SELECT t.s1_id, CASE WHEN t.country = '' THEN '?' ELSE t.country END AS country, len(list_intersect(coalesce(ids, []), matched)) AS tp, len(coalesce(ids, [])) AS p, len(matched) AS t FROM truth AS t LEFT JOIN picked USING (s1_id))
)"""

#: Distributions of the number of true matches among the first and the other candidates, then the expected score of
#: each size.
EXPECTED = """
placed AS MATERIALIZED (
  SELECT s1_id, target_id, prob, row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, rank, target_id) AS place FROM ranked QUALIFY place <= 24
), sized AS MATERIALIZED (
  SELECT s1_id, list(prob ORDER BY place) AS ps, count(*) AS k FROM placed GROUP BY s1_id
), front AS (
  SELECT s1_id, ps, k, 0 AS n, [1.0::DOUBLE] AS d FROM sized
  UNION ALL
  SELECT s1_id, ps, k, n + 1, list_transform(range(1, len(d) + 2), lambda i: coalesce(d[i], 0) * (1 - ps[n + 1]) + CASE WHEN i > 1 THEN d[i - 1] * ps[n + 1] ELSE 0 END) FROM front WHERE n < k
), back AS (
  SELECT s1_id, ps, k, k AS n, [1.0::DOUBLE] AS d FROM sized
  UNION ALL
  SELECT s1_id, ps, k, n - 1, list_transform(range(1, len(d) + 2), lambda i: coalesce(d[i], 0) * (1 - ps[n]) + CASE WHEN i > 1 THEN d[i - 1] * ps[n] ELSE 0 END) FROM back WHERE n > 0
), terms AS (
  SELECT f.s1_id, f.n, unnest(range(0, len(f.d))) AS a, f.d AS fd, b.d AS bd FROM front AS f JOIN back AS b ON f.s1_id = b.s1_id AND f.n = b.n
), cells AS (
  SELECT s1_id, n, a, fd[a + 1] AS pa, unnest(range(0, len(bd))) AS b, bd FROM terms
), curve AS (
  SELECT s1_id, n, round(CASE WHEN n = 0 THEN max(bd[1]) ELSE sum(1.25::DOUBLE * pa * bd[b + 1] * a / CASE WHEN n = 0 THEN 1 ELSE 0.25::DOUBLE * (a + b) + n END) END, 12) AS e FROM cells GROUP BY s1_id, n
), size_of AS MATERIALIZED (
  SELECT s1_id, n FROM curve QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY e DESC, n) = 1
), selected AS MATERIALIZED (
  SELECT p.s1_id, p.target_id, p.prob FROM placed AS p JOIN size_of AS z ON z.s1_id = p.s1_id AND p.place <= z.n
)"""


def chain(body: str, *parts: str) -> str:
    return "WITH RECURSIVE" + ",".join(parts) + "\n" + body


def sql() -> dict[str, str]:
    to_pairs = (DOCUMENTS, NORM, STATS, keys(), pairs())
    to_joined = (*to_pairs, TOTALS)
    to_ranked = (*to_joined, SCORED)
    to_truth = (*to_ranked, TRUTH)
    both = lambda n, a: f"SELECT s1_id, target_id, round({n}, 6) AS name_sim, round({a}, 6) AS addr_sim FROM joined"
    text = lambda x: f"array_to_string({x}, ' ')"
    sim = {
        "n_jac": jaccard("p_nc", "q_nc"), "n_dice": dice("p_nc", "q_nc"), "n_cont": containment("p_nc", "q_nc"), "n_wjac": "n_wjac", "n_gram_dice": "n_gram_dice", "n_gram_jac": jaccard("p_ng", "q_ng"),
        "nd_jac": jaccard("p_nd", "q_nd"), "nd_cont": "nd_cont", "a_jac": jaccard("p_addr", "q_addr"), "a_dice": dice("p_addr", "q_addr"), "a_cont": containment("p_addr", "q_addr"), "a_wjac": "a_wjac",
        "a_gram_dice": "a_gram_dice", "a_gram_jac": jaccard("p_ag", "q_ag"), "num_score": "num_score", "num_both_present": "has_num::INT::DOUBLE", "num_disagree": "(has_num AND num_score = 0)::INT::DOUBLE",
        "has_name_ev": "1.0::DOUBLE", "has_addr_ev": "has_addr::INT::DOUBLE", "target_latin": "1.0::DOUBLE", "n1_len": "len(p_nc)::DOUBLE", "n2_len": "len(q_nc)::DOUBLE", "a1_len": "len(p_addr)::DOUBLE", "a2_len": "len(q_addr)::DOUBLE",
        "len_ratio_name": ratio("least(len(p_nc), len(q_nc))::DOUBLE", "CASE WHEN least(len(p_nc), len(q_nc)) > 0 THEN greatest(len(p_nc), len(q_nc)) ELSE 0 END"),
        "len_ratio_addr": ratio("least(len(p_addr), len(q_addr))::DOUBLE", "CASE WHEN least(len(p_addr), len(q_addr)) > 0 THEN greatest(len(p_addr), len(q_addr)) ELSE 0 END"),
        "is_s3": "(substr(target_id, 2, 1) = '3')::INT::DOUBLE", "emb_cos": "0.0::DOUBLE", "emb_present": "0.0::DOUBLE",
    }
    rival = "list_distinct(list_concat(x.nc, x.addr_toks))", "list_distinct(list_concat(y.nc, y.addr_toks))"
    rule = lambda name, cond: f"SELECT '{name}' AS rule, 'error' AS severity, s1_id AS x FROM good WHERE {cond}"
    script = "CASE " + " ".join(f"WHEN c BETWEEN {lo} AND {hi} THEN '{n}'" for n, lo, hi in SCRIPTS) + " ELSE 'Latin' END"
    span = "".join(f"\\x{{{lo:04X}}}-\\x{{{hi:04X}}}" for _, lo, hi in SCRIPTS)
    thresholds = ", ".join(f"{x / 100}::DOUBLE" for x in range(34, 91, 2))
    return {
        "norm_fold": chain(f"SELECT entity_id, {fold('business_name')} AS name_fold, {fold('business_address')} AS address_fold FROM records", DOCUMENTS),
        "norm_squash": chain("SELECT entity_id, squashed, CASE WHEN length(short) >= 4 THEN short ELSE squashed END AS name_squash FROM ordered", DOCUMENTS, NORM),
        "norm_name_core": chain(f"SELECT entity_id, {text('nt')} AS name_tokens, {text('core')} AS core, {text('distinctive')} AS distinctive FROM ordered", DOCUMENTS, NORM),
        "norm_addr_tokens": chain(f"SELECT entity_id, {text('addr_list')} AS addr_tokens FROM ordered", "\nfirst AS (SELECT * FROM (" + DOCUMENTS.split("(", 1)[1].rsplit(")", 1)[0] + "))", "\nsecond AS (SELECT * FROM (" + PARTS.split("(", 1)[1].rsplit(")", 1)[0] + "))", "\nrecords AS (SELECT * FROM first UNION ALL SELECT 'P' || entity_id, business_name, business_address, country FROM second)", NORM.split("), norm AS")[0] + ")"),
        "norm_numeric_tokens": chain(f"SELECT entity_id, {text('numbers')} AS numbers FROM norm", DOCUMENTS, NORM),
        "norm_trigrams": chain(f"SELECT entity_id, len({grams('nch')}) AS n_name_grams, {text('list_sort(' + grams('nch') + ')')} AS name_grams, len({grams('ach')}) AS n_address_grams FROM spelled", DOCUMENTS, NORM, f"\nspelled AS MATERIALIZED (SELECT entity_id, {chars('nsq')} AS nch, {chars(text('addr_toks'))} AS ach FROM norm)"),
        "norm_script": chain(f"SELECT script, script = 'Latin' AS latin, count(*) AS n_records FROM (SELECT {script} AS script FROM (SELECT coalesce(unicode(nullif(regexp_extract(business_name, '[{span}]'), '')), 0) AS c FROM records)) GROUP BY script", DOCUMENTS),
        "source_counts": chain("SELECT country, count(*) AS n_records FROM records GROUP BY country", DOCUMENTS),
        "truth_explode": chain("SELECT s1_id, target_id FROM links", DOCUMENTS, TRUTH),
        "corpus_df": chain("SELECT channel, token, df FROM df", DOCUMENTS, NORM, STATS),
        "corpus_idf": chain("SELECT channel, token, round(ln(n_docs / (df + 1)), 9) AS idf, round(ln(n_docs), 9) AS unseen FROM df, n", DOCUMENTS, NORM, STATS),
        "rare_tokens": chain("SELECT entity_id, coalesce(string_agg(token, ' ' ORDER BY r) FILTER (channel = 'n'), '') AS rare_name, coalesce(string_agg(token, ' ' ORDER BY r) FILTER (channel = 'a'), '') AS rare_address FROM norm LEFT JOIN rare USING (entity_id) GROUP BY entity_id", DOCUMENTS, NORM, STATS),
        "blocking_keys": chain("SELECT * FROM blocking", DOCUMENTS, NORM, STATS, keys()),
        "posting_cap": chain("SELECT * FROM posting", DOCUMENTS, NORM, STATS, keys(3), pairs(20)),
        "posting_cap_chunked": chain("SELECT country, family, t1, t2, s1_id FROM (SELECT *, entity_id AS s1_id, count(*) OVER (PARTITION BY country, family, t1, t2, CAST(regexp_extract(entity_id, '[0-9]+$') AS BIGINT) % 4) AS size FROM blocking WHERE source = 1) WHERE size <= 20", DOCUMENTS, NORM, STATS, keys(3)),
        "candidate_pairs": chain("SELECT s1_id, target_id, round(jn, 9) AS jn, round(ja, 9) AS ja FROM gated", *to_joined, SCORED.split("), spelled AS")[0] + ")"),
        "candidate_pairs_skewed": chain("SELECT * FROM pairs", PARTS, NORM, STATS, keys(3), pairs(20)),
        "blocking_stats": chain("SELECT family, count(*) FILTER (size <= 200) AS n_keys, count(*) FILTER (size > 200) AS dropped_keys, CAST(coalesce(sum(size) FILTER (size <= 200), 0) AS BIGINT) AS postings FROM (SELECT country, family, t1, t2, count(*) AS size FROM blocking WHERE source = 1 GROUP BY ALL) GROUP BY family", DOCUMENTS, NORM, STATS, keys()),
        "run_statistics": chain('SELECT (SELECT count(*) FROM norm WHERE source = 1) AS "references", (SELECT count(*) FROM norm WHERE source <> 1) AS scanned, (SELECT count(*) FROM joined) AS considered, (SELECT count(*) FROM gated) AS passed, (SELECT count(*) FROM ranked) AS kept', *to_ranked),
        "pair_jaccard": chain(both(jaccard("p_nc", "q_nc"), jaccard("p_addr", "q_addr")), *to_joined),
        "pair_dice": chain(both(dice("p_nc", "q_nc"), dice("p_addr", "q_addr")), *to_joined),
        "pair_containment": chain(both(containment("p_nc", "q_nc"), containment("p_addr", "q_addr")), *to_joined),
        "pair_weighted_jaccard": chain(both(N_WJAC, A_WJAC), *to_joined),
        "pair_idf_cosine": chain(both("CASE WHEN square_n > 0 THEN bothsq_n / sqrt(square_n) ELSE 0 END", "CASE WHEN square_a > 0 THEN bothsq_a / sqrt(square_a) ELSE 0 END"), *to_joined),
        "pair_numeric": chain(f"SELECT s1_id, target_id, round({containment('p_num', 'q_num')}, 6) AS num_score, len(p_num) > 0 AND len(q_num) > 0 AS has_num FROM joined", *to_joined),
        "embedding_cosine_topk": chain("""SELECT s1_id, target_id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY cosine DESC, target_id) AS rank FROM (
  SELECT s1_id, target_id, round(greatest(-1.0, least(1.0, list_sum(list_transform(range(1, 65), lambda i: x.embedding[i]::DOUBLE * y.embedding[i]::DOUBLE)))), 5) AS cosine
  FROM pairs JOIN embeddings AS x ON s1_id = 'S' || (x.vec_id % 3 + 1) || '-' || x.vec_id JOIN embeddings AS y ON target_id = 'S' || (y.vec_id % 3 + 1) || '-' || y.vec_id)) WHERE rank <= 5""", *to_pairs),
        "rule_score": chain("SELECT s1_id, target_id, score FROM scored", *to_ranked),
        "prefilter_topk": chain("SELECT s1_id, target_id, score, rank FROM ranked", *to_ranked),
        "threshold_select": chain("SELECT s1_id, target_id, score, rank FROM ranked WHERE score >= 0.5 AND rank <= 3", *to_ranked),
        "threshold_sweep": chain(f"""SELECT threshold, macro_f, threshold = first_value(threshold) OVER (ORDER BY macro_f DESC, threshold) AS best FROM (
  SELECT threshold, round(avg(f), 9) AS macro_f FROM (SELECT threshold, {F_BETA} AS f FROM (
    SELECT threshold, t.s1_id, len(any_value(matched)) AS t, count(r.target_id) AS p, count(l.target_id) AS tp
    FROM truth AS t CROSS JOIN (SELECT unnest([{thresholds}]) AS threshold) AS h LEFT JOIN ranked AS r ON r.s1_id = t.s1_id AND r.score >= h.threshold
    LEFT JOIN links AS l ON l.s1_id = r.s1_id AND l.target_id = r.target_id GROUP BY threshold, t.s1_id)) GROUP BY threshold)""", *to_truth),
        "pair_features": chain("SELECT s1_id, target_id, " + ", ".join(f"round({sim[c]}, 6) AS {c}" for c in features.PAIR) + " FROM ranked", *to_ranked),
        "cross_source_features": chain(f"""SELECT r.s1_id, r.target_id, round(coalesce(xs_max_opp, 0), 6) AS xs_max_opp, round(coalesce(xs_mean_opp, 0), 6) AS xs_mean_opp, round(coalesce(xs_n_opp_strong, 0), 6)::DOUBLE AS xs_n_opp_strong, round(coalesce(xs_max_same, 0), 6) AS xs_max_same FROM ranked AS r LEFT JOIN (
  SELECT s1_id, target_id, max(sim) FILTER (opp) AS xs_max_opp, avg(sim) FILTER (opp) AS xs_mean_opp, count(*) FILTER (opp AND sim >= 0.5) AS xs_n_opp_strong, max(sim) FILTER (NOT opp) AS xs_max_same FROM (
    SELECT a.s1_id, a.target_id, substr(a.target_id, 2, 1) <> substr(b.target_id, 2, 1) AS opp, {jaccard(*rival)} AS sim
    FROM ranked AS a JOIN ranked AS b ON a.s1_id = b.s1_id AND a.target_id <> b.target_id JOIN norm AS x ON x.entity_id = a.target_id JOIN norm AS y ON y.entity_id = b.target_id) GROUP BY ALL) AS c ON c.s1_id = r.s1_id AND c.target_id = r.target_id""", *to_ranked),
        "rank_features": chain("""SELECT s1_id, target_id, score AS base_score, (row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, target_id) - 1)::DOUBLE AS rank, round(max(score) OVER w - score, 6) AS score_gap_top,
  round(CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE 0 END, 6) AS score_ratio_top, (count(*) OVER w)::DOUBLE AS n_candidates, round(score - avg(score) OVER w, 6) AS base_minus_mean FROM ranked WINDOW w AS (PARTITION BY s1_id)""", *to_ranked),
        "ratio_select": chain("""SELECT s1_id, CASE WHEN top > none THEN top_n ELSE 0 END::INT AS n_best, CASE WHEN top > none THEN top ELSE none END AS best FROM (
  SELECT s1_id, round(product(1 - prob), 9) AS none, max(f) AS top, min(n) FILTER (f = best_f) AS top_n FROM (
    SELECT *, max(f) OVER (PARTITION BY s1_id) AS best_f FROM (
      SELECT s1_id, prob, row_number() OVER o AS n, round(1.25::DOUBLE * sum(prob) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / (0.25::DOUBLE * sum(prob) OVER (PARTITION BY s1_id) + row_number() OVER o), 9) AS f
      FROM (SELECT * FROM ranked WHERE rank <= 24) WINDOW o AS (PARTITION BY s1_id ORDER BY prob DESC, rank, target_id))) GROUP BY s1_id)""", *to_ranked),
        "expected_f_select": chain("SELECT * FROM selected", *to_ranked, EXPECTED),
        "assignment_first_pass": chain("SELECT s1_id, target_id FROM selected QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY prob DESC, s1_id) > 1", *to_ranked, EXPECTED),
        "claim_counts": chain("SELECT target_id, count(*) AS n_claims FROM selected GROUP BY target_id", *to_ranked, EXPECTED),
        "macro_f": chain("SELECT coalesce(round(avg(f), 9), 0.0) AS macro_f FROM entity", *to_truth, ENTITY),
        "breakdown_by_country": chain("""SELECT country, count(*) AS entities, round(avg(f), 9) AS macro_f, CASE WHEN sum(p) > 0 THEN round(sum(tp) / sum(p), 9) ELSE 0 END AS micro_precision, CASE WHEN sum(t) > 0 THEN round(sum(tp) / sum(t), 9) ELSE 0 END AS micro_recall,
  CAST(sum(p) AS BIGINT) AS links_predicted, CAST(sum(t) AS BIGINT) AS links_true, count(*) FILTER (t = 0) AS singletons, count(*) FILTER (t = 0 AND p = 0) AS singletons_empty FROM entity GROUP BY GROUPING SETS ((), (country))""", *to_truth, ENTITY),
        "candidate_recall": chain("SELECT *, CASE WHEN true_links > 0 THEN round(found_links / true_links, 9) ELSE 0 END AS recall FROM (SELECT count(*) AS true_links, count(p.target_id) AS found_links FROM links LEFT JOIN pairs AS p USING (s1_id, target_id))", *to_truth),
        "oracle_score": chain(f"SELECT coalesce(round(avg(f), 9), 0.0) AS oracle_f FROM (SELECT {F_BETA} AS f FROM (SELECT t.s1_id, len(any_value(matched)) AS t, count(p.target_id) AS p, count(p.target_id) AS tp FROM truth AS t LEFT JOIN links AS l ON l.s1_id = t.s1_id LEFT JOIN pairs AS p ON p.s1_id = l.s1_id AND p.target_id = l.target_id GROUP BY t.s1_id))", *to_truth),
        "id_lists": chain("SELECT CAST(regexp_extract(t.s1_id, '[0-9]+$') AS BIGINT) AS ordinal, t.s1_id || chr(9) || coalesce(array_to_string(ids, ','), '') AS line FROM truth AS t LEFT JOIN picked USING (s1_id)", *to_truth, ENTITY),
        "validate_candidates": """
WITH good AS (
  SELECT 'S1-' || o_orderkey AS x, o_orderkey % 89 = 0 AS repeated, o_orderkey % 7 = 0 AS outside FROM orders
), found AS (
  SELECT 'repeated_id' AS rule, x FROM good WHERE repeated UNION ALL SELECT 'not_a_candidate', x FROM good WHERE outside
  UNION ALL SELECT 'duplicate_row', x FROM good GROUP BY x HAVING count(*) > 1
), counted AS (
  SELECT rule, count(*) AS offenders FROM found GROUP BY rule
), least AS (
  SELECT rule, string_agg(x, ',' ORDER BY x) AS examples FROM (SELECT rule, x, row_number() OVER (PARTITION BY rule ORDER BY x) AS r FROM (SELECT DISTINCT rule, x FROM found)) WHERE r <= 5 GROUP BY rule
)
SELECT rule, severity, coalesce(offenders, 0) AS offenders, coalesce(examples, '') AS examples, NOT EXISTS (SELECT 1 FROM counted WHERE rule <> 'not_a_candidate' AND offenders > 0) AS passed
FROM (VALUES ('malformed', 'error'), ('duplicate_row', 'error'), ('repeated_id', 'error'), ('self_match', 'error'), ('prefix', 'error'), ('missing', 'error'), ('unexpected', 'error'), ('not_a_candidate', 'warning')) AS rules(rule, severity)
LEFT JOIN counted USING (rule) LEFT JOIN least USING (rule)""",
        "id_predicates": chain("SELECT entity_id, number % 10 = 0 AS holdout, number % 2 = 0 AND (number // 2) % 3 = 1 AS in_chunk FROM (SELECT entity_id, CAST(regexp_extract(entity_id, '[0-9]+$') AS BIGINT) AS number FROM records)", DOCUMENTS),
        "truth_file": chain("SELECT s1_id, target_id FROM links", DOCUMENTS, TRUTH),
        "model_split": """
SELECT s1_id, CASE WHEN h < 6 THEN 'train' WHEN h < 8 THEN 'calibrate' ELSE 'test' END AS part, CAST(quality AS INT) AS label
FROM (SELECT 'S1-' || doc_id AS s1_id, quality, CAST('0x' || substr(md5('S1-' || doc_id || '|42'), 1, 8) AS BIGINT) % 10 AS h FROM labels)""",
        "validate_output": f"""
WITH lines AS (
  SELECT CASE WHEN o_orderkey % 101 = 0 THEN head ELSE head || chr(9) || ids END AS value FROM (
    SELECT o_orderkey, 'S1-' || CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS head,
           concat_ws(',', 'S2-' || o_custkey, CASE WHEN o_orderkey % 89 = 0 THEN 'S2-' || o_custkey END, CASE WHEN o_orderkey % 83 = 0 THEN 'S1-' || o_custkey END, CASE WHEN o_orderkey % 79 = 0 THEN 'X-' || o_custkey END) AS ids FROM orders)
), parsed AS MATERIALIZED (
  SELECT trim(string_split(value, chr(9))[1]) AS s1_id, list_filter(string_split(coalesce(string_split(value, chr(9))[2], ''), ','), lambda x: x <> '') AS ids, instr(value, chr(9)) = 0 AS malformed FROM lines
), good AS (SELECT * FROM parsed WHERE NOT malformed), required AS (SELECT 'S1-' || o_orderkey AS s1_id FROM orders WHERE o_orderkey % 103 <> 0),
used AS (SELECT DISTINCT unnest(ids) AS id FROM good),
found AS (
  SELECT 'malformed' AS rule, 'error' AS severity, s1_id AS x FROM parsed WHERE malformed
  UNION ALL SELECT 'duplicate_row', 'error', s1_id FROM good GROUP BY s1_id HAVING count(*) > 1
  UNION ALL {rule("repeated_id", "len(ids) <> len(list_distinct(ids))")}
  UNION ALL {rule("self_match", "len(list_filter(ids, lambda x: starts_with(x, 'S1-'))) > 0")}
  UNION ALL {rule("prefix", "len(list_filter(ids, lambda x: NOT regexp_matches(x, '^S[123]-'))) > 0")}
  UNION ALL SELECT 'missing', 'error', s1_id FROM (SELECT DISTINCT s1_id FROM required) AS r WHERE s1_id NOT IN (SELECT s1_id FROM good)
  UNION ALL SELECT 'unexpected', 'error', s1_id FROM (SELECT DISTINCT s1_id FROM good) AS g WHERE s1_id NOT IN (SELECT s1_id FROM required)
  UNION ALL SELECT 'unknown_id', 'error', id FROM used WHERE regexp_matches(id, '^S[23]-') AND id NOT IN (SELECT 'S2-' || c_custkey FROM customer WHERE c_custkey % 107 <> 0)
)
SELECT rule, 'error' AS severity, count(x) AS offenders, coalesce(array_to_string(list_sort(list_distinct(list(x) FILTER (x IS NOT NULL)))[1:5], ','), '') AS examples
FROM (VALUES ('malformed'), ('duplicate_row'), ('repeated_id'), ('self_match'), ('prefix'), ('missing'), ('unexpected'), ('unknown_id')) AS r(rule) LEFT JOIN found USING (rule) GROUP BY rule""",
        "embedding_inputs": chain("SELECT entity_id FROM norm WHERE source = 1", DOCUMENTS, NORM),
    }
