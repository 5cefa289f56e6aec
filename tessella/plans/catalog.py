"""Registered queries; their DuckDB equivalents are in `oracle`."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import similarity as S
from tessella.functions import text as T
from tessella.operators import assignment, blocking, features, metrics, model, records, scoring, selection, validate
from tessella.plans import adapters, oracle
from tessella.plans.matching import Matching
from tessella.sources import tables
from tessella.sources.shared import shared_folder

#: Small caps show what they do on small tables.
CAPPED = blocking.Blocking(df_cap=3, max_posting=20)
THRESHOLDS = tuple(x / 100 for x in range(34, 91, 2))
PICK = 0.5


def matching(spark: SparkSession, sf_dir: str) -> Matching:
    return Matching(adapters.records(spark, sf_dir))


def norm_fold(spark, d):
    r = adapters.records(spark, d)
    return r.select("entity_id", T.fold(F.col("business_name")).alias("name_fold"), T.fold(F.col("business_address")).alias("address_fold"))


def norm_squash(spark, d):
    r = adapters.records(spark, d)
    return r.select("entity_id", T.squash(F.col("business_name")).alias("squashed"), T.name_squash(F.col("business_name")).alias("name_squash"))


def _joined(c: Column) -> Column:
    return F.array_join(c, " ")


def norm_name_core(spark, d):
    r = adapters.records(spark, d)
    n = F.col("business_name")
    return r.select("entity_id", _joined(T.name_tokens(n)).alias("name_tokens"), _joined(T.name_core(n)).alias("core"), _joined(T.name_distinctive(n)).alias("distinctive"))


def norm_addr_tokens(spark, d):
    both = adapters.records(spark, d).unionByName(adapters.part_records(spark, d).withColumn("entity_id", F.concat(F.lit("P"), F.col("entity_id"))))
    return both.select("entity_id", _joined(T.address_tokens(F.col("business_address"), F.col("country"))).alias("addr_tokens"))


def norm_numeric_tokens(spark, d):
    return adapters.records(spark, d).select("entity_id", _joined(T.numeric_tokens(F.col("business_address"))).alias("numbers"))


def norm_trigrams(spark, d):
    n = matching(spark, d).norm
    return n.select("entity_id", F.size(T.ngrams(F.col("nsq"))).cast("bigint").alias("n_name_grams"), _joined(F.array_sort(T.ngrams(F.col("nsq")))).alias("name_grams"), F.size(T.address_grams(F.col("addr_toks"))).cast("bigint").alias("n_address_grams"))


def norm_script(spark, d):
    r = adapters.records(spark, d)
    return r.groupBy(T.script_of(F.col("business_name")).alias("script"), T.is_latin(F.col("business_name")).alias("latin")).agg(F.count("*").alias("n_records"))


def source_counts(spark, d):
    return records.country_counts(adapters.records(spark, d))


def truth_explode(spark, d):
    return metrics.links(adapters.truth(spark, d))


def corpus_df(spark, d):
    return matching(spark, d).stats[0]


def corpus_idf(spark, d):
    df, n = matching(spark, d).stats
    return records.idf(df, n).select("channel", "token", F.round("idf", 9).alias("idf"), F.round(F.log(F.lit(float(n))), 9).alias("unseen"))


def rare_tokens(spark, d):
    w = matching(spark, d).weighed
    return w.select("entity_id", _joined(F.transform("rare_n", lambda x: x["token"])).alias("rare_name"), _joined(F.transform("rare_a", lambda x: x["token"])).alias("rare_address"))


def blocking_keys(spark, d):
    return matching(spark, d).keys


def posting_cap(spark, d):
    m = Matching(adapters.records(spark, d), CAPPED)
    return blocking.postings(m.keys, CAPPED)


def posting_cap_chunked(spark, d):
    m = Matching(adapters.records(spark, d), CAPPED)
    number = F.regexp_extract("entity_id", "([0-9]+)$", 1).cast("bigint")
    k = m.keys.withColumn("chunk", F.when(F.col("source") == 1, F.pmod(number, F.lit(4))))
    return blocking.postings(k, CAPPED, "chunk")


def candidate_pairs(spark, d):
    m = matching(spark, d)
    return m.gated.select("s1_id", "target_id", F.round("jn", 9).alias("jn"), F.round("ja", 9).alias("ja"))


def candidate_pairs_skewed(spark, d):
    """Very frequent names: single tokens are no keys and postings are capped."""
    m = Matching(adapters.part_records(spark, d), CAPPED)
    return m.pairs


def blocking_stats(spark, d):
    return blocking.index_stats(matching(spark, d).keys)


def run_statistics(spark, d):
    m = matching(spark, d)
    gate = scoring.overlaps(m.joined).select(scoring.of(S.jaccard, "in_n", "tag_n").alias("jn"), scoring.of(S.jaccard, "in_a", "tag_a").alias("ja"))
    passed = (F.col("jn") >= scoring.GATE) | (F.col("ja") >= scoring.GATE)
    a = m.norm.agg(F.count_if(F.col("source") == 1).alias("references"), F.count_if(F.col("source") != 1).alias("scanned"))
    b = gate.agg(F.count("*").alias("considered"), F.count_if(passed).alias("passed"))
    c = m.ranked.agg(F.count("*").alias("kept"))
    return a.join(b, F.lit(True)).join(c, F.lit(True))


def _pair_query(name: Callable[[int], Column], addr: Callable[[int], Column]):
    def query(spark, d):
        m = matching(spark, d)
        return scoring.overlaps(m.joined).select("s1_id", "target_id", F.round(name(m.n_docs), 6).alias("name_sim"), F.round(addr(m.n_docs), 6).alias("addr_sim"))

    return query


def _sets(measure):
    return _pair_query(lambda n: scoring.of(measure, "in_n", "tag_n"), lambda n: scoring.of(measure, "in_a", "tag_a"))


def _weights(measure, power: int, total: str, *first: str):
    def one(c: str):
        return lambda n: measure(*(F.col(f"{x}_{c}") for x in first), S.weight_sum(F.col(f"in_{c}"), n, power), F.col(f"p_{total}_{c}"), F.col(f"q_{total}_{c}"))

    return _pair_query(one("n"), one("a"))


pair_jaccard, pair_dice, pair_containment = _sets(S.jaccard), _sets(S.dice), _sets(S.containment)
pair_weighted_jaccard = _weights(S.weighted_jaccard, 1, "sum", "in")
pair_idf_cosine = _weights(S.idf_cosine, 2, "square")


def pair_numeric(spark, d):
    n = S.numeric_agreement(F.col("p_numbers"), F.col("q_numbers"))
    return matching(spark, d).joined.select("s1_id", "target_id", F.round(n["score"], 6).alias("num_score"), n["evidence"].alias("has_num"))


def embedding_cosine_topk(spark, d):
    e = adapters.embeddings(spark, d)
    p = matching(spark, d).pairs.join(e.select(F.col("entity_id").alias("s1_id"), F.col("embedding").alias("ea")), "s1_id").join(e.select(F.col("entity_id").alias("target_id"), F.col("embedding").alias("eb")), "target_id")
    c = p.select("s1_id", "target_id", F.round(S.cosine(F.col("ea"), F.col("eb")), 5).alias("score"))
    return scoring.top_k(c, 5, None).select("s1_id", "target_id", F.col("score").alias("cosine"), F.col("rank").cast("bigint").alias("rank"))


def rule_score(spark, d):
    return matching(spark, d).scored.select("s1_id", "target_id", "score")


def prefilter_topk(spark, d):
    return matching(spark, d).ranked.select("s1_id", "target_id", "score", F.col("rank").cast("bigint").alias("rank"))


def threshold_select(spark, d):
    return scoring.threshold_select(matching(spark, d).ranked, PICK, 3).select("s1_id", "target_id", "score", F.col("rank").cast("bigint").alias("rank"))


def threshold_sweep(spark, d):
    return scoring.sweep(matching(spark, d).ranked, adapters.truth(spark, d), THRESHOLDS)


def _rounded(df: DataFrame, names) -> DataFrame:
    return df.select("s1_id", "target_id", *(F.round(c, 6).alias(c) for c in names))


def pair_features(spark, d):
    m = matching(spark, d)
    return _rounded(features.pair_features(scoring.with_records(m.ranked.select("s1_id", "target_id"), m.rated), m.n_docs), features.PAIR)


def cross_source_features(spark, d):
    m = matching(spark, d)
    return _rounded(features.cross_source(m.ranked, m.norm), features.CROSS)


def rank_features(spark, d):
    return _rounded(features.competition(matching(spark, d).ranked), features.RANK)


def with_prob(m: Matching) -> DataFrame:
    """The rule score stands for a probability where no model is asked for."""
    return m.ranked.withColumn("prob", F.col("score"))


def ratio_select(spark, d):
    return selection.ratio_counts(with_prob(matching(spark, d)))


def expected_f_select(spark, d):
    return selection.expected_select(with_prob(matching(spark, d))).select("s1_id", "target_id", "prob")


def assignment_first_pass(spark, d):
    return assignment.lost(selection.expected_select(with_prob(matching(spark, d))))


def claim_counts(spark, d):
    return assignment.claims(selection.expected_select(with_prob(matching(spark, d))))


def assignment_fixpoint(spark, d):
    return matching(spark, d).chosen().select("s1_id", "target_id", "prob")


def _picked(m: Matching) -> DataFrame:
    return metrics.as_lists(scoring.threshold_select(m.ranked, PICK))


def macro_f(spark, d):
    return metrics.macro_f(adapters.truth(spark, d), _picked(matching(spark, d)))


def breakdown_by_country(spark, d):
    return metrics.breakdown(adapters.truth(spark, d), _picked(matching(spark, d)))


def candidate_recall(spark, d):
    return metrics.candidate_recall(adapters.truth(spark, d), matching(spark, d).pairs)


def oracle_score(spark, d):
    return metrics.oracle_score(adapters.truth(spark, d), matching(spark, d).pairs)


def id_lists(spark, d):
    """Output lines, one for each reference record, empty lists among them."""
    s1 = adapters.records(spark, d).filter("entity_id like 'S1-%'").withColumn("ordinal", F.regexp_extract("entity_id", "([0-9]+)$", 1).cast("bigint"))
    done = tables.complete(s1, _picked(matching(spark, d)))
    return done.select("ordinal", F.concat("s1_id", F.lit("\t"), F.array_join("ids", ",")).alias("line"))


def validate_output(spark, d):
    """Damaged lines made from `orders`: repeated rows and ids, foreign prefixes, self-matches, lines without a tab."""
    o = adapters.table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    head = F.concat(F.lit("S1-"), F.when(k % 97 == 0, k - 1).otherwise(k).cast("string"))
    ids = F.concat_ws(",", F.concat(F.lit("S2-"), c.cast("string")), F.when(k % 89 == 0, F.concat(F.lit("S2-"), c.cast("string"))), F.when(k % 83 == 0, F.concat(F.lit("S1-"), c.cast("string"))), F.when(k % 79 == 0, F.concat(F.lit("X-"), c.cast("string"))))
    lines = o.select(F.when(k % 101 == 0, head).otherwise(F.concat(head, F.lit("\t"), ids)).alias("value"))
    required = o.filter(k % 103 != 0).select(F.concat(F.lit("S1-"), k.cast("string")).alias("s1_id"))
    known = adapters.table(spark, d, "customer").filter(F.col("c_custkey") % 107 != 0).select(F.concat(F.lit("S2-"), F.col("c_custkey").cast("string")).alias("target_id"))
    return validate.validate(validate.parse(lines), required, known)


def validate_candidates(spark, d):
    """Every rule without known ids, with candidate lists, and the verdict: lists made from `orders`, some of which repeat
    an id and some of which name no candidate."""
    o = adapters.table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.concat(F.lit("S2-"), F.col("o_custkey").cast("string"))
    s1 = F.concat(F.lit("S1-"), k.cast("string"))
    lines = o.select(F.concat(s1, F.lit("\t"), F.concat_ws(",", c, F.when(k % 89 == 0, c))).alias("value"))
    allowed = o.select(s1.alias("s1_id"), F.array(F.when(k % 7 == 0, F.lit("S2-none")).otherwise(c)).alias("ids"))
    report = validate.validate(validate.parse(lines), o.select(s1.alias("s1_id")), candidates=allowed)
    return report.withColumn("passed", F.lit(validate.passed(report)))


def id_predicates(spark, d):
    """The holdout predicate, and the second of three chunks among every other id."""
    number = F.regexp_extract("entity_id", "([0-9]+)$", 1).try_cast("bigint")
    return adapters.records(spark, d).select("entity_id", records.keep_every(number, 10).alias("holdout"), records.chunk_of(number, 1, 3, 2).alias("in_chunk"))


def truth_file(spark, d):
    """The truth written as a file of id lists and read again."""
    t = adapters.truth(spark, d).select("s1_id", F.col("matched").alias("ids"), F.regexp_extract("s1_id", "([0-9]+)$", 1).cast("bigint").alias("ordinal"))
    where = f"{shared_folder(spark)}/truth-{uuid.uuid4().hex}"
    tables.write_id_lists(t, where, single_file=True)
    return metrics.links(tables.read_truth(spark, where))


def embedding_inputs(spark, d):
    return tables.embedding_inputs(matching(spark, d).norm, all_targets=False)


def model_split(spark, d):
    """Parts of an entity-disjoint split, with labels of `labels` counted in each."""
    e = adapters.table(spark, d, "labels").select(F.concat(F.lit("S1-"), F.col("doc_id").cast("string")).alias("s1_id"), "quality")
    return model.split(e).select("s1_id", "part", F.col("quality").cast("int").alias("label"))


def labelled(spark, d):
    """Candidates with every feature, labelled by the silver truth, and their parts."""
    m = matching(spark, d)
    return model.split(model.label(m.featured, adapters.linked(m.described, spark, d)))


def gbt_scores(spark, d):
    """Probabilities of boosted trees, learned from the silver truth."""
    data = labelled(spark, d).persist()
    fitted = model.train(data)
    return model.apply(fitted, data).select("s1_id", "target_id", "part", "label", F.round(F.col("prob").cast("double"), 6).alias("prob"))


NAMES = (
    norm_fold, norm_squash, norm_name_core, norm_addr_tokens, norm_numeric_tokens, norm_trigrams, norm_script,
    source_counts, truth_explode, corpus_df, corpus_idf, rare_tokens,
    blocking_keys, posting_cap, posting_cap_chunked, candidate_pairs, candidate_pairs_skewed, blocking_stats, run_statistics,
    pair_numeric, embedding_cosine_topk, rule_score, prefilter_topk, threshold_select, threshold_sweep,
    pair_features, cross_source_features, rank_features, ratio_select, expected_f_select, assignment_first_pass,
    claim_counts, assignment_fixpoint, macro_f, breakdown_by_country, candidate_recall, oracle_score, id_lists,
    validate_output, validate_candidates, id_predicates, truth_file, embedding_inputs, model_split, gbt_scores,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in NAMES} | {
        "pair_jaccard": pair_jaccard,
        "pair_dice": pair_dice,
        "pair_containment": pair_containment,
        "pair_weighted_jaccard": pair_weighted_jaccard,
        "pair_idf_cosine": pair_idf_cosine,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
