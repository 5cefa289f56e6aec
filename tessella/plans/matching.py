"""The matching plan from source records to chosen links; each step is computed once and kept for the next."""

from __future__ import annotations

import warnings
from functools import cached_property

from pyspark.sql import DataFrame

from tessella.operators import blocking, features, records, scoring
from tessella.operators.assignment import assign
from tessella.sources import tables
from tessella.sources.shared import shared


class Matching:
    """Lazy steps over source records (entity_id, business_name, business_address, country). With `embeddings`
    (entity_id, embedding), unit vectors of names, targets whose names are not Latin are scored by their cosines. With
    `rating`, the statistics (df, n_docs) of another corpus, such as the one a model was trained on, tokens weigh in scores
    and features what they weigh there; keys always follow the statistics of this corpus."""

    def __init__(self, source: DataFrame, how: blocking.Blocking = blocking.Blocking(), sample_every: int = 1, embeddings: DataFrame | None = None, rating: tuple[DataFrame, int] | None = None):
        self.source, self.how, self.sample_every, self.embeddings, self.rating = source, how, sample_every, embeddings, rating
        self.cos = None if embeddings is None else "emb_cos"

    @cached_property
    def norm(self) -> DataFrame:
        return shared(records.normalise(self.source))

    @cached_property
    def stats(self) -> tuple[DataFrame, int]:
        df, n = records.corpus_stats(self.norm, self.sample_every)
        return df, records.document_count(n)

    @cached_property
    def weighed(self) -> DataFrame:
        return shared(records.weigh(self.norm, *self.stats))

    @property
    def n_docs(self) -> int:
        """Records that the weights in scores come from."""
        return (self.rating or self.stats)[1]

    @cached_property
    def rated(self) -> DataFrame:
        """Records with the weights that scores and features use."""
        return self.weighed if self.rating is None else shared(records.weigh(self.norm, *self.rating))

    @cached_property
    def keys(self) -> DataFrame:
        return blocking.keys(self.weighed, self.how)

    @cached_property
    def pairs(self) -> DataFrame:
        return shared(blocking.candidate_pairs(self.keys, self.how))

    def with_cosines(self, pairs: DataFrame) -> DataFrame:
        """`pairs`, with emb_cos if there are embeddings."""
        return pairs if self.cos is None else tables.embedding_cosines(pairs, self.embeddings, self.norm)

    @cached_property
    def joined(self) -> DataFrame:
        return scoring.with_records(self.with_cosines(self.pairs), self.rated)

    @cached_property
    def gated(self) -> DataFrame:
        return scoring.gated(self.joined, cos=self.cos)

    @cached_property
    def scored(self) -> DataFrame:
        """Gated pairs with all their columns and the rounded score."""
        return scoring.rounded(scoring.scored(self.gated, self.n_docs, cos=self.cos))

    @cached_property
    def described(self) -> DataFrame:
        """`ranked` with PAIR, for which a score's pair has met its records already: they are not joined once more."""
        d = features.pair_features(self.scored, self.n_docs, cos=self.cos)
        return shared(scoring.top_k(d.select("s1_id", "target_id", "score", *features.PAIR)))

    @cached_property
    def ranked(self) -> DataFrame:
        """Rows (s1_id, target_id, score, rank): the best candidates of each reference record."""
        if "described" in vars(self):
            return self.described.select("s1_id", "target_id", "score", "rank")
        return shared(scoring.top_k(self.scored.select("s1_id", "target_id", "score")))

    @cached_property
    def featured(self) -> DataFrame:
        """`ranked` candidates with every feature."""
        return features.competition(features.cross_source(self.described.drop("rank"), self.norm))

    def chosen(self, prob: str = "score") -> DataFrame:
        """Rows (s1_id, target_id, prob) after the one-owner assignment; warns if records are still contested."""
        d, passes, left = assign(self.ranked.withColumn("prob", self.ranked[prob]))
        if left:
            warnings.warn(f"{left} records are still claimed twice after {passes} passes", stacklevel=2)
        return d
