"""Matching records as they arrive against the reference source: a stateless stream-static join."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessella.operators import blocking, records, scoring


def match_stream(arriving: DataFrame, reference: DataFrame, df: DataFrame, n_docs: int, sink, how: blocking.Blocking = blocking.Blocking()):
    """Start a query that hands each micro-batch's rows (s1_id, target_id, score, rank) to `sink(rows, batch_id)`.

    `arriving` is a stream of source records, `reference` the static ones; statistics are those of the corpus so far.
    The reference's records (source 1) are indexed once, not in each micro-batch; arriving records are looked up, so those
    of source 1 and static ones of other sources match nothing. Returns the writer; the caller starts it with a trigger
    and a checkpoint location.
    """
    ref = records.weigh(records.normalise(reference), df, n_docs).filter("source = 1").persist()
    index = blocking.postings(blocking.keys(ref, how), how).persist()

    def one(batch: DataFrame, batch_id: int) -> None:
        w = records.weigh(records.normalise(batch), df, n_docs).filter("source <> 1")
        pairs = blocking.probe(blocking.keys(w, how), index)
        hits = scoring.rounded(scoring.scored(scoring.gated(scoring.with_records(pairs, ref.unionByName(w))), n_docs))
        sink(scoring.top_k(hits).select("s1_id", "target_id", "score", "rank"), batch_id)

    return arriving.writeStream.foreachBatch(one)
