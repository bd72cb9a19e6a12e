"""Records that arrive in a stream, matched against a standing pool: candidates per micro-batch.

The pool's keys and weights are a stored table; each micro-batch of normalised S1 records is a plain query against it,
so the stream keeps no state and a lost executor repeats a batch at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillstone.functions.text import normalised
from quillstone.operators import retrieval


class StandingIndex:
    """Postings of a pool (keys with at most max_df records, with their weights), written once."""

    def __init__(self, pool: DataFrame, path: str, p: retrieval.Retrieval | None = None):
        self.p, self.path = p or retrieval.Retrieval(), path
        keys = retrieval.block_keys(pool)
        weights = retrieval.key_weights(keys, pool, self.p)
        weights.write.mode("overwrite").parquet(f"{path}/weights")
        keys.join(weights.select(*retrieval.KEY), retrieval.KEY, "left_semi").write.mode("overwrite").parquet(f"{path}/postings")

    def candidates(self, s1: DataFrame) -> DataFrame:
        read = s1.sparkSession.read
        weights, postings = read.parquet(f"{self.path}/weights"), read.parquet(f"{self.path}/postings")
        own = retrieval.block_keys(s1)
        kept = retrieval.three_channel_top_k(retrieval.with_ranks(retrieval.candidate_scores(own, postings, weights)), self.p)
        return retrieval.with_normalised_scores(kept, retrieval.query_maxima(own, weights))


def match_arrivals(records: DataFrame, index: StandingIndex, out: str, checkpoint: str) -> StreamingQuery:
    """Append the candidates of streamed raw records to a Parquet table, a folder per batch, so a repeated batch replaces
    its own rows."""

    def batch(rows: DataFrame, number: int) -> None:
        index.candidates(normalised(rows)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
