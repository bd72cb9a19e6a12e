"""The re-ranker over wide pairs that no table holds: they are made for its sample, for its training, and for its scores."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators import boost
from quillstone.operators.retrieval import Retrieval
from quillstone.operators.wide import INPUTS, Wide
from quillstone.sources.tables import dropped, settled

COUNTS = ("brank", "brank_name", "brank_addr", "r_hn_eq")
KEPT = ", ".join(["s1_id string", "cand_id string", *[f"{c} {'long' if c in COUNTS else 'double'}" for c in INPUTS], "label int", "rr double", "rr_rank long"])
SAMPLE = 100  # S1 records that the thresholds are taken from, some 40,000 pairs; Spark's trees take 10,000


def _sampled(ids, cands, row, cand, x, label) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(boost.ready(x, INPUTS)).tobytes()], pa.binary())], names=["x"])


def trained(wide: Wide, learning: Column, rounds: int = 15, depth: int = 4) -> boost.Boosted:
    """On all pairs of the S1 that the condition on entity_id picks."""
    n = wide.s1.filter(learning).count()
    few = learning & (F.pmod(F.xxhash64("entity_id"), F.lit(max(1, n // SAMPLE))) == 0)
    rows = [np.frombuffer(bytes(r.x)) for d in wide.run(_sampled, "x binary", few) for r in d.collect()]
    width = len(boost.ready(np.zeros((len(INPUTS), 1)), INPUTS))
    cuts = boost.edges(np.hstack([np.zeros((width, 0)), *[r.reshape(width, -1) for r in rows]]))

    def binned(ids, cands, row, cand, x, label) -> pa.RecordBatch:
        return boost.block(boost.ready(x, INPUTS), label, cuts)

    parts = [settled(d, "wide-bins", "zstd") for d in wide.run(binned, boost.BLOCK, learning)]
    model = boost.fit(reduce(DataFrame.unionAll, parts), cuts, rounds, depth)
    for part in parts:
        dropped(part)
    return model


def reranked(s1: DataFrame, pool: DataFrame, truth: DataFrame, learning: Column, keep: int = 40, least: int = 3, tau: float = 0.002, p: Retrieval | None = None) -> DataFrame:
    """s1_id, cand_id, INPUTS, label, rr, rr_rank: what retrieval.adaptive_top_k() keeps of the scored wide candidates."""
    wide = Wide(s1, pool, truth, p)
    model = trained(wide, learning)

    def best(ids, cands, row, cand, x, label) -> pa.RecordBatch:
        rr = model.predict(boost.ready(x, INPUTS))
        order = np.lexsort((-rr, row))
        rank = np.arange(len(row)) - np.searchsorted(row, row) + 1  # rows of an S1 are together
        held = (rank <= keep) & ((rank <= least) | (rr[order] >= tau))
        at = order[held]
        values = [pa.array(v, pa.int64() if c in COUNTS else pa.float64(), from_pandas=True) for c, v in zip(INPUTS, x[:, at], strict=True)]
        columns = [ids.take(pa.array(row[at])), cands.take(pa.array(cand[at])), *values, pa.array(label[at].astype(np.int32)), pa.array(rr[at]), pa.array(rank[held])]
        return pa.RecordBatch.from_arrays(columns, names=["s1_id", "cand_id", *INPUTS, "label", "rr", "rr_rank"])

    return reduce(DataFrame.unionAll, [settled(d, "reranked") for d in wide.run(best, KEPT)])
