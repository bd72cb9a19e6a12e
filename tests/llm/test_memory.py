import subprocess
import sys

CODE = """
import re
import sys

import pyarrow as pa
from pyspark.sql import SparkSession

import corpus_pipeline
from quillstone.llm.minhash import sets
from quillstone.llm.toxicity import Network, Toxicity


def probe(batches):
    for _ in batches:
        pass
    with open("/proc/self/smaps_rollup") as f:
        kb = re.search(r"\\nPss_Anon:\\s+(\\d+)", f.read())[1]
    yield pa.RecordBatch.from_arrays([pa.array([int(kb) // 1024])], ["mb"])


corpus_pipeline.fit = lambda *_: Network.fresh(Toxicity())
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
held = lambda: spark.range(0, 1, 1, 1).mapInArrow(probe, "mb long").first().mb
docs = spark.range(0, 4000, 1, 1).selectExpr(
    "id AS doc_id", "concat_ws(' ', transform(sequence(1, 400), i -> hex(xxhash64(id, i)))) AS text", "'en' AS lang", "'s' AS source", "CAST(1 AS LONG) AS n_chars"
)
if sys.argv[1] == "toxicity":
    docs.sparkSession.createDataFrame([(0, 1)], "doc_id long, toxic int").createOrReplaceTempView("labels")
    corpus_pipeline.table = lambda *_: spark.table("labels")
    work = corpus_pipeline.toxicity(spark, docs, "")
else:
    work = sets(docs, corpus_pipeline.NEAR)
docs.limit(1).mapInArrow(lambda b: b, docs.schema).collect()
before = held()
work.write.format("noop").mode("overwrite").save()
print("held", before, held())
"""


def grown(what: str) -> int:
    """MB that an idle Python worker holds after a stage over 27 MB of text, beyond what it held before."""
    out = subprocess.run([sys.executable, "-c", CODE, what], capture_output=True, text=True, check=True, timeout=300).stdout
    before, after = map(int, out.rsplit("held", 1)[1].split())
    return after - before


def test_idle_workers_return_their_memory():
    assert {what: n for what in ("sets", "toxicity") if (n := grown(what)) > 60} == {}
