"""The audit over documents that keep arriving.

Each document comes in one row, so its n-grams are joined with the static probe
and counted within its batch: no state is kept from batch to batch, and each
batch adds its own rows to the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchsieve.functions.text import gram_keys, word_hashes
from benchsieve.operators.audit import probe, small


def gram_hits(documents: DataFrame, problems: DataFrame, n: int = 13) -> DataFrame:
    """``problem_id``, ``slice``, ``doc_id`` of a stream, one row per occurrence of an n-gram of a problem."""
    p = small(probe(problems, n))
    toks = documents.select("doc_id", "slice", word_hashes("text").alias("hs"))
    grams = toks.select("doc_id", "slice", F.explode(gram_keys("hs", n)).alias("k")).select("doc_id", "slice", "k.g1", "k.g2")
    return grams.join(p, ["g1", "g2"]).select("problem_id", "slice", "doc_id")


def run_available(occurrences: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Count a stream of occurrences over what there is now: ``problem_id``, ``slice``, ``doc_id``, ``hits``.

    A batch is written to a folder of its own number under ``out``, so one that
    is run again after a failure takes its own place and nothing counts twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("problem_id", "slice", "doc_id").agg(F.count(F.lit(1)).alias("hits")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = occurrences.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    schema = f"problem_id string, slice string, doc_id {occurrences.schema['doc_id'].dataType.simpleString()}, hits bigint, batch int"
    return occurrences.sparkSession.read.schema(schema).parquet(out).drop("batch")
