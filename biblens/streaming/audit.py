"""Streams of references: the batch audit on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from biblens.operators.index import WordIndex
from biblens.plans.audit import audit, citation_index
from biblens.runtime import scratch


def batch_table(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps each batch in a folder of its own number: a batch that comes again replaces itself."""
    return lambda results, n: results.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={n}")


def audit_stream(refs: DataFrame, works: DataFrame, sink: Callable[[DataFrame, int], None] | str, index: WordIndex | str | None = None, **options) -> DataStreamWriter:
    """A writer that audits each micro-batch of (ref_id, input_text) and gives the results to ``sink``.

    Ranking windows are not allowed on unbounded streams; within a micro-batch they are. ``sink`` is a function of
    the results and the batch number, or the folder of a ``batch_table``. The works are indexed once, before the first batch; with
    a folder as ``index`` they are looked for there, so that a restarted stream and other streams share one index. What
    a batch writes on the way is deleted when the sink is done with it.
    """
    spark = works.sparkSession
    if isinstance(index, str):
        index = WordIndex.open(spark, index)
    index = index or citation_index(works)
    put = batch_table(sink) if isinstance(sink, str) else sink

    def run(batch: DataFrame, n: int) -> None:
        with scratch(spark):
            put(audit(batch, works, index=index, **options), n)

    return refs.writeStream.foreachBatch(run)
