"""Incremental ingest of landed payloads."""

from __future__ import annotations

from collections import Counter
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsignal.operators.scoring import KeywordLists
from newsignal.operators.store import Store
from newsignal.plans.pipeline import summarized, take
from newsignal.sources.feeds import stream_payloads

EVERY = "15 minutes"


def ingest(
    payloads: DataFrame, store: Store, companies: DataFrame, lexicon: DataFrame, checkpoint: str,
    lists: KeywordLists = KeywordLists(), as_of: datetime | None = None, every: str | None = EVERY,
    counts: Counter | None = None,
) -> StreamingQuery:
    """Starts the job: each micro-batch is linked, stored and scored like a batch run.

    The state between batches is in the tables alone: a url or score already stored is not stored
    again, so a micro-batch that is replayed after a failure changes nothing. ``every=None``
    processes what has landed and stops. The progress of the query has the number of payloads and of failed ones as
    observed metrics ``landed``; ``counts`` takes the sums of what the batches count.
    """
    store.create()
    store.add_companies(companies)

    def each(batch: DataFrame, _batch_id: int) -> None:
        found = take(store, batch, companies, lexicon, lists, as_of)
        if counts is not None:
            counts.update(found)

    failed = F.col("_corrupt_record").isNotNull() | ~F.col("status").eqNullSafe("ok")
    watched = payloads.observe("landed", F.count(F.lit(1)).alias("payloads"), F.count_if(failed).alias("failed"))
    writer = watched.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def run_new(
    spark: SparkSession, landed: str, store: Store, companies: DataFrame, lexicon: DataFrame, event_type: str = "scheduled",
    lists: KeywordLists = KeywordLists(), as_of: datetime | None = None,
) -> DataFrame:
    """A run over the payload files that landed since the last one; files taken before are not opened. Returns its summary.

    Which files were taken is kept with the store, so a run that failed takes its files again.
    """
    def process() -> dict[str, int]:
        counts: Counter = Counter(articles_fetched=0)
        files = stream_payloads(spark, landed)
        ingest(files, store, companies, lexicon, f"{store.root}/taken", lists, as_of, None, counts).awaitTermination()
        return dict(counts)

    return summarized(spark, store, companies, event_type, as_of, process)
