"""What grows with the history grows no faster than it: work that rows share is done once."""

from datetime import timedelta

import rows
from rows import NOW

from runledger.operators import shapes
from runledger.session import scratch_dir
from runledger.sources.tables import Tables


def test_a_text_that_many_rows_share_is_normalized_once(spark):
    texts = [{"query_text": text, "fingerprint": known} for text in ("select 1 from t", "select 2  from T", "") for known in (None, "kept")]
    events = rows.events(spark, *texts * 20)
    path = scratch_dir(spark, "texts")
    found = shapes.fingerprinted_by_text(events, path)
    assert spark.read.parquet(path).count() == 3
    assert sorted(found.collect(), key=str) == sorted(shapes.fingerprinted(events).collect(), key=str)
    bare = events.drop("fingerprint")
    again = shapes.fingerprinted_by_text(bare, path).select("query_id", "fingerprint")
    assert sorted(again.collect()) == sorted(shapes.fingerprinted(bare).select("query_id", "fingerprint").collect())


def test_a_batch_is_folded_once(spark):
    made = Tables(spark, scratch_dir(spark, "tables"), 24)
    calls = spark.sparkContext.accumulator(0)
    marked = rows.events(spark, *[{"start_time": NOW - timedelta(hours=n)} for n in range(40)])
    schema = marked.schema

    def counted(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    made.append_events(marked.coalesce(1).mapInArrow(counted, schema), "s", 0)
    assert calls.value == 40
    assert made.events().count() == 40
