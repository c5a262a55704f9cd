import datetime as dt
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.errors import ConfigurationError
from kindred.operators import graph
from kindred.operators.dedupe import Settings
from kindred.streaming import meetings

ZERO = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "id bigint, at timestamp, name string, band int"


def roots(links, keys):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def by_the_book(rows, forget):
    """Links of each row to the one before it under the same name."""
    out, last = [], {}
    for key, at, name in sorted(rows, key=lambda r: (r[1], r[0])):
        if name in last and at - last[name][1] <= forget:
            out.append((key, last[name][0]))
        last[name] = (key, at)
    return out


@given(st.lists(st.tuples(st.integers(0, 60), st.sampled_from([3, 4])), max_size=30), st.integers(0, 6), st.lists(st.integers(1, 5), max_size=10))
@settings(max_examples=150, deadline=None)
def test_chains_do_not_depend_on_order_or_on_batches(records, forget, cuts):
    rows = [(k, at, bucket) for k, (at, bucket) in enumerate(records)]
    want = roots(by_the_book(rows, forget), range(len(rows)))
    held, links, left = pd.DataFrame({n: pd.Series(dtype="int64") for n in ("band", "bucket", "first", "last", "least")}), [], list(rows)
    for n in [*cuts, len(rows)]:
        part, left = left[:n], left[n:]
        new = pd.DataFrame([(0, b, at, at, k) for k, at, b in part], columns=held.columns).astype("int64")
        held, found = meetings.chained(pd.concat([held, new], ignore_index=True), forget)
        links += list(found.itertuples(index=False, name=None))
    assert all(b < a for a, b in links)
    assert roots(links, range(len(rows))) == want
    assert len(held) == len({(b, want[k]) for k, _, b in rows})


class Feed:
    """A folder that rows are added to, and a stream over it that is started anew from its checkpoint each time."""

    def __init__(self, spark, base, forget, delay):
        self.spark, self.base, self.forget, self.delay = spark, base, forget, delay

    def run(self, rows, parts=2):
        given = [(k, None if at is None else ZERO + dt.timedelta(seconds=at), name, k) for k, at, name in rows]
        self.spark.createDataFrame(given, SCHEMA).repartition(parts).write.mode("append").parquet(f"{self.base}/in")
        stream = self.spark.readStream.schema(SCHEMA).parquet(f"{self.base}/in")
        found = meetings.links(stream, "id", "at", F.array("name"), self.forget, self.delay, Settings(num_perm=16, threshold=0.5), slots=3)
        started = meetings.start(found, f"{self.base}/out", f"{self.base}/checkpoint")
        started.awaitTermination()
        return started

    def links(self):
        return [(r.a, r.b) for r in meetings.read(self.spark, f"{self.base}/out").collect()]

    def open(self):
        """Sessions that the state holds by now."""
        state = self.spark.read.format("statestore").option("stateVarName", "open").load(f"{self.base}/checkpoint")
        return state.count()


def test_restarts_late_rows_and_rows_without_key_or_time(spark, tmp_path):
    """Three runs of a checkpoint, each with rows that come before some of the run before; one name holds a third of the rows."""
    rng = random.Random(5)
    feed, every = Feed(spark, tmp_path, 20, "200 seconds"), []
    for i in range(3):
        rows = [(i * 100 + j, 150 * i + rng.randrange(200), rng.choice(["hot", "hot", *"abcd"])) for j in range(60)]
        every += rows
        feed.run([*rows, (None, 5, "hot"), (1000 + i, None, "hot")])
    want = by_the_book(every, 20)
    keys = [k for k, _, _ in every]
    got = feed.links()
    assert roots(got, keys) == roots(want, keys)
    assert all(b < a for a, b in got) and {k for link in got for k in link} <= set(keys)
    assert len(got) < len(keys) * 2
    # A run without new rows changes nothing.
    stream = feed.run([])
    assert sorted(feed.links()) == sorted(got) and stream.exception() is None


def test_buckets_are_forgotten_in_event_time(spark, tmp_path):
    feed = Feed(spark, tmp_path, 10, "0 seconds")
    feed.run([(1, 0, "x"), (2, 5, "x"), (3, 0, "y"), (4, 14, "z")])
    assert feed.open() > 0
    assert feed.links() == [(2, 1)]
    feed.run([(5, 15, "x")])  # ten seconds after the last of x
    assert sorted(feed.links()) in ([(2, 1), (5, 1)], [(2, 1), (5, 1), (5, 2)])
    feed.run([(6, 500, "w")])
    before = feed.open()
    feed.run([(7, 501, "x"), (8, 502, "y"), (9, 502, "w")])
    got = sorted(feed.links())
    assert (9, 6) in got and not any(7 in link or 8 in link for link in got)
    bands = Settings(num_perm=16, threshold=0.5).bands[0]
    assert before == bands  # those of w alone
    assert roots(got, range(1, 10))[5] == 1


def test_empty_stream_and_refused_parameters(spark, tmp_path):
    feed = Feed(spark, tmp_path, 10, "0 seconds")
    feed.run([], parts=1)
    assert feed.links() == [] and graph.components(meetings.read(spark, f"{tmp_path}/out")).count() == 0
    with pytest.raises(ConfigurationError):
        meetings.links(spark.createDataFrame([], SCHEMA), "id", "at", F.array("name"), -1)
