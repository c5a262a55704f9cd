"""Records of a stream meet those of their buckets when they arrive, and buckets are forgotten in event time.

The state of a bucket is its open sessions, not its members: a session is a chain of records of the bucket whose times lie no more than
``forget`` apart, known by its first and last time and its smallest key.  A record is linked to that key, and so are two
sessions that a record joins; the components of the links are those of all pairs of records of a session.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..errors import ConfigurationError
from ..operators import lsh, minhash
from ..operators.dedupe import Settings

#: Parts that buckets are dealt to, each one key of the state; a stream keeps the number that its checkpoint began with.
SLOTS = 256

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SESSION = "band int, bucket bigint, first bigint, last bigint, least bigint"
_LINK = "a bigint, b bigint"


def chained(rows: pd.DataFrame, forget: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Sessions (``band, bucket, first, last, least``) joined where they lie no more than ``forget`` apart, and the links ``a, b`` of those joined to
    the least key of each."""
    rows = rows.sort_values(["band", "bucket", "first"], kind="stable", ignore_index=True)
    if rows.empty:
        return rows, pd.DataFrame({"a": rows["least"], "b": rows["least"]})
    band, bucket = rows["band"].to_numpy(), rows["bucket"].to_numpy()
    other = np.r_[True, (band[1:] != band[:-1]) | (bucket[1:] != bucket[:-1])]
    reach = rows.groupby(np.cumsum(other))["last"].cummax().to_numpy()
    begins = other | np.r_[True, rows["first"].to_numpy()[1:] > reach[:-1] + forget]
    number = np.cumsum(begins) - 1
    joined = rows.groupby(number).agg(band=("band", "first"), bucket=("bucket", "first"), first=("first", "min"), last=("last", "max"), least=("least", "min"))
    least = joined["least"].to_numpy()[number]
    moved = rows["least"].to_numpy() != least
    return joined, pd.DataFrame({"a": rows["least"].to_numpy()[moved], "b": least[moved]}).drop_duplicates()


class Sessions(StatefulProcessor):
    """The open sessions of a slot's buckets: a list state, and one timer for the first of them that ends."""

    def __init__(self, forget: int) -> None:
        self.forget = forget

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _SESSION)

    def _held(self) -> pd.DataFrame:
        names = ["band", "bucket", "first", "last", "least"]
        return pd.DataFrame(list(self.open.get()), columns=names).astype({n: "int64" for n in names})

    def _keep(self, sessions: pd.DataFrame, watermark: int) -> None:
        """Keep the sessions that a record beyond the watermark (microseconds) may still join."""
        sessions = sessions[sessions["last"] + self.forget >= watermark]
        if sessions.empty:
            self.open.clear()
            return
        self.open.put([tuple(int(v) for v in row) for row in sessions.itertuples(index=False)])
        if next(iter(self.handle.listTimers()), None) is None:
            ends = int(sessions["last"].min()) + self.forget
            self.handle.registerTimer(max(ends, watermark) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        for part in rows:
            links = part[part["band"].isna()]
            if len(links):
                yield pd.DataFrame({"a": links["least"].astype("int64"), "b": links["first"].astype("int64")})
            met = part[part["band"].notna()][held.columns].astype("int64")
            held, links = chained(pd.concat([held, met], ignore_index=True), self.forget)
            if len(links):
                yield links
        self._keep(held, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        self._keep(self._held(), timerValues.getCurrentWatermarkInMs() * 1000)
        return iter(())

    def close(self) -> None:
        pass


def links(
    stream: DataFrame, key: str, time: str, features: Column, forget: float, delay: str = "0 seconds", settings: Settings | None = None, slots: int = SLOTS,
) -> DataFrame:
    """``a, b`` (b < a) as a stream: records that shared a bucket no more than ``forget`` seconds after the record before them there.

    ``key`` is a BIGINT, ``time`` a timestamp.  Rows without a key or a time link with nothing.  Records that come later than ``delay``
    behind the latest one seen may be passed over, as by every stream with a watermark; up to there the order of arrival is of no
    account.  A bucket's state is its open sessions, and goes once the watermark has passed the last of them by ``forget``.  Records
    of a bucket are chained where they lie, in each Arrow batch, before they are exchanged, so a hot bucket sends a row a batch."""
    if forget < 0 or slots < 1:
        raise ConfigurationError("forget must not be negative, slots must be positive")
    s, apart = settings or Settings(), round(forget * 1_000_000)
    known = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    asked = known.select(F.struct(F.col(key).cast("bigint").alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("at")).alias("record"), features.alias("features"))
    signed = minhash.sign(asked, "record", F.col("features"), s.num_perm, s.seed, s.width)
    banded = lsh.band_rows(signed, "record", *s.bands)
    single = banded.select("band", "bucket", F.col("key.at").alias("first"), F.col("key.at").alias("last"), F.col("key.key").alias("least"))

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sessions, found = chained(batch, apart)
            seen = batch["last"].max()
            yield sessions.assign(band=sessions["band"].astype("Int32"))
            # A link that is known already travels as a row without a bucket; it is as late as its batch.
            yield pd.DataFrame({"band": pd.array([None] * len(found), "Int32"), "bucket": found["a"], "first": found["b"], "last": seen, "least": found["a"]})

    met = single.mapInPandas(chain, _SESSION)
    slot = F.pmod(F.xxhash64("band", "bucket"), F.lit(slots)).cast("int")
    timed = met.select(slot.alias("slot"), "*", F.timestamp_micros("last").alias("seen")).withWatermark("seen", delay)
    return timed.groupBy("slot").transformWithStateInPandas(Sessions(apart), _LINK, "Append", "EventTime")


@contextlib.contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """State of this kind needs RocksDB; a query takes the setting when it starts."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def start(found: DataFrame, path: str, checkpoint: str, **trigger):
    """Write links to a folder, each batch once, from where the checkpoint left off; all that is there, unless a trigger is given."""
    with _rocks(found.sparkSession):
        out = found.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
        return out.trigger(**(trigger or {"availableNow": True})).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The links written so far."""
    return spark.read.schema(_LINK).parquet(path).distinct()
