"""Streaming queries: enrichment, windowed aggregation batch by batch, and running outputs record by record."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewheel.functions.codec import decode, encode
from tidewheel.functions.keys import amount, output_key, window_size
from tidewheel.operators import orders as O
from tidewheel.operators.aggregate import GROUP
from tidewheel.schemas import ORDER, OUTPUT

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def use_rocksdb(spark: SparkSession) -> None:
    """State in RocksDB, of which each batch checkpoints the changes only."""
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)


def enrich(raw: DataFrame) -> DataFrame:
    """(key, value) of enriched orders from raw order records; malformed ones are dropped. No shuffle."""
    done = O.normalize(decode(raw.select("value"), ORDER))
    return done.select(F.col("orderId").alias("key"), encode(done.columns).alias("value"))


def window_sums(enriched: DataFrame, seconds: int | None = None, watermark: str | None = None) -> DataFrame:
    """Sums by window in update mode: each batch emits the keys it touched. Without a watermark no record is late and state is never dropped."""
    ready, group = O.keyed(enriched, seconds), [*GROUP]
    if watermark:  # state of a window goes once the watermark has passed its end
        ready = ready.withColumn("_t", F.timestamp_seconds("normTs")).withWatermark("_t", watermark)
        group.append(F.window("_t", f"{window_size(seconds)} seconds"))
    sums = ready.groupBy(*group).agg(F.sum(amount()).cast("bigint").alias("sumAmount"), F.sum("qty").cast("bigint").alias("sumQty"), F.count("*").alias("lastSeq"))
    return sums.select(output_key().alias("key"), *GROUP, "sumAmount", "sumQty", "lastSeq")


class Running(StatefulProcessor):
    """Cumulative outputs of a key, one for each record; state (sumAmount, sumQty, lastSeq) can start from a snapshot."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("running", "sumAmount bigint, sumQty bigint, lastSeq bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        first = initialState.iloc[0]
        self.state.update((int(first["SumAmount"]), int(first["SumQty"]), int(first["LastSeq"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        met = pd.concat(parts).sort_values("off", kind="stable")  # a batch's rows of a key have no order of their own
        total, count, seq = self.state.get() if self.state.exists() else (0, 0, 0)
        product = met["price"].astype("float64") * met["qty"].astype("float64")
        if abs(int(total)) + float(product.abs().sum()) >= _RANGE or abs(int(count)) + float(met["qty"].abs().astype("float64").sum()) >= _RANGE:
            raise OverflowError(f"the sums of {key[0]} leave the range of long")  # numpy would wrap without a word
        delta = met["price"].astype("int64") * met["qty"].astype("int64")
        out = pd.DataFrame({"off": met["off"].astype("int64"), "key": key[0], "storeId": met["storeId"], "productId": met["productId"], "windowStart": met["windowStart"].astype("int64"), "seq": range(int(seq) + 1, int(seq) + len(met) + 1), "delta": delta, "deltaQty": met["qty"].astype("int64")})
        out["sumAmount"], out["sumQty"] = delta.cumsum() + int(total), out["deltaQty"].cumsum() + int(count)
        self.state.update((int(out["sumAmount"].iloc[-1]), int(out["sumQty"].iloc[-1]), int(seq) + len(met)))
        yield out

    def close(self) -> None:
        pass


#: A little below the highest long, as sums of floats tell whether it is left.
_RANGE = 2.0**63 * (1 - 1e-12)
RUNNING = "off bigint, key string, storeId string, productId string, windowStart bigint, seq bigint, delta bigint, deltaQty bigint, sumAmount bigint, sumQty bigint"


def running_outputs(enriched: DataFrame, seconds: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """One output for each record of a stream with `off`, in the order of off within each batch; `initial` is a snapshot's state."""
    ready = O.keyed(enriched, seconds).select("key", "off", *GROUP, "price", "qty")
    start = initial.groupBy("key") if initial is not None else None
    return ready.groupBy("key").transformWithStateInPandas(Running(), RUNNING, "Update", "None", start)


def start(df: DataFrame, write, checkpoint: str, name: str, trigger: dict | None = None, mode: str = "update") -> StreamingQuery:
    """A query whose batches go to write(batch, epoch). Triggers: {'availableNow': True} to drain and stop, {'processingTime': '100 milliseconds'} to go on."""
    return df.writeStream.outputMode(mode).queryName(name).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()


def output_records(outputs: DataFrame, now) -> DataFrame:
    """(key, value) of output records as a topic takes them; `now` is epoch seconds."""
    names = [part.strip().split()[0] for part in OUTPUT.split(",")]
    return outputs.withColumn("updatedAt", now).select("key", encode(names).alias("value"))
