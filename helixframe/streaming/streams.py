"""Structured Streaming over event logs (ST1-ST11). Every batch function is the batch loader's own code.

Tables are kept by KeyedTable with the micro-batch id as commit number, so a batch that Spark sends again after a failure
changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import builders, filters, intervals, ranges
from ..sources.sinks import KeyedTable, greatest_per_key


def start(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Runs fn per micro-batch; once: replays what there is and ends (ST11)."""
    writer = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def last_write_wins(table: KeyedTable) -> Callable[[DataFrame, int], None]:
    """The latest row per key is kept, by the table's order, however events are dealt into batches (ST2)."""
    _ordered(table)

    def fn(batch: DataFrame, batch_id: int) -> None:
        table.merge(upserts=batch, batch=batch_id)

    return fn


def publish_or_delete(table: KeyedTable, is_published) -> Callable[[DataFrame, int], None]:
    """Per key the last event by the table's order decides: a published row is kept, another deletes its key; neither comes back by an older one (ST3)."""
    _ordered(table)

    def fn(batch: DataFrame, batch_id: int) -> None:
        told = batch.withColumn("_on", F.coalesce(is_published, F.lit(False)))
        table.merge(upserts=told.where("_on").drop("_on"), deletes=told.where("not _on"), batch=batch_id)

    return fn


def _ordered(table: KeyedTable) -> None:
    if not table.order:
        raise ValueError("the table needs order columns: else the sequence of batches decides")


def gated(fn: Callable[[DataFrame, int], None], ready: Callable[[], bool], waiting: KeyedTable) -> Callable[[DataFrame, int], None]:
    """Holds batches in a table until the gate opens, then gives them with the next batch (ST4, J14).

    waiting: a table of the batches' columns; its rows are kept by event, so several of one key wait beside each other.
    """
    events = KeyedTable(waiting.spark, waiting.path, f"{waiting.schema}, _event string", "_event", waiting.buckets)

    def run(batch: DataFrame, batch_id: int) -> None:
        if not ready():
            events.merge(upserts=batch.withColumn("_event", F.concat_ws("-", F.lit(str(batch_id)), F.monotonically_increasing_id().cast("string"))), batch=batch_id)
            return
        held = events.read()
        fn(held.drop("_event").unionByName(batch.select(*[c for c in held.columns if c != "_event"])), batch_id)
        events.merge(deletes=held.select("_event"), batch=batch_id)

    return run


class WaitForKey(StatefulProcessor):
    """Rows of a key wait in the state until the key's opening row has come; later ones pass at once."""

    def __init__(self, schema: T.StructType):
        self.schema = schema
        self.row = Row(*schema.names)

    def values(self, row) -> tuple:
        return tuple(row[n] for n in self.schema.names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "open boolean")
        self.waiting = handle.getListState("waiting", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        is_open = self.open.exists()
        opened = False
        for r in rows:
            if r["_opens"]:
                opened = opened or not is_open
                is_open = True
            elif is_open:
                yield self.row(*self.values(r["_row"]))
            else:
                self.waiting.appendValue(self.values(r["_row"]))
        if opened:
            self.open.update((True,))
            for r in self.waiting.get():
                yield self.row(*r)
            self.waiting.clear()

    def close(self) -> None:
        pass


def wait_for_key(events: DataFrame, arrivals: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Streaming rows of events, each given out once: at once if its key has arrived, else when it does (J14, ST4).

    events and arrivals are streams with the key column. The state is keyed by (key, salt): rows of a hot key wait in
    `salts` places, and an arrival opens each of them. It holds waiting rows and one mark per key and salt, in the state
    store of the query's checkpoint, so nothing is lost or given out twice when the query starts again. Rows with a null
    key open by an arrival of a null key only. Repeated arrivals change nothing. Needs the RocksDB state store
    (state_store()).
    """
    row = F.struct(*events.columns)
    salt = F.pmod(F.xxhash64(F.to_json(row)), F.lit(salts)).cast("int")
    come = events.select(F.col(key).alias("_key"), salt.alias("_salt"), F.lit(False).alias("_opens"), row.alias("_row"))
    kind = come.schema["_row"].dataType
    opens = arrivals.select(F.col(key).alias("_key"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), F.lit(True).alias("_opens"), F.lit(None).cast(kind).alias("_row"))
    both = come.unionByName(opens)
    return both.groupBy("_key", "_salt").transformWithState(WaitForKey(events.schema), events.schema, "append", "none")


def state_store(spark: SparkSession) -> None:
    """Keyed state in RocksDB, which wait_for_key() needs; its snapshots lie in the query's checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def batches_to(path: str) -> Callable[[DataFrame, int], None]:
    """Every batch's rows as a folder of Parquet of its own, written over if the batch is sent again."""

    def fn(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return fn


def supersede(current: KeyedTable, history: KeyedTable, order: tuple[str, ...] = ("ts",), minimise: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """Each version of a record but the last lies in the history, marked with the version that comes next in order (ST5).

    current has (key, version, order columns, ...) with one row per record, history the same columns (or what minimise
    leaves of them) and invalidated_by, with a row per replaced version; both are kept by record. A version that comes
    late takes its place between the others: the one before it is marked anew, and it goes to the history itself. So any
    split into batches gives the same tables. A version that comes again replaces itself. minimise: from replaced rows to
    what the history keeps of them, such as builders.minimised_versions() (B14); it must leave key, version and order.
    """
    key = current.key

    def fn(batch: DataFrame, batch_id: int) -> None:
        now, then = current.read(), history.read()
        mine = batch.select(key).distinct()
        old = then.join(mine, key, "left_semi")
        full = now.join(mine, key, "left_semi").unionByName(batch.select(*now.columns))
        known = old.select(key, "version", *order, F.lit(0).alias("_full")).unionByName(full.select(key, "version", *order, F.lit(1).alias("_full")))
        # one row per version: its latest place in the order
        placed = known.groupBy(key, "version").agg(F.max(F.struct(*order, "_full")).alias("_at")).select(key, "version", "_at.*")
        linked = ranges.written(ranges.following(placed, key, [*order, "version"], "version", "invalidated_by"), "versions")
        told = greatest_per_key(full.withColumn("_version", F.struct(key, "version")), "_version", *order).drop("_version")
        rows = told.join(linked.where("_full = 1").select(F.col(key).alias("_k"), F.col("version").alias("_v"), "invalidated_by", "_is_last"), F.col(key).eqNullSafe(F.col("_k")) & F.col("version").eqNullSafe(F.col("_v"))).drop("_k", "_v")
        gone = rows.where("not _is_last").drop("_is_last")
        gone = gone if minimise is None else minimise(gone)
        kept = old.drop("invalidated_by").join(linked.where("_full = 0 and not _is_last").select(F.col(key).alias("_k"), F.col("version").alias("_v"), "invalidated_by"), F.col(key).eqNullSafe(F.col("_k")) & F.col("version").eqNullSafe(F.col("_v"))).drop("_k", "_v")
        history.merge(upserts=ranges.written(gone.select(*then.columns).unionByName(kept.select(*then.columns)), "replaced"), batch=batch_id)
        current.merge(upserts=rows.where("_is_last").select(*now.columns), batch=batch_id)

    return fn


def reject_regions(rejects: KeyedTable) -> Callable[[DataFrame, int], None]:
    """Region events that aren't valid go to the rejects, which have an order (ST7)."""
    _ordered(rejects)

    def fn(batch: DataFrame, batch_id: int) -> None:
        rejects.merge(upserts=batch.where(~filters.dosage_record_ok()), batch=batch_id)

    return fn


def enrich_regions(features: DataFrame, regions: KeyedTable, overlaps: KeyedTable, rejects: KeyedTable, one_location: bool = False) -> Callable[[DataFrame, int], None]:
    """Region events: valid ones are stored with their protein-coding overlaps, others go to the rejects (ST6, ST7).

    regions and rejects have an order, so a late event replaces nothing. Overlaps follow the stored regions: they are
    found anew for those keys whose stored row is of this batch. one_location: that of intervals.overlaps(), of the features.
    """
    _ordered(regions)
    reject = reject_regions(rejects)

    def fn(batch: DataFrame, batch_id: int) -> None:
        good = batch.where(filters.dosage_record_ok())
        names = regions.spark.createDataFrame([], regions.schema).columns
        regions.merge(upserts=good.select(*names), batch=batch_id)
        own = good.select(F.col(regions.key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in regions.order]).distinct()
        same = F.col(regions.key).eqNullSafe(F.col("_k"))
        for c in regions.order:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        stands = regions.read().join(own, same, "left_semi")
        found = intervals.coding_overlaps(stands.withColumnRenamed(regions.key, "variant"), features, one_location=one_location).withColumnRenamed("variant", regions.key)
        overlaps.merge(upserts=found, deletes=stands.select(regions.key), batch=batch_id)
        reject(batch, batch_id)

    return fn


def with_marker(fn: Callable[[DataFrame, int], None], progress: KeyedTable, name: str) -> Callable[[DataFrame, int], None]:
    """Writes a progress row after each batch (ST8)."""

    def run(batch: DataFrame, batch_id: int) -> None:
        fn(batch, batch_id)
        row = batch.sparkSession.createDataFrame([(name, batch_id)], "name string, batch long")
        progress.merge(upserts=row, batch=batch_id)

    return run


def request_log(table: KeyedTable) -> Callable[[DataFrame, int], None]:
    """Log events keyed by start time, with their duration; of one start the last end counts (ST9, X36)."""
    _ordered(table)

    def fn(batch: DataFrame, batch_id: int) -> None:
        table.merge(upserts=batch.withColumn("duration", F.col("end_time") - F.col("start_time")), batch=batch_id)

    return fn


def person_events(table: KeyedTable) -> Callable[[DataFrame, int], None]:
    """Person events of the four valid types are upserted as persons with their event's order columns (ST10, F15)."""
    _ordered(table)

    def fn(batch: DataFrame, batch_id: int) -> None:
        good = batch.where(filters.valid_event("event_type"))
        table.merge(upserts=builders.persons(good, *table.order), batch=batch_id)

    return fn
