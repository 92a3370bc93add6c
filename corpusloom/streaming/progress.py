"""Streams: run progress from events, and documents as their files arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.functions import text as tx
from corpusloom.operators import chunks, runs

#: Parts in which a run's newest events are kept, so that a run with most events is dealt to several tasks.
SALTS = 8
_EARLIEST = -(1 << 63)
#: Times in state keep their microseconds.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def run_progress(events: DataFrame) -> DataFrame:
    """Latest event type, counts and summed values of each run, for update mode; late events cannot do harm."""
    at = F.struct("ts", "event_id")
    return events.groupBy("run_id").agg(
        F.max_by("event_type", at).alias("last_type"), F.max("ts").alias("last_seen"), F.count("*").alias("n_events"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.sum("value").alias("total")
    )


def run_stages(events: DataFrame) -> DataFrame:
    """Events by run and type, for update mode."""
    return events.groupBy("run_id", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"))


def run_facts(events: DataFrame) -> DataFrame:
    """Rows of kind run, stage and metric that hold what a run's events amount to, for update mode.

    Events are those of runs.event_state(). Each counts for its run, its stage and its metrics in one aggregation,
    part of which is done before the exchange, so that no run's events meet in one task. Late events count as they
    would have in time. A null run is a run, a null stage a stage; null metrics add nothing.
    """
    kind = "array<struct<kind:string,name:string,amount:double>>"
    one = F.array(F.struct(F.lit("run"), F.lit(None), F.lit(None))).cast(kind)
    stage = F.array(F.struct(F.lit("stage"), "stage", F.lit(None))).cast(kind)
    metrics = F.transform(F.map_entries("metrics"), lambda e: F.struct(F.lit("metric"), e["key"], e["value"])).cast(kind)
    each = events.withColumn("_fact", F.explode(F.concat(one, stage, F.coalesce(metrics, F.array().cast(kind)))))
    keyed = each.groupBy("run_id", F.col("_fact.kind").alias("kind"), F.col("_fact.name").alias("name"))
    return keyed.agg(*runs.event_folds(), F.min(F.struct("ts", "seq")).alias("first"), F.sum("_fact.amount").alias("amount"))


def run_states(facts: DataFrame) -> DataFrame:
    """The rows of runs.event_state() from one row for each fact; sums of metrics are doubles."""
    base = facts.where("kind = 'run'").select("run_id", "stage", "document_name", "document_completed", "document_total", "status", "n_events")
    several = facts.where("kind <> 'run'").groupBy(F.col("run_id").alias("_run")).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "stage", F.struct("first", "name")))), lambda x: x["name"]).alias("seen_stages"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == "metric", F.struct("name", "amount"))))).alias("metrics"),
    ).withColumn("metrics", F.when(F.size("metrics") > 0, F.col("metrics")))
    return base.join(several, F.col("run_id").eqNullSafe(F.col("_run")), "left").drop("_run")


def _newest(n: int, schema: T.StructType) -> Callable:
    names = schema.names

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(zip(*state.get, strict=True)) if state.exists else []
        for rows in batches:
            kept = sorted([*kept, *zip(rows["_ts"].tolist(), rows["_seq"].tolist(), rows["_event"], strict=True)])[-n:]
        columns = [list(c) for c in zip(*kept, strict=True)]
        state.update(tuple(columns))
        yield pd.DataFrame([(*key, columns[2])], columns=names)

    return fold


def last_events(events: DataFrame, n: int = runs.LAST_EVENTS, salts: int = SALTS) -> DataFrame:
    """The newest n events of each part of a run (run_id, part, events as JSON), for update mode.

    A part's state is n events at most; older ones go as newer ones come, and one that comes late takes the place
    its (ts, seq) gives it. A null ts or seq is the oldest; events that agree in both are told apart by the rest.
    newest_events() brings the parts of a run together.
    """
    order = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(_EARLIEST)), F.coalesce(F.col("seq").cast("long"), F.lit(_EARLIEST))
    event = F.to_json(F.struct(*[F.col(f"`{c}`") for c in events.columns if c != "run_id"]), _TIMES)
    rows = events.select("run_id", F.pmod(F.xxhash64("ts", "seq"), F.lit(salts)).cast("int").alias("part"), order[0].alias("_ts"), order[1].alias("_seq"), event.alias("_event"))
    out = T.StructType([events.schema["run_id"], T.StructField("part", T.IntegerType()), T.StructField("events", T.ArrayType(T.StringType()))])
    return rows.groupBy("run_id", "part").applyInPandasWithState(_newest(n, out), out, "ts array<long>, seq array<long>, event array<string>", "update", GroupStateTimeout.NoTimeout)


def newest_events(parts: DataFrame, schema: T.StructType, n: int = runs.LAST_EVENTS) -> DataFrame:
    """The rows of runs.last_events() from one row for each part of a run; schema is that of the events."""
    own = T.StructType([f for f in schema if f.name != "run_id"])
    each = parts.select("run_id", F.explode("events").alias("_event")).select("run_id", F.from_json("_event", own, _TIMES).alias("_event"))
    return runs.last_events(each.select("run_id", "_event.*"), n)


def follow(updates: DataFrame, store: str) -> None:
    """Takes in what a stream of updates has to tell since the last call, and ends.

    The rows of a batch replace those of an earlier attempt at it, in a folder of its number.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/rows/batch={number}")

    query = updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def followed(spark: SparkSession, store: str, keys: list[str]) -> DataFrame:
    """The last update of each key."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("batch")))
    return spark.read.parquet(f"{store}/rows").withColumn("_place", place).where("_place = 1").drop("_place", "batch")


def arriving_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of cleaned texts: every new file once, by the checkpoint of the query that reads it."""
    texts = spark.readStream.option("pathGlobFilter", "*.{md,txt}").text(folder, wholetext=True)
    cleaned = tx.clean_document(F.col("value"))
    return texts.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), cleaned["clean_text"].alias("text"))


def arriving_sentences(spark: SparkSession, folder: str, delimiters: str = chunks.DELIMITERS) -> DataFrame:
    """Sentences with offsets of arriving documents; stateless, so no watermark is needed."""
    return arriving_documents(spark, folder).select("name", F.inline(chunks.sentence_array(F.col("text"), delimiters)))
