"""Events routed by action to handlers, a micro-batch at a time; what a handler cannot take is a dead letter with its reason."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import free_name


@dataclass(frozen=True)
class Handler:
    """What is done with the events of one action.

    payload: fields of its JSON, as DDL; result: SQL over ``payload`` and the event's columns by name of the result, null where it fails (``try_`` functions);
    checks: SQL conditions that must hold, by the reason that is given where they do not.
    """

    payload: str
    result: Mapping[str, str]
    checks: Mapping[str, str] = field(default_factory=dict)


def publish(events: DataFrame, folder: str, batch: str) -> None:
    """Write a batch of events to the folder of a topic under its own name; publishing it again replaces it."""
    events.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/batch={batch}")


def handled(events: DataFrame, handlers: Mapping[str, Handler], action: str = "event_type", body: str = "props") -> DataFrame:
    """Adds ``result`` (JSON) and ``reason`` (null where the handler took the event).

    Reasons: unknown_action, bad_payload (null or no JSON of the fields), the name of the first check that does not hold or is null, failed:<name> for the first result that is null.
    One pass without a Python worker; each payload is parsed by its own action's fields alone.
    """
    parsed = {name: free_name(f"payload_{i}", events.columns) for i, name in enumerate(handlers)}
    broken = {name: free_name(f"broken_{i}", events.columns) for i, name in enumerate(handlers)}
    mine = {name: F.col(f"`{action}`") == name for name in handlers}
    options = {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}
    rows = events.withColumns({parsed[n]: F.when(mine[n], F.from_json(F.col(f"`{body}`"), f"{h.payload}, _broken string", options)) for n, h in handlers.items()})
    rows = rows.withColumns({broken[n]: F.col(f"{parsed[n]}").isNull() | F.col(f"{parsed[n]}._broken").isNotNull() for n in handlers})
    reason, result = F.when(~F.coalesce(F.col(f"`{action}`").isin(*handlers), F.lit(False)), "unknown_action"), None
    for name, handler in handlers.items():
        said = lambda sql: F.expr(_on(sql, parsed[name]))  # noqa: B023,E731
        failed = F.when(F.col(broken[name]), "bad_payload")
        for why, condition in handler.checks.items():
            failed = failed.when(~F.coalesce(said(condition), F.lit(False)), why)
        for out, sql in handler.result.items():
            failed = failed.when(said(sql).isNull(), f"failed:{out}")
        reason = reason.when(mine[name], failed)
        made = F.to_json(F.struct(*(said(sql).alias(out) for out, sql in handler.result.items())))
        result = F.when(mine[name], made) if result is None else result.when(mine[name], made)
    rows = rows.withColumn(why := free_name("why", rows.columns), reason)
    return rows.select(*(F.col(f"`{c}`") for c in events.columns if c not in ("result", "reason")), F.when(F.col(why).isNull(), result).alias("result"), F.col(why).alias("reason"))


def _on(sql: str, name: str) -> str:
    """The SQL with the handler's own payload in place of ``payload``."""
    return sql.replace("payload.", f"{name}.")


def dispatch(batch: DataFrame, number: int, handlers: Mapping[str, Handler], folder: str, action: str = "event_type", body: str = "props", attempt: int = 1) -> None:
    """Write a batch's events to the folder with what came of them; the same number again replaces them, so that a replayed batch is there once."""
    rows = handled(batch, handlers, action, body).withColumns({"attempt": F.lit(attempt), "outcome": F.when(F.col("reason").isNull(), "done").otherwise("dead")})
    rows.write.mode("overwrite").partitionBy("outcome").option("compression", "zstd").parquet(f"{folder}/attempt={attempt}/batch={number}")


def run(events: DataFrame, handlers: Mapping[str, Handler], folder: str, log: str, every: str | None = None, action: str = "event_type", body: str = "props"):
    """A streaming query that dispatches each micro-batch. Without ``every`` (such as 1 minute) it takes what is there and ends."""
    writer = events.writeStream.option("checkpointLocation", log).foreachBatch(lambda batch, number: dispatch(batch, number, handlers, folder, action, body))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def outcomes(spark: SparkSession, folder: str, schema, outcome: str | None = None, attempt: int | None = None) -> DataFrame:
    """What was dispatched (the events' schema, result, reason, batch, attempt, outcome), of one outcome or attempt where given: only their folders are read."""
    kinds = {f.name: f.dataType.simpleString() for f in schema}
    full = ", ".join([*(f"`{n}` {k}" for n, k in kinds.items() if n not in ("result", "reason")), "result string, reason string, attempt int, batch long, outcome string"])
    rows = spark.read.schema(full).option("basePath", folder).parquet(folder)
    rows = rows if outcome is None else rows.filter(F.col("outcome") == outcome)
    return rows if attempt is None else rows.filter(F.col("attempt") == attempt)


def retry(spark: SparkSession, folder: str, schema, handlers: Mapping[str, Handler], most: int = 3, action: str = "event_type", body: str = "props") -> int:
    """Dispatch the dead letters of the last attempt again, with handlers that may have been mended; returns the attempt's number.

    Nothing is done once ``most`` attempts were made or nothing is dead. Attempts are kept side by side, so the letters of the last one are those still open.
    """
    last = outcomes(spark, folder, schema).agg(F.max("attempt")).first()[0] or 1
    dead = outcomes(spark, folder, schema, "dead", last)
    if last >= most or dead.isEmpty():
        return last
    dispatch(dead.select(*(F.col(f"`{f.name}`") for f in schema)), 0, handlers, folder, action, body, last + 1)
    return last + 1
