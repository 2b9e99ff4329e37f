"""Streaming operators and file sources as registered queries over the given tables."""

import uuid

from pyspark.sql import functions as F

from ..operators import documents, feedback
from ..session import shared_dir
from ..sources import files
from ..sources.graph_store import GraphStore
from ..streaming import dispatch, drift, episodes, events, jobs, state
from .fixtures import REF_TIME, query


def _stream(t, name="events"):
    return events.read(t.spark, f"{t.sf_dir}/{name}.parquet")


@query("STR-01", "SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type ELSE 'quarantine' END AS route FROM events")
def _(t):
    routed = events.route(_stream(t), "k int", ["click", "view", "purchase"])
    return events.drain(routed.select("event_id", "route"), "str-01")


_HANDLERS = {
    "click": dispatch.Handler("k int", {"target": "payload.k * 2"}, {"k_too_large": "payload.k < 90"}),
    "view": dispatch.Handler("k int", {"part": "cast(try_divide(event_id, payload.k % 5) as bigint)"}),
    "purchase": dispatch.Handler("k int", {"item": "payload.k", "cents": "cast(round(value * 100) as bigint)"}, {"no_value": "value >= 20"}),
}


@query("STR-01-dispatch", """WITH e AS (SELECT event_id, event_type, value, event_id % 97 = 0 AS broken, CASE WHEN event_id % 97 <> 0 THEN (props->>'k')::INT END AS k FROM events),
  r AS (SELECT *, CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'unknown_action' WHEN broken THEN 'bad_payload' WHEN event_type = 'click' AND k >= 90 THEN 'k_too_large' WHEN event_type = 'purchase' AND value < 20 THEN 'no_value'
    WHEN event_type = 'view' AND k % 5 = 0 THEN 'failed:part' END AS reason FROM e)
  SELECT event_id, reason, CASE WHEN reason IS NULL THEN CASE event_type WHEN 'click' THEN '{"target":' || k * 2 || '}' WHEN 'view' THEN '{"part":' || event_id // (k % 5) || '}' ELSE '{"item":' || k || ',"cents":' || round(value * 100)::BIGINT || '}' END END AS result, 1 AS attempt FROM r""")
def _(t):
    """Events through handlers; those that fail are dead letters with their reason."""
    stream = _stream(t).withColumn("props", F.when(F.col("event_id") % 97 == 0, F.lit('{"k":')).otherwise(F.col("props")))
    folder = f"{shared_dir(t.spark)}/dispatched-{uuid.uuid4().hex}"
    dispatch.run(stream, _HANDLERS, folder, f"{folder}-log").awaitTermination()
    return dispatch.outcomes(t.spark, folder, stream.schema).select("event_id", "reason", "result", "attempt")


_RISEN = """CASE WHEN e.layer = 'PERCEPTION' AND (confidence >= 0.85 OR validation_count >= 3 OR len(ontology_codes) > 0) THEN 'SEMANTIC' WHEN e.layer = 'SEMANTIC' AND (confidence >= 0.9 OR len(inference_rules) > 0 OR reference_count >= 5) THEN 'REASONING' END"""


@query("STR-02-promote", f"""WITH a AS (SELECT DISTINCT 'order:' || event_id AS id, CASE WHEN event_type IN ('signup', 'view', 'click') THEN 'PERCEPTION' ELSE 'SEMANTIC' END AS layer FROM events),
  r AS (SELECT e.id, e.layer, {_RISEN} AS target FROM {{rising}} e JOIN a ON a.id = e.id AND a.layer = e.layer)
  SELECT e.id, coalesce(r.target, e.layer) AS layer, CASE WHEN r.target IS NOT NULL THEN e.layer END AS promoted_from, CASE WHEN r.target IS NOT NULL THEN 2 END AS version FROM {{rising}} e LEFT JOIN r ON r.id = e.id""")
def _(t):
    """Events that create and update orders promote those that qualify in the store."""
    store = _rising(t, "promoted-on-events")
    kind = F.when(F.col("event_type").isin("signup", "view", "click"), "entity_created").otherwise("entity_updated")
    told = _stream(t).select(kind.alias("action"), F.concat(F.lit("order:"), "event_id").alias("id"))
    rows = told.join(t.rising.select("id", "layer", "confidence", "validation_count", "ontology_codes", "inference_rules", "reference_count"), "id")
    jobs.on_events(store, rows, "events", f"{store.path}-log").awaitTermination()
    return store.nodes().select("id", "layer", "promoted_from", "version")


@query("STR-08-promotions", """WITH p AS (SELECT *, CASE WHEN layer = 'PERCEPTION' AND (confidence >= 0.85 OR validation_count >= 3 OR len(ontology_codes) > 0) THEN 'SEMANTIC' ELSE layer END AS one FROM {rising}),
  q AS (SELECT *, CASE WHEN one = 'SEMANTIC' AND (confidence >= 0.9 OR len(inference_rules) > 0 OR reference_count >= 5) THEN 'REASONING' ELSE one END AS two FROM p)
  SELECT id, two AS layer, CASE WHEN two IS DISTINCT FROM one THEN one WHEN one IS DISTINCT FROM layer THEN layer END AS promoted_from, CASE WHEN two IS DISTINCT FROM layer THEN 1 + (two IS DISTINCT FROM one)::INT + (one IS DISTINCT FROM layer)::INT END AS version FROM q""")
def _(t):
    """Promotion scans of the stored nodes, the second of which finds nothing to do."""
    store = _rising(t, "scanned")
    jobs.scan(store)
    jobs.scan(store)
    return store.nodes().select("id", "layer", "promoted_from", "version")


def _rising(t, name):
    store = GraphStore(t.spark, f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}")
    store.commit(nodes=t.rising)
    return store


@query("STR-08-documents", "SELECT doc_id, 'doc:' || substr(sha256(coalesce(text, '')), 1, 16) AS content_id, length(coalesce(text, ''))::BIGINT AS chars FROM documents")
def _(t):
    """Documents are assessed when they are new; scanned again with nothing changed, none is."""
    folder = f"{shared_dir(t.spark)}/assessed-{uuid.uuid4().hex}"
    for again in range(2):
        stream = _stream(t, "documents").select("doc_id", "text")
        jobs.assess_new(stream, folder, f"{folder}-log{again}", lambda new: documents.sufficiency(new).join(new.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars")), "doc_id")).awaitTermination()
    return jobs.assessed(t.spark, folder).select("doc_id", "content_id", "chars")


@query("STR-02", "SELECT event_id, value FROM events WHERE event_type IN ('purchase', 'signup') AND value >= 100")
def _(t):
    return events.drain(events.promotions(_stream(t), ["purchase", "signup"], 100).select("event_id", "value"), "str-02")


@query("STR-08", "SELECT doc_id, 'doc:' || substr(sha256(text), 1, 16) AS content_id FROM documents")
def _(t):
    from ..functions.text import content_id

    return events.drain(_stream(t, "documents").select("doc_id", content_id(F.col("text")).alias("content_id")), "str-08")


@query("STR-09", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    return events.drain(events.first_seen(_stream(t), ["user_id", "event_type"]).select("user_id", "event_type"), "str-09")


@query("SRC-08")
def _(t):
    return files.scan(t.spark, t.sf_dir, "*.parquet").select("category", "size")


@query("SRC-16", "SELECT event_id, event_type FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(t):
    path = f"{shared_dir(t.spark)}/audit-log-{uuid.uuid4().hex}"
    files.append_log(t.events.filter("event_id % 2 = 0"), path)
    files.append_log(t.events.filter("event_id % 2 = 1"), path)
    return files.recent_log(t.spark, path, 50, "error").select("event_id", "event_type")


@query("ALG-06")
def _(t):
    """Within-cluster sums of k-means for k = 2 .. 4 on standardized columns."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = VectorAssembler(inputCols=["l_quantity", "l_extendedprice", "l_discount"], outputCol="raw").transform(t.lineitem)
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(rows).transform(rows).select("features")
    costs = [(k, float(KMeans(k=k, seed=1, maxIter=10).fit(scaled).summary.trainingCost)) for k in (2, 3, 4)]
    return t.spark.createDataFrame(costs, "k int, cost double")


@query("ALG-07")
def _(t):
    """Explained variance of principal components."""
    from pyspark.ml.feature import PCA, VectorAssembler

    rows = VectorAssembler(inputCols=["l_quantity", "l_extendedprice", "l_discount"], outputCol="features").transform(t.lineitem)
    found = PCA(k=2, inputCol="features", outputCol="out").fit(rows).explainedVariance
    return t.spark.createDataFrame([(i, float(v)) for i, v in enumerate(found)], "component int, variance double")


_COUNTED = """q AS (SELECT 'e' || (user_id % 5) AS entity, ts, event_id, event_id % 3 > 0 AS hit, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS i FROM events),
  f(entity, i, ts, count, hits, misses, first, promoted, queries, good) AS (SELECT DISTINCT entity, 0::BIGINT, NULL::TIMESTAMP, 0, 0, 0, NULL::TIMESTAMP, false, 0, 0 FROM q UNION ALL
    SELECT entity, i, ts, CASE WHEN late THEN 1 WHEN up THEN 0 ELSE n END, CASE WHEN late OR up THEN 0 ELSE h END, CASE WHEN late OR up THEN 0 ELSE m END, CASE WHEN late THEN ts WHEN up THEN NULL ELSE began END, up, n, h FROM (
      SELECT *, NOT late AND n >= 10 AND h >= 0.5 * (h + m) AS up FROM (SELECT *, ts - began > INTERVAL 24 HOUR AS late FROM (SELECT q.entity, q.i, q.ts, f.count + 1 AS n, f.hits + q.hit::INT AS h, f.misses + (NOT q.hit)::INT AS m, coalesce(f.first, q.ts) AS began FROM f JOIN q ON q.entity = f.entity AND q.i = f.i + 1) a) b) c)"""


@query("STR-03", f"WITH RECURSIVE {_COUNTED} SELECT entity, ts, queries::BIGINT AS queries, good::BIGINT AS hits FROM f WHERE promoted")
def _(t):
    rows = _stream(t).select(F.concat(F.lit("e"), F.col("user_id") % 5).alias("entity"), "ts", F.col("event_id").alias("id"), (F.col("event_id") % 3 > 0).alias("hit"))
    return events.drain(state.promoted_by_frequency(rows, "entity"), "promoted")


_STEP = "CASE WHEN event_id % 5 < 2 THEN CASE WHEN event_id % 3 = 0 THEN -0.1 ELSE -0.05 END WHEN event_id % 5 > 2 THEN 0.02 ELSE 0.0 END"
_FOLDED = f"""WITH RECURSIVE s AS (SELECT user_id, {_STEP}::DOUBLE AS step, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  f(user_id, i, v) AS (SELECT DISTINCT user_id, 0::BIGINT, 0.5::DOUBLE FROM s UNION ALL SELECT f.user_id, s.i, least(greatest(v + step, 0.1), 1.0)::DOUBLE FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1)"""


@query("STR-05", f"""{_FOLDED}, c AS (SELECT user_id, count(*) AS feedbacks, count(*) FILTER (WHERE event_id % 5 < 2) AS negative, count(*) FILTER (WHERE event_id % 5 > 2) AS positive FROM events GROUP BY 1)
  SELECT f.user_id, round(arg_max(v, i), 6) AS value, any_value(feedbacks) AS feedbacks, any_value(negative) AS negative, any_value(positive) AS positive FROM f JOIN c ON c.user_id = f.user_id GROUP BY 1""")
def _(t):
    rows = t.events.select("user_id", "ts", "event_id", (1 + F.col("event_id") % 5).alias("rating"), F.when(F.col("event_id") % 3 == 0, "critical").otherwise("minor").alias("severity"))
    return feedback.propagated(rows, "user_id", ["ts", "event_id"]).withColumn("value", F.round("value", 6))


@query("STR-06", """WITH w AS (SELECT unnest(range(0, 7)) AS k), d AS (SELECT operation_type, ts::DATE - k::INT AS day, success, confidence FROM {predictions}, w)
  SELECT operation_type, day AS start, count(*) AS n, round(avg(success::INT), 6) AS success_rate, round(avg(confidence) - avg(success::INT), 6) AS calibration FROM d GROUP BY 1, 2""")
def _(t):
    rates = events.rolling_success(t.predictions.withColumn("ts", F.col("ts").cast("timestamp")), "operation_type")
    return rates.select("operation_type", F.col("window.start").cast("date").alias("start"), "n", F.round("success_rate", 6).alias("success_rate"), F.round(F.col("confidence") - F.col("success_rate"), 6).alias("calibration"))


@query("STR-07", "SELECT user_id, max(ts) AS last, 'degraded' AS state FROM events GROUP BY 1 HAVING epoch_ms(max(ts)) + 36 * 3600000 < (SELECT epoch_ms(max(ts)) FROM events)")
def _(t):
    return events.drain(state.silent(_stream(t).select("user_id", "ts"), "user_id", 36 * 3600.0), "silent")


@query("STR-10", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
  SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM s GROUP BY user_id, n""")
def _(t):
    return events.sessions(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "user_id").select("user_id", "started", "ended", "events")


@query("STR-06-drift", """WITH d AS (SELECT event_type, ts::DATE AS day, count(*) AS n, count(*) FILTER (WHERE ok) AS good, count(*) FILTER (WHERE sure) AS sure, count(*) FILTER (WHERE ok AND sure) AS sg
    FROM (SELECT event_type, ts, value / 500 > 0.8 AS sure, CASE WHEN ts >= TIMESTAMP '2024-01-18' THEN event_id % 4 = 0 ELSE event_id % 3 <> 0 END AS ok FROM events) GROUP BY 1, 2),
  closed AS (SELECT * FROM d WHERE day::TIMESTAMP + INTERVAL 3 DAY <= (SELECT max(ts) FROM events)),
  s AS (SELECT event_type, day, sum(n) OVER a AS n, sum(good) OVER a AS good, sum(sure) OVER a AS sure, sum(sg) OVER a AS sg, coalesce(sum(n) OVER b, 0) AS pn, coalesce(sum(good) OVER b, 0) AS pgood, coalesce(sum(sure) OVER b, 0) AS psure, coalesce(sum(sg) OVER b, 0) AS psg FROM closed
    WINDOW a AS (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), b AS (PARTITION BY event_type ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 7 DAY PRECEDING)),
  f AS (SELECT event_type, day, n::BIGINT AS recent, pn::BIGINT AS before, CASE WHEN n >= 10 AND pn >= 10 THEN greatest(0, pgood / greatest(pn, 1) - good / greatest(n, 1)) END AS x, CASE WHEN n >= 10 AND pn >= 10 THEN greatest(0, psg / greatest(psure, 1) - sg / greatest(sure, 1)) END AS y FROM s)
  SELECT event_type, day, recent, before, round(0.6 * x + 0.4 * y, 6) AS score, coalesce(round(0.6 * x + 0.4 * y, 6) > 0.15, false) AS drifted, CASE WHEN round(0.6 * x + 0.4 * y, 6) > 0.15 THEN concat_ws(',', CASE WHEN x > 0.1 THEN 'retrain' END, CASE WHEN y > 0.1 THEN 'recalibrate' END) ELSE '' END AS advice FROM f""")
def _(t):
    """Closed days of a stream of outcomes that get worse from a day on."""
    ok = F.when(F.col("ts") >= F.lit("2024-01-18").cast("timestamp"), F.col("event_id") % 4 == 0).otherwise(F.col("event_id") % 3 != 0)
    folder = f"{shared_dir(t.spark)}/drift-{uuid.uuid4().hex}"
    drift.run(_stream(t).select("event_type", "ts", (F.col("value") / 500).alias("confidence"), ok.alias("success")), "event_type", folder, f"{folder}-log").awaitTermination()
    return drift.found(t.spark, folder).select("event_type", "day", "recent", "before", "score", "drifted", F.array_join("advice", ",").alias("advice"))


@query("STR-10-episodes", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR AND lag(event_type) OVER w <> 'purchase' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g),
  e AS (SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS turns, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS topics, bool_or(event_type = 'purchase') AS bought FROM s GROUP BY user_id, n)
  SELECT user_id, started, ended, turns, topics, CASE WHEN bought THEN 'end' ELSE 'silence' END AS closed_by FROM e WHERE CASE WHEN bought THEN ended ELSE ended + INTERVAL 1 HOUR END <= (SELECT date_trunc('milliseconds', max(ts)) FROM events)""")
def _(t):
    """Sessions of users that a purchase or an hour of silence closes; those that are open at the end of the stream (by its watermark, in milliseconds) are not given yet."""
    turns = _stream(t).select("user_id", "ts", F.col("event_id").alias("id"), F.col("event_type").alias("kind"), (F.col("event_type") == "purchase").alias("is_end"))
    return events.drain(episodes.session_episodes(turns, "user_id"), "episodes").withColumn("topics", F.array_join("topics", ","))


@query("STR-10-turns", """WITH m AS (SELECT *, lead(role) OVER w AS r, lead(content) OVER w AS c FROM {messages} WINDOW w AS (PARTITION BY session_id ORDER BY seq))
  SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq)::INT AS turn, 'user: ' || content || chr(10) || 'assistant: ' || CASE WHEN r = 'assistant' THEN c ELSE '' END AS body FROM m WHERE role = 'user'""")
def _(t):
    return episodes.turn_episodes(t.messages)
