"""Feedback, session and temporal operators as registered queries."""

from pyspark.sql import functions as F

from ..functions import temporal
from ..operators import feedback, graph, rules
from .fixtures import REF_TIME, query

_CASE = lambda i: "CASE entity_type " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in rules.DECAY.items()) + f" ELSE {rules.DEFAULT_DECAY[i]} END::DOUBLE"
_RATES, _FLOOR = f"(ln(2.0::DOUBLE) / {_CASE(0)})", _CASE(1)
_HOURS = f"(epoch_us(TIMESTAMP '{REF_TIME}') - epoch_us(last_observed)) / 3600000000.0"
_SCORE = f"least(greatest(exp(-{_RATES} * greatest({_HOURS}, 0)), {_FLOOR}) * (1 + least(0.3 * ln(observation_count + 1), 1.0)), 1.0)"


def _scored(t):
    score = temporal.relevance(F.col("entity_type"), F.col("last_observed"), F.col("observation_count"), REF_TIME)
    return t.observations.withColumn("raw", score).withColumn("score", F.round("raw", 6))


@query("SCL-20", f"SELECT id, entity_type, round({_SCORE}, 6) AS score FROM {{observations}}")
def _(t):
    return _scored(t).select("id", "entity_type", "score")


@query("SCL-21", f"SELECT id, CASE WHEN {_SCORE} >= 0.8 THEN 'current' WHEN {_SCORE} >= 0.5 THEN 'recent' WHEN {_SCORE} >= 0.2 THEN 'fading' ELSE 'stale' END AS category, CASE WHEN {_FLOOR} >= 0.3 THEN 'infinity'::DOUBLE ELSE round(-ln(0.3::DOUBLE) / {_RATES}, 4) END AS hours FROM {{observations}}")
def _(t):
    return _scored(t).select("id", temporal.relevance_category(F.col("raw")).alias("category"), F.round(temporal.hours_until(F.col("entity_type"), 0.3), 4).alias("hours"))


@query("SCL-24", f"SELECT id, CASE WHEN {_HOURS} <= 168 THEN 'recent' ELSE 'stale' END AS freshness FROM {{observations}}")
def _(t):
    return t.observations.select("id", temporal.freshness(F.col("last_observed"), REF_TIME).alias("freshness"))


@query("SCL-23", f"SELECT id, round({_SCORE}, 6) AS score FROM {{observations}} WHERE last_observed >= TIMESTAMP '2024-01-20 00:00:00' AND last_observed < TIMESTAMP '2024-01-28 00:00:00'")
def _(t):
    return _scored(t).filter("last_observed >= timestamp '2024-01-20 00:00:00' and last_observed < timestamp '2024-01-28 00:00:00'").select("id", "score")


@query("TOP-05", f"SELECT id, round({_SCORE}, 6) AS score FROM {{observations}} WHERE {_SCORE} >= 0.05 ORDER BY score DESC, id")
def _(t):
    return _scored(t).filter("raw >= 0.05").orderBy(F.desc("score"), "id").select("id", "score")


@query("SCL-27", "SELECT id, round(greatest(confidence * pow(0.9, k % 6), 0.1), 6) AS decayed, round(confidence * 0.3 + (k % 10) / 10.0 * 0.7, 6) AS blended, round(confidence * CASE layer WHEN 'PERCEPTION' THEN 0.7 WHEN 'SEMANTIC' THEN 0.85 WHEN 'REASONING' THEN 0.9 WHEN 'APPLICATION' THEN 1.0 ELSE 0.5 END, 6) AS adjusted FROM {nodes}")
def _(t):
    c = F.col("confidence")
    return t.nodes.select("id", F.round(temporal.decayed_confidence(c, F.col("k") % 6), 6).alias("decayed"), F.round(temporal.blended(c, F.col("k") % 10 / 10, 0.3), 6).alias("blended"), F.round(temporal.layer_adjusted(c, F.col("layer")), 6).alias("adjusted"))


_W = lambda l, c: f"({c} * CASE {l} WHEN 'PERCEPTION' THEN 0.7 WHEN 'SEMANTIC' THEN 0.85 WHEN 'REASONING' THEN 0.9 WHEN 'APPLICATION' THEN 1.0 ELSE 0.5 END)"  # noqa: E731, E741
_R = lambda l: f"coalesce(list_position(['PERCEPTION', 'SEMANTIC', 'REASONING', 'APPLICATION'], {l}), 0)"  # noqa: E731, E741


@query("SCL-28", f"""SELECT a.id, CASE WHEN abs({_W('a.layer', 'a.confidence')} - {_W('b.layer', 'b.confidence')}) > 0.3 THEN CASE WHEN {_W('a.layer', 'a.confidence')} > {_W('b.layer', 'b.confidence')} THEN a.layer ELSE b.layer END
  WHEN {_R('a.layer')} >= {_R('b.layer')} THEN a.layer ELSE b.layer END AS layer FROM {{nodes}} a JOIN {{nodes}} b ON b.id = split_part(a.id, ':', 1) || ':' || (a.k + 1) WHERE a.layer IS NOT NULL AND b.layer IS NOT NULL""")
def _(t):
    a = t.nodes.filter("layer is not null").withColumn("kind", F.substring_index("id", ":", 1))
    b = a.select("kind", (F.col("k") - 1).alias("k"), F.col("layer").alias("other"), F.col("confidence").alias("other_confidence"))
    return a.join(b, ["kind", "k"]).select("id", temporal.resolve_layers(F.col("layer"), F.col("confidence"), F.col("other"), F.col("other_confidence")).alias("layer"))


@query("AGG-30", "SELECT count(*) AS total, round(avg(rating), 6) AS mean_rating, " + ", ".join(f"count(*) FILTER (WHERE rating = {r}) AS rating_{r}" for r in range(1, 6)) + """, count(correction_text) AS corrections, count(*) FILTER (WHERE rating >= 4) AS positives, count(*) FILTER (WHERE rating <= 2) AS negatives,
  (SELECT string_agg(feedback_type || ':' || n, ',' ORDER BY n DESC, feedback_type) FROM (SELECT feedback_type, count(*) AS n FROM {feedback} WHERE feedback_type IS NOT NULL GROUP BY 1) k) AS types FROM {feedback}""")
def _(t):
    return feedback.statistics(t.feedback)


@query("AGG-31", """WITH f0 AS (SELECT CASE WHEN feedback_id % 4 = 0 THEN ['APPLICATION', 'PERCEPTION'] ELSE layers END AS layers, CASE WHEN feedback_id % 2 = 0 AND rating < 5 THEN rating + 1 ELSE rating END AS rating,
    CASE feedback_type WHEN 'click' THEN 'incorrect' WHEN 'view' THEN 'missing_info' WHEN 'purchase' THEN 'partially_correct' WHEN 'signup' THEN 'unhelpful' ELSE feedback_type END AS feedback_type FROM {feedback}),
  r AS (SELECT unnest(layers) AS layer, rating, feedback_type FROM f0), f AS (SELECT layer, feedback_type, row_number() OVER (PARTITION BY layer ORDER BY count(*) DESC, feedback_type) AS rank FROM r WHERE rating <= 2 GROUP BY layer, feedback_type),
  n AS (SELECT layer, string_agg(feedback_type, ',' ORDER BY rank) AS failures, list(feedback_type) AS kinds FROM f WHERE rank <= 5 GROUP BY layer),
  l AS (SELECT layer, count(*) AS total, avg(rating) AS mean, round(avg((rating <= 2)::INT), 6) AS negative_rate FROM r GROUP BY layer)
  SELECT layer, total, round(mean, 6) AS mean_rating, negative_rate, failures, concat_ws('; ', CASE WHEN mean < 3 THEN 'Critical: ' || layer || ' layer needs significant improvement' END,
    CASE WHEN layer = 'PERCEPTION' AND list_contains(kinds, 'incorrect') THEN 'Improve entity extraction accuracy from source documents' END, CASE WHEN layer = 'PERCEPTION' AND list_contains(kinds, 'missing_info') THEN 'Expand document coverage for better information retrieval' END,
    CASE WHEN layer = 'SEMANTIC' AND list_contains(kinds, 'incorrect') THEN 'Review ontology mappings for accuracy' END, CASE WHEN layer = 'SEMANTIC' AND list_contains(kinds, 'partially_correct') THEN 'Improve concept disambiguation' END,
    CASE WHEN layer = 'REASONING' AND list_contains(kinds, 'incorrect') THEN 'Review inference rules for logical consistency' END, CASE WHEN layer = 'REASONING' AND list_contains(kinds, 'unhelpful') THEN 'Improve relevance scoring in reasoning' END,
    CASE WHEN layer = 'APPLICATION' AND mean < 4 THEN 'Consider retraining with recent preference data' END) AS suggestions FROM l LEFT JOIN n USING (layer)""")
def _(t):
    kinds = {"click": "incorrect", "view": "missing_info", "purchase": "partially_correct", "signup": "unhelpful"}
    kind = F.coalesce(*(F.when(F.col("feedback_type") == k, v) for k, v in kinds.items()), F.col("feedback_type"))
    layers = F.when(F.col("feedback_id") % 4 == 0, F.array(F.lit("APPLICATION"), F.lit("PERCEPTION"))).otherwise(F.col("layers"))
    rating = F.when((F.col("feedback_id") % 2 == 0) & (F.col("rating") < 5), F.col("rating") + 1).otherwise(F.col("rating"))
    return feedback.layer_performance(t.feedback.withColumns({"feedback_type": kind, "layers": layers, "rating": rating}))


@query("AGG-32", "SELECT operation_type, count(*) FILTER (WHERE success) AS successes, count(*) FILTER (WHERE NOT success) AS failures, round(avg(confidence), 6) AS mean_confidence FROM {predictions} GROUP BY 1")
def _(t):
    return feedback.operations(t.predictions)


_BINS = "bins AS (SELECT least(floor(confidence * 5), 4)::INT AS bin, count(*) AS n, avg(confidence) AS c, avg(success::INT) AS a FROM {predictions} GROUP BY 1)"


@query("AGG-33", f"WITH {_BINS} SELECT bin, n, round(c, 6) AS mean_confidence, round(a, 6) AS accuracy, round(abs(c - a), 6) AS error FROM bins")
def _(t):
    return feedback.calibration(t.predictions)


@query("AGG-34", f"""WITH s AS (SELECT ts >= TIMESTAMP '{REF_TIME}' - INTERVAL 7 DAY AS r, success::INT AS ok, confidence > 0.8 AS sure FROM {{predictions}}),
  d AS (SELECT count(*) FILTER (WHERE r) AS recent, count(*) FILTER (WHERE NOT r) AS before, greatest(0, coalesce(avg(ok) FILTER (WHERE NOT r), 0) - coalesce(avg(ok) FILTER (WHERE r), 0)) AS d1,
    greatest(0, coalesce(avg(ok) FILTER (WHERE NOT r AND sure), 0) - coalesce(avg(ok) FILTER (WHERE r AND sure), 0)) AS d2 FROM s)
  SELECT recent, before, CASE WHEN recent >= 10 AND before >= 10 THEN round(0.6 * d1 + 0.4 * d2, 6) END AS score, CASE WHEN recent >= 10 AND before >= 10 THEN round(0.6 * d1 + 0.4 * d2, 6) > 0.15 END AS drifted FROM d""")
def _(t):
    return feedback.drift(t.predictions, REF_TIME)


@query("AGG-35", "SELECT split_part(action, ' ', 3) AS pattern, count(*) AS support, round(avg(success::INT), 6) AS share FROM {predictions} WHERE confidence >= 0.8 GROUP BY 1 HAVING count(*) >= 5 AND avg(success::INT) >= 0.6")
def _(t):
    return feedback.patterns(t.predictions, share=0.6)


@query("AGG-36", "SELECT user_id, min(confidence) AS least, max(confidence) AS most, avg(confidence) AS average, sum(observation_count * confidence) / sum(observation_count) AS weighted, product(confidence) AS product, 1 - product(1 - confidence) AS noisy_or FROM {observations} GROUP BY 1")
def _(t):
    return feedback.aggregate_confidence(t.observations, "user_id", weight=F.col("observation_count"))


@query("AGG-37", "WITH s AS (SELECT labels[1] AS class, greatest(confidence * CASE layer WHEN 'PERCEPTION' THEN 0.7 WHEN 'SEMANTIC' THEN 0.85 WHEN 'REASONING' THEN 0.9 WHEN 'APPLICATION' THEN 1.0 ELSE 0.5 END, 0.1) AS s, observation_count + 1 AS w FROM {nodes}) SELECT class, round(sum(s * w) / sum(w), 6) AS confidence FROM s GROUP BY class")
def _(t):
    s = F.greatest(temporal.layer_adjusted(F.col("confidence"), F.col("layer")), F.lit(0.1))
    rows = t.nodes.select(F.col("labels")[0].alias("class"), s.alias("s"), (F.col("observation_count") + 1).alias("w"))
    return rows.groupBy("class").agg(F.round(F.sum(F.col("s") * F.col("w")) / F.sum("w"), 6).alias("confidence"))


@query("AGG-38", """WITH p AS (SELECT lower(name) AS key, max(confidence) FILTER (WHERE layer = 'PERCEPTION') AS p, max(confidence) FILTER (WHERE layer = 'SEMANTIC') AS s, max(confidence) FILTER (WHERE layer = 'REASONING') AS r, max(confidence) FILTER (WHERE layer = 'APPLICATION') AS a
    FROM (SELECT name, layer, CASE WHEN k % 7 = 0 THEN confidence / 2 ELSE confidence END AS confidence, k FROM {nodes}) n WHERE layer IS NOT NULL GROUP BY 1)
  SELECT key, round(greatest(p, s, r, a) - least(p, s, r, a), 9) > 0.5 OR coalesce(round(p - s, 9) > 0.2, false) OR coalesce(round(p - r, 9) > 0.2, false) OR coalesce(round(p - a, 9) > 0.2, false) OR coalesce(round(s - r, 9) > 0.2, false) OR coalesce(round(s - a, 9) > 0.2, false) OR coalesce(round(r - a, 9) > 0.2, false) AS review FROM p""")
def _(t):
    rows = t.nodes.select(F.lower("name").alias("key"), "layer", F.when(F.col("k") % 7 == 0, F.col("confidence") / 2).otherwise(F.col("confidence")).alias("confidence"))
    return feedback.review_needed(rows)


@query("AGG-39", "SELECT operation_type, round(arg_min(confidence, (ts, operation_id)), 6) AS first, round(arg_max(confidence, (ts, operation_id)), 6) AS last, round(min(confidence), 6) AS least, round(max(confidence), 6) AS most, round(avg(confidence), 6) AS mean, CASE WHEN arg_max(confidence, (ts, operation_id)) > arg_min(confidence, (ts, operation_id)) THEN 'up' ELSE 'down' END AS trend FROM {predictions} GROUP BY 1")
def _(t):
    at, c = F.struct("ts", "operation_id"), F.col("confidence")
    rows = t.predictions.groupBy("operation_type").agg(F.min_by(c, at).alias("f"), F.max_by(c, at).alias("l"), F.min(c).alias("a"), F.max(c).alias("b"), F.avg(c).alias("m"))
    return rows.select("operation_type", *(F.round(x, 6).alias(y) for x, y in (("f", "first"), ("l", "last"), ("a", "least"), ("b", "most"), ("m", "mean"))), F.when(F.col("l") > F.col("f"), "up").otherwise("down").alias("trend"))


_RANKED = "ranked AS (SELECT session_id, rating, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, feedback_id DESC) AS rank FROM {feedback})"


@query("WIN-06", f"""WITH {_RANKED}, m AS (SELECT session_id, avg(rating) FILTER (WHERE rank <= 10) AS last, avg(rating) FILTER (WHERE rank > 10) AS previous FROM ranked WHERE rank <= 20 GROUP BY 1)
  SELECT session_id, round(last, 6) AS last, round(previous, 6) AS previous, CASE WHEN last - previous IS NULL THEN 'insufficient' WHEN last - previous > 0.2 THEN 'improving' WHEN last - previous < -0.2 THEN 'declining' ELSE 'stable' END AS trend FROM m""")
def _(t):
    return feedback.rating_trend(t.feedback, "session_id")


@query("WIN-07", """WITH r AS (SELECT operation_type, confidence, row_number() OVER (PARTITION BY operation_type ORDER BY ts DESC, operation_id DESC) AS rank FROM {predictions}), e AS (SELECT operation_type, arg_max(confidence, rank) AS f, arg_min(confidence, rank) AS l FROM r WHERE rank <= 5 GROUP BY 1)
  SELECT operation_type, round(f, 6) AS first, round(l, 6) AS last, CASE WHEN l > f * 1.1 THEN 'up' WHEN l < f * 0.9 THEN 'down' ELSE 'stable' END AS trend FROM e""")
def _(t):
    return feedback.confidence_trend(t.predictions, "operation_type")


@query("WIN-01", "SELECT session_id, role, content, min(ts) AS ts FROM {messages} GROUP BY 1, 2, 3")
def _(t):
    return feedback.first_messages(t.messages).select("session_id", "role", "content", "ts")


@query("WIN-02", "SELECT doc_id % 50 AS key, max(day) AS day, max(doc_id) AS doc_id FROM (SELECT *, rank() OVER (PARTITION BY doc_id % 50 ORDER BY day DESC, doc_id DESC) AS r FROM {assessments}) a WHERE r = 1 GROUP BY 1")
def _(t):
    return feedback.latest(t.assessments.withColumn("key", F.col("doc_id") % 50), "key", [F.desc("day"), F.desc("doc_id")]).select("key", "day", "doc_id")


@query("JOIN-27", "SELECT doc_id % 50 AS key, doc_id, day FROM (SELECT *, rank() OVER (PARTITION BY doc_id % 50 ORDER BY day DESC) AS r FROM {assessments}) a WHERE r = 1")
def _(t):
    return feedback.latest(t.assessments.withColumn("key", F.col("doc_id") % 50), "key", [F.desc("day")]).select("key", "doc_id", "day")


@query("WIN-09", "WITH c AS (SELECT session_id, count(*) AS n, max(ts) AS last FROM {messages} GROUP BY 1) SELECT s.session_id, coalesce(n, 0) AS messages, coalesce(last, started) AS last FROM {sessions} s LEFT JOIN c USING (session_id) ORDER BY last DESC, session_id LIMIT 50")
def _(t):
    return feedback.session_overview(t.sessions, t.messages).orderBy(F.desc("last"), "session_id").limit(50).select("session_id", "messages", "last")


@query("WIN-10", "SELECT subject_id, min(m) AS medication FROM (SELECT subject_id, unnest(medications) AS m FROM {subjects}) x GROUP BY subject_id, lower(m)")
def _(t):
    rows = t.subjects.select("subject_id", F.explode("medications").alias("medication"))
    return rows.groupBy("subject_id", F.lower("medication").alias("key")).agg(F.min("medication").alias("medication")).drop("key")


@query("WIN-12", "SELECT feedback_id, query_text FROM {feedback} QUALIFY row_number() OVER (PARTITION BY md5(lower(trim(query_text))) ORDER BY created_at, feedback_id) = 1")
def _(t):
    return feedback.dedup_examples(t.feedback, F.col("query_text"), ["created_at", "feedback_id"]).select("feedback_id", "query_text")


@query("WIN-13", "SELECT feedback_id, query_text, lag(feedback_id) OVER (PARTITION BY query_text ORDER BY created_at, feedback_id) AS previous FROM {feedback}")
def _(t):
    from pyspark.sql import Window

    return t.feedback.select("feedback_id", "query_text", F.lag("feedback_id").over(Window.partitionBy("query_text").orderBy("created_at", "feedback_id")).alias("previous"))


@query("WIN-14", "SELECT operation_id, lag(confidence) OVER w AS previous, lead(confidence) OVER w IS NULL AS active FROM {predictions} WINDOW w AS (PARTITION BY operation_type ORDER BY ts, operation_id)")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("operation_type").orderBy("ts", "operation_id")
    return t.predictions.select("operation_id", F.lag("confidence").over(w).alias("previous"), F.lead("confidence").over(w).isNull().alias("active"))


@query("VAL-12", """WITH f AS (SELECT 'order:' || (1 + feedback_id % 600)::VARCHAR AS id, count(*) AS feedbacks, count(*) FILTER (WHERE rating <= 2) AS negatives FROM {feedback} GROUP BY 1 HAVING count(*) >= 5 AND count(*) FILTER (WHERE rating <= 2) >= 3)
  SELECT id, CASE layer WHEN 'APPLICATION' THEN 'REASONING' WHEN 'REASONING' THEN 'SEMANTIC' ELSE 'PERCEPTION' END AS layer, layer AS previous_layer, CASE WHEN confidence > 0.3 THEN confidence - 0.2 ELSE 0.1 END AS confidence, feedbacks, negatives FROM {nodes} JOIN f USING (id) WHERE layer IN ('APPLICATION', 'REASONING', 'SEMANTIC')""")
def _(t):
    """Events as feedback on the first orders."""
    return feedback.demotions(t.nodes, t.feedback.withColumn("entity", F.concat(F.lit("order:"), (1 + F.col("feedback_id") % 600).cast("string"))))


@query("JOIN-32", """SELECT a.query_text, a.feedback_id AS chosen_id, b.feedback_id AS rejected_id, a.rating - b.rating AS gap FROM {feedback} a JOIN {feedback} b ON a.query_text = b.query_text AND a.rating - b.rating >= 2 AND a.response_text <> b.response_text
  ORDER BY gap DESC, chosen_id, rejected_id LIMIT 1000""")
def _(t):
    return feedback.rating_pairs(t.feedback).select("query_text", "chosen_id", "rejected_id", "gap")


@query("SCL-19", "SELECT feedback_id, query_text AS prompt, correction_text AS chosen, response_text AS rejected FROM {feedback} WHERE correction_text IS NOT NULL AND rating <= 3")
def _(t):
    return feedback.correction_pairs(t.feedback)


@query("SET-01", """WITH p AS (SELECT 1 AS rank, feedback_id, query_text, correction_text AS chosen FROM {feedback} WHERE correction_text IS NOT NULL AND rating <= 3 UNION ALL SELECT 2, feedback_id, query_text, response_text FROM {feedback} WHERE rating >= 4)
  SELECT rank, feedback_id, query_text FROM p QUALIFY row_number() OVER (PARTITION BY md5(lower(trim(query_text))) ORDER BY rank, feedback_id) = 1""")
def _(t):
    corrections = feedback.correction_pairs(t.feedback).select(F.lit(1).alias("rank"), "feedback_id", F.col("prompt").alias("query_text"), "chosen")
    high = t.feedback.filter("rating >= 4").select(F.lit(2).alias("rank"), "feedback_id", "query_text", F.col("response_text").alias("chosen"))
    return feedback.dedup_examples(corrections.unionByName(high), F.col("query_text"), ["rank", "feedback_id"]).select("rank", "feedback_id", "query_text")


@query("TOP-08", "SELECT feedback_id, rating FROM {feedback} WHERE rating <= 2 ORDER BY rating, created_at, feedback_id LIMIT 100")
def _(t):
    return t.feedback.filter("rating <= 2").orderBy("rating", "created_at", "feedback_id").limit(100).select("feedback_id", "rating")


@query("TOP-09", "SELECT feedback_id, correction_text FROM {feedback} WHERE correction_text IS NOT NULL ORDER BY created_at DESC, feedback_id LIMIT 50")
def _(t):
    return t.feedback.filter("correction_text is not null").orderBy(F.desc("created_at"), "feedback_id").limit(50).select("feedback_id", "correction_text")


@query("TOP-11", "SELECT session_id, seq, role FROM {messages} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, seq DESC) <= 3")
def _(t):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("seq")))
    return t.messages.withColumn("rank", rank).filter("rank <= 3").select("session_id", "seq", "role")


@query("SRC-18", "WITH h AS (SELECT feedback_id, ('0x' || substr(md5('0:' || feedback_id::VARCHAR), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS h FROM {feedback}) SELECT feedback_id, CASE WHEN h >= 0.95 THEN 'test' WHEN h >= 0.9 THEN 'validation' ELSE 'train' END AS split FROM h")
def _(t):
    return feedback.split(t.feedback, "feedback_id", {"train": 0.9, "validation": 0.05, "test": 0.05}).select("feedback_id", "split")


@query("AGG-07", "SELECT CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' WHEN confidence >= 0.5 THEN 'low' ELSE 'very_low' END AS band, count(*) AS n FROM {edges} GROUP BY 1")
def _(t):
    from ..operators.rules import CONFIDENCE_BANDS

    return t.edges.groupBy(graph.banded(F.col("confidence"), CONFIDENCE_BANDS, "very_low").alias("band")).agg(F.count("*").alias("n"))


@query("JOIN-36", "WITH f AS (SELECT session_id, count(*) AS n, round(avg(rating), 6) AS mean FROM {feedback} GROUP BY 1), s AS (SELECT DISTINCT 's' || user_id::VARCHAR AS session_id FROM events UNION SELECT 's-none') SELECT session_id, coalesce(n, 0) AS feedbacks, mean FROM s LEFT JOIN f USING (session_id)")
def _(t):
    sessions = t.events.select(F.concat(F.lit("s"), "user_id").alias("session_id")).union(t.spark.range(1).select(F.lit("s-none"))).distinct()
    counts = t.feedback.groupBy("session_id").agg(F.count("*").alias("feedbacks"), F.round(F.avg("rating"), 6).alias("mean"))
    return sessions.join(counts, "session_id", "left").withColumn("feedbacks", F.coalesce("feedbacks", F.lit(0)))
