"""Message and question operators as registered queries."""

from pyspark.sql import functions as F

from ..functions import messages, text
from ..operators import rules
from .fixtures import REF_TIME, query

_QUOTED = lambda x: "'" + x.replace("'", "''") + "'"
_T = "lower(trim(coalesce(question, '')))"
# Letters with marks become digits on both sides, since SQL's word ends know ASCII letters only.
_ASCII = lambda x: f"translate({x}, 'áéíóúñü', '1234567')"
_FIRST = lambda table, otherwise: "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({_T}, {_QUOTED(p)})' for p in phrases)} THEN '{name}'" for name, phrases in table.items()) + f" ELSE {otherwise} END"
_MEDICAL = f"((regexp_matches({_T}, '^(what|how|why|can|should|is|does|do)') OR contains({_T}, '?')) AND ({' OR '.join(f'contains({_T}, {_QUOTED(w)})' for w in messages.MEDICAL_WORDS)}))"
_KIND = "CASE " + " ".join(f"WHEN {' OR '.join(f'regexp_matches({_T}, {_QUOTED(p)})' for p in patterns)} THEN '{name}'" for name, patterns in messages.KINDS.items()) + f" WHEN {_MEDICAL} THEN 'medical_query' ELSE 'unknown' END"
_TOPIC = "CASE " + " ".join(f"WHEN contains({_T}, '{w}') THEN '{w}'" for w in messages.TOPICS) + f" ELSE nullif(regexp_extract({_T}, '(?:^|\\s)my\\s+(\\S+)', 1), '') END"


@query("SCL-15", f"SELECT event_id, {_KIND} AS kind, {_TOPIC} AS topic, {_FIRST(messages.URGENCY, _QUOTED('medium'))} AS urgency, {_FIRST(messages.TONES, _QUOTED('neutral'))} AS tone, {_MEDICAL} AS medical FROM {{asked}}")
def _(t):
    q = F.col("question")
    return t.asked.select("event_id", messages.kind(q).alias("kind"), messages.topic(q).alias("topic"), messages.urgency(q).alias("urgency"), messages.tone(q).alias("tone"), messages.medical_question(q).alias("medical"))


_PATTERNS = ", ".join(f"({i}, '{name}', {_QUOTED(p)}, {kind})" for i, (name, both) in enumerate(messages.INTENTS.items()) for kind, phrases in enumerate(both) for p in phrases)
_ROUTES = ", ".join(f"('{name}', '{','.join(layers)}', '{strategy}')" for name, (layers, strategy) in messages.ROUTES.items())
_ROUTED = f"""p(pos, intent, phrase, free) AS (VALUES {_PATTERNS}), ways(intent, layers, strategy) AS (VALUES {_ROUTES}), q AS (SELECT DISTINCT question FROM {{asked}}), names AS (SELECT DISTINCT pos, intent FROM p),
  hits AS (SELECT question, pos, sum(0.3::DOUBLE + 0.2::DOUBLE * least(length(phrase) / 20::DOUBLE, 1)) AS score FROM q JOIN p ON CASE WHEN free = 1 THEN contains({_T}, phrase) ELSE regexp_matches({_ASCII(_T)}, '\\b' || {_ASCII('phrase')} || '\\b') END GROUP BY 1, 2),
  scores AS (SELECT q.question, n.pos, n.intent, least(coalesce(score, 0), 1)::DOUBLE AS score FROM q CROSS JOIN names n LEFT JOIN hits h ON h.pos = n.pos AND h.question IS NOT DISTINCT FROM q.question),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, pos) AS r, lead(score) OVER (PARTITION BY question ORDER BY score DESC, pos) AS following FROM scores),
  routed AS (SELECT question, intent, CASE WHEN score > 0 THEN least(score * (1 + score - following), 1) ELSE 0.3 END::DOUBLE AS confidence, layers, strategy FROM ranked JOIN ways USING (intent) WHERE r = 1)"""


def _routes(t):
    return t.asked.select("event_id", "question", messages.route(F.col("question")).alias("r")).select("event_id", "question", "r.*")


@query("SCL-16", f"WITH {_ROUTED} SELECT event_id, intent, round(confidence, 6) AS confidence, layers, strategy FROM {{asked}} a JOIN routed r ON a.question IS NOT DISTINCT FROM r.question")
def _(t):
    return _routes(t).select("event_id", "intent", F.round("confidence", 6).alias("confidence"), F.array_join("layers", ",").alias("layers"), "strategy")


_KNOWN = _FIRST(messages.QUESTION_KINDS, _QUOTED("general"))
_STRATEGY = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in messages.STRATEGIES.items())


@query("SCL-17", f"""WITH {_ROUTED}, k AS (SELECT event_id, question, {_KNOWN} AS kind, event_id % 3 AS found, CASE WHEN event_id % 2 = 0 THEN ['SEMANTIC'] ELSE ['SEMANTIC', 'REASONING', 'PERCEPTION'] END AS tried FROM {{asked}})
  SELECT event_id, kind, CASE kind {_STRATEGY} END AS strategy, CASE WHEN found = 0 THEN list_filter(list_concat(string_split(layers, ','), ['PERCEPTION', 'SEMANTIC', 'REASONING', 'APPLICATION']), lambda x: NOT list_contains(tried, x))[1] END AS next_layer
  FROM k JOIN routed r ON k.question IS NOT DISTINCT FROM r.question""")
def _(t):
    kind = messages.question_kind(F.col("question"))
    tried = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("SEMANTIC"))).otherwise(F.array(*map(F.lit, ("SEMANTIC", "REASONING", "PERCEPTION"))))
    return _routes(t).select("event_id", kind.alias("kind"), messages.strategy(kind).alias("strategy"), messages.next_layer(F.col("layers"), tried, F.col("event_id") % 3, rules.LAYERS).alias("next_layer"))


_PHRASES = ", ".join(f"({i}, {_QUOTED(p)}, '{name}')" for i, (p, name) in enumerate((p, name) for name, ps in messages.WINDOW_PHRASES.items() for p in ps))
_BANDS = "CASE " + " ".join(f"WHEN ago <= {h} THEN '{name}'" for name, h in messages.WINDOW_HOURS.items() if name != "historical") + " WHEN ago IS NOT NULL THEN 'historical' END"
_UNIT = lambda x: f"CASE {x}[1] WHEN 'h' THEN 1 WHEN 'd' THEN 24 WHEN 'w' THEN 168 WHEN 's' THEN 168 WHEN 'm' THEN 720 END"
_AGO = r"'(\d+)\s+(days|day|hours|hour|weeks|week|months|month)\s+ago'"
_HACE = r"'hace\s+(\d+)\s+(días|día|horas|hora|semanas|semana|meses|mes)'"


@query("SCL-22", f"""WITH w(pos, phrase, named) AS (VALUES {_PHRASES}), q AS (SELECT event_id, lower(coalesce(question, '')) AS t FROM {{asked}}),
  e AS (SELECT event_id, t, CASE WHEN regexp_matches(t, {_HACE}) THEN regexp_extract(t, {_HACE}, 1)::BIGINT * {_UNIT(f'regexp_extract(t, {_HACE}, 2)')} WHEN regexp_matches(t, {_AGO}) THEN regexp_extract(t, {_AGO}, 1)::BIGINT * {_UNIT(f'regexp_extract(t, {_AGO}, 2)')} END AS ago FROM q),
  n AS (SELECT event_id, arg_max(named, length(phrase) * 1000 - pos) AS named FROM q JOIN w ON contains(t, phrase) GROUP BY 1)
  SELECT event_id, coalesce({_BANDS}, named, 'short_term') AS window, CASE WHEN ago IS NOT NULL THEN 0.95 WHEN named IS NOT NULL THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence, ago FROM e LEFT JOIN n USING (event_id)""")
def _(t):
    return t.asked.select("event_id", messages.time_window(F.col("question")).alias("w")).select("event_id", "w.window", "w.confidence", "w.ago")


@query("SCL-14", "SELECT doc_id, array_to_string(list_transform(list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda w: length(w) > 2 AND w NOT IN (" + ", ".join(f"'{w}'" for w in messages.STOP_TERMS) + ")), lambda w: regexp_replace(w, '^[?.,!]+|[?.,!]+$', '', 'g'))[1:10], ' ') AS terms FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(messages.question_terms(F.col("text")), " ").alias("terms"))


@query("SCL-12", r"""WITH h AS (SELECT doc_id, list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda w: regexp_matches(trim(w), '^#{1,3}\s+.')), lambda w: trim(regexp_replace(trim(w), '^#{1,3}\s+', ''))) AS heads FROM documents),
  c AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[À-ÖØ-öø-ɏ]', '0', 'g'), '\b[A-Z][a-z]+(?: +[A-Z][a-z]+)*\b')) AS term FROM documents), n AS (SELECT doc_id, term, count(*) AS n FROM c GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS k FROM n), t AS (SELECT doc_id, list(term ORDER BY k) AS terms FROM r WHERE k <= 10 AND n >= 3 GROUP BY 1)
  SELECT doc_id, array_to_string(list_concat(heads, list_filter(coalesce(terms, []), lambda x: NOT list_contains(heads, x)))[1:20], '|') AS topics FROM h LEFT JOIN t USING (doc_id)""")
def _(t):
    return text.topics(t.documents).select("doc_id", F.array_join("topics", "|").alias("topics"))


@query("SCL-40", f"SELECT user_id, CASE WHEN {_TOPIC} IS NOT NULL THEN array_to_string(list_transform(string_split({_TOPIC}, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || CASE {_KIND} WHEN 'symptom_report' THEN ' Discussion' WHEN 'medical_query' THEN ' Query' ELSE '' END END AS title FROM (SELECT user_id, arg_min(coalesce(question, ''), ts) AS question FROM {{asked}} GROUP BY 1)")
def _(t):
    first = t.asked.groupBy("user_id").agg(F.min_by(F.coalesce("question", F.lit("")), "ts").alias("question"))
    return first.select("user_id", messages.title(F.col("question")).alias("title"))


@query("SCL-26", "SELECT event_id, CASE event_id % 26 WHEN 20 THEN 'fever' WHEN 24 THEN 'cough' END AS found FROM {asked}")
def _(t):
    return t.asked.select("event_id", messages.resolved_condition(F.col("question")).alias("found"))


@query("SCL-41", "SELECT user_id, arg_max(CASE event_id % 26 WHEN 18 THEN 'Pablo' WHEN 20 THEN 'Marta' ELSE 'Rosa' END, (CASE event_id % 26 WHEN 20 THEN 2 ELSE 3 END, ts, event_id)) AS name FROM {asked} WHERE event_id % 26 IN (18, 20, 23) GROUP BY 1")
def _(t):
    rows = t.asked.select("user_id", "ts", "event_id", F.explode(messages.given_names(F.col("question"), ("metformin",))).alias("n"))
    return rows.groupBy("user_id").agg(F.max_by("n.name", F.struct("n.priority", "ts", "event_id")).alias("name"))


@query("SCL-42", f"""WITH l AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'view') AS last, count(*) FILTER (WHERE event_type = 'signup') AS n, count(*) FILTER (WHERE event_type = 'error') AS m FROM events GROUP BY 1)
  SELECT user_id, date_diff('day', last::DATE, DATE '{REF_TIME[:10]}') AS days, (last IS NOT NULL)::INT + (user_id % 3 = 0)::INT + (user_id % 5 = 0)::INT + (n > 1)::INT + (m > 0)::INT AS signals, last IS NOT NULL OR user_id % 3 = 0 OR user_id % 5 = 0 OR n > 1 OR m > 0 AS returning_subject FROM l""")
def _(t):
    kind = lambda k: F.col("event_type") == k
    rows = t.events.groupBy("user_id").agg(F.max(F.when(kind("view"), F.col("ts"))).alias("last"), F.count_if(kind("signup")).alias("sessions"), F.count_if(kind("error")).alias("memories"))
    rows = rows.withColumns({"topics": F.when(F.col("user_id") % 3 == 0, F.array(F.lit("diet"))), "summary": F.when(F.col("user_id") % 5 == 0, "a summary of the session").otherwise("short")})
    return messages.returning(rows, REF_TIME).select("user_id", "days", "signals", "returning_subject")
