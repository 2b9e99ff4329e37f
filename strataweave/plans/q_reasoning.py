"""Reasoning, subject views and assertion operators as registered queries."""

import uuid

from pyspark.sql import functions as F

from ..functions import extension
from ..operators import clinical, documents, flags, reasoning, rules, validation
from ..session import shared_dir
from ..sources import schemas
from .fixtures import REF_TIME, query

_L = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
_HELD = lambda c, values: f"len(list_filter({_L(values)}, lambda w: contains({c}, w))) > 0"
_Q = "lower(coalesce(question, ''))"


@query("SCL-13", f"SELECT event_id, array_to_string(list_concat(list_filter({_L(reasoning.KEYWORDS)}, lambda w: contains({_Q}, w)), list_transform(regexp_extract_all({_Q}, '([a-z0-9_]+)\\s+pain', 1), lambda w: w || ' pain')), ',') AS topics FROM {{asked}}")
def _(t):
    return t.asked.select("event_id", F.array_join(reasoning.keywords(F.col("question")), ",").alias("topics"))


_KEYS = "map_keys(properties)"


@query("SCL-33", f"""WITH e AS (SELECT CASE WHEN k % 6 = 0 THEN id || '_id' ELSE id END AS id, CASE k % 4 WHEN 0 THEN ['name', 'email'] WHEN 1 THEN ['amount', 'created_date'] WHEN 2 THEN ['status', 'created_date'] ELSE ['other'] END AS keys FROM {{nodes}})
  SELECT id, 'property' AS kind, 'identifier' AS suggestion FROM e WHERE lower(id) LIKE '%id' UNION ALL SELECT id, 'property', 'person' FROM e WHERE {_HELD('lower(id)', ('user', 'customer', 'person'))} UNION ALL SELECT id, 'property', 'transaction' FROM e WHERE {_HELD('lower(id)', ('order', 'transaction', 'purchase'))}
  UNION ALL SELECT id, 'property', 'has_contact_info' FROM e WHERE list_contains(keys, 'email') UNION ALL SELECT id, 'property', 'is_temporal' FROM e WHERE list_contains(keys, 'created_date') UNION ALL SELECT id, 'class', 'person' FROM e WHERE list_has_all(keys, ['name', 'email'])
  UNION ALL SELECT id, 'class', 'financial' FROM e WHERE list_contains(keys, 'amount') UNION ALL SELECT id, 'class', 'process' FROM e WHERE list_has_all(keys, ['status', 'created_date']) UNION ALL SELECT id, 'relationship', 'HAS_EMAIL' FROM e WHERE list_contains(keys, 'email') UNION ALL SELECT id, 'relationship', 'CREATED_ON' FROM e WHERE list_contains(keys, 'created_date')""")
def _(t):
    k = F.col("k")
    keys = F.when(k % 4 == 0, F.array(F.lit("name"), F.lit("email"))).when(k % 4 == 1, F.array(F.lit("amount"), F.lit("created_date"))).when(k % 4 == 2, F.array(F.lit("status"), F.lit("created_date"))).otherwise(F.array(F.lit("other")))
    named = t.nodes.select(F.when(k % 6 == 0, F.concat("id", F.lit("_id"))).otherwise(F.col("id")).alias("id"), F.map_from_arrays(keys, F.transform(keys, lambda x: F.lit("v"))).alias("properties"))
    return reasoning.suggestions(named)


_CONCEPTS = ", ".join(f"('{c}', '{x}', {len(columns)})" for c, columns in reasoning.CONCEPT_COLUMNS.items() for x in columns)
_RULES = ", ".join(f"('{c}', '{r}')" for c, names in reasoning.QUALITY_RULES.items() for r in names)


@query("SCL-34", f"""WITH c(concept, part, size) AS (VALUES {_CONCEPTS}), q(concept, rule) AS (VALUES {_RULES}), h AS (SELECT schema, "table", concept, size, count(DISTINCT part) AS n FROM {{attributes}} a JOIN c ON contains(lower("column"), part) GROUP BY ALL)
  SELECT schema, "table", 'concept' AS kind, concept AS value FROM h WHERE n >= 0.25 * size UNION ALL SELECT schema, "table", 'rule', rule FROM h JOIN q USING (concept) WHERE n >= 0.25 * size
  UNION ALL SELECT schema, "table", 'domain', CASE {" ".join(f"WHEN {_HELD('lower(' + chr(34) + 'column' + chr(34) + ')', words)} THEN '{name}'" for name, words in reasoning.DOMAINS.items())} END FROM {{attributes}}""")
def _(t):
    found = reasoning.table_concepts(t.attributes, 0.25)
    rows = found.select("schema", "table", F.lit("concept").alias("kind"), F.col("concept").alias("value")).union(reasoning.quality_rules(found).select("schema", "table", F.lit("rule"), "rule"))
    return rows.union(t.attributes.select("schema", "table", F.lit("domain"), reasoning.column_domain(F.col("column"))))


_CHRONIC = ("crohn", "colitis", "lupus", "arthritis", "diabetes", "hypertension", "asthma")


@query("SCL-35", f"""WITH m AS (SELECT subject_id, conditions, list_concat(medications, CASE WHEN subject_id LIKE '%1' THEN ['Humira pen', 'prednisone'] ELSE [] END) AS meds FROM {{subjects}})
  SELECT subject_id, 'on_biologic_therapy' AS pattern FROM m WHERE len(list_filter(meds, lambda x: {_HELD('lower(x)', reasoning.DRUG_CLASSES['biologic'])})) > 0 UNION ALL SELECT subject_id, 'multi_drug_regimen' FROM m WHERE len(meds) > 2 AND len(list_filter(meds, lambda x: {_HELD('lower(x)', reasoning.DRUG_CLASSES['corticosteroid'])})) > 0
  UNION ALL SELECT subject_id, 'chronic_condition_management' FROM m WHERE len(list_filter(conditions, lambda x: {_HELD('lower(x)', _CHRONIC)})) > 0
  UNION ALL SELECT 'u' || user_id, unnest(list_filter([CASE WHEN {_HELD(_Q, reasoning.MISSED)} THEN 'adherence_concern' WHEN {_HELD(_Q, reasoning.TAKEN)} THEN 'adherence_positive' END, CASE WHEN {_HELD(_Q, reasoning.SIDE_EFFECTS)} THEN 'side_effect_concern' END], lambda x: x IS NOT NULL)) FROM {{asked}}""")
def _(t):
    more = F.when(F.col("subject_id").like("%1"), F.array(F.lit("Humira pen"), F.lit("prednisone"))).otherwise(F.array().cast("array<string>"))
    patterns = reasoning.treatment_patterns(t.subjects.withColumn("medications", F.concat("medications", more)), _CHRONIC)
    return patterns.union(t.asked.select(F.concat(F.lit("u"), "user_id"), F.explode(reasoning.concerns(F.col("question")))))


@query("SCL-36", f"SELECT id, CASE WHEN confidence >= 0.8 THEN 'valid' WHEN confidence < 0.6 THEN 'warn' ELSE 'review' END AS state FROM {{nodes}} UNION ALL SELECT 'q' || event_id, CASE WHEN {_HELD(_Q, reasoning.ADVICE_WORDS)} THEN 'advice' ELSE 'plain' END FROM {{asked}}")
def _(t):
    asked = t.asked.select(F.concat(F.lit("q"), "event_id"), F.when(reasoning.asks_for_advice(F.col("question")), "advice").otherwise("plain"))
    return t.nodes.select("id", reasoning.entity_state(F.col("confidence")).alias("state")).union(asked)


_PART = lambda kind, where: f"coalesce(string_agg(DISTINCT id, ',' ORDER BY id) FILTER (WHERE entity_type = '{kind}' AND {where}), '')"
_ACTIVE, _OVER = "(status IS NULL OR status IN ('active', 'chronic'))", "status = 'resolved'"


@query("JOIN-40", f"""WITH o AS (SELECT *, CASE observation_count % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'resolved' END AS status FROM {{observations}})
  SELECT user_id, {_PART('Diagnosis', _ACTIVE)} AS diagnoses, {_PART('Diagnosis', _OVER)} AS resolved, {_PART('Medication', _ACTIVE)} AS medications, {_PART('Symptom', f"last_observed >= TIMESTAMP '{REF_TIME}' - INTERVAL 30 DAY")} AS recent, {_PART('Symptom', f"last_observed < TIMESTAMP '{REF_TIME}' - INTERVAL 30 DAY")} AS historical FROM o GROUP BY user_id""")
def _(t):
    status = F.when(F.col("observation_count") % 3 == 0, "active").when(F.col("observation_count") % 3 == 1, "resolved")
    rows = t.observations.select("user_id", "entity_type", F.col("id").alias("name"), status.alias("status"), F.col("last_observed").alias("at"))
    part = lambda kind: rows.filter(F.col("entity_type") == kind)
    view = clinical.subject_view(t.observations.select("user_id").distinct(), "user_id", {"diagnoses": part("Diagnosis"), "medications": part("Medication"), "symptoms": part("Symptom")}, REF_TIME)
    join = lambda c: F.array_join(c, ",")
    return view.select("user_id", join("diagnoses.active").alias("diagnoses"), join("diagnoses.resolved").alias("resolved"), join("medications.active").alias("medications"), join("symptoms.recent").alias("recent"), join("symptoms.historical").alias("historical"))


@query("SET-05", """WITH d AS (SELECT dst, count(*) AS refs FROM {edges} GROUP BY dst), c AS (SELECT n.id, layer FROM {nodes} n LEFT JOIN d ON n.id = d.dst WHERE layer = 'PERCEPTION' AND (confidence >= 0.9 OR observation_count >= 10) OR layer = 'SEMANTIC' AND coalesce(refs, 0) >= 5)
  SELECT id, layer AS promoted_from, CASE layer WHEN 'PERCEPTION' THEN 'SEMANTIC' ELSE 'REASONING' END AS layer FROM c""")
def _(t):
    chosen = flags.promotion_candidates(t.nodes, t.edges)
    empty = F.create_map().cast("map<string,string>")
    promoted = validation.promote(t.nodes.withColumn("properties", empty), chosen)
    return promoted.filter("promoted_from is not null").select("id", "promoted_from", "layer")


@query("EXT-03", "SELECT subject_id, 'aspirin+warfarin' AS rule FROM {subjects} WHERE list_contains(medications, 'aspirin') AND list_contains(medications, 'warfarin') UNION ALL SELECT subject_id, 'tramadol+diazepam' FROM {subjects} WHERE list_contains(medications, 'Tramadol') AND list_contains(medications, 'diazepam')")
def _(t):
    table = clinical.rule_table(t.spark).filter("category = 'drug_pair'")
    table = clinical.switched(clinical.switched(table, ["lisinopril+potassium"], False), ["metformin+contrast"], True)
    table = clinical.with_rule(table, "aspirin", "warfarin", "drug_pair", "high")
    return clinical.drug_alerts(t.subjects, table).filter("rule <> 'warfarin+aspirin'")


@query("AGG-61", """WITH a(alias, canonical) AS (VALUES %s), r(canonical, layer) AS (VALUES %s), n AS (SELECT canonical, count(*) AS aliases FROM a GROUP BY 1), k AS (SELECT type, count(*) AS used FROM {nodes} WHERE type IS NOT NULL GROUP BY 1)
  SELECT layer, count(*) AS types, sum(coalesce(aliases, 0))::BIGINT AS aliases, sum(coalesce(used, 0))::BIGINT AS used FROM r LEFT JOIN n USING (canonical) LEFT JOIN k ON lower(k.type) = canonical GROUP BY layer""" % (", ".join(f"('{a}', '{c}')" for a, c in rules.TYPE_ALIASES.items()), ", ".join(f"('{r[1]}', '{r[2]}')" for r in {x[1]: x for x in rules.CANONICAL_TYPES}.values())))
def _(t):
    return validation.registry_statistics(t.nodes)


@query("WIN-11", "SELECT chunk_id, seq * 1000 AS start, (seq * 1000 + length(text))::BIGINT AS stop FROM {chunks}")
def _(t):
    return documents.chunk_places(t.documents.select("doc_id", "text"), t.chunks)


_CHECKS = [("contains", "the"), ("regex", "[0-9]+"), ("min_length", "500"), ("max_words", "50"), ("similar", "0.2"), ("json", "a")]


@query("EXT-07", r"""WITH t AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN '{"a": ' || doc_id || '}' ELSE text END AS text, text AS lag FROM documents), w AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS x, list_distinct(list_filter(string_split_regex(lower(lag), '\s+'), lambda x: x <> '')) AS y FROM t)
  SELECT id, 'contains:the' AS check, contains(lower(text), 'the') AS passed FROM t UNION ALL SELECT id, 'regex:[0-9]+', regexp_matches(text, '[0-9]+') FROM t UNION ALL SELECT id, 'min_length:500', length(text) >= 500 FROM t UNION ALL SELECT id, 'max_words:50', len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) <= 50 FROM t
  UNION ALL SELECT id, 'similar:0.2', len(list_intersect(x, y)) >= 0.2 * len(list_distinct(list_concat(x, y))) FROM w UNION ALL SELECT id, 'json:a', id % 7 = 0 FROM t""")
def _(t):
    made = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit('{"a": '), "doc_id", F.lit("}"))).otherwise(F.col("text"))
    return extension.assertions(t.documents.select(F.col("doc_id").alias("id"), made.alias("text"), F.col("text").alias("expected")), _CHECKS)


@query("EXT-01", r"SELECT p_partkey, regexp_replace(regexp_replace(replace(lower(p_name), 'widget', 'product'), '\bred\b', 'crimson', 'g'), '\s+', '_', 'g') AS normalized FROM part")
def _(t):
    table = [("widget", "product"), *extension.word_rules({"red": "crimson"}), (r"\s+", "_")]
    stored = extension.rules_from_text(extension.rules_to_text(table))
    return extension.apply_name_rules(t.part, stored, "p_name").select("p_partkey", "normalized")


@query("EXT-06", "SELECT doc_id, i * 800 AS start, substr(coalesce(text, ''), i * 800 + 1, 1000) AS text FROM (SELECT doc_id, text, unnest(range(0, greatest(length(coalesce(text, '')) - 201, 0) // 800 + 1)) AS i FROM documents) d")
def _(t):
    return t.documents.select("doc_id", F.explode(extension.pieces(F.col("text"), 1000, 200)).alias("p")).select("doc_id", "p.*")


@query("SRC-23", """SELECT 'sessions' AS name, count(*) AS n, count(DISTINCT session_id) AS keys FROM {sessions} UNION ALL SELECT 'messages', count(*), count(DISTINCT session_id) FROM {messages} UNION ALL SELECT 'feedback', count(*), count(DISTINCT feedback_id) FROM {feedback}
  UNION ALL SELECT 'documents', count(*), count(DISTINCT doc_id) FROM documents UNION ALL SELECT 'document_quality', count(*), count(DISTINCT doc_id) FROM {assessments} UNION ALL SELECT 'ontology_quality', count(DISTINCT day), count(DISTINCT day) FROM {assessments}
  UNION ALL SELECT 'audit_logs', count(*), count(DISTINCT event_id) FROM events UNION ALL SELECT 'query_analytics', count(DISTINCT query_text), count(DISTINCT query_text) FROM {feedback}""")
def _(t):
    """Each table is written with its fixed schema and read back."""
    text = lambda c: F.col(c).cast("string")
    rows = {
        "sessions": t.sessions, "messages": t.messages, "feedback": t.feedback, "documents": t.documents.select(text("doc_id").alias("document_id"), F.col("source").alias("category")),
        "document_quality": t.assessments.select(text("doc_id").alias("document_id"), "score", "level"), "ontology_quality": t.assessments.groupBy(text("day").alias("assessment_id")).agg(F.avg("score").alias("score")),
        "audit_logs": t.events.select(text("event_id").alias("event_id"), "event_type", "ts"), "query_analytics": t.feedback.groupBy(F.md5("query_text").alias("query_hash")).agg(F.count("*").alias("executions"), F.max("created_at").alias("last_seen")),
    }
    path, out = f"{shared_dir(t.spark)}/tables-{uuid.uuid4().hex}", None
    for name, schema in schemas.TABLES.items():
        schemas.conformed(rows[name], schema).write.parquet(f"{path}/{name}")
        stored = t.spark.read.schema(schema).parquet(f"{path}/{name}")
        one = stored.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count_distinct(schema.fields[0].name).alias("keys"))
        out = one if out is None else out.union(one)
    return out
