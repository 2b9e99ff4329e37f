"""Filters and flags as registered queries."""

from pyspark.sql import functions as F

from ..operators import flags, measures, rules
from .fixtures import query

_IN = lambda values: ", ".join(f"'{v}'" for v in values)
_STRUCTURAL = "list_has_any(labels, [%s])" % _IN(rules.STRUCTURAL_LABELS)
_RULES = ", ".join(f"({i}, '{step}', '{kind}', '{v}', '{canonical}', '{layer}')" for i, (step, canonical, layer, types, labels) in enumerate(rules.CANONICAL_TYPES, 1) for kind, values in (("type", types), ("label", labels)) for v in values)
_MATCH = f"""rules(priority, step, kind, value, canonical_type, target_layer) AS (VALUES {_RULES}),
  vals AS (SELECT id, layer, labels, 'type' AS kind, type AS value FROM {{nodes}} UNION ALL SELECT id, layer, labels, 'label', unnest(labels) FROM {{nodes}}),
  hits AS (SELECT v.id, v.layer, r.* FROM vals v JOIN rules r USING (kind, value) WHERE NOT (step = 'table' AND list_has_any(labels, ['Chunk', 'Document', 'ExtractedEntity'])))"""
_NORMAL = "CASE x {} ELSE x END".format(" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.TYPE_ALIASES.items())).replace(" x ", " lower(trim(translate(type, '- ', '__'))) ").replace("ELSE x", "ELSE lower(trim(translate(type, '- ', '__')))")


@query("FLT-01", "SELECT label, count(*) AS count FROM (SELECT unnest(labels) AS label FROM {noisy}) x WHERE label IN ('Chunk', 'StructuralChunk', 'Document', 'DocumentQuality', 'ExtractedEntity', 'ConversationSession', 'Message') GROUP BY 1")
def _(t):
    return flags.structural_counts(t.noisy)


@query("FLT-02", """SELECT id, CASE WHEN length(name) < 3 THEN 'short_name' WHEN lower(trim(name)) IN ('the', 'a', 'an', 'and', 'or', 'is', 'are', 'was', 'were', 'this', 'that', 'these', 'those', 'it', 'its', 'however', 'therefore', 'thus', 'hence', 'also', 'although', 'because', 'since', 'while', 'but', 'yet', 'so', 'for', 'nor', 'be', 'been', 'being', 'have', 'has', 'had', 'do', 'does', 'did', 'will', 'would', 'could', 'should', 'may', 'might', 'must', 'can', 'not', 'no', 'none', 'all', 'any', 'some', 'of', 'in', 'on', 'at', 'to', 'from', 'by', 'with', 'as', 'if', 'then', 'else', 'when', 'where', 'which', 'who') THEN 'stopword' END AS noise_reason
  FROM {noisy} WHERE NOT list_has_any(labels, ['Chunk', 'StructuralChunk', 'Document', 'DocumentQuality', 'ExtractedEntity', 'ConversationSession', 'Message'])""")
def _(t):
    return flags.mark_noise(t.noisy).filter(~flags.is_structural()).select("id", "noise_reason")


@query("FLT-03", "SELECT id, NULL::VARCHAR AS status FROM {nodes}")
def _(t):
    return flags.reset_flags(t.nodes, "status").select("id", "status")


@query("FLT-04", "SELECT id, layer FROM {noisy} WHERE NOT is_structural AND NOT exclude_from_ontology AND NOT list_has_any(labels, ['Chunk', 'StructuralChunk', 'Document', 'DocumentQuality', 'ConversationSession', 'Message'])")
def _(t):
    return flags.knowledge(t.noisy).select("id", "layer")


@query("FLT-05", "SELECT id, name, layer FROM {noisy} WHERE layer IS NOT NULL AND layer NOT IN ('PERCEPTION', 'SEMANTIC', 'REASONING', 'APPLICATION')")
def _(t):
    return flags.invalid_layers(t.noisy).select("id", "name", "layer")


@query("FLT-06", "SELECT id, CASE WHEN type IS NULL THEN 'type' ELSE 'layer' END AS missing FROM {nodes} WHERE type IS NULL OR layer IS NULL")
def _(t):
    return flags.missing_type_or_layer(t.nodes).select("id", "missing")


@query("FLT-07", "SELECT id, layer, confidence FROM {nodes} WHERE (layer = 'SEMANTIC' AND confidence < 0.85) OR (layer = 'REASONING' AND confidence < 0.9)")
def _(t):
    return flags.low_confidence(t.nodes).select("id", "layer", "confidence")


_FIRST = "first AS (SELECT id, step, canonical_type, coalesce(layer, target_layer) AS layer FROM hits QUALIFY row_number() OVER (PARTITION BY id ORDER BY priority) = 1)"


@query("FLT-08", f"WITH {_MATCH}, {_FIRST} SELECT * FROM first")
def _(t):
    return flags.canonicalize(t.nodes)


_PLAIN = f"NOT {_STRUCTURAL}"
_REVIEW = f"{_PLAIN} AND NOT (length(name) < 3 OR lower(trim(name)) IN ({_IN(rules.STOPWORDS)}))"


@query("FLT-09", f"""WITH {_MATCH}, steps AS (SELECT DISTINCT step FROM rules UNION ALL VALUES ('conversation_structural'), ('null_type_inference'), ('null_type_review'), ('unknown_type_review'), ('orphan_flagging')),
  touched AS (SELECT step, id FROM hits UNION ALL SELECT 'conversation_structural', id FROM {{nodes}} WHERE list_has_any(labels, ['ConversationSession', 'Message']) UNION ALL SELECT 'null_type_inference', id FROM {{nodes}} WHERE type IS NULL AND {_PLAIN} AND list_has_any(labels, [{_IN(rules.INFERRING_LABELS)}])
    UNION ALL SELECT 'null_type_review', id FROM {{nodes}} WHERE type IS NULL AND {_REVIEW} UNION ALL SELECT 'unknown_type_review', id FROM {{nodes}} WHERE lower(type) = 'unknown' AND {_REVIEW}
    UNION ALL SELECT 'orphan_flagging', id FROM {{nodes}} WHERE {_PLAIN} AND id NOT IN (SELECT src FROM {{edges}} UNION SELECT dst FROM {{edges}}))
  SELECT step, count(DISTINCT id) AS n FROM steps LEFT JOIN touched USING (step) GROUP BY step""")
def _(t):
    return flags.canonicalize_dry_run(t.nodes, t.edges)


@query("FLT-10", "SELECT id, lower(list_filter(labels, lambda x: x IN ('DataEntity', 'Organization', 'Domain'))[1]) AS inferred_type FROM {nodes} WHERE type IS NULL")
def _(t):
    return flags.infer_type(t.nodes, ("DataEntity", "Organization", "Domain")).select("id", "inferred_type")


@query("FLT-11", "SELECT id, CASE WHEN type IS NULL THEN 'null_type' ELSE 'unknown_type' END AS review_reason FROM {nodes} WHERE type IS NULL OR lower(type) = 'unknown'")
def _(t):
    return flags.review_reasons(t.nodes).select("id", "review_reason")


@query("FLT-13", f"WITH {_MATCH}, {_FIRST} SELECT id, {_NORMAL} AS canonical_type FROM {{nodes}} JOIN first USING (id) WHERE type IS NOT NULL AND {_NORMAL} <> canonical_type")
def _(t):
    mapped = t.nodes.select("id", "type").join(flags.canonicalize(t.nodes).select("id", "canonical_type"), "id")
    return flags.normalize_types(mapped).select("id", "canonical_type")


@query("FLT-14", "SELECT id, id IN (SELECT id FROM {nodes} WHERE k % 19 = 0) AS dismissed FROM {nodes}")
def _(t):
    return flags.dismiss(t.nodes, t.nodes.filter("k % 19 = 0")).select("id", "dismissed")


@query("FLT-15", """SELECT id, name, description FROM (SELECT id, name, labels[1] AS type, properties['description'] AS description FROM {entities}) e
  WHERE type IN ('Domain', 'BusinessConcept', 'DataEntity') AND (contains(lower(name), 'ext') OR contains(lower(description), 'ext')) ORDER BY name, id LIMIT 50""")
def _(t):
    rows = t.entities.select("id", "name", F.col("labels")[0].alias("type"), F.try_element_at("properties", F.lit("description")).alias("description"))
    return flags.search(rows, "EXT", ("Domain", "BusinessConcept", "DataEntity")).select("id", "name", "description")


@query("FLT-16", "SELECT doc_id, source FROM documents WHERE lang IN ('de', 'fr') AND source ILIKE '%RC1%'")
def _(t):
    return t.documents.filter(F.col("lang").isin("de", "fr") & F.col("source").ilike("%RC1%")).select("doc_id", "source")


@query("FLT-17", "SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(lower(text), 'email|phone|ssn|password|address') THEN 'PII' END, CASE WHEN regexp_matches(lower(text), 'patient|health|medical|disease') THEN 'HEALTH' END, CASE WHEN regexp_matches(lower(text), 'customer|client|order') THEN 'CUSTOMER' END) AS tags FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(flags.text_tags(F.coalesce("text", F.lit(""))), ",").alias("tags"))


_GOVERNANCE = (("typed", "type is not null", "needs a type"), ("confident", "confidence >= 0.6", "needs confidence"), ("layered", "layer is not null", "needs a layer"))


@query("FLT-18", "SELECT id, 'typed' AS rule, 'needs a type' AS message FROM {nodes} WHERE type IS NULL UNION ALL SELECT id, 'confident', 'needs confidence' FROM {nodes} WHERE NOT coalesce(confidence >= 0.6, false) UNION ALL SELECT id, 'layered', 'needs a layer' FROM {nodes} WHERE layer IS NULL")
def _(t):
    return flags.violations(t.nodes, _GOVERNANCE)


@query("FLT-19", """WITH c AS (SELECT "column" AS name, "table" AS table_name, CASE "column" WHEN 'email' THEN 'PII' WHEN 'memo' THEN 'open' END AS classification, "column" = 'customer_name' AS is_pii FROM {attributes}),
  e AS (SELECT src, dst, CASE rel_type WHEN 'SUPPLIES' THEN 'FLOWS_TO' WHEN 'PLACED' THEN 'TRANSFORMS_INTO' ELSE rel_type END AS rel_type FROM {edges})
  SELECT 'pii_data' AS view, name AS a, table_name AS b, classification AS c, NULL::BIGINT AS n FROM c WHERE is_pii OR classification = 'PII'
  UNION ALL SELECT 'lineage', p.name, rel_type, q.name, NULL FROM e JOIN {nodes} p ON src = p.id JOIN {nodes} q ON dst = q.id WHERE rel_type IN ('FLOWS_TO', 'TRANSFORMS_INTO')
  UNION ALL SELECT 'domain_summary', array_to_string(labels, ','), NULL, NULL, count(*) FROM {nodes} WHERE layer = 'SEMANTIC' GROUP BY labels""")
def _(t):
    """Sales and orders stand for lineage."""
    kind = F.when(F.col("column") == "email", "PII").when(F.col("column") == "memo", "open")
    columns = t.attributes.select(F.col("column").alias("name"), F.col("table").alias("table_name"), kind.alias("classification"), (F.col("column") == "customer_name").alias("is_pii"))
    edges = t.edges.withColumn("rel_type", F.when(F.col("rel_type") == "SUPPLIES", "FLOWS_TO").when(F.col("rel_type") == "PLACED", "TRANSFORMS_INTO").otherwise(F.col("rel_type")))
    views = measures.named_views(columns, t.nodes, edges)
    none, text = F.lit(None).cast("long").alias("n"), lambda x: F.lit(x).cast("string")
    rows = views["pii_data"].select(F.lit("pii_data").alias("view"), F.col("name").alias("a"), F.col("table_name").alias("b"), F.col("classification").alias("c"), none)
    rows = rows.union(views["lineage"].select(F.lit("lineage"), "source", "rel_type", "target", none))
    return rows.union(views["domain_summary"].select(F.lit("domain_summary"), F.array_join("type", ","), text(None), text(None), "n"))


@query("FLT-20", "WITH gone AS (SELECT src AS id FROM {edges} WHERE dst = 'customer:8' UNION SELECT dst FROM {edges} WHERE src = 'customer:8' UNION SELECT 'customer:8') SELECT src, rel_type, dst FROM {edges} WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) AND rel_type = 'PLACED'")
def _(t):
    return flags.erase_subject(t.nodes, t.edges, "customer:8")[1].filter("rel_type = 'PLACED'").select("src", "rel_type", "dst")


@query("FLT-22", "SELECT id, CASE WHEN NOT list_has_any(labels, ['InformationAsset']) THEN layer END AS layer FROM {nodes}")
def _(t):
    return flags.drop_layer(t.nodes, ["InformationAsset"]).select("id", "layer")


@query("FLT-23", """WITH d AS (SELECT dst, count(*) AS refs FROM {edges} GROUP BY dst), j AS (SELECT n.*, coalesce(d.refs, 0) AS refs FROM {nodes} n LEFT JOIN d ON n.id = d.dst),
  t AS (SELECT id, confidence, refs AS "references", CASE WHEN layer = 'PERCEPTION' AND confidence >= 0.9 THEN 'confidence' WHEN layer = 'PERCEPTION' AND observation_count >= 10 THEN 'observations' WHEN layer = 'SEMANTIC' AND refs >= 5 THEN 'references' END AS trigger FROM j)
  SELECT * FROM t WHERE trigger IS NOT NULL""")
def _(t):
    return flags.promotion_candidates(t.nodes, t.edges).select("id", "confidence", "references", "trigger")


@query("FLT-24", "SELECT type, count(*) AS n FROM {nodes} WHERE NOT list_has_any(labels, ['Domain', 'Organization']) GROUP BY type")
def _(t):
    return flags.unmapped(t.nodes, ("Domain", "Organization"))


@query("FLT-25", "SELECT id, status FROM {nodes} WHERE status IS NULL OR status IN ('active', 'chronic')")
def _(t):
    return flags.active(t.nodes).select("id", "status")


@query("FLT-27", "SELECT feedback_id, 'b1' AS batch_id FROM {feedback} WHERE NOT used_for_training ORDER BY created_at, feedback_id LIMIT 500")
def _(t):
    return flags.training_batch(t.feedback, 500, "b1").select("feedback_id", "batch_id")


@query("FLT-28", "SELECT id, type IS NOT NULL AS has_type, layer IS NOT NULL AS has_layer, status IS NOT NULL AS has_status FROM {nodes} WHERE type IS NULL OR layer IS NULL OR status IS NULL")
def _(t):
    return flags.required_flags(t.nodes, ("type", "layer", "status")).select("id", "has_type", "has_layer", "has_status")


@query("FLT-29", """WITH m AS (SELECT session_id, count(*) AS c, count(*) FILTER (WHERE contains(lower(content), 'this')) AS h, count(*) FILTER (WHERE contains(content, 'this')) AS x FROM {messages} GROUP BY 1),
  a AS (SELECT 'any case' AS form, session_id, CASE WHEN contains(lower(title), 'this') THEN coalesce(c, 0) ELSE h END AS matches, coalesce(c, 0) AS message_count FROM {titled} LEFT JOIN m USING (session_id) WHERE contains(lower(title), 'this') OR h > 0 ORDER BY last_activity DESC, session_id LIMIT 20),
  b AS (SELECT 'exact' AS form, session_id, CASE WHEN contains(title, 'this') THEN c ELSE x END AS matches, c AS message_count FROM {titled} JOIN m USING (session_id) WHERE contains(title, 'this') OR x > 0 ORDER BY matches DESC, session_id LIMIT 20)
  SELECT * FROM a UNION ALL SELECT * FROM b""")
def _(t):
    found = [flags.search_sessions(t.titled, t.messages, text, exact, 20).select(F.lit("exact" if exact else "any case").alias("form"), "session_id", "matches", "message_count") for text, exact in (("THIS", False), ("this", True))]
    return found[0].union(found[1])
