"""Facts and text functions as registered queries."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import facts, ontology
from .fixtures import query

_FACTS = """facts AS (SELECT sha256(m.chunk_id || ':' || string_agg(entity, ':' ORDER BY entity)) AS fact_id, m.chunk_id, list(entity ORDER BY entity) AS entities, count(*) AS n, round(avg(confidence), 6) AS confidence,
  CASE WHEN bool_or(medical) AND bool_or(medicine) THEN 'treatment' WHEN bool_or(causal) OR contains(lower(any_value(c.text)), 'causes') THEN 'causation' WHEN len(list_distinct(flatten(list(types)))) = 1 THEN 'hierarchical' ELSE 'association' END AS fact_type
  FROM (SELECT chunk_id, entity, avg(confidence) AS confidence, bool_or(lower(type) IN ('drug', 'disease')) AS medical, bool_or(lower(type) IN ('treatment', 'medication')) AS medicine, bool_or(lower(type) IN ('cause', 'effect')) AS causal, list(DISTINCT type) AS types FROM {fact_mentions} GROUP BY chunk_id, entity) m
  LEFT JOIN {chunks} c ON c.chunk_id = m.chunk_id GROUP BY m.chunk_id HAVING count(*) >= 2 AND round(avg(confidence), 9) >= 0.6),
  hyper AS (SELECT fact_id, confidence, unnest(entities) AS entity FROM facts)"""


def _facts(t):
    return facts.build(t.fact_mentions, t.chunks)


@query("JOIN-11", "SELECT chunk_id, string_agg(DISTINCT entity, ',' ORDER BY entity) AS entities, count(DISTINCT entity) AS n FROM {mentions} GROUP BY 1 HAVING count(DISTINCT entity) >= 2")
def _(t):
    return facts.entity_sets(t.mentions).withColumn("entities", F.array_join("entities", ","))


@query("JOIN-12", "SELECT a.type AS type_a, b.type AS type_b, count(*) AS n FROM {mentions} a JOIN {mentions} b ON a.chunk_id = b.chunk_id AND a.entity < b.entity GROUP BY 1, 2 HAVING count(*) > 5 ORDER BY n DESC, 1, 2 LIMIT 50")
def _(t):
    return facts.type_pairs(t.mentions)


@query("AGG-14", f"WITH {_FACTS} SELECT fact_id, chunk_id, n, confidence, fact_type FROM facts")
def _(t):
    return _facts(t).drop("entities")


@query("AGG-13", f"WITH {_FACTS} SELECT fact_type, count(*) AS facts, sum(n)::BIGINT AS participants, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (WHERE confidence >= 0.7) AS confident FROM facts GROUP BY 1")
def _(t):
    return facts.statistics(_facts(t))


@query("AGG-15", "SELECT chunk_id, round(sum(confidence * CASE type WHEN 'Drug' THEN 2.0 ELSE 1.0 END) / sum(CASE type WHEN 'Drug' THEN 2.0 ELSE 1.0 END), 6) AS confidence FROM {mentions} GROUP BY 1")
def _(t):
    w = F.when(F.col("type") == "Drug", 2.0).otherwise(1.0)
    return t.mentions.groupBy("chunk_id").agg(F.round(F.sum(F.col("confidence") * w) / F.sum(w), 6).alias("confidence"))


@query("AGG-16", "SELECT count(DISTINCT entity) AS entities, round(avg((type IN ('Drug', 'Disease'))::INT), 6) AS known_share FROM {mentions}")
def _(t):
    return t.mentions.agg(F.count_distinct("entity").alias("entities"), F.round(F.avg(F.col("type").isin("Drug", "Disease").cast("int")), 6).alias("known_share"))


@query("JOIN-17", f"""WITH {_FACTS}, s AS (SELECT DISTINCT entity FROM {{mentions}} WHERE doc_id = 1)
  SELECT a.entity AS e1, a.fact_id AS f1, b.entity AS bridge, c.fact_id AS f2, d.entity AS e2, round((a.confidence + c.confidence) / 2, 6) AS confidence FROM hyper a JOIN s USING (entity) JOIN hyper b ON a.fact_id = b.fact_id AND b.entity <> a.entity
  JOIN hyper c ON c.entity = b.entity AND c.fact_id <> a.fact_id JOIN hyper d ON d.fact_id = c.fact_id AND d.entity <> a.entity AND d.entity <> b.entity""")
def _(t):
    return facts.chains(facts.hyperedges(_facts(t)), t.mentions.filter("doc_id = 1"))


_FIRST = "(SELECT min(entity) FROM {mentions} WHERE doc_id = 1)"


@query("JOIN-18", f"""WITH {_FACTS} SELECT h.fact_id, h.confidence, string_agg(DISTINCT o.entity, ',' ORDER BY o.entity) AS others FROM hyper h LEFT JOIN hyper o ON o.fact_id = h.fact_id AND o.entity <> h.entity WHERE h.entity = (SELECT min(entity) FROM {{mentions}} WHERE doc_id = 1) GROUP BY 1, 2 ORDER BY confidence DESC, fact_id LIMIT 50""")
def _(t):
    first = t.mentions.filter("doc_id = 1").agg(F.min("entity")).first()[0]
    return facts.of_entity(facts.hyperedges(_facts(t)), first)


@query("JOIN-19", f"""WITH {_FACTS}, p AS (SELECT a.entity AS a, b.entity AS b, a.fact_id, a.confidence FROM hyper a JOIN hyper b ON a.fact_id = b.fact_id AND a.entity < b.entity WHERE a.confidence >= 0.7)
  SELECT a, b, arg_min(fact_id, (-confidence, fact_id)) AS fact_id, max(confidence) AS confidence FROM p GROUP BY a, b""")
def _(t):
    return facts.propagate(facts.hyperedges(_facts(t)), t.edges.select("src", "dst"), 0.7)


@query("FLT-21", f"WITH {_FACTS} SELECT fact_id, entity FROM hyper WHERE confidence >= 0.68 OR fact_id LIKE '0%'")
def _(t):
    made = _facts(t)
    return facts.cleanup(made, facts.hyperedges(made), made.filter("fact_id like '0%'"), 0.68)[1].select("fact_id", "entity")


@query("JOIN-14", "SELECT DISTINCT doc_id, entity, type FROM {mentions}")
def _(t):
    return facts.document_entities(t.chunks, t.mentions)


# The word tables in full, apart from the operator's.
_ABBREVIATED = "MAP {'id': 'identifier', 'pk': 'primary_key', 'fk': 'foreign_key', 'uq': 'unique', 'idx': 'index', 'seq': 'sequence', 'tbl': 'table', 'col': 'column', 'attr': 'attribute', 'rel': 'relationship', 'ref': 'reference', 'int': 'integer', 'bool': 'boolean', 'char': 'character', 'varchar': 'variable_character', 'txt': 'text', 'num': 'numeric', 'dec': 'decimal', 'dt': 'date', 'ts': 'timestamp', 'cust': 'customer', 'acct': 'account', 'addr': 'address', 'dept': 'department', 'emp': 'employee', 'mgr': 'manager', 'org': 'organization', 'prod': 'product', 'svc': 'service', 'qty': 'quantity', 'amt': 'amount', 'desc': 'description', 'cat': 'category', 'subcat': 'subcategory', 'pt': 'patient', 'dx': 'diagnosis', 'rx': 'prescription', 'tx': 'treatment', 'hx': 'history', 'sx': 'symptoms', 'med': 'medication', 'lab': 'laboratory', 'appt': 'appointment', 'hosp': 'hospital', 'prov': 'provider', 'ins': 'insurance', 'yr': 'year', 'mo': 'month', 'wk': 'week', 'dy': 'day', 'hr': 'hour', 'min': 'minute', 'sec': 'second'}"
_SYNONYM = "MAP {'client': 'customer', 'buyer': 'customer', 'consumer': 'customer', 'patron': 'customer', 'member': 'user', 'subscriber': 'user', 'participant': 'user', 'purchase': 'order', 'sale': 'order', 'transaction': 'order', 'item': 'product', 'article': 'product', 'merchandise': 'product', 'good': 'product', 'diagnosis': 'medical_diagnosis', 'condition': 'medical_condition', 'therapy': 'treatment', 'procedure': 'medical_procedure', 'created': 'creation_date', 'modified': 'modification_date', 'updated': 'modification_date'}"
_BASIC = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(term, '([a-z])([A-Z])', '\1_\2', 'g')), '\s+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '^_+|_+$', '', 'g'), '_+', '_', 'g')"
_FORMS = f"""words AS (SELECT {_ABBREVIATED} AS abbreviations, {_SYNONYM} AS synonyms), b AS (SELECT id, term, {_BASIC} AS basic FROM {{terms}}),
  x AS (SELECT id, term, basic, array_to_string(list_transform(string_split(basic, '_'), lambda w: coalesce(abbreviations[w], w)), '_') AS expanded, synonyms FROM b, words),
  forms AS (SELECT id, term, basic, expanded, coalesce(synonyms[expanded], array_to_string(list_transform(string_split(expanded, '_'), lambda w: coalesce(synonyms[w], w)), '_')) AS mapped FROM x)"""


@query("SCL-01", f"WITH {_FORMS} SELECT id, mapped AS key FROM forms")
def _(t):
    return t.terms.select("id", text.normalized_name(F.col("term")).alias("key"))


@query("SCL-02", f"""WITH {_FORMS} SELECT id, concat_ws(' | ', 'Original: ' || term, CASE WHEN basic <> term THEN 'Basic normalization: ' || basic END, CASE WHEN expanded <> basic THEN 'Abbreviation expansion: ' || expanded END,
  CASE WHEN mapped <> expanded THEN 'Synonym mapping: ' || mapped END, 'Final: ' || mapped) AS steps FROM forms""")
def _(t):
    return t.terms.select("id", F.array_join(text.trace(F.col("term")), " | ").alias("steps"))


@query("SCL-03", f"""WITH {_FORMS}, p AS (SELECT a.id AS id, a.mapped = b.mapped AS equivalent, string_split(a.mapped, '_') AS x, string_split(b.mapped, '_') AS y FROM forms a JOIN forms b ON a.id = 'part:' || split_part(b.id, ':', 2) AND b.id LIKE 'order:%' WHERE a.id LIKE 'part:%')
  SELECT id, equivalent, CASE WHEN equivalent THEN 1.0 ELSE round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 6) END AS similarity FROM p""")
def _(t):
    """Parts against the orders of their number."""
    key = F.split_part("id", F.lit(":"), F.lit(2))
    parts = t.terms.filter("id like 'part:%'").select("id", key.alias("k"), F.col("term").alias("x"))
    rows = parts.join(t.terms.filter("id like 'order:%'").select(key.alias("k"), F.col("term").alias("y")), "k")
    x, y = F.col("x"), F.col("y")
    return rows.select("id", (text.normalized_name(x) == text.normalized_name(y)).alias("equivalent"), F.round(text.term_similarity(x, y), 6).alias("similarity"))


_WHOLE = "MAP {'htn': 'hypertension', 'dm': 'diabetes mellitus', 'dm2': 'diabetes mellitus type 2', 't2dm': 'diabetes mellitus type 2', 'chf': 'congestive heart failure', 'copd': 'chronic obstructive pulmonary disease', 'ckd': 'chronic kidney disease', 'cad': 'coronary artery disease', 'afib': 'atrial fibrillation', 'mi': 'myocardial infarction', 'bp': 'blood pressure', 'hr': 'heart rate', 'rx': 'prescription', 'mg': 'milligrams', 'mcg': 'micrograms'}"
_ALIASES = "MAP {'medication': 'Medication', 'drug': 'Medication', 'medicine': 'Medication', 'diagnosis': 'Diagnosis', 'condition': 'Diagnosis', 'disease': 'Diagnosis', 'symptom': 'Symptom', 'allergy': 'Allergy', 'allergen': 'Allergy', 'patient': 'Patient', 'person': 'Patient', 'procedure': 'Procedure', 'treatment': 'Treatment', 'lab_result': 'LabResult', 'vital_sign': 'VitalSign', 'observation': 'Observation'}"


@query("SCL-04", rf"""WITH c AS (SELECT id, trim(regexp_replace(lower(term), '\s+', ' ', 'g')) AS x, coalesce(type, '') AS type FROM {{terms}})
  SELECT id, coalesce(({_WHOLE})[x], x) AS name, CASE WHEN type = '' THEN 'Entity' ELSE coalesce(({_ALIASES})[replace(lower(trim(type)), ' ', '_')], array_to_string(list_transform(regexp_extract_all(type, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '')) END AS type FROM c""")
def _(t):
    from ..operators.rules import ENTITY_TYPES, MEDICAL_ABBREVIATIONS

    return t.terms.select("id", text.entity_name(F.col("term"), MEDICAL_ABBREVIATIONS).alias("name"), text.entity_type(F.col("type"), ENTITY_TYPES).alias("type"))


_REGISTERED = """reg(canonical, class, type_layer, path, schema_type, area) AS (VALUES
  ('table', 'DataEntity', 'PERCEPTION', 'data_entity/table', 'Dataset', 'data_architecture'), ('data_product', 'InformationAsset', 'SEMANTIC', 'information_asset/data_product', 'Dataset', 'data_architecture'),
  ('domain', 'Domain', 'SEMANTIC', 'domain', 'Organization', 'data_architecture'), ('person', 'Domain', 'SEMANTIC', 'stakeholder/person', 'Person', 'data_architecture'),
  ('business_concept', 'BusinessConcept', 'REASONING', 'business_concept', 'DefinedTerm', 'data_architecture'), ('workflow', 'BusinessConcept', 'REASONING', 'business_concept/workflow', NULL, 'data_architecture'),
  ('kpi', 'DataQualityScore', 'APPLICATION', 'quality_score/kpi', NULL, 'data_architecture'), ('disease', 'Disease', 'SEMANTIC', 'clinical_concept/disease', NULL, 'medical'), ('drug', 'Drug', 'SEMANTIC', 'therapeutic_agent/drug', NULL, 'medical'),
  ('gene', 'Gene', 'REASONING', 'biological_mechanism/gene', NULL, 'medical'), ('organization', 'Organization', 'APPLICATION', 'clinical_knowledge/organization', NULL, 'medical'),
  ('biomarker', 'Biomarker', 'PERCEPTION', 'clinical_observation/biomarker', NULL, 'medical'), ('cell_type', 'CellType', 'SEMANTIC', 'biological_entity/cell_type', NULL, 'medical')),
  spelling(form, canonical) AS (SELECT canonical, canonical FROM reg UNION ALL VALUES ('medical_condition', 'disease'), ('tables', 'table'), ('data_steward', 'person'), ('biomarkers', 'biomarker'), ('kpis', 'kpi'), ('businessconcept', 'business_concept'), ('dataentity', 'table'))"""
RESOLVED = rf"""{_REGISTERED}, spelt AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(type, '')), '[- ]', '_', 'g'), '[^\pL\pN_]', '', 'g'), '_+', '_', 'g'), '_') AS form FROM {{typed}}),
  resolved AS (SELECT t.*, CASE WHEN t.form = '' THEN 'unknown' ELSE coalesce(a.canonical, b.canonical, c.canonical, t.form) END AS canonical, coalesce(a.canonical, b.canonical, c.canonical) IS NOT NULL AS known FROM spelt t LEFT JOIN spelling a ON a.form = t.form
    LEFT JOIN spelling b ON t.form LIKE '%s' AND length(t.form) > 2 AND b.form = left(t.form, -1) LEFT JOIN spelling c ON regexp_matches(t.form, '_(entity|concept|type)$') AND c.form = regexp_replace(t.form, '_(entity|concept|type)$', ''))"""


@query("SCL-05", f"WITH {RESOLVED} SELECT DISTINCT type, canonical, known AS is_known FROM resolved WHERE type IS NOT NULL")
def _(t):
    return ontology.resolved(t.typed.filter("type is not null").select("type").distinct())


@query("AGG-57", f"WITH {RESOLVED} SELECT type, count(*) AS n FROM resolved WHERE type IS NOT NULL AND NOT known GROUP BY 1")
def _(t):
    return ontology.unknown_types(t.typed)


@query("SCL-06", rf"""WITH {RESOLVED}, m AS (SELECT id, type, layer, r.canonical, known, coalesce(class, CASE WHEN lower(type) = 'lineage' THEN 'transformsInto' END) AS class, type_layer, path, schema_type, area,
    regexp_replace(coalesce(type, ''), '[ -]', '', 'g') AS own FROM resolved r LEFT JOIN reg ON reg.canonical = r.canonical), n AS (SELECT *, upper(own[1]) || own[2:] AS label FROM m)
  SELECT id, concat_ws(',', class, CASE WHEN schema_type <> class THEN schema_type END, CASE WHEN label <> '' AND label IS DISTINCT FROM class AND label IS DISTINCT FROM schema_type THEN label END) AS labels,
    canonical, known AS mapped, coalesce(area, 'unknown') AS domain, coalesce(layer, type_layer) AS layer, coalesce(path, '') AS path FROM n""")
def _(t):
    return ontology.mapped(t.typed).select(
        "id", F.array_join("ontology_labels", ",").alias("labels"), "canonical", F.col("ontology_mapped").alias("mapped"), F.col("ontology_domain").alias("domain"), "layer", F.array_join("hierarchy", "/").alias("path"))


@query("SCL-06-rollup", f"WITH {RESOLVED} SELECT ancestor, count(*) AS n FROM (SELECT unnest(string_split(path, '/')) AS ancestor FROM resolved r JOIN reg ON reg.canonical = r.canonical WHERE known) GROUP BY 1")
def _(t):
    """Entities under each type of the hierarchy."""
    return ontology.by_ancestor(t.typed)


@query("SCL-07", "SELECT id, replace(lower(trim(name)), ' ', '') AS key, regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g') AS label FROM {nodes}")
def _(t):
    return t.nodes.select("id", F.replace(F.lower(F.trim("name")), F.lit(" "), F.lit("")).alias("key"), text.safe_label(F.col("name")).alias("label"))


@query("SCL-10", "SELECT doc_id, (length(text) // 4)::BIGINT AS tokens, sha256(text) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", text.token_estimate(F.col("text")).alias("tokens"), F.sha2("text", 256).alias("digest"))


@query("SRC-13", "SELECT doc_id, 'doc:' || substr(sha256(text), 1, 16) AS content_id FROM documents")
def _(t):
    return t.documents.select("doc_id", text.content_id(F.col("text")).alias("content_id"))


@query("SCL-11", "SELECT chunk_id, count(DISTINCT entity) AS mentions, min(entity) AS first FROM {mentions} GROUP BY 1")
def _(t):
    return t.mentions.groupBy("chunk_id").agg(F.count_distinct("entity").alias("mentions"), F.min("entity").alias("first"))


@query("SCL-38", "SELECT doc_id, list_sum(list_transform(range(0, 256), lambda i: (('0x' || substr(sha256(text), (i % 32) * 2 + 1, 2))::INT - 128) / 128.0)) AS total FROM documents")
def _(t):
    return t.documents.select("doc_id", F.aggregate(text.hash_embedding(F.col("text")), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("AGG-43", "SELECT count(*) AS chunks, sum(length(text))::BIGINT AS total, round(avg(length(text)), 6) AS average, min(length(text))::INT AS least, max(length(text))::INT AS most FROM {chunks}")
def _(t):
    n = F.length("text")
    return t.chunks.agg(F.count("*").alias("chunks"), F.sum(n).alias("total"), F.round(F.avg(n), 6).alias("average"), F.min(n).alias("least"), F.max(n).alias("most"))


@query("AGG-11", "SELECT count(*) AS chunks, round(avg(length(text)), 6) AS average, sum(length(text))::BIGINT AS total, CASE WHEN count(*) > 10000 THEN 'high' WHEN count(*) > 1000 THEN 'medium' ELSE 'low' END AS risk FROM {chunks}")
def _(t):
    n = F.length("text")
    risk = F.when(F.count("*") > 10000, "high").when(F.count("*") > 1000, "medium").otherwise("low")
    return t.chunks.agg(F.count("*").alias("chunks"), F.round(F.avg(n), 6).alias("average"), F.sum(n).alias("total"), risk.alias("risk"))
