"""Clinical, validation and ranking operators as registered queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import temporal
from ..operators import clinical, nearest, resolve, rules, shapes, validation
from .fixtures import REF_TIME, query

_T = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
_SUBJECT = """d AS (SELECT DISTINCT subject_id, lower(unnest(medications)) AS drug FROM {subjects}), c AS (SELECT DISTINCT subject_id, lower(unnest(conditions)) AS condition FROM {subjects}), a AS (SELECT DISTINCT subject_id, lower(unnest(allergies)) AS allergen FROM {subjects}), s AS (SELECT DISTINCT subject_id, lower(unnest(symptoms)) AS symptom FROM {subjects})"""
_PATTERNS = [(n, v, x, len(s), least) for n, v, s, least in rules.SYMPTOM_PATTERNS for x in s]


@query("JOIN-28", f"""WITH {_SUBJECT}, dp(x, y, severity) AS (VALUES {_T(rules.DRUG_PAIRS)}), dc(x, y, severity) AS (VALUES {_T(rules.DRUG_CONDITIONS)}), cr(x, y, severity) AS (VALUES {_T(rules.CROSS_REACTIONS)}), sp(pattern, severity, symptom, size, least) AS (VALUES {_T(_PATTERNS)})
  SELECT p.subject_id, 'drug_pair' AS rule, x || '+' || y AS detail, severity, 1.0::DOUBLE AS confidence FROM d p JOIN dp ON p.drug = x JOIN d q ON q.subject_id = p.subject_id AND q.drug = y
  UNION ALL SELECT d.subject_id, 'drug_condition', x || '+' || y, severity, 1.0 FROM d JOIN dc ON drug = x JOIN c ON c.subject_id = d.subject_id AND condition = y
  UNION ALL SELECT d.subject_id, 'cross_reaction', x || '+' || y, severity, 1.0 FROM a JOIN cr ON allergen = x JOIN d ON d.subject_id = a.subject_id AND drug = y
  UNION ALL SELECT subject_id, 'symptom_pattern', pattern, severity, round(least(1.0, count(DISTINCT sp.symptom) / size), 6) FROM s JOIN sp ON contains(s.symptom, sp.symptom) GROUP BY subject_id, pattern, severity, size, least HAVING count(DISTINCT sp.symptom) >= least""")
def _(t):
    return clinical.alerts(t.subjects)


@query("JOIN-29", f"WITH {_SUBJECT}, k(x, y) AS (VALUES {_T([tuple(sorted(p)) for p in rules.CONTRAINDICATED])}) SELECT d.subject_id, 'allergy' AS kind, drug AS detail FROM d JOIN a USING (subject_id) WHERE contains(lower(drug), lower(allergen)) UNION ALL SELECT p.subject_id, 'pair', x || '+' || y FROM d p JOIN k ON p.drug = x JOIN d q ON q.subject_id = p.subject_id AND q.drug = y")
def _(t):
    return clinical.contraindications(t.subjects)


_LABELLED = "CASE " + " ".join(f"WHEN x IN ({', '.join(repr(n) for n in names)}) THEN '{layer}'" for layer, names in rules.LAYER_LABELS.items()) + " END"
_PROP = lambda name: f"properties['{name}']"
_HAS = lambda names: f"list_has_any(map_keys(properties), [{', '.join(repr(n) for n in names)}])"
_ERRORS = "concat_ws(',', CASE WHEN id = '' THEN 'missing_id' END, CASE WHEN layer IS NULL THEN 'no_layer' END)"
_WARNINGS = f"""concat_ws(',', CASE WHEN length(id) > 100 THEN 'long_id' END, CASE WHEN contains(id, ' ') THEN 'blank_in_id' END, CASE WHEN id IN ('null', 'none', 'undefined', '') THEN 'empty_id' END, CASE WHEN contains(id, '<') THEN 'special_in_id' END,
  CASE WHEN len(list_filter(map_keys(properties), lambda x: trim(x) = '')) > 0 THEN 'blank_property' END, CASE WHEN len(list_filter(map_keys(properties), lambda x: lower(x) IN ('id', '_id', 'type', '_type', 'label', '_label'))) > 0 THEN 'reserved_property' END,
  CASE WHEN len(list_filter(map_values(properties), lambda x: x IS NULL)) > 0 THEN 'null_property' END, CASE WHEN len(list_filter(map_values(properties), lambda x: length(x) > 1000)) > 0 THEN 'large_property' END,
  CASE WHEN layer <> list_filter(list_transform(labels, lambda x: {_LABELLED}), lambda x: x IS NOT NULL)[1] THEN 'unusual_layer' END,
  CASE WHEN layer = 'REASONING' THEN CASE WHEN {_PROP('confidence')} IS NULL THEN 'no_confidence' WHEN NOT {_PROP('confidence')}::DOUBLE BETWEEN 0 AND 1 THEN 'bad_confidence' END END,
  {", ".join(f"CASE WHEN layer = '{layer}' AND NOT {_HAS(names)} THEN 'no_{names[0]}' END" for layer, names in rules.LAYER_PROPERTIES.items())})"""


@query("VAL-01", f"SELECT id, {_ERRORS} AS errors, {_WARNINGS} AS warnings, {_ERRORS} = '' AS is_valid FROM {{entities}}")
def _(t):
    return validation.validate_entities(t.entities)


@query("VAL-02", "SELECT src, rel_type, dst, CASE WHEN rel_type NOT IN ('PLACED', 'SUPPLIES') THEN 'not_permitted' ELSE '' END AS errors, rel_type IN ('PLACED', 'SUPPLIES') AS is_valid FROM {edges}")
def _(t):
    return validation.validate_relationships(t.edges, {"editor": ("PLACED", "SUPPLIES")}, "editor")


@query("VAL-03", f"SELECT count(*) FILTER (WHERE {_ERRORS} = '') AS valid, count(*) FILTER (WHERE {_ERRORS} <> '') AS invalid FROM {{entities}}")
def _(t):
    return validation.summary(validation.validate_entities(t.entities))


# Spelled out from the model's shapes, apart from the operator's table.
_SHAPES = """counts(shape, label, path, least, most) AS (VALUES ('DataEntity', 'DataEntity', 'name', 1, NULL), ('DataEntity', 'DataEntity', 'origin', 1, NULL), ('InformationAsset', 'InformationAsset', 'derivedFrom', 1, NULL), ('BusinessConcept', 'BusinessConcept', 'description', 1, NULL),
    ('Column', 'Column', 'name', 1, NULL), ('Column', 'Column', 'belongsTo', 1, 1), ('Column', 'Column', 'hasDataType', 1, 1), ('Table', 'Table', 'name', 1, NULL), ('Table', 'Table', 'belongsTo', 1, 1), ('Table', 'Table', 'hasColumn', 1, NULL),
    ('Constraint', 'Constraint', 'name', 1, NULL), ('Constraint', 'Constraint', 'constraintType', 1, NULL), ('Constraint', 'Constraint', 'appliesTo', 1, NULL), ('Relationship', 'Relationship', 'source', 1, 1), ('Relationship', 'Relationship', 'target', 1, 1), ('Relationship', 'Relationship', 'relationshipType', 1, NULL),
    ('Domain', 'Domain', 'name', 1, NULL), ('Domain', 'Domain', 'description', 1, NULL), ('TypeAssignment', 'TypeAssignment', 'column', 1, 1), ('TypeAssignment', 'TypeAssignment', 'dataType', 1, 1), ('Schema', 'Schema', 'name', 1, NULL), ('Schema', 'Schema', 'belongsTo', 1, 1), ('Catalog', 'Catalog', 'name', 1, NULL),
    ('DataQualityRule', 'DataQualityRule', 'name', 1, NULL), ('DataQualityRule', 'DataQualityRule', 'expression', 1, NULL), ('DataQualityRule', 'DataQualityRule', 'dimension', 1, NULL)),
  types(shape, label, path, expected) AS (VALUES ('DataEntity', 'DataEntity', 'name', 'string'), ('Column', 'Column', 'name', 'string'), ('Table', 'Table', 'name', 'string'), ('Constraint', 'Constraint', 'name', 'string'), ('Relationship', 'Relationship', 'relationshipType', 'string'), ('Domain', 'Domain', 'name', 'string'),
    ('Domain', 'Domain', 'description', 'string'), ('Schema', 'Schema', 'name', 'string'), ('Catalog', 'Catalog', 'name', 'string'), ('DataQualityRule', 'DataQualityRule', 'name', 'string'), ('DataQualityRule', 'DataQualityRule', 'expression', 'string'), ('ConfidenceScore', 'BusinessConcept', 'confidence', 'decimal'), ('ConfidenceScore', 'InformationAsset', 'confidence', 'decimal')),
  classes(shape, label, path, expected) AS (VALUES ('InformationAsset', 'InformationAsset', 'derivedFrom', 'DataEntity'), ('Column', 'Column', 'belongsTo', 'Table'), ('Table', 'Table', 'belongsTo', 'Schema'), ('Table', 'Table', 'hasColumn', 'Column'), ('Constraint', 'Constraint', 'appliesTo', 'Column'), ('TypeAssignment', 'TypeAssignment', 'column', 'Column'),
    ('TypeAssignment', 'TypeAssignment', 'dataType', 'DataType'), ('Schema', 'Schema', 'belongsTo', 'Catalog')),
  layers(shape, label, expected) AS (VALUES ('Table', 'Table', 'PERCEPTION'), ('Domain', 'Domain', 'SEMANTIC'), ('TypeAssignment', 'TypeAssignment', 'PERCEPTION'), ('Schema', 'Schema', 'PERCEPTION'), ('Catalog', 'Catalog', 'PERCEPTION'), ('DataQualityRule', 'DataQualityRule', 'REASONING')),
  n AS (SELECT id, unnest(labels) AS label FROM {shape_nodes}), f AS (SELECT DISTINCT id, path, value, datatype FROM {statements})"""


@query("VAL-04", f"""WITH {_SHAPES}, c AS (SELECT n.id, shape, counts.path, least, most, count(DISTINCT value) AS k FROM n JOIN counts USING (label) LEFT JOIN f ON f.id = n.id AND f.path = counts.path GROUP BY ALL)
  SELECT id, shape, path, 'min_count' AS kind, least::VARCHAR AS expected, k::VARCHAR AS value FROM c WHERE k < least UNION ALL SELECT id, shape, path, 'max_count', most::VARCHAR, k::VARCHAR FROM c WHERE k > most
  UNION ALL SELECT n.id, shape, f.path, 'datatype', expected, value FROM n JOIN types USING (label) JOIN f ON f.id = n.id AND f.path = types.path WHERE datatype <> expected
  UNION ALL SELECT n.id, shape, f.path, 'class', expected, value FROM n JOIN classes USING (label) JOIN f ON f.id = n.id AND f.path = classes.path WHERE NOT EXISTS (SELECT 1 FROM n m WHERE m.id = f.value AND m.label = expected)
  UNION ALL SELECT n.id, shape, 'layer', 'has_value', expected, NULL FROM n JOIN layers USING (label) WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.id = n.id AND path = 'layer' AND value = expected)
  UNION ALL SELECT n.id, 'Column', 'layer', 'in', 'PERCEPTION|SEMANTIC|REASONING|APPLICATION', value FROM n JOIN f USING (id) WHERE label = 'Column' AND path = 'layer' AND value NOT IN ('PERCEPTION', 'SEMANTIC', 'REASONING', 'APPLICATION')
  UNION ALL SELECT n.id, 'Constraint', path, 'in', 'PRIMARY_KEY|FOREIGN_KEY|UNIQUE|NOT_NULL|CHECK|DEFAULT', value FROM n JOIN f USING (id) WHERE label = 'Constraint' AND path = 'constraintType' AND value NOT IN ('PRIMARY_KEY', 'FOREIGN_KEY', 'UNIQUE', 'NOT_NULL', 'CHECK', 'DEFAULT')
  UNION ALL SELECT n.id, 'DataQualityRule', path, 'in', 'COMPLETENESS|ACCURACY|CONSISTENCY|TIMELINESS|VALIDITY', value FROM n JOIN f USING (id) WHERE label = 'DataQualityRule' AND path = 'dimension' AND value NOT IN ('COMPLETENESS', 'ACCURACY', 'CONSISTENCY', 'TIMELINESS', 'VALIDITY')
  UNION ALL SELECT n.id, 'Relationship', path, 'node_kind', 'iri', value FROM n JOIN f USING (id) WHERE label = 'Relationship' AND path IN ('source', 'target') AND datatype <> 'iri'
  UNION ALL SELECT n.id, 'ConfidenceScore', path, 'min_inclusive', '0.0', value FROM n JOIN f USING (id) WHERE label IN ('BusinessConcept', 'InformationAsset') AND path = 'confidence' AND coalesce(try_cast(value AS DOUBLE) < 0.0, true)
  UNION ALL SELECT n.id, 'ConfidenceScore', path, 'max_inclusive', '1.0', value FROM n JOIN f USING (id) WHERE label IN ('BusinessConcept', 'InformationAsset') AND path = 'confidence' AND coalesce(try_cast(value AS DOUBLE) > 1.0, true)
  UNION ALL SELECT n.id, 'ForeignKeyConstraint', path, 'needs', 'FOREIGN_KEY>referencesColumn', NULL FROM n JOIN f USING (id) WHERE label = 'Constraint' AND path = 'constraintType' AND value = 'FOREIGN_KEY' AND n.id NOT IN (SELECT id FROM f WHERE path = 'referencesColumn')
  UNION ALL SELECT n.id, 'ReasoningLayer', path, 'needs', 'REASONING>confidence', NULL FROM n JOIN f USING (id) WHERE label = 'Entity' AND path = 'layer' AND value = 'REASONING' AND n.id NOT IN (SELECT id FROM f WHERE path = 'confidence')
  UNION ALL SELECT DISTINCT n.id, 'LayerHierarchy', 'source>target', 'layer_order', 'REASONING>PERCEPTION|REASONING>SEMANTIC|APPLICATION>PERCEPTION|APPLICATION>SEMANTIC|APPLICATION>REASONING', x.value || '>' || y.value FROM n JOIN f s ON s.id = n.id AND s.path = 'source' JOIN f g ON g.id = n.id AND g.path = 'target'
    JOIN f x ON x.id = s.value AND x.path = 'layer' JOIN f y ON y.id = g.value AND y.path = 'layer' WHERE label = 'Relationship' AND (x.value, y.value) IN (('REASONING', 'PERCEPTION'), ('REASONING', 'SEMANTIC'), ('APPLICATION', 'PERCEPTION'), ('APPLICATION', 'SEMANTIC'), ('APPLICATION', 'REASONING'))""")
def _(t):
    return shapes.violations(t.shape_nodes, t.statements)


@query("VAL-05", "SELECT child AS id, CASE WHEN child = parent THEN 'self' ELSE 'lower_case' END AS problem FROM {hierarchy} WHERE child = parent OR child = lower(child)")
def _(t):
    return validation.hierarchy_problems(t.hierarchy)


@query("VAL-06", "SELECT 'typed' AS rule, round(avg((type IS NOT NULL)::INT), 6) AS passed FROM {nodes} UNION ALL SELECT 'sure', round(avg((confidence >= 0.7)::INT), 6) FROM {nodes}")
def _(t):
    return validation.pass_rates(t.nodes, {"typed": "type is not null", "sure": "confidence >= 0.7"})


_TO = "CASE k % 3 WHEN 0 THEN 'SEMANTIC' WHEN 1 THEN 'REASONING' ELSE 'APPLICATION' END"
_RANK = lambda c: f"list_position(['PERCEPTION', 'SEMANTIC', 'REASONING', 'APPLICATION'], {c})"
_MISSING = ", ".join(f"CASE WHEN to_layer = '{layer}' AND coalesce({_PROP(name)}, '') = '' THEN 'missing_{name}' END" for layer, names in rules.LAYER_REQUIREMENTS.items() for name in names)


@query("VAL-07", f"""WITH r AS (SELECT id, k, layer, properties, {_TO} AS to_layer FROM {{entities}} WHERE layer IS NOT NULL)
  SELECT id, k, to_layer, concat_ws(',', CASE WHEN {_RANK('to_layer')} < {_RANK('layer')} THEN 'downward' END, {_MISSING}, CASE WHEN to_layer = 'REASONING' AND NOT {_PROP('confidence')}::DOUBLE BETWEEN 0 AND 1 THEN 'bad_confidence' END) AS errors FROM r""")
def _(t):
    rows = t.entities.filter("layer is not null").withColumnRenamed("layer", "from_layer").withColumn("to_layer", F.expr(_TO))
    return validation.transition_errors(rows).select("id", "k", "to_layer", "errors")


_TARGET = "CASE user_id % 4 WHEN 0 THEN 'SEMANTIC' WHEN 1 THEN 'REASONING' WHEN 2 THEN 'APPLICATION' ELSE 'SEMANTIC' END"
_LAYER = "CASE user_id % 4 WHEN 0 THEN 'PERCEPTION' WHEN 1 THEN 'SEMANTIC' WHEN 2 THEN 'REASONING' ELSE 'APPLICATION' END"
_NAME = "CASE user_id % 7 WHEN 0 THEN 'Diabetes' WHEN 1 THEN 'chronic pain' WHEN 2 THEN 'fev' ELSE 'Zed' || cast(user_id as string) END"
_CONFIDENCE = "CASE WHEN user_id % 3 = 0 THEN 0.97 ELSE 0.5 + confidence / 2 END"
_ONTOLOGY = ", ".join("'" + n.replace("'", "''") + "'" for n in rules.ONTOLOGY_NAMES)
_GATE = f"""gates AS (SELECT id, entity_type, {_LAYER} AS layer, {_TARGET} AS target, lower({_NAME}) AS name, {_CONFIDENCE} AS confidence, observation_count AS n, (epoch_us(last_observed) - epoch_us(first_observed)) / 3600000000.0 AS hours, user_id % 5 AS sources FROM {{observations}}),
  criteria AS (SELECT *, CASE WHEN entity_type IN ('Diagnosis', 'Medication') THEN 'high' WHEN entity_type = 'Preference' THEN 'low' ELSE 'medium' END AS risk,
    len(list_filter([{_ONTOLOGY}], lambda x: contains(name, x) OR contains(x, name))) > 0 OR entity_type IN ('Medication', 'Diagnosis', 'Symptom') AS known, CASE layer WHEN 'PERCEPTION' THEN [0.85::DOUBLE, 2, 0] WHEN 'SEMANTIC' THEN [0.92::DOUBLE, 3, 48] WHEN 'REASONING' THEN [0.95::DOUBLE, 5, 168] END AS c FROM gates),
  gate AS (SELECT id, risk, layer, concat_ws(',', CASE WHEN c IS NULL THEN 'transition' END, CASE WHEN confidence < c[1] THEN 'confidence' END, CASE WHEN n < c[2] THEN 'observation_count' END, CASE WHEN c[3] > 0 AND hours < c[3] THEN 'temporal_stability' END,
    CASE WHEN layer IN ('SEMANTIC', 'REASONING') AND sources < 3 THEN 'multi_source' END, CASE WHEN c IS NOT NULL AND NOT known THEN 'ontology_match' END) AS failed FROM criteria),
  decided AS (SELECT id, risk, CASE WHEN failed <> '' THEN 'rejected' WHEN risk = 'high' AND layer <> 'PERCEPTION' THEN 'pending_review' ELSE 'approved' END AS decision, failed FROM gate)"""


def _gate(t):
    rows = t.observations.select("id", "entity_type", "first_observed", "last_observed", "observation_count", F.expr(_LAYER).alias("layer"), F.expr(_TARGET).alias("target_layer"), F.expr(_NAME).alias("name"), F.expr(_CONFIDENCE).alias("confidence"), (F.col("user_id") % 5).alias("sources"))
    return validation.promotion_gate(rows)


@query("VAL-08", f"WITH {_GATE} SELECT * FROM decided")
def _(t):
    return _gate(t)


@query("AGG-60", f"WITH {_GATE} SELECT risk, decision, count(*) AS n FROM decided GROUP BY 1, 2")
def _(t):
    return _gate(t).groupBy("risk", "decision").agg(F.count("*").alias("n"))


@query("VAL-09", """SELECT id, layer, CASE WHEN layer = 'PERCEPTION' AND (confidence >= 0.85 OR validation_count >= 3 OR len(ontology_codes) > 0) THEN 'SEMANTIC'
  WHEN layer = 'SEMANTIC' AND (confidence >= 0.9 OR len(inference_rules) > 0 OR reference_count >= 5) THEN 'REASONING' END AS target FROM {rising}""")
def _(t):
    return t.rising.select("id", "layer", validation.automatic_target().alias("target"))


_NEXT = "CASE layer WHEN 'PERCEPTION' THEN 'SEMANTIC' WHEN 'SEMANTIC' THEN 'REASONING' WHEN 'REASONING' THEN 'APPLICATION' END"


@query("VAL-10", f"""WITH p AS (SELECT id, k, name, layer, properties, CASE WHEN k % 10 < 3 AND id <> '' THEN {_NEXT} END AS next FROM {{entities}})
  SELECT id, k, coalesce(next, layer) AS layer, CASE WHEN next IS NULL THEN 1 ELSE 2 END AS version, CASE WHEN next IS NOT NULL THEN layer END AS promoted_from,
    CASE WHEN list_contains(map_keys(properties), 'domain') THEN {_PROP('domain')} WHEN next = 'SEMANTIC' THEN 'medical' END AS domain, CASE WHEN list_contains(map_keys(properties), 'description') THEN {_PROP('description')} WHEN next = 'SEMANTIC' THEN name END AS description,
    CASE WHEN list_contains(map_keys(properties), 'access_pattern') THEN {_PROP('access_pattern')} WHEN next = 'APPLICATION' THEN 'frequent_query' END AS access_pattern FROM p WHERE id NOT IN ('', 'none')""")
def _(t):
    nodes = t.entities.filter("id not in ('', 'none')")
    prop = lambda name: F.try_element_at("properties", F.lit(name)).alias(name)
    return validation.promote(nodes, nodes.filter("k % 10 < 3")).select("id", "k", "layer", "version", "promoted_from", *map(prop, ("domain", "description", "access_pattern")))


@query("VAL-11", "SELECT id, CASE WHEN k % 5 = 0 THEN 'approved' WHEN k % 5 = 1 THEN 'rejected' ELSE 'pending' END AS state FROM {nodes} WHERE status = 'pending'")
def _(t):
    decisions = t.nodes.filter("k % 5 < 2").select("id", (F.col("k") % 5 == 0).alias("approve"))
    return validation.decide(t.nodes.filter("status = 'pending'"), decisions).select("id", "state")


@query("VAL-13", """WITH a AS (SELECT CASE WHEN p_type = 'PROMO' THEN 'STANDARD' ELSE p_type END AS concept, lower(trim(p_name)) AS alias FROM part), u AS (SELECT concept, alias, count(*) AS usage FROM a GROUP BY 1, 2),
  s AS (SELECT DISTINCT p_type AS concept, CASE WHEN p_type = 'PROMO' THEN 'deprecated' ELSE 'active' END AS state, CASE WHEN p_type = 'PROMO' THEN 'STANDARD' END AS replaced_by FROM part)
  SELECT s.concept, state, replaced_by, alias, usage FROM s LEFT JOIN u USING (concept)""")
def _(t):
    aliases = t.part.select(F.col("p_type").alias("concept"), F.col("p_name").alias("alias"), F.lit(1).alias("usage"))
    merges = t.spark.createDataFrame([("PROMO", "STANDARD")], "source string, target string")
    return validation.concept_states(aliases, merges).join(validation.merge_concepts(aliases, merges), "concept", "left").select("concept", "state", "replaced_by", "alias", "usage")


@query("TOP-01", """SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 5) AS distance FROM {vectors} q JOIN {vectors} v ON q.vec_id % 20 = 0
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), v.vec_id) <= 5""")
def _(t):
    q = t.vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("x"))
    return nearest_l2(q, t.vectors, 5)


def nearest_l2(queries, vectors, k):
    """query_id, vec_id, distance: the k rows of least squared L2 distance; the stated queries against all rows, with a top-k a task before the merge."""
    gap = F.aggregate(F.zip_with("x", "embedding", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    measured = lambda q, v: v.join(q, F.lit(True)).select("query_id", "vec_id", gap.alias("distance"))
    size = vectors.agg(F.max(F.size("embedding"))).first()[0]
    whole = lambda c: nearest.plain(c) & (F.size(c) == size) & F.col("query_id" if c == "x" else "vec_id").isNotNull()
    pairs = nearest.nearest_candidates(queries.filter(whole("x")), vectors.filter(whole("embedding")), k)
    odd = vectors.filter(~F.coalesce(whole("embedding"), F.lit(False)))
    if not odd.isEmpty():  # vectors that are null, hold nulls or are shorter are measured as they are
        pairs = pairs.union(measured(queries, odd))
    odd = queries.filter(~F.coalesce(whole("x"), F.lit(False)))
    if not odd.isEmpty():
        pairs = pairs.union(measured(odd, vectors.filter(whole("embedding"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "vec_id", F.round("distance", 5).alias("distance"))


@query("TOP-03", """SELECT a.vec_id AS in_id, b.vec_id AS cand_id FROM {vectors} a JOIN {vectors} b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.2
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) <= 5""")
def _(t):
    found = resolve.embedding_matches(t.vectors.filter("vec_id % 20 = 0"), t.vectors, 0.2)
    rank = F.row_number().over(Window.partitionBy("in_id").orderBy(F.desc("score"), "cand_id"))
    return found.withColumn("rank", rank).filter("rank <= 5").select("in_id", "cand_id")


@query("TOP-04", "SELECT id, CASE WHEN lower(name) = 'red bolt' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS score FROM {nodes} WHERE contains(lower(name), 'red bolt')")
def _(t):
    return t.nodes.filter(F.lower("name").contains("red bolt")).select("id", F.when(F.lower("name") == "red bolt", 1.0).otherwise(0.8).alias("score"))


@query("SCL-25", f"""WITH u AS (SELECT user_id, max(ts) AS m FROM events GROUP BY 1), d AS (SELECT user_id, DATE '{REF_TIME[:10]}' - m::DATE AS days, floor((epoch_us(TIMESTAMP '{REF_TIME}') - epoch_us(m)) / 86400000000) AS passed FROM u)
  SELECT user_id, CASE WHEN days <= 0 THEN 'today' WHEN days <= 1 THEN 'yesterday' WHEN days <= 7 THEN 'this_week' ELSE 'older' END AS by_day,
    CASE WHEN passed = 0 THEN 'today' WHEN passed = 1 THEN 'yesterday' WHEN passed <= 7 THEN 'this_week' WHEN passed <= 30 THEN 'this_month' ELSE 'older' END AS elapsed FROM d""")
def _(t):
    last = t.events.groupBy("user_id").agg(F.max("ts").alias("last"))
    now = F.lit(REF_TIME).cast("timestamp")
    return last.select("user_id", temporal.day_bucket(F.col("last"), now).alias("by_day"), temporal.elapsed_bucket(F.col("last"), now).alias("elapsed"))
