"""Audit, statistics and storage operators as registered queries."""

from pyspark.sql import functions as F

from ..operators import audit, measures, rules, storage
from .fixtures import query
from .q_facts import _FORMS, RESOLVED

_STRUCT = "list_has_any(labels, ['Chunk', 'StructuralChunk', 'Document', 'DocumentQuality', 'ExtractedEntity', 'ConversationSession', 'Message'])"
_NOISE = "(length(name) < 3 OR lower(trim(name)) IN ('the', 'a', 'an', 'and', 'or', 'is', 'are', 'was', 'were', 'this', 'that', 'these', 'those', 'it', 'its', 'however', 'therefore', 'thus', 'hence', 'also', 'although', 'because', 'since', 'while', 'but', 'yet', 'so', 'for', 'nor', 'be', 'been', 'being', 'have', 'has', 'had', 'do', 'does', 'did', 'will', 'would', 'could', 'should', 'may', 'might', 'must', 'can', 'not', 'no', 'none', 'all', 'any', 'some', 'of', 'in', 'on', 'at', 'to', 'from', 'by', 'with', 'as', 'if', 'then', 'else', 'when', 'where', 'which', 'who'))"
# Labels of a child (a) and its parent (b) that may meet, spelled out apart from the operator's table.
_VALID = """(coalesce(list_has_any(a.labels, b.labels), false) OR coalesce((list_contains(a.labels, 'Attribute') AND list_contains(b.labels, 'DataEntity')) OR (list_contains(a.labels, 'Column') AND list_contains(b.labels, 'Table')) OR (list_contains(a.labels, 'InformationAsset') AND list_contains(b.labels, 'DataEntity'))
  OR (list_contains(a.labels, 'BusinessConcept') AND (list_contains(b.labels, 'BusinessConcept') OR list_contains(b.labels, 'Domain'))) OR (list_contains(a.labels, 'Domain') AND list_contains(b.labels, 'Domain')), false))"""
_ENDS = "ends AS (SELECT src AS id FROM {edges} UNION SELECT dst FROM {edges})"


@query("AGG-01", "SELECT unnest(labels) AS value, count(*) AS n FROM {nodes} GROUP BY 1")
def _(t):
    return audit.distribution(t.nodes.select(F.explode("labels").alias("l")), F.col("l"))


@query("AGG-03", f"WITH {_ENDS} SELECT coalesce(type, labels[1], 'Unknown') AS key, count(e.id) AS connected, count(*) - count(e.id) AS orphans FROM {{nodes}} n LEFT JOIN ends e ON n.id = e.id GROUP BY 1")
def _(t):
    return audit.connection_by(t.nodes, t.edges, audit.display_type())


@query("AGG-04", "WITH c AS (SELECT rel_type, count(*) AS n FROM {edges} GROUP BY 1 ORDER BY n DESC, rel_type LIMIT 3) SELECT rel_type, n, round(100.0 * n / sum(n) OVER (), 2)::DOUBLE AS percent FROM c")
def _(t):
    return audit.shares(t.edges, "rel_type", 3)


@query("AGG-05", "SELECT id, count(*) AS degree FROM (SELECT src AS id FROM {edges} UNION ALL SELECT dst FROM {edges}) e GROUP BY id ORDER BY degree DESC, id LIMIT 50")
def _(t):
    return audit.top_degrees(t.edges)


@query("AGG-06", f"""WITH {_ENDS}, s AS (SELECT id, 'document:' || (k % 97)::VARCHAR AS source_id FROM {{nodes}} WHERE k % 5 <> 2), c AS (SELECT source_id, count(*) AS total_entities, count(*) FILTER (WHERE e.id IS NULL) AS orphan_count FROM s LEFT JOIN ends e ON s.id = e.id GROUP BY 1)
  SELECT source_id, total_entities, orphan_count, round(orphan_count / total_entities, 6) AS orphan_rate FROM c ORDER BY orphan_count / total_entities DESC, source_id LIMIT 20""")
def _(t):
    """Four of five nodes come from one of 97 documents."""
    source = F.when(F.col("k") % 5 != 2, F.concat(F.lit("document:"), (F.col("k") % 97).cast("string")))
    return audit.documents_with_orphans(t.nodes.withColumn("source_id", source), t.edges)


_FOUND = f"""WITH {RESOLVED}, g AS (SELECT unnest(['all', 'belonging']) AS report), e AS (SELECT report, src, dst FROM {{edges}}, g WHERE report = 'all' OR rel_type IN ('BELONGS_TO', 'PART_OF')),
  n AS (SELECT report, id, type, known, CASE WHEN k % 5 <> 2 THEN 'document:' || (k % 97)::VARCHAR END AS source_id FROM resolved, g), ends AS (SELECT report, src AS id FROM e UNION SELECT report, dst FROM e),
  x AS (SELECT n.*, ends.id IS NULL AS orphan FROM n LEFT JOIN ends ON ends.report = n.report AND ends.id = n.id),
  d AS (SELECT report, source_id, count(*) FILTER (WHERE orphan) / count(*) AS r FROM x WHERE source_id IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY report ORDER BY count(*) FILTER (WHERE orphan) / count(*) DESC, source_id) <= 20),
  u AS (SELECT report, type, count(*) AS n FROM n WHERE NOT known AND type IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY report ORDER BY count(*) DESC, type) <= 5),
  m AS (SELECT report, count(*) FILTER (WHERE orphan) AS orphans, count(*) FILTER (WHERE orphan) / count(*) AS rate, count(*) FILTER (WHERE known) / count(*) AS covered, (SELECT count(*) FROM e WHERE e.report = x.report) AS edges,
    (SELECT max(c) FROM (SELECT report AS p, count(*) AS c FROM (SELECT report, src AS id FROM e UNION ALL SELECT report, dst FROM e) GROUP BY report, id) WHERE p = x.report) AS degree, (SELECT count(*) FROM d WHERE d.report = x.report AND r > 0.8) AS failing,
    (SELECT max(r) FROM d WHERE d.report = x.report) AS worst, (SELECT arg_min(source_id, (-r, source_id)) FROM d WHERE d.report = x.report) AS worst_id, (SELECT count(*) FROM u WHERE u.report = x.report) AS unknown, (SELECT string_agg(type, ',' ORDER BY n DESC, type) FROM u WHERE u.report = x.report) AS names FROM x GROUP BY report)"""


@query("AGG-08", f"""{_FOUND} SELECT report, kind, code, round(value, 6) AS value, detail FROM (
  SELECT report, 'cause' AS kind, 'critical_orphans' AS code, rate AS value, NULL AS detail FROM m WHERE rate >= 0.9 UNION ALL SELECT report, 'cause', 'high_orphans', rate, NULL FROM m WHERE rate >= 0.5 AND rate < 0.9
  UNION ALL SELECT report, 'cause', 'concentrated', degree, NULL FROM m WHERE degree > 100 AND edges > 1000 UNION ALL SELECT report, 'cause', 'low_ontology_coverage', covered, NULL FROM m WHERE covered < 0.5
  UNION ALL SELECT report, 'cause', 'unmapped_types', unknown, names FROM m WHERE unknown > 0 UNION ALL SELECT report, 'cause', 'failing_documents', failing, NULL FROM m WHERE failing > 0
  UNION ALL SELECT report, 'recommendation', unnest(['write_atomically', 'block_orphans']), rate, NULL FROM m WHERE rate >= 0.8 UNION ALL SELECT report, 'recommendation', 'extend_ontology', covered, NULL FROM m WHERE covered < 0.8
  UNION ALL SELECT report, 'recommendation', 'extract_facts_first', rate, NULL FROM m WHERE rate > 0.3 UNION ALL SELECT report, 'recommendation', 'link_orphans', orphans, NULL FROM m WHERE orphans > 1000
  UNION ALL SELECT report, 'recommendation', 'monitor_documents', NULL, NULL FROM m UNION ALL SELECT report, 'recommendation', 'inspect_document', worst, worst_id FROM m WHERE worst > 0.9)""")
def _(t):
    """The whole graph, and the graph of belonging alone, in which most nodes have no edge."""
    nodes = t.typed.withColumn("source_id", F.when(F.col("k") % 5 != 2, F.concat(F.lit("document:"), (F.col("k") % 97).cast("string"))))
    reports = {"all": t.edges, "belonging": t.edges.filter("rel_type in ('BELONGS_TO', 'PART_OF')")}
    parts = [audit.findings(nodes, edges).select(F.lit(name).alias("report"), "kind", "code", "value", "detail") for name, edges in reports.items()]
    return parts[0].union(parts[1])


@query("AGG-12", "SELECT (SELECT count(*) FROM {nodes}) AS nodes, (SELECT count(*) FROM {edges}) AS edges, (SELECT count(*) FROM {subjects}) AS subjects")
def _(t):
    one = t.nodes.agg(F.count("*").alias("nodes")).join(t.edges.agg(F.count("*").alias("edges")), F.lit(True))
    return one.join(t.subjects.agg(F.count("*").alias("subjects")), F.lit(True))


_MAPPED = "list_has_any(labels, ['Domain', 'Organization', 'DataEntity'])"


@query("AGG-17", f"SELECT count(*) AS entities, count(*) FILTER (WHERE {_MAPPED}) AS mapped, round(avg(({_MAPPED})::INT), 6) AS coverage, count(*) FILTER (WHERE NOT {_STRUCT} AND NOT {_NOISE}) AS knowledge, count(*) FILTER (WHERE NOT {_STRUCT} AND NOT {_NOISE} AND {_MAPPED}) AS knowledge_mapped, round(avg(({_MAPPED})::INT) FILTER (WHERE NOT {_STRUCT} AND NOT {_NOISE}), 6) AS knowledge_coverage FROM {{noisy}}")
def _(t):
    return audit.coverage(t.noisy, ("Domain", "Organization", "DataEntity"))


@query("AGG-18", """WITH s AS (SELECT labels[1] AS class, ((type IS NULL)::INT + (layer IS NULL)::INT + (status IS NULL)::INT) / 3.0 AS share FROM {nodes} WHERE labels[1] IN ('DataEntity', 'Organization'))
  SELECT class, count(*) FILTER (WHERE share = 0) AS full, count(*) FILTER (WHERE share > 0 AND share <= 0.5) AS partial, count(*) FILTER (WHERE share > 0.5) AS violating FROM s GROUP BY class""")
def _(t):
    return audit.compliance(t.nodes, {"DataEntity": ("type", "layer", "status"), "Organization": ("type", "layer", "status")})


@query("AGG-19", f"""WITH RECURSIVE h AS (SELECT src, dst FROM {{edges}} WHERE rel_type IN ('IS_A', 'SUBCLASS_OF', 'PART_OF', 'BELONGS_TO', 'hasAttribute')), up(node, d) AS (SELECT src, 1 FROM h UNION SELECT h.src, d + 1 FROM h JOIN up ON h.dst = up.node),
  depths AS (SELECT node, max(d) AS d FROM up GROUP BY 1), v AS (SELECT {_VALID} AS ok FROM h LEFT JOIN {{noisy}} a ON src = a.id LEFT JOIN {{noisy}} b ON dst = b.id), {_ENDS},
  one AS (SELECT count(*) AS relationships, count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE NOT ok) AS invalid, round(avg(ok::INT), 6) AS coherence, (SELECT max(d) FROM depths)::INT AS max_depth, (SELECT round(avg(d), 6) FROM depths) AS avg_depth, 0::BIGINT AS cyclic FROM v),
  k AS (SELECT id, NOT {_STRUCT} AND id NOT IN (SELECT id FROM ends) AS free, NOT {_STRUCT} AND is_structural AS marked, exclude_from_ontology AS away FROM {{noisy}})
  SELECT 'computed' AS report, relationships, valid, invalid, coherence, (SELECT count(*) FROM k WHERE free) AS orphans, 0::BIGINT AS episodic, 0::BIGINT AS knowledge, (SELECT count(*) FROM k WHERE free) AS unclassified, max_depth, avg_depth, cyclic FROM one
  UNION ALL SELECT 'flagged', relationships, valid, invalid, coherence, (SELECT count(*) FROM k WHERE marked), (SELECT count(*) FROM k WHERE marked AND away), (SELECT count(*) FROM k WHERE marked AND NOT away), 0, max_depth, avg_depth, cyclic FROM one""")
def _(t):
    """Orphans as the edges show them, and as marks on the nodes (those of structure) name them."""
    source = F.when(F.col("exclude_from_ontology"), "episodic").otherwise("knowledge")
    reports = {"computed": t.noisy.select("id", "labels"), "flagged": t.noisy.select("id", "labels", F.col("is_structural").alias("is_orphan"), source.alias("orphan_source"))}
    first, second = (measures.taxonomy(nodes, t.edges).select(F.lit(name).alias("report"), "*") for name, nodes in reports.items())
    return first.union(second)


@query("AGG-20", "WITH k AS (SELECT type, count(DISTINCT labels[1]) AS c FROM {nodes} WHERE type IS NOT NULL GROUP BY 1) SELECT count(*) AS types, count(*) FILTER (WHERE c = 1) AS consistent, round(avg((c = 1)::INT), 6) AS share FROM k")
def _(t):
    return audit.mapping_consistency(t.nodes)


@query("AGG-21", f"""WITH {_FORMS}, e AS (SELECT term AS name, lower(term) AS low, t.type, labels, is_structural, mapped, map_keys(abbreviations) AS a, map_keys(words.synonyms) AS s FROM {{terms}} t JOIN {{noisy}} n USING (id) JOIN forms f USING (id, term), words),
  keys AS (SELECT count(*) AS n FROM e WHERE NOT is_structural AND NOT {_STRUCT} AND coalesce(type, '') <> '' AND coalesce(name, '') <> '' GROUP BY replace(replace(trim(low), ' ', '_'), '-', ''))
  SELECT count(*) AS total, count(*) FILTER (WHERE mapped = replace(low, ' ', '_')) AS canonical, count(*) FILTER (WHERE mapped <> replace(low, ' ', '_')) AS normalized, count(*) FILTER (WHERE len(list_filter(a, lambda w: contains(low, w))) > 0) AS abbreviation_hits,
    count(*) FILTER (WHERE len(list_filter(s, lambda w: contains(low, w))) > 0) AS synonym_hits, round(count(mapped) / count(*), 6) AS rate, (SELECT count(*) FROM keys WHERE n > 1) AS duplicates FROM e""")
def _(t):
    named = t.terms.select("id", F.col("term").alias("name"), "type").join(t.noisy.select("id", "labels", "is_structural"), "id")
    return measures.normalization(named)


# Spelled out, apart from the operator's tables.
_EXCHANGE = """x AS (SELECT avg(list_has_any(labels, ['Dataset', 'Property', 'Article', 'DefinedTerm', 'Organization', 'Person', 'MedicalCondition', 'Drug', 'MedicalSignOrSymptom', 'MedicalTherapy', 'MedicalTest', 'MedicalStudy', 'Gene', 'AnatomicalStructure', 'Protein', 'MedicalEntity', 'InfectiousAgent', 'Thing'])::INT) AS c,
  avg(list_has_any(map_keys(properties), ['name', 'description', 'id', 'dateCreated', 'dateModified'])::INT) AS p, count(*) AS n FROM {entities})"""


@query("AGG-23", f"WITH {_EXCHANGE} SELECT n AS entities, round(c, 6) AS schema_coverage, round(p, 6) AS property_coverage, round(c * 0.6::DOUBLE + p * 0.4::DOUBLE, 6) AS readiness, c >= 0.5 AS linked_data_ready, c >= 0.7 AS rdf_exportable FROM x")
def _(t):
    return audit.interoperability(t.entities)


_SEVEN = f"""{_EXCHANGE}, rules(rel_type, a, b) AS (VALUES ('hasAttribute', 'DataEntity', 'Attribute'), ('hasAttribute', 'Table', 'Column'), ('belongsToDomain', '*', 'Domain'), ('derivedFrom', 'InformationAsset', 'DataEntity'), ('represents', 'DataEntity', 'BusinessConcept'), ('relatedTo', '*', '*')),
  links AS (SELECT e.src, e.rel_type, e.dst, bool_or(a IS NULL OR ((a = '*' OR coalesce(list_contains(p.labels, a), false)) AND (b = '*' OR coalesce(list_contains(q.labels, b), false)))) AS valid FROM {{named_edges}} e LEFT JOIN rules r ON r.rel_type = e.rel_type LEFT JOIN {{nodes}} p ON e.src = p.id LEFT JOIN {{nodes}} q ON e.dst = q.id GROUP BY ALL),
  kinds AS (SELECT type, count(DISTINCT labels[1]) AS c FROM {{nodes}} WHERE type IS NOT NULL GROUP BY 1),
  seven AS (SELECT (SELECT round(avg(({_MAPPED})::INT), 6) FROM {{noisy}}) AS coverage, (SELECT avg((type IS NOT NULL AND layer IS NOT NULL AND status IS NOT NULL)::INT) FROM {{nodes}} WHERE labels[1] IN ('DataEntity', 'Organization')) AS compliance,
    (SELECT round(avg({_VALID}::INT), 6) FROM {{edges}} JOIN {{nodes}} a ON src = a.id JOIN {{nodes}} b ON dst = b.id WHERE rel_type IN ('PART_OF', 'BELONGS_TO')) AS taxonomy, (SELECT round(avg((c = 1)::INT), 6) FROM kinds) AS consistency,
    (SELECT avg((regexp_matches(name, '^[a-z0-9]+(_[a-z0-9]+)*$'))::INT) FROM {{noisy}}) AS normalization, (SELECT avg(valid::INT) FROM links) AS cross_reference, (SELECT round(c * 0.6::DOUBLE + p * 0.4::DOUBLE, 6) FROM x) AS interoperability)"""


@query("AGG-24", f"""WITH {_SEVEN}, s AS (SELECT *, round(coverage * 0.25 + compliance * 0.2 + taxonomy * 0.15 + consistency * 0.15 + normalization * 0.1 + cross_reference * 0.1 + interoperability * 0.05, 6) AS score FROM seven)
  SELECT score, CASE WHEN score >= 0.9 THEN 'excellent' WHEN score >= 0.7 THEN 'good' WHEN score >= 0.5 THEN 'acceptable' WHEN score >= 0.3 THEN 'poor' ELSE 'critical' END AS level,
    concat_ws(', ', CASE WHEN coverage < 0.5 THEN 'critical: map entity types' END, CASE WHEN coverage < 0.8 THEN 'map entity types' END, CASE WHEN compliance < 0.7 THEN 'add required properties' END, CASE WHEN taxonomy < 0.9 THEN 'fix the hierarchy' END, CASE WHEN consistency < 0.9 THEN 'resolve type mappings' END,
      CASE WHEN normalization < 0.8 THEN 'normalize names' END, CASE WHEN cross_reference < 0.9 THEN 'fix cross-references' END, CASE WHEN interoperability < 0.5 THEN 'add schema.org types' END) AS advice FROM s""")
def _(t):
    from ..functions.text import normalized_name
    from ..operators.graph import cross_reference_validity, with_ends

    ends, required = with_ends(measures.hierarchy_edges(t.edges), t.nodes, "labels"), ("type", "layer", "status")
    compliant = audit.compliance(t.nodes, {"DataEntity": required, "Organization": required})
    parts = [
        audit.coverage(t.noisy, ("Domain", "Organization", "DataEntity")).select("coverage"),
        compliant.agg((F.sum("full") / F.sum(F.col("full") + F.col("partial") + F.col("violating"))).alias("compliance")),
        ends.agg(F.round(F.avg(measures.valid_hierarchy(F.col("src_labels"), F.col("dst_labels")).cast("int")), 6).alias("taxonomy")),
        audit.mapping_consistency(t.nodes).select(F.col("share").alias("consistency")),
        t.noisy.agg(F.avg((normalized_name(F.col("name"), {"": ""}, {"": ""}) == F.col("name")).cast("int")).alias("normalization")),
        cross_reference_validity(t.named_edges, t.nodes).agg(F.avg(F.col("valid").cast("int")).alias("cross_reference")),
        audit.interoperability(t.entities).select(F.col("readiness").alias("interoperability")),
    ]
    metrics = parts[0]
    for part in parts[1:]:
        metrics = metrics.crossJoin(part)  # one row each
    scored = audit.ontology_score(metrics)
    advice = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "advice"))), lambda a: a["advice"]), ", ")
    return scored.select("score", "level").crossJoin(audit.ontology_advice(scored).agg(advice.alias("advice")))


@query("AGG-25", f"SELECT count(*) FILTER (WHERE {_STRUCT}) AS structural, count(*) FILTER (WHERE NOT {_STRUCT} AND {_NOISE}) AS noise, round(100.0 * count(*) FILTER (WHERE NOT {_STRUCT} AND NOT {_NOISE} AND {_MAPPED}) / count(*) FILTER (WHERE NOT {_STRUCT} AND NOT {_NOISE}), 2)::DOUBLE AS adjusted FROM {{noisy}}")
def _(t):
    from ..operators.flags import has_label, is_structural, noise_reason

    s, n, m = is_structural(), noise_reason().isNotNull(), has_label(("Domain", "Organization", "DataEntity"))
    return t.noisy.agg(F.count_if(s).alias("structural"), F.count_if(~s & n).alias("noise"), F.round(100.0 * F.count_if(~s & ~n & m) / F.count_if(~s & ~n), 2).alias("adjusted"))


@query("AGG-28", "WITH d AS (SELECT unnest(['PERCEPTION', 'SEMANTIC', 'REASONING', 'APPLICATION', 'unassigned']) AS layer), c AS (SELECT coalesce(layer, 'unassigned') AS layer, count(*) AS n FROM {nodes} GROUP BY 1) SELECT layer, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 2)::DOUBLE AS percent FROM d LEFT JOIN c USING (layer)")
def _(t):
    return audit.layer_counts(t.nodes)


@query("AGG-27", f"SELECT layer, count(*) AS total, count(*) FILTER (WHERE {_STRUCT}) AS structural, count(*) FILTER (WHERE {_MAPPED}) AS mapped, round(100.0 * count(*) FILTER (WHERE {_MAPPED}) / count(*), 2)::DOUBLE AS percent FROM {{noisy}} GROUP BY layer")
def _(t):
    from ..operators.flags import has_label, is_structural

    m = has_label(("Domain", "Organization", "DataEntity"))
    return t.noisy.groupBy("layer").agg(F.count("*").alias("total"), F.count_if(is_structural()).alias("structural"), F.count_if(m).alias("mapped"), F.round(100.0 * F.count_if(m) / F.count("*"), 2).alias("percent"))


@query("AGG-26", "SELECT type, count(*) AS n FROM {nodes} WHERE type IS NOT NULL AND NOT list_has_any(labels, ['Organization', 'DataEntity', 'BusinessConcept', 'InformationAsset']) GROUP BY 1 UNION ALL SELECT '(mapped)', count(*) FROM {nodes} WHERE list_has_any(labels, ['Organization', 'DataEntity', 'BusinessConcept', 'InformationAsset'])")
def _(t):
    from ..operators.flags import canonicalize

    mapped = canonicalize(t.nodes).select("id")
    rest = t.nodes.filter("type is not null").join(mapped, "id", "left_anti").groupBy("type").agg(F.count("*").alias("n"))
    return rest.union(mapped.agg(F.lit("(mapped)"), F.count("*")))


@query("AGG-29", """WITH c AS (SELECT * FROM {layer_changes}), d AS (SELECT * FROM c WHERE status = 'completed')
  SELECT 'count' AS kind, 'total' AS key, count(*)::DOUBLE AS value FROM c UNION ALL SELECT 'count', status, count(*) FROM c GROUP BY status UNION ALL SELECT 'path', from_layer || ' → ' || to_layer, count(*) FROM d GROUP BY 2
  UNION ALL SELECT 'mean', 'mean_seconds', round(avg(epoch_us(completed_at) - epoch_us(requested_at)) / 1e6, 6) FROM d WHERE completed_at IS NOT NULL""")
def _(t):
    return measures.transition_statistics(t.layer_changes)


@query("AGG-40", "SELECT lang, count(*) AS documents, sum(n_chars)::BIGINT AS chars, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def _(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.count_distinct("source").alias("sources"))


@query("AGG-41", "SELECT 'level' AS kind, level AS key, count(*)::DOUBLE AS value FROM {rated} WHERE level IS NOT NULL GROUP BY level UNION ALL SELECT 'count', 'documents', count(DISTINCT doc_id) FROM {rated}"
  + "".join(f" UNION ALL SELECT 'average', '{c}', round(coalesce(avg({c}), 0), 6) FROM {{rated}}" for c in ("overall_score", "context_precision", "context_recall", "topic_coverage", "signal_to_noise", "entity_extraction_rate", "retrieval_quality")))
def _(t):
    return measures.quality_statistics(t.rated)


@query("AGG-42", "SELECT day, round(avg(score), 6) AS mean, count(*) FILTER (WHERE level <> 'critical') AS sound FROM {assessments} GROUP BY day")
def _(t):
    return t.assessments.groupBy("day").agg(F.round(F.avg("score"), 6).alias("mean"), F.count_if(F.col("level") != "critical").alias("sound"))


@query("JOIN-26", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@query("AGG-51", "SELECT subject_id, len(list_distinct(conditions))::INT AS conditions, len(list_distinct(medications))::INT AS medications FROM {subjects}")
def _(t):
    return t.subjects.select("subject_id", F.size(F.array_distinct("conditions")).alias("conditions"), F.size(F.array_distinct("medications")).alias("medications"))


@query("AGG-52", "SELECT (SELECT count(*) FROM {nodes} WHERE list_contains(labels, 'BusinessConcept')) AS concepts, (SELECT count(*) FROM {nodes} WHERE list_contains(labels, 'DataEntity')) AS assets, (SELECT count(*) FROM {edges} WHERE rel_type = 'SUPPLIES') AS links, (SELECT 2 * count(*) FROM {edges}) AS all_links")
def _(t):
    one = t.nodes.agg(F.count_if(F.array_contains("labels", "BusinessConcept")).alias("concepts"), F.count_if(F.array_contains("labels", "DataEntity")).alias("assets"))
    return one.join(t.edges.agg(F.count_if(F.col("rel_type") == "SUPPLIES").alias("links"), (2 * F.count("*")).alias("all_links")), F.lit(True))


@query("AGG-53", "WITH m AS (SELECT subject_id, unnest(symptoms) AS s FROM {subjects}) SELECT s AS symptom, count(*) AS n, CASE WHEN count(*) >= 5 THEN 'escalate' WHEN count(*) >= 2 THEN 'recurring' ELSE 'single' END AS state FROM m GROUP BY s")
def _(t):
    rows = t.subjects.select(F.explode("symptoms").alias("symptom")).groupBy("symptom").agg(F.count("*").alias("n"))
    return rows.withColumn("state", F.when(F.col("n") >= 5, "escalate").when(F.col("n") >= 2, "recurring").otherwise("single"))


@query("AGG-54", "SELECT CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS run, type, count(*) AS n FROM {mentions} GROUP BY ALL")
def _(t):
    return t.mentions.groupBy(F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("run"), "type").agg(F.count("*").alias("n"))


@query("AGG-55", "WITH c AS (SELECT (SELECT count(*) FROM {store_a}) AS l, (SELECT count(*) FROM {store_b}) AS r) SELECT 'orders' AS data, l AS left, r AS right, greatest(l - r, 0) AS missing, CASE WHEN greatest(l - r, 0) / l <= 0.05 THEN 'synced' WHEN greatest(l - r, 0) / l <= 0.2 THEN 'minor_drift' ELSE 'out_of_sync' END AS status FROM c")
def _(t):
    return audit.store_sync(t.store_a, t.store_b, "orders")


@query("AGG-56", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", min({c})::VARCHAR AS least, max({c})::VARCHAR AS most FROM {{nodes}}" for c in ("type", "layer", "k")))
def _(t):
    return audit.profile(t.nodes, ("type", "layer", "k"))


@query("AGG-58", "SELECT sha256(lower(query_text)) AS key, count(*) AS executions, round(avg(rating), 6) AS mean, count(*) FILTER (WHERE rating >= 4) AS hits FROM {feedback} GROUP BY 1")
def _(t):
    return t.feedback.groupBy(F.sha2(F.lower("query_text"), 256).alias("key")).agg(F.count("*").alias("executions"), F.round(F.avg("rating"), 6).alias("mean"), F.count_if(F.col("rating") >= 4).alias("hits"))


@query("AGG-62", "WITH o AS (SELECT src AS id, count(*) AS a FROM {edges} GROUP BY 1), i AS (SELECT dst AS id, count(*) AS b FROM {edges} GROUP BY 1) SELECT id, coalesce(a, 0) AS outgoing, coalesce(b, 0) AS incoming, coalesce(a, 0) + coalesce(b, 0) AS total FROM o FULL JOIN i USING (id) ORDER BY total DESC, id LIMIT 10")
def _(t):
    return audit.directed_degrees(t.edges)


@query("AGG-63", "SELECT layer, count(*) AS n, string_agg(DISTINCT labels[1], ',' ORDER BY labels[1]) AS classes FROM {nodes} GROUP BY layer")
def _(t):
    return t.nodes.groupBy("layer").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("labels")[0])), ",").alias("classes"))


@query("AGG-64", "SELECT round(100.0 * (SELECT count(*) FROM {edges}) / (SELECT count(*) FROM {nodes}), 2)::DOUBLE AS density")
def _(t):
    one = t.nodes.agg(F.count("*").alias("n")).join(t.edges.agg(F.count("*").alias("r")), F.lit(True))
    return one.select(F.round(F.try_divide(100.0 * F.col("r"), F.col("n")), 2).alias("density"))


@query("AGG-65", "SELECT k AS id, count(*) AS n, string_agg(name, '|' ORDER BY name) AS names FROM {nodes} GROUP BY k HAVING count(*) > 1")
def _(t):
    return t.nodes.groupBy(F.col("k").alias("id")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), "|").alias("names")).filter("n > 1")


@query("AGG-66", "SELECT rel_type, count(*) AS rows, count(source) AS with_source, count(*) - count(source) AS without_source, count(confidence) AS with_confidence, count(*) - count(confidence) AS without_confidence FROM (SELECT rel_type, confidence, CASE WHEN dst LIKE '%1' THEN 'feed' END AS source FROM {edges}) e GROUP BY 1")
def _(t):
    rows = t.edges.withColumn("source", F.when(F.col("dst").like("%1"), "feed"))
    return audit.completeness(rows, "rel_type", ("source", "confidence"))


@query("AGG-67", "SELECT count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation, min(value) AS least, max(value) AS most FROM events")
def _(t):
    return t.events.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("deviation"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("AGG-68", "SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem")
def _(t):
    return audit.correlations(t.lineitem, ("l_quantity", "l_extendedprice", "l_discount"))


@query("AGG-69", "WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.75) AS b FROM documents) SELECT doc_id, n_chars FROM documents, q WHERE n_chars < a - 1.5 * (b - a) OR n_chars > b + 1.5 * (b - a)")
def _(t):
    return audit.outliers(t.documents, "n_chars", "doc_id")


@query("SET-02", "WITH a AS (SELECT id FROM {store_a}), b AS (SELECT id FROM {store_b} UNION SELECT -1) SELECT (SELECT count(*) FROM (SELECT id FROM a INTERSECT SELECT id FROM b) x) AS common, (SELECT count(*) FROM (SELECT id FROM a EXCEPT SELECT id FROM b) x) AS only_left, (SELECT count(*) FROM (SELECT id FROM b EXCEPT SELECT id FROM a) x) AS only_right, round(100 * (SELECT count(*) FROM (SELECT id FROM a INTERSECT SELECT id FROM b) x) / (SELECT count(*) FROM (SELECT id FROM a UNION SELECT id FROM b) x), 4)::DOUBLE AS percent")
def _(t):
    return audit.overlap(t.store_a, t.store_b.select("id").union(t.spark.range(1).select(F.lit(-1).cast("long"))), "id")


@query("SET-03", "SELECT id FROM {store_a} EXCEPT SELECT id FROM {store_b}")
def _(t):
    return t.store_a.select("id").subtract(t.store_b.select("id"))


@query("SET-08", "SELECT id, 'removed' AS change, NULL::VARCHAR AS field, NULL::VARCHAR AS old, NULL::VARCHAR AS new FROM {store_a} WHERE id NOT IN (SELECT id FROM {store_b}) UNION ALL SELECT id, 'modified', 'status', a.status, b.status FROM {store_a} a JOIN {store_b} b USING (id) WHERE a.status <> b.status")
def _(t):
    return audit.snapshot_difference(t.store_a, t.store_b, "id", ("owner", "status"))


@query("SRC-01", "SELECT id, name FROM {nodes} ORDER BY id LIMIT 100 OFFSET 50")
def _(t):
    return storage.page(t.nodes.select("id", "name"), "id", 50, 100)


@query("SRC-05", """WITH batch AS (SELECT src, replace(lower(rel_type), '_', ' ') AS rel_type, dst, CASE WHEN confidence >= 0.5 THEN 1.5 - confidence END AS confidence FROM {edges} UNION ALL SELECT dst, 'seen:with', src, confidence FROM {edges} WHERE rel_type = 'SUPPLIES'),
  safe AS (SELECT src, upper(replace(replace(rel_type, ':', '_'), ' ', '_')) AS rel_type, dst, confidence FROM batch), ends AS (SELECT src AS id FROM batch UNION SELECT dst FROM batch)
  SELECT 'edge' AS kind, coalesce(e.src, s.src) AS src, coalesce(e.rel_type, s.rel_type) AS rel_type, coalesce(e.dst, s.dst) AS dst, coalesce(s.confidence, e.confidence) AS confidence FROM {edges} e FULL JOIN safe s ON e.src = s.src AND e.rel_type = s.rel_type AND e.dst = s.dst
  UNION ALL SELECT 'node', id, 'Entity', NULL, NULL FROM ends WHERE id NOT IN (SELECT id FROM {nodes})""")
def _(t):
    """All edges come again with other confidences, and those of suppliers also turned round; bare nodes stand beside the edges."""
    again = t.edges.select("src", F.translate(F.lower("rel_type"), "_", " ").alias("rel_type"), "dst", F.when(F.col("confidence") >= 0.5, 1.5 - F.col("confidence")).alias("confidence"))
    batch = again.union(t.edges.filter("rel_type = 'SUPPLIES'").select("dst", F.lit("seen:with"), "src", "confidence"))
    bare = storage.placeholders(t.nodes, batch).select(F.lit("node").alias("kind"), F.col("id").alias("src"), F.lit("Entity").alias("rel_type"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast("double").alias("confidence"))
    return storage.upsert_edges(t.edges, batch).select(F.lit("edge").alias("kind"), "*").union(bare)


@query("SRC-06", "SELECT id, CASE WHEN id = 'part:5' THEN 'closed' WHEN name = 'Order 7' THEN 'open' ELSE status END AS status FROM {nodes}")
def _(t):
    updates = t.spark.createDataFrame([("part:5", "closed"), ("Order 7", "open")], "ref string, value string")
    return storage.update_properties(t.nodes, updates, "status").select("id", "status")


@query("SRC-07", "SELECT src, rel_type, dst FROM {edges} WHERE src NOT LIKE 'nation:%' AND dst NOT LIKE 'nation:%'")
def _(t):
    return storage.delete_nodes(t.nodes, t.edges, t.nodes.filter("id like 'nation:%'"))[1].select("src", "rel_type", "dst")


@query("SRC-09", "SELECT id, CASE WHEN b.id IS NULL THEN 'delete' WHEN a.status <> b.status THEN 'update' ELSE 'keep' END AS action FROM {store_a} a LEFT JOIN {store_b} b USING (id)")
def _(t):
    return storage.reconcile(t.store_a, t.store_b, "id", ("status",))


@query("SRC-11", r"""WITH s AS (SELECT *, length(session_id) = 36 AND regexp_full_match(session_id, '[0-9a-fA-F]+-[0-9a-fA-F]+-[0-9a-fA-F]+-[0-9a-fA-F]+-[0-9a-fA-F]+') AS good, n % 4 = 0 AS known FROM {chat_sessions}), m AS (SELECT c.*, length(message_id) = 36 AND regexp_full_match(message_id, '[0-9a-fA-F]+-[0-9a-fA-F]+-[0-9a-fA-F]+-[0-9a-fA-F]+-[0-9a-fA-F]+') AS good, n % 4 = 0 AND seq % 3 = 0 AS known,
    n % 4 = 0 OR coalesce(n % 17 <> 0, false) AS able FROM {chat_messages} c), g AS (SELECT unnest([false, true]) AS every)
  SELECT CASE WHEN every THEN 'full' ELSE 'incremental' END AS mode, 'sessions' AS data, count(*) FILTER (WHERE good AND (every OR NOT known)) AS copied, count(*) FILTER (WHERE good AND known AND NOT every) AS known, count(*) FILTER (WHERE NOT good) AS bad_id, 0::BIGINT AS without_session FROM s, g GROUP BY every
  UNION ALL SELECT CASE WHEN every THEN 'full' ELSE 'incremental' END, 'messages', count(*) FILTER (WHERE good AND able AND (every OR NOT known)), count(*) FILTER (WHERE good AND able AND known AND NOT every), count(*) FILTER (WHERE NOT good), count(*) FILTER (WHERE good AND NOT able) FROM m, g GROUP BY every""")
def _(t):
    """Every fourth session and every third of its messages are already there."""
    there, said = t.chat_sessions.filter("n % 4 = 0"), t.chat_messages.filter("n % 4 = 0 and seq % 3 = 0")
    parts = [measures.copy_sessions(t.chat_sessions, t.chat_messages, there, said, full)[2].select(F.lit("full" if full else "incremental").alias("mode"), "*") for full in (False, True)]
    return parts[0].union(parts[1])


@query("SRC-12", "SELECT 'orders' AS data, (SELECT count(*) FROM {store_a}) AS left, (SELECT count(*) FROM {store_b}) AS right")
def _(t):
    return audit.store_sync(t.store_a, t.store_b, "orders").select("data", "left", "right")


@query("SRC-15", "WITH v AS (SELECT lower(name) AS variant, min(id) AS id FROM {nodes} WHERE id LIKE 'nation%' OR id LIKE 'region%' GROUP BY 1) SELECT n_name AS source, 'IN' AS rel_type, 'r' || n_regionkey AS target, v.id AS src, NULL::VARCHAR AS dst FROM nation LEFT JOIN v ON lower(n_name) = variant")
def _(t):
    names = t.nodes.filter("id like 'nation%' or id like 'region%'").select("id", F.lower("name").alias("name"))
    relations = t.nation.select(F.lower("n_name").alias("source"), F.lit("IN").alias("rel_type"), F.concat(F.lit("r"), "n_regionkey").alias("target"))
    found = storage.resolve_triples(relations, names)
    return t.nation.select(F.col("n_name").alias("source"), F.lower("n_name").alias("_s")).join(found.withColumnRenamed("source", "_s"), "_s").drop("_s")


@query("SRC-19", "SELECT id, type, layer, coalesce(status, 'none') AS policy FROM {nodes}")
def _(t):
    return t.nodes.select("id", "type", "layer", F.coalesce("status", F.lit("none")).alias("policy"))


@query("SRC-21", "SELECT id, CASE WHEN id % 20 = 0 THEN NULL ELSE status END AS status FROM {store_a}")
def _(t):
    stamped = storage.stamp(t.store_a, t.store_a.filter("id % 20 = 0"), "id", "b7")
    return storage.rollback(stamped, "b7", ["status"]).select("id", "status")


@query("SRC-22", """WITH b AS (SELECT *, CASE WHEN list_has_any(labels, ['MedicalEntity', 'Entity', 'PDFSource', 'RawConcept', 'Chunk', 'Document', 'Catalog', 'Schema', 'Table', 'Column', 'DataType', 'document', 'unknown', 'resource', 'concept']) THEN 'PERCEPTION'
    WHEN list_has_any(labels, ['SemanticConcept', 'Disease', 'Treatment', 'Drug', 'Symptom', 'Gene', 'Pathway', 'Diagnosis', 'Medication', 'Allergy', 'BusinessConcept', 'medication', 'treatment', 'medical_condition', 'body_part', 'profession']) THEN 'SEMANTIC'
    WHEN list_has_any(labels, ['InferredConcept', 'QualityRule', 'InferenceResult', 'DataQualityRule', 'DataQualityScore', 'Constraint', 'Policy', 'BusinessRule']) THEN 'REASONING'
    WHEN list_has_any(labels, ['QueryPattern', 'CachedResult', 'UsageMetric', 'Patient', 'Session', 'Message', 'UserFeedback']) THEN 'APPLICATION' END AS by_label FROM {older_nodes})
  SELECT id, coalesce(layer, by_label, 'PERCEPTION') AS layer, CASE WHEN layer IS NOT NULL THEN status WHEN coalesce(by_label, 'PERCEPTION') = 'PERCEPTION' THEN 'pending_validation' ELSE 'validated' END AS status,
    CASE WHEN layer IS NOT NULL OR by_label IS NULL THEN confidence WHEN by_label = 'PERCEPTION' THEN coalesce(confidence, 0.7) ELSE coalesce(confidence, 0.9) END AS confidence,
    CASE WHEN layer IS NULL THEN CASE WHEN by_label IS NULL THEN 'migration_default' ELSE 'migration_by_label' END END AS layer_assignment_method FROM b""")
def _(t):
    return measures.migrate_layers(t.older_nodes).select("id", "layer", "status", "confidence", "layer_assignment_method")


@query("JOIN-37", r"""WITH b AS (SELECT src, rel_type, dst FROM {edges} UNION ALL SELECT * FROM (VALUES ('part:1', 'X', 'part:1'), ('nobody', 'X', 'part:2'), ('part:3', 'X', ''))), e AS (SELECT id, unnest(map_entries(properties)) AS p FROM {entities} WHERE id <> ''),
  c AS (SELECT src, rel_type, dst, 'missing_target' AS conflict FROM b WHERE dst <> '' AND dst NOT IN (SELECT id FROM {nodes}) UNION ALL SELECT src, rel_type, dst, 'missing_source' FROM b WHERE dst <> '' AND src NOT IN (SELECT id FROM {nodes}) UNION ALL SELECT src, rel_type, dst, 'self_loop' FROM b WHERE src = dst
    UNION ALL SELECT src, rel_type, dst, 'duplicate' FROM b WHERE rel_type <> 'X' UNION ALL SELECT id, NULL, NULL, 'existing_id' FROM {entities} WHERE id <> '' AND id IN (SELECT id FROM {nodes})
    UNION ALL SELECT id, p.key, NULL, 'blank_property' FROM e WHERE regexp_full_match(p.key, '\s*') UNION ALL SELECT id, p.key, NULL, 'null_property' FROM e WHERE p.value IS NULL)
  SELECT src, rel_type, dst, conflict, CASE WHEN conflict IN ('existing_id', 'missing_source', 'missing_target') THEN 'high' WHEN conflict IN ('self_loop', 'blank_property') THEN 'medium' ELSE 'low' END AS severity,
    CASE conflict WHEN 'existing_id' THEN 'merge_entities' WHEN 'self_loop' THEN 'reject_operation' WHEN 'duplicate' THEN 'skip_duplicate' WHEN 'missing_source' THEN 'create_missing_entity' WHEN 'missing_target' THEN 'create_missing_entity' ELSE 'manual_review' END AS action, conflict LIKE '%property' AS manual FROM c""")
def _(t):
    """All edges come again, with three others; entities come as a batch of their own, whose properties stand in the place of types."""
    odd = t.spark.createDataFrame([("part:1", "X", "part:1"), ("nobody", "X", "part:2"), ("part:3", "X", "")], "src string, rel_type string, dst string")
    edges = storage.conflicts(t.edges.select("src", "rel_type", "dst").union(odd), t.nodes, t.edges)
    entities = storage.entity_conflicts(t.entities, t.nodes).select(F.col("id").alias("src"), F.col("property").alias("rel_type"), F.lit(None).cast("string").alias("dst"), "conflict")
    return storage.planned(edges.union(entities))
