"""Linking, evidence, concept and extension operators as registered queries."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import extension
from ..operators import linking, rules
from ..operators.rules import LAYER_WEIGHTS
from .fixtures import query


@query("JOIN-13", "SELECT rel_type, dst, count(*) AS n FROM {edges} WHERE src LIKE 'supplier:%' AND dst IN (SELECT id FROM {nodes} WHERE list_contains(labels, 'DataEntity')) GROUP BY ALL ORDER BY n DESC, dst LIMIT 20")
def _(t):
    return linking.bridges(t.nodes, t.edges, "Organization", "DataEntity").orderBy(F.desc("n"), "dst").limit(20)


_WORDS = lambda c: f"list_distinct(list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda w: w <> ''))"
_LINKS = f"""c AS (SELECT n_nationkey AS concept_id, {_WORDS('n_name')} AS x FROM nation UNION ALL SELECT 100, ['bolt'] UNION ALL SELECT 101, ['red', 'gear'] UNION ALL SELECT 102, ['large', 'red', 'widget']),
  a AS (SELECT p_partkey AS asset_id, {_WORDS('p_name')} AS y, {_WORDS("p_name || ' ' || p_type || ' brand ' || p_brand")} AS d, CASE WHEN p_partkey % 3 = 0 THEN 'Column' ELSE 'Table' END AS kind FROM part),
  l AS (SELECT concept_id, asset_id, CASE WHEN list_has_all(y, x) OR list_has_all(x, y) THEN 0.95 ELSE 0.85 END::DOUBLE AS score, CASE kind WHEN 'Column' THEN 'REPRESENTED_IN' ELSE 'DESCRIBED_IN' END AS rel_type FROM c JOIN a ON list_has_all(y, x) OR list_has_all(x, y) OR list_has_all(d, x))"""


def _links(t):
    extra = t.spark.createDataFrame([(100, "bolt"), (101, "Red Gear"), (102, "large red widget")], "id int, name string")
    concepts = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).union(extra)
    assets = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_name", "p_type", F.lit("brand"), "p_brand").alias("description"), F.when(F.col("p_partkey") % 3 == 0, "Column").otherwise("Table").alias("kind"))
    return linking.containment(concepts, assets, {"Column": "REPRESENTED_IN"})


@query("JOIN-20", f"WITH {_LINKS} SELECT concept_id, asset_id, score, rel_type FROM l")
def _(t):
    return _links(t)


@query("JOIN-38", f"WITH {_LINKS} SELECT concept_id, count(*) AS assets, round(avg(score), 6) AS mean FROM l GROUP BY 1")
def _(t):
    return _links(t).groupBy("concept_id").agg(F.count("*").alias("assets"), F.round(F.avg("score"), 6).alias("mean"))


@query("JOIN-23", "SELECT a.src AS id, count(DISTINCT b.dst) AS linked FROM {edges} a JOIN {edges} b ON a.dst = b.src WHERE a.rel_type = 'PLACED' AND b.rel_type = 'CONTAINS' GROUP BY 1")
def _(t):
    return linking.concept_view(t.edges, "PLACED", "CONTAINS")


@query("JOIN-24", "SELECT src, dst, e.confidence FROM {edges} e JOIN {nodes} a ON src = a.id JOIN {nodes} b ON dst = b.id WHERE rel_type = 'SUPPLIES' AND e.confidence >= 0.95 ORDER BY e.confidence DESC, src, dst")
def _(t):
    return linking.confident_links(t.nodes, t.edges, "SUPPLIES", 0.95)


@query("JOIN-25", """WITH b AS (SELECT DISTINCT name, lower(name) AS key FROM {incoming}), n AS (SELECT id, lower(name) AS key FROM {nodes}), x AS (SELECT b.name, 1 AS rank, n.id FROM b JOIN n USING (key)
  UNION ALL SELECT b.name, 2, h.id FROM b JOIN (SELECT string_split(key, ' ')[1] AS head, min(id) AS id FROM n GROUP BY 1) h ON string_split(b.key, ' ')[1] = head WHERE length(head) > 3)
  SELECT name, arg_min(id, (rank, id)) AS id, CASE min(rank) WHEN 1 THEN 'exact' ELSE 'first_word' END AS how FROM x GROUP BY name""")
def _(t):
    return linking.link_mentions(t.incoming, t.nodes)


@query("JOIN-33", "SELECT feedback_id AS chosen_id, (SELECT arg_max(feedback_id, (created_at, feedback_id)) FROM {feedback} WHERE rating <= 2) AS rejected_id FROM {feedback} WHERE rating >= 4 ORDER BY created_at DESC, feedback_id DESC LIMIT 500")
def _(t):
    return linking.high_low_pairs(t.feedback)


@query("JOIN-34", "SELECT p_partkey AS id, CASE WHEN lower(p_name) = 'red bolt' THEN 'name' WHEN lower(p_type) = 'red bolt' THEN 'alias' ELSE 'part' END AS how FROM part WHERE contains(lower(p_name), 'red bolt') OR contains(lower(p_type), 'red bolt')")
def _(t):
    return linking.find_concepts(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array("p_type").alias("aliases")), "Red Bolt")


_TERMS = "t AS (SELECT DISTINCT user_id AS question, lower(p_name) AS term FROM events JOIN part ON p_partkey = 1 + (event_id % 50))"
_DEG = "deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM {edges} UNION ALL SELECT dst FROM {edges}) e GROUP BY id)"


def _questions(t):
    rows = t.events.select(F.col("user_id").alias("question"), (1 + F.col("event_id") % 50).alias("p_partkey")).join(t.part, "p_partkey")
    return rows.groupBy("question").agg(F.collect_set(F.lower("p_name")).alias("terms"))


_EVIDENCE = f"WITH {_TERMS}, {_DEG}, r AS (SELECT question, n.id, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY question ORDER BY coalesce(degree, 0) DESC, n.id) AS rank FROM t JOIN {{nodes}} n ON lower(n.name) = term LEFT JOIN deg ON deg.id = n.id)"


@query("JOIN-39", f"{_EVIDENCE} SELECT question, id, degree FROM r WHERE rank <= 3")
def _(t):
    return linking.evidence(_questions(t), t.nodes, t.edges)


@query("JOIN-48", f"{_EVIDENCE} SELECT question, count(*) AS found, sum(degree)::BIGINT AS degree FROM r WHERE rank <= 5 GROUP BY 1")
def _(t):
    return linking.evidence(_questions(t), t.nodes, t.edges, 5).groupBy("question").agg(F.count("*").alias("found"), F.sum("degree").alias("degree"))


@query("TOP-10", f"{_EVIDENCE} SELECT question, string_agg(id, ',' ORDER BY id) AS context FROM r WHERE rank <= 2 GROUP BY 1")
def _(t):
    return linking.evidence(_questions(t), t.nodes, t.edges, 2).groupBy("question").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("context"))


@query("AGG-59", f"WITH {_TERMS} SELECT question, round(least(least(count(*), 5) * 0.15, 1.0), 6)::DOUBLE AS confidence FROM t GROUP BY 1")
def _(t):
    counts = _questions(t).select("question", F.size("terms").alias("terms"))
    return linking.answer_confidence(counts, {"terms": (5, 0.15)})


@query("SCL-18", f"WITH {_TERMS} SELECT question, layer, count(DISTINCT id) AS entities, round(least(0.5 + 0.1 * count(DISTINCT id), 1.0) * CASE layer WHEN 'PERCEPTION' THEN 0.7 WHEN 'SEMANTIC' THEN 0.85 WHEN 'REASONING' THEN 0.9 ELSE 1.0 END, 6)::DOUBLE AS confidence FROM t JOIN {{nodes}} n ON lower(n.name) = term WHERE layer IS NOT NULL GROUP BY 1, 2")
def _(t):
    return linking.layered_retrieval(_questions(t), t.nodes, LAYER_WEIGHTS)


@query("JOIN-43", """WITH a AS (SELECT user_id, event_type AS inference, max(coalesce(CASE WHEN event_id % 7 > 0 THEN value / 500 END, 0.5)) AS inferred FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2), b AS (SELECT user_id, event_type AS entity, max(value / 1000) AS validated FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1, 2)
  SELECT user_id, inference, entity, inferred, validated FROM a JOIN b USING (user_id) WHERE abs(inferred - validated) > 0.3""")
def _(t):
    rows = lambda kinds, value: t.events.filter(F.col("event_type").isin(*kinds)).select("user_id", F.col("event_type").alias("name"), value.alias("confidence"))
    return linking.contradictions(rows(("view", "click"), F.when(F.col("event_id") % 7 > 0, F.col("value") / 500)), rows(("error", "purchase"), F.col("value") / 1000), "user_id")


@query("JOIN-46", "SELECT DISTINCT lower(name) AS name FROM {incoming} WHERE lower(name) NOT IN (SELECT lower(name) FROM {nodes})")
def _(t):
    return t.incoming.select(F.lower("name").alias("name")).distinct().join(t.nodes.select(F.lower("name").alias("name")), "name", "left_anti")


@query("JOIN-47", "WITH t AS (SELECT DISTINCT subject_id, unnest(symptoms) AS topic FROM {subjects}), c AS (SELECT subject_id, CASE WHEN subject_id LIKE '%1' THEN 'fatigue syndrome' ELSE 'gout' END AS condition FROM {subjects}) SELECT subject_id, topic FROM t WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.subject_id = t.subject_id AND (contains(topic, condition) OR contains(condition, topic))) QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY topic) <= 3")
def _(t):
    topics = t.subjects.select("subject_id", F.explode("symptoms").alias("topic"))
    resolved = t.subjects.select("subject_id", F.when(F.col("subject_id").like("%1"), "fatigue syndrome").otherwise("gout").alias("condition"))
    return linking.open_topics(topics, resolved)


@query("AGG-10", "SELECT round(count(*) FILTER (WHERE rel_type = 'SUPPLIES') / count(*), 6) AS bridge_ratio, (count(*) FILTER (WHERE rel_type = 'SUPPLIES') / count(*) > 0.1)::INT + (count(DISTINCT rel_type) > 50)::INT AS issues FROM {edges}")
def _(t):
    bridge = F.count_if(F.col("rel_type") == "SUPPLIES") / F.count("*")
    return t.edges.agg(F.round(bridge, 6).alias("bridge_ratio"), ((bridge > 0.1).cast("int") + (F.count_distinct("rel_type") > 50).cast("int")).alias("issues"))


@query("WIN-08", """WITH RECURSIVE r AS (SELECT feedback_type, rating, row_number() OVER (ORDER BY created_at, feedback_id) AS p FROM {feedback}), g AS (SELECT feedback_type, p, sum(CASE WHEN rating >= 4 THEN 1 ELSE -1 END) OVER w AS good, count(*) OVER w AS seen FROM r WINDOW w AS (PARTITION BY feedback_type ORDER BY p RANGE BETWEEN 99 PRECEDING AND CURRENT ROW)),
  s AS (SELECT feedback_type, CASE WHEN seen >= 10 THEN sign(good) * 0.01 ELSE 0 END::DOUBLE AS step, row_number() OVER (PARTITION BY feedback_type ORDER BY p) AS i FROM g),
  f(feedback_type, i, v) AS (SELECT DISTINCT feedback_type, 0::BIGINT, 0.5::DOUBLE FROM s UNION ALL SELECT f.feedback_type, s.i, least(greatest(v + step, 0), 1)::DOUBLE FROM f JOIN s ON s.feedback_type = f.feedback_type AND s.i = f.i + 1) SELECT feedback_type, round(arg_max(v, i), 4) AS weight FROM f GROUP BY 1""")
def _(t):
    return linking.adaptive_weights(t.feedback)


@query("TOP-02", """WITH near AS (SELECT src AS id, count(DISTINCT dst) AS near FROM (SELECT src, dst FROM {edges} UNION ALL SELECT dst, src FROM {edges}) e WHERE src <> dst GROUP BY 1),
  g AS (SELECT n.id, confidence AS v, coalesce(near, 0) AS near, round(0.4 * least(coalesce(near, 0) / 10, 1.0) + 0.3 * least(((name IS NOT NULL)::INT + (layer IS NOT NULL)::INT + (confidence IS NOT NULL)::INT + (observation_count IS NOT NULL)::INT + (status IS NOT NULL)::INT) / 5, 1.0)
    + 0.3 * CASE type WHEN 'BusinessConcept' THEN 1.0 WHEN 'Domain' THEN 0.9 WHEN 'InformationAsset' THEN 0.8 WHEN 'Table' THEN 0.6 WHEN 'Column' THEN 0.4 ELSE 0.5 END, 9)::DOUBLE AS g FROM {nodes} n LEFT JOIN near USING (id)),
  s AS (SELECT *, v * 0.7::DOUBLE + g * 0.3::DOUBLE AS score FROM g)
  SELECT id, v AS vector_score, g AS graph_score, score, CASE WHEN v <= 0.6 AND g <= 0.7 THEN printf('Low confidence match (vector=%.2f, graph=%.2f)', v, g)
    ELSE concat_ws('; ', CASE WHEN v > 0.8 THEN printf('High semantic similarity (%.2f)', v) WHEN v > 0.6 THEN printf('Moderate semantic similarity (%.2f)', v) END, CASE WHEN g > 0.7 THEN 'Well-connected in graph (' || near || ' neighbors)' END) END AS explanation
  FROM s WHERE score >= 0.3 ORDER BY score DESC, id LIMIT 10""")
def _(t):
    matches = t.nodes.select("id", F.col("confidence").alias("match"))
    return linking.hybrid_search(matches, t.nodes.drop("k"), t.edges)


@query("SET-04", "SELECT subject_id, array_to_string(list_sort(list_distinct(list_concat(medications, conditions))), ',') AS merged FROM {subjects}")
def _(t):
    merged = linking.merge_lists(t.subjects.select("subject_id", F.col("medications").alias("merged")), t.subjects.select("subject_id", F.col("conditions").alias("merged")), "subject_id", "merged")
    return merged.select("subject_id", F.array_join("merged", ",").alias("merged"))


@query("SET-07", "SELECT user_id AS question, event_type AS source, min(CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END) AS rank FROM events GROUP BY 1, 2")
def _(t):
    part = lambda r: t.events.filter(F.col("event_id") % 2 == r).select(F.col("user_id").alias("question"), F.col("event_type").alias("source"))
    return linking.ranked_sources([part(0), part(1)])


@query("ALG-05", "WITH RECURSIVE tree AS (SELECT child, parent FROM {hierarchy}), up(node, ancestor, distance) AS (SELECT child, parent, 1 FROM tree UNION SELECT node, parent, distance + 1 FROM up JOIN tree ON ancestor = child WHERE distance < 64) SELECT node, ancestor, min(distance)::INT AS distance FROM up WHERE node <> ancestor GROUP BY ALL")
def _(t):
    return linking.ancestry(t.hierarchy)


@query("SCL-32", r"""WITH w AS (SELECT schema, "table", position, regexp_extract(lower(CASE position % 4 WHEN 0 THEN 'Patient' WHEN 1 THEN '' WHEN 2 THEN ' lab' ELSE 'x1y_' END || "column" || ' note'), '\w+') AS t FROM {attributes})
  SELECT schema, "table", position, CASE WHEN contains(t, 'patient') THEN 'Patient' WHEN contains(t, 'customer') THEN 'Customer' WHEN contains(t, 'user') THEN 'User' WHEN contains(t, 'order') THEN 'SalesOrder' WHEN contains(t, 'product') THEN 'Product' WHEN contains(t, 'invoice') THEN 'Invoice'
    WHEN contains(t, 'diagnosis') THEN 'MedicalDiagnosis' WHEN contains(t, 'treatment') THEN 'Treatment' WHEN contains(t, 'medication') THEN 'Medication' WHEN contains(t, 'therapy') THEN 'Therapy' WHEN contains(t, 'appointment') THEN 'Appointment' WHEN contains(t, 'lab') THEN 'LaboratoryResult' WHEN contains(t, 'assessment') THEN 'Assessment'
    WHEN contains(t, 'provider') THEN 'HealthcareProvider' ELSE array_to_string(list_transform(regexp_extract_all(replace(t, '_', ' '), '[a-z]+|[^a-z]+'), lambda p: upper(p[1]) || p[2:]), '').replace(' ', '') END AS concept,
    CASE WHEN contains(t, 'patient') OR contains(t, 'customer') THEN 0.95 WHEN contains(t, 'user') OR contains(t, 'order') OR contains(t, 'product') THEN 0.9 WHEN contains(t, 'invoice') THEN 0.85 WHEN contains(t, 'diagnosis') THEN 0.9 WHEN contains(t, 'treatment') THEN 0.85 WHEN contains(t, 'medication') THEN 0.9
    WHEN contains(t, 'therapy') THEN 0.85 WHEN contains(t, 'appointment') THEN 0.8 WHEN contains(t, 'lab') THEN 0.85 WHEN contains(t, 'assessment') THEN 0.8 WHEN contains(t, 'provider') THEN 0.85 ELSE 0.6 END::DOUBLE AS confidence FROM w""")
def _(t):
    head = F.when(F.col("position") % 4 == 0, "Patient").when(F.col("position") % 4 == 1, "").when(F.col("position") % 4 == 2, " lab").otherwise("x1y_")
    found = linking.inferred_concept(F.concat(head, F.col("column"), F.lit(" note")))
    return t.attributes.select("schema", "table", "position", found.alias("found")).select("schema", "table", "position", "found.concept", "found.confidence")


@query("SCL-39", "SELECT c_custkey, concat_ws(', ', 'name: ' || c_name, 'segment: ' || c_mktsegment, 'nation: ' || c_nationkey::VARCHAR) AS row_text FROM customer")
def _(t):
    values = F.map_from_arrays(F.array(F.lit("name"), F.lit("segment"), F.lit("nation")), F.array("c_name", "c_mktsegment", F.col("c_nationkey").cast("string")))
    return t.customer.select("c_custkey", F.array_join(F.transform(F.map_entries(values), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ").alias("row_text"))


@query("SRC-10", """WITH d AS (SELECT DISTINCT p_brand AS brand, p_type AS type, p_name AS name FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY brand, type ORDER BY name) AS i FROM d), e AS (SELECT brand, type, row_number() OVER (PARTITION BY brand ORDER BY type) AS j FROM (SELECT DISTINCT brand, type FROM d) x)
  SELECT brand AS domain, 'attribute' AS kind, type AS entity, name || CASE WHEN i = 1 THEN ' (Primary Key)' WHEN i % 3 = 0 THEN ' (Foreign Key)' ELSE '' END AS item FROM n UNION ALL SELECT brand, 'primary_key', type, name FROM n WHERE i = 1 UNION ALL SELECT brand, 'foreign_key', type, name FROM n WHERE i > 1 AND i % 3 = 0
  UNION ALL SELECT brand, 'rule', type, type || ' must be unique' FROM e UNION ALL SELECT brand, 'description', type, 'All of ' || type FROM e UNION ALL SELECT brand, 'owner', 'Keeper of ' || brand, brand || ',' || 'sales' FROM (SELECT DISTINCT brand FROM d) x
  UNION ALL SELECT a.brand, '1:N', a.type, b.type || ': a ' || a.type || ' has many' FROM e a JOIN e b ON a.brand = b.brand AND b.j = a.j + 1""")
def _(t):
    """Specs of the part table, one a brand, written as Markdown and read back as tables."""
    import uuid

    from ..session import shared_dir
    from ..sources import specs

    path = f"{shared_dir(t.spark)}/specs-{uuid.uuid4().hex}"
    rows = t.part.select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_name").alias("name")).distinct()
    i = F.row_number().over(Window.partitionBy("brand", "type").orderBy("name"))
    item = F.concat(F.lit("  - "), "name", F.when(F.col("i") == 1, " (Primary Key)").when(F.col("i") % 3 == 0, " (Foreign Key)").otherwise(""))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", c.alias("x")))), lambda e: e["x"]), "\n")
    blocks = rows.withColumn("i", i).groupBy("brand", "type").agg(joined(item).alias("items"))
    blocks = blocks.withColumns({"i": F.row_number().over(Window.partitionBy("brand").orderBy("type")), "next": F.lead("type").over(Window.partitionBy("brand").orderBy("type"))})
    entity = F.concat(F.lit("### "), "type", F.lit("\n- **Description**: All of "), "type", F.lit("\n- **Key Attributes**:\n"), "items", F.lit("\n- **Business Rules**:\n  - "), "type", F.lit(" must be unique\n"))
    link = F.when(F.col("next").isNotNull(), F.concat(F.lit("- **"), "type", F.lit("** → **"), "next", F.lit("** (1:N)\n  - a "), "type", F.lit(" has many\n")))
    whole = blocks.groupBy("brand").agg(joined(entity).alias("entities"), joined(F.coalesce(link, F.lit(""))).alias("links"))
    text = F.concat(
        F.lit("# Agreement\n\n## Document Information\n- **Domain**: "), "brand", F.lit("\n- **Stakeholders**: "), "brand", F.lit(", sales\n- **Data Owner**: Keeper of "), "brand",
        F.lit("\n\n## Data Entities\n\n"), "entities", F.lit("\n## Relationships\n\n### All\n"), "links", F.lit("\n## Data Quality Requirements\n\n### Completeness\n- none\n"))
    whole.select(text.alias("value"), F.col("brand").alias("b")).repartition(8, "b").write.partitionBy("b").text(path)
    made = specs.read(t.spark, f"{path}/*")
    names = made["domains"].select("file", "domain")
    row = lambda df, kind, entity, item: df.join(names, "file").select("domain", F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), F.col(entity).alias("entity"), item.alias("item"))
    parts = [
        row(made["attributes"], "attribute", "entity", F.col("attribute")), row(made["entities"], "primary_key", "entity", F.col("primary_key")),
        row(made["entities"].withColumn("key", F.explode("foreign_keys")), "foreign_key", "entity", F.col("key")), row(made["rules"], "rule", "entity", F.col("rule")), row(made["entities"], "description", "entity", F.col("description")),
        made["domains"].select("domain", F.lit("owner").alias("kind"), F.col("data_owner").alias("entity"), F.array_join("stakeholders", ",").alias("item")),
        row(made["relationships"], F.col("type"), "source", F.concat("target", F.lit(": "), "description")),
    ]
    return reduce(lambda a, b: a.union(b), parts)


_CHECKS = [("typed", "type is not null", "error", True), ("sure", "confidence >= 0.7", "warning", True), ("off", "false", "error", False)]


@query("EXT-02", "SELECT id, 'typed' AS rule, 'error' AS severity FROM {nodes} WHERE type IS NULL UNION ALL SELECT id, 'sure', 'warning' FROM {nodes} WHERE NOT confidence >= 0.7")
def _(t):
    return extension.apply_checks(t.nodes, _CHECKS, "id")


@query("EXT-04", "SELECT user_id, round(1 - product(1 - confidence), 6) AS confidence FROM {observations} GROUP BY 1")
def _(t):
    return t.observations.groupBy("user_id").agg(F.round(extension.confidence_strategy("noisy_or", "confidence"), 6).alias("confidence"))


@query("EXT-05")
def _(t):
    from ..operators.resolve import name_pairs

    distinct = name_pairs(t.incoming, t.nodes, 0.85).select("x", "y").distinct()
    return distinct.select("x", "y", F.round(extension.matching_ratio("x", "y"), 6).alias("ratio"))
