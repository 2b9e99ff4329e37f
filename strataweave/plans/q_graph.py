"""Resolution and graph operators as registered queries."""

from pyspark.sql import functions as F

from ..operators import graph, resolve, rules
from .fixtures import query

_DEG = "deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM {edges} UNION ALL SELECT dst FROM {edges}) e GROUP BY id)"


def _pairs(key: str) -> str:
    return f"""WITH {_DEG}, keyed AS (SELECT n.id, type, confidence, {key} AS key, coalesce(degree, 0) AS degree FROM {{nodes}} n LEFT JOIN deg USING (id) WHERE type IS NOT NULL),
  pairs AS (SELECT a.type, a.key, a.id AS a_id, b.id AS b_id, a.degree AS a_degree, b.degree AS b_degree, a.confidence AS a_confidence, b.confidence AS b_confidence FROM keyed a JOIN keyed b ON a.type = b.type AND a.key = b.key AND a.id < b.id)"""


_PAIR_COLUMNS = ["a_id", "b_id", "type", "key", "a_degree", "b_degree", "a_confidence", "b_confidence"]


@query("JOIN-01", _pairs("lower(trim(name))") + f" SELECT {', '.join(_PAIR_COLUMNS)} FROM pairs")
def _(t):
    return resolve.duplicate_pairs(t.nodes, t.edges).select(*_PAIR_COLUMNS)


@query("JOIN-02", _pairs("lower(name)") + " SELECT a_id, b_id FROM pairs")
def _(t):
    return resolve.duplicate_pairs(t.nodes, t.edges, trim=False).select("a_id", "b_id")


@query("WIN-03", _pairs("lower(trim(name))") + """ SELECT a_id, b_id, CASE WHEN a_degree > b_degree OR a_degree = b_degree AND a_confidence >= b_confidence THEN a_id ELSE b_id END AS winner,
  CASE WHEN a_degree <> b_degree THEN 'relationships' WHEN a_confidence <> b_confidence THEN 'confidence' ELSE 'first' END AS rationale FROM pairs""")
def _(t):
    return resolve.merge_plan(resolve.duplicate_pairs(t.nodes, t.edges)).select("a_id", "b_id", "winner", "rationale")


_EXACT = "exact AS (SELECT in_id, n.id AS cand_id, 1.0::DOUBLE AS score FROM {incoming} i JOIN {nodes} n ON i.type = n.type AND lower(i.name) = lower(n.name))"
_FUZZY = """fuzzy AS (SELECT in_id, n.id AS cand_id, 1 - levenshtein(lower(i.name), lower(n.name))::DOUBLE / greatest(length(i.name), length(n.name)) AS score
  FROM {incoming} i JOIN {nodes} n ON i.type = n.type WHERE 1 - levenshtein(lower(i.name), lower(n.name))::DOUBLE / greatest(length(i.name), length(n.name)) >= 0.85)"""


@query("JOIN-03", f"WITH {_EXACT} SELECT * FROM exact")
def _(t):
    return resolve.exact_matches(t.incoming, t.nodes)


@query("JOIN-04", f"WITH {_FUZZY} SELECT * FROM fuzzy")
def _(t):
    return resolve.fuzzy_matches(t.incoming, t.nodes)


@query("JOIN-05", """SELECT q.vec_id AS in_id, v.vec_id AS cand_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM {vectors} q JOIN {vectors} v ON q.label = v.label AND q.vec_id <> v.vec_id
  WHERE q.vec_id % 20 = 0 AND list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) >= 0.25""")
def _(t):
    return resolve.embedding_matches(t.vectors.filter("vec_id % 20 = 0"), t.vectors, 0.25)


_KEYED = "keyed AS (SELECT id, k, list_sort(list_distinct(list_filter(list_concat([layer, status, 'k' || (k % 3)], labels), lambda x: x IS NOT NULL))) AS keys FROM {nodes})"


def _keyed(t, *columns):
    keys = F.array_distinct(F.concat(F.array("layer", "status", F.concat(F.lit("k"), F.col("k") % 3)), F.col("labels")))
    return t.nodes.select("id", "k", *columns, F.array_compact(keys).alias("keys"))


@query("JOIN-06", f"""WITH {_KEYED}, sets AS (SELECT keys, count(*) AS candidates FROM keyed GROUP BY 1), asked AS (SELECT DISTINCT keys FROM keyed WHERE k % 20 = 0),
  scored AS (SELECT a.keys AS ka, b.keys AS kb, candidates, len(list_intersect(a.keys, b.keys))::DOUBLE / len(list_distinct(list_concat(a.keys, b.keys))) AS score FROM asked a, sets b)
  SELECT id AS in_id, array_to_string(kb, ',') AS cand_keys, candidates, score, score * 0.8 AS confidence FROM keyed JOIN scored ON keys = ka WHERE k % 20 = 0 AND score >= 0.75""")
def _(t):
    sets = _keyed(t)
    return resolve.key_jaccard(sets.filter("k % 20 = 0"), sets).withColumn("cand_keys", F.array_join("cand_keys", ","))


_NEAR = """embedded AS (SELECT q.vec_id AS in_id, 'part:' || v.vec_id AS cand_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM {vectors} q JOIN {vectors} v ON q.label = v.label AND q.vec_id <> v.vec_id
  WHERE q.vec_id % 20 = 0 AND list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) >= 0.2), near AS (SELECT * FROM embedded UNION ALL SELECT in_id, cand_id, 0.98 FROM fuzzy WHERE in_id % 3 = 1)"""


@query("JOIN-07", f"""WITH {_EXACT}, {_FUZZY}, {_NEAR}, {_KEYED}, best AS (SELECT in_id, cand_id, max(score) AS score FROM near GROUP BY 1, 2), pairs AS (SELECT f.in_id, f.cand_id, f.score * 0.3 + n.score * 0.5 AS score, a.keys AS x, b.keys AS y FROM fuzzy f JOIN best n ON n.in_id = f.in_id AND n.cand_id = f.cand_id
    JOIN keyed a ON a.id = 'part:' || f.in_id JOIN keyed b ON b.id = f.cand_id),
  mixed AS (SELECT in_id, cand_id, score + 0.2 * len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) AS score FROM pairs)
  SELECT * FROM exact UNION ALL SELECT * FROM mixed WHERE score >= 0.72 AND in_id NOT IN (SELECT in_id FROM exact)""")
def _(t):
    near = resolve.embedding_matches(t.vectors.filter("vec_id % 20 = 0"), t.vectors, 0.2).withColumn("cand_id", F.concat(F.lit("part:"), "cand_id"))
    sets = _keyed(t, "name", "type")
    own = sets.filter("id like 'part:%'").select(F.expr("cast(substring(id, 6) as bigint)").alias("id"), "keys")
    return resolve.hybrid_matches(t.incoming, sets, near, own, F.when(F.col("in_id") % 3 == 1, 0.98))


@query("JOIN-08", f"""WITH {_FUZZY}, best AS (SELECT in_id, max(score) AS score, arg_min(cand_id, (-score, cand_id)) AS cand_id FROM fuzzy GROUP BY in_id)
  SELECT i.in_id, CASE WHEN score >= 1 THEN 'merge' WHEN score >= 0.9 THEN 'link' ELSE 'create_new' END AS action, CASE WHEN score >= 0.9 THEN cand_id END AS cand_id, score FROM {{incoming}} i LEFT JOIN best USING (in_id)""")
def _(t):
    return resolve.resolution_actions(t.incoming, resolve.best_matches(t.incoming, t.nodes))


@query("JOIN-09", f"""WITH {_EXACT}, {_FUZZY}, rest AS (SELECT in_id, arg_min(cand_id, (-score, cand_id)) AS cand_id, max(score) AS score FROM fuzzy WHERE in_id NOT IN (SELECT in_id FROM exact) GROUP BY in_id)
  SELECT in_id, min(cand_id) AS cand_id, 1.0::DOUBLE AS score FROM exact GROUP BY in_id UNION ALL SELECT * FROM rest""")
def _(t):
    least = t.nodes.groupBy("type", F.lower("name").alias("name")).agg(F.min("id").alias("id"))  # of each name, so that no pairs of entities are made
    exact = resolve.exact_matches(t.incoming, least).groupBy("in_id").agg(F.min("cand_id").alias("cand_id"), F.lit(1.0).alias("score"))
    rest = resolve.best_matches(t.incoming.join(exact, "in_id", "left_anti"), t.nodes)
    best = rest.groupBy("in_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "cand_id")).alias("m"))
    return exact.union(best.select("in_id", "m.cand_id", -F.col("m.s")))


_MERGES = "merges AS (SELECT 'part:' || k AS loser, 'part:' || (k - 1) AS winner FROM {nodes} WHERE id LIKE 'part:%' AND k % 10 = 0)"


@query("JOIN-10", f"""WITH {_MERGES}, moved AS (SELECT coalesce(a.winner, src) AS src, rel_type, coalesce(b.winner, dst) AS dst, confidence FROM {{edges}} LEFT JOIN merges a ON src = a.loser LEFT JOIN merges b ON dst = b.loser)
  SELECT src, rel_type, dst, max(confidence) AS confidence FROM moved WHERE src <> dst GROUP BY ALL""")
def _(t):
    merges = t.nodes.filter("id like 'part:%' and k % 10 = 0").selectExpr("'part:' || k as loser", "'part:' || (k - 1) as winner")
    return resolve.rewire(t.edges, merges)


@query("JOIN-15", """WITH e AS (SELECT DISTINCT src, dst FROM {edges} WHERE rel_type IN ('PART_OF', 'BELONGS_TO', 'PLACED')), p2 AS (SELECT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src),
  p3 AS (SELECT p.src, c.dst FROM p2 p JOIN e c ON p.dst = c.src) SELECT 1 AS depth, count(*) AS n FROM e UNION ALL SELECT 2, count(*) FROM p2 UNION ALL SELECT 3, count(*) FROM p3""")
def _(t):
    return graph.path_frequency(t.edges.filter("rel_type in ('PART_OF', 'BELONGS_TO', 'PLACED')").dropDuplicates(["src", "dst"]))


@query("JOIN-16", """WITH RECURSIVE both_ways AS (SELECT src AS a, dst AS b, rel_type, src || '>' || rel_type || '>' || dst AS edge FROM {edges} UNION ALL SELECT dst, src, rel_type, src || '>' || rel_type || '>' || dst FROM {edges} WHERE src <> dst),
  walk(id, path, used, steps) AS (SELECT 'nation:3', '', []::VARCHAR[], 0 UNION ALL SELECT b, CASE WHEN steps = 0 THEN rel_type ELSE path || ',' || rel_type END, list_append(used, edge), steps + 1 FROM walk JOIN both_ways ON a = id WHERE steps < 2 AND NOT list_contains(used, edge))
  SELECT id, min(steps) AS distance, string_agg(DISTINCT path, '|' ORDER BY path) AS paths FROM walk GROUP BY id""")
def _(t):
    around = graph.neighbourhood_paths(t.edges, t.spark.createDataFrame([("nation:3",)], "id string"), 2)
    return around.select("id", "distance", F.array_join("paths", "|").alias("paths"))


@query("JOIN-21", "SELECT id, name FROM {nodes} WHERE id NOT IN (SELECT src FROM {edges} UNION SELECT dst FROM {edges})")
def _(t):
    return graph.orphans(t.nodes, t.edges).select("id", "name")


@query("FLT-12", "SELECT id, CASE WHEN list_has_any(labels, ['InformationAsset']) THEN 'episodic' WHEN list_has_any(labels, ['DataEntity', 'BusinessConcept']) THEN 'knowledge' ELSE 'unclassified' END AS orphan_class FROM {nodes} WHERE id NOT IN (SELECT src FROM {edges} UNION SELECT dst FROM {edges})")
def _(t):
    return graph.classify_orphans(t.nodes, t.edges, ["InformationAsset"], ["DataEntity", "BusinessConcept"]).select("id", "orphan_class")


@query("FLT-26", "SELECT id, name FROM {nodes} WHERE id NOT IN (SELECT src FROM {edges} UNION SELECT dst FROM {edges}) ORDER BY name, id LIMIT 100")
def _(t):
    return graph.orphans(t.nodes, t.edges).orderBy("name", "id").limit(100).select("id", "name")


@query("JOIN-22", "SELECT src, rel_type, dst, 'source' AS side FROM {edges} WHERE src NOT IN (SELECT id FROM {nodes}) UNION ALL SELECT src, rel_type, dst, 'target' FROM {edges} WHERE dst NOT IN (SELECT id FROM {nodes})")
def _(t):
    return graph.dangling(t.nodes, t.edges)


@query("JOIN-31", """WITH r AS (SELECT id, layer, list_position(['PERCEPTION', 'SEMANTIC', 'REASONING', 'APPLICATION'], layer) AS rank FROM {nodes} WHERE layer IS NOT NULL)
  SELECT src, rel_type, dst, a.layer AS src_layer, b.layer AS dst_layer FROM {edges} JOIN r a ON src = a.id JOIN r b ON dst = b.id WHERE a.rank > b.rank""")
def _(t):
    return graph.layer_inversions(t.edges, t.nodes).select("src", "rel_type", "dst", "src_layer", "dst_layer")


@query("JOIN-42", "SELECT src, rel_type, dst, list_aggregate(a.labels, 'string_agg', ',') AS src_labels, list_aggregate(b.labels, 'string_agg', ',') AS dst_labels FROM {edges} JOIN {nodes} a ON src = a.id JOIN {nodes} b ON dst = b.id")
def _(t):
    ends = graph.with_ends(t.edges, t.nodes, "labels")
    return ends.select("src", "rel_type", "dst", F.array_join("src_labels", ",").alias("src_labels"), F.array_join("dst_labels", ",").alias("dst_labels"))


@query("JOIN-44", "WITH first AS (SELECT id, name FROM {nodes} WHERE layer = 'SEMANTIC' ORDER BY id LIMIT 200) SELECT f.id, name, rel_type, dst FROM first f LEFT JOIN {edges} e ON f.id = e.src")
def _(t):
    return graph.graph_slice(t.nodes, t.edges, 200, "SEMANTIC")


@query("JOIN-45", "WITH d AS (SELECT 'out' AS direction, rel_type, dst AS other FROM {edges} WHERE src = 'nation:5' UNION ALL SELECT 'in', rel_type, src FROM {edges} WHERE dst = 'nation:5') SELECT d.*, n.name AS other_name FROM d LEFT JOIN {nodes} n ON other = n.id")
def _(t):
    return graph.node_detail(t.nodes, t.edges, "nation:5")


@query("SET-06", """WITH e AS (SELECT src, metadata_type AS rel_type, dst FROM {named_edges}) SELECT src, rel_type, dst FROM e
  UNION ALL SELECT dst, CASE rel_type WHEN 'has_schema' THEN 'belongs_to_schema' WHEN 'owned_by' THEN 'owner_of' WHEN 'write_to_table' THEN 'written_by' WHEN 'has_column' THEN 'belongs_to_table' WHEN 'previous' THEN 'next' END, src FROM e WHERE rel_type <> 'contains'""")
def _(t):
    return graph.inverse_edges(t.named_edges.select("src", F.col("metadata_type").alias("rel_type"), "dst"))


_TREE = "tree AS (SELECT child AS src, 'IS_A' AS rel_type, parent AS dst FROM {hierarchy})"


@query("ALG-03", f"WITH {_TREE} SELECT DISTINCT a.src, a.rel_type, b.dst FROM tree a JOIN tree b ON a.dst = b.src WHERE a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM tree c WHERE c.src = a.src AND c.dst = b.dst)")
def _(t):
    return graph.transitive_suggestions(t.hierarchy.selectExpr("child as src", "'IS_A' as rel_type", "parent as dst"))


@query("ALG-01", """WITH RECURSIVE up(node, root, steps) AS (SELECT child, parent, 1 FROM {hierarchy} WHERE child LIKE 'p%' UNION ALL SELECT node, parent, steps + 1 FROM up JOIN {hierarchy} ON root = child)
  SELECT node, max(steps)::INT AS depth, false AS cyclic FROM up GROUP BY node UNION ALL SELECT 'p1', 0, false UNION ALL SELECT unnest(['c1', 'c2', 'c3']), NULL, true""")
def _(t):
    return graph.hierarchy_depth(t.hierarchy)


@query("ALG-02", "SELECT 'c1>c2>c3' AS cycle")
def _(t):
    return graph.cycles(t.hierarchy)


@query("ALG-04", _pairs("lower(trim(name))") + " SELECT id, min(id) OVER (PARTITION BY type, key) AS canonical FROM keyed WHERE (type, key) IN (SELECT (type, key) FROM keyed GROUP BY type, key HAVING count(*) > 1)")
def _(t):
    return resolve.duplicate_groups(t.nodes)


@query("AGG-02", """SELECT n.c AS entities, e.c AS relationships, o.c AS orphans, round(o.c / n.c, 6) AS orphan_rate, CASE WHEN o.c / n.c >= 0.8 THEN 'critical' WHEN o.c / n.c >= 0.5 THEN 'high' WHEN o.c / n.c >= 0.2 THEN 'medium' ELSE 'low' END AS severity
  FROM (SELECT count(*) AS c FROM {nodes}) n, (SELECT count(*) AS c FROM {edges}) e, (SELECT count(*) AS c FROM {nodes} WHERE id NOT IN (SELECT src FROM {edges} UNION SELECT dst FROM {edges})) o""")
def _(t):
    return graph.graph_totals(t.nodes, t.edges)


@query("AGG-09", f"WITH {_DEG} SELECT CASE WHEN list_has_any(labels, ['InformationAsset']) THEN 'document' ELSE 'knowledge' END AS subgraph, count(*) AS nodes, round(avg(coalesce(degree, 0)), 6) AS average_degree, count(*) FILTER (WHERE degree IS NULL) AS isolated FROM {{nodes}} LEFT JOIN deg USING (id) GROUP BY 1")
def _(t):
    return graph.subgraph_stats(t.nodes, t.edges, ["InformationAsset"])


@query("AGG-22", """WITH rules(rel_type, a, b) AS (VALUES ('hasAttribute', 'DataEntity', 'Attribute'), ('hasAttribute', 'Table', 'Column'), ('belongsToDomain', '*', 'Domain'), ('derivedFrom', 'InformationAsset', 'DataEntity'), ('represents', 'DataEntity', 'BusinessConcept'), ('relatedTo', '*', '*')),
  ends AS (SELECT src, rel_type, dst, coalesce(x.labels, []) AS p, coalesce(y.labels, []) AS q FROM {named_edges} LEFT JOIN {nodes} x ON src = x.id LEFT JOIN {nodes} y ON dst = y.id)
  SELECT src, rel_type, dst, bool_or(a IS NULL OR ((a = '*' OR list_contains(p, a)) AND (b = '*' OR list_contains(q, b)))) AS valid FROM ends LEFT JOIN rules USING (rel_type) GROUP BY ALL""")
def _(t):
    return graph.cross_reference_validity(t.named_edges, t.nodes)


@query("AGG-50", "SELECT lower(trim(name)) AS key, count(DISTINCT type) AS types, count(*) AS n FROM {nodes} WHERE type IS NOT NULL GROUP BY 1 HAVING count(DISTINCT type) >= 2")
def _(t):
    return resolve.cross_type_duplicates(t.nodes)
