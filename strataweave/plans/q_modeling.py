"""Catalog, training-format and document-graph operators as registered queries."""

import uuid

from pyspark.sql import functions as F

from ..functions import training
from ..operators import catalog, documents, linking, ontology
from ..session import shared_dir
from ..sources import files
from .fixtures import query

_PARTS = " ".join(f"WHEN {' OR '.join(f'contains(c, {chr(39)}{p}{chr(39)})' for p in parts)} THEN '{kind}'" for kind, parts in catalog.TYPE_PARTS)
_TYPED = f"typed AS (SELECT *, CASE {_PARTS} ELSE 'VARCHAR' END AS kind FROM (SELECT *, lower(\"column\") AS c FROM {{attributes}}) a)"
_RULE = "CASE WHEN contains(lower(rule), 'unique') THEN 'uk' WHEN contains(lower(rule), 'cannot be null') THEN 'nn' WHEN contains(lower(rule), 'must be') AND contains(lower(rule), 'format') THEN 'chk' END"


@query("SCL-29", f"""WITH {_TYPED} SELECT DISTINCT "column", kind AS type, CASE WHEN kind = 'DECIMAL' THEN 10 WHEN kind <> 'VARCHAR' THEN NULL WHEN contains(c, 'email') THEN 255 WHEN contains(c, 'name') THEN 100 WHEN contains(c, 'description') OR contains(c, 'text') THEN 500 ELSE 100 END AS precision,
  CASE WHEN kind = 'DECIMAL' THEN CASE WHEN contains(c, 'rate') AND NOT contains(c, 'amount') THEN 4 ELSE 2 END END AS scale, CASE kind WHEN 'VARCHAR' THEN 'STRING' WHEN 'BOOLEAN' THEN 'BOOLEAN' WHEN 'DATE' THEN 'TEMPORAL' WHEN 'TIMESTAMP' THEN 'TEMPORAL' ELSE 'NUMERIC' END AS base FROM typed""")
def _(t):
    return t.attributes.select("column", catalog.attribute_type(F.col("column")).alias("a")).select("column", "a.*").distinct()


@query("SCL-30", f"""SELECT DISTINCT schema, CASE {_RULE} WHEN 'uk' THEN 'UNIQUE' WHEN 'nn' THEN 'NOT_NULL' ELSE 'CHECK' END AS kind, {_RULE} || '_' || "table" || '_' || "column" AS name FROM {{attributes}} WHERE {_RULE} IS NOT NULL""")
def _(t):
    found = t.attributes.select("schema", catalog.constraint(F.col("rule"), F.col("table"), F.col("column")).alias("c"))
    return found.filter("c is not null").select("schema", "c.kind", "c.name").distinct()


@query("JOIN-41", f"""WITH {_TYPED} SELECT schema, count(DISTINCT "table") AS tables, count(*) AS columns, count(DISTINCT kind) AS types FROM typed GROUP BY 1""")
def _(t):
    return catalog.overview(t.attributes)


@query("JOIN-35", """SELECT f.schema, f."table", f."column", min(k."table") AS target FROM {attributes} f JOIN {attributes} k ON f.schema = k.schema AND k.position = 0 AND f.position > 0 AND f."table" <> k."table" AND f."column" LIKE '%id' AND (k."column" = f."column" OR k."column" LIKE '%\\_' || f."column" ESCAPE '\\') GROUP BY ALL""")
def _(t):
    return catalog.foreign_keys(t.attributes)


@query("SCL-31", f"""WITH {_TYPED}, r AS (SELECT schema, "table", 'schema:' || schema AS s, 'table:' || schema || '.' || "table" AS t, 'column:' || schema || '.' || "table" || '.' || "column" AS c, 'type:' || kind AS k, 'constraint:' || schema || '.' || {_RULE} || '_' || "table" || '_' || "column" AS x FROM typed)
  SELECT s AS src, 'HAS_TABLE' AS rel_type, t AS dst FROM r UNION SELECT t, 'HAS_COLUMN', c FROM r UNION SELECT c, 'HAS_TYPE', k FROM r UNION SELECT c, 'HAS_CONSTRAINT', x FROM r WHERE x IS NOT NULL UNION SELECT 'file:' || schema || '.raw_' || "table" || '.csv', 'TRANSFORMS_INTO', t FROM r
  UNION SELECT a.t, 'TRANSFORMS_INTO', b.t FROM r a JOIN r b ON a.schema = b.schema AND a."table" = 'raw_' || substr(b."table", 5) AND b."table" LIKE 'dim%'""")
def _(t):
    return catalog.graph_edges(t.attributes)


@query("JOIN-30", "WITH p(policy, k) AS (VALUES ('retain', 3), ('mask', 5)) SELECT id, string_agg(policy, ',' ORDER BY policy) AS policies FROM {nodes} LEFT JOIN p ON nodes.k % p.k = 0 GROUP BY id")
def _(t):
    named = lambda name, k: t.nodes.filter(F.col("k") % k == 0).select(F.lit(name).alias("policy"), F.array("id").alias("applies_to"))
    return catalog.policies_by_asset(named("retain", 3).union(named("mask", 5)), t.nodes)


@query("SRC-14", """WITH k AS (SELECT lower(name) AS entity, min(id) AS dst FROM (SELECT 'n' || n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'd' || doc_id, (regexp_extract_all(text, '[A-Z][a-z]{6,}'))[1] FROM documents) x WHERE name IS NOT NULL GROUP BY 1)
  SELECT 'doc:' || doc_id AS src, 'HAS_CHUNK' AS rel_type, chunk_id AS dst, 1.0::DOUBLE AS confidence FROM {chunks} UNION ALL SELECT chunk_id, 'MENTIONS', 'extracted:' || entity, max(confidence) FROM {mentions} GROUP BY 1, 3 UNION ALL SELECT 'extracted:' || entity, 'LINKS_TO', dst, max(confidence) FROM {mentions} JOIN k USING (entity) GROUP BY 1, 3""")
def _(t):
    named = t.documents.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.regexp_extract("text", "[A-Z][a-z]{6,}", 0).alias("name")).filter("name <> ''")
    known = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name")).union(named)
    return documents.graph(t.documents, t.chunks, t.mentions, known)[1]


@query("SRC-17", "SELECT feedback_id::VARCHAR AS feedback_id, to_json(layers)::VARCHAR AS layers, query_text, rating::VARCHAR AS rating FROM {feedback}")
def _(t):
    path = f"{shared_dir(t.spark)}/export-{uuid.uuid4().hex}"
    files.export(t.feedback.select("rating", "query_text", "layers", "feedback_id"), path, "csv")
    return t.spark.read.option("header", True).option("escape", '"').csv(path)


_S = "'Answer briefly.'"
_FORMATS = {
    "dpo": "json_object('prompt', trim(q), 'chosen', trim(r), 'rejected', trim(c))", "sft": "json_object('prompt', CASE WHEN i <> '' THEN q || chr(10) || chr(10) || i ELSE q END, 'completion', r)", "alpaca": "json_object('instruction', q, 'input', i, 'output', r)",
    "sharegpt": f"json_object('conversations', [{{{{'from': 'system', 'value': {_S}}}}}, {{{{'from': 'human', 'value': CASE WHEN i <> '' THEN i ELSE q END}}}}, {{{{'from': 'gpt', 'value': r}}}}])",
    "chat": f"json_object('messages', [{{{{'role': 'system', 'content': {_S}}}}}, {{{{'role': 'user', 'content': CASE WHEN i <> '' THEN i ELSE q END}}}}, {{{{'role': 'assistant', 'content': r}}}}])",
    "dpo_chat": f"json_object('prompt', [{{{{'role': 'system', 'content': {_S}}}}}, {{{{'role': 'user', 'content': q}}}}], 'chosen', [{{{{'role': 'assistant', 'content': r}}}}], 'rejected', [{{{{'role': 'assistant', 'content': c}}}}])",
}


@query("SCL-37", ("WITH f AS (SELECT feedback_id, query_text AS q, CASE WHEN rating = 5 THEN 'about ' || feedback_type ELSE '' END AS i, CASE WHEN length(response_text) > 4 THEN response_text[1:4] || '...' ELSE response_text END AS r, coalesce(correction_text, '') AS cc, CASE WHEN length(coalesce(correction_text, '')) > 4 THEN correction_text[1:4] || '...' ELSE coalesce(correction_text, '') END AS c FROM {feedback} WHERE rating >= 4) "
  + " UNION ALL ".join(f"SELECT feedback_id, '{name}' AS format, {made}::VARCHAR AS line FROM f" for name, made in _FORMATS.items())).replace("{{", "{").replace("}}", "}"))
def _(t):
    rows = t.feedback.filter("rating >= 4")
    q, r, c = F.col("query_text"), training.cleaned(F.col("response_text"), 4), training.cleaned(F.col("correction_text"), 4)
    i, system = F.when(F.col("rating") == 5, F.concat(F.lit("about "), "feedback_type")).otherwise(""), "Answer briefly."
    made = {"dpo": training.dpo(q, r, c), "sft": training.sft(q, i, r), "alpaca": training.alpaca(q, i, r), "sharegpt": training.sharegpt(q, i, r, system), "chat": training.chat(q, i, r, system), "dpo_chat": training.dpo_chat(q, r, c, system)}
    lines = F.array(*(F.struct(F.lit(name).alias("format"), F.to_json(x).alias("line")) for name, x in made.items()))
    return rows.select("feedback_id", F.explode(lines).alias("x")).select("feedback_id", "x.*")


_CANONICAL = sorted(r[0] for r in (*ontology.DATA_TYPES, *ontology.MEDICAL_TYPES))
_CANON = ", ".join(f"('{x}')" for x in _CANONICAL)


@query("TOP-06", f"""WITH c(canonical) AS (VALUES {_CANON}), k AS (SELECT DISTINCT type FROM {{nodes}} WHERE type IS NOT NULL UNION SELECT DISTINCT replace(p_name, ' ', '-') FROM part), s AS (SELECT type, canonical, round(1 - levenshtein(translate(lower(type), '- ', '__'), canonical)::DOUBLE / greatest(length(type), length(canonical)), 6) AS score FROM k, c)
  SELECT type, canonical, score FROM s WHERE score > 0.4 QUALIFY row_number() OVER (PARTITION BY type ORDER BY score DESC, canonical) <= 5""")
def _(t):
    return linking.suggest_types(t.nodes.select("type").union(t.part.select(F.replace("p_name", F.lit(" "), F.lit("-")))), _CANONICAL)


_DICT = (("aspirin", "aspirin"), ("aspro", "aspirin"), ("warfarin", "warfarin"), ("metformin", "metformin"), ("metforal", "metformin"), ("ibuprofen", "ibuprofen"), ("lisinopril", "lisinopril"), ("amoxicillin", "amoxicillin"))
_RATIO = "CASE WHEN key = known THEN 1.0::DOUBLE ELSE round(1 - levenshtein(key, known)::DOUBLE / greatest(length(key), length(known)), 6) END"


@query("TOP-07", "WITH d(known, generic) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _DICT) + f"""), m AS (SELECT DISTINCT CASE WHEN subject_id LIKE '%1' THEN unnest(medications) ELSE unnest(medications)[3:] END AS name FROM {{subjects}}), n AS (SELECT name, lower(trim(name)) AS key FROM m),
  s AS (SELECT name, known, generic, {_RATIO} AS score FROM n, d), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, known) AS k FROM s WHERE score > 0.4), b AS (SELECT name, max(score) AS score, arg_min(generic, k) AS generic, list(generic ORDER BY k) FILTER (WHERE score >= 0.5) AS near FROM r WHERE k <= 3 GROUP BY 1)
  SELECT name, coalesce(score >= 0.7, false) AS is_valid, CASE WHEN score >= 0.7 THEN upper(generic[1]) || generic[2:] END AS validated, coalesce(score, 0)::DOUBLE AS confidence,
    CASE WHEN score = 1 THEN '' ELSE coalesce(array_to_string(list_transform(list_filter(near, lambda x, i: list_position(near, x) = i), lambda x: upper(x[1]) || x[2:]), ','), '') END AS suggestions FROM n LEFT JOIN b USING (name)""")
def _(t):
    names = t.subjects.select("subject_id", F.explode("medications").alias("m")).select(F.when(F.col("subject_id").like("%1"), F.col("m")).otherwise(F.expr("substring(m, 3)")).alias("name"))
    found = linking.validate_names(names, t.spark.createDataFrame(list(_DICT), "known string, generic string"))
    return found.withColumn("suggestions", F.array_join("suggestions", ","))
