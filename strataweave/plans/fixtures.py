"""Derived tables of the test data, as SQL that Spark and DuckDB both run, and the query registry.

``{name}`` in a text refers to another derived table or to a given one. Keys make all attributes, so that both engines
and every run agree.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import exists, materialize, measured_session, shared_dir

GIVEN = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())
REF_TIME = "2024-01-31 00:00:00"

FIXTURES: dict[str, str] = {
    "things": """
        SELECT 'region:' || cast(r_regionkey as string) AS id, r_name AS nm, 'Domain' AS cls, 'Domain' AS t, cast(r_regionkey as bigint) AS k FROM {region}
        UNION ALL SELECT 'nation:' || cast(n_nationkey as string), n_name, 'Domain', 'Domain', cast(n_nationkey as bigint) FROM {nation}
        UNION ALL SELECT 'customer:' || cast(c_custkey as string), c_name, 'BusinessConcept', 'BusinessConcept', c_custkey FROM {customer}
        UNION ALL SELECT 'supplier:' || cast(s_suppkey as string), s_name, 'Organization', 'Organization', s_suppkey FROM {supplier}
        UNION ALL SELECT 'part:' || cast(p_partkey as string), p_name, 'DataEntity', p_type, p_partkey FROM {part}
        UNION ALL SELECT 'order:' || cast(o_orderkey as string), 'Order ' || cast(o_orderkey as string), 'InformationAsset', 'InformationAsset', o_orderkey FROM {orders}""",
    "nodes": """
        SELECT id, CASE WHEN k % 3 = 0 THEN upper(nm) ELSE nm END AS name, CASE WHEN k % 17 = 0 THEN NULL ELSE t END AS type,
               CASE WHEN k % 2 = 0 THEN array(cls, 'Entity') ELSE array(cls) END AS labels,
               CASE k % 5 WHEN 0 THEN 'PERCEPTION' WHEN 1 THEN 'SEMANTIC' WHEN 2 THEN 'REASONING' WHEN 3 THEN 'APPLICATION' ELSE NULL END AS layer,
               cast(50 + k % 50 as double) / 100 AS confidence, cast(k % 13 as int) AS observation_count,
               CASE WHEN k % 4 = 0 THEN 'active' WHEN k % 4 = 1 THEN 'pending' ELSE NULL END AS status, k FROM {things}""",
    "edges": """
        SELECT src, rel_type, dst, cast(40 + (a + b) % 60 as double) / 100 AS confidence FROM (
        SELECT 'nation:' || cast(n_nationkey as string) AS src, 'PART_OF' AS rel_type, 'region:' || cast(n_regionkey as string) AS dst, cast(n_nationkey as bigint) AS a, cast(n_regionkey as bigint) AS b FROM {nation}
        UNION ALL SELECT 'customer:' || cast(c_custkey as string), 'BELONGS_TO', 'nation:' || cast(c_nationkey as string), c_custkey, cast(c_nationkey as bigint) FROM {customer} WHERE c_custkey % 7 <> 0
        UNION ALL SELECT 'supplier:' || cast(s_suppkey as string), 'BELONGS_TO', 'nation:' || cast(s_nationkey as string), s_suppkey, cast(s_nationkey as bigint) FROM {supplier}
        UNION ALL SELECT 'customer:' || cast(o_custkey as string), 'PLACED', 'order:' || cast(o_orderkey as string), o_custkey, o_orderkey FROM {orders} WHERE o_custkey % 7 <> 0
        UNION ALL SELECT DISTINCT 'order:' || cast(l_orderkey as string), 'CONTAINS', 'part:' || cast(l_partkey as string), l_orderkey, l_partkey FROM {lineitem}
        UNION ALL SELECT DISTINCT 'supplier:' || cast(l_suppkey as string), 'SUPPLIES', 'part:' || cast(l_partkey as string), l_suppkey, l_partkey FROM {lineitem}
        UNION ALL SELECT 'order:' || cast(o_orderkey as string), 'CONTAINS', 'part:' || cast(o_orderkey + 100000000 as string), o_orderkey, cast(0 as bigint) FROM {orders} WHERE o_orderkey % 1000 = 1) e""",
    "entities": """
        SELECT CASE WHEN k % 41 = 0 THEN '' WHEN k % 43 = 0 THEN 'a b ' || id WHEN k % 47 = 0 THEN id || '<x>' WHEN k % 53 = 0 THEN 'none' ELSE id END AS id, name, labels, layer, k,
               CASE k % 4 WHEN 0 THEN map_from_arrays(array('source', 'confidence', 'domain', 'description'), array('feed', cast(cast(k % 130 as double) / 100 as string), 'sales', CASE WHEN k % 8 = 0 THEN NULL ELSE 'text' END))
                 WHEN 1 THEN map_from_arrays(array('Type', 'origin', 'reasoning'), array('x', 'crm', 'rule')) WHEN 2 THEN map_from_arrays(array('usage_count', 'usage_context', 'access_pattern', 'confidence'), array('3', 'report', 'daily', '0.7'))
                 ELSE map_from_arrays(array('note', ' '), array(repeat('n', cast(k % 3 * 600 as int)), 'b')) END AS properties FROM {nodes}""",
    "noisy": """
        SELECT id, CASE k % 23 WHEN 0 THEN 'However' WHEN 1 THEN ' Which ' WHEN 2 THEN 'ab' WHEN 3 THEN 'none' WHEN 4 THEN 'vendor' ELSE name END AS name,
               CASE k % 19 WHEN 0 THEN array('ExtractedEntity') WHEN 1 THEN array('Entity', 'StructuralChunk') WHEN 2 THEN array('Message') WHEN 3 THEN array('Chunk', 'Document') WHEN 4 THEN array('InformationAsset') ELSE labels END AS labels,
               CASE WHEN k % 31 = 0 THEN 'DATA' WHEN k % 37 = 0 THEN 'semantic' ELSE layer END AS layer, k % 29 = 0 AS is_structural, k % 43 = 0 AS exclude_from_ontology FROM {nodes}""",
    "terms": """
        SELECT id, CASE k % 12 WHEN 0 THEN 'CustAddr' WHEN 1 THEN 'client' WHEN 2 THEN ' Order  Qty-No#' WHEN 3 THEN 'dx' WHEN 4 THEN 'pk' WHEN 5 THEN 'diagnosis' WHEN 6 THEN 'itemDesc_' WHEN 7 THEN 'empMgr Dept' WHEN 8 THEN 'HTN' WHEN 9 THEN ' T2DM ' ELSE name END AS term,
               CASE k % 9 WHEN 0 THEN 'medicine' WHEN 1 THEN 'Lab Result' WHEN 2 THEN ' person ' WHEN 3 THEN 'data-asset x2y' WHEN 4 THEN '' ELSE type END AS type FROM {nodes}""",
    "typed": """
        SELECT id, CASE k % 29 WHEN 0 THEN 'Medical Condition' WHEN 1 THEN 'tables' WHEN 2 THEN 'data-product' WHEN 3 THEN ' _Lab  Test_' WHEN 4 THEN 'Drug_Entity' WHEN 5 THEN 'therapies' WHEN 6 THEN 'Biomarkers' WHEN 7 THEN 'cell type'
                 WHEN 8 THEN 'Lineage' WHEN 9 THEN '!!' WHEN 10 THEN 'workflow_concept' WHEN 11 THEN 'KPIs' WHEN 12 THEN 'gene_type' WHEN 13 THEN 'Data Stewards' WHEN 14 THEN '3d-model' WHEN 15 THEN '' ELSE type END AS type, layer, k FROM {nodes}""",
    "rising": """
        SELECT n.id, n.name, n.type, n.labels, n.layer, n.confidence, n.observation_count, n.status, cast(n.k % 4 as int) AS validation_count, CASE WHEN n.k % 19 = 0 THEN array('C1') END AS ontology_codes, CASE WHEN n.k % 23 = 0 THEN array('r') ELSE array() END AS inference_rules,
               cast(coalesce(d.n, 0) as bigint) AS reference_count, cast(NULL as string) AS promoted_from, cast(NULL as int) AS version, n.k FROM {nodes} n LEFT JOIN (SELECT dst, count(*) AS n FROM {edges} GROUP BY dst) d ON d.dst = n.id""",
    "named_edges": """
        SELECT src, dst, CASE rel_type WHEN 'PART_OF' THEN 'belongsToDomain' WHEN 'BELONGS_TO' THEN CASE WHEN src LIKE 'supplier%' THEN 'represents' ELSE 'belongsToDomain' END WHEN 'PLACED' THEN 'relatedTo' WHEN 'CONTAINS' THEN CASE WHEN src LIKE '%7' THEN 'hasAttribute' ELSE 'derivedFrom' END ELSE 'SUPPLIES' END AS rel_type,
               CASE rel_type WHEN 'PART_OF' THEN 'has_schema' WHEN 'BELONGS_TO' THEN 'owned_by' WHEN 'PLACED' THEN 'write_to_table' WHEN 'CONTAINS' THEN CASE WHEN src LIKE '%3' THEN 'has_column' ELSE 'contains' END ELSE 'previous' END AS metadata_type FROM {edges}""",
    "hierarchy": """
        SELECT 'p' || cast(p_partkey as string) AS child, 'p' || cast(p_partkey div 2 as string) AS parent FROM {part} WHERE p_partkey > 1
        UNION ALL SELECT 'c1', 'c2' UNION ALL SELECT 'c2', 'c3' UNION ALL SELECT 'c3', 'c1'""",
    "chunks": """
        SELECT doc_id, cast(doc_id as string) || ':' || cast(i as string) AS chunk_id, cast(i as bigint) AS seq, substr(text, cast(i * 1000 + 1 as int), 1000) AS text
        FROM (SELECT doc_id, text, [[range (length(text) - 1) div 1000]] AS i FROM {documents} WHERE length(text) > 0) d""",
    "mentions": """
        SELECT DISTINCT chunk_id, doc_id, seq, lower(m) AS entity, CASE length(m) % 4 WHEN 0 THEN 'Person' WHEN 1 THEN 'Drug' WHEN 2 THEN 'Disease' ELSE 'Concept' END AS type,
               CASE WHEN length(m) % 2 = 0 THEN cast(0.6 as double) ELSE cast(0.75 as double) END AS confidence
        FROM (SELECT chunk_id, doc_id, seq, explode_all(text, '[A-Z][a-z][a-z][a-z][a-z][a-z][a-z]+') AS m FROM {chunks}) c""",
    "fact_mentions": """
        SELECT chunk_id, doc_id, seq, entity, CASE WHEN length(entity) % 5 = 0 THEN 'Medication' WHEN length(entity) % 11 = 0 THEN 'Cause' ELSE type END AS type, confidence FROM {mentions}""",
    "observations": """
        SELECT 'user:' || cast(user_id as string) || ':' || event_type AS id, user_id, CASE event_type WHEN 'click' THEN 'Symptom' WHEN 'view' THEN 'Medication' WHEN 'purchase' THEN 'Diagnosis' WHEN 'signup' THEN 'Preference' ELSE 'Other' END AS entity_type,
               min(ts) AS first_observed, max(ts) AS last_observed, count(*) AS observation_count, cast(sum(cast(value as decimal(18, 6))) as double) / count(*) / 499.7 AS confidence
        FROM {events} GROUP BY user_id, event_type""",
    "feedback": """
        SELECT event_id AS feedback_id, 's' || cast(user_id as string) AS session_id, 'q' || cast(event_id % 199 as string) AS query_text, 'r' || cast(event_id as string) AS response_text,
               cast(1 + event_id % 5 as int) AS rating, event_type AS feedback_type, CASE WHEN event_id % 9 = 0 THEN 'fixed ' || cast(event_id as string) END AS correction_text,
               CASE WHEN event_id % 2 = 0 THEN array('SEMANTIC', 'REASONING') ELSE array('PERCEPTION') END AS layers, 'user:' || cast(user_id as string) AS entity, ts AS created_at,
               event_id % 11 = 0 AS used_for_training FROM {events}""",
    "predictions": """
        SELECT event_id AS operation_id, event_type AS operation_type, event_type || ' item p' || cast(event_id % 7 as string) AS action, value / 500 AS confidence, event_id % 3 <> 0 AS success, ts FROM {events}""",
    "messages": """
        SELECT conv_id AS session_id, turn AS seq, role, coalesce(text, '') AS content, conv_id * 3600 + turn * 60 AS ts FROM {conversations}
        UNION ALL SELECT conv_id, turn + 100, role, coalesce(text, ''), conv_id * 3600 + (turn + 100) * 60 FROM {conversations} WHERE conv_id % 10 = 0""",
    "sessions": """
        SELECT conv_id AS session_id, conv_id % 20 AS subject_id, conv_id * 3600 AS started FROM {conversations} GROUP BY conv_id
        UNION ALL SELECT cast(1000000 as bigint), cast(3 as bigint), cast(0 as bigint)""",
    "assessments": """
        SELECT d.doc_id, cast(d.doc_id % 30 as int) AS day, cast(l.quality * 50 + d.n_chars % 50 as double) / 100 AS score,
               CASE WHEN l.quality * 50 + d.n_chars % 50 >= 80 THEN 'excellent' WHEN l.quality * 50 + d.n_chars % 50 >= 60 THEN 'good' WHEN l.quality * 50 + d.n_chars % 50 >= 30 THEN 'fair' ELSE 'critical' END AS level
        FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    "subjects": """
        SELECT 'c' || cast(c_custkey as string) AS subject_id,
               CASE c_custkey % 5 WHEN 0 THEN array('warfarin', 'aspirin') WHEN 1 THEN array('metformin', 'Tramadol', 'diazepam') WHEN 2 THEN array('ibuprofen', 'lisinopril', 'potassium') WHEN 3 THEN array('amoxicillin', 'naproxen') ELSE array('aspirin', 'metformin') END AS medications,
               CASE c_custkey % 4 WHEN 0 THEN array('diabetes', 'chronic kidney disease') WHEN 1 THEN array('hypertension', 'asthma', 'Heart failure') WHEN 2 THEN array('kidney disease', 'pregnancy') ELSE array('gout') END AS conditions,
               CASE c_custkey % 6 WHEN 0 THEN array('penicillin') WHEN 1 THEN array('aspirin') ELSE array('none') END AS allergies,
               CASE c_custkey % 3 WHEN 0 THEN array('thirst', 'fatigue', 'blurred vision', 'severe nausea', 'vomiting', 'mild abdominal pain') WHEN 1 THEN array('chest pain', 'shortness of breath') ELSE array('fatigue', 'Fever', 'chills', 'sudden confusion') END AS symptoms FROM {customer}""",
    "incoming": """
        SELECT p_partkey AS in_id, p_type AS type, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE substr(p_name, 1, cast(p_partkey % 5 as int) + 2) || substr(p_name, cast(p_partkey % 5 as int) + 4) END AS name
        FROM {part}""",
    "attributes": """
        SELECT DISTINCT replace(lower(p_brand), '#', '_') AS schema, CASE p_partkey % 3 WHEN 0 THEN 'dim_' WHEN 1 THEN 'raw_' ELSE '' END || replace(p_name, ' ', '_') AS table, cast(p_partkey % 12 as int) AS position,
               CASE p_partkey % 12 WHEN 0 THEN replace(p_name, ' ', '_') || '_id' WHEN 1 THEN split_part(p_name, ' ', 2) || '_id' WHEN 2 THEN 'created_at' WHEN 3 THEN 'total_amount' WHEN 4 THEN 'is_active' WHEN 5 THEN 'email'
                 WHEN 6 THEN 'order_day' WHEN 7 THEN 'total_rate' WHEN 8 THEN 'customer_name' WHEN 9 THEN 'quantity' WHEN 10 THEN 'long_description' ELSE 'memo' END AS column,
               CASE p_partkey % 5 WHEN 0 THEN 'Must be unique' WHEN 1 THEN 'cannot be null' WHEN 2 THEN 'must be in ISO format' WHEN 3 THEN 'anything' ELSE NULL END AS rule FROM {part}""",
    "asked": """
        SELECT event_id, user_id, ts, CASE event_id % 26
               WHEN 0 THEN 'What is ibuprofen?' WHEN 1 THEN 'Hello, good morning' WHEN 2 THEN 'My knee hurts and I am worried about it' WHEN 3 THEN 'thanks!'
               WHEN 4 THEN 'Should I take aspirin? It is urgent' WHEN 5 THEN 'qué es la diabetes y para qué sirve la insulina' WHEN 6 THEN 'por qué tengo dolor, es normal que duela hace 3 días' WHEN 7 THEN 'qué debo hacer ahora mismo, qué me recomienda'
               WHEN 8 THEN 'Tell me about the orders table and its columns' WHEN 9 THEN 'Can I combine warfarin with aspirin? I had chest pain yesterday' WHEN 10 THEN 'you mentioned something earlier about my diet, going back to that' WHEN 11 THEN 'what about the interaction with alcohol 2 weeks ago'
               WHEN 12 THEN 'cuéntame sobre el tratamiento para la tos del mes pasado' WHEN 13 THEN 'goodbye' WHEN 14 THEN 'can you explain the causes of fever this week' WHEN 15 THEN 'nothing in particular 40 months ago'
               WHEN 16 THEN 'I have been feeling better lately, thank you so much' WHEN 17 THEN 'why does it get worse?' WHEN 18 THEN 'my name is Pablo and i have a headache' WHEN 19 THEN 'random text with no meaning for anyone'
               WHEN 20 THEN 'hi, this is Marta speaking; my fever has resolved' WHEN 21 THEN 'is it normal? how much is too much, what should i do next' WHEN 22 THEN '  how are treatments for asthma chosen?  ' WHEN 23 THEN 'call me doctor, i am Rosa'
               WHEN 24 THEN 'the rash is gone. it went away: the cough' END AS question FROM {events}""",
    "store_a": "SELECT o_orderkey AS id, o_custkey AS owner, o_orderstatus AS status FROM {orders}",
    "store_b": "SELECT o_orderkey AS id, o_custkey AS owner, CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM {orders} WHERE o_orderkey % 20 <> 0",
    "shape_nodes": """
        SELECT 'catalog:' || cast(r_regionkey as string) AS id, array('Catalog') AS labels FROM {region} UNION ALL SELECT 'domain:' || cast(r_regionkey as string), array('Domain') FROM {region}
        UNION ALL SELECT 'schema:' || cast(n_nationkey as string), array('Schema') FROM {nation} UNION ALL SELECT 'rule:' || cast(n_nationkey as string), array('DataQualityRule') FROM {nation}
        UNION ALL SELECT DISTINCT 'type:' || cast(p_size % 7 as string), array('DataType') FROM {part}
        UNION ALL SELECT 'table:' || cast(s_suppkey as string), array('Table') FROM {supplier} UNION ALL SELECT 'column:' || cast(p_partkey as string), array('Column') FROM {part}
        UNION ALL SELECT 'constraint:' || cast(p_partkey as string), array('Constraint') FROM {part} UNION ALL SELECT 'assignment:' || cast(p_partkey as string), array('TypeAssignment') FROM {part}
        UNION ALL SELECT 'data:' || cast(p_partkey as string), array('DataEntity', 'Entity') FROM {part} UNION ALL SELECT 'concept:' || cast(c_custkey as string), array('BusinessConcept', 'Entity') FROM {customer}
        UNION ALL SELECT 'asset:' || cast(o_orderkey as string), array('InformationAsset') FROM {orders} UNION ALL SELECT 'link:' || cast(o_orderkey as string), array('Relationship') FROM {orders}""",
    "statements": """
        SELECT id, path, value, datatype FROM (
        SELECT 'catalog:' || cast(r_regionkey as string) AS id, 'name' AS path, r_name AS value, 'string' AS datatype FROM {region} WHERE r_regionkey <> 2
        UNION ALL SELECT 'catalog:' || cast(r_regionkey as string), 'layer', CASE WHEN r_regionkey = 3 THEN 'SEMANTIC' ELSE 'PERCEPTION' END, 'string' FROM {region}
        UNION ALL SELECT 'domain:' || cast(r_regionkey as string), 'name', r_name, 'string' FROM {region} UNION ALL SELECT 'domain:' || cast(r_regionkey as string), 'description', r_name || ' data', CASE WHEN r_regionkey = 1 THEN 'integer' ELSE 'string' END FROM {region} WHERE r_regionkey <> 4
        UNION ALL SELECT 'domain:' || cast(r_regionkey as string), 'layer', 'SEMANTIC', 'string' FROM {region} WHERE r_regionkey > 0
        UNION ALL SELECT 'schema:' || cast(n_nationkey as string), 'name', n_name, 'string' FROM {nation} UNION ALL SELECT 'schema:' || cast(n_nationkey as string), 'layer', 'PERCEPTION', 'string' FROM {nation} WHERE n_nationkey % 6 <> 0
        UNION ALL SELECT 'schema:' || cast(n_nationkey as string), 'belongsTo', CASE WHEN n_nationkey % 8 = 1 THEN 'domain:' ELSE 'catalog:' END || cast(n_regionkey as string), 'iri' FROM {nation} WHERE n_nationkey % 9 <> 0
        UNION ALL SELECT 'schema:' || cast(n_nationkey as string), 'belongsTo', 'catalog:0', 'iri' FROM {nation} WHERE n_nationkey % 10 = 3
        UNION ALL SELECT 'rule:' || cast(n_nationkey as string), 'name', n_name, 'string' FROM {nation} UNION ALL SELECT 'rule:' || cast(n_nationkey as string), 'expression', 'x > 0', 'string' FROM {nation} WHERE n_nationkey % 7 <> 0
        UNION ALL SELECT 'rule:' || cast(n_nationkey as string), 'dimension', CASE n_nationkey % 4 WHEN 0 THEN 'COMPLETENESS' WHEN 1 THEN 'ACCURACY' WHEN 2 THEN 'VALIDITY' ELSE 'BEAUTY' END, 'string' FROM {nation}
        UNION ALL SELECT 'rule:' || cast(n_nationkey as string), 'layer', CASE WHEN n_nationkey % 5 = 0 THEN 'SEMANTIC' ELSE 'REASONING' END, 'string' FROM {nation}
        UNION ALL SELECT 'table:' || cast(s_suppkey as string), 'name', s_name, CASE WHEN s_suppkey % 9 = 0 THEN 'integer' ELSE 'string' END FROM {supplier} UNION ALL SELECT 'table:' || cast(s_suppkey as string), 'belongsTo', 'schema:' || cast(s_nationkey as string), 'iri' FROM {supplier}
        UNION ALL SELECT 'table:' || cast(s_suppkey as string), 'layer', 'PERCEPTION', 'string' FROM {supplier} WHERE s_suppkey % 4 <> 0
        UNION ALL SELECT 'table:' || cast(l_suppkey as string), 'hasColumn', CASE WHEN l_partkey % 50 = 0 THEN 'data:' ELSE 'column:' END || cast(l_partkey as string), 'iri' FROM {lineitem} WHERE l_suppkey % 5 <> 0
        UNION ALL SELECT 'column:' || cast(p_partkey as string), 'name', p_name, 'string' FROM {part} WHERE p_partkey % 13 <> 0 UNION ALL SELECT 'column:' || cast(p_partkey as string), 'belongsTo', 'table:' || cast(1 + p_partkey % 10 as string), 'iri' FROM {part}
        UNION ALL SELECT 'column:' || cast(p_partkey as string), 'belongsTo', 'table:' || cast(2 + p_partkey % 10 as string), 'iri' FROM {part} WHERE p_partkey % 17 = 0
        UNION ALL SELECT 'column:' || cast(p_partkey as string), 'hasDataType', 'type:' || cast(p_size % 7 as string), 'iri' FROM {part} WHERE p_partkey % 11 <> 0
        UNION ALL SELECT 'column:' || cast(p_partkey as string), 'layer', CASE WHEN p_partkey % 19 = 0 THEN 'BASEMENT' ELSE 'PERCEPTION' END, 'string' FROM {part}
        UNION ALL SELECT 'constraint:' || cast(p_partkey as string), 'name', 'k' || cast(p_partkey as string), 'string' FROM {part} UNION ALL SELECT 'constraint:' || cast(p_partkey as string), 'constraintType', CASE p_partkey % 5 WHEN 0 THEN 'PRIMARY_KEY' WHEN 1 THEN 'FOREIGN_KEY' WHEN 2 THEN 'CHECK' WHEN 3 THEN 'UNIQUE' ELSE 'WISH' END, 'string' FROM {part}
        UNION ALL SELECT 'constraint:' || cast(p_partkey as string), 'appliesTo', CASE WHEN p_partkey % 12 = 0 THEN 'nowhere' ELSE 'column:' || cast(p_partkey as string) END, 'iri' FROM {part} WHERE p_partkey % 14 <> 0
        UNION ALL SELECT 'constraint:' || cast(p_partkey as string), 'referencesColumn', 'column:1', 'iri' FROM {part} WHERE p_partkey % 3 = 0
        UNION ALL SELECT 'assignment:' || cast(p_partkey as string), 'column', 'column:' || cast(p_partkey as string), 'iri' FROM {part} UNION ALL SELECT 'assignment:' || cast(p_partkey as string), 'dataType', CASE WHEN p_partkey % 21 = 0 THEN 'column:1' ELSE 'type:' || cast(p_size % 7 as string) END, 'iri' FROM {part} WHERE p_partkey % 23 <> 0
        UNION ALL SELECT 'assignment:' || cast(p_partkey as string), 'layer', 'PERCEPTION', 'string' FROM {part}
        UNION ALL SELECT 'data:' || cast(p_partkey as string), 'name', p_name, 'string' FROM {part} UNION ALL SELECT 'data:' || cast(p_partkey as string), 'origin', p_brand, 'string' FROM {part} WHERE p_partkey % 15 <> 0
        UNION ALL SELECT 'data:' || cast(p_partkey as string), 'layer', CASE WHEN p_partkey % 6 = 0 THEN 'REASONING' ELSE 'PERCEPTION' END, 'string' FROM {part}
        UNION ALL SELECT 'concept:' || cast(c_custkey as string), 'description', c_name, 'string' FROM {customer} WHERE c_custkey % 16 <> 0
        UNION ALL SELECT 'concept:' || cast(c_custkey as string), 'layer', CASE c_custkey % 4 WHEN 0 THEN 'PERCEPTION' WHEN 1 THEN 'SEMANTIC' WHEN 2 THEN 'REASONING' ELSE 'APPLICATION' END, 'string' FROM {customer}
        UNION ALL SELECT 'concept:' || cast(c_custkey as string), 'confidence', CASE WHEN c_custkey % 25 = 0 THEN '1.5' WHEN c_custkey % 26 = 0 THEN '-0.25' WHEN c_custkey % 27 = 0 THEN 'high' ELSE '0.75' END, CASE WHEN c_custkey % 27 = 0 THEN 'string' ELSE 'decimal' END FROM {customer} WHERE c_custkey % 3 > 0
        UNION ALL SELECT 'asset:' || cast(l_orderkey as string), 'derivedFrom', 'data:' || cast(l_partkey as string), 'iri' FROM {lineitem} WHERE l_orderkey % 18 <> 0
        UNION ALL SELECT 'asset:' || cast(o_orderkey as string), 'derivedFrom', 'concept:' || cast(o_custkey as string), 'iri' FROM {orders} WHERE o_orderkey % 22 = 0
        UNION ALL SELECT 'asset:' || cast(o_orderkey as string), 'confidence', '1.25', 'decimal' FROM {orders} WHERE o_orderkey % 24 = 0
        UNION ALL SELECT 'asset:' || cast(o_orderkey as string), 'layer', CASE o_orderkey % 3 WHEN 0 THEN 'SEMANTIC' WHEN 1 THEN 'PERCEPTION' ELSE 'REASONING' END, 'string' FROM {orders}
        UNION ALL SELECT 'link:' || cast(o_orderkey as string), 'source', 'concept:' || cast(o_custkey as string), CASE WHEN o_orderkey % 29 = 0 THEN 'string' ELSE 'iri' END FROM {orders} WHERE o_orderkey % 31 <> 0
        UNION ALL SELECT 'link:' || cast(o_orderkey as string), 'target', 'asset:' || cast(o_orderkey as string), 'iri' FROM {orders}
        UNION ALL SELECT 'link:' || cast(o_orderkey as string), 'target', 'asset:1', 'iri' FROM {orders} WHERE o_orderkey % 37 = 0
        UNION ALL SELECT 'link:' || cast(o_orderkey as string), 'relationshipType', 'PLACED', 'string' FROM {orders} WHERE o_orderkey % 41 <> 0) s""",
    "layer_changes": """
        SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'PERCEPTION' WHEN 1 THEN 'SEMANTIC' ELSE 'REASONING' END AS from_layer, CASE event_id % 3 WHEN 0 THEN 'SEMANTIC' WHEN 1 THEN 'REASONING' ELSE 'APPLICATION' END AS to_layer,
               CASE event_id % 7 WHEN 4 THEN 'pending' WHEN 5 THEN 'rejected' WHEN 6 THEN 'failed' ELSE 'completed' END AS status, ts AS requested_at,
               CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN ts + INTERVAL '90' SECOND ELSE ts + INTERVAL '7' MINUTE END AS completed_at FROM {events}""",
    "rated": """
        SELECT doc_id, CASE WHEN doc_id % 37 = 0 THEN NULL ELSE level END AS level, score AS overall_score, cast(doc_id % 101 as double) / 100 AS context_precision, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE cast(doc_id % 89 as double) / 100 END AS context_recall,
               cast(doc_id % 71 as double) / 100 AS topic_coverage, cast(doc_id % 53 as double) / 100 AS signal_to_noise, cast(doc_id % 31 as double) / 100 AS entity_extraction_rate, cast(NULL as double) AS retrieval_quality FROM {assessments}""",
    "titled": """
        SELECT session_id, started AS last_activity, CASE session_id % 7 WHEN 0 THEN 'About this' WHEN 1 THEN 'About This thing' WHEN 2 THEN NULL ELSE 'Talk' END AS title FROM {sessions}""",
    "chat_sessions": """
        SELECT session_id AS n, CASE WHEN session_id % 17 = 0 THEN 'bad-' || cast(session_id as string) ELSE '00000000-0000-4000-8000-' || lpad(cast(session_id as string), 12, '0') END AS session_id FROM {sessions}""",
    "chat_messages": """
        SELECT m.session_id AS n, m.seq, CASE WHEN m.seq % 13 = 12 THEN 'bad-' || cast(m.seq as string) ELSE '00000000-0000-4000-9000-' || lpad(cast(m.session_id * 1000 + m.seq as string), 12, '0') END AS message_id, s.session_id
        FROM {messages} m LEFT JOIN {chat_sessions} s ON s.n = m.session_id""",
    "older_nodes": """
        SELECT id, CASE k % 13 WHEN 1 THEN array('Drug') WHEN 2 THEN array('Policy', 'Table') WHEN 3 THEN array('Message') WHEN 4 THEN array('Alien') WHEN 5 THEN array('UserFeedback', 'BusinessRule') ELSE labels END AS labels,
               CASE WHEN k % 3 = 0 THEN layer END AS layer, status, CASE WHEN k % 6 <> 1 THEN confidence END AS confidence FROM {nodes}""",
    "vectors": "SELECT vec_id, embedding, label FROM {embeddings}",
}


def _spark(sql: str) -> str:
    sql = re.sub(r"\[\[range (.*?)\]\]", r"explode(sequence(0, cast(\1 as int)))", sql)
    return re.sub(r"explode_all\((\w+), ('[^']*')\)", r"explode(regexp_extract_all(\1, \2, 0))", sql)


def _duck(sql: str) -> str:
    sql = re.sub(r"\[\[range (.*?)\]\]", r"unnest(range(0, \1 + 1))", sql)
    sql = re.sub(r"explode_all\((\w+), ('[^']*')\)", r"unnest(regexp_extract_all(\1, \2))", sql)
    return sql.replace(" div ", " // ").replace("map_from_arrays(", "map(").replace("array(", "list_value(")


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


#: Derived tables that many queries share: written once a session to the shared folder.
STORED = frozenset(("nodes", "edges", "mentions", "observations"))
_WRITTEN: dict[tuple[str, str, str, str], DataFrame] = {}


class Tables:
    """The given and derived tables of a folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = measured_session(spark), sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in GIVEN:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in FIXTURES:
                sql = FIXTURES[name]
                made = self.spark.sql(_spark(sql), **{n: getattr(self, n) for n in _names(sql)})
                self._made[name] = self._stored(name, made) if name in STORED else made
            else:
                raise AttributeError(name)
        return self._made[name]


    def _stored(self, name: str, made: DataFrame) -> DataFrame:
        """The table as an earlier query of this session has written it, if that is still there."""
        key = (self.spark.sparkContext.applicationId, shared_dir(self.spark), self.sf_dir, name)
        if key not in _WRITTEN or not exists(_WRITTEN[key]):
            _WRITTEN[key] = materialize(made, f"derived-{name}")
        stored = _WRITTEN[key]
        return self.spark.read.schema(stored.schema).parquet(stored.stored_at)  # by this session, which need not be the one that wrote it


def oracle(sql: str) -> str:
    """DuckDB SQL with the derived tables that it refers to as common table expressions."""
    made: dict[str, str] = {}

    def add(text: str) -> str:
        for name in _names(text):
            if name not in GIVEN and name not in made:
                body = add(FIXTURES[name])
                made[name] = _duck(body)
        return re.sub(r"\{(\w+)\}", r"\1", text)

    body = add(sql.strip())
    head = ", ".join(f"{n} AS ({t})" for n, t in made.items())
    recursive = bool(re.match(r"WITH RECURSIVE ", body, re.I))
    own = re.sub(r"^WITH (RECURSIVE )?", "", body, flags=re.I) if re.match(r"WITH ", body, re.I) else ""
    if not head:
        return body
    return f"WITH {'RECURSIVE ' * recursive}{head}" + (f", {own}" if own else f" {body}")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a function of the tables as a query, with the SQL that must give the same rows."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[key] = oracle(sql)
        return f

    return register
