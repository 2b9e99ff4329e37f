"""Fixed schemas of the relational tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_KINDS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "time": T.TimestampType(), "boolean": T.BooleanType(), "strings": T.ArrayType(T.StringType())}


def _struct(**kinds: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind], True) for name, kind in kinds.items()])


SESSIONS = _struct(session_id="long", subject_id="string", title="string", started="time", active="boolean")
MESSAGES = _struct(session_id="long", seq="long", role="string", content="string")
FEEDBACK = _struct(feedback_id="string", session_id="string", query_text="string", response_text="string", rating="int", feedback_type="string", correction_text="string", layers="strings", created_at="time")
DOCUMENTS = _struct(document_id="string", filename="string", category="string", status="string", size="long", entities="int", relationships="int")
DOCUMENT_QUALITY = _struct(document_id="string", score="double", level="string", assessed_at="time", recommendations="strings")
ONTOLOGY_QUALITY = _struct(assessment_id="string", score="double", level="string", coverage="double", compliance="double", coherence="double", assessed_at="time")
AUDIT_LOGS = _struct(event_id="string", event_type="string", action="string", entity_id="string", old_values="string", new_values="string", ts="time")
QUERY_ANALYTICS = _struct(query_hash="string", executions="long", mean_seconds="double", cache_hits="long", last_seen="time")

#: By table name.
TABLES = {
    "sessions": SESSIONS, "messages": MESSAGES, "feedback": FEEDBACK, "documents": DOCUMENTS, "document_quality": DOCUMENT_QUALITY, "ontology_quality": ONTOLOGY_QUALITY, "audit_logs": AUDIT_LOGS,
    "query_analytics": QUERY_ANALYTICS,
}


def conformed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """``rows`` with the schema's columns in its order and types; a column that is missing is null, others go."""
    known = {c.lower() for c in rows.columns}
    return rows.select(*((F.col(f.name) if f.name.lower() in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))
