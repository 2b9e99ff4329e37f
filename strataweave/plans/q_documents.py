"""Document quality, catalog and training-format operators as registered queries."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog, documents
from .fixtures import GIVEN, query

_TOPICS = ("study", "System", "market", "river")
_HELD = lambda values: f"len(list_filter([{', '.join(repr(v.lower()) for v in values)}], lambda w: contains(lower(coalesce(text, '')), w)))"
_SUFFICIENT = lambda topic: f"SELECT doc_id, {_HELD(text.INDICATORS)}::INT AS indicators, round({_HELD(text.INDICATORS)} / 14.0::DOUBLE, 6) AS claim_coverage, round({topic}::DOUBLE, 6) AS topic_coverage, round(({topic}::DOUBLE + {_HELD(text.INDICATORS)} / 14.0::DOUBLE) / 2, 6) AS completeness FROM documents"


@query("AGG-45", _SUFFICIENT(f"({_HELD(_TOPICS)} / 4.0::DOUBLE)"))
def _(t):
    return documents.sufficiency(t.documents, _TOPICS)


_DENSITY = r"""fs AS (SELECT doc_id, chunk_id, regexp_replace(s, '^\s+|\s+$', '', 'g') AS s FROM (SELECT doc_id, chunk_id, unnest(string_split_regex(text, '[.!?]')) AS s FROM {chunks})),
  fk AS (SELECT doc_id, chunk_id, regexp_replace(lower(substr(s, 1, 50)), '\s+', ' ', 'g') AS key FROM fs WHERE length(s) >= 10 AND regexp_matches(regexp_replace(s, '[À-ÖØ-öø-ɏ]', '_', 'g'), '\d+|(?i:\b(is|are|was|were|has|have|caused?|leads?|results?|shows?)\b)|(?i:\b(treatment|medication|disease|patient|study|research)\b)')),
  fn AS (SELECT doc_id, chunk_id, key, count(*) OVER (PARTITION BY doc_id, key) AS n FROM fk), fc AS (SELECT c.doc_id, c.chunk_id, count(key) AS facts, count(*) FILTER (WHERE n > 1) AS repeated FROM {chunks} c LEFT JOIN fn ON fn.doc_id = c.doc_id AND fn.chunk_id = c.chunk_id GROUP BY ALL),
  fd AS (SELECT doc_id, count(DISTINCT key) AS d FROM fk GROUP BY 1), fr AS (SELECT doc_id, count(*) AS chunks, sum(facts)::BIGINT AS facts, count(*) FILTER (WHERE facts < 3) AS low_density, count(*) FILTER (WHERE repeated > 0.5 * facts) AS redundant FROM fc GROUP BY 1),
  density AS (SELECT doc_id, facts, coalesce(d, 0) AS distinct_facts, round(coalesce(d, 0) / chunks, 6) AS facts_a_chunk, round(CASE WHEN facts > 0 THEN (facts - coalesce(d, 0)) / facts ELSE 0.0::DOUBLE END, 6) AS redundancy,
    round(1 - least(CASE WHEN facts > 0 THEN (facts - coalesce(d, 0)) / facts ELSE 0.0::DOUBLE END, 0.8::DOUBLE), 6) AS signal_to_noise, low_density, redundant FROM fr LEFT JOIN fd USING (doc_id))"""
_STANDARD = ", ".join(f"'{x}'" for x in documents.STANDARD_TYPES)
_ENTITIES = f"""en AS (SELECT doc_id, lower(entity) AS entity, count(*) AS n, count(DISTINCT chunk_id) AS c, count(DISTINCT type) AS k FROM {{mentions}} GROUP BY 1, 2), ed AS (SELECT doc_id, count(*) AS entities, count(*) FILTER (WHERE n > 3) AS often, count(*) FILTER (WHERE k > 1) AS ambiguous, count(*) FILTER (WHERE c > 1) AS wide FROM en GROUP BY 1),
  ec AS (SELECT doc_id, chunk_id, count(*) AS n, count(*) FILTER (WHERE lower(type) IN ({_STANDARD})) AS s FROM {{mentions}} GROUP BY 1, 2), eb AS (SELECT doc_id, count(*) AS w, sum(n)::BIGINT AS m, sum(n * (n - 1) // 2)::BIGINT AS pairs, sum(s)::BIGINT AS s FROM ec GROUP BY 1), ek AS (SELECT doc_id, count(*) AS chunks FROM {{chunks}} GROUP BY 1),
  entities AS (SELECT doc_id, coalesce(entities, 0) AS entities, round(coalesce(w, 0) / chunks, 6) AS extraction_rate, coalesce(round(1 - often / entities, 6), 0) AS consistency, coalesce(ambiguous, 0) AS ambiguous, coalesce(round(wide / entities, 6), 0) AS across, coalesce(pairs, 0) AS pairs, coalesce(round(s / m, 6), 0) AS aligned FROM ek LEFT JOIN ed USING (doc_id) LEFT JOIN eb USING (doc_id))"""
_CONTINUING = ", ".join(f"'{x}'" for x in documents.CONTINUING)
_CHUNKING = rf"""ct AS (SELECT doc_id, seq, length(text) AS n, regexp_replace(text, '^\s+|\s+$', '', 'g') AS x FROM {{chunks}}), cb AS (SELECT doc_id, n, regexp_matches(x, '[.!?:#]$') AS complete, string_split_regex(lower(x), '\s+')[1] NOT IN ({_CONTINUING}) OR x LIKE '#%' AS contained, x = '' OR regexp_matches(x, '[.!?:]$') AS ends,
    lead(x = '' OR substr(x, 1, 1) <> lower(substr(x, 1, 1)) OR substr(x, 1, 1) = upper(substr(x, 1, 1))) OVER (PARTITION BY doc_id ORDER BY seq) AS fresh FROM ct),
  ca AS (SELECT doc_id, round(var_pop(n) / pow(avg(n), 2), 6) AS variation, avg((n BETWEEN 1050 AND 1950)::INT) AS optimal, avg(complete::INT) AS complete, avg(contained::INT) AS contained, coalesce(avg((ends AND fresh)::INT) FILTER (WHERE fresh IS NOT NULL), 1.0::DOUBLE) AS preserved FROM cb GROUP BY 1),
  chunking AS (SELECT doc_id, variation, round(optimal, 6) AS optimal, round(complete, 6) AS complete, round(contained, 6) AS contained, round(preserved, 6) AS preserved, round(complete * 0.3::DOUBLE + contained * 0.3::DOUBLE + preserved * 0.2::DOUBLE + optimal * 0.2::DOUBLE, 6) AS retrieval FROM ca)"""


@query("AGG-46", f"WITH {_DENSITY} SELECT * FROM density")
def _(t):
    return documents.density(t.chunks)


@query("AGG-47", f"WITH {_ENTITIES} SELECT * FROM entities")
def _(t):
    return documents.entity_density(t.chunks, t.mentions)


@query("AGG-48", f"WITH {_CHUNKING} SELECT * FROM chunking")
def _(t):
    return documents.chunking(t.chunks)


@query("WIN-05", r"WITH n AS (SELECT doc_id, text, lead(text) OVER (PARTITION BY doc_id ORDER BY seq) AS f FROM {chunks}) SELECT doc_id, round(avg((regexp_matches(text, '[.!?]\s*$') AND regexp_matches(f, '^[A-Z]'))::INT), 6) AS preserved FROM n WHERE f IS NOT NULL GROUP BY 1")
def _(t):
    return documents.context_preservation(t.chunks)


_HEADINGS = r"""hl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), hh AS (SELECT doc_id, pos, length(regexp_extract(line, '^(#{1,6}) ', 1)) AS level FROM hl WHERE regexp_matches(line, '^#{1,6} ')),
  hj AS (SELECT doc_id, level - lag(level, 1, 0) OVER w > 1 AS jump, lag(level, 1, 0) OVER w = 0 AND level > 1 AS orphan FROM hh WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  headings AS (SELECT doc_id, count(*) AS headings, count(*) FILTER (WHERE jump) AS jumps, count(*) FILTER (WHERE orphan) AS orphans, round(greatest(1 - 0.1::DOUBLE * count(*) FILTER (WHERE jump) - 0.15::DOUBLE * count(*) FILTER (WHERE orphan), 0), 6)::DOUBLE AS score FROM hj GROUP BY 1)"""
_COMMON = ", ".join(f"'{x}'" for x in documents.COMMON)
_COHERENCE = rf"""sl AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents), sn AS (SELECT *, regexp_matches(line, '^#{{1,6}}\s') AS heading FROM sl), sx AS (SELECT *, sum(heading::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM sn),
  st AS (SELECT doc_id, section, max(CASE WHEN heading THEN regexp_replace(line, '^#+\s+', '') END) AS title, string_agg(CASE WHEN NOT heading THEN line END, ' ') AS body FROM sx GROUP BY 1, 2),
  sg AS (SELECT doc_id, title, body, list_has_any(list_filter(string_split_regex(lower(coalesce(title, 'document')), '\s+'), lambda w: w <> '' AND w NOT IN ({_COMMON})), string_split_regex(lower(body), '\s+')) AS good FROM st),
  coherence AS (SELECT doc_id, CASE WHEN count(title) = 0 OR count(body) = 0 THEN 0.5::DOUBLE ELSE round(count(*) FILTER (WHERE body IS NOT NULL AND good) / count(body), 6) END AS coherence FROM sg GROUP BY 1)"""
# SQL's \b knows ASCII letters only: others are replaced by word characters first.
_RELEVANCY = r"""rt AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[À-ÖØ-öø-ɏ]', '0', 'g'), '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b')) AS term FROM {chunks}), rc AS (SELECT doc_id, term, count(*) AS n FROM rt GROUP BY 1, 2), rq AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower('What is ' || term || '?'), '\s+'), lambda w: w <> '')) AS words FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS r FROM rc) WHERE r <= 5 AND n >= 2 AND length(term) > 3),
  rw AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') AS held FROM {chunks}), rk AS (SELECT doc_id, count(*) AS chunks FROM {chunks} GROUP BY 1), rn AS (SELECT doc_id, count(*) AS queries FROM rq GROUP BY 1),
  rr AS (SELECT q.doc_id, count(*) AS relevant FROM rq q JOIN rw w USING (doc_id) WHERE len(list_intersect(words, held)) > 0 AND len(list_intersect(words, held)) >= 0.3 * len(words) GROUP BY 1),
  rp AS (SELECT doc_id, CASE WHEN queries > 0 THEN least(coalesce(relevant, 0) / queries / 5, 1.0::DOUBLE) ELSE 0.7::DOUBLE END AS p, CASE WHEN queries > 0 THEN coalesce(relevant, 0) / (chunks * queries) ELSE 0.7::DOUBLE END AS r FROM rk LEFT JOIN rn USING (doc_id) LEFT JOIN rr USING (doc_id)),
  relevancy AS (SELECT doc_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM rp)"""


@query("WIN-04", f"WITH {_HEADINGS} SELECT * FROM headings")
def _(t):
    return documents.headings(t.documents)


_OVERALL = f"""WITH {_DENSITY}, {_ENTITIES}, {_CHUNKING}, {_HEADINGS}, {_COHERENCE}, {_RELEVANCY}, sufficiency AS ({_SUFFICIENT('0.8')}),
  allof AS (SELECT s.doc_id, s.topic_coverage, s.completeness, coalesce(d.redundancy, 0) AS redundancy, coalesce(d.facts_a_chunk, 0) AS facts_a_chunk, coalesce(d.signal_to_noise, 0) AS signal_to_noise, coalesce(h.score, 0.3) AS heading_score, coalesce(h.orphans, 0) AS orphans, coalesce(e.ambiguous, 0) AS ambiguous, coalesce(e.extraction_rate, 0) AS extraction_rate,
    coalesce(e.consistency, 0) AS consistency, coalesce(c.complete, 0) AS complete, coalesce(c.retrieval, 0) AS retrieval, coalesce(o.coherence, 0) AS coherence, coalesce(r.precision, 0) AS precision, coalesce(r.recall, 0) AS recall, coalesce(r.f1, 0) AS f1
    FROM sufficiency s LEFT JOIN density d USING (doc_id) LEFT JOIN entities e USING (doc_id) LEFT JOIN chunking c USING (doc_id) LEFT JOIN headings h USING (doc_id) LEFT JOIN coherence o USING (doc_id) LEFT JOIN relevancy r USING (doc_id)),
  scored AS (SELECT *, round(f1 * 0.25::DOUBLE + completeness * 0.2::DOUBLE + signal_to_noise * 0.15::DOUBLE + coherence * 0.15::DOUBLE + consistency * 0.15::DOUBLE + retrieval * 0.1::DOUBLE, 5) AS score FROM allof)
  SELECT doc_id, score, CASE WHEN score >= 0.9 THEN 'excellent' WHEN score >= 0.7 THEN 'good' WHEN score >= 0.5 THEN 'acceptable' WHEN score >= 0.3 THEN 'poor' ELSE 'critical' END AS level,
    array_to_string(list_filter([{", ".join(f"CASE WHEN {condition} THEN '{code}' END" for code, condition in documents.ADVICE)}], lambda x: x IS NOT NULL)[1:5], ',') AS advice FROM scored"""


@query("AGG-49", _OVERALL)
def _(t):
    return documents.overall(t.documents, t.chunks, t.mentions)


@query("AGG-44", f"WITH {_RELEVANCY} SELECT * FROM relevancy")
def _(t):
    return documents.relevancy(t.chunks, documents.repeated_terms(t.chunks))


@query("SCL-08", r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?m)^\s*[-*_]{3,}\s*$', '', 'g'), '\*\*([^*\n]+)\*\*', '\1', 'g') AS x FROM documents)
  SELECT doc_id, trim(regexp_replace(array_to_string(list_filter(string_split(x, chr(10)), lambda w: length(trim(w)) = 0 OR length(trim(w)) >= 3), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')) AS text FROM c""")
def _(t):
    return t.documents.select("doc_id", text.clean_markdown(F.col("text")).alias("text"))


@query("SCL-09")
def _(t):
    return documents.chunk_table(t.documents, text.chunks(F.coalesce("text", F.lit(""))))


