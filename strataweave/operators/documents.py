"""Document quality over chunks (doc_id, chunk_id, seq, text) and mentions: one aggregate a document, no loop on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FACT_PATTERNS, INDICATORS
from .graph import banded

# Fixed values of the quality model.
LEVELS = ((0.9, "excellent"), (0.7, "good"), (0.5, "acceptable"), (0.3, "poor"))
WEIGHTS = {"contextual_relevancy": 0.25, "context_sufficiency": 0.20, "information_density": 0.15, "structural_clarity": 0.15, "entity_density": 0.15, "chunking_quality": 0.10}
STANDARD_TYPES = ("person", "organization", "location", "date", "medication", "disease", "treatment", "symptom", "procedure", "study", "table", "column", "concept", "process", "system")
CONTINUING = ("it", "this", "that", "these", "those", "and", "but", "or", "however")
COMMON = ("the", "a", "an", "and", "or", "is", "are", "of", "to", "in", "for")


def _share(a: Column, b: Column) -> Column:
    return F.round(a / b, 6)


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _words(x: Column) -> Column:
    return F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != "")


def sufficiency(documents: DataFrame, topics: Sequence[str] = ()) -> DataFrame:
    """doc_id, indicators, claim_coverage, topic_coverage (0.8 without expected topics), completeness. A null text is empty."""
    t = F.lower(F.coalesce("text", F.lit("")))
    held = lambda values: F.size(F.filter(F.array(*map(F.lit, values)), lambda w: F.contains(t, F.lower(w))))
    indicators = held(INDICATORS)
    topic = held(topics) / len(topics) if topics else F.lit(0.8)
    claim = indicators / len(INDICATORS)
    return documents.select("doc_id", indicators.alias("indicators"), F.round(claim, 6).alias("claim_coverage"), F.round(topic, 6).alias("topic_coverage"), F.round((topic + claim) / 2, 6).alias("completeness"))


def facts(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_id, key: the sentences of at least ten characters that look like facts, by their first 50 characters."""
    sentence = chunks.select("doc_id", "chunk_id", F.explode(F.split("text", "[.!?]")).alias("s")).withColumn("s", _stripped(F.col("s")))
    fact = sentence.filter((F.length("s") >= 10) & F.col("s").rlike("|".join(f"(?:{p})" for p in FACT_PATTERNS)))
    return fact.select("doc_id", "chunk_id", F.regexp_replace(F.lower(F.substring("s", 1, 50)), r"\s+", " ").alias("key"))


def density(chunks: DataFrame, least_facts: int = 3) -> DataFrame:
    """doc_id, facts, distinct_facts, facts_a_chunk, redundancy, signal_to_noise, low_density (chunks under ``least_facts``), redundant (chunks with most facts repeated).

    Over all chunks of a document. Documents without facts have zeros.
    """
    one = facts(chunks).groupBy("doc_id", "key", "chunk_id").agg(F.count("*").alias("n"))
    total = one.groupBy("doc_id", "key").agg(F.sum("n").alias("all"))
    by_chunk = one.join(total, ["doc_id", "key"]).groupBy("doc_id", "chunk_id").agg(F.sum("n").alias("facts"), F.sum(F.when(F.col("all") > 1, F.col("n")).otherwise(0)).alias("repeated"))
    joined = chunks.select("doc_id", "chunk_id").join(by_chunk, ["doc_id", "chunk_id"], "left").fillna(0, ["facts", "repeated"])
    rows = joined.groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.sum("facts").alias("facts"), F.count_if(F.col("facts") < least_facts).alias("low_density"), F.count_if(F.col("repeated") > 0.5 * F.col("facts")).alias("redundant"))
    rows = rows.join(total.groupBy("doc_id").agg(F.count("*").alias("distinct_facts")), "doc_id", "left").fillna(0, ["distinct_facts"])
    redundancy = F.when(F.col("facts") > 0, (F.col("facts") - F.col("distinct_facts")) / F.col("facts")).otherwise(0.0)
    return rows.select(
        "doc_id", "facts", "distinct_facts", _share(F.col("distinct_facts"), F.col("chunks")).alias("facts_a_chunk"), F.round(redundancy, 6).alias("redundancy"),
        F.round(1 - F.least(redundancy, F.lit(0.8)), 6).alias("signal_to_noise"), "low_density", "redundant")


def entity_density(chunks: DataFrame, mentions: DataFrame, types: Sequence[str] = STANDARD_TYPES) -> DataFrame:
    """doc_id, entities, extraction_rate, consistency, ambiguous, across, pairs, aligned of mentions (doc_id, chunk_id, entity, type).

    ambiguous: names under several types; across: share of names in several chunks; pairs: of mentions in one chunk;
    consistency: share of names mentioned at most three times. Documents without mentions have zeros.
    """
    names = mentions.groupBy("doc_id", F.lower("entity").alias("entity")).agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("chunks"), F.count_distinct("type").alias("types"))
    by_name = names.groupBy("doc_id").agg(F.count("*").alias("entities"), F.count_if(F.col("n") > 3).alias("often"), F.count_if(F.col("types") > 1).alias("ambiguous"), F.count_if(F.col("chunks") > 1).alias("wide"))
    in_chunk = mentions.groupBy("doc_id", "chunk_id").agg(F.count("*").alias("n"), F.count_if(F.lower("type").isin(*types)).alias("standard"))
    by_chunk = in_chunk.groupBy("doc_id").agg(F.count("*").alias("with"), F.sum("n").alias("mentions"), F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"), F.sum("standard").alias("standard"))
    rows = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks")).join(by_name, "doc_id", "left").join(by_chunk, "doc_id", "left").fillna(0)
    of = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    c = F.col
    return rows.select(
        "doc_id", "entities", of(c("with"), c("chunks")).alias("extraction_rate"), F.when(c("entities") > 0, F.round(1 - c("often") / c("entities"), 6)).otherwise(0.0).alias("consistency"), "ambiguous",
        of(c("wide"), c("entities")).alias("across"), "pairs", of(c("standard"), c("mentions")).alias("aligned"))


def chunking(chunks: DataFrame, target: int = 1500, tolerance: float = 0.3) -> DataFrame:
    """doc_id, variation (population variance over squared mean), optimal, complete, contained, preserved shares, retrieval.

    complete: chunks that end a sentence; contained: whose first word continues nothing; preserved: borders with a finished
    sentence before and no small letter after (1 for one chunk).
    """
    text = _stripped(F.col("text"))
    first = F.lower(F.split(text, r"\s+")[0])
    order = Window.partitionBy("doc_id").orderBy("seq")
    start = F.substring(text, 1, 1)
    rows = chunks.select(
        "doc_id", F.length("text").alias("n"), text.rlike("[.!?:#]$").alias("complete"), (~first.isin(*CONTINUING) | text.startswith("#")).alias("contained"),
        ((text == "") | text.rlike("[.!?:]$")).alias("ends"), F.lead((text == "") | (start != F.lower(start)) | (start == F.upper(start))).over(order).alias("fresh"))
    mean = lambda x: F.avg(x.cast("int"))
    found = rows.groupBy("doc_id").agg(
        F.round(F.var_pop("n") / F.pow(F.avg("n"), F.lit(2)), 6).alias("variation"), mean(F.col("n").between(int(target * (1 - tolerance)), int(target * (1 + tolerance)))).alias("optimal"),
        mean(F.col("complete")).alias("complete"), mean(F.col("contained")).alias("contained"), F.coalesce(mean(F.when(F.col("fresh").isNotNull(), F.col("ends") & F.col("fresh"))), F.lit(1.0)).alias("preserved"))
    retrieval = F.col("complete") * 0.3 + F.col("contained") * 0.3 + F.col("preserved") * 0.2 + F.col("optimal") * 0.2
    return found.select("doc_id", "variation", *(F.round(c, 6).alias(c) for c in ("optimal", "complete", "contained", "preserved")), F.round(retrieval, 6).alias("retrieval"))


def context_preservation(chunks: DataFrame) -> DataFrame:
    """doc_id, preserved: share of chunk borders where one chunk ends a sentence and the next starts with a capital."""
    following = F.lead("text").over(Window.partitionBy("doc_id").orderBy("seq"))
    rows = chunks.withColumn("following", following).filter("following is not null")
    return rows.groupBy("doc_id").agg(F.round(F.avg((F.col("text").rlike(r"[.!?]\s*$") & F.col("following").rlike("^[A-Z]")).cast("int")), 6).alias("preserved"))


def headings(documents: DataFrame) -> DataFrame:
    """doc_id, headings, jumps (a level skipped), orphans (a first heading below level 1), score 1 - 0.1 a jump - 0.15 an orphan, not below 0."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).filter(F.col("line").rlike("^#{1,6} "))
    level = F.length(F.regexp_extract("line", "^(#{1,6}) ", 1))
    before = F.lag(level, 1, 0).over(Window.partitionBy("doc_id").orderBy("at"))
    rows = lines.select("doc_id", ((level - before) > 1).alias("jump"), ((before == 0) & (level > 1)).alias("orphan"))
    found = rows.groupBy("doc_id").agg(F.count("*").alias("headings"), F.count_if("jump").alias("jumps"), F.count_if("orphan").alias("orphans"))
    return found.withColumn("score", F.round(F.greatest(1 - 0.1 * F.col("jumps") - 0.15 * F.col("orphans"), F.lit(0.0)), 6))


def section_coherence(documents: DataFrame) -> DataFrame:
    """doc_id, coherence: share of a document's sections whose text holds a word of their heading (0.5 without headings)."""
    lines = documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    heading = F.col("line").rlike(r"^#{1,6}\s")
    lines = lines.select("doc_id", "line", heading.alias("heading"), F.sum(heading.cast("int")).over(Window.partitionBy("doc_id").orderBy("at")).alias("section"))
    title = F.max(F.when(F.col("heading"), F.regexp_replace("line", r"^#+\s+", "")))
    sections = lines.groupBy("doc_id", "section").agg(title.alias("title"), F.count_if(~F.col("heading")).alias("lines"))
    wanted = sections.filter("lines > 0").select("doc_id", "section", F.explode_outer(F.array_distinct(_words(F.coalesce("title", F.lit("document"))))).alias("word"))
    wanted = wanted.filter(~F.col("word").isin(*COMMON))
    held = lines.filter("not heading").select("doc_id", "section", F.explode(F.array_distinct(_words(F.col("line")))).alias("word")).distinct()
    good = held.join(wanted, ["doc_id", "section", "word"], "left_semi").groupBy("doc_id").agg(F.count_distinct("section").alias("good"))
    counts = sections.groupBy("doc_id").agg(F.count_if(F.col("lines") > 0).alias("sections"), F.count("title").alias("titles"))
    coherence = F.when((F.col("titles") == 0) | (F.col("sections") == 0), 0.5).otherwise(F.round(F.coalesce("good", F.lit(0)) / F.col("sections"), 6))
    return counts.join(good, "doc_id", "left").select("doc_id", coherence.alias("coherence"))


def repeated_terms(chunks: DataFrame, least: int = 2, top: int = 5) -> DataFrame:
    """doc_id, query: questions about each document's most repeated capitalized terms, from all its chunks; ties by term."""
    terms = chunks.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"), 0)).alias("term"))
    counts = terms.groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "term"))
    return counts.withColumn("rank", rank).filter((F.col("rank") <= top) & (F.col("n") >= least) & (F.length("term") > 3)).select("doc_id", F.concat(F.lit("What is "), "term", F.lit("?")).alias("query"))


def relevancy(chunks: DataFrame, queries: DataFrame, share: float = 0.3, retrieved: int = 5) -> DataFrame:
    """doc_id, precision, recall, f1 of every document: how many of its chunks hold at least ``share`` of the words of its queries (doc_id, query).

    precision: relevant chunks a query over ``retrieved``, at most 1; recall: over all chunks. Both are 0.7 without queries.
    """
    terms = queries.distinct().select("doc_id", "query", F.explode(F.array_distinct(_words(F.col("query")))).alias("term"))
    sizes = terms.groupBy("doc_id", "query").agg(F.count("*").alias("size"))
    words = chunks.select("doc_id", "chunk_id", F.explode(F.array_distinct(_words(F.col("text")))).alias("term"))
    hits = words.join(terms, ["doc_id", "term"]).groupBy("doc_id", "query", "chunk_id").agg(F.count("*").alias("k")).join(sizes, ["doc_id", "query"])
    good = hits.filter(F.col("k") >= share * F.col("size")).groupBy("doc_id").agg(F.count("*").alias("relevant"))
    rows = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks")).join(sizes.groupBy("doc_id").agg(F.count("*").alias("queries")), "doc_id", "left").join(good, "doc_id", "left").fillna(0)
    asked = F.col("queries") > 0
    precision = F.when(asked, F.least(F.col("relevant") / F.col("queries") / retrieved, F.lit(1.0))).otherwise(0.7)
    recall = F.when(asked, F.col("relevant") / (F.col("chunks") * F.col("queries"))).otherwise(0.7)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return rows.select("doc_id", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


#: Advice, most urgent first: code, and the condition on the measures that calls for it.
ADVICE = (
    ("missing_topics", "topic_coverage < 0.8"), ("repeated_facts", "redundancy > 0.3"), ("heading_levels", "heading_score < 0.7"), ("ambiguous_entities", "ambiguous > 0"),
    ("chunk_precision", "f1 < 0.7 and precision < 0.7"), ("chunk_recall", "f1 < 0.7 and recall < 0.7"), ("few_facts", "facts_a_chunk < 3"), ("orphan_sections", "orphans > 0"),
    ("few_entities", "extraction_rate < 0.5"), ("cut_sentences", "complete < 0.7"),
)


def overall(documents: DataFrame, chunks: DataFrame, mentions: DataFrame, weights: Mapping[str, float] = WEIGHTS, most: int = 5) -> DataFrame:
    """doc_id, score, level, advice (the first ``most`` codes, comma-separated) of every document; what it has no text for counts 0."""
    parts = [relevancy(chunks, repeated_terms(chunks)), density(chunks), entity_density(chunks, mentions), chunking(chunks)]
    joined = sufficiency(documents).join(section_coherence(documents), "doc_id", "left").join(headings(documents).select("doc_id", "orphans", F.col("score").alias("heading_score")), "doc_id", "left")
    for part in parts:
        joined = joined.join(part, "doc_id", "left")
    joined = joined.fillna(0.3, ["heading_score"]).fillna(0)
    values = {"contextual_relevancy": "f1", "context_sufficiency": "completeness", "information_density": "signal_to_noise", "structural_clarity": "coherence", "entity_density": "consistency", "chunking_quality": "retrieval"}
    score = F.round(sum(F.col(values[k]) * w for k, w in weights.items()), 5)
    advice = F.slice(F.array_compact(F.array(*(F.when(F.expr(condition), F.lit(code)) for code, condition in ADVICE))), 1, most)
    return joined.select("doc_id", score.alias("score"), banded(score, LEVELS, "critical").alias("level"), F.array_join(advice, ",").alias("advice"))


def chunk_table(documents: DataFrame, text: Column) -> DataFrame:
    """doc_id, seq, text of an array of chunks a document."""
    return documents.select("doc_id", F.posexplode(text).alias("seq", "text"))


def graph(documents: DataFrame, chunks: DataFrame, mentions: DataFrame, known: DataFrame, longest: int = 500) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, name) and edges (src, rel_type, dst, confidence) of documents, their chunks and the entities that chunks mention.

    A chunk's name is the start of its text, cut for storage. HAS_CHUNK, MENTIONS, and LINKS_TO where an entity has the name of a known node (id, name):
    the first by id.
    """
    doc, entity = F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), F.concat(F.lit("extracted:"), F.replace(F.lower("entity"), F.lit(" "), F.lit("_")))
    sizes = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    nodes = documents.join(sizes, "doc_id", "left").select(doc.alias("id"), F.lit("Document").alias("kind"), F.concat_ws(" ", F.coalesce("n", F.lit(0)), F.lit("chunks")).alias("name"))
    nodes = nodes.union(chunks.select("chunk_id", F.lit("Chunk"), F.substring("text", 1, longest))).union(mentions.groupBy(entity).agg(F.lit("ExtractedEntity"), F.min("entity")))
    said = mentions.groupBy("chunk_id", entity.alias("dst")).agg(F.max("confidence").alias("confidence"))
    names = known.groupBy(F.lower("name").alias("entity")).agg(F.min("id").alias("dst"))
    linked = mentions.withColumn("entity", F.lower("entity")).join(names, "entity").groupBy(entity.alias("src"), "dst").agg(F.max("confidence").alias("confidence"))
    edges = chunks.select(doc.alias("src"), F.lit("HAS_CHUNK").alias("rel_type"), F.col("chunk_id").alias("dst"), F.lit(1.0).alias("confidence"))
    return nodes, edges.union(said.select("chunk_id", F.lit("MENTIONS"), "dst", "confidence")).union(linked.select("src", F.lit("LINKS_TO"), "dst", "confidence"))


def chunk_places(documents: DataFrame, chunks: DataFrame, head: int = 50, overlap: int = 0) -> DataFrame:
    """chunk_id, start, stop: where each chunk (doc_id, chunk_id, seq, text) stands in its document's text, from 0.

    The search for a chunk's first ``head`` characters runs on from the end of the chunk before it, less the overlap, a document's chunks in order; what is
    not found stands where the search has come to.
    """
    parts = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk_id", F.substring("text", 1, head).alias("head"), F.length("text").alias("n")))).alias("c"))
    none = F.array().cast("array<struct<chunk_id:string,start:bigint,stop:bigint>>")

    def add(state, c):
        at = F.call_function("locate", c["head"], F.col("text"), (state["at"] + 1).cast("int"))
        start = F.when(at > 0, at - 1).otherwise(state["at"]).cast("long")
        row = F.struct(c["chunk_id"].alias("chunk_id"), start.alias("start"), (start + c["n"]).alias("stop"))
        return F.struct(F.array_append(state["done"], row).alias("done"), (start + c["n"] - overlap).alias("at"))

    joined = documents.join(parts, "doc_id")
    places = F.aggregate("c", F.struct(none.alias("done"), F.lit(0).cast("long").alias("at")), add, lambda s: s["done"])
    return joined.select(F.explode(places).alias("p")).select("p.*")
