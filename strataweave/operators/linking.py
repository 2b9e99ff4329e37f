"""Links between concepts and data assets, evidence for questions, topics of subjects, concept upkeep."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_case
from ..session import materialize
from . import rules
from .feedback import clamped_sums
from .resolve import ratio

# Words that name a concept.
CONCEPT_WORDS = {
    "patient": ("Patient", 0.95), "customer": ("Customer", 0.95), "user": ("User", 0.90), "order": ("SalesOrder", 0.90), "product": ("Product", 0.90), "invoice": ("Invoice", 0.85), "diagnosis": ("MedicalDiagnosis", 0.90),
    "treatment": ("Treatment", 0.85), "medication": ("Medication", 0.90), "therapy": ("Therapy", 0.85), "appointment": ("Appointment", 0.80), "lab": ("LaboratoryResult", 0.85), "assessment": ("Assessment", 0.80),
    "provider": ("HealthcareProvider", 0.85),
}


def bridges(nodes: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    """rel_type, dst, n: edges from nodes of one label to nodes of another, by target."""
    label = lambda x: nodes.filter(F.array_contains("labels", x)).select("id")
    rows = edges.join(label(source).toDF("src"), "src", "left_semi").join(label(target).toDF("dst"), "dst", "left_semi")
    return rows.groupBy("rel_type", "dst").agg(F.count("*").alias("n"))


def containment(concepts: DataFrame, assets: DataFrame, kinds: Mapping[str, str], otherwise: str = "DESCRIBED_IN", exact: float = 0.95, partial: float = 0.85) -> DataFrame:
    """concept_id, asset_id, score, rel_type: the words of one name among the other's (either way), or the concept's among the asset's description; best a pair.

    Words are an inverted index: pairs are counted over shared words, never over all concepts and assets. The relationship follows the asset's kind.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+"), lambda w: w != ""))
    left = concepts.select(F.col("id").alias("concept_id"), words(F.col("name")).alias("x")).select("concept_id", F.size("x").alias("n"), F.explode("x").alias("w"))
    rel = F.coalesce(*(F.when(F.col("kind") == k, r) for k, r in kinds.items()), F.lit(otherwise))
    right = assets.select(F.col("id").alias("asset_id"), rel.alias("rel_type"), words(F.col("name")).alias("y"), words(F.col("description")).alias("d"))
    right = right.select("asset_id", "rel_type", F.size("y").alias("m"), "y", "d", F.explode(F.array_union("y", "d")).alias("w"))
    right = right.select("asset_id", "rel_type", "m", "w", F.array_contains("y", F.col("w")).alias("named"), F.array_contains("d", F.col("w")).alias("described"))
    shared = left.join(right, "w").groupBy("concept_id", "asset_id", "rel_type", "n", "m").agg(F.count_if("named").alias("k"), F.count_if("described").alias("j"))
    score = F.when((F.col("k") == F.col("n")) | (F.col("k") == F.col("m")), exact).when(F.col("j") == F.col("n"), partial)
    return shared.select("concept_id", "asset_id", score.alias("score"), "rel_type").filter("score is not null")


def confident_links(nodes: DataFrame, edges: DataFrame, rel_type: str, least: float) -> DataFrame:
    """src, dst, confidence of one relationship between known nodes, from ``least`` on; best first."""
    known = nodes.select("id")
    rows = edges.filter((F.col("rel_type") == rel_type) & (F.col("confidence") >= least)).join(known.toDF("src"), "src", "left_semi").join(known.toDF("dst"), "dst", "left_semi")
    return rows.select("src", "dst", "confidence").orderBy(F.desc("confidence"), "src", "dst")


def concept_view(edges: DataFrame, first: str, second: str) -> DataFrame:
    """id, linked: what two steps (rel_type first, then second) reach from each node, with the count of different ends."""
    a, b = (edges.filter(F.col("rel_type") == r).select("src", "dst") for r in (first, second))
    rows = a.toDF("id", "middle").join(b.toDF("middle", "end"), "middle")
    return rows.groupBy("id").agg(F.count_distinct("end").alias("linked"))


def link_mentions(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """name, id, how: the best node for a name: the same name, then the same words without the last, then the same first word over three letters."""
    base = names.select("name", F.lower("name").alias("key")).distinct()
    known = nodes.select("id", F.lower("name").alias("key"))
    first = F.substring_index("key", " ", 1)
    exact = base.join(known, "key").select("name", "id", F.lit(1).alias("rank"))
    head = base.withColumn("head", F.substring_index("key", " ", 1)).filter("length(head) > 3").drop("key").join(known.withColumn("head", first).groupBy("head").agg(F.min("id").alias("id")), "head").select("name", "id", F.lit(2))
    best = exact.union(head).groupBy("name").agg(F.min(F.struct("rank", "id")).alias("b"))
    return best.select("name", "b.id", F.when(F.col("b.rank") == 1, "exact").otherwise("first_word").alias("how"))


def high_low_pairs(feedback: DataFrame, limit: int = 500) -> DataFrame:
    """chosen_id, rejected_id: each of the latest high-rated rows with the latest low-rated one (the measure pairs different prompts)."""
    low = feedback.filter("rating <= 2").agg(F.max_by("feedback_id", F.struct("created_at", "feedback_id")).alias("rejected_id"))
    high = feedback.filter("rating >= 4").orderBy(F.desc("created_at"), F.desc("feedback_id")).limit(limit)
    return high.select(F.col("feedback_id").alias("chosen_id")).join(F.broadcast(low), F.lit(True))  # one row


def find_concepts(concepts: DataFrame, text: str) -> DataFrame:
    """id, how: by name, by alias, or by part of either, for concepts (id, name, aliases)."""
    t = text.lower()
    how = F.when(F.lower("name") == t, "name").when(F.exists("aliases", lambda a: F.lower(a) == t), "alias").when(F.lower("name").contains(t) | F.exists("aliases", lambda a: F.lower(a).contains(t)), "part")
    return concepts.select("id", how.alias("how")).filter("how is not null")


def contradictions(inferences: DataFrame, validations: DataFrame, key: str, gap: float = 0.3) -> DataFrame:
    """key, inference, entity, and their confidences where those of one key (a query) differ by more than the gap; a null confidence is 0.5.

    Names of a key count once, by their best confidence, so that a busy key brings as many pairs as it has names, not rows.
    """
    one = lambda df, name, value: df.groupBy(key, F.col("name").alias(name)).agg(F.max(F.coalesce("confidence", F.lit(0.5))).alias(value))
    joined = one(inferences, "inference", "inferred").join(one(validations, "entity", "validated"), key)
    return joined.filter(F.abs(F.col("inferred") - F.col("validated")) > gap).select(key, "inference", "entity", "inferred", "validated")


def open_topics(topics: DataFrame, resolved: DataFrame, top: int = 3) -> DataFrame:
    """subject_id, topic: a subject's topics that no resolved condition of it names, the first by name."""
    gone = topics.join(resolved, "subject_id").filter("contains(topic, condition) or contains(condition, topic)").select("subject_id", "topic").distinct()
    rank = F.row_number().over(Window.partitionBy("subject_id").orderBy("topic"))
    return topics.distinct().join(gone, ["subject_id", "topic"], "left_anti").withColumn("rank", rank).filter(F.col("rank") <= top).select("subject_id", "topic")


def evidence(questions: DataFrame, nodes: DataFrame, edges: DataFrame, top: int = 3) -> DataFrame:
    """question, id, degree: the best connected nodes whose name is a term of the question.

    The best of a question are among the ``top`` of each of its terms, so that a name that very many nodes have meets the questions with ``top`` of them.
    """
    terms = questions.select("question", F.explode(F.array_distinct("terms")).alias("term"))
    degree = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    named = nodes.select("id", F.lower("name").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    named = named.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    first = lambda rows, key: rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("degree"), "id"))).filter(F.col("rank") <= top).drop("rank")
    return first(terms.join(first(named, "term"), "term"), "question").select("question", "id", "degree")


def answer_confidence(counts: DataFrame, boosts: Mapping[str, tuple[int, float]]) -> DataFrame:
    """question, confidence: capped counts of each kind of evidence times their boost, at most 1."""
    total = sum((F.least(F.coalesce(c, F.lit(0)), F.lit(cap)) * boost for c, (cap, boost) in boosts.items()), F.lit(0.0))
    return counts.select("question", F.round(F.least(total, F.lit(1.0)), 6).alias("confidence"))


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with their place in the order, from 0: sorted by ranges over all tasks, with each task's start from the counts before it."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    stored = materialize(ranged, "numbered")  # so that tasks and places stay as they are
    task = F.shiftrightunsigned(name, 33)
    counts = stored.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    starts = counts.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = stored.join(F.broadcast(starts), task == F.col("_task"))
    return joined.withColumn(name, F.col("_start") + F.col(name).bitwiseAND(F.lit((1 << 33) - 1))).drop("_task", "_start")


def adaptive_weights(feedback: DataFrame, frame: int = 100, least: int = 10, step: float = 0.01, start: float = 0.5, stretch: int = 100_000) -> DataFrame:
    """feedback_type, weight: a step up or down a row by the success of the type among the last ``frame`` rows of all types, kept in 0 .. 1.

    Rows are numbered over all types. A type's rows are cut into stretches of numbers, each with the rows of the frame before it, so that
    one type with most rows is spread; its steps are folded by runs.
    """
    rows = numbered(feedback.select("feedback_type", "rating", "created_at", "feedback_id"), ("created_at", "feedback_id"), "place")
    own = F.floor(F.col("place") / stretch)
    near = rows.withColumn("part", F.explode(F.array_distinct(F.array(own, F.floor((F.col("place") + frame - 1) / stretch)))))
    last = Window.partitionBy("feedback_type", "part").orderBy("place").rangeBetween(-(frame - 1), 0)
    good = F.sum(F.when(F.col("rating") >= 4, 1).otherwise(-1)).over(last)
    moved = F.when(F.count("*").over(last) >= least, F.signum(good.cast("double"))).otherwise(0.0) * step
    steps = near.withColumn("step", moved).filter(F.col("part") == own)
    return clamped_sums(steps, "feedback_type", ["place"], "step", start, 0.0, 1.0).select("feedback_type", F.round("value", 4).alias("weight"))


def hybrid_search(
    matches: DataFrame, nodes: DataFrame, edges: DataFrame, vector_weight: float = 0.7, graph_weight: float = 0.3, least: float = 0.3, top: int = 10, type_scores: Mapping[str, float] = rules.TYPE_SCORES,
) -> DataFrame:
    """id, vector_score, graph_score, score, explanation of matches (id, match) that reach ``least``, best first.

    The graph score is 0.4 of neighbours up to 10, 0.3 of properties that are set up to 5 (columns beside id, type and labels) and 0.3 of the type's score.
    """
    both = edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst")
    near = both.groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("near"))
    own = [c for c in nodes.columns if c not in ("id", "type", "labels")]
    there = sum((F.col(c).isNotNull().cast("int") for c in own), F.lit(0))
    kind = F.coalesce(*(F.when(F.col("type") == k, v) for k, v in type_scores.items()), F.lit(0.5))
    props = nodes.select("id", F.least(there / 5, F.lit(1.0)).alias("rich"), kind.alias("kind"))
    rows = matches.select("id", F.col("match").alias("vector_score")).join(props, "id").join(near, "id", "left").withColumn("near", F.coalesce("near", F.lit(0)))
    rows = rows.withColumn("graph_score", F.round(0.4 * F.least(F.col("near") / 10, F.lit(1.0)) + 0.3 * F.col("rich") + 0.3 * F.col("kind"), 9))
    rows = rows.withColumn("score", F.col("vector_score") * vector_weight + F.col("graph_score") * graph_weight).filter(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(top)
    vector, graph = F.format_string("%.2f", "vector_score"), F.format_string("%.2f", "graph_score")
    alike = F.when(F.col("vector_score") > 0.8, F.concat(F.lit("High semantic similarity ("), vector, F.lit(")"))).when(F.col("vector_score") > 0.6, F.concat(F.lit("Moderate semantic similarity ("), vector, F.lit(")")))
    linked = F.when(F.col("graph_score") > 0.7, F.concat(F.lit("Well-connected in graph ("), F.col("near").cast("string"), F.lit(" neighbors)")))
    weak = F.concat(F.lit("Low confidence match (vector="), vector, F.lit(", graph="), graph, F.lit(")"))
    said = F.concat_ws("; ", alike, linked)
    return rows.select("id", "vector_score", "graph_score", "score", F.when(said == "", weak).otherwise(said).alias("explanation"))


def merge_lists(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Key and the united, sorted list of both sides."""
    joined = old.select(key, F.col(column).alias("_a")).join(new.select(key, F.col(column).alias("_b")), key, "full_outer")
    none = F.array().cast("array<string>")
    return joined.select(key, F.array_sort(F.array_union(F.coalesce("_a", none), F.coalesce("_b", none))).alias(column))


def ranked_sources(parts: Sequence[DataFrame]) -> DataFrame:
    """question, source, rank: typed source lists in their order, the first appearance of a name kept."""
    union = None
    for i, part in enumerate(parts):
        one = part.select("question", "source", F.lit(i).alias("rank"))
        union = one if union is None else union.union(one)
    return union.groupBy("question", "source").agg(F.min("rank").alias("rank"))


def ancestry(tree: DataFrame) -> DataFrame:
    """node, ancestor, distance of every node to all above it in (child, parent), whatever the depth: paths double in a round, by one join on the ends known so far.

    Nodes on a cycle, which have no top, are left out beyond their first step around it. Each round is written.
    """
    known = materialize(tree.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).filter("node <> ancestor").distinct(), "ancestry")
    reach = 1
    while True:
        last = known.filter(F.col("distance") == reach)
        further = last.select("node", F.col("ancestor").alias("middle")).join(known.select(F.col("node").alias("middle"), "ancestor", F.col("distance").alias("more")), "middle")
        further = further.select("node", "ancestor", (F.col("more") + reach).alias("distance")).filter("node <> ancestor")
        grown = materialize(known.union(further).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")), "ancestry")
        if grown.count() == known.count():
            return grown
        known, reach = grown, 2 * reach


def layered_retrieval(questions: DataFrame, nodes: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """question, layer, entities, confidence: per layer the nodes whose name is a term; min(0.5 + 0.1 n, 1) by the layer's weight.

    Nodes are counted before they meet the questions, an id once with all terms that it has, so that a name that very many nodes have is one row a layer.
    """
    terms = questions.select("question", F.explode(F.array_distinct("terms")).alias("term"))
    named = nodes.filter("layer is not null").select("id", "layer", F.lower("name").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    alike = named.groupBy("id", "layer").agg(F.array_sort(F.collect_set("term")).alias("names")).groupBy("layer", "names").agg(F.count("id").alias("n"))
    met = terms.join(alike.withColumn("term", F.explode("names")), "term").select("question", "layer", "names", "n").distinct()
    hits = met.groupBy("question", "layer").agg(F.sum("n").alias("entities"))
    weight = F.coalesce(*(F.when(F.col("layer") == k, F.lit(v)) for k, v in weights.items()))
    return hits.withColumn("confidence", F.round(F.least(0.5 + 0.1 * F.col("entities"), F.lit(1.0)) * weight, 6))


def inferred_concept(name: Column, words: Mapping[str, tuple[str, float]] = CONCEPT_WORDS, otherwise: float = 0.6) -> Column:
    """(concept, confidence) of a name's first run of letters, digits and _: of the first word of the table that it holds, else the run in PascalCase; null where there is none."""
    t = F.lower(F.regexp_extract(name, r"(?U)(\w+)", 1))
    pair = lambda c, x: F.struct(c.alias("concept"), F.lit(x).cast("double").alias("confidence"))
    pascal = F.array_join(F.transform(F.split(t, "_"), title_case), "")
    return F.when(t != "", F.coalesce(*(F.when(F.contains(t, F.lit(w)), pair(F.lit(c), x)) for w, (c, x) in words.items()), pair(pascal, otherwise)))


def validate_names(names: DataFrame, dictionary: DataFrame, weak: float = 0.4, suggested: float = 0.5, valid: float = 0.7, top: int = 3) -> DataFrame:
    """name, is_valid, validated, confidence, suggestions of names against a dictionary (known, generic) of bounded size.

    An exact name is valid as it is. Else the ``top`` most similar ones above ``weak`` count: valid if the best reaches ``valid``; their generics
    from ``suggested`` on are suggestions, best first. Blank names are invalid. Distinct names alone meet the dictionary.
    """
    plain = names.select("name").distinct().withColumn("key", F.lower(F.trim(F.coalesce("name", F.lit("")))))
    known = F.broadcast(dictionary.groupBy(F.lower("known").alias("known")).agg(F.min("generic").alias("generic")))  # a dictionary, not data
    scored = plain.filter("key <> ''").select("key").distinct().join(known, F.lit(True)).withColumn("score", F.when(F.col("key") == F.col("known"), 1.0).otherwise(F.round(ratio(F.col("key"), F.col("known")), 6))).filter(F.col("score") > weak)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "known"))
    best = scored.withColumn("rank", rank).filter(F.col("rank") <= top).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "generic"))).alias("m"))
    first = F.get("m", F.lit(0))
    others = F.array_distinct(F.transform(F.filter("m", lambda x: x["score"] >= suggested), lambda x: F.initcap(x["generic"])))
    joined = plain.join(best, "key", "left")
    ok = F.coalesce(first["score"] >= valid, F.lit(False))
    none = F.array().cast("array<string>")
    return joined.select("name", ok.alias("is_valid"), F.when(ok, F.initcap(first["generic"])).alias("validated"), F.coalesce(first["score"], F.lit(0.0)).alias("confidence"),
                         F.when(first["score"] == 1.0, none).otherwise(F.coalesce(others, none)).alias("suggestions"))


def suggest_types(types: DataFrame, canonical: Sequence[str], least: float = 0.4, top: int = 5) -> DataFrame:
    """type, canonical, score: the ``top`` canonical types most similar to each distinct type's normalized form, above ``least``; ties by name."""
    table = F.broadcast(types.sparkSession.createDataFrame([(c,) for c in canonical], "canonical string"))  # a registry, not data
    kinds = types.filter("type is not null").select("type").distinct()
    plain = F.translate(F.trim(F.lower("type")), "- ", "__")
    scored = kinds.join(table, F.lit(True)).withColumn("score", F.round(ratio(plain, F.col("canonical")), 6)).filter(F.col("score") > least)
    rank = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("score"), "canonical"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top).select("type", "canonical", "score")
