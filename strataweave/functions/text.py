"""Names, texts and chunks as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Expansions of words in names, and words that stand for another.
ABBREVIATIONS = {
    "id": "identifier", "pk": "primary_key", "fk": "foreign_key", "uq": "unique", "idx": "index", "seq": "sequence", "tbl": "table", "col": "column", "attr": "attribute", "rel": "relationship", "ref": "reference",
    "int": "integer", "bool": "boolean", "char": "character", "varchar": "variable_character", "txt": "text", "num": "numeric", "dec": "decimal", "dt": "date", "ts": "timestamp",
    "cust": "customer", "acct": "account", "addr": "address", "dept": "department", "emp": "employee", "mgr": "manager", "org": "organization", "prod": "product", "svc": "service", "qty": "quantity", "amt": "amount",
    "desc": "description", "cat": "category", "subcat": "subcategory",
    "pt": "patient", "dx": "diagnosis", "rx": "prescription", "tx": "treatment", "hx": "history", "sx": "symptoms", "med": "medication", "lab": "laboratory", "appt": "appointment", "hosp": "hospital", "prov": "provider", "ins": "insurance",
    "yr": "year", "mo": "month", "wk": "week", "dy": "day", "hr": "hour", "min": "minute", "sec": "second",
}
SYNONYMS = {
    "client": "customer", "buyer": "customer", "consumer": "customer", "patron": "customer", "member": "user", "subscriber": "user", "participant": "user", "purchase": "order", "sale": "order", "transaction": "order",
    "item": "product", "article": "product", "merchandise": "product", "good": "product", "diagnosis": "medical_diagnosis", "condition": "medical_condition", "therapy": "treatment", "procedure": "medical_procedure",
    "created": "creation_date", "modified": "modification_date", "updated": "modification_date",
}
INDICATORS = ("study", "research", "evidence", "treatment", "diagnosis", "patient", "clinical", "trial", "data", "analysis", "methodology", "results", "conclusion", "reference")
FACT_PATTERNS = (r"\d+", r"(?i)\b(is|are|was|were|has|have|caused?|leads?|results?|shows?)\b", r"(?i)\b(treatment|medication|disease|patient|study|research)\b")


def word_map(word: Column, values: Mapping[str, str]) -> Column:
    table = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(F.try_element_at(table, word), word)


def _basic(name: Column) -> Column:
    """camelCase cut, white space as _, other marks dropped, _ trimmed and collapsed."""
    x = F.regexp_replace(F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2")), r"(?U)\s+", "_")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[^a-z0-9_]", ""), "^_+|_+$", ""), "_+", "_")


def _words(name: Column, values: Mapping[str, str]) -> Column:
    return F.array_join(F.transform(F.split(name, "_"), lambda w: word_map(w, values)), "_")


def _stages(name: Column, abbreviations: Mapping[str, str], synonyms: Mapping[str, str]) -> list[Column]:
    """The name after each stage: basic, abbreviations by word, synonyms of the whole or else by word."""
    basic = _basic(name)
    expanded = _words(basic, abbreviations)
    table = F.create_map(*(F.lit(x) for kv in synonyms.items() for x in kv))
    return [basic, expanded, F.coalesce(F.try_element_at(table, expanded), _words(expanded, synonyms))]


def normalized_name(name: Column, abbreviations: Mapping[str, str] = ABBREVIATIONS, synonyms: Mapping[str, str] = SYNONYMS) -> Column:
    """The canonical form of a name; an empty one stays as it is."""
    return F.when(name == "", name).otherwise(_stages(name, abbreviations, synonyms)[-1])


def trace(name: Column, abbreviations: Mapping[str, str] = ABBREVIATIONS, synonyms: Mapping[str, str] = SYNONYMS) -> Column:
    """The steps of normalization: the original, each stage that changes the name, the final form."""
    basic, expanded, mapped = _stages(name, abbreviations, synonyms)
    said = lambda head, c: F.concat(F.lit(f"{head}: "), c)
    return F.array_compact(F.array(
        said("Original", name), F.when(basic != name, said("Basic normalization", basic)), F.when(expanded != basic, said("Abbreviation expansion", expanded)),
        F.when(mapped != expanded, said("Synonym mapping", mapped)), said("Final", mapped),
    ))


def term_similarity(a: Column, b: Column) -> Column:
    """1 for terms of one canonical form, else the Jaccard similarity of their forms' words."""
    x, y = normalized_name(a), normalized_name(b)
    p, q = (F.array_distinct(F.split(c, "_")) for c in (x, y))
    return F.when(x == y, 1.0).otherwise(F.size(F.array_intersect(p, q)) / F.size(F.array_union(p, q)))


def entity_name(name: Column, abbreviations: Mapping[str, str]) -> Column:
    """Lower case, white space collapsed, and the long form of a name that is an abbreviation; null as empty."""
    return word_map(F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)\s+", " ")), abbreviations)


def entity_type(kind: Column, aliases: Mapping[str, str]) -> Column:
    """The type that an alias stands for, else title case; Entity where there is none."""
    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    known = F.try_element_at(table, F.replace(F.lower(F.trim(kind)), F.lit(" "), F.lit("_")))
    return F.when(F.coalesce(kind, F.lit("")) == "", "Entity").otherwise(F.coalesce(known, title_case(kind)))


def free_name(name: str, taken: list[str]) -> str:
    """The name with underscores before it until no column has it, upper and lower case alike."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def title_case(x: Column) -> Column:
    """A capital after anything that is no letter, all else lower case."""
    return F.array_join(
        F.transform(F.regexp_extract_all(x, F.lit(r"([A-Za-z]+|[^A-Za-z]+)"), 1), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))), "")


def safe_label(x: Column) -> Column:
    return F.regexp_replace(x, r"[^A-Za-z0-9_]", "_")


def clean_markdown(text: Column) -> Column:
    """Rules, bold marks and lines under three characters go; blank lines collapse."""
    x = F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*[-*_]{3,}\s*$", ""), r"\*\*([^*\n]+)\*\*", "$1")
    lines = F.filter(F.split(x, "\n"), lambda w: (F.length(F.trim(w)) == 0) | (F.length(F.trim(w)) >= 3))
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def content_id(text: Column) -> Column:
    return F.concat(F.lit("doc:"), F.substring(F.sha2(text, 256), 1, 16))


def hash_embedding(text: Column, dims: int = 256) -> Column:
    """SHA-256 bytes in turn, scaled to -1 .. 1."""
    digest = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (F.conv(F.substr(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") - 128) / 128)


def chunks(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Paragraph-wise chunks of about ``size`` characters: an array of (start, text).

    Paragraphs are joined while they fit; longer ones are cut every size - overlap characters. One pass an array, in order.
    """
    step = size - overlap
    pieces = F.flatten(F.transform(F.split(text, "\n\n"), lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - overlap - 1) / step).cast("int")), lambda i: F.substr(p, i * step + 1, F.lit(size))))))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state, piece):
        fits = F.length(state["open"]) + F.length(piece) + 2 <= size
        joined = F.when(state["open"] == "", piece).otherwise(F.concat(state["open"], F.lit("\n\n"), piece))
        return F.struct(
            F.when(fits | (state["open"] == ""), state["done"]).otherwise(F.array_append(state["done"], state["open"])).alias("done"),
            F.when(fits | (state["open"] == ""), joined).otherwise(piece).alias("open"),
        )

    return F.aggregate(pieces, empty, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))


def topics(documents: DataFrame, most_terms: int = 10, least: int = 3, most: int = 20) -> DataFrame:
    """doc_id, topics: headings of the first three levels in order, then a text's most frequent capitalized terms seen ``least`` times; ties by term."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda w: F.trim(w).rlike(r"^#{1,3}\s+."))
    heads = documents.select("doc_id", F.transform(lines, lambda w: F.trim(F.regexp_replace(F.trim(w), r"^#{1,3}\s+", ""))).alias("heads"))
    terms = documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]+(?: +[A-Z][a-z]+)*\b"), 0)).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "term"))
    best = terms.withColumn("k", rank).filter((F.col("k") <= most_terms) & (F.col("n") >= least)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "term"))).alias("found"))
    own = F.coalesce(F.col("found.term"), F.array().cast("array<string>"))
    every = F.concat("heads", F.filter(own, lambda x: ~F.array_contains("heads", x)))
    return heads.join(best, "doc_id", "left").select("doc_id", F.slice(every, 1, most).alias("topics"))
