"""What a message is about: intent, topic, urgency, tone, routing, time windows, names and resolved conditions, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of message kinds, in the order in which they are tried (lower-cased, trimmed text).
KINDS = {
    "greeting": (r"\b(hello|hi|hey|greetings|good morning|good afternoon|good evening)\b", r"^(hi|hello|hey)[\s!?]*$"),
    "symptom_report": (
        r"\b(hurts?|hurt|pain|painful|ache|aching|feeling|symptoms?|discomfort)\b", r"\b(i have|i've got|experiencing|suffering from)\b.*(pain|ache|symptom)", r"\b(my .* (hurts?|aches?|is painful))\b"),
    "follow_up": (
        r"\b(about|regarding|concerning|related to)\b.*(you (said|mentioned|told))", r"\b(earlier|before|previously) you (said|mentioned)\b", r"^(what about|how about)", r"\b(going back to|returning to)\b"),
    "medical_query": (
        r"^(what is|what are|what's|whats)\s+(a|an|the)?\s*\w+", r"^(how (does|do|can|should|would)|why (does|do|is|are))\b.*\?", r"\b(can i take|should i take|is it safe)\b",
        r"\b(side effects?|interactions?|contraindications?)\b", r"\b(treat(s|ment)?|cure|prevent|diagnos(is|e))\b.*\?"),
    "acknowledgment": (
        r"^(thanks?|thank you|thx|ty|appreciate it|got it|ok|okay)[\s!.]*$", r"\b(thanks?|thank you)\b.*\b(much|lot|help)\b", r"^(understood|got it|makes sense|i see)[\s!.]*$"),
    "farewell": (r"^(goodbye|bye|see you|later|farewell|take care)[\s!.]*$", r"\b(have to go|gotta go|heading out)\b"),
    "clarification": (
        r"\b(what do you mean|what does that mean|i don't understand)\b", r"^(huh|what\?|pardon|sorry\?)[\s!?]*$", r"\b(can you (explain|clarify|elaborate|rephrase))\b"),
}
TOPICS = ("pain", "knee", "back", "head", "headache", "fever", "cough", "medication", "treatment", "diagnosis", "prescription", "doctor", "ibuprofen", "aspirin", "therapy", "exercise", "diet")
URGENCY = {
    "critical": ("emergency", "urgent", "critical", "severe", "can't breathe", "chest pain", "bleeding heavily"), "high": ("very painful", "getting worse", "spreading", "swollen", "high fever"),
    "medium": ("concerned", "worried", "uncomfortable", "bothering me"), "low": ("minor", "slight", "occasional", "wondering about"),
}
TONES = {
    "concerned": ("worried", "concerned", "scared", "afraid"), "grateful": ("thanks", "thank you", "appreciate", "grateful"), "frustrated": ("frustrated", "annoyed", "upset", "angry"),
    "hopeful": ("hope", "hoping", "better", "improving"), "confused": ("confused", "don't understand", "unclear"),
}
QUESTION_STARTS = ("what", "how", "why", "can", "should", "is", "does", "do")
MEDICAL_WORDS = ("medication", "treatment", "disease", "condition", "symptom", "pain")
# Routing intents in order of preference: phrases between word ends, phrases anywhere.
INTENTS = {
    "factual": (
        ("qué", "cuál", "cuáles", "cuándo", "cuánto", "cuántos", "dónde", "quién", "cómo se llama", "what", "which", "when", "how much", "how many", "where", "who", "what is called"),
        ("qué es", "cuál es", "cuándo fue", "cuánto es", "dónde está", "quién es", "cómo se llama", "tengo", "tomo", "me recetaron", "what is", "which is", "when was", "how much is", "where is", "who is",
         "what is called", "i have", "i take", "was prescribed")),
    "relational": (
        ("qué relación", "cómo se relaciona", "qué tiene que ver", "para qué sirve", "para qué es", "what relation", "how related", "what has to do", "what is for", "used for"),
        ("medicamento para", "tratamiento para", "sirve para", "se usa para", "indicado para", "contraindicado", "interacción con", "efectos de", "causas de", "medication for", "treatment for", "used for",
         "is for", "indicated for", "contraindicated", "interaction with", "effects of", "causes of")),
    "inferential": (
        ("por qué", "debería", "podría", "es normal", "es peligroso", "me preocupa", "significa que", "why", "should i", "could i", "is it normal", "is it dangerous", "worried about", "means that"),
        ("debería preocuparme", "es normal que", "significa", "podría ser", "es grave", "es peligroso", "qué implica", "qué significa", "por qué tengo", "should i worry", "is it normal", "means", "could be",
         "is serious", "is dangerous", "what does it imply", "what does it mean", "why do i have")),
    "actionable": (
        ("qué debo hacer", "qué puedo hacer", "cómo puedo", "qué me recomienda", "qué opciones tengo", "what should i do", "what can i do", "how can i", "what do you recommend", "what options"),
        ("qué hacer", "cómo actuar", "qué pasos", "recomiendas", "sugieres", "aconsejas", "próximo paso", "siguiente paso", "what to do", "how to act", "what steps", "recommend", "suggest", "advise", "next step",
         "following step")),
    "exploratory": (
        ("cuéntame", "explícame", "háblame", "todo sobre", "información sobre", "tell me", "explain", "talk about", "everything about", "information about"),
        ("cuéntame sobre", "explícame", "háblame de", "quiero saber", "información general", "tell me about", "explain to me", "talk about", "want to know", "general information")),
}
ROUTES = {
    "factual": (("SEMANTIC", "PERCEPTION"), "symbolic_first"), "relational": (("SEMANTIC", "REASONING"), "symbolic_first"), "inferential": (("REASONING", "SEMANTIC"), "collaborative"),
    "actionable": (("APPLICATION", "REASONING"), "collaborative"), "exploratory": (("SEMANTIC", "REASONING", "PERCEPTION"), "collaborative"),
}
# Kinds of question in the order in which they are tried, and how each is answered.
QUESTION_KINDS = {
    "drug_interaction": ("interaction", "interact", "combine", "together with", "take with", "mix with", "drug-drug"),
    "contraindication": ("contraindicated", "should not", "dangerous", "avoid", "allergic", "allergy", "react to"),
    "symptom_interpretation": ("symptom", "feeling", "experiencing", "what does it mean", "is it normal", "why do i feel"),
    "treatment_recommendation": ("treatment", "recommend", "option", "therapy", "should i", "what can i take", "best for"),
    "disease_information": ("what is", "tell me about", "explain", "how does", "causes of", "symptoms of"),
    "data_catalog": ("table", "column", "schema", "database", "data", "field", "dda", "catalog"),
}
STRATEGIES = {
    "drug_interaction": "symbolic_only", "contraindication": "symbolic_only", "symptom_interpretation": "neural_first", "treatment_recommendation": "collaborative",
    "disease_information": "collaborative", "data_catalog": "symbolic_first", "general": "collaborative",
}
# Phrases of time windows, and the windows' hours.
WINDOW_PHRASES = {
    "immediate": ("ahora", "now", "ahora mismo", "right now", "en este momento", "at the moment", "actualmente", "currently"),
    "recent": ("hoy", "today", "esta mañana", "this morning", "hace poco", "recently", "hace unas horas", "a few hours ago"),
    "short_term": ("esta semana", "this week", "últimos días", "last few days", "ayer", "yesterday", "últimamente", "lately"),
    "medium_term": ("este mes", "this month", "últimas semanas", "last few weeks", "el mes pasado", "last month"),
    "long_term": ("últimos meses", "last few months", "este trimestre", "this quarter", "recientemente"),
    "historical": ("siempre", "always", "históricamente", "historically", "desde que empezó", "since the beginning", "alguna vez", "ever", "en el pasado", "in the past"),
}
WINDOW_HOURS = {"immediate": 6, "recent": 24, "short_term": 168, "medium_term": 720, "long_term": 2160, "historical": 87600}
STOP_TERMS = ("what", "is", "the", "a", "an", "how", "does", "can", "i", "me", "my", "about", "tell", "for", "with", "to", "of", "and", "or", "in", "on", "at", "this", "that")
# Ways to give a name with their priority, and what is no name.
NAME_PATTERNS = (
    (r"my name is\s+([A-Z][a-z]+)", 3), (r"i am\s+([A-Z][a-z]+)(?:\s+and|\s*$)", 3), (r"(?:hi|hello|hey),?\s+(?:my name is|i'm|i am)\s+([A-Z][a-z]+)", 3), (r"call me\s+([A-Z][a-z]+)", 3),
    (r"i'm\s+([A-Z][a-z]+)(?:\s+and|\s*,|\s*$)", 2), (r"this is\s+([A-Z][a-z]+)(?:\s+speaking|\s*$)", 2), (r"^([A-Z][a-z]+)\s+here", 1),
)
NO_NAMES = (
    "assistant", "doctor", "nurse", "patient", "user", "help", "okay", "yes", "no", "thanks", "thank", "please", "chronic", "acute", "severe", "mild", "moderate", "morning", "evening", "night", "today",
    "yesterday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
)
RESOLVED = (
    r"(?:no longer have|has resolved|is gone|went away|is better|has cleared)[:\s]+(?:the\s+)?([a-z\s]+?)(?:\s*[-.]|$)", r"(?:their|my)\s+([a-z\s]+?)\s+(?:has\s+)?(?:resolved|gone|better|cleared)",
    r"([a-z\s]+?)\s+(?:has been marked as resolved|is no longer)",
)


def holds(text: Column, phrases: Sequence[str]) -> Column:
    """Whether the text holds one of the phrases."""
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p))


def first_of(text: Column, table: Mapping[str, Sequence[str]], otherwise: str | None) -> Column:
    """The first entry of a table one of whose phrases the text holds."""
    return F.coalesce(*(F.when(holds(text, phrases), name) for name, phrases in table.items()), F.lit(otherwise).cast("string"))


def _plain(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def medical_question(text: Column) -> Column:
    t = _plain(text)
    return (F.exists(F.array(*map(F.lit, QUESTION_STARTS)), lambda w: F.startswith(t, w)) | t.contains("?")) & holds(t, MEDICAL_WORDS)


def kind(text: Column) -> Column:
    """The first kind of message with a pattern that the text meets; else a medical question, else unknown. A null text is empty."""
    t = _plain(text)
    met = (F.when(t.rlike("|".join(f"(?:{p})" for p in patterns)), name) for name, patterns in KINDS.items())
    return F.coalesce(*met, F.when(medical_question(text), "medical_query"), F.lit("unknown"))


def topic(text: Column) -> Column:
    """The first medical term that the text holds, else the word after "my", else null."""
    t = _plain(text)
    after = F.regexp_extract(t, r"(?:^|\s)my\s+(\S+)", 1)
    return F.coalesce(*(F.when(F.contains(t, F.lit(w)), w) for w in TOPICS), F.when(after != "", after))


def urgency(text: Column) -> Column:
    return first_of(_plain(text), URGENCY, "medium")


def tone(text: Column) -> Column:
    return first_of(_plain(text), TONES, "neutral")


def title(text: Column) -> Column:
    """A session's title from its first message: topic, then what is said about it; null without a topic."""
    suffix = F.when(kind(text) == "symptom_report", " Discussion").when(kind(text) == "medical_query", " Query").otherwise("")
    return F.concat(F.initcap(topic(text)), suffix)


def route(text: Column, boost: float = 0.2) -> Column:
    """A struct of intent, confidence, layers, strategy for a question in either language.

    Each phrase that the text holds adds 0.3 + boost * min(1, length / 20); an intent's score is at most 1, and of equal ones the first wins.
    Confidence is the best score times 1 + its lead over the next, at most 1 (0.3 without any phrase).
    """
    t = _plain(text)

    def total(phrases: Sequence[str], met) -> Column:
        weigh = lambda acc, p: acc + 0.3 + F.least(F.length(p) / 20, F.lit(1.0)) * boost
        return F.aggregate(F.filter(F.array(*map(F.lit, phrases)), met), F.lit(0.0), weigh)

    def bounded(p: Column) -> Column:  # phrases hold letters and blanks alone, so that they are patterns as they are
        return F.contains(t, p) & F.regexp_like(t, F.concat(F.lit(r"\b"), p, F.lit(r"\b")))

    scores = [F.struct(F.least(total(words, bounded) + total(phrases, lambda p: F.contains(t, p)), F.lit(1.0)).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("intent"))
              for i, (name, (words, phrases)) in enumerate(INTENTS.items())]
    ranked = F.sort_array(F.array(*scores), asc=False)
    best, following = ranked[0]["score"], ranked[1]["score"]
    confidence = F.when(best > 0, F.least(best * (1 + best - following), F.lit(1.0))).otherwise(0.3)
    routes = F.create_map(*(x for name, (layers, strategy) in ROUTES.items() for x in (F.lit(name), F.struct(F.array(*map(F.lit, layers)).alias("layers"), F.lit(strategy).alias("strategy")))))
    way = routes[ranked[0]["intent"]]
    return F.struct(ranked[0]["intent"].alias("intent"), confidence.alias("confidence"), way["layers"].alias("layers"), way["strategy"].alias("strategy"))


def next_layer(layers: Column, tried: Column, found: Column, order: Sequence[str]) -> Column:
    """The layer to ask next where the tried ones found nothing: the routed ones first, then the others in order; null if there is none."""
    left = F.array_except(F.array_union(layers, F.array(*map(F.lit, order))), tried)
    return F.when(found == 0, F.get(left, F.lit(0)))


def question_kind(text: Column) -> Column:
    return first_of(_plain(text), QUESTION_KINDS, "general")


def strategy(question: Column) -> Column:
    return F.coalesce(*(F.when(question == k, v) for k, v in STRATEGIES.items()))


def time_window(text: Column, default: str = "short_term") -> Column:
    """A struct of window, hours, confidence, ago (hours back of an explicit "n units ago", else null).

    An explicit time decides (0.95), else the longest phrase in the text (0.9; of equal ones the first), else the default (0.5). Months are 30 days.
    """
    t = F.lower(F.coalesce(text, F.lit("")))
    unit_hours = F.create_map(*(F.lit(x) for kv in {"h": 1, "d": 24, "w": 168, "s": 168, "m": 720}.items() for x in kv))
    explicit = F.coalesce(*(
        F.when(t.rlike(p), F.regexp_extract(t, p, 1).try_cast("long") * unit_hours[F.substring(F.regexp_extract(t, p, 2), 1, 1)])
        for p in (r"hace\s+(\d+)\s+(días|día|horas|hora|semanas|semana|meses|mes)", r"(\d+)\s+(days|day|hours|hour|weeks|week|months|month)\s+ago")
    ))
    of_hours = F.coalesce(*(F.when(explicit <= h, name) for name, h in WINDOW_HOURS.items() if name != "historical"), F.when(explicit.isNotNull(), "historical"))
    phrases = [(p, name) for name, ps in WINDOW_PHRASES.items() for p in ps]
    known = F.array(*(F.struct(F.lit(len(p)).alias("n"), F.lit(-i).alias("order"), F.lit(p).alias("phrase"), F.lit(name).alias("window")) for i, (p, name) in enumerate(phrases)))
    named = F.array_max(F.filter(known, lambda x: F.contains(t, x["phrase"])))["window"]
    window = F.coalesce(of_hours, named, F.lit(default))
    hours = F.coalesce(*(F.when(window == k, F.lit(h)) for k, h in WINDOW_HOURS.items()))
    confidence = F.when(explicit.isNotNull(), 0.95).when(named.isNotNull(), 0.9).otherwise(0.5)
    return F.struct(window.alias("window"), hours.alias("hours"), confidence.alias("confidence"), explicit.alias("ago"))


def question_terms(text: Column, most: int = 10) -> Column:
    """The first ``most`` words of three letters or more that are no stop words, without marks at their ends."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_TERMS))
    return F.slice(F.transform(words, lambda w: F.regexp_replace(w, r"^[?.,!]+|[?.,!]+$", "")), 1, most)


def given_names(text: Column, known_drugs: Sequence[str] = ()) -> Column:
    """Array of (name, priority) that a text introduces: at least three letters, no excluded word, no drug; a pattern's first match counts."""
    found = F.array(*(F.struct(F.regexp_extract(text, f"(?i){p}", 1).alias("name"), F.lit(priority).alias("priority")) for p, priority in NAME_PATTERNS))
    return F.filter(found, lambda x: (F.length(x["name"]) >= 3) & ~F.lower(x["name"]).isin(*NO_NAMES, *known_drugs))


def resolved_condition(text: Column) -> Column:
    """The condition that a text says is over, else null."""
    t = F.lower(F.coalesce(text, F.lit("")))
    tries = [F.trim(F.regexp_extract(t, p, 1)) for p in RESOLVED]
    return F.coalesce(*(F.when(~x.isin("", "it", "this", "that", "the"), x) for x in tries))


def returning(subjects: DataFrame, ref: str) -> DataFrame:
    """``subjects`` (last, topics, summary, sessions, memories) with days since the last session, the number of signals and whether any says that the subject returns."""
    signals = (F.col("last").isNotNull(), F.coalesce(F.size("topics"), F.lit(0)) > 0, F.coalesce(F.length("summary"), F.lit(0)) > 10, F.col("sessions") > 1, F.col("memories") > 0)
    count = sum((F.coalesce(s, F.lit(False)).cast("int") for s in signals), F.lit(0))
    days = F.datediff(F.lit(ref).cast("date"), F.col("last").cast("date")).cast("long")
    return subjects.withColumns({"days": days, "signals": count}).withColumn("returning_subject", F.col("signals") > 0)
