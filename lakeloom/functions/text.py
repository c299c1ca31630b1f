"""Column functions on text: tokens, hashes, measures. All run in the JVM.

``\\w`` means letters, digits and underscores of any script (``[\\p{L}\\p{N}_]`` in Java's regex).
Null in, null out, unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the retrieval tokenizer drops.
STOPWORDS = ("and", "the", "is", "in", "to", "of", "a", "for", "with", "on", "at")
WORD = r"[\p{L}\p{N}_]+"
#: White space of any script, in a spelling that Java and RE2 share.
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def words(c: Column) -> Column:
    """Word tokens in lower case, duplicates kept (service tokenizer; also ``\\b\\w+\\b``)."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def tokens(c: Column) -> Column:
    """Retrieval tokens: hyphens stay inside, stop words go."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS))


def plain_split(c: Column) -> Column:
    """White-space tokens; none for blank texts."""
    return F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))


def count_matches(c: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))


def count_literal(c: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def squashed(c: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), SPACE, " "))


def content_hash(c: Column) -> Column:
    """SHA-256 of the squashed text; empty for null and blank texts, which are never duplicates."""
    flat = squashed(F.coalesce(c, F.lit("")))
    return F.when(flat == "", F.lit("")).otherwise(F.sha2(flat, 256))


def char_shingles(c: Column, k: int = 3) -> Column:
    """Distinct k-grams of the squashed text's characters; none if it is shorter."""
    flat = squashed(c)
    return F.when(F.length(flat) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(flat) - (k - 1)), lambda i: F.substring(flat, i, k)))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both))


def density(c: Column) -> Column:
    """Share of non-space characters, length of content lines and variety of words, weighted .4/.3/.3; .5 for very short texts."""
    lines = F.filter(F.split(c, r"\r\n|\r|\n"), lambda x: F.length(F.trim(x)) > 5)
    solid = F.length(F.regexp_replace(c, r"\s", "")) / F.length(c)
    line = F.least(F.lit(1.0), F.aggregate(lines, F.lit(0.0), lambda s, x: s + F.length(x)) / F.size(lines) / 100)
    w = words(c)
    variety = F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(0.5)
    return F.when((F.length(F.coalesce(c, F.lit(""))) < 10) | (F.size(lines) == 0), F.lit(0.5)).otherwise(0.4 * solid + 0.3 * line + 0.3 * variety)


# Word lists of the rule-based sentiment ("difficult" counts twice).
POSITIVE = ("good", "great", "excellent", "positive", "outstanding", "beneficial", "successful", "improve", "advantage", "useful", "helpful", "best", "recommend", "happy", "pleased", "impressive", "perfect", "wonderful")
NEGATIVE = ("bad", "poor", "negative", "terrible", "horrible", "worst", "failure", "problem", "issue", "difficult", "disappointing", "fail", "disadvantage", "damage", "risk", "harm", "severe", "trouble", "wrong")


def sentiment(c: Column) -> Column:
    """STRUCT<sentiment, score>: beyond a quarter either way it is positive or negative."""
    return sentiment_of(words(c))


def sentiment_of(w: Column) -> Column:
    """As ``sentiment``, of word tokens."""
    pos = F.size(F.filter(w, lambda x: x.isin(*POSITIVE)))
    neg = F.size(F.filter(w, lambda x: x.isin(*NEGATIVE))) + F.size(F.filter(w, lambda x: x == "difficult"))
    score = F.when(pos + neg > 0, (pos - neg) / (pos + neg)).otherwise(0.0)
    return F.struct(F.when(score > 0.25, "positive").when(score < -0.25, "negative").otherwise("neutral").alias("sentiment"), F.round(score, 2).alias("score"))


# Key words of the topics.
TOPICS = {
    "technology": ("software", "hardware", "computer", "algorithm", "programming", "code", "development", "api"),
    "finance": ("budget", "investment", "financial", "revenue", "profit", "loss", "market", "stock", "fund"),
    "healthcare": ("patient", "medical", "health", "treatment", "diagnosis", "hospital", "clinic", "doctor"),
    "education": ("student", "learning", "teaching", "course", "curriculum", "school", "university", "education"),
    "business": ("company", "business", "corporate", "strategy", "management", "customer", "service", "product"),
    "legal": ("law", "legal", "regulation", "compliance", "contract", "agreement", "policy", "rights"),
    "science": ("research", "experiment", "hypothesis", "data", "analysis", "scientific", "theory"),
    "marketing": ("brand", "campaign", "advertising", "market", "consumer", "customer", "promotion"),
}


def topic_scores(c: Column) -> Column:
    """MAP<topic, occurrences of its key words anywhere in the text>."""
    low = F.lower(c)
    pairs = []
    for topic, keys in TOPICS.items():
        total = F.lit(0)
        for k in keys:
            total = total + count_literal(low, k)
        pairs += [F.lit(topic), total]
    return F.create_map(*pairs)


def topics(c: Column) -> Column:
    """Topics with at least a fifth of the highest score, best first, ties in the table's order."""
    return topics_of(topic_scores(c))


def topics_of(scores: Column) -> Column:
    """As ``topics``, of the map of scores."""
    top = F.array_max(F.map_values(scores))
    order = list(TOPICS)
    ranked = F.array_sort(F.transform(F.filter(F.map_entries(scores), lambda e: (e["value"] > 0) & (e["value"] >= 0.2 * top)), lambda e: F.struct((-e["value"]).alias("s"), F.array_position(F.array(*map(F.lit, order)), e["key"]).alias("o"), e["key"].alias("t"))))
    return F.transform(ranked, lambda r: r["t"])


DATE = r"(?i)\b(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{4}|\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{4})\b"
_FORMATS = ("yyyy-M-d", "yyyy/M/d", "d-M-yyyy", "d/M/yyyy", "d MMM yyyy", "d MMMM yyyy")


def dates(c: Column) -> Column:
    """ISO dates from 1900 to next year, each once, in order of appearance."""
    found = F.regexp_extract_all(c, F.lit(DATE), F.lit(1))
    parsed = F.transform(found, lambda x: F.coalesce(*(F.to_date(F.try_to_timestamp(x, F.lit(f))) for f in _FORMATS)))
    good = F.filter(parsed, lambda d: d.isNotNull() & (F.year(d) >= 1900) & (F.year(d) <= F.year(F.current_date()) + 1))
    return F.array_distinct(F.transform(good, lambda d: F.date_format(d, "yyyy-MM-dd")))


def structure(c: Column) -> Column:
    """STRUCT<section_count, has_lists, list_count, paragraph_count>."""
    headers = count_matches(c, r"(?m)^#+\s+.+$|^[A-Z][A-Za-z0-9\s]+:$")
    lists = count_matches(c, r"(?m)^\s*\d+\.\s+[\p{L}\p{N}_]+") + count_matches(c, r"(?m)^\s*[-*•]\s+[\p{L}\p{N}_]+")
    paragraphs = F.size(F.filter(F.split(c, r"\n\s*\n"), lambda p: p.rlike(r"\S")))
    return F.struct(headers.alias("section_count"), (lists > 0).alias("has_lists"), lists.alias("list_count"), paragraphs.alias("paragraph_count"))


def document_type(c: Column) -> Column:
    """By the first pattern that the content has; plain text otherwise."""
    return (
        F.when(c.rlike(r"^#\s+|\n#{1,6}\s+"), "markdown")
        .when(c.rlike(r"<html|<body|<div|<p>|<h[1-6]"), "html")
        .when(c.rlike(r"def\s+[\p{L}\p{N}_]+\s*\(|class\s+[\p{L}\p{N}_]+\s*[:(]|import\s+[\p{L}\p{N}_]+|from\s+[\p{L}\p{N}_]+\s+import"), "code")
        .when(c.rlike(r"\b(?:Dear|To Whom It May Concern|Sincerely|Regards)[,:]"), "letter")
        .when(c.rlike(r"\b(?:Abstract|Introduction|Methodology|Results|Conclusion|References)\b"), "academic")
        .when(c.rlike(r"\b(?:Table of Contents|Chapter \d+)\b"), "book")
        .otherwise("text")
    )


# Patterns of rule-based entities.
ENTITY_PATTERNS = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "URL": r"https?://(?:[-\w.]++|%[\da-fA-F]{2})+[/\w\.-]*(?:\?\S+)?",
    "MONEY": r"\$\s*\d+(?:[,.]\d+)*(?:\s*(?:thousand|million|billion|trillion))?|\d+(?:[,.]\d+)*\s*(?:USD|EUR|GBP|JPY|CHF|CAD|AUD|CNY|HKD|NZD|KRW)",
    "PERCENT": r"\b\d+(?:\.\d+)?%\b",
    "VERSION": r"\bv?(?:\d+\.){1,3}\d+(?:-[a-zA-Z0-9.-]+)?\b",
}


# Words that end the names of organisations and of places, the phone pattern, and abbreviations of organisations.
ORGANISATIONS = ("Inc", "LLC", "Ltd", "Limited", "Corp", "Corporation", "Company", "Co", "GmbH", "AG", "Foundation", "Institute", "University", "College", "School", "Association", "Society", "Partners", "Group", "Team", "Department")
METADATA_ORGANISATIONS = ("Inc", "LLC", "Ltd", "Corporation", "Corp", "Company", "Co", "GmbH", "Limited", "Association", "Foundation", "Institute", "University", "College")
PLACES = ("Street", "Avenue", "Road", "Boulevard", "Lane", "Drive", "Place", "Square", "Highway", "Bridge", "Park", "City", "Town", "Village", "County", "District", "State", "Province", "Country", "Region", "Area", "Valley", "Mountain", "Island", "River", "Lake", "Ocean", "Sea", "Bay", "Coast", "Port", "Airport")
PHONE = r"\b(?:\+\d{1,3}\s?)?(?:\(\d{1,4}\)\s?)?(?:\d{1,4}[-.\s]?){1,4}\d{1,4}\b"
ABBREVIATIONS = {
    "USA": "United States of America",
    "US": "United States",
    "UK": "United Kingdom",
    "EU": "European Union",
    "UN": "United Nations",
    "CEO": "Chief Executive Officer",
    "CFO": "Chief Financial Officer",
    "CTO": "Chief Technology Officer",
    "VP": "Vice President",
    "Dr.": "Doctor",
    "Prof.": "Professor",
    "Mr.": "Mister",
    "Mrs.": "Missus",
    "MS": "Microsoft",
    "FB": "Facebook",
    "AMZN": "Amazon",
    "GOOG": "Google",
    "AAPL": "Apple",
    "IBM": "International Business Machines",
}
TITLES = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.")


def names_before(c: Column, words: tuple[str, ...]) -> Column:
    """Distinct runs of words from a capital letter to one of ``words``, in alphabetical order; the white space before it becomes one space."""
    each = [F.transform(F.regexp_extract_all(c, F.lit(rf"\b([A-Z][A-Za-z0-9\s&'-]+)\s+{w}\b"), F.lit(1)), lambda x: F.concat(x, F.lit(" "), F.lit(w))) for w in words]  # noqa: B023
    return F.array_sort(F.array_distinct(F.concat(*each)))


def all_entities(c: Column) -> Column:
    """As ``entities``, with PHONE, ORGANIZATION and LOCATION."""
    more = [F.lit("PHONE"), F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(PHONE), F.lit(0)))), F.lit("ORGANIZATION"), names_before(c, ORGANISATIONS), F.lit("LOCATION"), names_before(c, PLACES)]
    return F.map_concat(entities(c), F.map_filter(F.create_map(*more), lambda k, v: F.size(v) > 0))


def normal_entity(kind: Column, entity: Column) -> Column:
    """The normal form of an entity: persons without titles, organisations without abbreviation, dates in ISO form."""
    person = F.regexp_replace(F.trim(F.regexp_replace(entity, "(?:" + "|".join(t.replace(".", r"\.") for t in TITLES) + r") ", "")), r"\s+", " ")
    full = F.element_at(F.create_map(*(F.lit(x) for pair in ABBREVIATIONS.items() for x in pair)), entity)
    return F.when(kind == "PERSON", person).when(kind == "ORGANIZATION", F.coalesce(full, entity)).when(kind == "DATE", F.coalesce(dates(entity)[0], entity)).otherwise(entity)


def references(c: Column) -> Column:
    """Citations, each once, in order of kind: (Author, year), [n], and the entries of the last reference section."""
    harvard = r"\(([A-Z][a-z]+(?:[-\s][A-Z][a-z]+)*)(?:[\s,]+(?:et al\.?|and)[\s,]+[A-Z][a-z]+)*[\s,]+(\d{4})\)"
    whole = F.regexp_extract_all(c, F.lit(harvard), F.lit(0))
    authors = F.transform(whole, lambda x: F.concat(F.regexp_extract(x, harvard, 1), F.lit(", "), F.regexp_extract(x, harvard, 2)))
    numbers = F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: F.concat(F.lit("["), x, F.lit("]")))
    parts = F.split(c, r"(?m)^(?:References|Bibliography|Works Cited|Sources)\s*$")
    lines = F.transform(F.split(F.element_at(parts, -1), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    put = lambda a: F.when(a["now"] != "", F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"])

    def step(a: Column, x: Column) -> Column:
        longer = F.struct(a["done"].alias("done"), F.when(a["now"] != "", F.concat(a["now"], F.lit(" "), x)).otherwise(F.lit("")).alias("now"))
        return F.when(x == "", F.struct(put(a).alias("done"), F.lit("").alias("now"))).when(x.rlike("^[A-Z]"), F.struct(put(a).alias("done"), x.alias("now"))).otherwise(longer)

    listed = F.when(F.size(parts) > 1, F.aggregate(lines, empty, step, put)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(authors, numbers, listed))


def entities(c: Column) -> Column:
    """MAP<type, distinct matches in alphabetical order>, types without a match left out."""
    pairs = []
    for name, pattern in {**ENTITY_PATTERNS, "DATE": DATE}.items():
        pairs += [F.lit(name), F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0))))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: F.size(v) > 0)
