"""Text functions as Spark columns: tokens, content words, configuration keys, clauses, paragraphs, lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that searches ignore.
SEARCH_STOPWORDS = (
    "the", "a", "an", "of", "to", "in", "is", "are", "and", "or", "for", "on",
    "with", "as", "by", "at", "be", "this", "that", "it", "from", "how", "do",
    "i", "my", "you", "your", "can", "does", "what", "when", "which",
)
# The words that claims ignore.
CLAIM_STOPWORDS = tuple(
    "a an and are as at be by can does do for from has have if in into is it its of on or that "
    "the to use used using with when what which while you your not no than then them they this "
    "these those be been being will would should could may might there here also".split()
)
# Fixed value: what a configuration key looks like.
CONFIG_KEY = r"spark\.[a-zA-Z0-9._]+[a-zA-Z0-9]"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def words(text: Column) -> Column:
    """Runs of a-z and 0-9 in lower case; splitting between them is several times faster than extracting them."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Search tokens in order, duplicates kept; null text has none."""
    return F.filter(F.coalesce(F.split(F.lower(text), "[^a-z0-9]+"), F.array().cast("array<string>")), lambda w: ~w.isin("", *SEARCH_STOPWORDS))


def content_words(text: Column) -> Column:
    return F.filter(F.coalesce(words(text), F.array().cast("array<string>")), lambda w: ~w.isin(*CLAIM_STOPWORDS) & (F.length(w) > 2))


def approximate_tokens(text: Column) -> Column:
    """Words and punctuation marks, a labelled approximation of a model's token count."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"))


def config_keys(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CONFIG_KEY), F.lit(0))


def required_evidence(answer: Column, spans: Column) -> Column:
    """Sorted distinct configuration keys of the answer, then its spans in order."""
    return F.concat(F.array_sort(F.array_distinct(config_keys(answer))), F.coalesce(spans, F.array().cast("array<string>")))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def claim_clauses(answer: Column) -> Column:
    """Clauses that assert something: no configuration key, three content words at least."""
    parts = F.transform(F.split(answer, r"(?<=[.!?])\s+|;\s*"), stripped)
    return F.filter(parts, lambda p: (p != "") & ~p.rlike(CONFIG_KEY) & (F.size(content_words(p)) >= 3))


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n\s*\n"), lambda p: stripped(p) != "")


def lines(text: Column) -> Column:
    parts = F.split(text, LINE_ENDS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def squashed(text: Column, most: int = 90) -> Column:
    return F.substring(F.regexp_replace(stripped(text), r"\s+", " "), 1, most)


def heading_path(path: Column) -> Column:
    return F.array_join(path, " > ")


def chunk_id(doc: Column, ordinal: Column) -> Column:
    return F.format_string("%s#%04d", doc, ordinal)


def thousandths(p: Column) -> Column:
    """p in thousandths, rounded by its exact value and ties to even, as printf does; Java's formats round the shortest decimal instead."""
    x, c = p * 1000.0, p * 134217729.0
    high = c - (c - p)
    rest = (high * 1000.0 - x) + (p - high) * 1000.0  # what the product x lacks
    tie = (x - F.floor(x)) == 0.5
    return F.when(tie & (rest < 0), F.floor(x).cast("double")).when(tie & (rest > 0), F.ceil(x).cast("double")).otherwise(F.rint(x)) / 1000.0


def p_value_text(p: Column) -> Column:
    return F.when(p.isNull(), "n/a").when(p < 0.001, "<.001").otherwise(F.format_string("%.3f", thousandths(p)))


def is_documentation(name: Column) -> Column:
    return name.endswith(".md") & ~name.isin("README.md", "index.md", "404.md")
