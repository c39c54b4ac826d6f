"""Text normalisation and tokenisation as Column expressions.

Everything here stays inside JVM expressions; no Python function sees a row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marker that separates a question from attached evidence.
EVIDENCE_MARKER = "Benchmark evidence:"

# Words that never become a phrase on their own.
PHRASE_STOP_WORDS = [
    "what", "which", "where", "when", "whose", "show", "list", "give", "find", "return", "with", "from",
    "that", "this", "have", "has", "had", "each", "every", "their", "there", "than", "then", "into", "about",
]

# Words without content for concept matching.
CONCEPT_STOP_WORDS = [
    "what", "which", "who", "where", "when", "please", "give", "show", "list", "find", "return", "have",
    "with", "from", "that", "this", "them", "their", "being", "all", "the", "and", "for", "are", "was",
    "were", "had", "has", "how", "many", "much", "of", "in", "to", "is", "a", "an", "on", "by", "at", "as",
]

# Words ignored when a note is ranked against a question.
NOTE_STOP_WORDS = [
    "the", "and", "for", "with", "what", "which", "how", "are", "was", "were", "that", "this", "from", "who",
    "has", "have", "refers", "refer", "benchmark", "evidence", "among", "all", "any", "their", "they", "its",
]

# Shapes of printed values, tested in this order.
VALUE_PATTERNS = {
    "currency": r"^[$£€¥]\s*[+-]?[\d,]+(\.\d+)?$",
    "percentage": r"^[+-]?[\d,.]+\s*%$",
    "numeric_text": r"^[+-]?[\d,]+(\.\d+)?$",
    "date": r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}([ T].*)?$",
    "time": r"^\d{1,2}:\d{2}(:\d{2})?(\s*[APap][Mm])?$",
}

# Storage-format tags, several of which may hold for one value.
FORMAT_TAGS = {
    "currency_text": r"^[$£€¥]\s*[+-]?[\d,]+(\.\d+)?$",
    "thousands_separator": r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?\+?$",
    "percentage_text": r"^[+-]?[\d,.]+%$",
    "plus_suffix": r"^[\d,]+\+$",
    "date_text": r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}([ T].*)?$",
    "time_text": r"^\d{1,2}:\d{2}(:\d{2})?(\s*[APap][Mm])?$",
    "numeric_text": r"^[+-]?[\d,.]+$",
}

YEAR_PATTERN = r"\b(?:19|20)\d{2}\b"


# Characters removed from both ends of a text.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2003\u2009\u202f\u3000"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value) -> Column:
    return F.btrim(_col(value), F.lit(WHITESPACE))


def fold(value) -> Column:
    """Case folding. Lower-casing plus the foldings that lower-casing leaves alone."""
    lowered = F.replace(F.lower(_col(value)), F.lit("ß"), F.lit("ss"))
    return F.translate(lowered, "ςſ", "σs")


def squeeze(value) -> Column:
    """Trim and collapse every run of whitespace to one space."""
    return F.trim(F.regexp_replace(_col(value), r"(?U)\s+", " "))


def normalize(value) -> Column:
    """The form under which stored values and phrases are compared."""
    return squeeze(fold(value))


def words(value) -> Column:
    """ASCII word list in order of appearance, underscores treated as spaces."""
    return F.regexp_extract_all(fold(F.replace(_col(value), F.lit("_"), F.lit(" "))), F.lit("[a-z0-9]+"), 0)


def identifier_tokens(value) -> Column:
    """camelCase split, folded words, one trailing plural s removed from words longer than three."""
    spaced = F.regexp_replace(_col(value), "([a-z])([A-Z])", "$1 $2")
    return F.transform(
        words(spaced),
        lambda w: F.when(F.endswith(w, F.lit("s")) & (F.length(w) > 3), F.left(w, F.length(w) - 1)).otherwise(w),
    )


def word_tokens(value) -> Column:
    """T4: sorted unique words of the normalised value."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(normalize(value), F.lit("[a-z0-9]+"), 0)))


def compact(value) -> Column:
    """Only the letters and digits of the normalised value."""
    return F.regexp_replace(normalize(value), "[^a-z0-9]+", "")


def grams_of(text: Column, size: int = 3) -> Column:
    """Sorted unique character n-grams; a shorter text is its own single gram.

    A capturing lookahead yields the overlapping runs in one pass; a lambda over positions would
    evaluate ``text`` once per position.
    """
    many = F.sort_array(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), 1)))
    return (
        F.when(F.length(text) >= size, many)
        .when(F.length(text) > 0, F.array(text))
        .otherwise(F.array().cast("array<string>"))
    )


def char_ngrams(value, size: int = 3) -> Column:
    """T5: n-grams of the compacted value."""
    return grams_of(compact(value), size)


def jaccard(left: Column, right: Column) -> Column:
    """Set similarity of two arrays; two empty sets score zero."""
    union = F.greatest(F.lit(1), F.size(F.array_union(left, right)))
    return F.size(F.array_intersect(left, right)) / union


def value_pattern(value) -> Column:
    """T3, first part: which printed shape a value has, or null."""
    text = strip(value)
    result = None
    for name, shape in VALUE_PATTERNS.items():
        hit = text.rlike(shape)
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return result


def value_number(value) -> Column:
    """T3, second part: the number inside a printed value; null when it does not parse."""
    text = strip(value)
    digits = F.regexp_replace(text, r"[$£€¥%,\s]", "")
    return F.when(value_pattern(value).isin("currency", "percentage", "numeric_text"), digits.try_cast("double"))


def format_tags(values: Column) -> Column:
    """Sorted tags that hold for at least one of the printed values."""

    def tag(name: str) -> Column:
        return F.when(F.exists(values, lambda v: strip(v).rlike(FORMAT_TAGS[name])), F.lit(name))

    return F.array_compact(F.array(*[tag(name) for name in sorted(FORMAT_TAGS)]))


def natural_part(question) -> Column:
    """The question without attached evidence."""
    return strip(F.split(_col(question), EVIDENCE_MARKER, 2)[0])


def evidence_part(question) -> Column:
    """The attached evidence, empty when there is none."""
    parts = F.split(_col(question), EVIDENCE_MARKER, 2)
    return F.when(F.size(parts) > 1, strip(F.try_element_at(parts, F.lit(2)))).otherwise("")


def question_key(value) -> Column:
    """Identity of a question, ignoring case and punctuation."""
    return F.trim(F.regexp_replace(fold(value), r"(?U)\W+", " "))


def statement_key(value) -> Column:
    """Identity of a statement, ignoring case and layout."""
    return squeeze(fold(value))


def shingles(items: Column, width: int) -> Column:
    """Runs of ``width`` consecutive items joined by a space; none when there are fewer items.

    Built by zipping shifted copies, so ``items`` is evaluated a fixed number of times per row.
    """
    runs = items
    for shift in range(1, width):
        count = F.greatest(F.size(items) - F.lit(shift), F.lit(0))
        runs = F.zip_with(
            F.slice(runs, F.lit(1), count), F.slice(items, F.lit(shift + 1), count), lambda a, b: F.concat_ws(" ", a, b)
        )
    return runs


def _without(items: Column, stop: list[str], folded: bool = True) -> Column:
    banned = F.array(*[F.lit(w) for w in stop])
    return F.filter(items, lambda w: ~F.array_contains(banned, F.lower(w) if folded else w))


def phrase_words(natural) -> Column:
    """Words of a natural question that may be part of a phrase."""
    return _without(F.regexp_extract_all(_col(natural), F.lit("[A-Za-z][A-Za-z0-9_.-]+"), 0), PHRASE_STOP_WORDS)


def phrase_candidates(natural, kept) -> Column:
    """All phrase spellings in priority order, duplicates still inside. ``kept`` holds the phrase words."""
    natural, kept = _col(natural), _col(kept)
    return F.concat(
        F.regexp_extract_all(natural, F.lit("['\"]([^'\"\\n]{1,120})['\"]"), 1),
        F.regexp_extract_all(
            natural, F.lit(r"[$£€¥]?[+-]?\d[\d,.]*(?:\s*%)?|\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b"), 0
        ),
        F.regexp_extract_all(natural, F.lit(r"(?U)\b[A-Z][\w.-]*(?:\s+[A-Z][\w.-]*){0,3}\b"), 0),
        kept,
        shingles(kept, 2),
        shingles(kept, 3),
    )


def concept_words(natural) -> Column:
    found = F.regexp_extract_all(_col(natural), F.lit("[A-Za-z][A-Za-z0-9_-]*"), 0)
    return F.filter(_without(found, CONCEPT_STOP_WORDS), lambda w: F.length(w) > 2)


def question_terms(question) -> Column:
    """Unique identifier tokens of the natural question without the concept stop words."""
    return F.array_distinct(_without(identifier_tokens(natural_part(question)), CONCEPT_STOP_WORDS, folded=False))


def note_terms(value) -> Column:
    """Unique content words of at least three letters, used to rank column notes."""
    kept = _without(words(value), NOTE_STOP_WORDS, folded=False)
    return F.array_distinct(F.filter(kept, lambda w: F.length(w) >= 3))


def years(value) -> Column:
    return F.regexp_extract_all(_col(value), F.lit(YEAR_PATTERN), 0)


def sql_identifier(name) -> Column:
    """An identifier as it must be written in a statement."""
    name = _col(name)
    quoted = F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(name.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), name).otherwise(quoted)


def quoted(value) -> Column:
    """A value in single quotes; double quotes when it holds a single quote and no double quote."""
    value = _col(value)
    double = F.contains(value, F.lit("'")) & ~F.contains(value, F.lit('"'))
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.when(double, F.concat(F.lit('"'), F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'))).otherwise(
        F.concat(F.lit("'"), escaped, F.lit("'"))
    )
