"""Text cleaning and text-to-value conversion."""

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

# Accepted boolean spellings, as lower-case text.
TRUE_TEXTS = ["t", "tr", "tru", "true", "y", "ye", "yes", "on", "1"]
FALSE_TEXTS = ["f", "fa", "fal", "fals", "false", "n", "no", "of", "off", "0"]


def blank_to_null(text):
    """Outer spaces removed; an empty rest becomes NULL."""
    return F.nullif(F.trim(text), F.lit(""))


def blank_or_null_word_to_null(text):
    """As `blank_to_null`, and the literal word null becomes NULL too."""
    return F.nullif(blank_to_null(text), F.lit("null"))


def is_unusable_id(text):
    """True for NULL, blank, the word null in any case, or outer spaces."""
    trimmed = F.trim(text)
    return (
        text.isNull() | (trimmed == "") | (F.lower(trimmed) == "null") | (text != trimmed)
    )


def any_unusable_id(names):
    """One predicate over several id columns."""
    return reduce(or_, [is_unusable_id(F.col(n)) for n in names])


def text_to_boolean(text, strict=True):
    word = F.lower(F.trim(text))
    value = F.when(word.isin(TRUE_TEXTS), F.lit(True)).when(
        word.isin(FALSE_TEXTS), F.lit(False)
    )
    if not strict:
        return value
    return value.when(
        text.isNotNull(),
        F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean"),
    )


def utf8_text(data, strict=True):
    """Bytes as text. Malformed input raises, or gives NULL when not strict."""
    if strict:
        return F.decode(data, "UTF-8")
    return F.try_validate_utf8(data.cast("string"))
