"""Tokenisers and text predicates. The ``lower`` forms stay inside generated code; ``nfkc_casefold`` is the exact form."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

WORD = r"[\p{L}\p{N}]+"
NO_WORD = r"[^\p{L}\p{N}]+"
# Fixed values of the retrieval language: words without evidence, directive words, words that ask for numbers.
STOP = "a an the and or of to in on at by for from with as is are was were be been this that these those what which where when why how please tell give show find list name include including across applicable applies apply specified before after since until exactly required requirement return full values value number numeric strings word only answer".split()
DIRECTIVES = "return full values value number numeric strings word evaluation date only answer".split()
NUMERIC = "price fee cost charge invoice quantity total sum response target limit elapsed hour hours effective amendment replace".split()
#: Who buys from whom, as a sentence's end: (subject, provider).
ASSIGNMENT = r"(?i)\b([\p{L}\p{N}_ -]{1,80}?)\s+purchases\s+service\s+from\s+([\p{L}\p{N}_ .-]{1,80})\.?$"
#: What any text has that holds such a sentence.
ASSIGNS = r"(?i)purchases\s+service\s+from\s"
EFFECTIVE = r"(?i)\b(?:effective|amend|replace|supersed)\w*\b"


@F.pandas_udf(StringType())
def nfkc_casefold(text: pd.Series) -> pd.Series:
    """NFKC, then casefold: what ``lower`` only approximates (sharp s, dotted I, full width)."""
    return text.str.normalize("NFKC").str.casefold()


def flat(text: Column) -> Column:
    """Lower case, underscores as blanks, white space as single blanks."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), "_", " "), r"\s+", " "))


def words(text: Column) -> Column:
    """All words in order, lower case, underscores apart."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def spaced(text: Column) -> Column:
    """All words in order, lower case, as one text: what is no word is one space, at the ends too."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NO_WORD, " ")


def distinct_words(text: Column) -> Column:
    return F.array_distinct(words(text))


def t1_terms(text: Column) -> Column:
    """Retrieval terms: distinct words without the stop list."""
    return F.array_except(F.array_distinct(words(text)), F.array(*[F.lit(w) for w in STOP]))


def t2_terms(text: Column) -> Column:
    """Graph terms: distinct words of three signs or more."""
    return F.array_distinct(F.filter(words(text), lambda w: F.length(w) >= 3))


def t3_text(text: Column) -> Column:
    """Search text: words joined by single spaces."""
    return F.array_join(words(text), " ")


def t4_terms(text: Column) -> Column:
    """Semantic terms: words of three signs or more, in order, repeats kept."""
    return F.filter(words(text), lambda w: F.length(w) >= 3)


def t5_text(text: Column) -> Column:
    """Duplicate key: everything but a-z and 0-9 becomes one space. What stays is listed and joined: replacing what goes costs ten times as much."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def contains_phrase(haystack: Column, needle: Column) -> Column:
    """Whether the word list ``needle`` stands contiguously in the word list ``haystack``."""
    return F.concat(F.lit(" "), F.array_join(haystack, " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.array_join(needle, " "), F.lit(" ")))


def digest(*columns: Column) -> Column:
    """sha256 identity of a flat record: of its fields' texts as a JSON array, so that no two records run together."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.array(*[c.cast("string") for c in columns])), 256))


def canonical_digest(body: Column) -> Column:
    """sha256 of the canonical form of JSON texts: sorted keys, no blanks, no non-finite numbers; null for what is no strict JSON object."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(body)["canonical"], 256))


def strict_object(body: str | None) -> tuple[str | None, str | None]:
    """(problem, canonical form) of a JSON text: repeated keys and non-finite numbers are no strict JSON."""

    def pairs(items):
        if len(items) != len({k for k, _ in items}):
            raise KeyError("repeated_key")
        return dict(items)

    def refuse(_):
        raise KeyError("non_finite")

    try:
        value = json.loads(body or "", object_pairs_hook=pairs, parse_constant=refuse)
        if not isinstance(value, dict):
            return "not_an_object", None
        return None, json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except KeyError as e:
        return e.args[0], None
    except (ValueError, RecursionError):
        return "malformed", None


@F.pandas_udf(StructType([StructField("problem", StringType()), StructField("canonical", StringType())]))
def canonical_json(body: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([strict_object(b) for b in body], columns=["problem", "canonical"])
