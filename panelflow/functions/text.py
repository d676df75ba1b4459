"""Text clean-up, coercion and code maps.  All built-in expressions, no UDF."""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from panelflow.presets import NULL_TOKENS, SIGNIFICANCE_CODES

# Every character Python counts as blank, so that a strip here equals a Python strip.
BLANKS = "".join(chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace())

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(as_col(c).cast("string"), F.lit(BLANKS))


def lower_strip(c: Column | str) -> Column:
    return F.lower(strip(c))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(as_col(c), F.lit(""))


def null_tokens(c: Column | str, tokens: Sequence[str] = NULL_TOKENS, stripped: bool = True) -> Column:
    """Null where the text is one of the tokens for "missing"."""
    c = as_col(c)
    probe = strip(c) if stripped else c
    return F.when(~probe.isin(list(tokens)), c)


def to_number(c: Column | str) -> Column:
    """Text to double; anything that is not a plain decimal number gives null.

    The pattern keeps out what a bare cast lets through: ``5d``, ``NaN``, ``Infinity``.
    """
    text = strip(c)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def to_integer(c: Column | str, kind: str = "int") -> Column:
    """Text to integer; ``2016.0`` counts as 2016, a fraction gives null.

    Digits are cast directly: by way of a double, long ids would lose their last digits.
    """
    return canonical_code(c).try_cast(kind)


def canonical_code(c: Column | str) -> Column:
    """One spelling per code: ``1``, ``1.0`` and ``1.00`` are all ``1``."""
    return whole_number(strip(c))


def whole_number(text: Column) -> Column:
    """Drop a fraction of zeros."""
    return F.regexp_replace(text, r"^([+-]?\d+)\.0+$", "$1")


def _literal_map(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def map_code(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Code to label; a code outside the map gives null."""
    return F.try_element_at(_literal_map(mapping), as_col(c))


def recode(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Code to label; a code outside the map stays as it is."""
    c = as_col(c)
    return F.coalesce(map_code(c, mapping), c)


def contains_any(c: Column | str, words: Sequence[str]) -> Column:
    c = as_col(c)
    hit = F.lit(False)
    for word in words:
        hit = hit | c.contains(word)
    return hit


def contains_ignore_case(c: Column | str, word: str) -> Column:
    """Substring test; null counts as no."""
    return F.coalesce(F.lower(as_col(c)).contains(word.lower()), F.lit(False))


def classify_by_words(c: Column | str, classes: Mapping[str, Sequence[str]]) -> Column:
    """Name of the first class one of whose words occurs, else the normalised text."""
    text = lower_strip(c)
    out: Column | None = None
    for name, words in classes.items():
        test = contains_any(text, words)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return text if out is None else out.otherwise(text)


def override_by_words(c: Column | str, words: Sequence[str], default: Column | str) -> Column:
    """The first of the words that occurs in the text, else the default."""
    text = F.lower(as_col(c))
    hits = [F.when(text.contains(word), F.lit(word)) for word in words]
    return F.coalesce(*hits, as_col(default))


def strip_infix(c: Column | str, infixes: Sequence[str]) -> Column:
    """Drop a level infix that closes a name part: ``prom_mate2m_rbd`` to ``prom_mate_rbd``."""
    return F.regexp_replace(as_col(c), f"({'|'.join(infixes)})(?=_|$)", "")


def template(*parts: Column | str) -> Column:
    """Parts joined by underscores."""
    return F.concat_ws("_", *[as_col(p) for p in parts])


def sign_class(c: Column | str) -> Column:
    return F.when(as_col(c) > 0, F.lit("positive")).otherwise(F.lit("negative"))


def first_delimiter(c: Column | str) -> Column:
    """Delimiter of a header line: a pipe wins over a semicolon, a semicolon over a comma."""
    c = as_col(c)
    return (
        F.when(c.contains("|"), F.lit("|"))
        .when(c.contains(";"), F.lit(";"))
        .otherwise(F.lit(","))
    )


def rank_of(c: Column | str, ordered: Sequence[str]) -> Column:
    """1-based place of a label in a declared order, null for other labels."""
    c = as_col(c)
    ranks = F.create_map(*[x for i, v in enumerate(ordered, 1) for x in (F.lit(v), F.lit(i))])
    return F.try_element_at(ranks, c)


def significance_flag(c: Column | str) -> Column:
    """Significance of a difference as -1, 0 or 1, from its text or its number."""
    return to_integer(recode(strip(c), SIGNIFICANCE_CODES))


def stamp_to_date(c: Column | str) -> Column:
    """Date of a ``yyyyMMdd`` stamp, null where it is not one."""
    return F.try_to_date(canonical_code(c), "yyyyMMdd")
