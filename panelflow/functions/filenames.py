"""What a file name or folder says about its rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from panelflow.functions.text import as_col, blank_to_null
from panelflow.presets import DETAIL_FILE_TAGS, LEVEL_OF_FOLDER, LEVELS, NO_LEVEL, NO_YEAR


def is_entity_file(name: Column | str) -> Column:
    """Files at entity grain: ``…_rbd.csv``, ``…_rbd_….csv`` or ``…_rbd_….txt``."""
    return as_col(name).rlike(r"(_rbd_.*\.(csv|txt)|_rbd\.csv)$")


def is_main_file(name: Column | str, tags: Sequence[str] = DETAIL_FILE_TAGS) -> Column:
    """Delimited files without a mark of finer grain in the name."""
    low = F.lower(as_col(name))
    return low.rlike(r"\.(csv|txt)$") & ~low.rlike("|".join(tags))


def year_in(name: Column | str) -> Column:
    """First ``20xx`` in the text, else null."""
    found = F.regexp_extract(as_col(name), r"(20\d{2})", 1)
    return blank_to_null(found).try_cast("int")


def level_in(name: Column | str, prefix: str = "", levels: Sequence[str] = LEVELS) -> Column:
    """Level between the prefix and a four-digit year, lower case, else null."""
    pattern = rf"(?i){prefix}({'|'.join(levels)})\d{{4}}"
    return F.lower(blank_to_null(F.regexp_extract(as_col(name), pattern, 1)))


def level_of_folder(folder: Column | str, known: Mapping[str, str] = LEVEL_OF_FOLDER) -> Column:
    """Canonical level of a folder name; an unknown name passes through in lower case."""
    low = F.lower(as_col(folder))
    pairs = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, low), low)


def parent_folder(path: Column | str) -> Column:
    return F.regexp_extract(as_col(path), r"/([^/]+)/[^/]+$", 1)


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(as_col(path), r"([^/]+)$", 1)


def file_facts(
    name: Column | str,
    prefixes: Sequence[str],
    level_pattern: str = "[2468][mb]",
    no_level: str = NO_LEVEL,
    no_year: str = NO_YEAR,
) -> tuple[Column, Column]:
    """(level, year) told by a glossary file name, both text.

    The year follows a known prefix and an optional level; without such a prefix it is the
    first run of four digits, and the level stays at its default.
    """
    name = as_col(name)
    tagged = rf"(?i)({'|'.join(prefixes)})({level_pattern})?(\d{{4}})"
    level = F.lower(blank_to_null(F.regexp_extract(name, tagged, 2)))
    year = blank_to_null(F.regexp_extract(name, tagged, 3))
    any_year = blank_to_null(F.regexp_extract(name, r"(\d{4})", 1))
    return F.coalesce(level, F.lit(no_level)), F.coalesce(year, any_year, F.lit(no_year))
