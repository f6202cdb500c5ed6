"""Columns of names, paths and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldergraph.functions.values import EXTENSION_TAGS, MIME_TYPES, OTHER_MIME, STOPWORDS, SUPPORTED_EXTENSIONS


def _table(groups: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for value, names in groups.items() for name in names.split() for x in (name, value)])


def extension_tag(extension: Column) -> Column:
    """The tag of an extension with or without its dot; null if it has none."""
    return F.try_element_at(_table(EXTENSION_TAGS), F.regexp_replace(F.lower(extension), r"^\.", ""))


def mime_type(extension: Column) -> Column:
    return F.coalesce(F.try_element_at(_table(MIME_TYPES), F.lower(extension)), F.lit(OTHER_MIME))


def is_supported(extension: Column) -> Column:
    return F.lower(extension).isin(SUPPORTED_EXTENSIONS)


def terms(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits that count as keywords."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[a-zA-Z0-9]+"), F.lit(0)), F.lower)
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS) & ~w.rlike("^[0-9]+$"))


def normal_path(path: Column) -> Column:
    """Forward slashes, none at the end."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", "")


def file_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^./]*$", "")


def parent_path(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def ancestors(path: Column) -> Column:
    """A path and all paths above it, from the top down: /a/b -> [/a, /a/b]."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def safe_name(name: Column) -> Column:
    """Characters that folder names can't have become _."""
    return F.trim(F.translate(name, '/\\:*?"<>|', "_________"))


#: Fields that file_metadata may have, whatever the kind of file.
METADATA = "lines long, characters long, words long, pages long, width long, height long, title string, author string, subject string, description string, keywords string, lastModifiedBy string, revision string"


def metadata_json(metadata: Column) -> Column:
    """A struct of METADATA fields, or a map of them, as JSON text; null fields are left out."""
    return F.to_json(metadata)


def parsed_metadata(text: Column) -> Column:
    """A struct of METADATA; fields that are missing, and all fields of a text that isn't a JSON object, are null."""
    return F.from_json(text, METADATA)


def text_metadata(text: Column) -> Column:
    """lines, characters (bytes) and words of a text."""
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    words = F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    return F.struct(lines.cast("long").alias("lines"), F.octet_length(text).cast("long").alias("characters"), words.cast("long").alias("words"))
