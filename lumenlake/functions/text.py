"""File names, folder names, destination paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenlake.constants import FOLDER_FORBIDDEN

# Leading or trailing white space, in the Unicode sense.
_EDGES = r"(?U)^\s+|\s+$"


def trim_unicode(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def file_name(path: Column) -> Column:
    """Last component of a path, empty when there is none (STR1)."""
    last = F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)
    return F.when(last.isin(".", ".."), F.lit("")).otherwise(last)


def extension(name: Column) -> Column:
    """Lower-cased text after the last dot; a lone leading dot does not count (STR2)."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1))


def name_key(name: Column) -> Column:
    """Key under which two names count as the same (STR3)."""
    return F.lower(name)


def sanitize_folder(name: Column) -> Column:
    """Folder-safe form of free text (STR4)."""
    return trim_unicode(F.translate(name, FOLDER_FORBIDDEN, "_" * len(FOLDER_FORBIDDEN)))


def type_token(ext: Column) -> Column:
    """Upper-cased extension, the value of ``{type}`` in a pattern (STR5)."""
    return F.upper(ext)


# A character no path can contain marks the joint of two paths.
_JOINT = "\u0000"
# The left side and joint before an absolute right side, the joint after an
# empty left side, and the joint after a slash.
_NO_SLASH_NEEDED = "(?s)^[^\u0000]*\u0000(?=/)|^\u0000|(?<=/)\u0000"


def join_path(left: Column, right: Column) -> Column:
    """Path join: an absolute right side wins, an empty left side vanishes (STR7).

    Each side occurs once in the expression, so nested joins stay small.
    """
    joined = F.concat(left, F.lit(_JOINT), right)
    return F.translate(F.regexp_replace(joined, _NO_SLASH_NEEDED, ""), _JOINT, "/")


def parent_folder(path: Column) -> Column:
    """Text before the last slash (STR8).

    Without a slash the result is empty, also for backslash-only paths.  If the
    only slash is the first character, the last backslash is the boundary.
    """
    return F.regexp_extract(path, r"(?s)^(.+(?=/[^/]*$)|/[^/]*(?=\\[^\\/]*$))", 1)


def base_name(path: Column) -> Column:
    """Last component over either kind of separator (STR9)."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


def hash_prefix(digest: Column, length: int = 16) -> Column:
    """First characters of a digest for log lines (STR10)."""
    return F.substring(digest, 1, length)
