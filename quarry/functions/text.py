"""Column functions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Lower-case Unicode word tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def space_words(text: Column) -> Column:
    """Tokens between white space; none for null."""
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(space_words(text))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(space_words(text), 1, n), " ")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def paragraphs(text: Column, separator: str = "\n") -> Column:
    return F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != "")


def first_paragraph(text: Column, fallback: int = 500) -> Column:
    """Text before the first blank line, else the first ``fallback`` characters."""
    parts = F.split(text, "\n\n")
    return F.when(F.size(parts) > 1, F.trim(parts[0])).otherwise(F.substring(text, 1, fallback))


def first_sentence(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)^(.*?[.!?])(\s|$)", 1)


def between_braces(text: Column) -> Column:
    """From the first ``{`` to the last ``}``."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def code_block(text: Column) -> Column:
    """The first fenced or inline code block, else the whole text."""
    fenced = F.regexp_extract(text, r"(?s)```(?:\w*\n)?(.*?)```", 1)
    inline = F.regexp_extract(text, r"`([^`]+)`", 1)
    return F.btrim(F.when(fenced != "", fenced).when(inline != "", inline).otherwise(text), F.lit(" \t\r\n"))


def without_braces(title: Column) -> Column:
    """``Name (qualifier)`` -> ``Name``."""
    return F.trim(F.regexp_replace(title, r"\s*\([^)]*\)", ""))


def letters_only(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), r"[^a-z0-9 ]", ""))


def file_name(topic: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(topic)), r"[^\w\s-]", ""), r"[\s-]+", "_")


def passage(text: Column, title: Column, mode: str, most: int = 1500) -> Column:
    """What a ranker gets to read: ``full`` (cut), ``first_sentence``, ``first_paragraph`` or ``title_only``."""
    if mode == "title_only":
        return title
    if mode == "first_sentence":
        return first_sentence(text)
    if mode == "first_paragraph":
        parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")
        return F.when(F.size(parts) > 1, parts[0]).otherwise(F.substring(text, 1, 200))
    return F.substring(text, 1, most)


def random_words(key: Column, vocabulary: Column, n: int, seed: int = 42) -> Column:
    """``n`` words of an array, drawn by a seeded hash of the key: a random-text baseline."""
    draw = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", key, i, F.lit(seed))), 1, 8), 16, 10).cast("long")
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.element_at(vocabulary, (draw(i) % F.size(vocabulary)).cast("int") + 1)), " ")
