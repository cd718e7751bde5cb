"""String functions with the engine's value semantics; all are Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: a supplementary character counts as two."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def strip_controls(text: Column) -> Column:
    """Without leading and trailing characters up to U+0020."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def is_blank(text: Column) -> Column:
    """True for null, empty and white space only."""
    return F.coalesce(text.rlike(r"^\s*$"), F.lit(True))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """The folder, or an empty string at the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(name: Column) -> Column:
    """After the last dot; empty for names without a dot and for dot files."""
    return F.when(F.instr(F.substring(name, 2, 1 << 30), ".") > 0, F.substring_index(name, ".", -1)).otherwise(F.lit(""))


def simple_name(fqn: Column) -> Column:
    return F.substring_index(fqn, ".", -1)


def package_of(fqn: Column) -> Column:
    return F.regexp_replace(fqn, r"\.?[^.]*$", "")


def decapitalize(name: Column) -> Column:
    return F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30))


def lines_of(text: Column) -> Column:
    """Lines without trailing empty ones."""
    return F.split(F.regexp_replace(text, r"\n+$", ""), "\n")


def extract_lines(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end, from 1, inclusive; clamped to the text, empty if nothing is left."""
    lines = lines_of(text)
    first = F.greatest(start, F.lit(1))
    last = F.least(F.size(lines), F.greatest(first, end))
    return F.when(first > F.size(lines), F.lit("")).otherwise(F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n"))


def bounded(text: Column, max_file_kb: int) -> Column:
    """The text, cut after so many KB of UTF-16 units with a mark. Half a character that the cut leaves counts as a question mark."""
    most = max_file_kb * 1024
    units = F.substring(F.encode(text, "UTF-16BE"), 1, 2 * most)
    split = F.hex(F.substring(units, 2 * most - 1, 1)).between("D8", "DB")
    whole = F.decode(F.when(split, F.substring(units, 1, 2 * most - 2)).otherwise(units), "UTF-16BE")
    cut = F.when(F.length(text) == utf16_length(text), F.substring(text, 1, most)).otherwise(F.concat(whole, F.when(split, "?").otherwise("")))
    return F.when(utf16_length(text) > most, F.concat(cut, F.lit("\n… (truncated)"))).otherwise(text)


def class_header(text: Column, name: Column) -> Column:
    """Package and import lines up to the declaration of ``name``, which is kept."""
    declares = r"^.*\b(class|interface|enum|record|@interface)\s+\w+.*$"
    lines = lines_of(text)
    is_declaration = F.transform(lines, lambda x: x.rlike(declares) & F.contains(x, name))
    at = F.array_position(is_declaration, F.lit(True)).cast("int")
    above = lambda xs: F.filter(xs, lambda x: x.startswith("package ") | x.startswith("import "))
    found = F.concat(above(F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0)))), F.array(F.get(lines, at - 1)))
    return F.array_join(F.when(at > 0, found).otherwise(above(lines)), "\n")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the UTF-16 length, rounded up; 0 for null and empty."""
    return F.coalesce(((utf16_length(text) + 3) / 4).cast("int"), F.lit(0))
