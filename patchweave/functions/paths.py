"""Path classification: category and sensitivity, from the path alone or with a content sample."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from patchweave.config import SENSITIVE_PATTERNS
from patchweave.functions.text import basename

# The extensions, names and markers of each category.
BINARY_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "webp", "ico", "bmp", "pdf", "zip", "tar", "gz", "jar", "war", "class", "exe", "dll", "so", "dylib",
    "woff", "woff2", "ttf", "eot", "mp4", "mp3", "db", "sqlite", "bin", "dat",
)
SOURCE_EXTENSIONS = (
    "java", "kt", "kts", "scala", "groovy", "py", "js", "jsx", "ts", "tsx", "mjs", "cjs", "go", "rs", "c", "h", "cc", "cpp", "cxx", "cs",
    "rb", "php", "swift", "m", "mm", "sql", "sh", "bash", "ps1", "vue",
)
CONFIG_EXTENSIONS = ("yml", "yaml", "xml", "json", "toml", "ini", "properties", "cfg", "conf", "gradle")
DOC_EXTENSIONS = ("md", "markdown", "adoc", "rst", "txt")
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "go.sum", "cargo.lock", "gemfile.lock", "poetry.lock")
CONFIG_NAMES = ("pom.xml", "dockerfile", "makefile", ".gitignore", ".editorconfig")
GENERATED_SUFFIXES = (".min.js", ".min.css", ".pb.go", "_pb2.py", ".designer.cs", ".g.cs")
GENERATED_FOLDERS = ("/generated/", "/gen/")
GENERATED_MARKERS = ("do not edit", "@generated", "auto-generated", "autogenerated", "automatically generated", "generated by")
TEST_FOLDERS = ("src/test/", "/test/", "/tests/")
TEST_SUFFIXES = ("test.java", "tests.java", "it.java", "_test.py", "_test.go")
TEST_INFIXES = (".test.", ".spec.")


def _one_of(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def _extension_of(extensions: tuple[str, ...]) -> str:
    """After the last dot of the base name, which is not its first sign."""
    return rf"[^/]\.{_one_of(extensions)}\z"


def _name_of(names: tuple[str, ...]) -> str:
    return rf"(?:^|/){_one_of(names)}\z"


# One pattern a category, so that a path is looked at once for each, also where it is a long expression.
_GENERATED = "|".join((_name_of(LOCK_FILES), rf"{_one_of(GENERATED_SUFFIXES)}\z", _one_of(GENERATED_FOLDERS)))
_TEST = "|".join((_one_of(TEST_FOLDERS), rf"{_one_of(TEST_SUFFIXES)}\z", r"(?:^|/)test_[^/]*\z", rf"{_one_of(TEST_INFIXES)}[^/]*\z"))


def category(path: Column, sample: Column | None = None) -> Column:
    """BINARY, GENERATED, TEST, DOCUMENTATION, CONFIG, SOURCE or OTHER: the first that fits; OTHER for null."""
    lower = F.lower(path)
    generated = lower.rlike(_GENERATED)
    if sample is not None:
        generated = generated | F.lower(F.coalesce(sample, F.lit(""))).rlike(_one_of(GENERATED_MARKERS))
    return (
        F.when(lower.rlike(_extension_of(BINARY_EXTENSIONS)), "BINARY")
        .when(generated, "GENERATED")
        .when(lower.rlike(_TEST), "TEST")
        .when(lower.rlike(_extension_of(DOC_EXTENSIONS)), "DOCUMENTATION")
        .when(lower.rlike(f"{_extension_of(CONFIG_EXTENSIONS)}|{_name_of(CONFIG_NAMES)}"), "CONFIG")
        .when(lower.rlike(_extension_of(SOURCE_EXTENSIONS)), "SOURCE")
        .otherwise("OTHER")
    )


def glob_regex(patterns: tuple[str, ...]) -> str:
    """One expression for all globs on a base name: ``*`` and ``?`` do not cross a slash."""
    parts = ("".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in p) for p in patterns)
    return "^(?:" + "|".join(parts) + ")$"


def is_sensitive(path: Column, patterns: tuple[str, ...] = SENSITIVE_PATTERNS) -> Column:
    """Whether the lower-cased base name fits a pattern; false for null and blank paths."""
    name = F.lower(basename(F.translate(path, "\\", "/")))
    return F.coalesce(name.rlike(glob_regex(patterns)) & ~path.rlike(r"^\s*$"), F.lit(False))


def change_type(status: Column) -> Column:
    """added, removed and renamed; anything else, null included, is a modification."""
    return F.when(status == "added", "ADD").when(status == "removed", "DELETE").when(status == "renamed", "RENAME").otherwise("MODIFY")


def file_stats(change: Column, additions: Column, deletions: Column) -> Column:
    return F.concat(F.lower(change), F.lit(", +"), additions.cast("string"), F.lit("/-"), deletions.cast("string"))
