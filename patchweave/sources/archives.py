"""Repository archives as rows: one row for each file of a zip, all or nothing for each archive."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_zip(content: bytes | None, max_file: int, max_total: int) -> Iterator[tuple[str | None, str | None, str | None]]:
    """(path, content, error) of the files below the first folder, which is stripped.

    Entries that leave the folder, files over ``max_file`` bytes and archives over ``max_total`` are errors. Sizes are checked while
    reading, so a small archive that unpacks to a large one does not fill memory.
    """
    try:
        archive = zipfile.ZipFile(io.BytesIO(content or b""))
    except zipfile.BadZipFile as bad:
        yield None, None, f"unreadable: {bad}"
        return
    total, prefix = 0, None
    for entry in archive.infolist():
        name = entry.filename.replace("\\", "/")
        prefix = name.split("/", 1)[0] + "/" if prefix is None else prefix
        path = name.removeprefix(prefix)
        if entry.is_dir() or not path:
            continue
        if path.startswith("/") or ".." in path.split("/"):
            yield path, None, "leaves the archive"
            return
        with archive.open(entry) as file:
            raw = file.read(max_file + 1)
        total += len(raw)
        if len(raw) > max_file or total > max_total:
            yield path, None, "file too large" if len(raw) > max_file else "archive too large"
            return
        yield path, raw.decode("utf-8", "replace"), None


def snapshot_files(archives: DataFrame, max_file: int = 256 << 10, max_total: int = 50 << 20) -> DataFrame:
    """(repo, sha, path, content) of the sound archives of (repo, sha, content); an archive with any error gives no rows.

    An archive is read twice, once to judge it and once for its files, so no more than one file is held at a time.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for repo, sha, content in zip(batch["repo"].to_pylist(), batch["sha"].to_pylist(), batch["content"], strict=True):
                error = next((e for _, _, e in explode_zip(content.as_py(), max_file, max_total) if e), None)
                if error:
                    continue
                for path, text, _ in explode_zip(content.as_py(), max_file, max_total):
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (repo, sha, path, text)], names=["repo", "sha", "path", "content"])

    return archives.select("repo", "sha", "content").mapInArrow(scan, "repo string, sha string, path string, content string")


def archive_errors(archives: DataFrame, max_file: int = 256 << 10, max_total: int = 50 << 20) -> DataFrame:
    """(repo, sha, error) of the archives that are rejected."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [next((e for _, _, e in explode_zip(c.as_py(), max_file, max_total) if e), None) for c in batch["content"]]
            yield pa.RecordBatch.from_arrays([batch["repo"], batch["sha"], pa.array(found, pa.string())], names=["repo", "sha", "error"])

    return archives.select("repo", "sha", "content").mapInArrow(scan, "repo string, sha string, error string").where("error IS NOT NULL")


def with_fallback(wanted: DataFrame, archived: DataFrame, lazy: DataFrame) -> DataFrame:
    """Wanted (repo, sha, path) with ``content`` and ``kind``: from the archive, else from single-file reads; null if neither has it."""
    first = archived.select("repo", "sha", "path", F.col("content").alias("a"))
    second = lazy.select("repo", "sha", "path", F.col("content").alias("b"))
    met = wanted.join(first, ["repo", "sha", "path"], "left").join(second, ["repo", "sha", "path"], "left")
    return met.select("repo", "sha", "path", F.coalesce("a", "b").alias("content"), F.when(F.col("a").isNotNull(), "ARCHIVE").when(F.col("b").isNotNull(), "CONTENTS_LAZY").alias("kind"))
