"""TeX projects from files and archives, as rows of text files."""

from __future__ import annotations

import io
import posixpath
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings


def safe_path(name: str) -> str:
    """The name as a path below the project's root; raises where it would leave it."""
    path = posixpath.normpath(name.replace("\\", "/"))
    if path.startswith(("/", "../")) or path in ("..", "."):
        raise ValueError(f"unsafe path in archive: {name}")
    return path


def unpack(name: str, content: bytes, most: int = DEFAULT.archive_bytes) -> list[tuple[str, bytes]]:
    """Files of an archive (or the single file), without folders, links and resource forks; at most ``most`` bytes unpacked."""
    low = name.lower()
    if low.endswith(".tex"):
        return [("main.tex", content)]
    found, total = [], 0
    if low.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            members = [(i.filename, i.file_size, lambda i=i: z.read(i)) for i in z.infolist() if not i.is_dir() and not i.filename.startswith("__MACOSX/")]
            for path, size, read in members:
                total += size
                if total > most:
                    raise ValueError("archive too large")
                found.append((safe_path(path), read()))
        return found
    if low.endswith((".tar", ".tgz", ".tar.gz", ".tar.xz", ".tar.bz2")):
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            for member in t:
                if member.isfile():
                    total += member.size
                    if total > most:
                        raise ValueError("archive too large")
                    found.append((safe_path(member.name), t.extractfile(member).read()))
        return found
    raise ValueError(f"not a TeX source: {name}")


def expand(files: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``path, content`` (binary) -> ``project, path, content`` (text), ``error`` for sources that can't be unpacked."""
    most = settings.archive_bytes

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                try:
                    rows = [(name, p, c.decode("utf-8", "replace"), None) for p, c in unpack(name, content, most)]
                except (ValueError, OSError, zipfile.BadZipFile, tarfile.TarError, EOFError) as e:
                    rows = [(name, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["project", "path", "content", "error"])

    return files.select("path", "content").mapInPandas(run, "project string, path string, content string, error string")


def read_projects(spark: SparkSession, folder: str) -> DataFrame:
    """TeX sources and archives below a folder, as rows of their files."""
    return expand(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.lower("path").rlike(r"\.(tex|zip|tar|tgz|gz|xz|bz2)$")))
