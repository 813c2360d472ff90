"""Files as tables: scans of folders, and extraction of their bytes to blocks."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import map_rows
from ..operators.chunker import BLOCK
from .formats import SUPPORTED, extract, title_of

BINARY = "path string, modificationTime timestamp, length long, content binary"
EXTRACTED = f"title string, blocks array<{BLOCK}>, file_type string, warnings array<string>, pages int, needs_ocr boolean, error string"
_SKIP = r"(?:^|/)(?:~\$[^/]*|\.[^/]*|Thumbs\.db|desktop\.ini|node_modules)(?:/|$)"
_KINDS = "(?i)(?:" + "|".join(s.replace(".", r"\.") for s in SUPPORTED) + ")$"


def safe_key(name: str) -> str:
    """A source's key: forward slashes, without empty, . and .. parts, up to 400 characters."""
    return "/".join(p for p in name.replace("\\", "/").split("/") if p not in ("", ".", ".."))[-400:]


def inside(root: str, path: str) -> str:
    """path, if it lies in root; both are resolved by their text, so that no link is followed."""
    base, full = PurePosixPath(root), PurePosixPath(root, path)
    if ".." in full.parts or not full.is_relative_to(base):
        raise PermissionError(f"{path} is outside the import root")
    return str(full)


def named(files: DataFrame, root: str) -> DataFrame:
    """Supported files (of the binaryFile source) with their source_key, which is relative to the root, and filename."""
    base = PurePosixPath(root.split("://")[-1]).name
    relative = F.regexp_replace(F.regexp_extract("path", rf"/{F_quote(base)}/(.*)$", 1), "%20", " ")
    keyed = files.withColumn("source_key", F.when(relative == "", F.lit(base)).otherwise(F.concat(F.lit(f"{base}/"), relative)))
    return keyed.where(F.col("source_key").rlike(_KINDS) & ~F.col("source_key").rlike(_SKIP)).withColumn("filename", F.element_at(F.split("source_key", "/"), -1))


def F_quote(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All supported files below a path, hidden and temporary ones left out."""
    return named(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path), path)


def extracted(files: DataFrame) -> DataFrame:
    """files (filename, content) with title, blocks, file_type, warnings, pages, needs_ocr; what cannot be read has an error instead of blocks."""

    def one(name: str | None, content: bytes | None) -> dict:
        try:
            return extract(content or b"", name)
        except MemoryError:  # of the machine, not of the file
            raise
        except Exception as e:  # one bad file is a row, not a failed job
            known = name is not None and name.lower().endswith(SUPPORTED)
            return {"title": title_of(name) if known else None, "file_type": name.rpartition(".")[2].lower() if known else None, "error": str(e)[:500] or type(e).__name__, "needs_ocr": False}

    return map_rows(files, ["filename", "content"], lambda rows: [one(r["filename"], r["content"]) for r in rows], EXTRACTED, [c for c in files.columns if c != "content"])
