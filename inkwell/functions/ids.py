"""Stable identities as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Namespace of the name-based ids (fixed value).
NAMESPACE = "b3c1e7a25d4f4e8a9c217f0d3a6b9e14"


def uuid5(name: str | Column, namespace: str = NAMESPACE) -> Column:
    """Version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(col(name), "UTF-8")))
    variant = F.lower(F.conv(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8).cast("string"), 10, 16))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def hmac_sha256(key: bytes, message: str | Column) -> Column:
    """Hex HMAC-SHA256 of a column under one key of up to 64 bytes, with the pads as literals."""
    if len(key) > 64:
        raise ValueError("the key has more than 64 bytes")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key.ljust(64, b"\0")).hex())) for pad in (0x36, 0x5C))
    digest = F.sha2(F.concat(inner, F.encode(col(message), "UTF-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(digest)), 256)


def document_id(key: bytes, space: str | Column, source_key: str | Column) -> Column:
    """Id of a source in a space; keys of sources compare in lower case and with forward slashes."""
    source = F.lower(F.replace(col(source_key), F.lit("\\"), F.lit("/")))
    return uuid5(hmac_sha256(key, F.concat(F.lit("doc:"), col(space), F.lit(":"), source)))


def chunk_id(doc_id: str | Column, index: str | Column, sha: str | Column) -> Column:
    return uuid5(F.concat_ws(":", col(doc_id), col(index).cast("string"), col(sha)))


def chunker_config(version: str, target: int, overlap: float, merge: int) -> str:
    return f"{version}/t{target}/o{int(overlap * 100 + 0.5)}/m{merge}"


def model_key(model: str) -> str:
    return re.sub(r"[^a-zA-Z0-9_-]+", "_", re.sub(r":latest$", "", model)).lower()
