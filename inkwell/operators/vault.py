"""Real names at rest: AES-256-GCM with a key from a file or a passphrase."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col


def new_key() -> bytes:
    return os.urandom(32)


def passphrase_key(passphrase: str, salt: bytes) -> bytes:
    return hashlib.scrypt(passphrase.encode(), salt=salt, n=1 << 14, r=8, p=1, dklen=32)


def encrypt(c: str | Column, key: bytes) -> Column:
    """struct<iv, tag, ciphertext>, each in hex, with a fresh 12-byte iv."""
    sealed = F.hex(F.aes_encrypt(col(c), F.lit(key), F.lit("GCM")))
    n = F.length(sealed)
    return F.struct(F.lower(F.substring(sealed, 1, 24)).alias("iv"), F.lower(F.substring(sealed, n - 31, F.lit(32))).alias("tag"), F.lower(F.substring(sealed, F.lit(25), n - 56)).alias("ciphertext"))


def decrypt(iv: str | Column, tag: str | Column, ciphertext: str | Column, key: bytes) -> Column:
    sealed = F.unhex(F.concat(col(iv), col(ciphertext), col(tag)))
    return F.aes_decrypt(sealed, F.lit(key), F.lit("GCM")).cast("string")


def store(entities: DataFrame, key: bytes) -> DataFrame:
    """entity_id, iv, tag, ciphertext of the canonical names; write it once, the iv is drawn on every evaluation."""
    return entities.select(F.col("id").alias("entity_id"), encrypt("canonical", key).alias("s")).select("entity_id", "s.*")


def reveal(vault: DataFrame, key: bytes, ids: list[int]) -> dict[int, str]:
    rows = vault.where(F.col("entity_id").isin(ids)).select("entity_id", decrypt("iv", "tag", "ciphertext", key).alias("name"))
    return {r.entity_id: r["name"] for r in rows.collect()}
