"""Where results go: tables and encrypted files."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vault_key(password: str, salt: bytes, rounds: int = 100_000) -> bytes:
    """A 256-bit key from a password (PBKDF2 with SHA-512)."""
    return hashlib.pbkdf2_hmac("sha512", password.encode(), salt, rounds, 32)


def lock(rows: DataFrame, column: str, key: bytes) -> DataFrame:
    return rows.withColumn(column, F.aes_encrypt(F.col(column).cast("binary"), F.lit(key), F.lit("GCM")))


def unlock(rows: DataFrame, column: str, key: bytes) -> DataFrame:
    return rows.withColumn(column, F.aes_decrypt(F.col(column), F.lit(key), F.lit("GCM")))


def encrypt_text(rows: DataFrame, column: str, key: bytes) -> DataFrame:
    """Base64 of the AES-CBC cipher text."""
    return rows.withColumn(column, F.base64(F.aes_encrypt(F.col(column).cast("binary"), F.lit(key), F.lit("CBC"))))


def decrypt_text(rows: DataFrame, column: str, key: bytes) -> DataFrame:
    return rows.withColumn(column, F.decode(F.aes_decrypt(F.unbase64(F.col(column)), F.lit(key), F.lit("CBC")), "UTF-8"))


def append_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("append").parquet(path)


def replace_table(rows: DataFrame, path: str) -> None:
    """Overwrites a table with rows that don't read from it."""
    rows.write.mode("overwrite").parquet(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """A one-column export as text files."""
    lines.write.mode("overwrite").text(path)
