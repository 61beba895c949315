"""Fernet tokens as SQL expressions.

The format is the public Fernet specification: version byte, 8-byte time, 16-byte IV,
AES-128-CBC ciphertext, HMAC-SHA256. HMAC is written out with ``sha2`` because Spark has
no HMAC function; its two padded keys are prepared on the driver.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from maskwright.functions.spans import let
from maskwright.session import BROADCAST_ROWS

KEY_COLUMNS = ("enc_key", "ipad", "opad")

KEY_SCHEMA = T.StructType(
    [
        T.StructField("key_id", T.StringType(), False),
        T.StructField("enc_key", T.BinaryType(), False),
        T.StructField("ipad", T.BinaryType(), False),
        T.StructField("opad", T.BinaryType(), False),
    ]
)


def ensure_key(key: str | bytes | None = None) -> bytes:
    """Check a urlsafe-base64 key of 32 bytes and return it re-encoded; make one if none is given."""
    if not key:
        return base64.urlsafe_b64encode(os.urandom(32))
    try:
        raw = base64.urlsafe_b64decode(key)
    except Exception as exc:
        raise ValueError("Invalid key: not urlsafe base64") from exc
    if len(raw) != 32:
        raise ValueError(f"Invalid key: {len(raw)} bytes instead of 32")
    return base64.urlsafe_b64encode(raw)


@dataclass(frozen=True)
class KeyRing:
    """A table of key parts by key id; whether it may be broadcast; its key id if there is only one."""

    table: DataFrame
    small: bool
    only: str | None = None


def key_ring(spark: SparkSession, keys: Mapping[str, str | bytes]) -> KeyRing:
    """Keys by id. They travel as data, so that no plan or log shows them."""
    rows = []
    for key_id, key in keys.items():
        if not key:
            raise ValueError(f"key {key_id!r} is empty")
        raw = base64.urlsafe_b64decode(ensure_key(key))
        signing = raw[:16].ljust(64, b"\0")
        rows.append(
            (
                key_id,
                bytearray(raw[16:]),
                bytearray(b ^ 0x36 for b in signing),
                bytearray(b ^ 0x5C for b in signing),
            )
        )
    only = rows[0][0] if len(rows) == 1 else None
    return KeyRing(spark.createDataFrame(rows, KEY_SCHEMA), len(rows) <= BROADCAST_ROWS, only)


def hmac_sha256(message: str, ipad: str = "ipad", opad: str = "opad") -> str:
    return f"unhex(sha2(concat({opad}, unhex(sha2(concat({ipad}, {message}), 256))), 256))"


def derived_iv(context: str, ipad: str = "ipad", opad: str = "opad") -> str:
    """An IV which a retried task makes again, yet differs for every context under a key."""
    return f"substring({hmac_sha256(f'encode({context}, {UTF8})', ipad, opad)}, 1, 16)"


UTF8 = "'UTF-8'"


def encrypt(plain: str, epoch_seconds: str, iv: str, enc_key: str = "enc_key", ipad: str = "ipad", opad: str = "opad") -> str:
    """Fernet token of a string."""
    head = f"unhex('80'), unhex(lpad(hex(CAST({epoch_seconds} AS bigint)), 16, '0'))"
    body = f"aes_encrypt(encode({plain}, {UTF8}), {enc_key}, 'CBC', 'PKCS', {iv})"
    token = f"translate(base64(concat(signed, {hmac_sha256('signed', ipad, opad)})), '+/\\r\\n', '-_')"
    return let("signed", f"concat({head}, {body})", token)


def decrypt(token: str, enc_key: str = "enc_key", ipad: str = "ipad", opad: str = "opad") -> str:
    """Plain string of a token; NULL when the token is malformed, forged or under another key."""
    signed = "substring(raw, 1, octet_length(raw) - 32)"
    genuine = (
        "octet_length(raw) >= 73 AND hex(substring(raw, 1, 1)) = '80'"
        f" AND substring(raw, octet_length(raw) - 31, 32) = {hmac_sha256(signed, ipad, opad)}"
    )
    body = "substring(raw, 10, octet_length(raw) - 41)"
    plain = f"try_validate_utf8(CAST(try_aes_decrypt({body}, {enc_key}, 'CBC', 'PKCS') AS string))"
    raw = f"try_to_binary(translate({token}, '-_', '+/'), 'base64')"
    return let("raw", raw, f"if({genuine}, {plain}, NULL)")
