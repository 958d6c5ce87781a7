"""Key derivation on the driver, HMAC and AES-GCM as columns.

Secrets enter plans only as columns of one-row or key tables, never as
literals, so that plans and logs don't show them.
"""

from __future__ import annotations

import base64
import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SealError


def hkdf(secret: bytes, info: bytes, size: int = 32, salt: bytes = b"") -> bytes:
    """RFC 5869 with SHA-256."""
    key = hmac.new(salt or bytes(32), secret, hashlib.sha256).digest()
    out, block, n = b"", b"", 1
    while len(out) < size:
        block = hmac.new(key, block + info + bytes([n]), hashlib.sha256).digest()
        out, n = out + block, n + 1
    return out[:size]


def master_key(text: str) -> bytes:
    """32 bytes from base64 text; longer ones are folded."""
    try:
        raw = base64.b64decode(text, validate=True)
    except ValueError:
        raise SealError("SHRED-CONFIG-001", "the master key is not base64") from None
    if len(raw) < 32:
        raise SealError("SHRED-CONFIG-001", "the master key has fewer than 32 bytes")
    if len(set(raw)) < 8:
        raise SealError("SHRED-CONFIG-001", "the master key looks like a sample")
    return raw if len(raw) == 32 else hkdf(raw, b"sh/master/v1")


def pads(key: bytes) -> tuple[bytes, bytes]:
    """The two padded keys of HMAC-SHA-256."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_hex(ipad: Column, opad: Column, message: Column) -> Column:
    return F.sha2(F.concat(opad, F.unhex(F.sha2(F.concat(ipad, message), 256))), 256)


def part(x: Column) -> Column:
    """|<bytes>:<text>, the unit of all canonical forms; null is |-."""
    return F.when(x.isNull(), F.lit("|-")).otherwise(F.concat(F.lit("|"), F.octet_length(x).cast("string"), F.lit(":"), x))


def seal_bytes(plain: Column, key: Column, aad: Column) -> Column:
    """Nonce, ciphertext and tag."""
    return F.aes_encrypt(plain, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad)


def open_bytes(sealed: Column, key: Column, aad: Column) -> Column:
    """Null if the key or any bound text is wrong."""
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), aad)
