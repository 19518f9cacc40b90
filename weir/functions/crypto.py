"""AEAD functions over keysets kept as JSON: AES-GCM by Spark's own expressions."""

from __future__ import annotations

import base64
import json
import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F


def new_keyset(kind: str = "AEAD_AES_GCM_256") -> str:
    """KEYS.NEW_KEYSET, as KEYS.KEYSET_TO_JSON shows it."""
    return rotate_keyset(json.dumps({"primary": None, "keys": []}), kind)


def rotate_keyset(keyset: str, kind: str = "AEAD_AES_GCM_256") -> str:
    """KEYS.ROTATE_KEYSET: a new primary key; the others still decrypt."""
    if kind not in ("AEAD_AES_GCM_256", "DETERMINISTIC_AEAD_AES_SIV_CMAC_256"):
        raise ValueError(f"key type {kind} is not supported")
    return add_key(keyset, secrets.token_bytes(32))


def add_key(keyset: str, raw: bytes) -> str:
    """KEYS.ADD_KEY_FROM_RAW_BYTES; the key becomes the primary one."""
    if len(raw) not in (16, 32):
        raise ValueError("an AES key has 16 or 32 bytes")
    k = json.loads(keyset)
    number = 1 + max((x["id"] for x in k["keys"]), default=0)
    k["keys"].append({"id": number, "key": base64.b64encode(raw).decode()})
    return json.dumps({**k, "primary": number})


def keyset_length(keyset: str) -> int:
    return len(json.loads(keyset)["keys"])


def _keys(keyset: str) -> list[tuple[int, bytes]]:
    """The primary key first."""
    k = json.loads(keyset)
    return sorted(((x["id"], base64.b64decode(x["key"])) for x in k["keys"]), key=lambda x: (x[0] != k["primary"], x[0]))


def encrypt(keyset: str, plain: Column, aad: Column) -> Column:
    """AEAD.ENCRYPT: the key's number, then the nonce, the text and its tag."""
    number, key = _keys(keyset)[0]
    body = F.aes_encrypt(plain.cast("binary"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad.cast("binary"))
    return F.concat(F.lit(number.to_bytes(4, "big")), body)


def decrypt_bytes(keyset: str, cipher: Column, aad: Column) -> Column:
    """AEAD.DECRYPT_BYTES: by the key that the text names."""
    out = F.raise_error(F.lit("AEAD.DECRYPT: no such key")).cast("binary")
    body = F.substring(cipher, F.lit(5), F.octet_length(cipher) - 4)
    for number, key in _keys(keyset):
        own = F.aes_decrypt(body, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), aad.cast("binary"))
        out = F.when(F.substring(cipher, 1, 4) == F.lit(number.to_bytes(4, "big")), own).otherwise(out)
    return out


def decrypt_string(keyset: str, cipher: Column, aad: Column) -> Column:
    return decrypt_bytes(keyset, cipher, aad).cast("string")


def keyset_to_json(keyset: str) -> str:
    """KEYS.KEYSET_TO_JSON: keysets are kept so."""
    return json.dumps(json.loads(keyset), separators=(",", ":"))


def keyset_from_json(text: str) -> str:
    """KEYS.KEYSET_FROM_JSON, an error for what is none."""
    k = json.loads(text)
    if k["primary"] not in {x["id"] for x in k["keys"]}:
        raise ValueError("the primary key is not in the keyset")
    return json.dumps(k)


def deterministic_encrypt(keyset: str, plain: Column, aad: Column) -> Column:
    """DETERMINISTIC_ENCRYPT: the nonce is made of the text, its context and the key, so equal texts have equal ciphers.

    The bytes are this library's own form, not those of another one's AES-SIV.
    """
    number, key = _keys(keyset)[0]
    plain, aad = plain.cast("binary"), aad.cast("binary")
    nonce = F.substring(F.unhex(F.sha2(F.concat(F.lit(key), F.unhex(F.sha2(F.concat(F.lit(key), F.unhex(F.sha2(aad, 256)), plain), 256))), 256)), 1, 12)
    body = F.aes_encrypt(plain, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), nonce, aad)
    return F.concat(F.lit(number.to_bytes(4, "big")), body)


def deterministic_decrypt_bytes(keyset: str, cipher: Column, aad: Column) -> Column:
    """DETERMINISTIC_DECRYPT_BYTES: the nonce stands in the text, as with AEAD.ENCRYPT."""
    return decrypt_bytes(keyset, cipher, aad)


def deterministic_decrypt_string(keyset: str, cipher: Column, aad: Column) -> Column:
    return decrypt_string(keyset, cipher, aad)
