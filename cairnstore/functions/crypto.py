"""Encryption of chunks. Each chunk is sealed by itself with AES-GCM, so any chunk is read alone and a changed one is
noticed; the key comes from a passphrase by scrypt on the driver and is checked by an HMAC record."""

from __future__ import annotations

import hashlib
import hmac
import os
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cost, block size, lanes and salt bytes of the key derivation.
SCRYPT = {"n": 1 << 12, "r": 8, "p": 4}
SALT = 20
PROBE = b"cairnstore key check"


class WrongPassphrase(ValueError):
    pass


@dataclass(frozen=True)
class KeyRecord:
    """What is stored: no key, no passphrase."""

    salt: str
    check: str
    bits: int = 128


def derive(passphrase: str, salt: bytes, bits: int = 128) -> bytes:
    return hashlib.scrypt(passphrase.encode(), salt=salt, dklen=bits // 8, maxmem=1 << 26, **SCRYPT)


def new_key(passphrase: str, bits: int = 128) -> tuple[bytes, KeyRecord]:
    if bits not in (128, 192, 256):
        raise ValueError("a key has 128, 192 or 256 bits")
    salt = os.urandom(SALT)
    key = derive(passphrase, salt, bits)
    return key, KeyRecord(salt.hex(), hmac.new(key, PROBE, hashlib.sha256).hexdigest(), bits)


def open_key(passphrase: str, record: KeyRecord) -> bytes:
    key = derive(passphrase, bytes.fromhex(record.salt), record.bits)
    if not hmac.compare_digest(hmac.new(key, PROBE, hashlib.sha256).hexdigest(), record.check):
        raise WrongPassphrase("the passphrase doesn't fit this repository")
    return key


def seal(data: Column, key: bytes) -> Column:
    return F.aes_encrypt(data, F.lit(bytearray(key)), F.lit("GCM"))


def unseal(data: Column, key: bytes) -> Column:
    """Null where the data was changed or the key is another."""
    return F.try_aes_decrypt(data, F.lit(bytearray(key)), F.lit("GCM"))


def unsealed_range(data: Column, key: bytes, start: Column, length: Column) -> Column:
    """Bytes start to start + length of the plain text."""
    return F.substring(unseal(data, key), start + 1, length)
