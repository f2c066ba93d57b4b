"""Project keys: one 32-byte master key per project, one derived sub-key per purpose.

The caller takes the master key from a secret store. Only sub-keys are ever placed
in a plan (as HMAC pads or AES literals); the master key stays on the driver.
"""

from __future__ import annotations

import hashlib
import hmac
import string
from dataclasses import dataclass, field

# Purposes a sub-key can be derived for.
PURPOSES = (
    "tokenization",
    "id_hash",
    "date_shift",
    "time_shift",
    "numeric_synthesis",
    "mapping_encryption",
    "artifact_encryption",
)

_HKDF_SALT = b"veilspark:v1"
# Characters that are safe in a folder name, the first of them alphanumeric.
_NAME_CHARS = frozenset(string.ascii_letters + string.digits + "_.-")
_LONGEST_NAME = 128

# Binary literals a plan can carry; give this to spark.sql.redaction.string.regex so
# that explain output and the event log hide them.
PLAN_REDACTION_REGEX = r"(?i)(0x|X')[0-9A-F]{64,}'?|\[B@[0-9a-f]+"


def validate_identifier(value: str, field_name: str) -> str:
    """The value, if it can name a partition folder as it is."""
    if not isinstance(value, str) or not 0 < len(value) <= _LONGEST_NAME:
        raise ValueError(f"{field_name}: a text of 1 to {_LONGEST_NAME} characters is needed")
    odd = sorted(set(value) - _NAME_CHARS)
    if odd or value[0] in "_.-":
        raise ValueError(f"{field_name} cannot name a folder: {odd or value[0]}")
    return value


@dataclass(frozen=True)
class ProjectKey:
    project_id: str
    master_key: bytes = field(repr=False)

    def __post_init__(self) -> None:
        validate_identifier(self.project_id, "project_id")
        if len(self.master_key) < 32:
            raise ValueError("master_key must contain at least 32 bytes")

    @property
    def key_id(self) -> str:
        return hashlib.sha256(self.master_key).hexdigest()[:16]

    def sub_key(self, purpose: str) -> bytes:
        """HKDF-SHA256 (RFC 5869) with one 32-byte output block."""
        if purpose not in PURPOSES:
            raise ValueError(f"unknown key purpose: {purpose}")
        extracted = hmac.new(_HKDF_SALT, self.master_key, hashlib.sha256).digest()
        return hmac.new(extracted, purpose.encode("ascii") + b"\x01", hashlib.sha256).digest()

    def pads(self, purpose: str) -> tuple[bytes, bytes]:
        """The (inner, outer) HMAC pads of a purpose, so that executors only hash."""
        block = self.sub_key(purpose).ljust(64, b"\0")
        return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
