"""Hash-derived columns: deterministic arms, keys, keyed digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 10_000


def sha(*parts: Column | str) -> Column:
    return F.sha2(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def hex_to_long(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def assignment_bucket(customer_id: Column, seed: Column | str) -> Column:
    """First 32 bits of sha256('seed:customer') modulo 10 000."""
    seed_col = F.lit(seed) if isinstance(seed, str) else seed
    return F.pmod(hex_to_long(F.substring(sha(seed_col, ":", customer_id), 1, 8)), F.lit(BUCKETS))


def assign_arm(customer_id: Column, seed: Column | str, control_pct: float) -> Column:
    cut = F.lit(control_pct * BUCKETS)
    return F.when(assignment_bucket(customer_id, seed) < cut, "control").otherwise("treatment")


def propensity(arm: Column, control_pct: float) -> Column:
    return F.when(arm == "control", F.lit(control_pct)).when(
        arm == "treatment", F.lit(1.0 - control_pct)
    )


def unit_interval(salt: str, *parts: Column) -> Column:
    """Uniform draw in [0, 1) from 52 hash bits, exact as a double."""
    joined = F.concat_ws("|", F.lit(salt), *[p.cast("string") for p in parts])
    return hex_to_long(F.substring(F.sha2(joined, 256), 1, 13)) / F.lit(float(1 << 52))


def idem_key(cycle_id: Column, attempt_seq: Column, action_type: Column, paise: Column) -> Column:
    return F.substring(sha(cycle_id, ":", attempt_seq, ":", action_type, ":", paise), 1, 32)


def jitter_seconds(key: Column, spread: int) -> Column:
    first64 = F.conv(F.substring(sha("jitter:", key), 1, 16), 16, 10).cast("decimal(20,0)")
    return (first64 % F.lit(spread).cast("decimal(20,0)")).cast("long")


def hmac_pads(secret: bytes) -> tuple[str, str]:
    """Hex of the inner and outer key pads (RFC 2104, SHA-256 block of 64 bytes)."""
    import hashlib

    key = hashlib.sha256(secret).digest() if len(secret) > 64 else secret
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_sha256(body: Column, ipad_hex: Column, opad_hex: Column) -> Column:
    """HMAC-SHA256 hex digest built from two native sha2 calls."""
    inner = F.sha2(F.concat(F.unhex(ipad_hex), body.cast("binary")), 256)
    return F.sha2(F.concat(F.unhex(opad_hex), F.unhex(inner)), 256)
