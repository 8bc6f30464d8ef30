"""Deterministic scalar functions: identifiers, canonical bytes, digests, backoff and jitter."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER_BYTES = 128
RESOURCES = 64


def valid_identifier(x: Column, prefix: str) -> Column:
    """Prefix, then one or more of [A-Za-z0-9_.-], 128 bytes at most."""
    return x.rlike(f"^{prefix}[A-Za-z0-9_.-]+$") & (F.octet_length(x) <= IDENTIFIER_BYTES)


def big_endian(x: Column, width: int) -> Column:
    """An integer as ``width`` big-endian bytes."""
    return F.unhex(F.lpad(F.hex(x.cast("long")), 2 * width, "0"))


def encode_identifier(x: Column) -> Column:
    """Two-byte big-endian length, then the bytes."""
    return F.concat(big_endian(F.octet_length(x), 2), x.cast("binary"))


def scope_bytes(tenant: Column, process: Column, definition: Column, version: Column, digest: Column) -> Column:
    """Canonical bytes of a process scope: four identifiers and a 32-byte digest."""
    return F.concat(*map(encode_identifier, (tenant, process, definition, version)), digest)


def effect_key_bytes(scope: Column, step: Column, attempt: Column, kind: Column, payload: Column) -> Column:
    """Canonical bytes of an effect key: scope, step, attempt, kind code, payload digest; no action id."""
    return F.concat(scope, encode_identifier(step), big_endian(attempt, 4), big_endian(kind, 1), payload)


def definition_bytes(definition: Column, version: Column, steps: Column) -> Column:
    """Canonical bytes of a definition: id, version, number of steps, steps."""
    body = F.aggregate(steps, F.lit("").cast("binary"), lambda a, s: F.concat(a, encode_identifier(s)))
    return F.concat(encode_identifier(definition), encode_identifier(version), big_endian(F.size(steps), 4), body)


def task_fingerprint(tag: bytes, code: Column, schema: Column, effect: Column, mode: Column, attempts: Column, timeout: Column, delay: Column, checkpoint_bytes: Column, budgets: list[Column], cpu: Column, deadline: Column) -> Column:
    """SHA-256 of a task definition's fields after a domain ``tag``."""
    parts = [F.lit(tag), code, big_endian(schema, 4), big_endian(effect, 1), big_endian(mode, 1), big_endian(attempts, 4), big_endian(timeout, 8), big_endian(delay, 8), big_endian(checkpoint_bytes, 4)]
    return F.sha2(F.concat(*parts, *[big_endian(b, 4) for b in budgets], big_endian(cpu, 8), big_endian(deadline, 8)), 256)


def tagged_identity(prefix: str, tag: bytes, *parts: Column) -> Column:
    """``prefix`` and the SHA-256 of a domain ``tag`` and the parts: timer inputs, relays."""
    return F.concat(F.lit(prefix), F.sha2(F.concat(F.lit(tag), *parts), 256))


def valid_resources(x: Column) -> Column:
    """At most 64 resources, none twice."""
    return (F.size(F.array_distinct(x)) == F.size(x)) & (F.size(x) <= RESOURCES)


def backoff_delay(base: int, most: int, ordinal: Column) -> Column:
    """``base`` shifted left by ``ordinal`` in 64 unsigned bits, at most ``most``; bits shifted out are lost, shifts of 64 and more give ``most``."""
    shifted = F.call_function("shiftleft", F.lit(base).cast("long"), ordinal.cast("int"))
    return F.when((ordinal >= 64) | (shifted < 0) | (shifted > most), F.lit(most).cast("long")).otherwise(shifted)


def jitter(seed: Column, ordinal: Column, most: int) -> Column:
    """A deterministic value in [0, most) from the first 8 seed bytes (little-endian) and the ordinal."""

    @F.pandas_udf("long")
    def mixed(seeds: pd.Series, ordinals: pd.Series) -> pd.Series:
        # fixed values of the mixing function
        golden, first, second = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
        with np.errstate(over="ignore"):
            x = np.frombuffer(b"".join(s[:8] for s in seeds), dtype="<u8").copy() if len(seeds) else np.zeros(0, np.uint64)
            x ^= ordinals.to_numpy().astype(np.uint64) * golden
            for shift, factor in ((30, first), (27, second)):
                x = (x ^ (x >> np.uint64(shift))) * factor
            x ^= x >> np.uint64(31)
        return pd.Series((x % np.uint64(most)).astype(np.int64))

    return mixed(seed, ordinal)


def due_at(now: Column, base: int, most: int, ordinal: Column) -> Column:
    """When a retry is due, without jitter."""
    return now + backoff_delay(base, most, ordinal)


def little_endian(x: Column) -> Column:
    """A non-negative integer as 8 little-endian bytes."""
    h = F.lpad(F.hex(x.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)]))


def read_little_endian(data: Column, start: int) -> Column:
    """The integer (below 2**63) in the 8 little-endian bytes of ``data`` from the 1-based ``start``."""
    h = F.hex(F.substring(data, start, 8))
    return F.conv(F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)]), 16, 10).cast("long")


def encode_record(tag: bytes, variant: Column, counters: list[Column]) -> Column:
    """A fixed-width record: tag, variant byte, little-endian counters."""
    return F.concat(F.lit(tag), big_endian(variant, 1), *map(little_endian, counters))


def record_code(data: Column, tag: bytes, n_counters: int) -> Column:
    """Why bytes are no such record (no byte may trail), or null."""
    return F.when(F.substring(data, 1, len(tag)) != F.lit(tag), "UnknownTag").when(F.octet_length(data) != len(tag) + 1 + 8 * n_counters, "InvalidLength")


def digest_numbers(digest: Column) -> Column:
    """A binary digest as the array of its 32 byte values, as JSON has it."""
    h = F.hex(digest)
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))


def wire_json(*fields: Column) -> Column:
    """Compact JSON of the fields in their order, nulls kept."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def parse_envelope(data: Column, schema: str) -> Column:
    """A JSON envelope as a struct; malformed ones give a struct of nulls."""
    return F.from_json(data, schema, {"mode": "PERMISSIVE"})


def blob_code(schema: Column, want_schema: Column, data: Column, want_bytes: Column, want_digest: Column) -> Column:
    """Why a blob isn't the one referred to: schema, then length, then digest; null if it is."""
    return F.when(schema != want_schema, "SchemaMismatch").when(F.octet_length(data) != want_bytes, "LengthMismatch").when(F.sha2(data, 256) != want_digest, "DigestMismatch")


def error_class(error: Column) -> Column:
    """The diagnostic class of a port's error."""
    # fixed values
    classes = {"Unavailable": "Availability", "Cancelled": "Availability", "Conflict": "Conflict", "Unauthorized": "Authorization", "QuotaExceeded": "Invariant", "Invariant": "Invariant", "TimedOut": "Timeout", "Ambiguous": "Ambiguous"}
    return F.element_at(F.create_map(*[F.lit(x) for pair in classes.items() for x in pair]), error)
