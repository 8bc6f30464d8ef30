"""The five binary layouts of timeline records: encoders and strict decoders as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.scalars import big_endian, little_endian

# fixed values: fields in their order with their bytes; u64 are little-endian; (name, fields) is an optional group behind a presence byte
U64, ID, SCOPE = 8, 32, 128
OBSERVATION = (("observation_scope", SCOPE), ("authority", ID), ("epoch", U64), ("sequence", U64), ("observed_step", U64), ("observation_digest", ID))
HEAD = (("scope", SCOPE), ("branch", U64), ("step", U64), ("revision", U64), ("finalized", (("finalized_step", U64),)), ("observed", OBSERVATION))
LAYOUTS = {
    "checkpoint": (1, (*HEAD, ("last_branch", U64))),
    "input": (2, (("scope", SCOPE), ("branch", U64), ("step", U64), ("input_id", ID), ("revision", U64), ("digest", ID))),
    "anchor": (3, (("scope", SCOPE), ("branch", U64), ("step", U64), ("snapshot_id", ID), ("digest", ID))),
    "fork": (4, (*HEAD, ("new_branch", U64), ("anchor_scope", SCOPE), ("anchor_branch", U64), ("anchor_step", U64), ("snapshot_id", ID), ("state_digest", ID),
                 ("replaced", (("input_scope", SCOPE), ("input_branch", U64), ("input_step", U64), ("input_id", ID), ("input_revision", U64), ("input_digest", ID))))),
    "intent": (5, (("scope", SCOPE), ("branch", U64), ("step", U64), ("revision", U64), ("effect_id", ID), ("digest", ID), ("charge", U64))),
}
TAG_BYTES = 20


def _put(fields: tuple, values: dict[str, Column]) -> Column:
    parts = []
    for name, kind in fields:
        if isinstance(kind, tuple):
            there = values.get(name, F.lit(False))
            body = F.when(there, F.concat(F.lit(b"\x01"), _put(kind, values))) if kind[0][0] in values else F.lit(None).cast("binary")
            parts.append(F.coalesce(body, F.lit(b"\x00")))
        else:
            parts.append(little_endian(values[name]) if kind == U64 else values[name])
    return F.concat(*parts)


def encode(tag: bytes, layout: str, values: dict[str, Column]) -> Column:
    """The bytes of a record: tag, variant, fields. Numbers are below 2**63, ids, digests and scopes binary of their sizes; a group is there where its own column is true."""
    variant, fields = LAYOUTS[layout]
    return F.concat(F.lit(tag), big_endian(F.lit(variant), 1), _put(fields, values))


def _size(fields: tuple) -> int:
    return sum(kind for _, kind in fields)


def decode(data: Column, tag: bytes, layout: str) -> tuple[Column, dict[str, Column]]:
    """(code, fields) of a record: UnknownTag, UnknownVariant, InvalidFlag or InvalidLength (no byte may trail or be missing), or null; the fields are null where there is a code.

    Only the structure is checked: what it refers to is the reader's to check.
    """
    variant, fields = LAYOUTS[layout]
    at: Column = F.lit(len(tag) + 2)
    flags, found = F.lit(False), {}

    def number(start: Column) -> Column:
        h = F.hex(F.substr(data, start, F.lit(U64)))
        turned = F.concat(*[F.substr(h, F.lit(i), F.lit(2)) for i in range(15, 0, -2)])
        return F.when(F.length(h) == 16, F.conv(turned, 16, 10).cast("decimal(20,0)"))

    def take(name: str, kind: int, start: Column, there: Column) -> None:
        value = number(start) if kind == U64 else F.substr(data, start, F.lit(kind))
        found[name] = F.when(there, value)

    for name, kind in fields:
        if isinstance(kind, tuple):
            flag = F.hex(F.substr(data, at, F.lit(1)))
            flags = flags | ~flag.isin("00", "01")
            there, inner = flag == "01", at + 1
            found[name] = there
            for own, size in kind:
                take(own, size, inner, there)
                inner = inner + size
            at = at + 1 + F.when(there, _size(kind)).otherwise(0)
        else:
            take(name, kind, at, F.lit(True))
            at = at + kind
    code = (
        F.when(F.substr(data, F.lit(1), F.lit(len(tag))) != F.lit(tag), "UnknownTag").when(F.hex(F.substr(data, F.lit(len(tag) + 1), F.lit(1))) != f"{variant:02X}", "UnknownVariant")
        .when(F.octet_length(data) + 1 < at, "InvalidLength").when(flags, "InvalidFlag").when(F.octet_length(data) + 1 != at, "InvalidLength")
    )
    return code, {name: F.when(code.isNull(), value) for name, value in found.items()}
