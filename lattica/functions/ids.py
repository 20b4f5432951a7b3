"""Identifiers as column expressions: the same input gives the same id on every engine."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What node_id() and edge_id() give.
SHA1 = r"\A[0-9a-f]{40}\z"


def _bare(segment: Column) -> Column:
    """Without one pair of outer brackets or double quotes, lower-cased."""
    return F.lower(F.regexp_replace(segment, r'^(?:\[(.*)\]|"(.*)")$', "$1$2"))


def canonical_qname(schema: Column, name: Column) -> Column:
    return F.when(schema.isNull(), _bare(name)).otherwise(F.concat(_bare(schema), F.lit("."), _bare(name)))


def node_id(kind: Column, qname: Column) -> Column:
    return F.sha1(F.concat(kind, F.lit(" "), F.lower(qname)))


def edge_id(kind: Column, src: Column, dst: Column, discriminator: Column | None = None) -> Column:
    """The blank before the discriminator stays when that is empty."""
    return F.sha1(F.concat(kind, F.lit(" "), src, F.lit(" "), dst, F.lit(" "), F.lit("") if discriminator is None else F.coalesce(discriminator, F.lit(""))))


def packed(id_: str) -> Column:
    """A hash in half its bytes; other ids are made longer than those, so that different ones stay different."""
    return F.when(F.col(id_).rlike(SHA1), F.unhex(id_)).otherwise(F.concat(F.encode(F.col(id_), "UTF-8"), F.lit(bytes(21))))


def stable_text(text: Column) -> Column:
    """The JSON document in text, compact and with sorted keys at every depth; null where there is none. What follows it is ignored."""
    return F.to_json(F.try_parse_json(text))


def stable_json(value: Any) -> str:
    """Compact JSON with sorted keys at every depth; lists keep their order."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
