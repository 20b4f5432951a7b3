"""Naming conventions and type families, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type tokens and their families; any other token is a family of its own.
FAMILIES = {
    "int": "int", "integer": "int", "bigint": "int", "smallint": "int", "serial": "int", "bigserial": "int",
    "objectid": "oid", "_id": "oid",
    "uuid": "uuid",
    "varchar": "str", "text": "str", "char": "str", "nvarchar": "str", "string": "str",
}


def entity(name: Column) -> Column:
    """struct(entity, conv) that a column's name points to, else null: <e>_id, <e>Id or <e>ID, id_<e>; the first that fits decides."""
    low = F.lower(name)

    def found(part: Column, conv: float) -> Column:
        return F.when(part != "", F.struct(part.alias("entity"), F.lit(conv).alias("conv")))

    return (
        F.when(low.endswith("_id"), found(F.regexp_extract(low, r"(?s)^(.*)_id$", 1), 1.0))
        .when(name.rlike(r"(?:Id|ID)$"), found(F.regexp_extract(low, r"(?s)^(.*)id$", 1), 1.0))
        .when(low.startswith("id_"), found(F.regexp_extract(low, r"(?s)^id_(.*)$", 1), 0.8))
    )


def candidate_names(e: Column) -> Column:
    """Names that a table of the entity may have: as it is, plurals, and the singular of a plural."""
    n = F.length(e)
    cut = lambda k: F.substring(e, F.lit(1), n - k)
    singular = F.when(e.endswith("ies") & (n > 3), F.concat(cut(3), F.lit("y"))).when(~e.endswith("ies") & e.endswith("es") & (n > 2), cut(2)).when(~e.endswith("es") & e.endswith("s") & (n > 1), cut(1))
    # "ies" and "es" alone are too short for their own rule and fall through to the next.
    singular = F.coalesce(singular, F.when(e == "ies", F.lit("i")).when(e == "es", F.lit("e")))
    names = F.array(e, F.concat(e, F.lit("s")), F.concat(e, F.lit("es")), F.when(e.endswith("y"), F.concat(cut(1), F.lit("ies"))), singular)
    return F.array_distinct(F.filter(names, lambda x: x.isNotNull()))


def type_family(data_type: Column) -> Column:
    low = F.lower(data_type)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv]), low), low)
