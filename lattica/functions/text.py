"""Analysis of SQL bodies as column expressions: masking, write targets, presence of names, dynamic SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "'##MASKED##'"
#: ASCII word borders; what the JDK takes for \b is not relied on.
_LEFT, _RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
# Verbs that write, with the name after them.
_NAME = r"([A-Za-z0-9_.]+)"
WRITES = tuple(rf"(?i){_LEFT}{verb}\s+{_NAME}" for verb in (r"insert\s+into", "update", r"delete\s+from", r"merge\s+into", "merge", r"truncate\s+table", r"replace\s+into"))
_QUOTES = {"mssql": r'[\[\]"]', "sqlite": r'[\[\]"`]', "mysql": r'[\[\]"`]', "pg": '"'}


def canonical(text: Column, dialect: str = "mssql") -> Column:
    """Quotes of the dialect removed, lower-cased."""
    return F.lower(F.regexp_replace(text, _QUOTES[dialect], ""))


def mask_strings(body: Column) -> Column:
    """String literals, doubled quotes inside them included, become one fixed literal."""
    return F.regexp_replace(body, r"'[^']*(?:''[^']*)*'", MASK)


def strip_comments(body: Column) -> Column:
    """Block and line comments become a blank; on masked text only."""
    return F.regexp_replace(F.regexp_replace(body, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")


def mask_in_place(body: Column) -> Column:
    """Literals masked at their length, so that offsets stay: between quotes, all but quotes becomes x.

    Splitting at quotes, every second part lies inside a literal; a doubled quote ends one and starts the next.
    """
    parts = F.split(body, "'", -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.regexp_replace(p, r"(?s).", "x")).otherwise(p)), "'")


def action_part(body: Column) -> Column:
    """From the first BEGIN to the last END of a trigger, literals left out of the search; null without both."""
    shape = mask_in_place(body)
    found = F.regexp_instr(shape, F.lit(rf"(?i){_LEFT}begin{_RIGHT}"))
    block = F.regexp_substr(shape, F.lit(rf"(?is){_LEFT}begin{_RIGHT}.*{_LEFT}end{_RIGHT}"))
    return F.when(block.isNotNull(), F.substring(body, found, F.length(block)))


def write_targets(body: Column) -> Column:
    """Distinct names after a verb that writes, sorted; body is canonical already."""
    found = [F.regexp_extract_all(body, F.lit(p), F.lit(1)) for p in WRITES]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found))))


def _quoted(name: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def simple_name(qname: Column) -> Column:
    """All but the first segment, or the whole if there is only one."""
    return F.regexp_replace(qname, r"^[^.]*\.", "")


def mentions(masked: Column, qname: Column) -> Column:
    """The name, qualified or not, stands in the body as a word."""
    low = F.lower(masked)
    word = lambda n: F.concat(F.lit(_LEFT), _quoted(n), F.lit(_RIGHT))
    return F.regexp_like(low, word(qname)) | F.regexp_like(low, word(simple_name(qname)))


def access(qname: Column, targets: Column) -> Column:
    return F.when(F.array_contains(targets, qname) | F.array_contains(targets, simple_name(qname)), F.lit("write")).otherwise(F.lit("read"))


def dynamic_sql(body: Column, dialect: str) -> Column:
    """The body builds SQL at run time."""
    if dialect == "mssql":
        return body.rlike(rf"(?i){_LEFT}sp_executesql{_RIGHT}") | body.rlike(rf"(?i){_LEFT}exec(?:ute)?\s*[(@]")
    if dialect == "pg":
        return F.regexp_replace(body, rf"(?i){_LEFT}execute\s+(?:function|procedure){_RIGHT}", "").rlike(rf"(?i){_LEFT}execute{_RIGHT}")
    if dialect == "mysql":
        return body.rlike(rf"(?i){_LEFT}(?:prepare|execute){_RIGHT}")
    return F.lit(False)


def local_name(qname: Column) -> Column:
    return F.substring_index(qname, ".", -1)


def normalized_body(body: Column) -> Column:
    """LF line ends, no blanks at line ends, and without one final line end."""
    lines = F.split(F.replace(body, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    blank = r"[\s\x{FEFF}\p{Zs}\x{2028}\x{2029}]+$"
    trimmed = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, blank, "")), "\n")
    return F.regexp_replace(trimmed, r"\n\z", "")


def ddl_identifiers(ddl: Column) -> Column:
    """Distinct names that DDL statements touch, sorted: altered tables, added and dropped columns, indexes and their tables."""
    text = F.lower(F.regexp_replace(F.regexp_replace(ddl, r"\[([^\]]*)\]", "$1"), '"([^"]*)"', "$1"))
    name = r"([A-Za-z0-9_.]+)"
    patterns: Sequence[tuple[str, Sequence[int]]] = (
        (rf"{_LEFT}alter\s+table\s+{name}", (1,)),
        (rf"{_LEFT}add\s+column\s+{name}", (1,)),
        (rf"{_LEFT}drop\s+column\s+{name}", (1,)),
        (rf"{_LEFT}create\s+(?:unique\s+)?index\s+{name}\s+on\s+{name}", (1, 2)),
        (rf"{_LEFT}drop\s+index\s+{name}\s+on\s+{name}", (1, 2)),
        (rf"{_LEFT}drop\s+index\s+([A-Za-z0-9_]+\.[A-Za-z0-9_]+)(?!\s+on{_RIGHT})", (1,)),
    )
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, groups in patterns for g in groups]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found))))
