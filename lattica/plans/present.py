"""Plain-text answers. Formatters take small collected results and only lay them out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

DYNAMIC = "[DYNAMIC SQL]"
RULE, WIDEST = "─", 60
DETAILS = ("brief", "normal", "full")
_TRUNCATED = "  ⚠  Result truncated at depth limit — full impact may be larger"
_INCOMPLETE = "  ⚠  Impact possibly incomplete — chain contains dynamic SQL"

Row = Mapping[str, Any]


@dataclass
class Near:
    """A neighbour: the node's row, and the edge's."""

    node: Row
    edge: Row = field(default_factory=dict)


#: edge kind -> direction (out, in) -> neighbours
Groups = dict[str, dict[str, list[Near]]]


def locale_key(name: str) -> tuple[str, str]:
    """Order of names as readers expect it: underscore before dot, letters without regard to case first."""
    rank = {"_": "\x01", "-": "\x02", ".": "\x03"}
    return "".join(rank.get(c, c.lower()) for c in name), name.swapcase()


def _text(lines: Iterable[str]) -> str:
    return "\n".join([*lines, ""]) + "\n"


def _rule(n: int) -> str:
    return RULE * min(WIDEST, n)


def _value(row: Row, name: str) -> Any:
    payload = row.get("payload")
    return payload.get(name) if payload else None


def _sections(*parts: Sequence[str]) -> list[str]:
    return [line for part in parts if part for line in ("", *part)]


def _once(entries: Iterable[Near]) -> list[Near]:
    return list({e.node["qname"]: e for e in reversed(list(entries))}.values())[::-1]


def caveat(node: Row) -> list[str]:
    return [f"{DYNAMIC} impact analysis may be incomplete"] if _value(node, "has_dynamic_sql") else []


def key_columns(constraints: Iterable[Near], references: Sequence[Near]) -> tuple[set[str], dict[str, str]]:
    """Primary-key columns, and of foreign-key columns where they lead.

    That is the constraint's definition if it has one; else the one table that references of the constraint's name lead
    to; else, of a single foreign key, the one table referenced at all.
    """
    constraints = list(constraints)
    pk = {c for e in constraints if _value(e.node, "type") == "PK" for c in _value(e.node, "columns") or ()}
    foreign = [e.node for e in constraints if _value(e.node, "type") == "FK"]
    fk: dict[str, str] = {}
    for node in foreign:
        target = _value(node, "definition")
        if target is None:
            named = [e for e in references if (e.edge.get("attrs") or {}).get("constraint_name") == node["name"]]
            tables = {e.node["qname"] for e in named or (references if len(foreign) == 1 else ())}
            target = tables.pop() if len(tables) == 1 else None
        if target is not None:
            fk |= dict.fromkeys(_value(node, "columns") or (), target)
    return pk, fk


def columns(entries: Iterable[Near], pk: set[str], fk: Mapping[str, str]) -> list[str]:
    out = []
    for e in sorted(entries, key=lambda e: _value(e.node, "ordinal") or 0):
        name, default = e.node["name"], _value(e.node, "default")
        marks = ["[PK]"] * (name in pk) + [f"[FK→{fk.get(name)}]"] * (name in fk) + ["[NN]"] * (_value(e.node, "nullable") is False and name not in pk)
        out.append("  ".join([f"  {name}", _value(e.node, "data_type") or "unknown", *marks, *([f"DEFAULT {default}"] if default is not None else [])]))
    return ["COLUMNS", *out] if out else []


def constraints(entries: Iterable[Near], fk: Mapping[str, str]) -> list[str]:
    out = []
    for e in sorted(entries, key=lambda e: locale_key(e.node["name"])):
        kind, cols = _value(e.node, "type") or "", _value(e.node, "columns") or []
        target = f" → {fk[cols[0]]}" if kind == "FK" and cols and cols[0] in fk else ""
        out.append(f"  [{kind}]  {e.node['name']}  ({', '.join(cols)}{target})")
    return ["CONSTRAINTS", *out] if out else []


def indexes(entries: Iterable[Near]) -> list[str]:
    out = []
    for e in sorted(entries, key=lambda e: locale_key(e.node["name"])):
        method = _value(e.node, "method")
        out.append(f"  {e.node['name']}  {'UNIQUE ' if _value(e.node, 'unique') else ''}({', '.join(_value(e.node, 'columns') or [])})" + (f" [{method}]" if method else ""))
    return ["INDEXES", *out] if out else []


def parameters(node: Row) -> list[str]:
    marks = {"out": ["[OUT]"], "inout": ["[INOUT]"]}
    out = []
    for p in sorted(_value(node, "parameters") or [], key=lambda p: p["ordinal"]):
        out.append("  ".join([f"  {p['name']}", p["data_type"], *marks.get(p["direction"], []), *["[DEFAULT]"] * (p["has_default"] is True)]))
    return ["PARAMETERS", *out] if out else []


def consumed(entries: Iterable[Near]) -> list[str]:
    rows = sorted(entries, key=lambda e: locale_key(e.node["qname"]))
    return [f"consumes: {e.node['qname']}.{c}" for e in rows for c in (e.edge.get("attrs") or {}).get("dst_columns") or ()]


def triggers(entries: Iterable[Near]) -> list[str]:
    rows = sorted(entries, key=lambda e: locale_key(e.node["name"]))
    out = [f"  {e.node['name']}  {_value(e.node, 'timing') or ''} {', '.join(_value(e.node, 'events') or [])}".rstrip() for e in rows]
    return ["TRIGGERS", *out] if out else []


def focus(node: Row) -> list[str]:
    one = [Near(node)]
    by_kind: dict[str, Callable[[], list[str]]] = {
        "column": lambda: columns(one, set(), {}), "field": lambda: columns(one, set(), {}), "constraint": lambda: constraints(one, {}), "index": lambda: indexes(one),
        "trigger": lambda: triggers(one), "procedure": lambda: parameters(node), "function": lambda: parameters(node),
    }
    return by_kind.get(node["kind"], list)()


def _of(groups: Groups, kind: str, direction: str) -> list[Near]:
    return groups.get(kind, {}).get(direction, [])


def _arrows(title: str, out: Sequence[Near], into: Sequence[Near]) -> list[str]:
    lines = ["", f"  {title}"]
    for label, arrow, entries in (("out", "→", out), ("in", "←", into)):
        if entries:
            lines += [f"    {label}:", *(f"      {arrow} {e.node['qname']}  [{e.node['kind']}]" for e in entries)]
    return lines


def _counts(kind: str, out: Sequence[Near], into: Sequence[Near]) -> str:
    return f"  {kind:<22} " + ", ".join([f"{len(out)} out"] * bool(out) + [f"{len(into)} in"] * bool(into))


def explore(node: Row, groups: Groups, detail: str = "normal") -> str:
    lines = [f"{node['qname']}  [{node['kind']}]", _rule(len(node["qname"]) + len(node["kind"]) + 4)]
    if detail != "brief":
        if node["kind"] in ("table", "view"):
            pk, fk = key_columns(_of(groups, "has_constraint", "out"), _of(groups, "references", "out"))
            lines += _sections(columns(_of(groups, "has_column", "out"), pk, fk), constraints(_of(groups, "has_constraint", "out"), fk))
            if detail == "full":
                lines += _sections(indexes(_of(groups, "has_index", "out")), triggers(_of(groups, "fires_on", "in")), consumed(_of(groups, "depends_on", "out")))
        else:
            lines += _sections(focus(node))
        lines += _sections(caveat(node))
    for kind in sorted(groups):
        out, into = _once(_of(groups, kind, "out")), _once(_of(groups, kind, "in"))
        lines += [_counts(kind, out, into)] if detail == "brief" else _arrows(kind, out, into)
    if not groups:
        lines.append("  (no neighbors)")
    if detail == "full":
        lines += ["", "  Details", f"  bodyHash  {node['body_hash'] or '(none)'}", f"  level     {node['level']}"]
    return _text([*lines])


def describe(node: Row, groups: Groups, detail: str = "normal") -> str:
    """One object with its columns, constraints and, in full, indexes, triggers and body."""
    n_index, n_trigger = len(_of(groups, "has_index", "out")), len(_of(groups, "fires_on", "in"))
    notes = [f"{n_index} idx"] * bool(n_index) + [f"{n_trigger} trg!"] * bool(n_trigger)
    lines = [f"{node['qname']}  [{node['kind']}]" + (f"  [{', '.join(notes)}]" if notes else ""), _rule(len(node["qname"]) + len(node["kind"]) + 4)]
    if detail == "brief":
        return _text(lines)
    pk, fk = key_columns(_of(groups, "has_constraint", "out"), _of(groups, "references", "out"))
    lines += _sections(columns(_of(groups, "has_column", "out"), pk, fk), constraints(_of(groups, "has_constraint", "out"), fk), parameters(node), caveat(node))
    if detail == "full":
        lines += _sections(indexes(_of(groups, "has_index", "out")), triggers(_of(groups, "fires_on", "in")), consumed(_of(groups, "depends_on", "out")))
        if node["kind"] in ("procedure", "function", "trigger"):
            body = _value(node, "body")
            if node["level"] != "full":
                lines += ["", "BODY (body omitted — object indexed at metadata level)"]
            else:
                lines += ["", "BODY", body] if body is not None else ["", "BODY (body omitted — not indexed at full level)"]
    return _text(lines)


def related(node: Row, groups: Groups, detail: str = "normal") -> str:
    lines = [f"RELATED: {node['qname']}  [{node['kind']}]", _rule(len(node["qname"]) + len(node["kind"]) + 12)]
    if not groups:
        return _text([*lines, "  (no neighbors)"])
    inferred: list[tuple[str, Near]] = []
    for kind in sorted(groups):
        sure = {}
        for direction in ("out", "in"):
            entries = _of(groups, kind, direction)
            inferred += [(direction, e) for e in entries if e.edge.get("confidence") == "inferred"]
            sure[direction] = _once(e for e in entries if e.edge.get("confidence") != "inferred")
        if not any(sure.values()):
            continue
        if detail == "brief":
            lines.append(_counts(kind, sure["out"], sure["in"]))
        else:
            lines += _arrows(kind, *(sorted(sure[d], key=lambda e: locale_key(e.node["qname"])) for d in ("out", "in")))
    if inferred and detail == "brief":
        lines.append(f"  {'inferred':<22} {len(inferred)} total")
    elif inferred:
        lines += ["", "  inferred  (confidence: inferred)"]
        for direction, e in sorted(inferred, key=lambda x: locale_key(x[1].node["qname"])):
            score = f"  score={e.edge['score']:.2f}" if detail == "full" and e.edge.get("score") is not None else ""
            lines.append(f"      {'→' if direction == 'out' else '←'} {e.node['qname']}  [{e.node['kind']}]{score}")
    return _text(lines)


def impact(node: Row, chains: Sequence[Row], names: Mapping[str, str], truncated: bool, degraded: Sequence[str], detail: str = "normal") -> str:
    """chains has nodes and access, in the order of discovery."""
    by = {a: [c["nodes"] for c in chains if c["access"] == a] for a in ("read", "write")}
    lines = [f"IMPACT: {node['qname']}  [{node['kind']}]", _rule(len(node["qname"]) + len(node["kind"]) + 10)]
    if detail == "brief":
        for access, pad in (("read", "   "), ("write", "  ")):
            n = len(by[access])
            lines.append(f"  {access.upper()} impact:{pad}{n} chain{'s' * (n != 1)}")
        return _text([*lines, *[_TRUNCATED] * truncated, *[_INCOMPLETE] * bool(degraded)])
    for access in ("read", "write"):
        lines += ["", f"{access.upper()} IMPACT", *([f"  {' → '.join(names.get(i, i) for i in c)}" for c in by[access]] or ["  (none)"])]
    lines += _sections([_TRUNCATED] * truncated)
    if degraded:
        lines += ["", _INCOMPLETE, *(f"  {n}  {DYNAMIC}" for n in sorted((names.get(i, i) for i in degraded), key=locale_key))]
    return _text(lines)


def path(start: str, end: str, found: Any, names: Mapping[str, str]) -> str:
    """found: a Path of ids."""
    lines = [f"PATH: {start}  →  {end}", _rule(len(start) + len(end) + 8)]
    if not found.found:
        lines += ["  No join path found between these endpoints.", ""]
        if found.from_neighbors:
            lines += [f"  Neighbors of {start}:", *(f"    → {names.get(i, i)}" for i in found.from_neighbors)]
        if found.to_neighbors:
            lines += ["", f"  Neighbors of {end}:", *(f"    → {names.get(i, i)}" for i in found.to_neighbors)]
        return _text(lines)
    if not found.hops:
        return _text([*lines, f"  {start}  (same node, no hops)"])
    if found.inferred:
        lines += ["  ⚠  Route uses inferred (non-declared) edges", ""]
    for a, b, cols in found.hops:
        a, b = names.get(a, a), names.get(b, b)
        lines += [f"  {a}  →  {b}", *([f"      JOIN ON {a}.{x} = {b}.{y}" for x, y in cols] or ["      (join columns not resolved)"])]
    return _text(lines)


# Buckets of a precheck and their titles.
BUCKETS = (("triggers", "TRIGGERS FIRING ON AFFECTED OBJECTS"), ("writers", "WRITERS"), ("readers", "READERS"), ("constraints_and_indexes", "CONSTRAINTS AND INDEXES AFFECTED"))


def precheck(matched: Sequence[Row], affected: Sequence[Row], what_to_test: Sequence[str], unmatched: Sequence[str], detail: str = "normal") -> str:
    def item(r: Row) -> str:
        sure = "  (confidence: parsed)" if detail == "full" else ""
        return f"  [{r['kind']}]  {r['qname']}{sure}" + (f"  {DYNAMIC}" if r.get("has_dynamic_sql") and detail != "brief" else "")

    order = lambda rows: sorted(rows, key=lambda r: locale_key(r["qname"]))
    lines = ["DDL PRECHECK", RULE * 40, "", "MATCHED OBJECTS", *([item(r) for r in order(matched)] or ["  (none matched)"])]
    if detail == "brief":
        return _text(lines)
    for bucket, title in BUCKETS:
        rows = [item(r) for r in order(r for r in affected if r["bucket"] == bucket)]
        lines += _sections([title, *rows] if rows else [])
    lines += _sections(["WHAT TO TEST", *(f"  - {q}" for q in sorted(what_to_test))] if what_to_test else [])
    if detail == "full":
        lines += ["", "UNMATCHED IDENTIFIERS", *([f"  {n}  (no matching graph node)" for n in sorted(unmatched)] or ["  (none)"])]
    return _text(lines)


def search(hits: Sequence[Row], total: int, offset: int = 0, detail: str = "normal") -> str:
    lines = ["SEARCH RESULTS", RULE * 40]
    if not hits:
        return _text([*lines, "  No results found."])
    lines += [f"  [{h['kind']}]  {h['qname']}" + (f"  (matched: {h['matched']})" if detail == "full" else "") for h in hits]
    more = offset + len(hits) < total
    return _text([*lines, "", f"--- {total} results | offset {offset} | hasMore: true ---" if more else f"--- {total} results (total) | offset {offset} ---"])


def status(engine: str, version: str | None, last_sync: str | None, counts: Mapping[str, int], levels: Mapping[str, str], excluded: Sequence[str], drift: bool | None, detail: str = "normal", title: str = "GRAPH STATUS") -> str:
    """drift: None if the source could not be asked."""
    told = {None: "could not be checked live (no connection)", True: "detected (schema changed since last sync)", False: "none detected"}[drift]
    lines = [title, RULE * 40, f"  Engine:     {engine}{f' {version}' if version else ''}", f"  Last sync:  {last_sync or 'never'}", f"  Drift:      {told}"]
    if detail == "brief":
        return _text(lines)
    if counts:
        lines += ["", "  Object counts:", *(f"    {k:<18}  {counts[k]}" for k in sorted(counts) if counts[k] > 0)]
    if levels:
        lines += ["", "  Index levels:", *(f"    {k:<18}  {levels[k]}" for k in sorted(levels))]
    if detail == "full":
        lines += ["", "  Excluded objects:", *(f"    {q}" for q in sorted(excluded))] if excluded else ["", "  Excluded objects:  (none)"]
    return _text(lines)


def snapshot_diff(changes: Sequence[Row]) -> str:
    """changes has change, kind, qname."""
    lines = []
    for change, sign in (("added", "+"), ("removed", "-"), ("changed", "~")):
        rows = sorted((c for c in changes if c["change"] == change), key=lambda c: (c["qname"], c["kind"]))
        lines += [f"{change.upper()} ({len(rows)})", *(f"  {sign} [{c['kind']}]  {c['qname']}" for c in rows)]
    return _text(lines)


def sync_summary(result: Any) -> str:
    if not result.changed:
        return _text(["Up to date: the fingerprint has not changed."])
    return _text([f"Synced: {result.upserted} upserted, {result.deleted} deleted", *(f"  {k:<18}  {result.counts[k]}" for k in sorted(result.counts))])
