"""Deeply nested records into related flat tables, by Dewey labels."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metascope.runtime import cut

#: Fields whose value may come as a list, a single item, JSON text, null or nothing.
LISTS = frozenset({"forms", "elements", "events", "by_event", "sources", "type", "type_set", "group", "commands"})
ITEMS = "record_id bigint, label string, parent_label string, item_kind string, item_key string, parent_key string, name string, item_type string, event string, handler string"
_COLUMNS = [c.split()[0] for c in ITEMS.split(", ")]
_OPEN = ("[", "{")


def _loads(text: str):
    """The value of complete JSON text, or None. Text nested too deeply for the C parser is read level by level."""
    try:
        return json.loads(text)
    except ValueError:
        return None
    except RecursionError:
        return _loads_deep(text)


def _loads_deep(text: str):
    """JSON of any depth, with a stack of our own instead of recursion."""
    scan, n, at = json.JSONDecoder().scan_once, len(text), 0
    root: list = []
    stack: list = [root]
    names: list = [None]
    ready = True  # a value may follow

    def put(value) -> None:
        if isinstance(stack[-1], dict):
            stack[-1][names[-1]] = value
        else:
            stack[-1].append(value)

    def blank(i: int) -> int:
        while i < n and text[i] in " \t\r\n":
            i += 1
        return i

    def name(i: int) -> int:
        if text[i : i + 1] != '"':
            raise ValueError("a name is missing")
        names[-1], i = scan(text, i)
        i = blank(i)
        if text[i : i + 1] != ":":
            raise ValueError("a colon is missing")
        return i + 1

    try:
        while True:
            at = blank(at)
            if ready:
                c = text[at : at + 1]
                if c in ("[", "{") and c:
                    new: list | dict = [] if c == "[" else {}
                    put(new)
                    at = blank(at + 1)
                    if text[at : at + 1] == ("]" if c == "[" else "}"):
                        at, ready = at + 1, False
                    else:
                        stack.append(new)
                        names.append(None)
                        if c == "{":
                            at = name(at)
                else:
                    value, at = scan(text, at)
                    put(value)
                    ready = False
            elif len(stack) == 1:
                return root[0] if at == n else None
            else:
                c, top = text[at : at + 1], stack[-1]
                if c == ",":
                    at, ready = blank(at + 1), True
                    if isinstance(top, dict):
                        at = name(at)
                elif c and c == ("}" if isinstance(top, dict) else "]"):
                    stack.pop()
                    names.pop()
                    at += 1
                else:
                    raise ValueError("a bracket is missing")
    except (ValueError, StopIteration):
        return None


class Label:
    """A Dewey label: the ordinals from the root down, each among the children of its parent and from 1. It is kept as its
    last ordinal and the label without it (`up`), so that truncation is one step and labels share what they have in common.
    `path` is the number of the schema path; kind and key are set if the node is a row of a table."""

    __slots__ = ("up", "ordinal", "path", "field", "node", "kind", "key", "_at")

    def __init__(self, up: Label | None, ordinal: int, path: int, field: str, node):
        self.up, self.ordinal, self.path, self.field, self.node = up, ordinal, path, field, node
        self.kind, self.key, self._at = "", "", None

    def truncated(self, kinds: frozenset[str]) -> Label | None:
        """The longest truncation of this label that is a row of one of the kinds."""
        at, passed = self.up, []
        while at is not None and at.kind not in kinds:
            if at._at is not None and at._at[0] is kinds:
                at = at._at[1]
                break
            passed.append(at)
            at = at.up
        for x in passed:  # so that a label that many share is truncated once
            x._at = (kinds, at)
        return at

    def __str__(self) -> str:
        out, at = [], self
        while at.up is not None:
            out.append(str(at.ordinal))
            at = at.up
        return ".".join(reversed(out))


class Paths:
    """Schema paths, the fields from the root down without ordinals, as numbers; and for each the group that its nodes
    belong to. A group follows from the parent path's group and the last field alone."""

    #: (group of the parent path, field) -> group; None stands for any group (fixed names of the exports).
    GROUPS = {
        (None, "subscription"): "subscription", (None, "elements"): "elements", (None, "commands"): "commands", (None, "events"): "events", ("events", "by_event"): "by_event",
        (None, "sources"): "sources", (None, "type"): "sources", (None, "type_set"): "sources", (None, "group"): "sources",
    }

    def __init__(self):
        self.number: dict[tuple[int, str], int] = {}
        self.group = [""]

    def child(self, path: int, field: str) -> int:
        n = self.number.get((path, field))
        if n is None:
            n = self.number[path, field] = len(self.group)
            self.group.append(self.GROUPS.get((self.group[path], field)) or self.GROUPS.get((None, field), ""))
        return n


def labelled(value, paths: Paths) -> Iterator[Label]:
    """The label of every node in document order; the items of a list have the list's schema path. JSON text in one of
    LISTS counts as what it says."""
    stack = [Label(None, 0, 0, "", value)]
    while stack:
        at = stack.pop()
        if isinstance(at.node, str) and at.field in LISTS and at.node.lstrip()[:1] in _OPEN:
            inner = _loads(at.node)
            at.node = at.node if inner is None else inner
        yield at
        if isinstance(at.node, dict):
            stack.extend([Label(at, i, paths.child(at.path, k), k, v) for i, (k, v) in enumerate(at.node.items(), 1)][::-1])
        elif isinstance(at.node, list):
            stack.extend([Label(at, i, at.path, at.field, v) for i, v in enumerate(at.node, 1)][::-1])


#: A lone half of a surrogate pair, which JSON may hold and no table can.
_HALF = re.compile("[\ud800-\udfff]")


def _text(x) -> str:
    """A scalar as text; nothing for null, blank text and structures."""
    if x is None or isinstance(x, (dict, list)):
        return ""
    if isinstance(x, bool):
        return "true" if x else "false"
    text = str(x)
    if not text.strip():
        return ""
    return text if text.isascii() else _HALF.sub("\ufffd", text)


def _handlers(x) -> list[str]:
    """The handlers that a value names: text, or an object as module.method, or a list of such."""
    if isinstance(x, str) and x.lstrip()[:1] in _OPEN and (inner := _loads(x)) is not None:
        x = inner
    if isinstance(x, list):
        return [h for y in x for h in _handlers(y)]
    if isinstance(x, dict):
        module, method = _text(x.get("module")), _text(x.get("method"))
        return [f"{module}.{method}" if module else method] if method else []
    return [_text(x)] if _text(x) else []


_OWNERS, _FORMS, _SUBSCRIPTIONS = frozenset({"form", "element", "subscription"}), frozenset({"form"}), frozenset({"subscription"})


def flat_items(record_id, payload: str | None, texts: bool = True) -> Iterator[tuple]:
    """The rows of ITEMS of one record; none if the payload is null or not complete JSON. Every node gets its label and its
    schema path; the path's group and the node's shape tell the table; the parent is the longest truncation of the label
    that is a row of the parents' tables. texts: whether the labels are written out as text."""
    value = _loads(payload.lstrip("\ufeff")) if isinstance(payload, str) else None
    if value is None:
        return
    paths = Paths()
    out = lambda at, up, kind, key, name=None, item_type=None, event=None, handler=None: (
        record_id, str(at) if texts else None, str(up) if texts and up else None, kind, key, up.key if up else None, name, item_type, event, handler,
    )
    for at in labelled(value, paths):
        node, group, above = at.node, paths.group[at.path], at.up
        within = above.node if above is not None else None
        if isinstance(node, dict):
            if group != "elements" and "form_name" in node:
                at.kind, at.key = "form", _text(node["form_name"])
                yield out(at, None, "form", at.key, at.key, _text(node.get("owner")) or None)
            elif group == "subscription" or (above is None and "sources" in node):
                at.kind, at.key = "subscription", (_handlers(node.get("handler")) or [""])[0]
                yield out(at, None, "subscription", at.key, _text(node.get("name")) or None, None, _text(node.get("event")) or None, at.key)
            elif group in ("elements", "commands") and (up := at.truncated(_OWNERS)) is not None and up.kind != "subscription":
                form = up if up.kind == "form" else up.truncated(_FORMS)
                name = _text(node.get("element_name" if group == "elements" else "command_name"))
                if group == "elements":
                    at.kind, at.key = "element", f"{form.key}/{_text(node.get('element_id')) or name}"
                    yield out(at, up, "element", at.key, name or None, _text(node.get("element_type")) or None)
                else:
                    yield out(at, form, "command", f"{form.key}/{name}", name, None, None, _text(node.get("action")) or None)
        # handlers: an item of events with event and handler, or a member of an object by event name
        listed = group == "events" and isinstance(node, dict) and "event" in node
        above_group = paths.group[above.path] if above is not None else ""
        member = isinstance(within, dict) and (above_group == "by_event" or (above_group == "events" and not {"event", "by_event"} & within.keys()))
        if listed or member:
            up = at.truncated(_OWNERS)
            if up is not None and up.kind != "subscription":
                event, handlers = (_text(node["event"]), _handlers(node.get("handler"))) if listed else (_text(at.field), _handlers(node))
                for h in handlers:
                    yield out(at, up, "handler", f"{event}={h}", None, None, event, h)
        elif group == "sources" and not isinstance(node, (dict, list)) and (key := _text(node)):
            up = at.truncated(_OWNERS)
            if up is not None and up.kind == "subscription":
                yield out(at, up, "source", key, key, at.field)


#: Rows go out as soon as their labels have so many characters, so that a very deep record fills no task's memory.
_CHARS, _ROWS = 8_000_000, 20_000


def flatten_records(records: DataFrame, texts: bool = True) -> DataFrame:
    """Every item of every record with its Dewey label and its parent's, in the columns of ITEMS.

    item_kind: form, element, command, handler, subscription, source. A record that was delivered twice, identical in
    payload, counts once; a null, damaged or cut payload gives no rows; JSON that holds none of these gives none.
    Extra columns are ignored. An element with neither id nor name has the key `form_name/`. Lone halves of surrogate
    pairs come out as U+FFFD. Records are labelled one by one where they lie, in Arrow batches: the only shuffle is that of
    the repeated rows. The text of a label is as long as its node is deep; without texts the work is linear at any depth.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, chars = [], 0
        for b in batches:
            for i, p in zip(b["record_id"], b["payload"]):
                for r in flat_items(i, p, texts):
                    rows.append(r)
                    chars += len(r[1] or "") + len(r[2] or "")
                    if chars > _CHARS or len(rows) >= _ROWS:
                        yield pd.DataFrame(rows, columns=_COLUMNS)
                        rows, chars = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=_COLUMNS)

    # ids travel as text: pandas would turn a column with nulls into floats
    rows = records.select(F.col("record_id").cast("string").alias("record_id"), "payload").filter("payload is not null")
    return rows.mapInPandas(run, ITEMS.replace("record_id bigint", "record_id string")).withColumn("record_id", F.col("record_id").cast("bigint")).distinct()


#: The related flat tables and their columns.
TABLES = {
    "forms": ("form", "item_key as form_name", "item_type as owner"),
    "elements": ("element", "item_key as element_key", "parent_key", "name as element_name", "item_type as element_type"),
    "commands": ("command", "name as command_name", "parent_key", "handler as action"),
    "handlers": ("handler", "event", "handler", "parent_key"),
    "subscriptions": ("subscription", "name as subscription_name", "event", "handler"),
    "sources": ("source", "item_key as source", "parent_key"),
}


def record_tables(records: DataFrame) -> dict[str, DataFrame]:
    """The related flat tables of TABLES, each with record_id, label and parent_label, which refers to the label of the
    parent's row in the same record. Payloads are parsed once; the items lie in the shared folder by kind, so that each
    table reads its own."""
    items = cut(flatten_records(records), "item_kind")
    return {name: items.filter(F.col("item_kind") == kind).selectExpr("record_id", "label", "parent_label", *cols) for name, (kind, *cols) in TABLES.items()}


def found_items(records: DataFrame) -> DataFrame:
    """record_id, item_kind, item_key, parent_key of the elements, handlers and sources, without repetitions. Labels are made
    and truncated as for the tables; only their texts, which this result has no column for, are not written out."""
    return flatten_records(records, texts=False).filter(F.col("item_kind").isin("element", "handler", "source")).select("record_id", "item_kind", "item_key", "parent_key").distinct()
