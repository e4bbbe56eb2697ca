"""XML descriptors as rows: objects with their references, forms with commands, events and elements, event subscriptions."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metascope.functions.constants import ELEMENT_TYPES, REFERENCE_TYPES
from metascope.sources.exports import form_identity, is_form_xml

_REF = "struct<section:string,container:string,source:string,raw_type:string,target_type:string,target_name:string>"
_COMMAND = "struct<name:string,action:string,title:string,tooltip:string>"
_EVENT = "struct<event:string,handler:string,source_kind:string,source_name:string>"
_ELEMENT = (
    "struct<element_id:string,element_name:string,element_type:string,title:string,data_path:string,command_name:string,command_ref:string,visible:boolean,enabled:boolean,"
    "read_only:boolean,parent_element_id:string,parent_element_name:string,depth:int,events:array<struct<event:string,handler:string>>>"
)
OBJECTS = f"config_id string, file_path string, rel_path string, object_type string, object_name string, synonym string, document string, refs array<{_REF}>"
FORMS = f"config_id string, file_path string, rel_path string, form_name string, owner_type string, owner_object_type string, owner_name string, root_type string, document string, data_paths array<string>, commands array<{_COMMAND}>, events array<{_EVENT}>, elements array<{_ELEMENT}>"
SUBSCRIPTIONS = "config_id string, file_path string, rel_path string, subscription_name string, synonym string, comment string, event string, handler string, handler_module string, handler_method string, sources array<string>, uuid string, document string"


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def child(e: ET.Element | None, name: str) -> ET.Element | None:
    return next((c for c in e if local(c) == name), None) if e is not None else None


def children(e: ET.Element | None, name: str) -> list[ET.Element]:
    return [c for c in e if local(c) == name] if e is not None else []


def own_text(e: ET.Element | None) -> str:
    return (e.text or "").strip() if e is not None else ""


def all_text(e: ET.Element | None) -> str:
    """The texts of an element and all below it, joined by spaces."""
    return " ".join(t for x in e.iter() if (t := (x.text or "").strip())) if e is not None else ""


def localized(e: ET.Element | None) -> str:
    """The first content of a localized text, else its own text."""
    if e is None:
        return ""
    return next((t for x in e.iter() if local(x) == "content" and (t := (x.text or "").strip())), own_text(e))


def truth(text: str, default: bool) -> bool:
    return {"true": True, "false": False}.get(text.strip().lower(), default)


def once(items: list[str], most: int) -> list[str]:
    return list(dict.fromkeys(s for i in items if (s := i.strip())))[:most]


def _root(content: bytes) -> ET.Element | None:
    try:
        return ET.fromstring(content)
    except (ET.ParseError, ValueError, LookupError):
        return None


def parse_object(content: bytes) -> dict | None:
    """Type, name, synonym, card and type references of a descriptor; None if it is broken or describes no object."""
    root = _root(content)
    top = next((c for c in root if local(c) != "MetaDataObject"), None) if root is not None else None
    props = child(top, "Properties")
    if props is None:
        return None
    kind, name, synonym, comment = local(top), own_text(child(props, "Name")), localized(child(props, "Synonym")), own_text(child(props, "Comment"))
    card = [f"Тип метаданных: {kind}", f"Имя объекта: {name}", f"Синоним: {synonym}", *([f"Описание: {comment}"] if comment else [])]
    refs: list[dict] = []

    def field(e: ET.Element, section: str, container: str, line: str) -> str | None:
        p = child(e, "Properties")
        if p is None:
            return None
        field_name = own_text(child(p, "Name"))
        types = [t for x in (child(p, "Type").iter() if child(p, "Type") is not None else ()) if local(x) == "Type" and x is not child(p, "Type") and (t := (x.text or "").strip())]
        for t in types:
            raw, dot, target = t.removeprefix("cfg:").partition(".")
            if dot and raw.endswith("Ref") and raw[:-3].isascii() and raw.isalpha():
                refs.append({"section": section, "container": container, "source": field_name, "raw_type": raw, "target_type": REFERENCE_TYPES.get(raw, raw[:-3]), "target_name": target})
        return line.format(field_name, ", ".join(types), localized(child(p, "Synonym")))

    below = child(top, "ChildObjects")
    for tag, section, heading, line in (("Attribute", "attributes", "Реквизиты:", "  - {} ({}): {}"), ("TabularSection", "", "", ""), ("Dimension", "dimensions", "Измерения:", "  - [Измерение] {} ({}): {}"), ("Resource", "resources", "Ресурсы:", "  - [Ресурс] {} ({}): {}")):
        if tag == "TabularSection":
            for part in children(below, tag):
                p = child(part, "Properties")
                if p is not None:
                    part_name = own_text(child(p, "Name"))
                    card.append(f"Табличная часть: {part_name} ({localized(child(p, 'Synonym'))})")
                    card += [x for a in children(child(part, "ChildObjects"), "Attribute") if (x := field(a, "tabular_section", part_name, "    * {} ({}): {}"))]
            continue
        lines = [x for e in children(below, tag) if (x := field(e, section, "", line))]
        card += [heading, *lines] if lines else []
    return {"object_type": kind, "object_name": name, "synonym": synonym, "document": "\n".join(card), "refs": refs}


def _events(e: ET.Element) -> list[dict]:
    """X11: the events right at an element."""
    return [{"event": x.get("name", "").strip(), "handler": h} for x in children(child(e, "Events"), "Event") if (h := all_text(x))]


def form_elements(root: ET.Element) -> list[dict]:
    """The element tree in document order, with the id, name and depth of the nearest element above."""
    out: list[dict] = []
    todo = [(e, "", "", 0) for c in root for e in ([c] if local(c) == "AutoCommandBar" else list(c) if local(c) == "ChildItems" else [])][::-1]
    while todo:
        e, up_id, up_name, depth = todo.pop()
        kind, name, ident = local(e), e.get("name", "").strip(), e.get("id", "").strip()
        if kind in ELEMENT_TYPES and (name or ident):
            command = all_text(child(e, "CommandName"))
            ref = command.rpartition(".")[2] if command.startswith("Form.Command.") else command
            ident, name = ident or f"auto_{len(out) + 1}", name or kind
            out.append({
                "element_id": ident, "element_name": name, "element_type": kind, "title": localized(child(e, "Title")), "data_path": all_text(child(e, "DataPath")), "command_name": command, "command_ref": ref,
                "visible": truth(all_text(child(e, "Visible")), True), "enabled": truth(all_text(child(e, "Enabled")), True), "read_only": truth(all_text(child(e, "ReadOnly")), False),
                "parent_element_id": up_id, "parent_element_name": up_name, "depth": depth, "events": _events(e),
            })
            up_id, up_name, depth = ident, name, depth + 1
        below = child(e, "ChildItems")
        todo += [(c, up_id, up_name, depth) for c in (below if below is not None else ())][::-1]
    return out


def form_commands(root: ET.Element) -> list[dict]:
    """Every Command of a form that has a name or an action."""
    rows = [{"name": (c.get("name") or all_text(child(c, "Name"))).strip(), "action": all_text(child(c, "Action")), "title": all_text(child(c, "Title")), "tooltip": all_text(child(c, "ToolTip"))} for c in root.iter() if local(c) == "Command"]
    return [r | {"name": r["name"] or r["action"]} for r in rows if r["name"] or r["action"]]


def form_events(root: ET.Element) -> list[dict]:
    """Every event with a handler, and the nearest named element above it."""
    out, todo = [], [(root, "", "")]
    while todo:
        e, kind, name = todo.pop()
        tag = local(e)
        if tag not in ("Event", "Events") and e.get("name", "").strip():
            kind, name = tag, e.get("name", "").strip()
        if tag == "Event" and (h := all_text(e)):
            out.append({"event": e.get("name", "").strip(), "handler": h, "source_kind": kind, "source_name": name})
        todo += [(c, kind, name) for c in e][::-1]
    return out


def parse_form(content: bytes, identity: dict) -> dict | None:
    """A form's card, data paths, commands, events and elements; None if it is broken."""
    root = _root(content)
    if root is None:
        return None
    texts: dict[str, list[str]] = {}
    groups = {"Title": "title", "Caption": "title", "ToolTip": "title", "CommandName": "command", "DataPath": "path", "Attribute": "attribute", "Item": "item", "Group": "item", "Button": "item", "Table": "item"}
    for e in root.iter():
        if (g := groups.get(local(e))) and (t := all_text(e)):
            texts.setdefault(g, []).append(t)
    commands, events, kind = form_commands(root), form_events(root), local(root)
    elements = form_elements(root) if kind == "Form" else []
    paths = once(texts.get("path", []), 20)
    owner = f"{identity['owner_type']}.{identity['owner_name']}" if identity["owner_name"] else identity["owner_type"] or "unknown"
    card = ["Тип сущности: Form", f"Тип XML формы: {kind}", f"Владелец: {owner}", f"Имя формы: {identity['form_name']}"]
    for heading, lines in (
        ("Заголовки:", once(texts.get("title", []), 10)), ("Команды:", once(texts.get("command", []), 20)), ("Commands:", [f"{c['name']} -> {c['action'] or 'no action'}" for c in commands[:20]]),
        ("Event handlers:", [f"{e['source_name'] or e['source_kind']}.{e['event']} -> {e['handler']}" for e in events[:20]]), ("Реквизиты формы:", once(texts.get("attribute", []), 20)),
        ("Элементы формы:", once(texts.get("item", []), 20)), ("Пути данных:", paths), ("UI elements:", [f"{e['element_type']} {e['element_name']} -> {e['data_path'] or e['command_name'] or 'no binding'}" for e in elements[:30]]),
    ):
        card += [heading, *(f"  - {x}" for x in lines)] if lines else []
    return identity | {"root_type": kind, "document": "\n".join(card), "data_paths": paths, "commands": commands, "events": events, "elements": elements}


def parse_subscription(content: bytes) -> dict | None:
    """An event subscription; None for broken or other XML."""
    root = _root(content)
    sub = child(root, "EventSubscription")
    props = child(sub, "Properties")
    if props is None:
        return None
    get = lambda n: own_text(child(props, n))
    handler = get("Handler")
    parts = handler.split(".")
    source = child(props, "Source")
    sources = once([x.text or "" for x in (source if source is not None else ()) if local(x) in ("Type", "TypeSet")], 1 << 30)
    synonym, comment = localized(child(props, "Synonym")), get("Comment")
    card = ["Тип метаданных: EventSubscription", f"Имя подписки: {get('Name')}", f"Синоним: {synonym}", f"Событие: {get('Event')}", f"Источники: {', '.join(sources)}", f"Обработчик: {handler}", *([f"Описание: {comment}"] if comment else [])]
    return {
        "subscription_name": get("Name"), "synonym": synonym, "comment": comment, "event": get("Event"), "handler": handler, "handler_module": ".".join(parts[:2]) if len(parts) >= 2 else "",
        "handler_method": ".".join(parts[2:]), "sources": sources, "uuid": sub.get("uuid", ""), "document": "\n".join(card),
    }


def _parsed(rows: DataFrame, schema: str, parse) -> DataFrame:
    cols = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                if (made := parse(bytes(r["content"]), r)) is not None:
                    out.append({k: r[k] for k in ("config_id", "file_path", "rel_path")} | made)
            yield pd.DataFrame(out, columns=cols)

    return rows.mapInPandas(run, schema)


def objects(files: DataFrame) -> DataFrame:
    """Object descriptors (columns of OBJECTS): XML that is neither a form's nor a help page's; broken files give no row."""
    rel, name = F.col("rel_path"), F.substring_index(F.replace("rel_path", F.lit("\\"), F.lit("/")), "/", -1)
    keep = F.lower(rel).endswith(".xml") & F.col("content").isNotNull() & ~is_form_xml(rel) & ~rel.rlike(r"(^|[/\\])Forms[/\\]") & ~name.isin("Form.xml", "Help.xml")
    return _parsed(files.filter(keep).select("config_id", "file_path", "rel_path", "content"), OBJECTS, lambda c, r: parse_object(c))


def forms(files: DataFrame) -> DataFrame:
    """Forms (columns of FORMS); broken files give no row."""
    rows = files.filter(is_form_xml(F.col("rel_path")) & F.col("content").isNotNull()).select("config_id", "file_path", "rel_path", "content", form_identity(F.col("rel_path")).alias("i")).select("config_id", "file_path", "rel_path", "content", "i.*")
    return _parsed(rows, FORMS, lambda c, r: parse_form(c, {k: r[k] for k in ("form_name", "owner_type", "owner_object_type", "owner_name")}))


def subscriptions(files: DataFrame) -> DataFrame:
    """Event subscriptions (columns of SUBSCRIPTIONS) of the files below EventSubscriptions."""
    keep = F.col("rel_path").rlike(r"(^|[/\\])EventSubscriptions[/\\]") & F.lower("rel_path").endswith(".xml") & F.col("content").isNotNull()
    return _parsed(files.filter(keep).select("config_id", "file_path", "rel_path", "content"), SUBSCRIPTIONS, lambda c, r: parse_subscription(c))


def command_cards(forms_: DataFrame) -> DataFrame:
    """A card for each command of a form."""
    c = forms_.select("config_id", "file_path", "form_name", "owner_type", "owner_object_type", "owner_name", F.explode("commands").alias("c"))
    owner = F.when(F.col("owner_name") != "", F.concat_ws(".", "owner_object_type", "owner_name")).otherwise(F.coalesce(F.nullif(F.col("owner_type"), F.lit("")), F.lit("unknown")))
    line = lambda label, x: F.concat(F.lit(label), F.coalesce(x, F.lit("")))
    card = F.concat_ws("\n", F.lit("Тип сущности: FormCommand"), line("Владелец: ", owner), line("Форма: ", F.col("form_name")), line("Команда: ", F.col("c.name")), line("Заголовок: ", F.col("c.title")), line("Подсказка: ", F.col("c.tooltip")), line("Обработчик: ", F.col("c.action")))
    return c.select("config_id", "file_path", "form_name", "owner_name", F.col("c.name").alias("command_name"), F.col("c.action").alias("action"), F.col("c.title").alias("title"), F.col("c.tooltip").alias("tooltip"), card.alias("document"))
