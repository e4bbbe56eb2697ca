"""Modules of program code as rows: methods with their comments and annotations, calls, uses of metadata, structure checks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metascope.functions.constants import ANNOTATIONS, CALL_KEYWORDS, CONTEXTS, NAMESPACES, REFERENCE, REFERENCE_TYPES
from metascope.sources.exports import module_identity

_START = re.compile(r"\s*(процедура|procedure|функция|function)\s+([a-zа-яё0-9_]+)\s*\(", re.I)
_END = re.compile(r"\s*(конецпроцедуры|endprocedure|конецфункции|endfunction)", re.I)
_ANNOTATION = re.compile(rf"\s*&({'|'.join(ANNOTATIONS)})\s*\(\s*[\"']([^\"']+)[\"']\s*\)", re.I)
_CONTEXT = re.compile(rf"\s*&({'|'.join(sorted(CONTEXTS, key=len, reverse=True))})\b", re.I)
METHODS = "config_id string, rel_path string, module_type string, module_name string, module_path string, method_name string, start_line int, end_line int, body string, annotation string, target_method string, annotation_raw string"
ISSUES = "file_id bigint, rel_path string, severity string, line int, message string"


def read_text(content: bytes) -> str:
    """The text of a module; bytes that are not UTF-8 are left out, line ends become \\n."""
    return content.decode("utf-8-sig", "ignore").replace("\r\n", "\n").replace("\r", "\n")


def texts(files: DataFrame) -> DataFrame:
    """rel_path and text (by read_text) of all files. Null contents give none."""
    rows = files.filter(F.col("content").isNotNull()).select("rel_path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"rel_path": b["rel_path"], "text": [read_text(bytes(c)) for c in b["content"]]})

    return rows.mapInPandas(run, "rel_path string, text string")


def split_methods(text: str, joined_comments: bool = False) -> list[dict]:
    """The methods of a module. A method runs from its head to the first line that closes one; an open one is
    left out. The // comments and & annotations right above it belong to it; an empty or any other line ends them.
    joined_comments: comments are put before the head without line ends, as some indexes have them."""
    out: list[dict] = []
    notes: list[str] = []
    marks: list[str] = []
    mark: tuple[str, str, str] | None = None
    open_: dict | None = None
    for number, line in enumerate(text.split("\n"), 1):
        if open_ is not None:
            open_["lines"].append(line)
            if _END.match(line):
                out.append({"method_name": open_["name"], "start_line": open_["start"], "end_line": number, "body": "\n".join(open_["lines"]) if not open_["glued"] else open_["glued"] + "\n".join(open_["lines"]),
                            "annotation": open_["mark"][0], "target_method": open_["mark"][1], "annotation_raw": open_["mark"][2]})
                open_, notes, marks, mark = None, [], [], None
            continue
        s = line.strip()
        if s.startswith("//"):
            notes.append(s)
        elif s.startswith("&"):
            marks.append(line)
            if m := _ANNOTATION.match(line):
                mark = (ANNOTATIONS[m[1].lower()], m[2].strip(), s)
        elif m := _START.match(line):
            glued = "".join(notes) if joined_comments else ""
            open_ = {"name": m[2], "start": number, "lines": [*([] if joined_comments else notes), *marks, line], "glued": glued, "mark": mark or ("", "", "")}
            notes, marks = [], []
        else:
            notes, marks, mark = [], [], None
    return out


def methods(files: DataFrame) -> DataFrame:
    """The methods of all .bsl files (columns of METHODS), one row each. Null contents give none."""
    ident = module_identity(F.col("rel_path"))
    rows = files.filter(F.lower("rel_path").endswith(".bsl") & F.col("content").isNotNull()).select("config_id", "rel_path", ident.alias("i"), "content").select("config_id", "rel_path", "i.*", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for c, p, t, n, path, content in zip(b["config_id"], b["rel_path"], b["module_type"], b["module_name"], b["module_path"], b["content"]):
                out += [{"config_id": c, "rel_path": p, "module_type": t, "module_name": n, "module_path": path} | m for m in split_methods(read_text(bytes(content)))]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in METHODS.split(", ")])

    return rows.mapInPandas(run, METHODS)


def modules(files: DataFrame) -> DataFrame:
    """The modules of all .bsl files: config_id, rel_path, file_path, module_type, module_name, module_path."""
    rows = files.filter(F.lower("rel_path").endswith(".bsl"))
    return rows.select("config_id", "rel_path", "file_path", module_identity(F.col("rel_path")).alias("i")).select("config_id", "rel_path", "file_path", "i.*").distinct()


def module_summaries(methods_: DataFrame, most: int = 200) -> DataFrame:
    """config_id, module_path, module_type, method_count and a summary that names the first `most` methods by line and
    name. Only these are gathered; all are counted."""
    from metascope.operators.skew import first_rows

    keys = ["config_id", "module_path", "module_type"]
    m = methods_.filter("method_name <> ''").select(*keys, "start_line", "method_name")
    first = first_rows(m.withColumn("_same", F.lit(1)).groupBy(*keys, "start_line", "method_name").agg(F.count("_same").alias("_same")), keys, ["start_line", "method_name"], most)
    # a method that is there several times is named as often, within the first `most`
    named = first.withColumn("_name", F.explode(F.array_repeat("method_name", F.least("_same", F.lit(most)).cast("int")))).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "_name"))).alias("_m"))
    counted = m.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    k = [c.eqNullSafe(d) for c, d in ((F.col(x), F.col(f"_k_{x}")) for x in keys)]
    j = counted.join(named.withColumnsRenamed({x: f"_k_{x}" for x in keys}), k)
    n, none = F.col("_n"), F.expr("cast(array() as array<string>)")
    lines = F.concat(
        F.array(F.concat(F.lit("Модуль: "), "module_path"), F.concat(F.lit("Тип модуля: "), "module_type"), F.concat(F.lit("Количество методов: "), n.cast("string")), F.lit("Методы:")),
        F.transform(F.slice("_m", 1, most), lambda x: F.concat(F.lit("- "), x["_name"])),
        F.when(n > most, F.array(F.concat(F.lit("- ... еще "), (n - most).cast("string"), F.lit(" методов")))).otherwise(none),
    )
    return j.select(*keys, n.cast("int").alias("method_count"), F.array_join(lines, "\n").alias("document"))


def bare_code(body: Column) -> Column:
    """Code without comments and with empty strings. A line ends at its first //, before strings are looked at."""
    return F.regexp_replace(F.regexp_replace(F.replace(body, F.lit("\r"), F.lit("")), "//[^\\n]*", ""), '"(?:[^"\\n]++|"")*"', '""')


_NAME = "[A-Za-zА-Яа-яЁё_][A-Za-zА-Яа-яЁё0-9_]*"
_NOT_IN_WORD = "(?<![A-Za-zА-Яа-яЁё0-9_])"


def _bind(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def call_candidates(body: Column) -> Column:
    """Array of struct(kind, module_name, method_name), each once: qualified A.B( and local B( not after a dot;
    keywords are no calls."""
    no_call = lambda x: F.lower(x).isin(*CALL_KEYWORDS)
    call = lambda kind, m, n: F.struct(kind.alias("kind"), m.alias("module_name"), n.alias("method_name"))

    def found(code: Column) -> Column:
        pairs = F.regexp_extract_all(code, F.lit(rf"{_NOT_IN_WORD}({_NAME}\.{_NAME})\s*\("), F.lit(1))
        single = F.regexp_extract_all(code, F.lit(rf"(?<![A-Za-zА-Яа-яЁё0-9_.])({_NAME})\s*\("), F.lit(1))
        qualified = F.transform(F.array_distinct(pairs), lambda p: call(F.lit("qualified"), F.split_part(p, F.lit("."), F.lit(1)), F.split_part(p, F.lit("."), F.lit(2))))
        local = F.transform(F.array_distinct(single), lambda n: call(F.lit("local"), F.lit(""), n))
        return F.filter(F.concat(qualified, local), lambda c: ~no_call(c["module_name"]) & ~no_call(c["method_name"]))

    return _bind(bare_code(body), found)


def metadata_usages(body: Column) -> Column:
    """Array of struct(namespace, object_type, object_name), each once: namespace.Name, letter case matters."""
    names = "|".join(sorted(NAMESPACES, key=len, reverse=True))
    types = F.create_map(*[F.lit(x) for kv in NAMESPACES.items() for x in kv])
    hits = F.array_distinct(F.regexp_extract_all(bare_code(body), F.lit(rf"{_NOT_IN_WORD}((?:{names})\.{_NAME})"), F.lit(1)))
    part = lambda p, i: F.split_part(p, F.lit("."), F.lit(i))
    return F.transform(hits, lambda p: F.struct(part(p, 1).alias("namespace"), types[part(p, 1)].alias("object_type"), part(p, 2).alias("object_name")))


def type_references(text: Column) -> Column:
    """Array of struct(raw_type, target_type, target_name) of every XxxRef.Name in a text, in order."""
    types = F.create_map(*[F.lit(x) for kv in REFERENCE_TYPES.items() for x in kv])
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)).alias("r"), F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(2)).alias("n"))
    return F.transform(pairs, lambda p: F.struct(p["r"].alias("raw_type"), F.coalesce(types[p["r"]], F.regexp_replace(p["r"], "Ref$", "")).alias("target_type"), p["n"].alias("target_name")))


def card_dependencies(cards: DataFrame) -> DataFrame:
    """References of a metadata card's text by section (the last heading above the line): key, section, source,
    target_type, target_name. Only references with the prefix cfg:, or without any, are read."""
    lines = cards.select("key", F.posexplode(F.split("document", "\n")).alias("_i", "_l"))
    sections = F.create_map(*[F.lit(x) for kv in {"Реквизиты": "attributes", "Табличная часть": "tabular_section", "Измерения": "dimensions", "Ресурсы": "resources"}.items() for x in kv])
    head = sections[F.regexp_extract("_l", "^(Реквизиты|Табличная часть|Измерения|Ресурсы):", 1)]
    from pyspark.sql import Window

    carried = lines.withColumn("section", F.last(head, ignorenulls=True).over(Window.partitionBy("key").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)))
    refs = carried.filter("section is not null").select("key", "section", F.regexp_extract("_l", r"^\s*[-*]\s*(?:\[[^\]]*\]\s*)?([^ (]+)", 1).alias("source"), F.explode(type_references(F.col("_l"))).alias("r"))
    return refs.select("key", "section", "source", "r.target_type", "r.target_name").distinct()


_DIRECTIVE = re.compile(r"#\s*(область|region|конецобласти|endregion|если|if|конецесли|endif)\b", re.I)
_RETURN = re.compile(r"\s*(?:возврат|return)\b(.*)$", re.I)
_CODE_PART = re.compile(r'(?:"(?:[^"]|"")*+(?:"|$)|[^"/]|/(?!/))*+')


def structure_issues(text: str) -> list[tuple[str, int, str]]:
    """(severity, line, message): unknown and dangling annotations (warnings); methods that are nested, repeated,
    open, closed without a beginning or by the other kind's end; procedures that return a value; functions without a
    return (warning); regions and conditions without their other half. In the order of the lines."""
    found: list[tuple[str, int, str]] = []
    stack: list[dict] = []
    first: dict[str, int] = {}
    waiting: list[int] = []
    halves = {"region": [], "condition": []}
    say = lambda severity, line, message: found.append((severity, line, message))
    for number, raw in enumerate(text.split("\n"), 1):
        line = raw.strip()
        if not line or line.startswith("//"):
            continue
        if line.startswith("&"):
            if _ANNOTATION.match(line) or _CONTEXT.match(line):
                waiting.append(number)
            else:
                say("warning", number, "unknown annotation")
            continue
        if head := _START.match(raw):
            kind, name = "function" if head[1].lower() in ("функция", "function") else "procedure", head[2]
            if stack:
                say("error", number, f"{name} begins before the end of {stack[-1]['name']}")
            if name.lower() in first:
                say("error", number, f"{name} was declared in line {first[name.lower()]}")
            first.setdefault(name.lower(), number)
            stack.append({"kind": kind, "name": name, "line": number, "returns": False})
            waiting = []
            continue
        for at in waiting:
            say("warning", at, "an annotation without a method")
        waiting = []
        if stack and (back := _RETURN.match(_CODE_PART.match(raw)[0])):
            stack[-1]["returns"] = True
            if stack[-1]["kind"] == "procedure" and back[1].strip().strip(";").strip():
                say("error", number, f"procedure {stack[-1]['name']} returns a value")
        if end := _END.match(raw):
            if not stack:
                say("error", number, "an end without a method")
                continue
            top = stack.pop()
            if top["kind"] != ("function" if end[1].lower() in ("конецфункции", "endfunction") else "procedure"):
                say("error", number, f"{top['name']} is closed as the other kind")
            if top["kind"] == "function" and not top["returns"]:
                say("warning", top["line"], f"function {top['name']} has no return")
        elif mark := _DIRECTIVE.match(line):
            word = mark[1].lower()
            half = halves["region" if word in ("область", "region", "конецобласти", "endregion") else "condition"]
            if word in ("область", "region", "если", "if"):
                half.append(number)
            elif half:
                half.pop()
            else:
                say("error", number, "a closing directive without its beginning")
    for m in stack:
        say("error", m["line"], f"{m['name']} is not closed")
    for name, half in halves.items():
        for at in half:
            say("error", at, f"a {name} is not closed")
    for at in waiting:
        say("warning", at, "an annotation without a method")
    return sorted(found, key=lambda x: x[1])


def validate_modules(files: DataFrame) -> DataFrame:
    """The issues of every module, exploded (columns of ISSUES); a module without issues gives no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, p, *issue) for i, p, c in zip(b["file_id"], b["rel_path"], b["content"]) for issue in structure_issues(read_text(bytes(c)))]
            yield pd.DataFrame(out, columns=["file_id", "rel_path", "severity", "line", "message"])

    return files.filter(F.lower("rel_path").endswith(".bsl") & F.col("content").isNotNull()).select("file_id", "rel_path", "content").mapInPandas(run, ISSUES)


REPORT = "struct<fileinfos:array<struct<path:string,diagnostics:array<struct<severity:string,code:string,message:string,range:struct<start:struct<line:int,character:int>>>>>>>"


def report_diagnostics(reports: DataFrame) -> DataFrame:
    """JSON reports (column report) of a language server as rows: file, line, column (from 1), code, severity, message."""
    from metascope.functions.text import severity_col

    d = reports.select(F.explode(F.from_json("report", REPORT)["fileinfos"]).alias("f")).select(F.col("f.path").alias("file"), F.explode("f.diagnostics").alias("d"))
    at = F.col("d.range.start")
    return d.select(
        "file", (F.coalesce(at["line"], F.lit(0)) + 1).alias("line"), (F.coalesce(at["character"], F.lit(0)) + 1).alias("column"),
        F.coalesce(F.nullif(F.col("d.code"), F.lit("")), F.lit("unknown")).alias("code"), severity_col(F.col("d.severity"), numbers=True).alias("severity"), F.trim(F.coalesce("d.message", F.lit(""))).alias("message"),
    )


def severity_counts(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"))
