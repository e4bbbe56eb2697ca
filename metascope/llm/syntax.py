"""Source files that do not parse: recursive descent with precedence climbing and panic-mode recovery for modules,
well-formedness for XML."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keywords of the module language in both of its languages, and the kind of token that each makes (fixed values of the language).
KEYWORDS = {
    "P": "процедура procedure", "p": "конецпроцедуры endprocedure", "F": "функция function", "f": "конецфункции endfunction",
    "I": "если if", "T": "тогда then", "E": "иначеесли elsif", "e": "иначе else", "k": "конецесли endif",
    "L": "для for", "c": "каждого each", "j": "из in", "o": "по to", "W": "пока while", "D": "цикл do", "d": "конеццикла enddo",
    "Y": "попытка try", "x": "исключение except", "y": "конецпопытки endtry",
    "R": "возврат return", "r": "вызватьисключение raise", "b": "прервать break продолжить continue", "g": "перейти goto",
    "v": "перем var", "V": "знач val", "X": "экспорт export", "S": "асинх async", "h": "добавитьобработчик addhandler удалитьобработчик removehandler",
    "z": "выполнить execute", "N": "новый new", "w": "ждать await", "A": "и and или or", "!": "не not", "q": "истина true ложь false неопределено undefined null",
}
#: Directives: the kind, and the first words that make it.
DIRECTIVES = {
    "1": "область region", "2": "конецобласти endregion", "3": "если if", "4": "иначеесли elsif", "5": "иначе else", "6": "конецесли endif",
    "7": "вставка insert", "8": "конецвставки endinsert", "9": "удаление delete", "0": "конецудаления enddelete", "u": "использовать use native",
}
_KIND = {w: k for k, ws in KEYWORDS.items() for w in ws.split()}
_DIRECTIVE = {w: k for k, ws in DIRECTIVES.items() for w in ws.split()}
_NL = r"(?>\r\n|\n|\r)"  # atomic, as are the loops of strings: an open quote before many empty lines must not make the search back up
#: One token: comment, member access, name, string (going on over lines that begin with |), number, date, directive, annotation, label, operator, anything else.
_TOKEN = re.compile(
    rf"""\s*+(//[^\r\n]*|\.\s*[^\W\d]\w*|[^\W\d]\w*|"[^"\r\n]*+(?:(?:""|{_NL}(?:[ \t]*+(?://[^\r\n]*+)?{_NL})*+[ \t]*+\|)[^"\r\n]*+)*+"|\d+(?:\.\d+)?|'[\d :.\-/]*'|\#[ \t]*\w*[^\r\n]*|&[^\W\d]\w*|~[^\W\d]\w*[ \t]*:?|<>|<=|>=|\S|\Z)"""
)
_EXPRESSION = re.compile(r"[insaq.()\[\],?+\-*/%=<!ANw]*")
_OPERATORS = {"A": 1, "=": 3, "<": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5}
_CLOSERS = {"k": "If", "d": "a loop", "y": "Try", "p": "a procedure", "f": "a function", "2": "#Region", "6": "#If", "8": "#Insert", "0": "#Delete"}
#: What may go on or close an open block: kind of the opener -> kinds.
_PARTS = {"I": "Eek", "L": "d", "W": "d", "Y": "xy", "P": "p", "F": "f", "1": "2", "3": "456", "7": "8", "9": "0"}
_NAMES = {"I": "If", "L": "For", "W": "While", "Y": "Try", "P": "Procedure", "F": "Function", "1": "#Region", "3": "#If", "7": "#Insert", "9": "#Delete"}
_STATEMENTS = frozenset("ILWYRrbgvhzPFS&13579" + "eEkdyxpf246850u")
MAX_MEMO = 200_000


class _Kinds(dict):
    """Token to kind; remembers short tokens."""

    def __missing__(self, token: str) -> str:
        c = token[:1]
        if not c or token[:2] == "//":
            return ""
        if c == '"':
            return "s" if len(token) > 1 else "\x01"
        if c == "'":
            return "a" if len(token) > 1 else "\x01"
        if c == "#":
            word = re.match(r"#[ \t]*(\w*)", token)[1].lower()
            return _DIRECTIVE.get(word, "\x02")
        if c == ".":
            kind = "." if len(token) > 1 else "\x01"
        elif c == "&":
            kind = "&" if len(token) > 1 else "\x01"
        elif c == "~":
            kind = "~" if len(token) > 1 else "\x01"
        elif c.isdigit():
            kind = "n" if c in "0123456789" else "\x01"
        elif c == "_" or c.isalpha():
            kind = _KIND.get(token.lower(), "i")
        elif c in "<>":
            kind = "<"
        else:
            kind = c if c in "()[],?+-*/%=;" else "\x01"
        if len(self) < MAX_MEMO:
            self[token] = kind
        return kind


class _Fault(Exception):
    """at: index in the slice; what: the message."""

    def __init__(self, at: int, what: str):
        super().__init__(what)
        self.at, self.what = at, what


def _primary(s: str, i: int) -> int:
    c = s[i : i + 1]
    if c in ("-", "+") and c:
        return _unary(s, i + 1)
    if c in ("i", "n", "a", "q") and c:
        i += 1
    elif c == "s":
        while s[i : i + 1] == "s":
            i += 1
    elif c == "(":
        i = _expect(s, _binary(s, i + 1, 0), ")")
    elif c == "?":
        i = _expect(s, i + 1, "(")
        i = _expect(s, _binary(s, i, 0), ",")
        i = _expect(s, _binary(s, i, 0), ",")
        i = _expect(s, _binary(s, i, 0), ")")
    elif c == "N":
        i += 1
        if s[i : i + 1] == "i":
            i += 1
            while s[i : i + 1] == ".":
                i += 1
        elif s[i : i + 1] != "(":
            raise _Fault(i, "a type is missing after New")
    elif c == "w":
        return _unary(s, i + 1)
    else:
        raise _Fault(i, "an expression is missing")
    return _postfix(s, i)


def _postfix(s: str, i: int) -> int:
    while True:
        c = s[i : i + 1]
        if c == ".":
            i += 1
        elif c == "[":
            i = _expect(s, _binary(s, i + 1, 0), "]")
        elif c == "(":
            i += 1
            while s[i : i + 1] == ",":
                i += 1
            while s[i : i + 1] != ")":
                i = _binary(s, i, 0)
                if s[i : i + 1] == ",":
                    while s[i : i + 1] == ",":
                        i += 1
                elif s[i : i + 1] != ")":
                    raise _Fault(i, "a bracket is not closed")
            i += 1
        else:
            return i


def _expect(s: str, i: int, c: str) -> int:
    if s[i : i + 1] != c:
        raise _Fault(i, "a bracket is not closed" if c in ")]" else f"{c} is missing")
    return i + 1


def _unary(s: str, i: int) -> int:
    while s[i : i + 1] in ("-", "+") and i < len(s):
        i += 1
    return _primary(s, i)


def _binary(s: str, i: int, least: int) -> int:
    """Precedence climbing: the end of the expression from i whose operators bind at least so tightly. Not binds between
    And and the comparisons."""
    if s[i : i + 1] == "!":
        i = _binary(s, i + 1, 2)
    else:
        i = _unary(s, i)
    while (p := _OPERATORS.get(s[i : i + 1], -1)) >= least and p > 0:
        i = _binary(s, i + 1, p + 1) if s[i + 1 : i + 2] != "!" else _binary(s, i + 1, 0)
    return i


def _whole(s: str) -> tuple[int, str] | None:
    """The fault of a slice that should be one expression."""
    try:
        end = _binary(s, 0, 0)
    except _Fault as e:
        return e.at, e.what
    return None if end == len(s) else (end, "unexpected token in an expression")


def _assignment(s: str) -> tuple[int, str] | None:
    """The fault of a slice that should be a call or an assignment."""
    try:
        if s[:1] == "w":
            end = _unary(s, 0)
        elif s[:1] in ("i", "N", "?", "s"):
            end = _postfix(s, 1) if s[0] == "i" else _primary(s, 0)
        else:
            return 0, "a statement can't begin so"
        if end == len(s):
            return None if s[-1] == ")" else (end, "a statement is not complete")
        if s[end] == "=" and s[0] == "i":
            end = _binary(s, end + 1, 0)
            if end == len(s):
                return None
    except _Fault as e:
        return e.at, e.what
    return end, "a semicolon is missing"


class Parser:
    """Modules of the business language. Expressions are looked up by the kinds of their tokens, so that each shape is
    parsed once for each process; the memo is bounded and changes no result."""

    def __init__(self):
        self.kinds, self.memo = _Kinds(), {}

    def parse(self, text: str) -> list[tuple[int, str]]:
        """All errors as (line from 1, message) in the order of their place; none for a valid module."""
        self.k = "".join(map(self.kinds.__getitem__, _TOKEN.findall(text))) + "$"
        if sys.getrecursionlimit() < 6 * len(self.k) + 20_000:  # no nesting is deeper than this; Python's calls among themselves take heap, not the C stack
            sys.setrecursionlimit(6 * len(self.k) + 20_000)
        self.faults: list[tuple[int, str]] = []
        self.open: list[tuple[str, int]] = []
        i = 0
        while True:
            i = self._list(i, "")
            if self.k[i] == "$":
                break
            i += 1
        if not self.faults:
            return []
        places, line, at = [], 1, 0
        for m in _TOKEN.finditer(text):
            if self.kinds[m[1]]:
                line += len(re.findall(_NL, text[at : m.start(1)]))
                at = m.start(1)
                places.append(line)
        places.append(line + len(re.findall(_NL, text[at:])))
        return [(places[min(i, len(places) - 1)], what) for i, what in sorted(self.faults)]

    def _fault(self, i: int, what: str) -> None:
        self.faults.append((i, what))

    def _skip(self, i: int) -> int:
        """Panic mode: goes to the end of the statement or to the next keyword that begins, parts or closes one."""
        k = self.k
        while k[i] != ";" and k[i] != "$" and k[i] not in _STATEMENTS:
            i += 1
        return i + 1 if k[i] == ";" else i

    def _slice(self, i: int, check) -> int:
        """Checks the run of expression tokens from i with the memo; the index behind it."""
        end = _EXPRESSION.match(self.k, i).end()
        s = self.k[i:end]
        key = (check, s)
        fault = self.memo.get(key, 0)
        if fault == 0:
            fault = check(s)
            if len(self.memo) < MAX_MEMO and len(s) < 400:
                self.memo[key] = fault
        if fault:
            self._fault(i + fault[0], fault[1])
        return end

    def _list(self, i: int, enders: str) -> int:
        """Statements from i up to one of the enders, or to a keyword that only an outer block can take."""
        k = self.k
        while True:
            c = k[i]
            if c == ";":
                i += 1
                continue
            if c in enders or c == "$":
                return i
            start = i
            i = self._statement(c, i)
            if i < 0:
                return -i - 1
            c = k[i]
            if c == ";":
                i += 1
            elif k[start] in "PF123456789&S~u0" or k[i - 1] in "pf24680u" or c == "$" or c in enders or c in "12345678900u":
                pass
            elif c in _CLOSERS or c in "eEx":
                pass  # the block's own rule says whether it may stand here
            else:
                if not self.faults or self.faults[-1][0] < start:
                    self._fault(i, "a semicolon is missing" if c >= " " else "an unknown token")
                i = max(self._skip(i), i + (i == start))
            if i == start:
                i += 1

    def _statement(self, c: str, i: int) -> int:
        """The index behind the statement; -1 - index for a keyword that belongs to an outer block."""
        k = self.k
        if c in "iw" or c in "?Ns":
            return self._slice(i, _assignment)
        if c == "I":
            return self._if(i)
        if c == "R":
            return self._slice(i + 1, _whole) if k[i + 1] in "insaq(?+-!Nw" else i + 1
        if c in "LW":
            return self._loop(c, i)
        if c == "Y":
            self.open.append(("Y", i))
            i = self._list(i + 1, "xy")
            if k[i] == "x":
                i = self._list(i + 1, "y")
            return self._close(i, "y")
        if c in "1379":
            self.open.append((c, i))
            i = self._list(i + 1, _PARTS[c])
            seen = False
            while c == "3" and k[i] in "45":
                if seen:
                    self._fault(i, "a part follows #Else")
                seen = k[i] == "5"
                i = self._list(i + 1, "456")
            return self._close(i, _PARTS[c][-1])
        if c in "PF":
            return self._method(i)
        if c == "S":
            if k[i + 1] in "PF":
                return self._method(i + 1)
            self._fault(i, "Async without a method")
            return i + 1
        if c == "&":
            end = i + 1
            if k[end] == "(":
                end = self._slice(end, _whole)
            if k[end] not in "&PFvS13456":
                self._fault(i, "an annotation without a method")
            return end
        if c == "v":
            i += 1
            while True:
                if k[i] != "i":
                    self._fault(i, "a variable's name is missing")
                    return self._stop(i)
                i += 1
                if k[i] == "X":
                    i += 1
                if k[i] != ",":
                    return i
                i += 1
        if c == "b":
            return i + 1
        if c == "r":
            return self._slice(i + 1, _whole) if k[i + 1] in "insaq(?+-!Nw" else i + 1
        if c == "g":
            if k[i + 1] != "~":
                self._fault(i + 1, "a label is missing")
                return i + 1
            return i + 2
        if c == "~":
            return i + 1
        if c == "h":
            return self._slice(i + 1, _pair)
        if c == "z":
            return self._slice(i + 1, _whole)
        if c == "u":
            return i + 1
        if c in _CLOSERS or c in "eEx45":
            if any(c in _PARTS[kind] for kind, _ in self.open):
                return -1 - i
            self._fault(i, f"this closes {_CLOSERS[c]} that isn't open" if c in _CLOSERS else "a part without its block")
            return i + 1
        self._fault(i, {"\x01": "an unknown token or a quote that isn't closed", "\x02": "an unknown directive"}.get(c, "a statement can't begin so"))
        return self._stop(i + 1)

    def _stop(self, i: int) -> int:
        """After a fault within a statement: its end, without the semicolon."""
        j = self._skip(i)
        return j - 1 if j > i and self.k[j - 1] == ";" else j

    def _close(self, i: int, closer: str) -> int:
        kind, at = self.open.pop()
        if self.k[i] == closer:
            return i + 1
        self._fault(at, f"{_NAMES[kind]} is not closed")
        return i

    def _then(self, i: int, c: str, what: str) -> int:
        i = self._slice(i, _whole)
        if self.k[i] == c:
            return i + 1
        self._fault(i, f"{what} is missing")
        return self._stop(i)

    def _if(self, i: int) -> int:
        self.open.append(("I", i))
        i = self._list(self._then(i + 1, "T", "Then"), "Eek")
        while self.k[i] == "E":
            i = self._list(self._then(i + 1, "T", "Then"), "Eek")
        if self.k[i] == "e":
            i = self._list(i + 1, "k")
        return self._close(i, "k")

    def _loop(self, c: str, i: int) -> int:
        k = self.k
        self.open.append((c, i))
        i += 1
        if c == "L":
            if k[i] == "c":
                if k[i + 1] != "i" or k[i + 2] != "j":
                    self._fault(i + 1, "For Each needs a name and In")
                    i = self._stop(i + 1)
                    i = i if k[i] != "D" else i
                else:
                    i += 3
                i = self._then(i, "D", "Do") if k[i] != "D" else i + 1
            else:
                end = self._slice(i, _assignment)
                if k[end] != "o":
                    self._fault(end, "To is missing")
                    i = self._stop(end)
                else:
                    i = self._then(end + 1, "D", "Do")
        else:
            i = self._then(i, "D", "Do")
        return self._close(self._list(i, "d"), "d")

    def _method(self, i: int) -> int:
        k, c = self.k, self.k[i]
        if any(kind in "PF" for kind, _ in self.open):
            return -1 - i  # a method can't begin within another: the blocks up to the outer method end here
        self.open.append((c, i))
        m = _HEADER.match(k, i)
        if m:
            i = m.end()
        else:
            self._fault(i, "a method's head is not complete")
            i = self._stop(i + 1)
        return self._close(self._list(i, _PARTS[c]), _PARTS[c])


def _pair(s: str) -> tuple[int, str] | None:
    try:
        end = _expect(s, _binary(s, 0, 0), ",")
        end = _binary(s, end, 0)
    except _Fault as e:
        return e.at, e.what
    return None if end == len(s) else (end, "unexpected token in an expression")


#: A method's head: name, parameters with Val and default values, Export.
_HEADER = re.compile(r"[PF]i\((?:(?:&(?:\([insaq,=\-]*\))?)*V?i(?:=[-+]?(?:s+|[naqi]\.*))?(?:,(?:&(?:\([insaq,=\-]*\))?)*V?i(?:=[-+]?(?:s+|[naqi]\.*))?)*)?\)X?")

_PARSER: list[Parser] = []


def module_errors(content: bytes) -> list[tuple[int, str]]:
    """The errors of a module's bytes: UTF-8, a byte order mark allowed."""
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        return [(content[: e.start].count(b"\n") + 1, "not UTF-8")]
    if not _PARSER:
        _PARSER.append(Parser())
    return _PARSER[0].parse(text)


#: Byte order marks and what they say (fixed values).
_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
_DECLARED = re.compile(rb"""<\?xml[^>]*?encoding\s*=\s*["']([A-Za-z][\w.\-]*)["']""")


def xml_errors(content: bytes) -> list[tuple[int, str]]:
    """The error of XML bytes, read by their byte order mark, else by the declared encoding, else as UTF-8. There is at most
    one: a reader of XML must stop at the first, since nothing behind it can be relied on."""
    mark = next((name for m, name in _MARKS if content.startswith(m)), None)
    try:
        if mark == "utf-32":
            content, mark = content.decode("utf-32").encode("utf-8"), "utf-8"
        parser = expat.ParserCreate(mark) if mark else expat.ParserCreate()
        try:
            parser.Parse(content, True)
        except (expat.ExpatError, ValueError, LookupError) as e:
            declared = _DECLARED.match(content)
            if mark or not declared or getattr(e, "code", 18) not in (18,):  # 18: an encoding that expat doesn't have
                raise
            text = content.decode(declared[1].decode("ascii"))
            expat.ParserCreate("utf-8").Parse(text.encode("utf-8"), True)
    except expat.ExpatError as e:
        return [(e.lineno, expat.ErrorString(e.code))]
    except (ValueError, LookupError) as e:
        return [(1, f"can't be decoded: {e}"[:200])]
    return []


RESULT = "file_id bigint, config_id string, file_path string, rel_path string, language string, accepted boolean, n_errors int, first_line int, first_cause string, errors array<struct<line:int,message:string>>"
_CHECKS = {"bsl": module_errors, "xml": xml_errors}


def parse_files(files: DataFrame) -> DataFrame:
    """One row for each scanned version whose rel_path ends in .bsl or .xml (in any letter case), with the columns of
    RESULT: all errors, the first cause and its line, accepted if there is none.

    An empty module is valid, an empty XML file is not; a null content was not scanned and gives no row, and so do other
    extensions and a null rel_path. Repeated rows give their row again. Files are parsed where they lie, without a shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:  # ids travel as text: pandas would turn a column with nulls into floats
        for b in batches:
            found = [_CHECKS[lang](bytes(c)) for lang, c in zip(b["language"], b["content"])]
            out = b[["file_id", "config_id", "file_path", "rel_path", "language"]].copy()
            out["accepted"] = pd.array([not e for e in found], dtype="boolean")
            out["n_errors"] = pd.array([len(e) for e in found], dtype="Int32")
            out["first_line"] = pd.array([e[0][0] if e else None for e in found], dtype="Int32")
            out["first_cause"] = pd.Series([e[0][1] if e else None for e in found], index=out.index, dtype=object)
            out["errors"] = pd.Series([[{"line": n, "message": m} for n, m in e] for e in found], index=out.index, dtype=object)
            yield out

    language = F.lower(F.regexp_extract("rel_path", r"\.([A-Za-z]+)$", 1))
    rows = files.select(F.col("file_id").cast("string").alias("file_id"), "config_id", "file_path", "rel_path", language.alias("language"), "content")
    return rows.filter(F.col("language").isin(*_CHECKS) & F.col("content").isNotNull()).mapInPandas(run, RESULT.replace("file_id bigint", "file_id string")).withColumn("file_id", F.col("file_id").cast("bigint"))


def invalid_rates(parsed: DataFrame) -> DataFrame:
    """versions, invalid and rate per config_id and language, each version once."""
    once = parsed.select("file_id", "config_id", "language", "accepted").distinct()
    return once.groupBy("config_id", "language").agg(
        F.count(F.lit(1)).alias("versions"), F.count_if(~F.col("accepted")).alias("invalid"), F.round(F.count_if(~F.col("accepted")) / F.count(F.lit(1)), 6).alias("rate")
    )


def against_diagnostics(parsed: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """What the validator's findings tell of it: files (by path, without letter case of the drive and kind of slash) per
    language, parse result of any version, and whether an error was reported."""
    path = lambda c: F.lower(F.replace(c, F.lit("\\"), F.lit("/")))
    told = diagnostics.filter(F.lower(F.trim("severity")) == "error").select(path(F.col("file_path")).alias("path")).filter("path is not null").distinct().withColumn("told", F.lit(True))
    files = parsed.groupBy(path(F.col("file_path")).alias("path"), "language").agg(F.bool_and("accepted").alias("accepted"))
    return files.join(told, "path", "left").groupBy("language", "accepted", F.coalesce("told", F.lit(False)).alias("reported")).agg(F.count(F.lit(1)).alias("files"))
