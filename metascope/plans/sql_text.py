"""The text functions as SQL expressions, from the same constants, for the SQL side of the queries."""

from __future__ import annotations

from collections.abc import Iterable

from metascope.functions.constants import STOPWORDS, SUFFIXES, TYPE_WORDS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def array(items: Iterable[str]) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def normalized(x: str) -> str:
    """RE2 has no lookaround; each border is split by a pass of its own."""
    out = f"replace(coalesce({x}, ''), '_', ' ')"
    for a, b in (("[a-zа-яё0-9]", "[A-ZА-ЯЁ]"), ("[A-ZА-ЯЁ]", "[A-ZА-ЯЁ][a-zа-яё]"), ("[A-Za-z]", "[А-Яа-яЁё]"), ("[А-Яа-яЁё]", "[A-Za-z]")):
        out = rf"regexp_replace({out}, '({a})({b})', '\1 \2', 'g')"
    return f"replace(lower(array_to_string(regexp_extract_all({out}, '[A-Za-zА-Яа-яЁё0-9_]+'), ' ')), 'ё', 'е')"


def stem(t: str) -> str:
    cases = " ".join(f"WHEN ends_with({t}, {q(s)}) AND length({t}) >= {len(s) + 4} THEN left({t}, length({t}) - {len(s)})" for s in SUFFIXES)
    return f"CASE WHEN length({t}) > 4 AND regexp_full_match({t}, '[а-яё]+') THEN CASE {cases} ELSE {t} END ELSE {t} END"


def tokens(x: str) -> str:
    return f"list_filter(string_split({normalized(x)}, ' '), lambda t: t <> '')"


def stems(x: str) -> str:
    return f"list_transform({tokens(x)}, lambda t: {stem('t')})"


def distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


def keywords_of(stems_: str, stopwords: Iterable[str] = STOPWORDS) -> str:
    """Of a column of stems."""
    return f"list_filter({stems_}, lambda t, i: (length(t) > 1 OR regexp_full_match(t, '[0-9]')) AND NOT list_contains({array(sorted(stopwords))}, t) AND list_position({stems_}, t) = i)"


def object_type(norm: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({norm}, {q(f'(^|[^A-Za-zА-Яа-яЁё0-9_])({chr(124).join(ws)})([^A-Za-zА-Яа-яЁё0-9_]|$)')}) THEN {q(k)}" for k, ws in TYPE_WORDS.items())
    return f"CASE {cases} END"


def any_in(norm: str, phrases: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({norm}, {q(p)})" for p in phrases) + ")"


def akin_count(words: str, prefixes: Iterable[str]) -> str:
    return f"len(list_filter({array(prefixes)}, lambda p: len(list_filter({words}, lambda w: starts_with(w, p) OR starts_with(p, w))) > 0))"


def overlap(st: str, kw: list[str], phrase: str = "") -> str:
    """Of a column of stems."""
    joined = f"array_to_string({st}, ' ')"
    exact = " + ".join(f"list_contains({st}, {q(k)})::INT" for k in kw)
    part = " + ".join(f"contains({joined}, {q(k)})::INT" for k in kw)
    more = f" + CASE WHEN contains({joined}, {q(phrase)}) THEN 0.8::DOUBLE ELSE 0 END" if len(phrase) > 2 else ""
    return f"CASE WHEN {joined} = '' THEN 0.0::DOUBLE ELSE 0.8::DOUBLE * ({exact}) / {len(kw)}::DOUBLE + 0.12::DOUBLE * ({part}){more} END"


def specificity(st: str, kw: list[str], phrase: str = "") -> str:
    joined = f"array_to_string({st}, ' ')"
    base = f"CASE WHEN {joined} = {q(phrase)} THEN 2.2::DOUBLE WHEN starts_with({joined}, {q(phrase + ' ')}) OR ends_with({joined}, {q(' ' + phrase)}) THEN 1.0 WHEN contains({joined}, {q(phrase)}) THEN 0.4 ELSE 0.0 END"
    hits = " + ".join(f"list_contains({st}, {q(k)})::INT" for k in kw)
    return f"CASE WHEN {joined} = '' THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, {base} + 0.12::DOUBLE * ({hits}) - least(0.6::DOUBLE, 0.08::DOUBLE * greatest(0, len({st}) - {len(kw)}))) END"


def identifier(x: str, st: str, query: str) -> str:
    """x: the normalized text, st: its stems."""
    from metascope.functions.text import keywords, normalize

    b = normalize(query)
    cb, kw = b.replace(" ", ""), keywords(query, ())
    ca = f"replace({x}, ' ', '')"
    base = f"CASE WHEN {ca} = {q(cb)} THEN 5.0::DOUBLE WHEN {x} = {q(b)} THEN 4.0 WHEN starts_with({ca}, {q(cb)}) OR starts_with({q(cb)}, {ca}) THEN 2.3 WHEN contains({x}, {q(b)}) OR contains({q(b)}, {x}) THEN 1.4 ELSE 0.0 END"
    return f"CASE WHEN {x} = '' THEN 0.0::DOUBLE ELSE {base} + 1.8::DOUBLE * ({overlap(st, kw, ' '.join(kw))}) + 1.2::DOUBLE * ({specificity(st, kw, ' '.join(kw))}) END"
