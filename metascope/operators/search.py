"""Search: what a question asks for, and scores of objects, code, modules, forms, commands and subscriptions with their parts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metascope.functions import text as t
from metascope.functions.constants import ANCHOR_PREFIXES, ANCHOR_RIVALS, CODE_EXPANSIONS, CODE_STOPWORDS, CORE_TYPES, LOW_SIGNAL_TYPES, PRIMARY_TYPES, REGISTER_TYPES, STRUCTURE_LOW_TYPES, STRUCTURE_TYPES, VALIDATION_MODULES, VALIDATION_SIGNALS

Parts = list[tuple[str, Column]]


@dataclass(frozen=True)
class Rule:
    """A rule of a domain, given by the caller (Q3, Q4): active if every trigger is among the question's words."""

    name: str
    triggers: tuple[str, ...]
    terms: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    queries: tuple[str, ...] = ()


@dataclass(frozen=True)
class Question:
    """Q1 to Q7: a question and all that follows from its words; worked out once, on the driver."""

    text: str
    rules: tuple[Rule, ...] = ()
    kw: list[str] = field(init=False)
    code_kw: list[str] = field(init=False)
    kind: str | None = field(init=False)
    active: tuple[Rule, ...] = field(init=False)

    def __post_init__(self):
        put = lambda k, v: object.__setattr__(self, k, v)
        put("kw", t.keywords(self.text))
        put("code_kw", t.keywords(self.text, CODE_STOPWORDS))
        put("kind", t.object_type(self.text))
        put("active", tuple(r for r in self.rules if t.alias_overlap(self.kw, r.triggers) == len(set(r.triggers))))

    phrase = property(lambda self: " ".join(self.kw))
    code_phrase = property(lambda self: " ".join(self.code_kw))
    structural = property(lambda self: t.structural_intent(self.text))
    report = property(lambda self: t.report_intent(self.text))
    validation = property(lambda self: t.validation_intent(self.text))
    register = property(lambda self: t.register_intent(self.text, self.kind))
    navigation = property(lambda self: t.navigation_intent(self.text, self.kind))

    def retrieval(self) -> list[str]:
        """Q2, with the queries of active rules."""
        return list(dict.fromkeys([*t.retrieval_queries(self.text), *[q for r in self.active for q in r.queries if not self.kind or not r.types or self.kind in r.types]]))

    def code_retrieval(self) -> list[str]:
        """Q5: Q2 by the words for code, with the queries of active rules and, for a question about checks, the expansions."""
        out = [*t.retrieval_queries(self.text, CODE_STOPWORDS), *[q for r in self.active for q in r.queries]]
        if self.validation:
            n = t.normalize(self.text)
            out += [q for every, some, queries in CODE_EXPANSIONS if all(x in n for x in every) and (not some or any(x in n for x in some)) for q in queries]
        return list(dict.fromkeys(out))

    @property
    def anchors(self) -> list[str]:
        """the question's words that begin as an anchor does, or an anchor as they."""
        return [k for k in self.kw if any(k.startswith(a) or a.startswith(k) for a in ANCHOR_PREFIXES)]

    def lookups(self) -> list[str]:
        """Q1, with the queries of active rules."""
        return list(dict.fromkeys([*t.lookup_queries(self.text), *[q for r in self.active for q in r.queries if not self.kind or not r.types or self.kind in r.types]]))


#: Weights of the parts of an object's score: of the name and the synonym (overlap, specificity), of the text, of the type and of each intent.
PROFILES = {
    "vector": {"name": (1.8, 1.6), "synonym": (1.5, 1.1), "document": 0.5, "type": (0.6, -0.2), "structure": (0.8, -0.6), "navigation": (0.9, -1.4), "register": (2.0, -1.2, -1.8)},
    "lexical": {"name": (2.2, 2.0), "synonym": (1.6, 1.2), "document": 0.4, "type": (0.6, 0.0), "structure": (1.0, -0.8), "navigation": (1.2, -1.8), "register": (2.2, -1.4, -2.2)},
}


def prepared(df: DataFrame, *columns: str) -> DataFrame:
    """Adds each text column's normalized form and stems as _n_<column> and _st_<column>, computed once for all parts of a
    score. They come out of a generator, through which neither filters nor projections are merged: else a filter on the
    score would bring them in again for every mention."""
    n = df.select("*", F.inline(F.array(F.struct(*[t.normalize_col(F.col(c)).alias(f"_n_{c}") for c in columns]))))
    return n.select("*", F.inline(F.array(F.struct(*[t.stems_of(F.col(f"_n_{c}")).alias(f"_st_{c}") for c in columns]))))


def _like(column: str, query: str) -> Column:
    return t.identifier_of(F.col(f"_n_{column}"), F.col(f"_st_{column}"), query)


def _same(column: str, name: str) -> Column:
    return F.col(f"_n_{column}") == t.normalize(name)


def _text(column: str, kw: list[str], phrase: str, over: float, special: float = 0.0, label: str | None = None) -> Parts:
    st, label = F.col(f"_st_{column}"), label or column
    out = [(f"{label}_overlap", t.overlap_col(st, kw, phrase) * over)]
    return [*out, (f"{label}_specificity", t.specificity_col(st, kw, phrase) * special)] if special else out


def _one_of(c: Column, yes: tuple[str, ...], a: float, no: tuple[str, ...], b: float) -> Column:
    return F.when(c.isin(*yes), a).when(c.isin(*no), b).otherwise(0.0)


def object_parts(q: Question, profile: str, explain: bool = False) -> Parts:
    """F1, F2: the parts of an object's score besides its cosine. Needs _st_object_name, _st_synonym, _st_document."""
    w, kind = PROFILES[profile], F.col("object_type")
    parts = _text("object_name", q.kw, q.phrase, *w["name"], "name") + _text("synonym", q.kw, q.phrase, *w["synonym"]) + _text("document", q.kw, q.phrase, w["document"])
    if q.kind:
        parts.append(("type", F.when(kind == q.kind, w["type"][0]).otherwise(w["type"][1])))
    if q.structural:
        parts.append(("structure", _one_of(kind, STRUCTURE_TYPES, w["structure"][0], STRUCTURE_LOW_TYPES, w["structure"][1])))
    if q.navigation and not q.kind:
        parts.append(("navigation", _one_of(kind, PRIMARY_TYPES, w["navigation"][0], LOW_SIGNAL_TYPES, w["navigation"][1])))
    if q.register:
        a, b, c = w["register"]
        parts.append(("register", F.when(kind.isin(*REGISTER_TYPES), a).when(kind.isin("Catalog", "Subsystem", "Role"), b).when(kind.isin(*LOW_SIGNAL_TYPES), c).otherwise(0.0)))
    return parts + anchor_parts(q) + rule_parts(q, F.array_join(F.concat("_st_object_name", "_st_synonym", "_st_document"), " "), kind, 0.55, 0.9, 0.8)


def rule_parts(q: Question, joined: Column, kind: Column, each: float, two: float, typed: float) -> Parts:
    """for each active rule, what its terms in the text and the type are worth."""
    parts = []
    for r in q.active:
        n = sum((F.contains(joined, F.lit(x)).cast("int") for x in r.terms), F.lit(0))
        parts.append((f"rule_{r.name}", n * each + F.when(n >= 2, two).otherwise(0.0) + (F.when(kind.isin(*r.types), typed).otherwise(0.0) if r.types else F.lit(0.0))))
    return parts


def anchor_parts(q: Question) -> Parts:
    """how many of the question's anchors an object's name and synonym hold; nothing without anchors."""
    if not q.anchors:
        return []
    text = F.array_join(F.concat("_st_object_name", "_st_synonym"), " ")
    holds = lambda x: F.contains(text, F.lit(x))
    n = sum((holds(a).cast("int") for a in q.anchors), F.lit(0))
    score = n * 0.7 + F.when(n >= 2, 1.2).when((n == 1) & F.lit(len(q.anchors) == 1), 0.5).otherwise(0.0) - F.when(n == 0, min(1.4, len(q.anchors) * 0.35)).otherwise(0.0)
    for word, rival, with_word, with_rival in ANCHOR_RIVALS:
        if any(a.startswith(word) for a in q.anchors):
            score += F.when(holds(word), with_word).when(holds(rival), with_rival).otherwise(0.0)
    return [("anchors", F.when(text != "", score).otherwise(0.0))]


def signal_parts(q: Question, signals=VALIDATION_SIGNALS, modules=VALIDATION_MODULES) -> Parts:
    """F8: for a question about checks, what each signal in a method's name, path and text is worth. Needs _n_method_name,
    _n_module_path, _n_document and module_type; other signals and modules may be given."""
    if not q.validation:
        return []
    asked_in, where = t.normalize(q.text), {"method": F.col("_n_method_name"), "document": F.col("_n_document")}
    where["any"] = F.concat_ws(" ", "_n_method_name", "_n_module_path", "_n_document")
    parts = []
    for label, field_, phrases, weight, asked, otherwise in signals:
        if asked in asked_in:
            parts.append((f"signal_{label}", F.when(t.contains_any_col(where[field_], phrases), weight).otherwise(otherwise)))
    kind = None
    for types, begins, weight in modules:
        test = F.col("module_type").isin(*types) if types else F.col("_n_module_path").startswith(begins)
        kind = F.when(test, weight) if kind is None else kind.when(test, weight)
    return [*parts, ("signal_module", kind.otherwise(0.0))] if kind is not None else parts


def lookup_parts(q: Question, query: str, explain: bool = False) -> Parts:
    """an object's score as the answer to one lookup query."""
    kind = F.col("object_type")
    parts = [("base", F.lit(1.5)), ("name", _like("object_name", query) * 1.8), ("synonym", _like("synonym", query) * 1.4)]
    if q.kind:
        parts.append(("type", F.when(kind == q.kind, 0.4).otherwise(0.0)))
    if q.structural:
        parts.append(("structure", F.when(kind.isin(*CORE_TYPES), 2.0).otherwise(0.0)))
    if q.navigation and not (explain and q.kind):
        parts.append(("navigation", F.when(kind.isin(*CORE_TYPES), 4.0).when(kind.isin(*PRIMARY_TYPES), 1.5).when(kind.isin(*LOW_SIGNAL_TYPES), -2.0).otherwise(0.0)))
    if q.register:
        parts.append(("register", F.when(kind.isin(*REGISTER_TYPES), 3.0).when(kind.isin("Catalog", "Subsystem", "Role"), -3.0).when(kind.isin(*LOW_SIGNAL_TYPES), -2.5).otherwise(0.0)))
    return parts + anchor_parts(q)


def code_parts(q: Question, profile: str) -> Parts:
    """the parts of a method's score besides its cosine. Needs _st_method_name, _st_module_path, _st_document."""
    kw, ph = q.code_kw, q.code_phrase
    name, module = t.overlap_col(F.col("_st_method_name"), kw, ph), t.overlap_col(F.col("_st_module_path"), kw, ph)
    if profile == "vector":
        parts = _text("method_name", kw, ph, 1.8, 1.3) + _text("module_path", kw, ph, 1.5, 1.1) + _text("document", kw, ph, 0.9)
        if kw:
            best = F.greatest(name, module, t.overlap_col(F.col("_st_document"), kw, ph))
            parts.append(("far_from_question", F.when(best < 0.45, -1.8).when(best < 0.8, -0.8).otherwise(0.0)))
    else:
        parts = _text("method_name", kw, ph, 2.0, 1.4) + _text("module_path", kw, ph, 2.4, 1.4)
        if kw:
            parts.append(("too_little", F.when(name + module < 0.25, -99.0).otherwise(0.0)))
    if not q.report:
        parts.append(("report", F.when(F.col("module_type") == "Reports", -1.6 if profile == "vector" else -1.8).otherwise(0.0)))
    joined = F.array_join(F.concat("_st_module_path", "_st_method_name", "_st_document"), " ")
    return parts + signal_parts(q) + rule_parts(q, joined, F.col("module_type"), 0.5, 0.8, 0.6)


def module_parts(name: str, module_type: str | None = None) -> Parts:
    """F12. Like all scores below, over prepared() columns: module_path, module_name."""
    parts = [("path", _like("module_path", name) * 1.8), ("name", _like("module_name", name) * 2.0)]
    if module_type:
        parts.append(("type", F.when(F.col("module_type") == module_type, 0.7).otherwise(-0.3)))
    return [*parts, ("exact", F.when(_same("module_path", name), 5.0).when(_same("module_name", name), 4.2).otherwise(0.0))]


def module_vector_parts(q: Question) -> Parts:
    """a module's score besides its cosine. Needs the stems of document."""
    return [("path", _like("module_path", q.text) * 1.4), ("name", _like("module_name", q.text) * 1.6), *_text("document", q.kw, q.phrase, 0.8)]


def object_lookup_parts(name: str, kind: str | None = None) -> Parts:
    """An object by its name; its very id is above all others."""
    parts = [("name", _like("object_name", name) * 1.8), ("synonym", _like("synonym", name) * 1.4)]
    if kind:
        parts.append(("type", F.when(F.col("object_type") == kind, 0.4).otherwise(0.0)))
        parts.append(("id", F.when((F.col("object_type") == kind) & (F.col("object_name") == name), 999.0).otherwise(0.0)))
    return [*parts, ("exact", F.when(_same("object_name", name), 4.5).otherwise(0.0))]


def form_parts(name: str, owner: str | None = None, owner_type: str | None = None) -> Parts:
    """form_name, owner_name, owner_object_type."""
    parts = [("form", _like("form_name", name) * 2.2), ("exact", F.when(_same("form_name", name), 4.5).otherwise(0.0))]
    if owner:
        parts.append(("owner", _like("owner_name", owner) * 1.5))
    if owner_type:
        parts.append(("owner_type", _like("owner_object_type", owner_type) * 1.2 + F.when(F.col("owner_object_type") == owner_type, 0.4).otherwise(0.0)))
    return parts


def owner_parts(owner: str, owner_type: str | None = None) -> Parts:
    """F17, forms by their owner."""
    parts = [("owner", _like("owner_name", owner) * 2.0), ("exact", F.when(_same("owner_name", owner), 4.0).otherwise(0.0))]
    if owner_type:
        parts.append(("owner_type", _like("owner_object_type", owner_type) * 1.4 + F.when(F.col("owner_object_type") == owner_type, 0.6).otherwise(0.0)))
    return parts


def method_parts(name: str, module_path: str | None = None, module_type: str | None = None, vector: bool = False) -> Parts:
    """method_name, module_path."""
    parts = [("method", _like("method_name", name) * (2.5 if vector else 2.2)), ("exact", F.when(F.lower("method_name") == name.lower(), 5.0).otherwise(0.0))]
    if module_path:
        parts.append(("module", _like("module_path", module_path) * (1.6 if vector else 1.5)))
    if module_type:
        parts.append(("type", F.when(F.col("module_type") == module_type, 0.5).otherwise(0.0)))
    return parts


def command_parts(q: Question) -> Parts:
    """F13. Needs the stems of title, tooltip, form_name and document."""
    parts = [("name", _like("command_name", q.text) * 1.8), ("action", _like("action", q.text) * 1.4)]
    for c, w in (("title", 1.2), ("tooltip", 0.8), ("form_name", 0.9), ("document", 0.5)):
        parts += _text(c, q.kw, q.phrase, w)
    return parts


def subscription_parts(q: Question) -> Parts:
    """F14. Needs the stems of synonym, sources_text and document."""
    parts = [("name", _like("subscription_name", q.text) * 1.8), ("handler", _like("handler", q.text) * 1.5), ("event", _like("event", q.text) * 1.2)]
    for c, w in (("synonym", 1.2), ("sources_text", 1.0), ("document", 0.5)):
        parts += _text(c, q.kw, q.phrase, w)
    return parts


def scored(df: DataFrame, parts: Parts, vector: Column | None = None, explain: bool = False) -> DataFrame:
    """`df` with score, the sum of all parts; with explain, also components: those of 0.05 or more either way, as
    (label, value). Stems columns are dropped."""
    every = [*([("vector", vector)] if vector is not None else []), *parts]
    out = df.withColumn("_parts", F.array(*[F.struct(F.lit(n).alias("label"), v.cast("double").alias("value")) for n, v in every]))
    out = out.withColumn("score", F.round(F.aggregate("_parts", F.lit(0.0), lambda acc, p: acc + p["value"]), 6))
    if explain:
        out = out.withColumn("components", F.filter("_parts", lambda p: F.abs(p["value"]) >= 0.05))
    return out.drop("_parts", *[c for c in df.columns if c.startswith(("_st_", "_n_"))])


def top(df: DataFrame, limit: int, *ties: str, least: float | None = None) -> DataFrame:
    """the best rows; a limit is what the report asks for. Runs as TakeOrdered: each task keeps `limit` rows."""
    rows = df if least is None else df.filter(F.col("score") >= least)
    return rows.orderBy(F.desc("score"), *ties).limit(limit)
