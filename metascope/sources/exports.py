"""Export trees as tables: scanning, filters, identities that follow from paths, state caches and changed files."""

from __future__ import annotations

import json
import os
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metascope.functions.constants import FOLDERS, SCHEMA_VERSION


def slashes(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def read_export(spark: SparkSession, root: str, config_id: str) -> DataFrame:
    """An export folder as export_files: config_id, file_path, rel_path, mtime, length, content. The folder may lie in any
    file system that Spark reads; contents are read by the tasks that need them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{bsl,xml,BSL,XML}").load(root)
    path = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    base = root.rstrip("/") + "/"
    return files.select(F.lit(config_id).alias("config_id"), path.alias("file_path"), F.substring_index(path, base, -1).alias("rel_path"), F.col("modificationTime").cast("timestamp_ntz").alias("mtime"), "length", "content")


def indexable(files: DataFrame, index_filter: str | None = None) -> DataFrame:
    """The files that are indexed. .bsl and .xml only; without .git, ConfigDumpInfo.xml, Configuration.xml, XML under
    Templates, and whatever lies in a nested export, that is below a folder other than the root that holds a
    Configuration.xml. index_filter: a part of the path."""
    rel = slashes(F.col("rel_path"))
    name = F.substring_index(rel, "/", -1)
    f = files.withColumns({"_rel": rel, "_name": name, "_folder": F.regexp_replace(rel, "[^/]*$", "")})
    roots = f.filter((F.col("_name") == "Configuration.xml") & (F.col("_folder") != "")).select(F.col("config_id").alias("_c"), F.col("_folder").alias("_root")).distinct()
    keep = F.lower("_name").rlike(r"\.(bsl|xml)$") & ~F.col("_name").isin("ConfigDumpInfo.xml", "Configuration.xml") & ~F.col("_rel").rlike(r"(^|/)\.git/")
    keep = keep & ~(F.lower("_name").endswith(".xml") & F.col("_rel").rlike("(^|/)Templates/"))
    if index_filter:
        keep = keep & F.contains(F.col("file_path"), F.lit(index_filter))
    # each folder above a file is an equality key, so that nested roots are found without comparing all pairs
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("_rel", "/")) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(F.split("_rel", "/"), F.lit(1), i), "/"), F.lit("/")))
    kept = f.filter(keep).withColumn("_above", above)
    nested = kept.select(F.col("config_id").alias("_k"), F.col("_rel").alias("_r"), F.explode("_above").alias("_a")).join(roots, (F.col("_k") == F.col("_c")) & (F.col("_a") == F.col("_root")), "left_semi").select("_k", "_r").distinct()
    return kept.join(nested, (F.col("config_id") == F.col("_k")) & (F.col("_rel") == F.col("_r")), "left_anti").select(*files.columns)


def _parts(rel: Column) -> Column:
    return F.split(slashes(rel), "/")


def is_form_xml(rel: Column) -> Column:
    """Forms/X.xml, Forms/X/Ext/Form.xml or CommonForms/X/Ext/Form.xml."""
    p = _parts(rel)
    n, at = F.size(p), F.array_position(p, "Forms")
    body = (F.element_at(p, -1) == "Form.xml") & (F.try_element_at(p, F.lit(-2)) == "Ext")
    in_forms = (n == at + 1) | ((n >= at + 3) & body)
    common = (n >= 4) & (F.element_at(p, 1) == "CommonForms") & body
    return F.lower(rel).endswith(".xml") & F.coalesce(F.when(at > 0, in_forms).otherwise(common), F.lit(False))


def folder_type(folder: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv])
    return F.coalesce(names[folder], folder)


def form_identity(rel: Column) -> Column:
    """struct(form_name, owner_type, owner_object_type, owner_name) of a form's path."""
    p = _parts(rel)
    n, at = F.size(p), F.array_position(p, "Forms")
    get = lambda i: F.coalesce(F.try_element_at(p, i.cast("int")), F.lit(""))
    stem = F.regexp_replace(get(F.lit(-1)), r"\.[^.]*$", "")
    forms, common, other = at > 0, (at == 0) & (n >= 2) & (get(F.lit(1)) == "CommonForms"), (at == 0) & (n >= 2)
    part = get(at + 1)
    name = F.when(forms & (n > at), F.when(F.lower(part).endswith(".xml"), F.regexp_replace(part, r"\.[^.]*$", "")).otherwise(part)).when(common, get(F.lit(2))).otherwise(stem)
    kind = F.when(forms & (at >= 3), get(F.greatest(at - 2, F.lit(1)))).when(forms & (at == 2), get(F.lit(1))).when(other, get(F.lit(1))).otherwise("")
    owner = F.when(forms & (at >= 3), get(F.greatest(at - 1, F.lit(1)))).when(forms, "").when(other, get(F.lit(2))).otherwise("")
    return F.struct(name.alias("form_name"), kind.alias("owner_type"), folder_type(kind).alias("owner_object_type"), owner.alias("owner_name"))


def module_identity(rel: Column) -> Column:
    """struct(module_type, module_name, module_path) of a module's path."""
    p = _parts(rel)
    n, at = F.size(p), F.array_position(p, "Forms")
    get = lambda i: F.coalesce(F.try_element_at(p, i.cast("int")), F.lit(""))
    kind = get(F.lit(1))
    name = F.when(n >= 2, get(F.lit(2))).otherwise(F.regexp_replace(get(F.lit(-1)), r"\.[^.]*$", ""))
    form = (n >= 3) & (get(F.lit(-3)) == "Ext") & (get(F.lit(-2)) == "Form") & (get(F.lit(-1)) == "Module.bsl")
    file, base = get(F.lit(-1)), F.concat_ws(".", kind, name)
    path = (
        F.when((at > 0) & (n > at) & form, F.concat(base, F.lit(".Forms."), get(at + 1), F.lit(".FormModule")))
        .when((n >= 5) & (kind == "CommonForms") & form, F.concat(base, F.lit(".FormModule")))
        .when(F.contains(file, F.lit("ObjectModule.bsl")), F.concat(base, F.lit(".МодульОбъекта")))
        .when(F.contains(file, F.lit("ManagerModule.bsl")), F.concat(base, F.lit(".МодульМенеджера")))
        .otherwise(base)
    )
    return F.struct(kind.alias("module_type"), name.alias("module_name"), path.alias("module_path"))


def changed_files(files: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """Files whose mtime differs from the state's, exactly, or that the state doesn't have; all with force. Of several
    state rows of a file the one with the latest mtime holds."""
    if force:
        return files
    known = state.select(F.col("config_id").alias("_c"), slashes(F.col("rel_path")).alias("_p"), F.col("mtime").alias("_m")).groupBy("_c", "_p").agg(F.max("_m").alias("_m"))
    j = files.join(known, (F.col("config_id") == F.col("_c")) & (slashes(F.col("rel_path")) == F.col("_p")), "left")
    return j.filter(F.col("_p").isNull() | ~F.col("mtime").eqNullSafe(F.col("_m"))).select(*files.columns)


def schema_gate(state: DataFrame, configs: DataFrame, version: int = SCHEMA_VERSION) -> DataFrame:
    """S3: for each configuration whether its own cache forces a full rebuild: it has rows of another version or of none."""
    own = configs.select("config_id", "cache_file").filter("config_id is not null").distinct()
    stale = state.join(own.select("cache_file").distinct(), "cache_file", "left_semi").groupBy("config_id", "cache_file").agg(F.count(F.lit(1)).alias("cached"), F.count_if(~F.col("schema_version").eqNullSafe(F.lit(version))).alias("stale"))
    return own.join(stale, ["config_id", "cache_file"], "left").select("config_id", F.coalesce("cached", F.lit(0)).alias("cached"), F.coalesce("stale", F.lit(0)).alias("stale"), (F.coalesce("stale", F.lit(0)) > 0).alias("rebuild"))


def export_counts(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files on disk per configuration by class, and how many of them changed or are missing in the state."""
    known = state.select(F.col("config_id").alias("_c"), slashes(F.col("rel_path")).alias("_p"), F.col("mtime").alias("_m")).distinct()
    f = files.select("config_id", slashes(F.col("rel_path")).alias("rel"), "mtime").groupBy("config_id", "rel").agg(F.max("mtime").alias("mtime"))
    same = [F.col("config_id") == F.col("_c"), F.col("rel") == F.col("_p")]
    j = f.join(known.select("_c", "_p").distinct(), same, "left").withColumn("_known", F.col("_p").isNotNull()).drop("_c", "_p")
    j = j.join(known, [*same, F.col("mtime") == F.col("_m")], "left")
    low = F.lower("rel")
    return j.groupBy("config_id").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(low.endswith(".bsl")).alias("bsl"), F.count_if(low.endswith(".xml")).alias("xml"), F.count_if(is_form_xml(F.col("rel"))).alias("form_xml"),
        F.count_if(~F.col("_known")).alias("unknown"), F.count_if(F.col("_known") & F.col("_p").isNull()).alias("changed"),
    )


def line_snippet(texts: DataFrame, key: str, column: str, first: int, last: int) -> DataFrame:
    """The lines first to last (from 1, both included) of each text, numbered: key, line_no, line. Ends are clamped;
    first > last is taken as first = last."""
    lo, hi = max(1, first), max(max(1, first), last)
    lines = F.split(F.replace(F.replace(F.col(column), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n")
    cut = F.slice(lines, F.lit(lo), F.lit(hi - lo + 1))
    return texts.filter(F.col(column).isNotNull()).select(key, F.posexplode(cut).alias("_i", "line")).select(key, (F.col("_i") + lo).alias("line_no"), "line")


def resolve_inside(root: str, path: str) -> str:
    """The real path of `path` below `root`; raises ValueError if it leads out or isn't there."""
    base = os.path.realpath(root)
    full = os.path.realpath(path if os.path.isabs(path) else os.path.join(base, path))
    if full != base and not full.startswith(base + os.sep):
        raise ValueError(f"{path} lies outside the export")
    if not os.path.exists(full):
        raise ValueError(f"{path} doesn't exist")
    return full


def modules_under(files: DataFrame, path: str, most: int | None = None) -> DataFrame:
    """The modules at or below a path, in order; `most` of them if given, as the report asks."""
    p = path.replace("\\", "/").strip("/")
    rel = slashes(F.col("rel_path"))
    hit = indexable(files).filter(F.lower(rel).endswith(".bsl") & ((F.lit(p) == "") | (rel == p) | rel.startswith(p + "/")))
    return hit.orderBy("rel_path").limit(most) if most is not None else hit


def git_changed(folder: str, timeout: int = 30) -> list[str]:
    """Modules that git reports as changed below a folder: the new names of renamed ones, sorted, once each."""
    out = subprocess.run(["git", "-C", folder, "status", "--porcelain", "-z", "--untracked-files=all"], capture_output=True, timeout=timeout, check=True).stdout.decode("utf-8", "replace")
    names, entries = set(), iter(out.split("\0"))
    for entry in entries:
        if len(entry) > 3:
            names.add(entry[3:])
            if entry[0] in "RC":
                next(entries, None)  # the old name follows
    return sorted(n for n in names if n.lower().endswith(".bsl"))


def read_registry(text: str) -> list[dict]:
    """The configurations of a registry, {"configs": [...]} or a bare list; none if it isn't valid JSON."""
    try:
        data = json.loads(text)
    except ValueError:
        return []
    items = data.get("configs", []) if isinstance(data, dict) else data
    return [x for x in items if isinstance(x, dict)] if isinstance(items, list) else []
