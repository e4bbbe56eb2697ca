import os
import subprocess
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from metascope import config
from metascope.plans.export_queries import QUERIES
from metascope.sources import descriptors, exports, modules

MODULE = """\ufeff// Модуль
// описание

// первый
// метод
&НаСервере
&После("Цель")
Процедура Первый(А)
\tСообщить("http://x//y"); // Вызов(1)
\tОбщий.Сделать(1); Второй();
\tСправочники.Товары.Найти();
КонецПроцедуры
&НаКлиенте

Функция Второй()
\tВозврат 1;
EndFunction
Процедура Открытая()
"""
SUBSCRIPTION = """<Meta xmlns:v8="urn:c"><EventSubscription uuid="u1"><Properties><Name>BeforeWriteProducts</Name><Synonym><v8:item><v8:lang>ru</v8:lang><v8:content>Перед записью</v8:content></v8:item></Synonym>
<Comment>c</Comment><Source><v8:Type>CatalogRef.Products</v8:Type><v8:Type>CatalogRef.Products</v8:Type><v8:TypeSet>DocumentRef.Sales</v8:TypeSet></Source><Event>BeforeWrite</Event><Handler>CommonModule.ProductsEvents.BeforeWrite</Handler></Properties></EventSubscription></Meta>"""
CATALOG = """<Meta xmlns:v8="urn:c"><Catalog><Properties><Name>Товары</Name><Synonym><v8:item><v8:content>Товар</v8:content></v8:item></Synonym><Comment/></Properties><ChildObjects>
<Attribute><Properties><Name>Вид</Name><Type><v8:Type>cfg:CatalogRef.Виды</v8:Type><v8:Type>xs:string</v8:Type></Type></Properties></Attribute>
<TabularSection><Properties><Name>Состав</Name></Properties><ChildObjects><Attribute><Properties><Name>Часть</Name><Type><v8:Type>cfg:DocumentRef.Приход</v8:Type></Type></Properties></Attribute></ChildObjects></TabularSection>
<Dimension><Properties><Name>Изм</Name><Type><v8:Type>cfg:EnumRef.Цвета</v8:Type></Type></Properties></Dimension><Resource><Properties><Name>Рес</Name></Properties></Resource></ChildObjects></Catalog></Meta>"""
FORM = """<Form><AutoCommandBar name="Панель" id="-1"><ChildItems><Button name="Кнопка" id="1"><CommandName>Form.Command.Сохранить</CommandName></Button></ChildItems></AutoCommandBar>
<Events><Event name="OnOpen">ПриОткрытии</Event></Events><ChildItems><UsualGroup name="Группа" id="2"><Visible>false</Visible><ChildItems><InputField name="Поле" id="3"><DataPath>Объект.Поле</DataPath><Events><Event name="OnChange">ПриИзменении</Event></Events></InputField></ChildItems></UsualGroup></ChildItems>
<Commands><Command name="Сохранить"><Title><v8 xmlns="">Сохранить всё</v8></Title><Action>Сохранить</Action></Command></Commands></Form>"""


def test_methods_with_comments_and_annotations():
    first, second = modules.split_methods(modules.read_text(MODULE.encode()))
    assert (first["method_name"], first["start_line"], first["end_line"], first["annotation"], first["target_method"]) == ("Первый", 8, 12, "after", "Цель")
    assert first["body"].startswith('// первый\n// метод\n&НаСервере\n&После("Цель")\nПроцедура')
    assert modules.split_methods(modules.read_text(MODULE.encode()), True)[0]["body"].startswith("// первый// метод&НаСервере")
    assert (second["start_line"], second["annotation"], second["body"].startswith("Функция")) == (15, "", True)


@pytest.mark.parametrize(
    "text,errors,warnings",
    [
        ("Функция А()\nВозврат 1;\nКонецФункции\nПроцедура Б()\nКонецПроцедуры", 0, 0), ("Функция А()\nКонецФункции", 0, 1), ("Процедура А()\nВозврат 1;\nКонецПроцедуры", 1, 0), ("&Чужая\n#Область Х\n#Если А Тогда\nПроцедура А()", 3, 1),
        ("Процедура А()\nКонецПроцедуры\nProcedure а()\nEndProcedure", 1, 0), ("&НаСервере\nА = 1;", 0, 1), ("Процедура А()\nПроцедура Б()\nКонецПроцедуры\nКонецПроцедуры", 1, 0), ("Процедура А()\nКонецФункции", 1, 0), ("КонецПроцедуры\n#EndIf\n#КонецОбласти", 3, 0),
        ("Процедура А()\nВозврат; // 1\nКонецПроцедуры\n&НаКлиенте", 0, 1), ("", 0, 0),
    ],
)
def test_structure(text, errors, warnings):
    found = [s for s, _, _ in modules.structure_issues(text)]
    assert (found.count("error"), found.count("warning")) == (errors, warnings)


def test_calls_usages_and_references(spark):
    df = spark.createDataFrame([(modules.read_text(MODULE.encode()), "CatalogRef.А, cfg:OtherRef.Б")], "body string, x string")
    r = df.select(modules.call_candidates(F.col("body")), modules.metadata_usages(F.col("body")), modules.type_references(F.col("x"))).first()
    assert {tuple(c) for c in r[0]} >= {("qualified", "Общий", "Сделать"), ("local", "", "Второй")}
    assert not any(c["method_name"] == "Вызов" for c in r[0])
    assert [tuple(u) for u in r[1]] == [("Справочники", "Catalog", "Товары")]
    assert [tuple(x) for x in r[2]] == [("CatalogRef", "Catalog", "А"), ("OtherRef", "Other", "Б")]


def test_descriptors():
    s = descriptors.parse_subscription(SUBSCRIPTION.encode())
    assert (s["subscription_name"], s["sources"], s["handler_module"], s["handler_method"], s["uuid"]) == ("BeforeWriteProducts", ["CatalogRef.Products", "DocumentRef.Sales"], "CommonModule.ProductsEvents", "BeforeWrite", "u1")
    assert descriptors.parse_subscription(b"<Meta>") is None and descriptors.parse_subscription(b"<Meta><Catalog/></Meta>") is None and descriptors.parse_object(b"<Meta/>") is None
    o = descriptors.parse_object(CATALOG.encode())
    assert (o["object_type"], o["object_name"], o["synonym"]) == ("Catalog", "Товары", "Товар")
    assert [(r["section"], r["container"], r["source"], r["target_type"], r["target_name"]) for r in o["refs"]] == [("attributes", "", "Вид", "Catalog", "Виды"), ("tabular_section", "Состав", "Часть", "Document", "Приход"), ("dimensions", "", "Изм", "Enum", "Цвета")]
    assert "  - Вид (cfg:CatalogRef.Виды, xs:string): " in o["document"] and "Табличная часть: Состав ()" in o["document"]
    f = descriptors.parse_form(FORM.encode(), {"form_name": "Ф", "owner_type": "Catalogs", "owner_object_type": "Catalog", "owner_name": "Товары"})
    assert [(e["element_id"], e["parent_element_id"], e["depth"], e["visible"]) for e in f["elements"]] == [("-1", "", 0, True), ("1", "-1", 1, True), ("2", "", 0, False), ("3", "2", 1, True)]
    assert f["elements"][1]["command_ref"] == "Сохранить" and f["commands"][0]["title"] == "Сохранить всё"
    assert [(e["event"], e["handler"], e["source_name"]) for e in f["events"]] == [("OnOpen", "ПриОткрытии", ""), ("OnChange", "ПриИзменении", "Поле")]
    assert descriptors.parse_form(b"<Form>", {}) is None


FILES = "config_id string, file_path string, rel_path string, file_id bigint, mtime timestamp_ntz, content binary"


def files(spark, rows):
    return spark.createDataFrame([("a", f"D:/x/{p}", p, i, datetime(2025, 1, 1), c) for i, (p, c) in enumerate(rows)], FILES)


def test_paths(spark):
    paths = ["Catalogs/А/Forms/Ф/Ext/Form.xml", "Catalogs\\А\\Forms\\Ф.xml", "CommonForms/О/Ext/Form.xml", "Catalogs/А.xml", "Catalogs/А/Ext/ObjectModule.bsl", "Catalogs/А/Forms/Ф/Ext/Form/Module.bsl", "CommonModules/М/Ext/Module.bsl", "CommonForms/О/Ext/Form/Module.bsl", "x.xml"]
    rel = F.col("rel_path")
    rows = files(spark, [(p, b"") for p in paths]).select("rel_path", exports.is_form_xml(rel).alias("f"), exports.form_identity(rel).alias("i"), exports.module_identity(rel).alias("m")).collect()
    r = {x.rel_path: x for x in rows}
    assert [r[p].f for p in paths] == [True, True, True, False, False, False, False, False, False]
    assert tuple(r[paths[0]].i) == tuple(r[paths[1]].i) == ("Ф", "Catalogs", "Catalog", "А") and tuple(r[paths[2]].i) == ("О", "CommonForms", "CommonForm", "О")
    assert [r[p].m.module_path for p in paths[4:8]] == ["Catalogs.А.МодульОбъекта", "Catalogs.А.Forms.Ф.FormModule", "CommonModules.М", "CommonForms.О.FormModule"]


def test_what_is_indexed(spark):
    names = ["Configuration.xml", "ConfigDumpInfo.xml", "Catalogs/А.xml", "Catalogs/А/Templates/М/Ext/T.xml", "Catalogs/А/Templates/М/M.bsl", "sub/Configuration.xml", "sub/Catalogs/Б.xml", "sub2/В.bsl", ".git/x.xml", "r.txt"]
    got = {r.rel_path for r in exports.indexable(files(spark, [(n, b"") for n in names])).collect()}
    assert got == {"Catalogs/А.xml", "Catalogs/А/Templates/М/M.bsl", "sub2/В.bsl"}
    assert {r.rel_path for r in exports.indexable(files(spark, [(n, b"") for n in names]), "sub2").collect()} == {"sub2/В.bsl"}
    assert [r.rel_path for r in exports.modules_under(files(spark, [(n, b"") for n in names]), "sub2").collect()] == ["sub2/В.bsl"]


def test_reading_a_folder(spark, tmp_path):
    (tmp_path / "Catalogs").mkdir()
    (tmp_path / "Catalogs" / "Товары + 1.xml").write_text(CATALOG, encoding="utf-8")
    (tmp_path / "m.bsl").write_text("А = 1;")
    (tmp_path / "no.txt").write_text("")
    got = {r.rel_path: r for r in exports.read_export(spark, str(tmp_path), "a").collect()}
    assert set(got) == {"Catalogs/Товары + 1.xml", "m.bsl"} and bytes(got["m.bsl"].content) == "А = 1;".encode()
    assert exports.resolve_inside(str(tmp_path), "m.bsl").endswith("m.bsl")
    for bad in ("../x", "none.bsl"):
        with pytest.raises(ValueError):
            exports.resolve_inside(str(tmp_path), bad)
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    assert exports.git_changed(str(tmp_path)) == ["m.bsl"]


def test_lines(spark):
    df = spark.createDataFrame([("k", "a\r\nb\rc\nd"), ("n", None)], "k string, t string")
    get = lambda a, b: [(r.line_no, r.line) for r in exports.line_snippet(df, "k", "t", a, b).collect()]
    assert get(2, 3) == [(2, "b"), (3, "c")] and get(-5, 1) == [(1, "a")] and get(4, 99) == [(4, "d")] and get(9, 3) == []


def test_language_server_report(spark):
    report = '{"fileinfos": [{"path": "p.bsl", "diagnostics": [{"severity": 1, "code": "c", "message": " m ", "range": {"start": {"line": 4, "character": 0}}}, {"severity": "Warning"}]}]}'
    rows = modules.report_diagnostics(spark.createDataFrame([(report,), ("{",), (None,)], "report string"))
    assert sorted(tuple(r) for r in rows.collect()) == [("p.bsl", 1, 1, "unknown", "warning", ""), ("p.bsl", 5, 1, "c", "error", "m")]
    assert {tuple(r) for r in modules.severity_counts(rows).collect()} == {("error", 1), ("warning", 1)}


def test_configurations(spark):
    text = '{"configs": [{"config_id": "Do CF", "export_path": "/x", "default": true}, {"name": "do_cfe", "export_path": "y", "kind": "Extension", "extends": "Do CF"}, {"name": "no path"}, 3]}'
    a, b = config.registered(text, "/base")
    assert (a.config_id, a.is_default, a.collection_name) == ("do_cf", True, "code_do_cf_e5_large") and (b.export_path, b.config_kind, b.base_config_id) == ("/base/y", "extension", "do_cf")
    assert [x.config_id for x in config.registered(text[len('{"configs": ') : -1], "/base")] == ["do_cf", "do_cfe"] and config.registered("{", "/") == []
    pick = lambda req=None, **s: config.resolve([a, b], s, req).config_id
    assert [pick("do_cfe"), pick(ACTIVE_CONFIG_ID="do_cfe"), pick(CONFIG_NAME="DO CFE"), pick("none")] == ["do_cfe", "do_cfe", "do_cfe", "do_cf"]
    assert config.resolve([], {"CONFIG_NAME": "My Base", "BASE_CONFIG_ID": " "}).config_id == "my_base" and config.config_key(" --") == "default"
    assert config.model_suffix({"EMBEDDING_MODEL": "x/MiniLM-L6"}) == "minilm" and config.model_suffix({"EMBEDDING_PROVIDER": "openai"}) == "openai"
    with pytest.raises(ValueError):
        config.provider({"EMBEDDING_PROVIDER": "x"})
    assert config.config_table(spark, [a, b]).count() == 2


def test_language_server(spark, tmp_path):
    from metascope.sources.language_server import analyze, server_status

    fake = tmp_path / "server"
    fake.write_text("""#!/bin/sh
while [ $# -gt 0 ]; do case $1 in --srcDir) src=$2;; --outputDir) out=$2;; esac; shift; done
echo "{\\"fileinfos\\": [{\\"path\\": \\"file://$src/00000.bsl\\", \\"diagnostics\\": [{\\"severity\\": \\"Error\\", \\"message\\": \\"m\\"}]}]}" > $out/report.json
""")
    fake.chmod(0o755)
    use = {"BSL_LS_BINARY": str(fake)}
    done = analyze({"Catalogs/А.bsl": b"x"}, use)
    assert done.status == "completed" and tuple(modules.report_diagnostics(spark.createDataFrame([(done.report,)], "report string")).first())[0] == "Catalogs/А.bsl"
    assert analyze({}, use).status == "not_run" and analyze({"a": b""}, {"BSL_LS_BINARY": "none"}).status == "unavailable" and server_status(use)["available"]
    fake.write_text("#!/bin/sh\nsleep 5\n")
    assert analyze({"a": b""}, use | {"BSL_LS_TIMEOUT": "1"}).status == "timeout"
    fake.write_text("#!/bin/sh\nexit 3\n")
    assert analyze({"a": b""}, use).status == "failed"


def test_sending_the_package(spark, monkeypatch, tmp_path):
    from metascope.runtime import ship

    assert not ship(spark), "workers find it by PYTHONPATH"
    monkeypatch.setenv("PYTHONPATH", "")
    monkeypatch.chdir(tmp_path)
    sent = []
    monkeypatch.setattr(spark.sparkContext, "addPyFile", sent.append)
    assert ship(spark) and len(sent) == 1 and not ship(spark)
    import zipfile

    assert "metascope/runtime.py" in zipfile.ZipFile(sent[0]).namelist()
    del spark.sparkContext._metascope_sent


def test_every_annotation_of_a_text(spark, tmp_path):
    text = '&После("А")\nПроцедура А1()\nКонецПроцедуры\n&Instead( \'Б \' )\nПроцедура Б1()\nКонецПроцедуры\n&После("А")'
    spark.createDataFrame([("d", text), ("none", "&НаСервере"), ("null", None)], "doc_id string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, QUERIES["annotation_places"](spark, str(tmp_path)).collect()))
    assert got == [("d", 0, "after", "А"), ("d", 1, "instead", "Б"), ("d", 2, "after", "А")]
