import random

import pytest

from metascope.llm.syntax import against_diagnostics, invalid_rates, module_errors, parse_files, xml_errors

OK = [
    "", "\ufeff", "// только комментарий\n\n", "Перем А, Б Экспорт;\n", "А = 1;", "А.Б().В[1] = Новый Структура(\"К\", 2)", "Процедура П() КонецПроцедуры",
    "&НаСервере\nФункция Ф(Знач А, Б = Неопределено, В = -1) Экспорт\n\tВозврат ?(А = 1, \"да\"\"нет\", Не Б);\nКонецФункции",
    "#Область Х\nПроцедура П()\n\tЕсли А Тогда\n\tИначеЕсли Б И Не В Тогда Возврат;\n\tИначе\n\tКонецЕсли;\nEndProcedure\n#КонецОбласти",
    "#If Server Then\nFor Each A In B Do Break; EndDo;\nFor I = 1 To 10 Do Continue EndDo;\nWhile True Do EndDo\n#Else\nTry Raise; Except F() EndTry;\n#EndIf",
    'Т = "ВЫБРАТЬ\n\t|А\n\t// пояснение\n\n\t|<<<<<<< x\n\t|КонецФункции";', "А = '20250101';\r\nБ = А + -1 * (2 % 3) >= 4 Или Не А <> Б;\rВ(,1,);", "Запрос.Выполнить().Выгрузить();", "~Метка:\nПерейти ~Метка;", "Выполнить(\"А\");",
    "АСИНХ ПРОЦЕДУРА П() Ждать Ф(); КОНЕЦПРОЦЕДУРЫ", "&Вместо(\"П\")\nПроцедура Р_П()\nКонецПроцедуры", "А = Новый(\"Тип\", П); Б = \"а\" \"б\";", "ДобавитьОбработчик А.Б, В.Г;", ";;;",
]
BAD = [
    "Процедура П()", "КонецПроцедуры", "Процедура П() КонецФункции", "Если А Тогда", "Если А Тогда КонецЦикла;", "Для А = 1 По 2 Цикл КонецЕсли;", "Попытка Исключение", "#Область А", "#КонецОбласти", "#Если А Тогда\n#КонецОбласти",
    "#Область А\nПроцедура П()\n#КонецОбласти\nКонецПроцедуры", 'А = "не закрыта;\nБ = 1;', "А = (1 + 2;", "А = Б[1;", "А = 1)", "<<<<<<< x\n=======\n>>>>>>> y", "<html></html>", "просто текст", "А = ;", "А = 1 + ;", "А = 1 Б = 2", "{\"a\": 1}",
    "Процедура А()\nПроцедура Б()\nКонецПроцедуры\nКонецПроцедуры", "Если А\nБ();\nКонецЕсли;", "А\x00\x00", "Процедура П(\nКонецПроцедуры", "&НаСервере\nА = 1;", "А;", "#Чтото", "А = 'x';", "Иначе", "Возврат Возврат;",
]


@pytest.mark.parametrize("text", OK)
def test_valid_modules(text):
    assert module_errors(text.encode()) == []


@pytest.mark.parametrize("text", BAD)
def test_invalid_modules(text):
    assert module_errors(text.encode())


def test_recovery_tells_all_errors_and_the_first():
    text = "Процедура А()\n\tБ = ;\n\tВ = 1;\n\tГ = (2;\nКонецПроцедуры\n#Область Х\n"
    assert [n for n, _ in module_errors(text.encode())] == [2, 4, 6]
    assert module_errors("А = 1;\n".encode() + b"\xff") == [(2, "not UTF-8")]


def test_breaking_a_valid_module_is_seen():
    good = OK[8] + "\n" + OK[7] + "\n" + OK[10]
    for word in ("КонецЕсли", "EndProcedure", "#КонецОбласти", "КонецФункции", "Тогда", '"ВЫБРАТЬ'):
        assert module_errors(good.replace(word, "", 1).encode()), word


def test_no_text_stalls_or_crashes():
    rnd = random.Random(1)
    bits = ['"', "\r\n", "\n", "\r", "|", "Если ", "Тогда ", "КонецЕсли;", "(", ")", "А", "=", "//", "#Область\n", "&А", "'", "Процедура П()", ";", "[", "?", "Новый ", "Для Каждого ", "\x00", "🙂"]
    for _ in range(1500):
        module_errors("".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))).encode())
    assert module_errors(('А = "' + "\r\n" * 50_000).encode())
    assert not module_errors(("Если А Тогда " * 5000 + "КонецЕсли;" * 5000).encode())
    assert not module_errors(("А = " + "(" * 5000 + "1" + ")" * 5000 + ";").encode())


@pytest.mark.parametrize(
    "content,valid",
    [
        (b"<a/>", True), (b"", False), (b"<a>", False), (b"<a></b>", False), (b"<a x='1' x='2'/>", False), (b"<a>&nbsp;</a>", False), (b"\n<?xml version='1.0'?><a/>", False), (b"\xef\xbb\xbf<?xml version='1.0' encoding='UTF-8'?><a/>", True),
        ("<?xml version='1.0' encoding='windows-1251'?><а>ж</а>".encode("cp1251"), True), ("<?xml version='1.0' encoding='UTF-8'?><a>ж</a>".encode("cp1251"), False), ("<?xml version='1.0' encoding='UTF-16'?><a>ж</a>".encode("utf-16"), True),
        ("<?xml version='1.0' encoding='koi8-r'?><a>ж</a>".encode("koi8-r"), True), (b"<?xml version='1.0' encoding='none-such'?><a/>", False), ("\ufeff<?xml version='1.0' encoding='windows-1251'?><a>ж</a>".encode(), True),
        ("<?xml version='1.0' encoding='shift_jis'?><a>あ</a>".encode("shift_jis"), True), (b"<a><![CDATA[<b>&]]></a>", True), (b"<a/><b/>", False), (b"version lfs-pointer/v1", False),
    ],
)
def test_xml(content, valid):
    assert (not xml_errors(content)) == valid


def test_tables(spark):
    rows = [(1, "a", "D:/x/m.bsl", "m.BSL", b"\xd0\x90 = ;"), (2, "a", "D:/x/n.bsl", "n.bsl", b""), (3, "a", "D:/x/f.xml", "f.xml", b""), (4, "a", "p", "r.txt", b"x"), (5, "a", "p", "z.bsl", None), (6, None, None, None, b"x"), (1, "a", "D:/x/m.bsl", "m.BSL", b"\xd0\x90 = ;")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "file_id bigint, config_id string, file_path string, rel_path string, content binary, accepted string")
    p = parse_files(df)
    assert sorted((r.file_id, r.accepted) for r in p.distinct().collect()) == [(1, False), (2, True), (3, False)]
    assert {(r.language, r.versions, r.invalid, r.rate) for r in invalid_rates(p).collect()} == {("bsl", 2, 1, 0.5), ("xml", 1, 1, 1.0)}
    d = spark.createDataFrame([("d:\\x\\M.bsl", "Error")], "file_path string, severity string")
    assert ("bsl", False, True, 1) in {tuple(r) for r in against_diagnostics(p, d).collect()}
    assert parse_files(df.filter("false")).count() == 0


def test_null_and_huge_ids(spark):
    df = spark.createDataFrame([(i, "a", "p", "x.bsl", b"(") for i in (None, (1 << 62) + 1)], "file_id bigint, config_id string, file_path string, rel_path string, content binary")
    assert {r.file_id for r in parse_files(df).collect()} == {None, (1 << 62) + 1}


def test_no_error_of_a_long_module_is_left_out():
    found = module_errors(("Процедура П()\n" + "А = ;\n" * 2500).encode())
    assert found[0] == (1, "Procedure is not closed") and [n for n, _ in found[1:]] == list(range(2, 2502))


def test_no_depth_and_no_number_of_errors_is_too_much():
    from metascope.llm.syntax import module_errors

    deep = "А = " + "(" * 100_000 + "1" + ")" * 100_000 + ";"
    assert module_errors(deep.encode()) == []
    assert module_errors(("А = " + "(" * 100_000 + "1;").encode()) == [(1, "a bracket is not closed")]
    calls = "А = " + "Ф(" * 30_000 + "1" + ")" * 30_000 + ";"
    assert module_errors(calls.encode()) == []
    assert len(module_errors("\n".join(["А = ;"] * 5000).encode())) == 5000
