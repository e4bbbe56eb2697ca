"""Personal information inside free text: labelers vote, expectation-maximisation weighs them, a span classifier decides."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metascope.runtime import cut

TYPES = ("person", "email", "phone", "id_number", "address")

# --- gazetteers -------------------------------------------------------------------------------------------------------
#: Common given names of both languages, in the first case.
GIVEN_RU = """Александр Алексей Анатолий Андрей Антон Аркадий Арсений Артём Артур Богдан Борис Вадим Валентин Валерий Василий Виктор Виталий
Владимир Владислав Всеволод Вячеслав Геннадий Георгий Герман Глеб Григорий Давид Даниил Данила Демид Денис Дмитрий Евгений Егор Захар Иван
Игнат Игорь Илья Кирилл Константин Лев Леонид Макар Максим Марк Матвей Михаил Никита Николай Олег Павел Пётр Платон Роман Руслан Савелий Семён
Сергей Станислав Степан Тарас Тимофей Тимур Фёдор Филипп Эдуард Юрий Яков Ян Ярослав Ринат Рустам Марат""".split()
GIVEN_RU_F = """Александра Алина Алиса Алла Алёна Анастасия Ангелина Анна Антонина Арина Валентина Валерия Варвара Василиса Вера Вероника Виктория
Галина Дарья Диана Ева Евгения Екатерина Елена Елизавета Жанна Зинаида Зоя Инна Ирина Карина Кира Клавдия Кристина Ксения Лариса Лидия Любовь
Людмила Маргарита Марина Мария Милана Надежда Наталья Наталия Нина Оксана Олеся Ольга Полина Раиса Римма Светлана Снежана София Софья Тамара
Татьяна Ульяна Юлия Яна Эльвира Регина""".split()
GIVEN_EN = """Aaron Adam Alan Albert Alexander Alice Amanda Amy Andrea Andrew Angela Anna Anthony Arthur Barbara Benjamin Betty Brian Carl Carol
Caroline Catherine Charles Charlotte Christine Christopher Clara Claire Daniel David Deborah Dennis Diana Donald Dorothy Douglas Edith Edward
Eleanor Elizabeth Ellen Emily Emma Eric Ethan Eva Felix Florence Frances Frank Frederick George Grace Graham Hannah Harold Harry Helen Henry
Howard Hugo Ian Irene Isaac Jack Jacob James Jane Janet Jason Jean Jennifer Jessica Joan John Jonathan Joseph Joyce Judith Julia Karen Keith
Kenneth Kevin Laura Lawrence Leonard Linda Lisa Louise Lucy Margaret Maria Marion Mark Martha Martin Mary Matthew Michael Michelle Nancy Nathan
Nicholas Nora Norman Oliver Olivia Owen Patricia Patrick Paul Peter Philip Rachel Ralph Raymond Rebecca Richard Robert Roger Ronald Rose Roy
Ruth Samuel Sandra Sarah Scott Sharon Simon Sophia Sophie Stephen Steven Stuart Susan Theodore Theresa Thomas Timothy Victor Victoria Vincent
Walter Wendy William""".split()
_STEM = {"Павел": "Павл", "Лев": "Льв", "Пётр": "Петр"}


def _cases(name: str) -> list[str]:
    """The forms of a Russian given name in all cases, by its ending."""
    s, end = _STEM.get(name, name), name[-1]
    if end == "а":
        out = [s[:-1] + e for e in ("а", "ы", "и", "е", "у", "ой", "ою")]
    elif end == "я":
        out = [s[:-1] + e for e in ("я", "и", "е", "ю", "ей", "ёй")]
    elif end == "й":
        out = [s[:-1] + e for e in ("й", "я", "ю", "ем", "е", "и")]
    elif end == "ь":
        out = [s[:-1] + e for e in ("ь", "я", "ю", "ем", "е", "и", "ью")]
    else:
        out = [s + e for e in ("а", "у", "ом", "ем", "е")]
    return [name, *out]


_fold = lambda w: w.lower().replace("ё", "е")
GIVEN = frozenset(_fold(f) for n in GIVEN_RU + GIVEN_RU_F for f in _cases(n)) | frozenset(n.lower() for n in GIVEN_EN)
_PATRONYMIC = re.compile(r"(?:[а-яё]{2,}(?:ович|евич|ич)(?:а|у|ем|ом|е)?|[а-яё]{2,}(?:овн|евн|ичн|иничн)(?:а|ы|е|у|ой|ою))")
_SURNAME_RU = re.compile(r"[а-яё]{2,}(?:(?:[оеё]в|[иы]н)(?:а|у|ым|е|ой|ою|ых|ыми|ы)?|(?:ск|цк)(?:ий|ого|ому|им|ом|ая|ой|ую|ою|их)|[её]?нко|[чщ]?ук[ауе]?(?:ом)?|юк[ауе]?(?:ом)?|ян[ауе]?|дзе|швили|[оеё]ва?|ых|их|ович|евич)")
_SURNAME_EN = re.compile(r"[a-z]{2,}(?:wick|ridge|stead|ley|more|mere|vell|well|gate|shaw|dorne|low|ton|son|ham|ford|worth|field|land|man|ing|er|y|s|all|ett|by|brook|wood|son)")
#: Words that begin with a capital in this kind of text and are no names.
_COMMON = frozenset(
    """the a an cache no validation graph search batch export handler check method users filter don it we item result total row selection clearing meta then session if
    do not for each in email street catalog document try except reference on assigned given else should new report test reported contact signed object mr ms person ask build
    chunk applicant apt ship phone please order while filters links rows state totals prices return flat road fwd which call lane rd number national insurance social security
    null true false and or to from with by at of street road lane avenue drive court way place close square
    запрос не значение справочник индекс расширение реквизит ошибка подписка кэш вместо пользователь табличная смотри отчет граф команда форма замер исправлено метод нужно при
    после событие сначала проверка обмен ключ итог выборка отбор данные строка тогда дата пустая сумма адрес передача ссылка если обработать тип имя синоним цикл для улица
    каждого из сообщить количество текст структура формат неопределено записи массив попытка исключение получить иначе новый следующий оценка эталон штрихкод пункт пока заявку
    доставка со экзаменуемый почта схема телефон доработал контактное партнеры передать автор дом поле версия клиент образец проверяли возврат номер ответственный перешлите
    вопросы согласовано акт связь звоните подпись писать счета отв остатки печать""".split()
)

# --- candidates -------------------------------------------------------------------------------------------------------
_RU = r"[А-ЯЁ](?:\.|(?:[а-яё]++|[А-ЯЁ]++)(?:-[А-ЯЁ](?:[а-яё]++|[А-ЯЁ]++))?(?!\w))"
_EN = r"[A-Z](?:\.|(?:['’][A-Z])?(?:[a-z]++|[A-Z]++)(?:-[A-Z](?:[a-z]++|[A-Z]++))?(?!\w))"
_RUN_RU = re.compile(rf"(?<![\w.]){_RU}(?:(?:[ \xa0]{{1,2}}|(?<=\.)){_RU})+")
_RUN_EN = re.compile(rf"(?<![\w.]){_EN}(?:(?:,?[ \xa0]{{1,2}}|(?<=\.)){_EN})+")
_TOKEN = re.compile(rf"{_RU}|{_EN}")
_AT = r"(?:@|＠|\s?[\[({<]\s?(?:at|собака|эт)\s?[\])}>]\s?|[ \xa0](?:собака|\(a\))[ \xa0])"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|точка|тчк)\s?[\])}]\s?|[ \xa0](?:dot|точка)[ \xa0])"
_EMAIL = re.compile(rf"(?<![\w.+\-])[A-Za-z0-9А-Яа-яЁё_][\w.+\-]*(?:{_AT}(?:[\w\-]+{_DOT})+[A-Za-zА-Яа-яЁё]{{2,24}}|[ \xa0]at[ \xa0](?:[\w\-]+[ \xa0](?:dot|точка)[ \xa0])+[A-Za-zА-Яа-яЁё]{{2,24}})(?![\w])", re.I)
_EMAIL_AT = re.compile(r"[@＠]|(?<=[ \xa0])[Сс][Оо][Бб][Аа][Кк][Аа](?!\w)|[\[({<]\s?(?:[Aa][Tt]|[Ээ][Тт]|[Сс][Оо][Бб][Аа][Кк][Аа]|a)\s?[\])}>]|(?<=[ \xa0])[Aa][Tt](?=[ \xa0][\w\-]+[ \xa0](?:dot|DOT|точка)[ \xa0])")
_SEP = r"(?:[ \t\xa0\u2009\u202f]?[(.\-\u2010-\u2015/]?[ \t\xa0\u2009\u202f]?)"
_PHONE = re.compile(rf"(?<![\w.+\-/№#])(?:\+\d{{1,3}}{_SEP}|[78]{_SEP})?(?:\(\d{{2,5}}\)|\d{{2,5}}){_SEP}\d{{2,4}}(?:{_SEP}\d{{2,4}}){{1,4}}(?![\w])(?!\.\d)")
_ID = re.compile(
    r"(?<![\w.+\-/])(?:\d{2}[ \xa0]?\d{2}[ \xa0,]{0,2}(?:(?:№|N|номер|no\.?)[ \xa0]?)?\d{6}|\d{3}[- \xa0\u2010-\u2015]?\d{3}[- \xa0\u2010-\u2015]?\d{3}[- \xa0\u2010-\u2015]?\d{2}|\d{12}|\d{10}|\d{3}[-\u2010-\u2015]\d{2}[-\u2010-\u2015]\d{4}|[A-Z]{2}[ \xa0]?\d{2}[ \xa0]?\d{2}[ \xa0]?\d{2}[ \xa0]?[A-D])(?![\w])(?!-\d)"
)
_STREET = r"(?:улиц[аыеу]|ул\.?|переул(?:ок|ка|ке)|пер\.|просп(?:ект[ае]?|\.)|пр-т|пр\.|бульвар|бул\.|б-р|шоссе|ш\.|набережная|наб\.|площадь|пл\.|проезд|тупик|аллея)"
_NAME_RU = r"(?:(?:\d{1,2}-[а-яё]{1,2}[ \xa0])?[А-ЯЁ](?:[а-яё]++|[А-ЯЁ]++)(?:-[А-ЯЁа-яё]+)?(?:[ \xa0][А-ЯЁ](?:[а-яё]++|[А-ЯЁ]++)){0,2})"
_HOUSE = r"(?:[ \xa0]?,?[ \xa0]{0,2}(?i:д(?:ом|\.)?[ \xa0]?)?(?:№[ \xa0]?)?\d{1,4}(?!\d)(?:[А-Яа-яA-Za-z](?!\w))?(?:[ \xa0]?/[ \xa0]?\d+|(?i:к|корп|стр)\.?[ \xa0]?\d+|,?[ \xa0](?i:корп|стр|к|строение|корпус)\.?[ \xa0]?\d+)*)"
_FLAT = r"(?:,?[ \xa0](?i:кв\.?|квартира|оф\.?|офис)[ \xa0]?\d+)?"
_NAME_AFTER = _NAME_RU.replace("{0,2})", "{0,6})")  # after the street word there is no telling how many words a name has
_ADDRESS_RU = re.compile(rf"(?<![\w])(?:(?:(?i:кв|д|дом|квартира)\.?[ \xa0]?\d+[А-Яа-я]?,[ \xa0]?){{0,2}})(?:(?i:{_STREET})[ \xa0]?{_NAME_AFTER}|{_NAME_RU}[ \xa0](?i:{_STREET}))(?:{_HOUSE}){_FLAT}(?![\w])")
_ROAD = r"(?i:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Close|Court|Ct|Way|Place|Square|Terrace|Crescent|Boulevard|Blvd|Hill|Gardens|Row|Mews|Grove)"
_ADDRESS_EN = re.compile(rf"(?<![\w])(?:(?i:Flat|Apt|Apartment|Unit|Suite)\.?[ \xa0]\w{{1,5}},[ \xa0])?\d{{1,5}}[A-Za-z]?,?[ \xa0](?:[A-Z](?:[a-z]+|[A-Z]+)[ \xa0]){{1,3}}{_ROAD}(?!\w)(?:(?<=St|Rd|Ln|Dr|Ct)\.|(?<=Ave)\.|(?<=Blvd)\.)?(?:,[ \xa0](?i:Flat|Apt|Apartment|Unit|Suite)\.?[ \xa0]\w{{1,5}})?")
_ADDRESS_AT = re.compile(r"(?<![\w])(?:[Уу][Лл](?:\.|[Ии][Цц]| )|[Пп][Ее][Рр](?:\.|[Ее][Уу][Лл])|[Пп][Рр](?:[Оо][Сс][Пп]|-т|\.|[Оо][Ее][Зз][Дд])|[Бб](?:[Уу][Лл]|-р)|[Шш](?:[Оо][Сс][Сс]|\.)|[Нн][Аа][Бб]|[Пп][Лл](?:[Оо][Щщ]|\.)|[Тт][Уу][Пп][Ии][Кк]|[Аа][Лл][Лл][Ее][Яя]|(?:S(?:t|T|q)|R[doO]|L[anAN]|A[vV]e?|D[rR]|C[loLOtTr]|W[aA]y|P[lL]a|T[eE]r|B[loLO]|H[iI]l|G[arRA]|Row|ROW|M[eE]w)[a-zA-Z]*(?=[\s.,;|)]|$))")

# --- contexts ---------------------------------------------------------------------------------------------------------
_CONTEXT = {
    "person": re.compile(r"(?:автор\w*(?: правки)?|отв\.|ответственн\w+|подпись|вопросы|связь|клиент\w*|согласовано с|передать|со слов|открыл(?:\(а\)|а)?|доработал\w*|подписан\w*|проверяли\w*|проверил\w*|исполнитель|сотрудник\w*|г-н(?:/г-жа)?|г-жа|карточке|владелец|фио|contact|assigned to|signed-off|mr/ms|mrs?\.?|ms\.?|dr\.?|applicant|ask|reported by|test card|owner|reviewer|author|by|cc|на)[\s:\-–—|,.(]*$"),
    "email": re.compile(r"(?:e-?mail|почт\w+|писать|пишите|перешлите|копия|протокол|cc|login|user|owner|to|from|адрес|signed|contact|at|отв|автор|вопросы|подпись)\b[^\n@]{0,60}$"),
    "phone": re.compile(r"(?:тел\w*|моб\w*|phone|tel|call|mobile|fax|факс|звон\w*|линия|перезвон\w+|on-call|whatsapp)\b[\s.:=\-–—(|,\"']*(?:по|after)?\s*$"),
    "id_number": re.compile(r"(?:паспорт\w*|снилс|страхов\w+|инн|ssn|social security|national insurance|ni number|passport|tax id|удостоверени\w+)\b[^\n\d]{0,40}$"),
    "address": re.compile(r"(?:адрес\w*|г\.|гор\.|город|доставк\w+|прожива\w+|теперь|переехал\w*|улиц\w+|по адресу:?|подпись|ship|to|at|address|deliver\w*|card|mr/ms|живет|\d{6})\b[^\n]{0,60}$"),
}
_ORGANISATION = re.compile(r"(?:организаци\w+|юрлиц\w*|компани\w+|ооо|зао|оао|огрн|кпп|контрагента|company|organi[sz]ation|vat)\b[^\n]{0,25}$")
_GOODS = re.compile(r"(?:штрихкод|партия|парти\w|lot|order|заказ\w*|build|верси\w+|платформ\w+|режим\w*|счет\w*|ссылка|object|barcode|артикул|код|isbn|строка|артикул|ip|guid|договор\w*)\b[^\n]{0,14}$")
_LONG_DIGITS = re.compile(r"\d{13,}")
_CODE = re.compile(r"[\"']\s*\+\s*$|\+\s*[\"']$")


@dataclass(frozen=True)
class Span:
    """A candidate: its type, place (code points), the votes of the type's labelers (one of + - 0 each), and what the
    classifier sees besides them: features of the span and its surroundings, as numbers below FEATURES."""

    kind: str
    start: int
    end: int
    votes: str
    seen: tuple[int, ...] = ()


#: Features of spans are hashed into so many places.
FEATURES = 96
_LAST_WORD, _NEXT, _AGAIN = re.compile(r"(\w+)\W*$"), re.compile(r"\s*(\w+|\S)?"), re.compile(r"(.)\1+", re.S)


class _Classes(dict):
    """Characters by class: 9 digit, X capital, x other letter, blank; the rest stays. Remembers each character."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = "9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else " " if c.isspace() else c
        return out


_CLASSES = _Classes()


def _shape(s: str) -> str:
    """The classes of a span's characters, runs of one class as one, and the number of digits."""
    classes = s[:80].translate(_CLASSES)
    return f"{_AGAIN.sub(r'\1', classes)} {classes.count('9')}"


def features(text: str, span: Span) -> tuple[int, ...]:
    """The span's shape and length, the word before it and what follows it."""
    before = _LAST_WORD.search(text[max(0, span.start - 30) : span.start])
    after = _NEXT.match(text, span.end, span.end + 20)[1] or ""
    facts = (f"shape {_shape(text[span.start : span.end])}", f"length {(span.end - span.start) // 8}", f"before {before[1].lower() if before else ''}", f"edge {text[span.start - 1 : span.start]}", f"after {after.lower()[:12]}")
    return tuple(sorted({zlib.crc32(f"{span.kind} {f}".encode()) % FEATURES for f in facts}))


def _vote(*marks: int) -> str:
    return "".join("+" if m > 0 else "-" if m < 0 else "0" for m in marks)


def _left(text: str, start: int, most: int = 70) -> str:
    return text[max(0, start - most) : start].lower()


def _role(token: str) -> str:
    """G given name, P patronymic, I initial, S like a surname, C a common word, W any other word."""
    if token.endswith("."):
        return "I"
    w = _fold(token)
    if w in GIVEN:
        return "G"
    if w in _COMMON:
        return "C"
    if _PATRONYMIC.fullmatch(w):
        return "P"
    part = w.rpartition("-")[2]
    if (_SURNAME_RU if "а" <= part[:1] <= "я" else _SURNAME_EN).fullmatch(part):
        return "S"
    return "W"


#: The ways in which a name is written, over the roles of its parts; a comma only between a surname and what follows.
_FORMS = re.compile(r"(?:[SW],?G[PI]?|[SW],?I{1,2}|G[PI]?[SW]|I{1,2}[SW]|GG|GPG)")
#: Without a known given name or an initial: two words, or three with a patronymic, only where a label or title says that a person follows.
_UNKNOWN = re.compile(r"[SW]{2}|[SW]{2}P|[SW]P[SW]")
_LABEL = re.compile(r"(?:(?:^|[\s(«\"])(?:автор|ответственн(?:ый|ая)|исполнитель|сотрудник|сотрудница|клиент|фио|заявитель(?:ница)?|подписал(?:а)?|проверил(?:а)?|contact|author|reviewer|reported by|assigned to|applicant|signed|owner|name|customer|employee)\s*[:—–-]\s*|(?:^|[\s(«\"])(?:contact|reported by|assigned to|signed by|mr|mrs|ms|dr|г-н|г-жа|господин|госпожа)\.?\s)$")


def _people(text: str) -> Iterator[Span]:
    for russian, runs in ((True, _RUN_RU), (False, _RUN_EN)):
        for run in runs.finditer(text):
            tokens = list(_TOKEN.finditer(text, run.start(), run.end()))
            roles = [_role(t[0]) for t in tokens]
            known = bool({"G", "I"} & set(roles))
            first = next((i for i, r in enumerate(roles) if r != "C"), len(roles))  # a label may stand in the run itself
            if not known and not _UNKNOWN.fullmatch("".join(roles[first:])):
                continue
            for a in range(len(tokens)):
                for b in range(a + 2, min(len(tokens), a + 4) + 1):
                    shape = roles[a]
                    for i in range(a + 1, b):
                        shape += ("," if "," in text[tokens[i - 1].end() : tokens[i].start()] else "") + roles[i]
                    if not _FORMS.fullmatch(shape) and (known or a != first or b < len(tokens) or not _UNKNOWN.fullmatch(shape) or not _LABEL.search(_left(text, tokens[a].start()))):
                        continue
                    if (b < len(tokens) and roles[b] in "IP" and _FORMS.fullmatch(shape + roles[b])) or (a and roles[a] == "I" and roles[a - 1] in "GI"):
                        continue  # part of a longer one
                    start, end = tokens[a].start(), tokens[b - 1].end()
                    left, after = _left(text, start), text[end : end + 14].lower()
                    words = [t[0] for t in tokens[a:b] if not t[0].endswith(".")]
                    caps = {w.isupper() for w in words if len(w) > 1}
                    comma = "," in shape
                    yield Span("person", start, end, _vote(
                        1 if "G" in shape else 0,
                        1 if "P" in shape else 0,
                        1 if "I" in shape else 0,
                        1 if "S" in shape else -1 if "W" in shape and known else 0,
                        1 if _CONTEXT["person"].search(left) else 0,
                        -1 if re.match(r"[ \xa0,]*(?:улица|переулок|пер\.|ул\.|street|road|lane|rd)", after) or re.search(r"(?:ул\.|улица|пер\.|проспект)[ \xa0]?$", left) else 0,
                        1 if re.match(r"\s*[<(|,;.]|\s*\S+@|\s+и\s|\s+and\s", after) else 0,
                        -1 if len(caps) > 1 else 0,
                        -1 if re.match(r"[-@_\d]", after) else 0,
                        -1 if comma and (russian or "I" in shape) else 1 if comma else 0,
                    ))


def _emails(text: str) -> Iterator[Span]:
    last = -1
    for at in _EMAIL_AT.finditer(text):
        a = at.start()
        while a > 0 and text[a - 1] in " \xa0" and at.start() - a < 2:
            a -= 1
        while a > 0 and (text[a - 1].isalnum() or text[a - 1] in "._+-"):
            a -= 1
        while a < at.start() and text[a] in ".+-":
            a += 1
        m = _EMAIL.match(text, a)
        if not m or m.start() <= last:
            continue
        last = m.start()
        s = m[0]
        plain, left = "@" in s or "＠" in s, _left(text, m.start())
        end = m.end()
        host = re.split(r"@|＠|[\[({<]\s?(?:at|собака|эт)\s?[\])}>]|\s(?:собака|at)\s", s, maxsplit=1, flags=re.I)[-1]
        yield Span("email", m.start(), end, _vote(
            1 if plain else 0,
            1 if _CONTEXT["email"].search(left) else 0,
            1 if re.search(r"(?:example|test|invalid|com|org|net|ru|рф|su|local|info|biz|by|kz|ua|io|edu|gov|uk|de)$", s, re.I) else -1,
            1 if re.search(r"[\[({<]\s?at|собака|[\[({]\s?dot", s, re.I) else 0,
            -1 if re.match(r"[\d.]+$", host) else 1,
            -1 if text[end : end + 1] in ("(", "/") and text[end : end + 1] else 0,
        ))


def _phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        s = m[0]
        digits = re.sub(r"\D", "", s)
        left = _left(text, m.start())
        plus, bracket, eight = s[0] == "+", "(" in s, digits[0] in "78" and len(digits) == 11
        told = bool(_CONTEXT["phone"].search(left))
        if not (10 <= len(digits) <= 13 or (plus and 7 <= len(digits) <= 15) or (told and 6 <= len(digits) <= 9)):
            continue
        yield Span("phone", m.start(), m.end(), _vote(
            1 if plus else 0,
            1 if bracket else 0,
            1 if eight else 0,
            1 if told else 0,
            -1 if _GOODS.search(left) or _ORGANISATION.search(left) else 0,
            -1 if _CONTEXT["id_number"].search(left) else 0,
            -1 if not (plus or bracket or eight) and len(digits) > 9 else 0,
            -1 if s == digits and not eight and len(digits) > 9 else 0,
            -1 if re.fullmatch(r"\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4}.*|\d{4}-\d\d-\d\d.*", s) else 0,
        ))


def _ids(text: str) -> Iterator[Span]:
    for m in _ID.finditer(text):
        s, left = m[0], _left(text, m.start())
        digits = re.sub(r"\D", "", s)
        org = bool(_ORGANISATION.search(left))
        tax = len(digits) == 10 and s == digits and bool(re.search(r"инн\b[^\n]{0,25}$", left)) and not re.search(r"физ|лич|сотруд", left[-25:])
        asked = not org and not tax and bool(_CONTEXT["id_number"].search(left))
        letters = s[0].isalpha()
        yield Span("id_number", m.start(), m.end(), _vote(
            1 if asked else -1,
            -1 if org else 0,
            -1 if _GOODS.search(left) else 0,
            1 if letters or re.fullmatch(r"\d{3}.\d\d.\d{4}", s) or re.fullmatch(r"\d{3}.\d{3}.\d{3}.\d\d", s) else 0,
            -1 if tax else 0,
            -1 if digits[:1] in ("7", "8") and len(digits) == 11 and not asked else 0,
            -1 if _CONTEXT["phone"].search(left) else 0,
        ))


_WORD = re.compile(r"\w+\W*")


def _back(text: str, at: int, words: int) -> int:
    """Where the last `words` words before a place begin, whatever their length."""
    for _ in range(words):
        while at and not (text[at - 1].isalnum() or text[at - 1] == "_"):
            at -= 1
        while at and (text[at - 1].isalnum() or text[at - 1] == "_"):
            at -= 1
    return at


def _ahead(text: str, at: int, words: int) -> int:
    """Where the next `words` words end."""
    for _ in range(words):
        m = _WORD.search(text, at)
        if not m:
            return len(text)
        at = m.end()
    return at


def _addresses(text: str) -> Iterator[Span]:
    seen = set()
    for at in _ADDRESS_AT.finditer(text):
        russian = at[0][0] > "z"
        if not russian and not text[max(0, at.start() - 40) : at.start()].rstrip()[-1:].isalpha():
            continue
        # as many words as the patterns can take on either side: flat and house (4), names (4, with ordinals); names (8), house, flat
        for m in (_ADDRESS_RU if russian else _ADDRESS_EN).finditer(text, _back(text, at.start(), 8), _ahead(text, at.end(), 18)):
            if m.start() in seen or m.end() <= at.start() or m.start() > at.start():
                continue
            seen.add(m.start())
            s, left = m[0], _left(text, m.start())
            name = re.search(r"(?:ая|яя|ый|ий|ой|ых|их|ова|ева|ина|АЯ|ЫЙ|ИЙ)(?!\w)", s)
            yield Span("address", m.start(), m.end(), _vote(
                1 if re.search(rf"(?<!\w)(?i:{_STREET})(?!\w)|{_ROAD}", s) else -1,
                1 if re.search(r"(?i:(?<!\w)(?:д\.|дом|кв\.)|apt|flat)", s) else 0,
                1 if name or not russian else 0,
                1 if _CONTEXT["address"].search(left) else 0,
                -1 if _CODE.search(left) else 0,
                -1 if re.search(r"(?:метод|строка|таблица|method|line|batch)\s*$", left) else 0,
                1 if re.match(r"\s*(?:[,.;|\n]|$|вход|ground)", text[m.end() : m.end() + 12]) else 0,
            ))


_FINDERS = (_people, _emails, _phones, _ids, _addresses)


def candidates(text: str | None) -> list[Span]:
    """All candidates of a text with their votes; spans may overlap."""
    if not text:
        return []
    out = [s for find in _FINDERS for s in find(text)]
    if any(s.kind in ("phone", "id_number") for s in out):
        long = [(m.start(), m.end()) for m in _LONG_DIGITS.finditer(text)]
        out = [s for s in out if s.kind not in ("phone", "id_number") or not any(a <= s.start < b for a, b in long)]
    return [replace(s, seen=features(text, s)) for s in out]


# --- weak supervision -------------------------------------------------------------------------------------------------
def expectation_maximisation(patterns: list[tuple[str, int]], rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """Reliabilities of the labelers of one type from the counts of their vote patterns: how often a vote of each is right,
    the share of true candidates, and each pattern's posterior.

    A labeler that votes is right with its reliability; that it abstains says nothing. Each reliability has a prior worth
    a twentieth of the labeler's votes around 0.85 and stays between 0.6 and 0.995, so that true keeps its meaning; the
    share stays between 0.2 and 0.8, so that a type of which nearly all candidates are true does not win every overlap. The
    first posteriors follow the majority of the votes."""
    votes = np.array([["-0+".index(c) - 1 for c in p] for p, _ in patterns], dtype=float)
    n = np.array([c for _, c in patterns], dtype=float)
    said = votes != 0
    post = 1 / (1 + np.exp(-1.7 * votes.sum(axis=1)))
    right, share = np.full(votes.shape[1], 0.85), 0.5
    for _ in range(rounds):
        agree = np.where(votes > 0, post[:, None], np.where(votes < 0, 1 - post[:, None], 0.0))
        total = (n[:, None] * said).sum(axis=0)
        prior = 2 + total / 20
        right = np.clip(((n[:, None] * agree).sum(axis=0) + 0.85 * prior) / (total + prior), 0.6, 0.995)
        share = float(np.clip(((post * n).sum() + 1) / (n.sum() + 2), 0.2, 0.8))
        new = 1 / (1 + np.exp(-np.clip(votes @ np.log(right / (1 - right)) + np.log(share / (1 - share)), -40, 40)))
        moved = float(np.abs(new - post).max())
        post = new
        if moved < 1e-7:
            break
    return right, share, post


#: How many spans of a type the classifier is trained on at most; all spans are counted for EM and decided by the classifier.
TRAIN_SPANS = 5_000


def _row(votes: str, seen) -> np.ndarray:
    x = np.zeros(1 + 2 * len(votes) + FEATURES)
    x[0] = 1.0
    for i, c in enumerate(votes):
        if c != "0":
            x[1 + 2 * i + (c == "-")] = 1.0
    for f in seen:
        x[1 + 2 * len(votes) + f] = 1.0
    return x


def train_classifier(spans: list[tuple[str, tuple[int, ...]]], post: dict[str, float], steps: int = 200) -> np.ndarray:
    """Weights of a logistic span classifier over the votes (two features each), the features of the span and its
    surroundings, and a bias; fitted by Newton steps to the posteriors of the votes. The surroundings are held closer to zero, so that
    they decide only where the votes leave it open."""
    x = np.array([_row(v, f) for v, f in spans])
    y = np.array([post[v] for v, _ in spans])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.5)
    ridge[0], ridge[-FEATURES:] = 1e-3, max(4.0, len(spans) / 100)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass(frozen=True)
class Model:
    """Weights of the span classifier by type; small, and all that the tasks get."""

    weights: dict[str, np.ndarray]

    def probability(self, span: Span) -> float:
        w = self.weights.get(span.kind)
        if w is None:
            return 0.0
        z, n = w[0], len(span.votes)
        for i, c in enumerate(span.votes):
            if c != "0":
                z += w[1 + 2 * i + (c == "-")]
        for f in span.seen:
            z += w[1 + 2 * n + f]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def save(self) -> str:
        """As JSON text; the same model decides on other documents as on these."""
        return json.dumps({k: [float(x) for x in w] for k, w in self.weights.items()})

    @classmethod
    def load(cls, text: str) -> Model:
        return cls({k: np.array(w) for k, w in json.loads(text).items()})

    def choose(self, spans: list[Span], least: float = 0.5) -> list[Span]:
        """The spans that are likely enough, of those that overlap the likeliest, then the longest, then the first."""
        scored = sorted(((self.probability(s), s) for s in spans), key=lambda x: (-round(x[0], 9), -(x[1].end - x[1].start), x[1].start, x[1].kind))
        kept: list[Span] = []
        taken: list[tuple[int, int]] = []  # in order, without overlaps
        for p, s in scored:
            at = bisect_left(taken, (s.start, s.end))
            if p >= least and not (at and taken[at - 1][1] > s.start) and not (at < len(taken) and taken[at][0] < s.end):
                kept.append(s)
                taken.insert(at, (s.start, s.end))
        return sorted(kept, key=lambda s: s.start)


_SPAN = "struct<kind:string,start:bigint,end:bigint,votes:string,seen:array<int>>"


def _stored(spans) -> list[Span]:
    return [Span(x["kind"], x["start"], x["end"], x["votes"], tuple(x["seen"])) for x in spans]


def scan(documents: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id and the candidates of each text that has some; with texts, every row, with its text. Whole texts, each where
    it lies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [[{"kind": s.kind, "start": s.start, "end": s.end, "votes": s.votes, "seen": list(s.seen)} for s in candidates(t if isinstance(t, str) else None)] for t in b["text"]]
            out = pd.DataFrame({"doc_id": b["doc_id"], "spans": pd.Series(found, index=b.index, dtype=object)})
            yield out.assign(text=b["text"]) if texts else out[[bool(f) for f in found]]

    # ids travel as text: pandas would turn a column with nulls into floats
    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return (rows if texts else rows.filter("text is not null")).mapInPandas(run, f"doc_id string, spans array<{_SPAN}>" + (", text string" if texts else ""))


def fit(scanned: DataFrame, train_spans: int = TRAIN_SPANS) -> Model:
    """EM over the vote patterns of all candidates, of which only the counts come to the driver: at most 3 to the number of
    labelers of a type, however large the corpus. Then the classifier, on at most train_spans spans of each type, chosen
    by a hash of their place."""
    spans = scanned.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    counts = spans.groupBy("kind", "votes").count().collect()
    order = F.xxhash64("doc_id", "start", "end", "votes")
    rows = None
    for kind in TYPES:
        some = spans.filter(F.col("kind") == kind).orderBy(order, "doc_id", "start").limit(train_spans).select("kind", "votes", "seen")
        rows = some if rows is None else rows.unionByName(some)
    sample = rows.collect()  # bounded by train_spans
    weights = {}
    for kind in TYPES:
        patterns = sorted((r["votes"], r["count"]) for r in counts if r["kind"] == kind)
        if patterns:
            _, _, post = expectation_maximisation(patterns)
            weights[kind] = train_classifier([(r["votes"], tuple(r["seen"])) for r in sample if r["kind"] == kind], {v: float(p) for (v, _), p in zip(patterns, post)})
    return Model(weights)


def find_pii(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, pii_type, start_pos, end_pos (code points, from 0) of each piece of personal information, without
    repetitions. Null, empty and blank texts give no rows; a repeated document counts once. The candidates are written to
    the shared folder once; without a model one is fitted on all of them, and it then decides on them."""
    scanned = cut(scan(documents))
    model = fit(scanned) if model is None else model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, s.kind, s.start, s.end) for i, spans in zip(b["doc_id"], b["spans"]) for s in model.choose(_stored(spans))]
            yield pd.DataFrame(rows, columns=["doc_id", "pii_type", "start_pos", "end_pos"])

    out = scanned.mapInPandas(run, "doc_id string, pii_type string, start_pos bigint, end_pos bigint")
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint")).distinct()


def _placed(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for s in spans:
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join([*out, text[at:]])


def redact(text: str | None, model: Model) -> str | None:
    """The text with [PERSON], [EMAIL], [PHONE], [ID_NUMBER] or [ADDRESS] in place of each span, otherwise unchanged."""
    return _placed(text, model.choose(candidates(text))) if text else text


def redact_documents(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id and text of every row with typed placeholders; null stays null. With a saved model each text is read once and
    depends on itself alone. Without one the texts are written to the shared folder with their candidates, which the
    model is fitted on and then placed from: they are searched once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = b["spans"] if "spans" in b else [None] * len(b)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [(redact(t, model) if s is None else _placed(t, model.choose(_stored(s)))) if isinstance(t, str) else None for t, s in zip(b["text"], spans)]})

    if model is None:
        rows = cut(scan(documents, True))
        model = fit(rows)
    else:
        rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast("bigint"))


def model_report(scanned: DataFrame) -> str:
    """Reliabilities and probabilities of the patterns, for reading."""
    counts = scanned.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").count().collect()
    out = {}
    for kind in TYPES:
        patterns = sorted((r["votes"], r["count"]) for r in counts if r["kind"] == kind)
        if patterns:
            right, share, post = expectation_maximisation(patterns)
            out[kind] = {"share": round(share, 4), "labelers": right.round(3).tolist(), "patterns": [(p, n, round(float(q), 3)) for (p, n), q in zip(patterns, post)]}
    return json.dumps(out, ensure_ascii=False, indent=1)
