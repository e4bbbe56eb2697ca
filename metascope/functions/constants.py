"""Fixed values that results depend on: patterns, word lists and lookup tables of the domain's files and queries."""

from __future__ import annotations

# The words of a text, and the borders at which a compound name is split.
TOKEN = r"[A-Za-zА-Яа-яЁё0-9_]+"
CAMEL = r"(?<=[a-zа-яё0-9])(?=[A-ZА-ЯЁ])|(?<=[A-ZА-ЯЁ])(?=[A-ZА-ЯЁ][a-zа-яё])|(?<=[A-Za-z])(?=[А-Яа-яЁё])|(?<=[А-Яа-яЁё])(?=[A-Za-z])"

# Endings that are cut from a word, in the order in which they are tried.
SUFFIXES = (
    "иями", "ями", "ами", "его", "ого", "ему", "ому", "ыми", "ими", "иях", "ах", "ях",
    "ия", "ья", "ий", "ый", "ой", "ее", "ие", "ые", "ое", "ей", "ам", "ям", "ом", "ем",
    "ов", "ев", "ую", "юю", "ая", "яя", "а", "я", "ы", "и", "у", "ю", "е", "о",
)

# Words of a question that say nothing about what is asked.
STOPWORDS = frozenset({
    "как", "где", "когда", "какой", "какая", "какие", "какое", "что", "это", "для", "про", "по",
    "из", "на", "в", "во", "с", "со", "и", "или", "у", "к", "от", "до", "над", "под", "без",
    "а", "же", "ли", "бы", "то", "не", "если", "при", "чтобы", "который", "которая", "которые",
    "мне", "нам", "нужно", "надо", "нужен", "нужна", "нужны", "понять", "подскажи", "подскажите",
    "ищу", "найди", "найти", "покажи", "показать", "посмотри", "посмотреть", "лежит", "лежат",
    "описан", "описана", "описано", "описаны", "работа", "работы", "работать", "работе",
    "конфигурация", "конфигурации", "база", "базе", "место", "месте", "объекте",
    "структура", "реквизиты", "реквизит", "табличная", "табличные", "табличной", "табличных",
    "часть", "части", "список", "справочник", "справочника", "документ", "документа", "журнал",
    "регистр", "сведений", "накопления", "метаданные", "метаданных", "объект", "объекта",
    "процедура", "функция", "метод", "модуль", "клиент", "сервер", "форма", "формы", "данные",
})
CODE_STOPWORDS = STOPWORDS | {"заполнение", "получить", "получение", "обработка", "обработать", "открыть", "форма", "форму"}

# Words that name a type of object, in the order in which the types are tried; word borders stand around each.
TYPE_WORDS = {
    "Catalog": (r"справочник(?:а|у|ом|е|и|ов)?", r"catalogs?"),
    "Document": (r"документ(?:а|у|ом|е|ы|ов)?", r"documents?"),
    "DocumentJournal": (r"журнал(?:а|у|ом|е|ы|ов)?", r"documentjournals?"),
    "InformationRegister": (r"регистр(?:а|у|ом|е|ы|ов)?\s+сведени(?:й|я|ям|ями|ях)", r"informationregisters?"),
    "AccumulationRegister": (r"регистр(?:а|у|ом|е|ы|ов)?\s+накоплени(?:я|й|ям|ями|ях)", r"accumulationregisters?"),
    "Enum": (r"перечислени(?:е|я|ю|ем|ях)", r"enums?"),
    "Constant": (r"констант(?:а|ы|у|е|ой|ами|ах)?", r"constants?"),
    "Role": (r"рол(?:ь|и|ей|ям|ями|ях)", r"roles?"),
    "CommonModule": (r"общ(?:ий|его|ему|им|ем)\s+модул(?:ь|я|ю|ем|е|и)", r"commonmodules?"),
}

# Phrases that show what a question is after.
STRUCTURE_PHRASES = ("структура", "реквизит", "реквизиты", "табличная часть", "табличные части", "измерения", "ресурсы")
REPORT_PHRASES = ("отчет", "отчеты", "report", "печат", "форма", "формат")
VALIDATION_PREFIXES = ("провер", "контрол", "ошиб", "нельзя", "запрет", "отказ", "проведен", "провест", "остат", "отриц", "недостат", "хват")
REGISTER_PREFIXES = ("взаиморасчет", "расчет", "задолж", "остат", "оборот", "движен", "денежн", "оплат", "цен", "себестоим")

# Groups of object types by how much they say.
STRUCTURE_TYPES = ("Catalog", "Document", "InformationRegister", "AccumulationRegister", "Enum", "ChartOfCharacteristicTypes", "ChartOfAccounts")
STRUCTURE_LOW_TYPES = ("Report", "CommonPicture", "Constant", "Role", "DocumentJournal")
PRIMARY_TYPES = (*STRUCTURE_TYPES, "CommonModule")
LOW_SIGNAL_TYPES = ("Constant", "Role", "CommonPicture", "DocumentJournal", "Subsystem", "StyleItem", "ScheduledJob", "XDTOPackage", "Style", "Language", "SessionParameter", "CommonCommand", "CommonForm")
REGISTER_TYPES = ("AccumulationRegister", "InformationRegister", "AccountingRegister", "CalculationRegister")
CORE_TYPES = ("Catalog", "Document", "InformationRegister", "AccumulationRegister")

# Reference types and the types of the objects they point to.
REFERENCE_TYPES = {
    "CatalogRef": "Catalog", "DocumentRef": "Document", "EnumRef": "Enum", "AccumulationRegisterRef": "AccumulationRegister", "InformationRegisterRef": "InformationRegister",
    "ChartOfAccountsRef": "ChartOfAccounts", "ChartOfCharacteristicTypesRef": "ChartOfCharacteristicTypes", "BusinessProcessRef": "BusinessProcess", "TaskRef": "Task", "ConstantRef": "Constant",
}
REFERENCE = r"([A-Za-z]+Ref)\.([A-Za-zА-Яа-яЁё0-9_]+)"

# Folders of an export and the types of the objects in them.
FOLDERS = {
    "Catalogs": "Catalog", "Documents": "Document", "Enums": "Enum", "InformationRegisters": "InformationRegister", "AccumulationRegisters": "AccumulationRegister", "ChartsOfAccounts": "ChartOfAccounts",
    "ChartsOfCharacteristicTypes": "ChartOfCharacteristicTypes", "CommonForms": "CommonForm", "CommonModules": "CommonModule", "Reports": "Report", "DataProcessors": "DataProcessor",
}

# Namespaces of the module language and the types of the objects in them.
NAMESPACES = {
    "Справочники": "Catalog", "Catalogs": "Catalog", "Документы": "Document", "Documents": "Document", "Перечисления": "Enum", "Enums": "Enum", "РегистрыСведений": "InformationRegister",
    "InformationRegisters": "InformationRegister", "РегистрыНакопления": "AccumulationRegister", "AccumulationRegisters": "AccumulationRegister", "ПланыСчетов": "ChartOfAccounts",
    "ChartsOfAccounts": "ChartOfAccounts", "ПланыВидовХарактеристик": "ChartOfCharacteristicTypes", "ChartsOfCharacteristicTypes": "ChartOfCharacteristicTypes", "БизнесПроцессы": "BusinessProcess",
    "BusinessProcesses": "BusinessProcess", "Задачи": "Task", "Tasks": "Task", "Константы": "Constant", "Constants": "Constant",
}

# Words before a bracket that are no calls.
CALL_KEYWORDS = (
    "процедура", "procedure", "функция", "function", "если", "иначеесли", "иначе", "для", "каждого", "пока", "попытка", "исключение", "возврат", "новый", "выполнить", "экспорт", "знач", "тогда",
    "конецесли", "конеццикла", "конецпопытки", "конецпроцедуры", "конецфункции",
)

# Annotations of extension methods and what they mean.
ANNOTATIONS = {"перед": "before", "before": "before", "после": "after", "after": "after", "вместо": "instead", "instead": "instead", "изменениеиконтроль": "change_and_validate", "changeandvalidate": "change_and_validate"}
# Annotations that say where a method runs.
CONTEXTS = (
    "наклиенте", "насервере", "насерверебезконтекста", "наклиентенасервере", "наклиентенасерверебезконтекста", "atclient", "atserver", "atservernocontext", "atclientatserver", "atclientatservernocontext",
)

# Tags of a form that are elements.
ELEMENT_TYPES = frozenset(
    """InputField LabelField Button UsualGroup Pages Page Table CheckBox CheckBoxField RadioButton ProgressBar Picture PictureField Calendar Chart SpreadSheetDocument TextDocument
    HTMLDocument CommandBar AutoCommandBar ContextMenu ExtendedTooltip SearchStringAddition ViewStatusAddition SearchControlAddition Label LabelDecoration GroupBox Popup CommandGroup
    Field Column""".split()
)
# Severities of a report by number.
SEVERITIES = {1: "error", 2: "warning", 3: "information", 4: "hint"}
SCHEMA_VERSION = 4

# --- signals and expansions (fixed values on which scores depend) -------------------------------------------------------
#: Beginnings of words that anchor a question in its objects; and word, rival, what it is worth with the word, with the rival alone.
ANCHOR_PREFIXES = ("договор", "контрагент", "поступлен", "приход", "товар", "расчет", "взаиморасчет", "остат", "цен", "заказ", "клиент", "покупател", "поставщик")
ANCHOR_RIVALS = (("договор", "контрагент", 2.2, -1.2),)
#: F8: phrases of methods that check a rule, and of methods that serve a form.
RULE_PHRASES = ("обработка проведения", "перед проведением", "проверка заполнения", "проверить заполнение", "проверить", "контроль", "отказ")
FORM_PHRASES = ("при изменении", "при активизации строки", "при начале редактирования", "начале редактирования", "при открытии", "при создании на сервере", "обработка выбора", "начало выбора", "очистить")
#: F8: label, where it is looked for, any of these phrases, weight; asked: only if the question has this; otherwise: the weight if it is asked and not found.
VALIDATION_SIGNALS = (
    ("rule_in_name", "method", RULE_PHRASES, 2.6, "", 0.0),
    ("rule_in_text", "document", RULE_PHRASES, 1.0, "", 0.0),
    ("posting", "method", ("обработка проведения",), 2.4, "", 0.0),
    ("before_posting", "method", ("перед проведением", "проведение"), 1.2, "", 0.0),
    ("check", "any", ("провер",), 1.0, "", 0.0),
    ("control", "any", ("контрол",), 1.0, "", 0.0),
    ("refusal", "any", ("отказ",), 1.1, "", 0.0),
    ("error", "any", ("ошиб", "исключение"), 0.8, "", 0.0),
    ("stock", "any", ("остат",), 0.8, "", 0.0),
    ("negative", "any", ("отриц", "недостат"), 1.3, "", 0.0),
    ("stock_asked", "any", ("остат",), 0.8, "остат", -0.9),
    ("negative_asked", "any", ("отриц", "недостат"), 0.7, "отриц", 0.0),
    ("form_handler", "method", FORM_PHRASES, -3.0, "", 0.0),
    ("change_handler", "method", ("при изменении", "при активизации строки"), -1.5, "", 0.0),
)
#: F8: module types, beginnings of the normalized path, and what they are worth; the first that holds counts.
VALIDATION_MODULES = ((("Documents", "CommonModules", "AccumulationRegisters"), "", 0.7), ((), "documents ", 0.6), ((), "data processors ", -0.3))
#: Q5: for a question about checks: all of the first and any of the second must be in it; the queries that are then asked as well.
CODE_EXPANSIONS = (
    ((), (), ("проверка бизнес правила проведение документа", "обработка проведения проверка отказ")),
    (("остат",), (), ("контроль остатков при проведении документа", "проверка отрицательных остатков проведение", "недостаточно товаров проведение документа отказ")),
    (("товар",), ("хвата", "нельзя", "провести"), ("контроль остатков товаров при проведении документа", "недостаточно товара проведение документа отказ", "проверка доступного остатка товара проведение")),
)
