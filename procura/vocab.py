"""Default word lists, limits and labels.

Fixed values: results depend on every entry below being exactly as written, so
they are kept together, in plain text. Each one is only a default and can be
replaced through the matching argument of the function that uses it.
"""

# --- listing columns, in order of preference -------------------------------
URL_COLUMNS = (
    "Ссылка",
    "URL",
    "Url",
    "Ссылка на закупку",
    "Карточка",
    "Link",
    "Номер извещения (ссылка на источник)",
)
ID_COLUMNS = (
    "Номер",
    "№",
    "Номер закупки",
    "ID",
    "Код",
    "Номер извещения (ссылка на источник)",
)
TITLE_COLUMNS = (
    "Наименование",
    "Предмет",
    "Название",
    "Объект закупки",
    "Наименование лота",
)
DEADLINE_COLUMNS = (
    "Дата окончания приема заявок",
    "Дата окончания подачи заявок",
    "Окончание подачи",
)
CUSTOMER_COLUMNS = ("Заказчик", "Организатор")
CUSTOMER_INN_COLUMNS = ("ИНН Заказчика", "ИНН Организатора")
PLACEHOLDER_IDS = ("источник", "source")

# --- portal and links: examples, each replaced by an argument ------------------
PORTAL_LABEL = "portal"
PORTAL_HOST = "cards.portal.example.org"
PORTAL_CARD_MARKER = "/tender/"
PORTAL_HOSTS = ("cards.portal.example.org", "portal.example.org")
PORTAL_SERVICE_HOST = "service.portal.example.org"
IGNORED_HOSTS = ("t.me", "telegram.me", "vk.cc", "youtube.com", "youtu.be")
DOCUMENT_EXTENSIONS = (
    ".pdf",
    ".doc",
    ".docx",
    ".xls",
    ".xlsx",
    ".zip",
    ".rar",
    ".rtf",
    ".txt",
)
DOCUMENT_KEYWORDS = ("скач", "влож", "download", "file")
SOURCE_KEYWORDS = ("tender", "zakup", "purchase", "process", "trade")
LINK_PATTERNS = (
    ("*=", "download"),
    ("*=", "file"),
    ("*=", "document"),
    ("$=", ".pdf"),
    ("$=", ".doc"),
    ("$=", ".docx"),
    ("$=", ".xls"),
    ("$=", ".xlsx"),
    ("$=", ".zip"),
)
FILENAME_CHARS = 180

# --- matching ---------------------------------------------------------------
STOPWORDS = (
    "оказание",
    "услуг",
    "работ",
    "закупка",
    "области",
    "продукты",
    "программные",
    "программного",
    "обеспечения",
    "разработка",
    "тестированию",
    "системы",
    "система",
    "информационных",
    "информационной",
    "проект",
    "проекта",
    "для",
    "по",
    "на",
    "и",
    "или",
    "в",
    "из",
    "ао",
    "ооо",
)
GENERIC_NAMES = (
    "техническое задание",
    "технические требования",
    "документация о закупке",
    "проект договора",
    "извещение",
    "форма коммерческого предложения",
    "договор",
    "смета",
)
PROJECT_MARKERS = (
    "crm",
    "энергосфера",
    "сотиассо",
    "seo",
    "аммиач",
    "сейсмо",
    "лаборатор",
    "спрут",
    "аквилон",
    "мобильн",
)
PRIORITY_KEYWORDS = (
    "техничес",
    "тз",
    "извещ",
    "документац",
    "договор",
    "коммерчес",
    "требован",
)
PRIORITY_EXTENSIONS = (".pdf", ".docx", ".doc")
UNREADABLE_ARCHIVES = (".rar", ".7z")
SKIPPED_NAMES = (".DS_Store",)
TOKEN_CHARS = 4
LONG_TOKEN_CHARS = 8
ID_SCORE = 100
CUSTOMER_SCORE = 3
MIN_SCORE = 4
TOP_CANDIDATES = 5
ACCEPT_SCORE = 8
ACCEPT_MARGIN = 3
MIN_CONFIDENCE = 60
FILES_PER_TENDER = 4
FRAGMENT_CHARS = 5_000

# --- classification and report ---------------------------------------------
DEFAULT_TAG = "Не изучено"
TAGS = (
    "Не наш тип работ",
    "Частично наш стек",
    "Не наш стек",
    "Не подходим по требованиям",
    "Мало опыта / кейсов",
    "Предварительно подходит",
    "В работу",
    "Подано",
    "Не успели обработать",
    "Не изучено",
)
MONTHS = (
    "Январь",
    "Февраль",
    "Март",
    "Апрель",
    "Май",
    "Июнь",
    "Июль",
    "Август",
    "Сентябрь",
    "Октябрь",
    "Ноябрь",
    "Декабрь",
)
UNDATED_SHEET = "Без даты"
UNTITLED_FOLDER = "Без названия"
FOLDER_BYTES = 180
DIRNAME_CHARS = 100

# --- messages ---------------------------------------------------------------
NO_FILES_COMMENT = "Документы не скачаны, поэтому классификация невозможна."
NO_FILES_ANALYSIS = "Документы не были скачаны, анализ невозможен."
NO_COMMENT = "Комментарий не был возвращён моделью."
NOT_JSON_COMMENT = (
    "Модель вернула ответ не в JSON-формате, "
    "поэтому классификация не распознана автоматически."
)
PROVIDER_ERROR_PREFIX = "LLM provider не был вызван: "
BLOCKED_COMMENT = (
    "Документы не получены из-за антибот-защиты площадки, "
    "поэтому содержательная оценка тендера не проводилась."
)
BLOCKED_ERROR = (
    "Документы видны в карточке, но скачивание заблокировано "
    "антибот-защитой площадки."
)
NOTHING_FOUND_COMMENT = (
    "Документы не найдены ни в {portal}, ни по внешней ссылке, "
    "поэтому содержательная оценка тендера не проводилась."
)
NOTHING_FOUND_ERROR = (
    "Documents were not found in {portal} and no external source link was detected"
)
SOURCE_EMPTY_ERROR = "Documents were not found on the external source page"
PIPELINE_ERROR_COMMENT = "Не удалось обработать тендер из-за ошибки пайплайна."
STUB_NO_FILES = "без файлов"
STUB_COMMENT = "Stub provider вернул тестовый ответ для файлов: {files}."
STUB_ANALYSIS = (
    "Это тестовый ответ stub-провайдера. Алгоритм обработки, запись в Excel и "
    "маршрутизация файлов работают, но реальный LLM API в этом запуске не "
    "использовался."
)
STUB_CONFIDENCE = 1

# --- prompts ----------------------------------------------------------------
ANALYSIS_PROMPT = (
    "Ссылка на тендер: {url}\n\n"
    "{template}\n\n"
    "Дополнительное требование к формату ответа:\n"
    "Верни только JSON-объект без markdown-обёртки со следующими полями:\n"
    '{{"classification_tag": "один из заранее разрешённых тегов", '
    '"confidence_percent": "целое число от 0 до 100", '
    '"classification_comment": "одно предложение, почему выбран этот тег", '
    '"analysis_markdown": "полный структурированный анализ по пунктам 1-6"}}\n'
    "Разрешённые теги: {tags}.\n"
    "Если уверенность низкая, всё равно выбери самый подходящий тег и отрази "
    "сомнение в classification_comment."
)
MATCH_PROMPT_HEAD = (
    "Определи, к какому тендеру относится файл.\n"
    "Смотри только на имя файла и фрагмент текста файла.\n"
    "Выбери ровно один tender_id из списка или верни NONE, если файл нельзя "
    "надёжно привязать.\n"
    'Верни только JSON вида {"tender_id":"...", "confidence": 0-100, '
    '"reason":"..."}.\n\n'
    "Имя файла: "
)
MATCH_PROMPT_TEXT = "\n\nФрагмент текста файла:\n"
MATCH_PROMPT_OPTIONS = "\n\nКандидаты:\n"
MATCH_NO_TEXT = "[текст не извлечен]"
