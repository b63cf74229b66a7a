"""Word lists and patterns of request understanding.

All of it is data, and a caller may pass other tables of the same form. Patterns
are matched against lower-cased text with the letter yo as ye, are free of word
boundaries and look-arounds, and so mean the same in Java's and RE2's dialect.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Direction:
    value: str
    label: str
    interests: tuple[str, ...]
    pattern: str


@dataclass(frozen=True)
class Activity:
    name: str
    terms: tuple[str, ...]
    interests: tuple[str, ...]
    direction: str
    patterns: tuple[str, ...]


# --- fixed values: directions, interests, activities, in order of precedence

DIRECTIONS = (
    Direction("technical", "Техническая", ("building", "logic"), "техническ|робот|программ|инженер|констру|3d|модел|информат|технолог"),
    Direction("art", "Художественная", ("creative",), "художеств|рисован|рисовать|лепк|дизайн|музык|вокал|танц|театр|творческ"),
    Direction("sport", "Физкультурно-спортивная", ("sports",), "спорт|плаван|футбол|хокке|гимнаст|самбо|дзюдо|борьб|баскет|волей"),
    Direction("social", "Социально-гуманитарная", ("social",), "социальн|гуманитар|общени|лидер|журналист|волонтер|английск|язык"),
    Direction("science", "Естественно-научная", ("logic",), "естественно|научн|биолог|хими|физик|математ|исследован|эколог"),
    Direction("tourism", "Туристско-краеведческая", ("sports", "social"), "туризм|турист|краевед|поход|экскурс|ориентирован"),
)

INTERESTS = (
    ("creative", "рис|леп|твор|дизайн|мастер|худож|придум|музык|танц|поделк|вокал"),
    ("building", "робот|констру|собират|инженер|3d|модел|техн"),
    ("sports", "спорт|плав|футбол|хокке|гимнаст|самбо|дзюдо|борьб|бег|волейбол|баскетбол"),
    ("social", "обща|друз|команд|театр|сцен|выступ|лидер|журналист"),
    ("logic", "логик|математ|программ|шахмат|как все устроено|информат|физик"),
    ("calm", "спокой|усидчив|в своем темпе|не спеша"),
)

ACTIVITIES = (
    Activity("баскетбол", ("баскетбол", "баскет"), ("sports",), "sport", ("баскетбол[а-я]*", "баскет")),
    Activity("футбол", ("футбол",), ("sports",), "sport", ("футбол[а-я]*",)),
    Activity("волейбол", ("волейбол",), ("sports",), "sport", ("волейбол[а-я]*",)),
    Activity("хоккей", ("хоккей", "хокке"), ("sports",), "sport", ("хокке[а-я]*",)),
    Activity("плавание", ("плавание", "плав"), ("sports",), "sport", ("плаван[а-я]*",)),
    Activity("гимнастика", ("гимнастика", "гимнаст"), ("sports",), "sport", ("гимнаст[а-я]*",)),
    Activity("самбо", ("самбо",), ("sports",), "sport", ("самбо",)),
    Activity("дзюдо", ("дзюдо",), ("sports",), "sport", ("дзюдо",)),
    Activity("борьба", ("борьба", "борьб"), ("sports",), "sport", ("борьб[а-я]*",)),
    Activity("бокс", ("бокс",), ("sports",), "sport", ("бокс[а-я]*",)),
    Activity("каратэ", ("каратэ", "карате"), ("sports",), "sport", ("карат[эе]",)),
    Activity("пауэрлифтинг", ("пауэрлифтинг",), ("sports",), "sport", ("пауэрлифтинг[а-я]*",)),
    Activity("лыжные гонки", ("лыжные гонки", "лыж"), ("sports",), "sport", ("лыж[а-я]*",)),
    Activity("теннис", ("теннис",), ("sports",), "sport", ("теннис[а-я]*",)),
    Activity("настольный теннис", ("настольный теннис", "теннис"), ("sports",), "sport", ("настольн[а-я]* +теннис[а-я]*",)),
    Activity("шахматы", ("шахматы", "шахмат"), ("logic", "calm"), "science", ("шахмат[а-я]*",)),
    Activity("робототехника", ("робототехника", "робот"), ("building", "logic"), "technical", ("робот[а-я]*",)),
    Activity("программирование", ("программирование", "программ"), ("logic", "building"), "technical", ("программ[а-я]*",)),
    Activity("конструирование", ("конструирование", "констру"), ("building",), "technical", ("констру[а-я]*",)),
    Activity("рисование", ("рисование", "рис"), ("creative", "calm"), "art", ("рисован[а-я]*|рису[а-я]*",)),
    Activity("танцы", ("танцы", "танц", "хореография"), ("creative", "social"), "art", ("танц[а-я]*", "хореограф[а-я]*")),
    Activity("вокал", ("вокал", "пение"), ("creative", "social"), "art", ("вокал[а-я]*|пени[а-я]*",)),
    Activity("театр", ("театр", "театральная студия"), ("creative", "social"), "art", ("театр[а-я]*",)),
)

# --- fixed values: words before an activity, and what is no activity behind them

TRIGGERS = ("по", "любит", "нравится", "интересует", "интересуется", "ищем", "нужны", "нужно", "хочет")
STOPWORDS = (
    "занятия", "занятие", "кружок", "кружки", "программа", "программы", "ребенок", "ребенку", "мальчик", "мальчика", "девочка", "девочку", "сын", "сыну", "дочь", "дочке", "лет", "года", "город", "оленегорск", "оленегорске", "мурманск", "мурманске",
)
TERM_ENDINGS = "ом|ем|ами|ями|ах|ях|ов|ев|ам|ям|ой|ей|ую|юю|а|я|у|ю|е|ы|и"
NEGATIONS = "не|без|кроме|исключить|исключая|но не"

# --- fixed values: ages by words, days, forms, goals and avoidances, in order of precedence

AGE_WORDS = (("первоклассник|первый класс", 7), ("подросток", 13), ("школьник", 8))
SCHEDULE = (("weekdays", "будн|после школы"), ("weekends", "выходн|суббот|воскрес"), ("morning", "утр"), ("evening", "вечер|после школы"))
FORMS = ((2, "очно[- ]?заочн|смешан|гибрид|частично +(онлайн|дистанц|очно)"), (3, "заочн|онлайн|дистанц|удален"), (1, "очн|офлайн|на месте|в аудитори|рядом"))
GOALS = (("first_try", "первый кружок|первый опыт|в первый раз"), ("strengths", "практическ|навык|сильн"), ("social", "общени|друз"), ("discipline", "дисциплин|режим"), ("interest", "интерес|нрав"))
AVOIDANCES = (
    ("noise", "(не любит|боится|избега).{0,24}(шум|шумн|больш)"), ("strict", "(не любит|боится|избега).{0,24}(жестк|строг)"), ("stage", "(не любит|боится|избега).{0,24}(выступ|сцен)"),
    ("routine", "однообраз|рутин"), ("intense", "слишком актив|перегруз|интенсив|активный темп"),
)
EXPERIENCE = (("active", "уже ход|уже заним|ходит в круж|занимаетс"), ("new", "(ищем|хотим).{0,20}нов"), ("tried", "пробовал|пробовали|ходили,? но|не зашло|не закрепил"), ("none", "не ходил|никогда не ходил|пока не ходил"))
ADAPTATION = (("fast", "сразу проб|быстро включа"), ("careful", "сначала присматрива|осторожно вход|нужно освоитьс"), ("soft", "мягк.*адаптац|спокойн.*адаптац|нужно время на адаптац"), ("depends", "зависит от обстанов|зависит от ситуации"))
TRAJECTORY = "траектор|план на год|годовой план"
CALM_WISHES = "не любит актив|не подходит актив|не любит интенсив|спокойн"

# --- fixed values: settlements of the catalogue's region, and the endings that a name takes by its own ending

PLACES = """
Заполярный
Никель
Печенга
Борисоглебский
Вайда-Губа
Корзуново
Лиинахамари
Луостари
Приречный
Путевая Усадьба 9 км железной дороги Луостари-Никель
Раякоски
Сальмиярви
Спутник
Цыпнаволок
Титовка
Ковдор
Ёнский
Риколатва
Куропта
Лейпи
Ёна
Апатиты
Тик-Губа
Хибины
Кировск
Коашва
Титан
Мончегорск
25 км железной дороги Мончегорск-Оленья
27 км железной дороги Мончегорск-Оленья
Оленегорск
Имандра
Высокий
Лапландия
Ягельный Бор
Полярные Зори
Зашеек
Африканда
Кандалакша
Зеленоборский
Белое Море
Зареченск
Кайралы
Куолоярви
Лесозаводский
Нивский
Пояконда
Приозерный
Алакуртти
Княжая Губа
Ковда
Ковдозеро
Колвица
Лувеньга
Федосеевка
Жемчужная
Нямозеро
Пинозеро
Проливы
Ручьи
Умба
Восточное Мунозеро
Индель
Маяк Никодимский
Варзуга
Кузомень
Кашкаранцы
Оленица
Пялица
Тетрино
Чаваньга
Чапома
Ревда
Ловозеро
Каневка
Краснощелье
Сосновка
Кола
Верхнетуломский
Кильдинстрой
Молочный
Мурмаши
Туманный
Белокаменка
Минькино
Пулозеро
Териберка
Тулома
Ура-Губа
Восточный Кильдин
Голубые Ручьи
Дальние Зеленцы
Западный Кильдин
Зверосовхоз
Килпъявр
Междуречье
Мишуково
Мокрая Кица
Остров Большой Олений
Песчаный
Пушной
Ретинское
Светлый
Шонгуй
Выходной
Кица
Лопарская
Магнетиты
Нял
Пяйве
Тайбола
Мурманск
Североморск
Сафоново
Североморск-3
Щукозеро
Островной
Лумбовка
Корабельное
Святой Нос
Мыс-Чёрный
Маяк-Городецкий
Терско-Орловский Маяк
Заозерск
Видяево
Чан-Ручей
Полярный
Гаджиево
Снежногорск
Кувшинская Салма
Оленья Губа
Сайда-Губа
""".strip().split("\n")

#: Ending of a word of five letters or more: letters that it loses, endings that it takes instead.
NAME_ENDINGS = (
    ("ск", 0, "|е|а|у|ом"), ("ый", 2, "ый|ого|ому|ым|ом"), ("ий", 2, "ий|его|ему|им|ем"), ("ая", 2, "ая|ой|ую"), ("ое", 2, "ое|ом"), ("а", 1, "а|е|у|ой|ы"), ("я", 1, "я|е|ю|ей|и"), ("о", 1, "о|е|ом|а"),
    ("ь", 1, "ь|е|я|ю|ем"), ("ы", 1, "ы|ах|ам|ами|ов"), ("и", 1, "и|ах|ам|ами|ов"), ("", 0, "|е|а|у|ом"),
)

# --- end of fixed values
