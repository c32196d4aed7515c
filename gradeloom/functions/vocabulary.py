"""Words, labels and patterns that results depend on."""

# Mark types in order, their labels and the label lookup.
MARK_TYPES = ("fard1", "fard2", "fard3", "fard4", "activities")
LABELS = {"fard1": "الفرض الأول", "fard2": "الفرض الثاني", "fard3": "الفرض الثالث", "fard4": "الفرض الرابع", "activities": "الأنشطة"}
LABEL_TO_TYPE = {
    "الفرض 1": "fard1",
    "الفرض الأول": "fard1",
    "فرض 1": "fard1",
    "الفرض 2": "fard2",
    "الفرض الثاني": "fard2",
    "فرض 2": "fard2",
    "الفرض 3": "fard3",
    "الفرض الثالث": "fard3",
    "فرض 3": "fard3",
    "الفرض 4": "fard4",
    "الفرض الرابع": "fard4",
    "فرض 4": "fard4",
    "الأنشطة": "activities",
    "النشاط": "activities",
    "أنشطة": "activities",
}

# White space as the reference's patterns mean it.
SPACE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
ARABIC = "\\u0600-\\u06FF"

# Recognised text. Mark types, header lines, titles and summary words.
DETECT = {
    "fard1": "فرض\\s*(?:1|١|الأول|اول)",
    "fard2": "فرض\\s*(?:2|٢|الثاني|ثاني)",
    "fard3": "فرض\\s*(?:3|٣|الثالث|ثالث)",
    "fard4": "فرض\\s*(?:4|٤|الرابع|رابع)",
    "activities": "الأنشطة|النشاط|المراقبة\\s*المستمرة|مراقبة\\s*مستمرة|أنشطة",
}
HEADER_LINE = (
    "اسم.*الفرض|الفرض.*اسم",
    "التلميذ.*الفرض|الفرض.*التلميذ",
    "رقم.*اسم.*الفرض",
    "الاسم.*الفرض.*الأنشطة",
    "name.*fard|fard.*name",
    "student.*mark|mark.*student",
    "رقم|الاسم|الفرض|الأنشطة",
    "number|name|fard|activities",
)
TITLE_KIND = (("number", "(?iu)رقم|الرقم|number"), ("name", "(?iu)اسم|الاسم|التلميذ|name|student"), ("mark", "(?iu)الفرض|الأنشطة|fard|activities"))
TITLE_TYPE = (
    ("fard1", "الفرض1|الفرض١|فرض1|فرض١|fard1|الاول|الأول"),
    ("fard2", "الفرض2|الفرض٢|فرض2|فرض٢|fard2|الثاني|ثاني"),
    ("fard3", "الفرض3|الفرض٣|فرض3|فرض٣|fard3|الثالث|ثالث"),
    ("fard4", "الفرض4|الفرض٤|فرض4|فرض٤|fard4|الرابع|رابع"),
    ("activities", "الانشطه|الأنشطة|النشاط|المراقبهالمستمره|المراقبةالمستمرة|activities"),
)
STRICT_HEADERS = (
    "الاسم الكامل",
    "اسم التلميذ",
    "الفرض الأول",
    "الفرض الثاني",
    "الفرض الثالث",
    "الأنشطة المدمجة",
    "المجموع العام",
    "المعدل العام",
    "المجموع",
    "المعدل",
    "total",
    "average",
)
SUMMARY_WORDS = ("المجموع", "المعدل", "total", "average", "sum", "إجمالي", "الإجمالي")
SUMMARY_NAMES = ("المجموع", "المعدل", "إجمالي", "الإجمالي")

# Sheets. Indicators, header words, column titles and labels.
OFFICIAL_WORDS = ("رقم التلميذ", "إسم التلميذ", "الفرض", "النقطة", "مسار", "القسم")
HEADER_WORDS = ("رقم التلميذ", "إسم التلميذ", "تاريخ", "رقم", "اسم")
NAME_TITLES = (
    "الاسم الكامل",
    "اسم التلميذ",
    "الاسم",
    "إسم التلميذ",
    "اسم الطالب",
    "التلميذ",
    "الطالب",
    "اسم المتعلم",
    "المتعلم",
    "nom et prénom",
    "nom",
    "prénom",
    "nom complet",
    "eleve",
    "élève",
    "nom de l'élève",
)
ID_TITLES = ("رقم التلميذ", "رقم", "ر.ت", "ر.م", "الرقم", "المسلسل", "رقم الطالب", "الرقم الترتيبي", "ت", "id", "الرقم التسلسلي")
MARK_TITLES = {
    "fard1": ("الفرض 1", "الفرض الأول", "فرض 1", "فرض١", "اختبار 1", "امتحان 1", "تقويم 1"),
    "fard2": ("الفرض 2", "الفرض الثاني", "فرض 2", "فرض٢", "اختبار 2", "امتحان 2", "تقويم 2"),
    "fard3": ("الفرض 3", "الفرض الثالث", "فرض 3", "فرض٣", "اختبار 3", "امتحان 3", "تقويم 3"),
    "fard4": ("الفرض 4", "الفرض الرابع", "فرض 4", "فرض٤", "اختبار 4", "امتحان 4", "تقويم 4"),
    "activities": ("الأنشطة", "النشاط", "أنشطة", "المهارات", "الأداء", "نشاط", "تطبيقات", "مراقبة مستمرة"),
}
FUZZY_TITLES = {f"fard{k}": f"فرض.*{k}|{k}.*فرض|اختبار.*{k}|{k}.*اختبار|امتحان.*{k}|{k}.*امتحان" for k in (1, 2, 3, 4)}
TEST_LABELS = {
    "fard1": ("الفرض الأول", "الفرض 1", "فرض 1", "فرض الأول", "فرض١"),
    "fard2": ("الفرض الثاني", "الفرض 2", "فرض 2", "فرض الثاني", "فرض٢"),
    "fard3": ("الفرض الثالث", "الفرض 3", "فرض 3", "فرض الثالث", "فرض٣"),
    "fard4": ("الفرض الرابع", "الفرض 4", "فرض 4", "فرض الرابع", "فرض٤"),
    "activities": ("الأنشطة", "النشاط", "أنشطة", "المراقبة المستمرة", "مراقبة مستمرة"),
}
SCORE_LABEL = "النقطة"
STRONG_TITLES = {
    "fard1": ("فرض 1", "فرض الأول", "فرض١"),
    "fard2": ("فرض 2", "فرض الثاني", "فرض٢"),
    "fard3": ("فرض 3", "فرض الثالث", "فرض٣"),
    "fard4": ("فرض 4", "فرض الرابع", "فرض٤"),
    "activities": ("أنشطة", "نشاط"),
}
WEAK_TITLES = {"fard1": ("فرض", "1"), "fard2": ("فرض", "2"), "fard3": ("فرض", "3"), "fard4": ("فرض", "4")}  # both words
WEAK_ACTIVITIES = ("أداء", "مهارات")  # either word
EXTRA_TITLES = ("فرض", "امتحان", "اختبار", "تقويم")
META_LABELS = {"level": ("المستوى", "مستوى", "المستوي"), "section": ("القسم", "قسم", "الفوج", "الشعبة", "الفصل")}
NO_COLUMN = "غير متوفر"

# Layouts of known documents.
TEMPLATES = (
    ("massar-standard", 1, 0, {"fard1": 2, "fard2": 4, "fard3": 6, "activities": 8}, 2),
    ("massar-alternative", 2, 0, {"fard1": 3, "fard2": 5, "fard3": 7, "activities": 9}, 2),
    ("custom-school-format", 2, 0, {"fard1": 3, "fard2": 4, "activities": 5}, 2),
)

# Recommendations in words of our own, by rule.
ADVICE = {
    "low_pass": "أقل من ستين في المئة من النقط ناجحة: يُستحسن تنظيم حصص دعم لهذا القسم.",
    "low_average": "معدل القسم في %s دون عشرة.",
    "spread": "النقط في %s متباعدة: الانحراف المعياري %.2f، فقد يحتاج القسم إلى عمل بالمجموعات.",
    "missing": "أكثر من عُشر النقط غائب في %s: يرجى مراجعة ما أُدخل.",
}

# Usage events and upload gates.
USAGE_EVENTS = ("app_launched", "license_activated", "license_validated", "image_uploaded", "ocr_started", "ocr_completed", "ocr_failed", "marks_insertion_started", "marks_insertion_completed", "marks_insertion_failed", "app_restarted", "error_occurred")
IMAGE_TYPES = ("image/jpeg", "image/jpg", "image/png", "image/webp")
