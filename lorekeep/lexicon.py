"""Word lists, lookup tables and thresholds that results depend on."""

# Fixed values, as results require them; order matters where ties are broken by it.
KINDS = ("decision", "constraint", "preference", "task", "fact", "note")
ACTIONABILITY = {"decision": 0.22, "constraint": 0.20, "task": 0.17, "preference": 0.14, "fact": 0.11, "note": 0.06}
BASE_IMPORTANCE = {"decision": 0.84, "constraint": 0.82, "task": 0.78, "preference": 0.66, "fact": 0.63, "note": 0.46}
BASE_CERTAINTY = {"decision": 0.90, "constraint": 0.88, "task": 0.82, "preference": 0.80, "fact": 0.77, "note": 0.70}
STOP_WORDS = (
    "a an and are as at be by do for from how if in into is it of on or that the this to we what when where why with "
    "але без було бути в ви вже він вона воно для до є за з і й її їх коли ми на не ні про та те ти то у це цей ця що як"
).split()
KIND_HINTS = {
    "decision": (
        "we decided", "decision", "switch to", "replace", "adopt", "selected", "choose", "chosen", "agreed",
        "вирішили", "обрали", "переходимо", "замінюємо", "прийнято рішення", "ухвалено рішення", "рішення", "ухвалили", "вирішено", "ухвалено",
    ),
    "constraint": (
        "must", "must stay", "cannot", "cant", "never", "limit", "budget", "required", "should stay",
        "обовязково", "повинно", "має", "не можна", "ліміт", "бюджет",
    ),
    "task": (
        "todo", "next step", "follow up", "need to", "implement", "fix", "add", "ship",
        "зробити", "треба", "потрібно", "додати", "виправити", "реалізувати",
    ),
    "preference": (
        "prefer", "would rather", "want", "avoid", "ideally",
        "краще", "хочемо", "уникаємо", "бажано", "надає перевагу", "віддає перевагу", "надаю перевагу", "волію",
    ),
    "fact": ("currently", "today", "uses", "contains", "runs on", "станом", "використовує", "містить", "працює на"),
}
#: Extra points: (kind, points, words of which one is contained).
KIND_BONUS = (
    ("constraint", 1, ("must", "never", "cannot", "повинно", "не можна")),
    ("decision", 1, ("decided", "switch to", "replace", "вирішили", "обрали", "рішення", "ухвалили")),
)
#: Extra points: (kind, points, beginnings of which one is present).
KIND_OPENINGS = (("task", 4, ("todo", "next step")), ("note", 2, ("note",)))
STRONG_WORDS = ("must", "critical", "production", "security", "deadline", "blocked", "important", "never", "обовязково", "критично", "дедлайн", "блокер")
HEDGE_WORDS = ("maybe", "might", "perhaps", "probably", "consider", "idea", "possibly", "можливо", "мабуть", "ідея")
TITLE_OPENINGS = {
    "decision": r"^(?:we\s+decided\s+to|decided\s+to|decision:\s*|we\s+will\s+|switch\s+to\s+|adopt\s+|use\s+|вирішили\s+|обрали\s+|будемо\s+|переходимо\s+на\s+|замінюємо\s+|прийнято\s+рішення\s+|ухвалено\s+рішення\s+|вирішено\s+|ухвалили\s+)",
    "constraint": r"^(?:must\s+|must\s+stay\s+|cannot\s+|never\s+|should\s+|обовязково\s+|повинно\s+|має\s+|не\s+можна\s+)",
    "task": r"^(?:todo:\s*|todo\s+|need\s+to\s+|implement\s+|fix\s+|add\s+|зробити\s+|треба\s+|потрібно\s+|додати\s+|виправити\s+|реалізувати\s+)",
    "preference": r"^(?:prefer\s+|want\s+|avoid\s+|краще\s+|хочемо\s+|уникаємо\s+|бажано\s+)",
}
#: The first that fits is taken off.
SUFFIXES = (
    "ування аються ається юються ується ються ється "
    "ятями яттю ятей ятям ятях яті яте "
    "ення ання іння ивши авши уючи "
    "ила или ило ати яти ити іти ути ого ому ими ями ена ане ені ані ене "
    "ить ать ять ють уть ємо ою ів ам ом ах их ує"
).split()
PREFIXES = "пере роз при над під про від ви за на по до не об".split()
STEM_LEAST = 3
PREFIX_ROUNDS = 2
APOSTROPHES = "'’‘ʼ"
SEGMENT_LEAST, SEGMENT_MOST, SEGMENTS = 12, 320, 24
NEAR_DUPLICATE = 0.72
DUPLICATE_CANDIDATES = 6
TITLE_WORDS, TITLE_CHARS, SUMMARY_CHARS, EXCERPT_CHARS, SOURCE_CHARS = 10, 72, 180, 220, 240
QUERY_TERMS, TAG_TERMS, TAGS = 8, 10, 6
HALF_LIFE_DAYS, RECENCY_DAYS = 30.0, 14.0
DECAY_KINDS, DECAY_THRESHOLD, DECAY_AGE_DAYS, DECAY_ACCESS = ("note", "fact"), 0.35, 30, 1
BM25_K1, BM25_B, BM25_IDF_FLOOR = 1.2, 0.75, 1e-6
#: Weights of the indexed columns.
WEIGHTS = {"title": 5.0, "summary": 2.5, "content": 1.0, "tags_text": 1.5, "stems_text": 1.0}
VERSION = 4
