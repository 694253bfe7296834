"""Column functions against literal cases, and the plain versions against the columns."""

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import enrich, plain, text as T
from lorekeep.operators import segment


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in enumerate(values)))
    return df.select(f(*[F.col(f"c{k}") for k in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("П'ятниця", "пятниця"), ("Зʼїзд", "зїзд"), ("it's o'clock", "its oclock"), ("isn’t", "isnt"), ("  a_b - C!! ", "a_b - c"), (None, ""), ("", "")])
def test_canonicalize(spark, raw, want):
    assert one(spark, T.canonicalize, raw) == want
    if raw is not None:
        assert plain.canonical(raw) == want


@pytest.mark.parametrize(
    "word,stem",
    [("зробили", "зроб"), ("зробила", "зроб"), ("готується", "гот"), ("пишу", "пишу"), ("значення", "знач"), ("змінюються", "змін"), ("читання", "чит"), ("нового", "нов"), ("archive", "archive"), ("ось", "ось"), ("мрія", "мрія"), ("сади", "сади")],
)
def test_light_stem(spark, word, stem):
    assert one(spark, T.light_stem, word) == stem


@pytest.mark.parametrize("word", ["столом", "столах", "столам", "столів", "Столам"])
def test_deep_stem_of_declensions(spark, word):
    assert one(spark, lambda c: T.deep_stem(T.canonicalize(c)), word) == "стол"


def test_deep_stem(spark):
    assert one(spark, T.deep_stem, "заготовила") == "готов"
    for w in ("перечитали", "переробили", "недороблене", "значення", "заготовила", "data"):
        assert one(spark, T.deep_stem, w) == plain.stem(w)


def test_search_phrases(spark):
    got = one(spark, T.search_phrases, "archive restore drill")
    assert [(p.text, p.scoped) for p in got] == [("archive", False), ("restore", False), ("drill", False)]
    got = one(spark, T.search_phrases, "заготовити заготовила заготовлення")
    assert [(p.text, p.scoped) for p in got] == [("заготов", False)] * 2 + [("заготовл", False), ("готов", True), ("готовл", True)]
    assert [(p.text, p.scoped) for p in one(spark, lambda c: T.search_phrases(c, False), "зробили")] == [("зробили", False)]


def test_terms_skip_stop_words(spark):
    assert one(spark, T.query_terms, "Ми хочемо зберегти журнал на рік for the auditors") == ["хочемо", "зберегти", "журнал", "рік", "auditors"]
    assert len(one(spark, T.query_terms, " ".join(f"word{i}" for i in range(20)))) == 8


def test_overlap(spark):
    a, b = "The nightly job writes its report to the shared folder.", "The nightly job writes its report to the shared folder before six on weekdays."
    assert one(spark, lambda x, y: T.overlap(T.semantic_terms(x), T.semantic_terms(y)), a, b) >= 0.72
    assert one(spark, lambda x, y: T.overlap(T.semantic_terms(x), T.semantic_terms(y)), a, "") == 0


@pytest.mark.parametrize(
    "saying,kind,importance,certainty",
    [
        ("We agreed to adopt columnar files for the archive.", "decision", 0.84, 0.90),
        ("Backups must never leave the production network.", "constraint", 0.97, 0.94),
        ("Next step: document the restore drill.", "task", 0.78, 0.82),
        ("Maybe we should avoid nested loops, ideally.", "preference", 0.71, 0.62),
        ("Перейти на новий формат вирішили вчора.", "decision", None, None),
        ("Краще тримати журнал окремо.", "preference", None, None),
        ("Сервер працює на старому залізі.", "fact", None, None),
        ("", "note", 0.38, 0.70),
    ],
)
def test_enrichment(spark, saying, kind, importance, certainty):
    df = spark.createDataFrame([(saying,)], "s string").withColumn("k", enrich.infer_kind(F.col("s")))
    r = df.select("k", enrich.infer_importance(F.col("s"), F.col("k")).alias("i"), enrich.infer_certainty(F.col("s"), F.col("k")).alias("c")).first()
    assert r.k == kind
    if importance is not None:
        assert (r.i, r.c) == (importance, certainty)


def test_title_and_summary(spark):
    assert one(spark, lambda c: T.derive_title(c, F.lit("decision")), "We decided to keep one log for each region.") == "keep one log for each region"
    assert one(spark, lambda c: T.derive_title(c, F.lit("decision")), "Вирішили скоротити журнал подій") == "скоротити журнал подій"
    assert one(spark, T.derive_summary, "\n  \n first line \nsecond") == "first line"
    assert one(spark, T.derive_summary, "x" * 200) == "x" * 177 + "..."


def test_excerpt(spark):
    body = "a" * 100 + " needle " + "b" * 300
    got = one(spark, lambda s, c, t: T.excerpt(s, c, t), "", body, ["needle"])
    assert got.startswith("...") and got.endswith("...") and "needle" in got and len(got) <= 220
    assert one(spark, lambda s, c, t: T.excerpt(s, c, t), "", body, ["zzz"]) == body[:217] + "..."


def test_merging_texts(spark):
    assert one(spark, T.merge_sources, "talk-7", "talk-8; talk-7") == "talk-7; talk-8" == plain.sources("talk-7", "talk-8; talk-7")
    for a, b in (("few words", "rather more words about the weekly archive"), ("same words", "words same"), ("", "x")):
        assert one(spark, T.richer, a, b) == plain.richer(a, b)
    long = "word " * 30
    assert one(spark, lambda a, b: T.richer(a, b, 72), "a", long) == plain.richer("a", long, 72)


def test_plain_versions_agree(spark):
    for s in ("П'ятниця: переробили звіт столами the Archive!", "naïve café 123 _x_", "", "  "):
        assert tuple(one(spark, T.semantic_terms, s)) == plain.terms(s)
        assert one(spark, lambda c: T.stems_text(c, c, F.array(F.lit("tag"))), s) == plain.stems(s, s, ["tag"])
        assert one(spark, lambda c: T.fingerprint(c, F.lit("note"), c, c), s) == plain.fingerprint(s, "note", s, s)


def test_segments(spark):
    assert one(spark, segment.segments, "Журнал тепер окремо. Копії робимо щодня.") == ["Журнал тепер окремо.", "Копії робимо щодня."]
    assert one(spark, segment.segments, "- first item here\n* second item here\n1) first item here\n2. tiny") == ["first item here", "second item here"]
    assert one(spark, segment.segments, None) == [] == one(spark, segment.segments, "")
    long = " ".join(f"Sentence number {i} is here." for i in range(40)) + "\nanother line of text"
    parts = one(spark, segment.segments, long)
    assert all(len(p) <= 320 for p in parts) and " ".join(parts[:-1]).startswith("Sentence number 0") and parts[-1] == "another line of text"
    assert len(one(spark, segment.segments, "\n".join(f"line number {i} of many" for i in range(50)))) == 24


def test_long_sources_and_titles_are_cut(spark):
    names = "; ".join(f"source number {k}" for k in range(40))
    got = one(spark, T.merge_sources, names, "last")
    assert got == plain.sources(names, "last") and len(got) <= 240 and got.endswith("...")
    for kind, opening in (("constraint", "Never "), ("task", "TODO: "), ("preference", "Prefer "), ("fact", ""), ("note", "")):
        assert one(spark, lambda c: T.derive_title(c, F.lit(kind)), f"{opening}mix the two archives.") == "mix the two archives"
    title = one(spark, lambda c: T.derive_title(c, F.lit("note")), "extraordinarily " * 12)
    assert title == " ".join(["extraordinarily"] * 4)


def test_beginnings_equal_those_of_whole_texts(spark):
    odd = [None, "", " \u200b\ufeff\x1c ", "one", "\n\n one\u00a0two\tthree\u3000four  five six seven eight nine ten eleven", "\x85a b\r\nc", "'' -", "a  b"]
    df = spark.createDataFrame([(x,) for x in odd], "x string")
    for r in df.select("x", T.normalize_space(F.col("x")).alias("n"), T.first_words(F.col("x"), 10).alias("w"), T.blank(F.col("x")).alias("b")).collect():
        assert r.w == " ".join(r.n.split(" ")[:10]) and r.b == (r.n == "") and r.n == plain.squeeze(r.x or "")
