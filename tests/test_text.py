from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelway.functions.labels import compose_label, is_good_grade, split_label
from labelway.functions.text import clean_text, has_words, is_blank, safe_key
from labelway.plans.hierarchy import drop_empty_texts

CLEAN = [
    (None, " "),
    ("", " "),
    (" \t\n", " "),
    ("Hello, World!", "hello world"),
    ("see https://a.b/c?d=1 now", "see now"),
    ("xhttp://a.b y", "x y"),
    ("HTTPS://A.B/c", "https a b c"),  # lower-casing comes after the URL step
    ("http:// alone", "http alone"),
    ("mail me@x.org today", "mail today"),
    ("@start end@ a@@b @@", "start end"),
    ("tel 8 (701) 123-45-67", "tel"),
    ("a1b22c", "a b c"),
    ("٣ ab٤c", "ab c"),  # Arabic digits
    ("½ and Ⅷ x²", "½ and ⅷ x²"),  # number letters stay
    ("snake_case __", "snake_case __"),
    ("no break space\u001cunit", "no break space unit"),
    ("Жалоба №5: «Дорога»", "жалоба дорога"),
    ("Қазақ тілі — ӘҒҚ", "қазақ тілі әғқ"),
    ("tab\tand\nline", "tab and line"),
    ("123", " "),
    ("…!?", " "),
    ("日本語テキスト。", "日本語テキスト"),
    ("emoji 😀 out", "emoji out"),
]


def test_clean_text_cases(spark):
    df = spark.createDataFrame(CLEAN, "text string, expected string")
    text = F.col("text")
    for row in df.select("*", clean_text(text).alias("got"), has_words(text).alias("words")).collect():
        assert row["got"] == row["expected"], row
        assert row["words"] == (row["expected"] != " "), row


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x4FF), max_size=40), min_size=1, max_size=40))
def test_clean_text_properties(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    once = clean_text(F.col("text"))
    words = has_words(F.col("text"))
    for row in df.select(once.alias("a"), clean_text(once).alias("b"), words.alias("words")).collect():
        a = row["a"]
        assert row["words"] == (a != " ")
        assert a == " " or (a == a.strip() and "  " not in a)
        assert not any(c.isdecimal() for c in a)
        assert row["b"].replace("̇", "") == a.replace("̇", "")


def test_long_run_without_blank_is_linear(spark):
    df = spark.createDataFrame([("x" * 400_000 + "@",), ("a@" + "b" * 400_000,)], "text string")
    got = [r[0] for r in df.select(F.length(clean_text(F.col("text")))).collect()]
    assert got == [400_000, 1]


def test_drop_empty_texts(spark):
    rows = [(1, None), (2, "42 !"), (3, "Yes 1"), (4, " ")]
    df = drop_empty_texts(spark.createDataFrame(rows, "row_id long, text string"), "text")
    assert [tuple(r) for r in df.collect()] == [(3, "yes")]


def test_is_blank(spark):
    df = spark.createDataFrame([(None,), ("",), ("\u001c  ",), (" x ",)], "t string")
    assert [r[0] for r in df.select(is_blank(F.col("t"))).collect()] == [True, True, True, False]


# Published name and key pairs.
KEYS = [
    ("НАУКА", "НАУКА__b9926b92"),
    ("ВНУТРЕННЯЯ ПОЛИТИКА ", "ВНУТРЕННЯЯ_ПОЛИТИКА__1824cebc"),
    ("ВОПРОСЫ ЗЕМЛИ И ЗЕМЛЕПОЛЬЗОВАНИЯ", "ВОПРОСЫ_ЗЕМЛИ_И_ЗЕМЛЕПОЛЬЗОВАНИЯ__f5798139"),
    (
        "ВООРУЖЕННЫЕ СИЛЫ, ДРУГИЕ ВОЙСКА И ВОИНСКИЕ ФОРМИРОВАНИЯ, НАЦИОНАЛЬНАЯ БЕЗОПАСНОСТЬ",
        "ВООРУЖЕННЫЕ_СИЛЫ_ДРУГИЕ_ВОЙСКА_И_ВОИНСКИЕ_ФОРМИРОВАНИЯ_НАЦИОНАЛЬНАЯ_БЕЗОПАСНОСТЬ__373f0dc0",
    ),
    (
        "ДЕНЕЖНО-КРЕДИТНАЯ ПОЛИТИКА. МАКРОПРУДЕНИЦАЛЬНАЯ ПОЛИТИКА, РЕГУЛИРОВАНИЕ И НАДЗОР/КОНТРОЛЬ"
        " ПЛАТЕЖНЫХ СИСТЕМ, ВАЛЮТНЫХ ОПЕРАЦИЙ",
        "ДЕНЕЖНО-КРЕДИТНАЯ_ПОЛИТИКА._МАКРОПРУДЕНИЦАЛЬНАЯ_ПОЛИТИКА_РЕГУЛИРОВАНИЕ_И_НАДЗОР___40ba946d",
    ),
]


def test_safe_key(spark):
    df = spark.createDataFrame(KEYS, "name string, expected string")
    for row in df.select("*", safe_key(F.col("name")).alias("got")).collect():
        assert row["got"] == row["expected"]


def test_labels(spark):
    rows = [("a", "b"), (None, "b"), ("a", None), ("a__SEP__b", "c")]
    df = spark.createDataFrame(rows, "issue string, sub string")
    labels = [r[0] for r in df.select(compose_label(F.col("issue"), F.col("sub"))).collect()]
    assert labels == ["a__SEP__b", "nan__SEP__b", "a__SEP__nan", "a__SEP__b__SEP__c"]
    given_labels = [("__single__",), ("x__SEP__y__SEP__z",), ("plain",), ("__SEP__y",)]
    issue, sub = split_label(F.col("label"))
    got = [tuple(r) for r in spark.createDataFrame(given_labels, "label string").select(issue, sub).collect()]
    assert got == [(None, None), ("x", "y__SEP__z"), (None, "plain"), ("", "y")]


def test_grades(spark):
    rows = ["4", "5", " 5 ", "4.0", "5e0", "3", "n/a", "", None, "4d", "5f", "NaN", "45", "+4"]
    df = spark.createDataFrame([(g,) for g in rows], "g string")
    kept = [r["g"] for r in df.where(is_good_grade(F.col("g"))).collect()]
    assert kept == ["4", "5", " 5 ", "4.0", "5e0", "+4"]
    numbers = spark.createDataFrame([(4.0,), (4.5,), (5.0,)], "g double")
    assert numbers.where(is_good_grade(F.col("g"))).count() == 2
