import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexaloom.functions import text as T
from lexaloom.functions.urls import normalize_url

STEMS = {
    "фильм": "фильм", "фильмы": "фильм", "фильмами": "фильм", "режиссёра": "режиссёр", "режиссёр": "режиссёр", "осень": "осен", "осени": "осен",
    "самая": "сам", "моими": "моими", "снимается": "снимает", "снялись": "снял", "учиться": "учит", "боялась": "боял", "войны": "войн", "новых": "нов",
    "мою": "мою", "день": "ден", "дня": "дня", "семья": "сем", "стихотворениями": "стихотворен", "объявлениями": "объявлен", "большой": "большой",
    "film": "film", "фильм2": "фильм2", "он": "он", "xфильмы": "xфильм", "1999": "1999",
}
TOKENS = {
    "С.-Петербург, e-mail C++": ["с", "петербург", "e", "mail", "c"],
    "Ёлка ёж Йод 2x": ["ёлка", "ёж", "йод", "2x"],
    "für été": ["f", "r", "t"],
    "K": [],
    "": [],
}
URLS = {
    "HTTP://Example.COM:80/a?b=2&a=1&utm_source=x#frag": "http://example.com/a?a=1&b=2",
    "https://EX.com:443": "https://ex.com/",
    "https://ex.com:8443/": "https://ex.com:8443/",
    "http://h/?UTM_Campaign=1&q=a b&q=": "http://h/?q=&q=a+b",
    "https://h/p?GCLID=1": "https://h/p",
    "  https://h/p?x=~*%20ё  ": "https://h/p?x=~%2A+%D1%91",
    "https://ru.wikipedia.org/?curid=42": "https://ru.wikipedia.org/?curid=42",
    "https://m.a.example.net/en/25#top": "https://m.a.example.net/en/25",
    "": "http:///",
    "example.com/x": "http:example.com/x",
    "http://h/?q=%zz&r=1+2": "http://h/?q=%25zz&r=1+2",
}


def column(spark, values, make, name="v"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string").select("i", make(F.col(name)).alias("out")).orderBy("i").collect()
    return [r["out"] for r in rows]


def test_stems(spark):
    assert column(spark, STEMS, T.stem) == list(STEMS.values())
    assert [T.stem_word(w) for w in STEMS] == list(STEMS.values())


def test_tokens(spark):
    assert column(spark, TOKENS, T.tokens) == list(TOKENS.values())
    assert column(spark, [None], T.tokens) == [[]]


def test_invalid_bytes_separate(spark):
    row = spark.createDataFrame([(bytearray(b"\xffA"),), (bytearray(b"a\xc3b"),)], "c binary").select(T.tokens(T.valid_text(F.col("c"))).alias("t")).collect()
    assert [r["t"] for r in row] == [["a"], ["a", "b"]]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="аяоеыиуюсьъмхйгвёabz12 .", max_size=14), min_size=1, max_size=40))
def test_column_and_driver_stemmer_agree(spark, texts):
    got = column(spark, texts, lambda c: T.stems(T.tokens(c)))
    want = [[T.stem_word(w.lower()) for w in re.findall(T.TOKEN_PATTERN, t)] for t in texts]
    assert got == want


def test_urls(spark):
    assert column(spark, URLS, normalize_url) == list(URLS.values())
    assert column(spark, [None], normalize_url) == ["http:///"]


def test_clean_tail(spark):
    cases = {"A\nЛитература\nB\nСсылки\nC": "A", "  A  ": "  A  ", "x\nСмX также\ny": "x\nСмX также\ny", " x\nСм. также\ny": "x"}
    assert column(spark, cases, T.clean_tail) == list(cases.values())


def test_html(spark):
    cases = {"<p>a<br/>b</p><script>x</script>c&amp;d": "a\nb\n c&amp;d", "": "", "<STYLE>p{}</STYLE>a \t b": "a b", "a</p></p></p></p>b": "a\n\nb"}
    assert column(spark, cases, T.html_to_text) == list(cases.values())
    row = spark.createDataFrame([(bytearray(b"a\xffb"),)], "c binary").select(T.html_bytes_to_text(F.col("c")).alias("t")).first()
    assert row["t"] == "ab"


def test_small_functions(spark):
    sizes = spark.createDataFrame([(1023,), (1024,), (1536,), (5 * 1024**3,)], "n long").select(T.human_bytes(F.col("n")).alias("s")).collect()
    assert [r["s"] for r in sizes] == ["1023 B", "1024 B (1.00 KB)", "1536 B (1.50 KB)", "5368709120 B (5.00 GB)"]
    waits = spark.range(13).select(T.backoff_seconds(F.col("id")).alias("s")).orderBy("id").collect()
    assert [r["s"] for r in waits] == [2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 3600, 3600]
    assert column(spark, ["00000012.tok", "x.tok", "123456789.tok", ""], T.leading_doc_id) == [12, 0, 12345678, 0]
    assert column(spark, ["", "a"], T.fnv1a64_hex) == ["cbf29ce484222325", "af63dc4c8601ec8c"]
    assert column(spark, ["7"], lambda c: T.page_url("https://h/?curid={pageid}", c)) == ["https://h/?curid=7"]


@pytest.mark.parametrize("part, whole, want", [(3, 2, 1.5), (3, 0, 0.0)])
def test_ratio(spark, part, whole, want):
    assert spark.range(1).select(T.ratio(F.lit(part), F.lit(whole)).alias("r")).first()["r"] == want
