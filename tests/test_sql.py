from lexaloom.functions import sql
from lexaloom.functions.text import stem_word


def test_sql_functions(spark):
    sql.register(spark)
    words = ["фильмами", "снялись", "осень", "моими", "film", "фильм2"]
    spark.createDataFrame([(" ".join(words),), (None,)], "body string").createOrReplaceTempView("sql_docs")
    rows = spark.sql("SELECT tokenize_ru(body) AS t, stem_ru_all(tokenize_ru(body)) AS s, stem_ru(element_at(tokenize_ru(coalesce(body, 'осень')), 1)) AS one FROM sql_docs").collect()
    got = {bool(r["t"]): r for r in rows}
    assert got[True]["t"] == words and got[True]["s"] == [stem_word(w) for w in words] and got[True]["one"] == "фильм"
    assert got[False]["t"] == [] and got[False]["one"] == "осен"
    assert [r["b"] for r in spark.sql("SELECT backoff_seconds(CAST(id AS INT)) AS b FROM range(3)").collect()] == [2, 4, 8]
