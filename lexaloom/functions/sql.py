"""The text functions for SQL: ``register`` makes them temporary SQL functions,
which the optimizer inlines like built-in ones."""

from pyspark.sql import SparkSession

from .text import ENDINGS, REFLEXIVE, SIGNS, STEM_BYTES, TOKEN_PATTERN


def _cut(word: str, endings: tuple[str, ...]) -> str:
    cut = f"regexp_replace({word}, '(?:{'|'.join(endings)})$', '')"
    stays = f"octet_length({word}) < {STEM_BYTES} OR {word} RLIKE '[0-9]' OR NOT {word} RLIKE '[а-яё]' OR octet_length({cut}) < {STEM_BYTES}"
    return f"CASE WHEN {stays} THEN {word} ELSE {cut} END"


def definitions() -> dict[str, str]:
    """name(arguments) RETURNS type -> body"""
    steps = "words"
    for endings in (REFLEXIVE, ENDINGS, SIGNS):
        steps = f"transform({steps}, w -> {_cut('w', endings)})"
    return {
        "tokenize_ru(body STRING) RETURNS ARRAY<STRING>": f"transform(regexp_extract_all(coalesce(body, ''), '{TOKEN_PATTERN}', 0), w -> lower(w))",
        "stem_ru_all(words ARRAY<STRING>) RETURNS ARRAY<STRING>": steps,
        "stem_ru(word STRING) RETURNS STRING": f"element_at({steps.replace('words', 'array(word)', 1)}, 1)",
        "backoff_seconds(tries INT) RETURNS BIGINT": "CAST(least(3600, pow(2, least(tries + 1, 12))) AS BIGINT)",
    }


def register(spark: SparkSession) -> None:
    for head, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
