"""Term frequencies and their rank-frequency laws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stem, tokens

#: Ranks of one frequency that one row holds as an array.
RANKS_AT_ONCE = 100_000
# Ranks that a fit looks at, and the offsets that it tries.
FIT_RANKS = 2000
FIT_OFFSETS = (0.0, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0)


def term_frequency(docs: DataFrame, stemmed: bool = False) -> DataFrame:
    """(term, count) over all tokens. Stems are cut after counting, once per distinct token."""
    raw = docs.select(F.explode(tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("count"))
    return raw.groupBy(stem(F.col("term")).alias("term")).agg(F.sum("count").alias("count")) if stemmed else raw


def top_terms(frequencies: DataFrame, k: int) -> DataFrame:
    return frequencies.orderBy(F.desc("count"), "term").limit(k)


def totals(frequencies: DataFrame) -> DataFrame:
    return frequencies.agg(F.count("*").alias("unique_terms"), F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("total_tokens"))


def rank_frequency(frequencies: DataFrame) -> DataFrame:
    """(rank, frequency), ranks from 1, equal counts at different ranks.

    Only how many terms have each count is ordered globally, which is a small
    table; the ranks of one count are then a range, made in pieces."""
    alike = frequencies.groupBy("count").agg(F.count("*").alias("terms"))
    upto = alike.withColumn("upto", F.sum("terms").over(Window.orderBy(F.desc("count"))))
    pieces = upto.select("count", "upto", F.explode(F.sequence(F.col("upto") - F.col("terms") + 1, F.col("upto"), F.lit(RANKS_AT_ONCE).cast("long"))).alias("from"))
    until = F.least(F.col("from") + RANKS_AT_ONCE - 1, F.col("upto"))
    return pieces.select(F.explode(F.sequence(F.col("from"), until)).alias("rank"), F.col("count").alias("frequency"))


def zipf_curve(ranked: DataFrame, s: float = 1.0) -> DataFrame:
    """Adds ``zipf``: the largest frequency over rank to the power of s."""
    largest = ranked.agg(F.max("frequency")).scalar()
    return ranked.withColumn("zipf", largest / F.pow(F.col("rank").cast("double"), F.lit(s)))


def _offsets(df: DataFrame, offsets: tuple[float, ...]) -> DataFrame:
    return df.withColumn("b", F.explode(F.array(*[F.lit(float(b)) for b in offsets])))


def mandelbrot_candidates(ranked: DataFrame, ranks: int = FIT_RANKS, offsets: tuple[float, ...] = FIT_OFFSETS) -> DataFrame:
    """(b, s, c, err) of a least-squares line through log(rank + b) and log(frequency)
    for every offset b; err is the mean squared error of c / (rank + b)**s itself. Without two ranks there is none."""
    points = _offsets(ranked.where((F.col("rank") <= ranks) & (F.col("frequency") > 0)), offsets)
    x, y = F.log(F.col("rank") + F.col("b")), F.log(F.col("frequency").cast("double"))
    lines = points.groupBy("b").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")).where("slope is not null")
    fits = lines.select("b", (-F.col("slope")).alias("s"), F.exp("intercept").alias("c"))
    predicted = F.col("c") / F.pow(F.col("rank") + F.col("b"), F.col("s"))
    return points.join(F.broadcast(fits), "b").groupBy("b", "s", "c").agg(F.avg(F.pow(predicted - F.col("frequency"), F.lit(2.0))).alias("err"))


def mandelbrot_best(candidates: DataFrame) -> DataFrame:
    """The candidate of the least error, the smallest offset among equal ones; no row without candidates."""
    best: Column = F.min(F.struct("err", "b", "s", "c")).alias("best")
    return candidates.agg(best).where("best is not null").select("best.b", "best.s", "best.c", "best.err")


def curves(ranked: DataFrame) -> DataFrame:
    """The data of a log-log plot: frequency, the Zipf curve and the best fit at every rank."""
    best = mandelbrot_best(mandelbrot_candidates(ranked))
    fit = {k: best.select(k).scalar() for k in ("b", "s", "c")}
    return zipf_curve(ranked).withColumn("mandelbrot", fit["c"] / F.pow(F.col("rank") + fit["b"], fit["s"]))
