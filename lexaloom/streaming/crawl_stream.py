"""The crawl loop as a stream: every micro-batch of responses moves the tables on.

A version of the tables is a folder; the name of the current one is written
last, so a batch that is interrupted leaves the old version and is done again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import crawl


class CrawlState:
    """docs, frontier and texts under ``path``, one folder per finished batch."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last complete version, -1 before the first."""
        if not self._fs.exists(self._at(self.path)):
            return -1
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        done = [int(n[1:]) for n in names if n.startswith("v") and self._fs.exists(self._at(f"{self.path}/{n}/_DONE"))]
        return max(done, default=-1)

    def table(self, name: str, schema: str) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(schema).parquet(f"{self.path}/v{v}/{name}") if v >= 0 else self.spark.createDataFrame([], schema)

    def write(self, v: int, **tables: DataFrame) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/v{v}/{name}")
        self._fs.create(self._at(f"{self.path}/v{v}/_DONE"), True).close()

    def docs(self) -> DataFrame:
        return self.table("docs", crawl.DOCS)

    def frontier(self) -> DataFrame:
        return self.table("frontier", crawl.FRONTIER)

    def texts(self) -> DataFrame:
        return self.table("texts", "name string, text string")

    def seed(self, found: DataFrame) -> None:
        """Fills an empty frontier; one that has tasks is left alone."""
        if self.frontier().limit(1).isEmpty():
            v = self.version()
            self.write(v + 1, docs=self.docs(), frontier=crawl.add_to_frontier(self.frontier(), found), texts=self.texts())

    def apply(self, responses: DataFrame, v: int) -> None:
        """One batch. Of several responses of one URL in it the latest counts."""
        docs, frontier, texts = self.docs(), self.frontier(), self.texts()
        latest = responses.groupBy("norm_url").agg(F.max_by(F.struct(*[c for c in responses.columns if c != "norm_url"]), F.col("fetched_at")).alias("r")).select("norm_url", "r.*")
        known = frontier.select("norm_url", "url", "source")
        news = crawl.changed(latest.join(known, "norm_url"), docs)
        fresh = crawl.extracted_texts(news)
        kept = texts.join(fresh.select("name"), "name", "left_anti").unionByName(fresh)
        self.write(v, docs=crawl.upsert_docs(docs, news), frontier=crawl.reschedule(frontier, latest), texts=kept)


def crawl_stream(state: CrawlState, responses: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the loop over a stream of responses; ``trigger`` as in writeStream.trigger. A batch that was already applied is skipped."""
    first = state.version() + 1

    def step(batch: DataFrame, number: int) -> None:
        v = first + number
        if state.version() < v:
            state.apply(batch, v)

    return responses.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def changed_stream(fetches: DataFrame) -> DataFrame:
    """Of a stream (key string, seq long, content_hash string): the fetches that
    change their key's content, by one value of state per key."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches, state: GroupState):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        before = rows["content_hash"].shift(1)
        before.iloc[0] = last
        state.update((rows["content_hash"].iloc[-1],))
        yield rows[(rows["content_hash"] != before) & ~(rows["content_hash"].isna() & before.isna())]

    return fetches.groupBy("key").applyInPandasWithState(step, "key string, seq long, content_hash string", "content_hash string", "append", GroupStateTimeout.NoTimeout)
