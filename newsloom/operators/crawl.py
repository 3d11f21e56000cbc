"""Best-first crawl over pages at hand: ranked pops, statuses, inherited scores, rounds that can be resumed.

A round pops the best unseen urls of each domain, fetches them (a join with the pages), and pushes the links of those it got, each with
the highest score of the round's pages that hold it, unless the url is known already. What a round moves is what it pops and pushes:
pages, links and known urls lie clustered by url and stay where they are; the queue is read and written once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.frontier import pop
from newsloom.sources.keyed import Files, KeySet, bucketed, detach
from newsloom.sources.shared import fresh_path

QUEUE = "url string, url_score double, domain string, status string, retries int, met int"
DONE = "url string, url_score double, page_score double, domain string, status string, retries int, met int, popped int"


class BestFirst:
    """A crawl whose rounds are kept in a folder; started again with the same folder it goes on after the last whole round.

    start(url), links(src, dst), pages(url, score); domain(url) names what urls are ranked within. per_domain urls of a domain are popped a
    round, and of all domains `batch` at most, dealt in turn, if that is given. A url without a page is tried again, `retries` times.
    """

    def __init__(
        self, start: DataFrame, links: DataFrame, pages: DataFrame, domain: Callable[[Column], Column],
        per_domain: int = 50, batch: int | None = None, retries: int = 3, path: str | None = None, buckets: int | None = None,
    ):
        self.spark, self.domain = start.sparkSession, domain
        self.per_domain, self.batch, self.retries = per_domain, batch, retries
        self.files = Files(self.spark, path or fresh_path(self.spark))
        if not self.files.exists("buckets"):  # a crawl keeps the number that it began with
            self.files.put("buckets", str(buckets or self.spark.conf.get("spark.sql.shuffle.partitions")))
        self.buckets = int(self.files.read("buckets"))
        self.known = KeySet(self.spark, f"{self.files.path}/known", "url", self.buckets)
        self.start, self.links, self.pages = start, links, pages

    def _at(self, kind: str, k: int) -> str:
        return f"{self.files.path}/{kind}-{k}"

    def rounds(self) -> int | None:
        """The last whole round: its queue, which is written last, is there."""
        done = [int(n.split("-")[1]) for n in self.files.names() if n.startswith("queue-") and self.files.exists(f"{n}/_SUCCESS")]
        return max(done, default=None)

    def _first(self) -> None:
        urls = self.start.select("url").where("url is not null").distinct()
        self.known.add(urls, 0)
        rows = urls.select("url", F.lit(0.0).alias("url_score"), self.domain(F.col("url")).alias("domain"), F.lit("unseen").alias("status"), F.lit(0).alias("retries"), F.lit(0).alias("met"))
        rows.write.mode("overwrite").parquet(self._at("queue", 0))

    def _round(self, k: int, links: DataFrame, pages: DataFrame) -> None:
        queue = self.spark.read.schema(QUEUE).parquet(self._at("queue", k - 1))
        taken = pop(queue, self.per_domain, batch=self.batch).drop("rn").withColumn("status", F.lit("processing"))
        fetched = taken.join(pages, "url", "left").withColumn("popped", F.lit(k))
        again = F.col("retries") < self.retries
        status = F.when(F.col("page_score").isNotNull(), "seen").when(again, "unseen").otherwise("error")
        fetched = fetched.withColumn("status", status).withColumn("retries", F.when(status == "unseen", F.col("retries") + 1).otherwise(F.col("retries")))
        fetched.select(*[c.split()[0] for c in DONE.split(", ")]).write.mode("overwrite").parquet(self._at("done", k))
        done = self.spark.read.schema(DONE).parquet(self._at("done", k))

        found = done.where("status = 'seen'").select(F.col("url").alias("src"), "page_score").join(links, "src").groupBy(F.col("dst").alias("url")).agg(F.max("page_score").alias("url_score"))
        new = self.known.absent(found, k - 1).select("url", "url_score", self.domain(F.col("url")).alias("domain"), F.lit("unseen").alias("status"), F.lit(0).alias("retries"), F.lit(k).alias("met"))
        new.write.mode("overwrite").parquet(self._at("new", k))
        new = self.spark.read.schema(QUEUE).parquet(self._at("new", k))
        self.known.add(new, k)
        self.known.fold(k)
        names = [c.split()[0] for c in QUEUE.split(", ")]
        left = queue.join(done.select("url"), "url", "left_anti").select(*names)
        rest = left.unionByName(done.where("status = 'unseen'").select(*names)).unionByName(new)
        rest.write.mode("overwrite").parquet(self._at("queue", k))
        self.files.delete(f"new-{k}")
        self.files.delete(f"queue-{k - 2}")

    def run(self, rounds: int | None = None) -> int:
        """Go on until nothing is unseen, or for so many rounds at most; the number of rounds that the crawl has had."""
        k = self.rounds()
        if k is None:
            self._first()
            k = 0
        last = None if rounds is None else k + rounds
        pages = bucketed(self.pages.groupBy("url").agg(F.max("score").cast("double").alias("page_score")), "url", buckets=self.buckets)
        links = bucketed(self.links.select("src", "dst").where("dst is not null").distinct(), "src", buckets=self.buckets)
        while (last is None or k < last) and not self.spark.read.schema(QUEUE).parquet(self._at("queue", k)).isEmpty():
            k += 1
            self._round(k, links, pages)
        detach(pages, links)
        return k

    def result(self) -> DataFrame:
        """(url, url_score, page_score, domain, status, retries, met, popped): every known url as it stands; popped is the last round that took it."""
        k = self.rounds()
        queue = self.spark.read.schema(QUEUE).parquet(self._at("queue", k))
        done = self.spark.read.schema(DONE).parquet(*[self._at("done", j) for j in range(1, k + 1)]) if k else None
        if done is None:
            return queue.select("url", "url_score", F.lit(None).cast("double").alias("page_score"), "domain", "status", "retries", "met", F.lit(None).cast("int").alias("popped"))
        ends = done.where("status <> 'unseen'")
        tried = done.where("status = 'unseen'").groupBy("url").agg(F.max("popped").alias("popped"))
        waits = queue.join(tried, "url", "left").withColumn("page_score", F.lit(None).cast("double"))
        return reduce(DataFrame.unionByName, [ends, waits.select(*ends.columns)])
