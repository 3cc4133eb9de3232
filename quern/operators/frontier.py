"""Best-first crawls over stored links: all hosts at once, each in the order of a heap.

A host's next page is the unseen link of the highest priority (ties: the smaller
address), and a visited page's links join the frontier.  One round takes each
host's best `ahead` links together and follows them; what it then accepts is the
longest beginning that no newly found link would have come before, so the order is
a heap's and the rounds are far fewer than pages.  A host stops at its budget.

The frontier and what was seen are tables in the shared folder; the best of a host
are ranked with a limit before the shuffle, and nothing is gathered by host.  Null
hosts and addresses are left out; links that are no pages are visited and lead
nowhere; a page's links count for the host from which it was reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.shared import drop, stored, stored_at


def _worth(priority: str, url: str) -> Column:
    """Smaller comes first."""
    return F.struct((-F.col(priority)).alias("p"), F.col(url).alias("u"))


def crawl(seeds: DataFrame, links: DataFrame, budget: int = 30, ahead: int = 8) -> DataFrame:
    """(host, step, url, priority) of each host's visits, from seeds (host, url, priority) and links (url, to, priority)."""
    spark = seeds.sparkSession
    once = lambda df: df.groupBy("host", "url").agg(F.max("priority").alias("priority"))
    edges = stored(links.where("url is not null and `to` is not null").groupBy("url", "to").agg(F.max("priority").alias("priority")), "links")
    frontier, path = stored_at(once(seeds.where("host is not null and url is not null").select("host", "url", F.col("priority").cast("double"))), "frontier")
    seen, seen_path = stored_at(spark.createDataFrame([], frontier.schema).withColumn("step", F.lit(0)), "seen")
    for _ in range(budget):
        if not frontier.take(1):
            break
        done = seen.groupBy("host").agg(F.count("*").alias("n"))
        order = Window.partitionBy("host").orderBy(F.col("priority").desc(), "url")
        best = frontier.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ahead)
        batch, batch_path = stored_at(best.join(done, "host", "left").select("host", "url", "priority", "rank", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") + F.col("rank") <= budget), "batch")
        out = batch.select("host", "rank", "url").join(edges.select("url", F.col("to"), F.col("priority").alias("p")), "url").select("host", "rank", F.col("to").alias("url"), F.col("p").alias("priority"))
        known = frontier.select("host", "url").unionByName(seen.select("host", "url"))
        found, found_path = stored_at(out.join(known, ["host", "url"], "left_anti"), "found")
        # The best link that each page of the batch leads to, and so all pages before one.
        leads = found.groupBy("host", "rank").agg(F.min(_worth("priority", "url")).alias("best"))
        before = F.min("best").over(Window.partitionBy("host").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
        ranked = batch.join(leads, ["host", "rank"], "left").withColumn("before", before)
        taken, taken_path = stored_at(ranked.where(F.col("before").isNull() | (_worth("priority", "url") < F.col("before"))).select("host", "url", "priority", (F.col("n") + F.col("rank")).cast("int").alias("step"), "rank"), "taken")
        last = taken.groupBy("host").agg(F.max("rank").alias("upto"), F.max("step").alias("visits"))
        new = found.join(last, "host").where("rank <= upto").select("host", "url", "priority")
        rest = frontier.join(taken.select("host", "url"), ["host", "url"], "left_anti").unionByName(new)
        # Hosts that have used up their budget need no frontier any more.
        spent = last.where(F.col("visits") >= budget).select("host")
        later, later_path = stored_at(once(rest.join(spent, "host", "left_anti")), "frontier")
        more, more_path = stored_at(seen.unionByName(taken.select("host", "url", "priority", "step")), "seen")
        for old in (path, seen_path, batch_path, found_path, taken_path):
            drop(spark, old)
        frontier, path, seen, seen_path = later, later_path, more, more_path
    return seen.select("host", "step", "url", "priority")
