"""Best-first crawls against a heap."""

from __future__ import annotations

import heapq
import random

import pytest

from quern.operators.frontier import crawl


def by_heap(seeds, links, budget):
    out = set()
    leads = {}
    for url, to, p in links:
        if url is not None and to is not None:
            leads.setdefault(url, {})[to] = max(p, leads.get(url, {}).get(to, p))
    for host in {h for h, *_ in seeds if h is not None}:
        best = {}
        for h, u, p in seeds:
            if h == host and u is not None:
                best[u] = max(p, best.get(u, p))
        heap, seen, known = [(-p, u) for u, p in best.items()], 0, set(best)
        heapq.heapify(heap)
        while heap and seen < budget:
            p, url = heapq.heappop(heap)
            seen += 1
            out.add((host, seen, url, -p))
            for to, q in leads.get(url, {}).items():
                if to not in known:
                    known.add(to)
                    heapq.heappush(heap, (-q, to))
    return out


@pytest.mark.parametrize("ahead", [1, 50])
def test_crawl_is_a_heaps(spark, ahead):
    r = random.Random(11)
    price = {f"u{k}": float(r.randint(0, 9)) for k in range(90)}
    links = [(f"u{r.randint(0, 60)}", f"u{r.randint(0, 89)}") for _ in range(260)]
    links = [(a, b, price[b]) for a, b in links] + [("u1", "u1", price["u1"]), (None, "u2", 1.0), ("u3", None, 1.0), ("u4", "u5", price["u5"]), ("u4", "u5", price["u5"])]
    seeds = [(f"h{k % 5}", u, price[u]) for k, u in enumerate(r.sample(sorted(price), 12))] + [(None, "u1", 1.0), ("h0", None, 1.0), ("h9", "alone", 2.0)]
    s = spark.createDataFrame(seeds, "host string, url string, priority double")
    e = spark.createDataFrame(links, "url string, `to` string, priority double")
    got = crawl(s, e, budget=9, ahead=ahead).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == by_heap(seeds, links, 9)


def test_empty(spark):
    s = spark.createDataFrame([], "host string, url string, priority double")
    e = spark.createDataFrame([], "url string, `to` string, priority double")
    assert crawl(s, e).count() == 0
