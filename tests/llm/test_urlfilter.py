import random
from datetime import datetime, timezone

from pyspark.sql import functions as F

from lexaloom.llm import urlfilter as U


def at(seconds):
    return datetime.fromtimestamp(seconds, timezone.utc).replace(tzinfo=None)


def entries(spark, rows):
    return spark.createDataFrame(rows, "rule string, allow boolean, action string, s long").withColumn("at", F.timestamp_seconds("s")).drop("s")


def captures(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, s long, rule string").withColumn("fetched_at", F.timestamp_seconds("s")).drop("s")


def test_hosts(spark):
    cases = {"http://A.B.com:80/x": "a.b.com", "https://u:p@h.org.?q=@z": "h.org", "mailto:x@y": "", "//h/x": "", None: "", "": "", "HTTP://h": "h", "http://[::1]:8/": "[::1]", " https://h.:443": "h"}
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "i int, u string").select("i", U.host_of(F.col("u")).alias("h")).orderBy("i").collect()
    assert [r["h"] for r in rows] == list(cases.values())
    got = spark.range(1).select(U.suffixes(F.lit("a.b.c")).alias("s"), U.suffixes(F.lit("a.b.c"), 2).alias("t")).first()
    assert got["s"] == ["a.b.c", "b.c", "c"] and got["t"] == ["b.c", "c"]


def test_intervals(spark):
    rows = [("A.com", False, "add", 10), ("a.com", False, "add", 20), ("a.com", False, "remove", 30), ("a.com", False, "add", 40), ("a.com", None, "remove", 40), ("a.com", False, "remove", 5), ("a.com", True, "add", 7), (None, False, "add", 1), ("b", False, "oops", 1)]
    got = sorted((r["rule"], r["allow"], r["valid_from"], r["valid_to"]) for r in U.intervals(entries(spark, rows)).collect())
    assert got == [("a.com", False, at(10), at(30)), ("a.com", True, at(7), None)]


def brute(page_rows, entry_rows):
    out = []
    for page, url, s, _ in page_rows:
        host = url.split("//")[1].split("/")[0] if url and "//" in url else ""
        best, n = None, 0
        if host and s is not None:
            for rule, allow in {(r, a) for r, a, *_ in entry_rows}:
                if host == rule or host.endswith("." + rule):
                    events = {}
                    for r, a, action, t in entry_rows:
                        if (r, a) == (rule, allow) and t <= s:
                            events[t] = events.get(t, True) and action == "add"
                    on, since = False, None
                    for t in sorted(events):
                        if events[t] != on:
                            on, since = events[t], t
                    if on:
                        n += 1
                        best = max(best or (), (len(rule), allow, rule, since))
        out.append((page, best[2] if best else None, at(best[3]) if best else None, n, best[1] if best else True))
    return sorted(out, key=str)


def test_against_replay(spark):
    rnd = random.Random(0)
    rules = ["com", "a.com", "b.a.com", "x.org", "org"]
    events = [(rnd.choice(rules), rnd.random() < 0.3, rnd.choice(["add", "remove"]), rnd.randrange(1000)) for _ in range(60)]
    pages = [(i, f"http://{rnd.choice(['a.com', 'b.a.com', 'c.b.a.com', 'com', 'x.org', 'yx.org', 'net'])}/p", rnd.randrange(-50, 1100), "own") for i in range(300)]
    pages += [(1000, None, 5, "own"), (1001, "http://a.com/", None, "own"), (1002, "nothing", 5, "own"), (3, pages[3][1], pages[3][2], "own")]
    for slice_seconds in (50, 10**6):
        got = U.judge_captures(captures(spark, pages), entries(spark, events), slice_seconds=slice_seconds).collect()
        assert sorted(((r["page_id"], r["rule"], r["active_since"], r["n_active"], r["kept"]) for r in got), key=str) == brute(pages, events)


def test_empty_tables(spark):
    assert U.judge_captures(captures(spark, []), entries(spark, [("a", False, "add", 1)])).collect() == []
    got = U.judge_captures(captures(spark, [(1, "http://a/", 5, "r")]), entries(spark, [])).collect()
    assert [(r["kept"], r["n_active"], r["rule"]) for r in got] == [(True, 0, None)]
    judged = U.judge_captures(captures(spark, [(1, "http://a/", 5, "r")]), entries(spark, [("a", False, "add", 1)]))
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hosts_of_many_labels(spark):
    deep = ".".join("abcdefghij") + ".com"
    events = [(deep, False, "add", 1), ("www." + deep, True, "add", 1), (".".join(f"x{i}" for i in range(40)), False, "add", 1)]
    pages = [(i, f"http://{host}/p", 5, "own") for i, host in enumerate([deep, "www." + deep, "z.y." + deep, "other." + deep[2:], ".".join(f"x{i}" for i in range(-60, 40))])]
    got = U.judge_captures(captures(spark, pages), entries(spark, events)).collect()
    assert sorted(((r["page_id"], r["rule"], r["active_since"], r["n_active"], r["kept"]) for r in got), key=str) == brute(pages, events)
    assert [r["kept"] for r in sorted(got)] == [False, True, False, True, False]
    got = spark.range(1).select(U.suffixes(F.lit(deep)).alias("s")).first()["s"]
    assert got[0] == deep and len(got) == 11
