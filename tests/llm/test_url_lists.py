import random

from tallyframe.llm import url_lists as U


def test_against_a_plain_loop(spark):
    rng = random.Random(4)
    hosts = ["a.example.com", "example.com", "b.a.example.com", "x.org", "y.net"]
    urls = [f"http://{h}/{p}/z" for h in hosts for p in ("p", "q")] + ["https://USER@A.Example.com:80/p?x#y", "nonsense", None, "http://x.org"]
    captures = [(i, rng.choice(urls), rng.choice([None, *range(20)])) for i in range(200)]
    captures += captures[:5]
    changes = [(rng.choice([*hosts, "x.org/p", "example.com/q"]), rng.randrange(20), rng.choice(["add", "add", "remove"]), rng.choice(["spam", "allow", "adult"])) for _ in range(60)] + [(None, 3, "add", "spam"), ("x.org", None, "add", "spam")]
    got = U.as_of(spark.createDataFrame(captures, "page_id long, url string, fetched long"), U.intervals(spark.createDataFrame(changes, "key string, at long, action string, category string")))

    def state(key, at):
        best = {}
        for k, t, action, cat in changes:
            if k == key and t is not None and t <= at:
                best[t] = max(best.get(t, ("", "")), (action, cat))
        return (best[max(best)][1], max(best)) if best and best[max(best)][0] == "add" else None

    def want(url, at):
        if url is None or "://" not in url or at is None:
            return None
        rest = url.split("://")[1]
        host, *path = rest.split("/")
        host = host.split("@")[-1].split(":")[0].lower()
        path = path[0].split("?")[0] if path else ""
        labels, found = host.split("."), []
        for i in range(max(1, len(labels) - 1)):
            s = ".".join(labels[i:])
            for key in [s, f"{s}/{path}"] if path else [s]:
                if (e := state(key, at)) is not None:
                    found.append((len(key), e[0] != "allow", e[1], key, e[0]))
        return max(found, default=None)

    rows = [tuple(r) for r in got.select("page_id", "list_key", "category", "valid_from", "blocked").collect()]
    assert len(rows) == len(captures)
    expect = []
    for i, u, at in captures:
        w = want(u, at)
        expect.append((i, w and w[3], w and w[4], w and w[2], bool(w and w[4] != "allow")))
    assert sorted(rows, key=str) == sorted(expect, key=str)


def test_empty(spark):
    caps = spark.createDataFrame([(1, "http://a.b", 3)], "page_id long, url string, fetched long")
    none = U.intervals(spark.createDataFrame([], "key string, at long, action string, category string"))
    assert U.as_of(caps, none).first()["blocked"] is False and U.as_of(caps.limit(0), none).count() == 0


def test_clashing_columns_and_a_very_long_url(spark):
    from pyspark.sql import functions as F

    url = "http://" + "a." * 120 + "example.com/" + "p" * 100_000
    caps = spark.createDataFrame([(1, url, 3), (2, "http://example.com/" + "p" * 100_000, 3)], "page_id long, url string, fetched long").withColumns({"list_key": F.lit("x"), "category": F.lit("y"), "valid_from": F.lit(1), "depth": F.lit(2), "key": F.lit(3)})
    changes = spark.createDataFrame([("example.com", 1, "add", "spam", "z")], "key string, at long, action string, category string, url string")
    rows = U.as_of(caps, U.intervals(changes)).orderBy("page_id").collect()
    assert [(r["page_id"], r["list_key"], r["blocked"]) for r in rows] == [(1, "example.com", True), (2, "example.com", True)]
