"""Collusion signals, the combined anomaly scan, short price series and the cross-validated vote, on hand-made rows."""

import datetime as dt
from math import cos, hypot, radians

import numpy as np
from pyspark.sql import functions as F

from tenderlens.operators import anomaly as A
from tenderlens.operators import graph as G
from tenderlens.operators import learning as L
from tenderlens.operators import text as X

VENDORS = "vendor_id int, ip string, email string, device string, lat double, lon double, directors array<string>, address string, phone string"


def test_nine_collusion_signals(spark):
    base = (1, "10.0.0.1", "x@Acme.example", "ua", 12.0, 77.0, ["p", "q"], "road 1", "555")
    none = [None] * 8
    others = {
        2: (2, "10.0.0.1", *none[1:]), 3: (3, "10.0.0.7", *none[1:]), 4: (4, None, "y@acme.EXAMPLE", *none[2:]), 5: (5, *none[:2], "ua", *none[3:]), 6: (6, *none[:3], 12.0005, 77.0005, *none[5:]),
        7: (7, *none[:5], ["q", "z"], *none[6:]), 8: (8, *none[:6], "road 1", None), 9: (9, *none[:7], "555"), 10: (10, *none), 11: (11, *none[:3], 12.001, 77.0, *none[5:]), 12: (12, *base[1:]),
    }
    free = [(20, None, "a@gmail.com", *none[2:]), (21, None, "b@gmail.com", *none[2:])]
    words = " ".join(f"word{i} plain, text." for i in range(12))
    docs = spark.createDataFrame([(1, 1, "bid", words), (2, 10, "bid", words + " more plain, text."), (3, 10, "other", words), (4, 9, "bid", "too short"), (5, 8, None, words)], "doc_id int, vendor_id int, doc_type string, text string")
    vendors = spark.createDataFrame([base, *others.values(), *free], VENDORS).join(X.styles(docs), "vendor_id", "left")
    pairs = spark.createDataFrame([(1, b, 3) for b in others] + [(20, 21, 1)], "a int, b int, shared int")
    got = {(r["a"], r["b"]): r for r in G.collusion(pairs, vendors).collect()}
    want = {2: ("ip", 4), 3: ("subnet", 2), 4: ("domain", 3), 5: ("device", 2), 6: ("distance", 4), 7: ("directors", 4), 8: ("address", 4), 9: ("phone", 3), 10: ("style", 3), 11: ("", 0)}
    assert {b: (got[1, b]["signals"], got[1, b]["score"]) for b in want} == want
    assert got[1, 12]["signals"] == "ip,domain,device,distance,directors,address,phone" and got[1, 12]["score"] == 24 and got[1, 12]["level"] == "high"
    assert got[20, 21]["score"] == 0 and got[20, 21]["level"] == "low" and got[1, 3]["level"] == "medium"
    assert abs(got[1, 6]["distance_m"] - hypot(0.0005 * 111_000, 0.0005 * 111_000 * cos(radians(12.0)))) < 1e-6 and got[1, 2]["distance_m"] is None
    few = G.collusion(pairs, vendors.select("vendor_id", "phone"))
    assert {r["signals"] for r in few.collect()} == {"", "phone"} and G.collusion(pairs.limit(0), vendors).count() == 0


def day(i):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=int(i))


def scan(spark, bids, times=()):
    bids = spark.createDataFrame(bids, "bid_id int, tender_id int, vendor_id int, total_amount double, submitted_at timestamp")
    times = spark.createDataFrame(list(times), "vendor_id int, at timestamp")
    return A.bid_signals(bids, times, spark.createDataFrame([(5, 1.67), (10, 2.18), (20, 2.56)], "k int, critical double"))


def test_bid_signals(spark):
    rng = np.random.default_rng(2)
    bids = [(t * 10 + v, t, v, float(100 + rng.uniform(0, 20)), day(t)) for t in range(30) for v in range(1, 7)]
    bids += [(1001, 5, 7, 900.0, day(5)), (1002, 6, 8, -1.0, day(6)), (1003, 7, 8, None, day(7))]
    bids = [(b, t, v, 2000.0 if (t, v) == (20, 3) else x, at) for b, t, v, x, at in bids]
    times = [(1, dt.datetime(2024, 1, 1, 9, 0, s)) for s in range(5)] + [(2, dt.datetime(2024, 1, 1, h)) for h in range(20)]
    got = {r["bid_id"]: r for r in scan(spark, bids, times).collect()}
    assert len(got) == 181 and 1002 not in got and 1003 not in got
    assert got[1001]["fence"] == "extreme" and got[1001]["grubbs"] and got[203]["fence"] == "extreme" and got[203]["ewma_alert"]
    assert sum(r["ewma_alert"] for r in got.values() if r["vendor_id"] == 3) == 1
    assert got[11]["timing_risk"] == "CRITICAL" and got[12]["timing_risk"] == "LOW" and got[13]["timing_risk"] == "LOW"  # one hour; spread; no times
    assert got[11]["network_risk"] == "HIGH" and got[11]["digit_risk"] == "CRITICAL" and got[11]["digit_fails"] and got[11]["cv_risk"] in ("MODERATE", "LOW")
    assert got[1001]["digit_risk"] == "LOW" and got[1001]["cv_risk"] == "LOW"  # one bid tells nothing
    assert scan(spark, []).count() == 0


def test_points_of_the_summary(spark):
    rows = [(1, 1, 1, "extreme", True, True, "CRITICAL", "HIGH", True, "LOW", "HIGH", "MODERATE", True), (2, 1, 2, "normal", False, False, "CRITICAL", "LOW", False, "LOW", "LOW", "LOW", True), (3, 2, 2, "mild", False, True, "LOW", "MODERATE", False, "HIGH", "MODERATE", "LOW", None)]
    s = spark.createDataFrame(rows, "bid_id int, tender_id int, vendor_id int, fence string, grubbs boolean, ewma_alert boolean, entropy_risk string, digit_risk string, digit_fails boolean, cv_risk string, network_risk string, timing_risk string, forest boolean")
    a, b = A.summarise(s, "tender_id").orderBy("tender_id").collect()
    assert (a["bids"], a["forest"], a["extreme"], a["grubbs"], a["ewma_alerts"], a["points"], a["risk"]) == (2, 2, 1, 1, 1, 2 + 2 + 1 + 2 + 1, "CRITICAL")
    assert (b["forest"], b["mild"], b["variation"], b["points"], b["risk"]) == (0, 1, 2, 0, "LOW")
    assert A.summarise(s).first()["bids"] == 3 and A.summarise(s.limit(0)).filter(F.col("points") > 0).count() == 0


PRICES = "k string, m date, p double"


def months(k, values):
    return [(k, dt.date(2020 + i // 12, i % 12 + 1, 1), float(v)) for i, v in enumerate(values)]


def test_linear_forecast(spark):
    rng = np.random.default_rng(3)
    y = 50 + 3 * np.arange(9) + rng.normal(0, 2, 9)
    df = spark.createDataFrame(months("one", [7]) + months("two", [10, 8]) + months("many", y), PRICES)
    got = {(r["k"], r["step"]): r for r in L.linear_forecast(df, "k", "m", "p").collect()}
    assert len(got) == 9 and [got["one", s]["forecast"] for s in (1, 2, 3)] == [7.0] * 3 and got["one", 1]["error"] is None
    assert abs(got["two", 2]["forecast"] - 4.0) < 1e-9 and got["two", 2]["error"] is None
    x = np.arange(1, 10)
    slope, icept = np.polyfit(x, y, 1)
    s = np.sqrt(((y - icept - slope * x) ** 2).sum() / 7)
    for step in (1, 2, 3):
        r, at = got["many", step], 9 + step
        f = icept + slope * at
        assert abs(r["forecast"] - f) < 1e-6 and abs(r["error"] - s * np.sqrt(1 + 1 / 9 + (at - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum())) < 1e-6
        assert abs(r["low"] - f * (1 - 0.02 * step)) < 1e-6 and abs(r["high"] - f * (1 + 0.02 * step)) < 1e-6 and r["last"] == y[-1]
    assert str(got["many", 1]["month"]) == "2020-10-01" and L.linear_forecast(df.limit(0), "k", "m", "p").count() == 0


def test_forecast_takes_the_line_where_series_are_short(spark):
    wave = [100 + 10 * np.sin(2 * np.pi * i / 12) for i in range(40)]
    df = spark.createDataFrame(months("long", wave) + months("short", [5, 6, 7, 8]), PRICES)
    got = {(r["k"], r["step"]): r for r in L.forecast(df, "k", "m", "p").collect()}
    assert {k: r["engine"] for (k, _), r in got.items()} == {"long": "ensemble", "short": "linear"} and len(got) == 6
    assert abs(got["short", 1]["forecast"] - 9) < 1e-9 and all(85 < got["long", s]["forecast"] < 115 for s in (1, 2, 3))
    assert all(got["long", s]["low"] <= got["long", s]["forecast"] <= got["long", s]["high"] for s in (1, 2, 3))
    only = L.forecast(df.filter("k = 'short'"), "k", "m", "p").collect()
    assert {r["engine"] for r in only} == {"linear"} and L.forecast(df.limit(0), "k", "m", "p").count() == 0


def test_vote_by_cross_validation(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(x), float(y), bool(x + 0.3 * z > 0.4)) for i, (x, y, z) in enumerate(rng.normal(0, 1, (150, 3)))]
    df = spark.createDataFrame(rows, "id int, x double, y double, bad boolean")
    p = L.soft_vote(df.filter("id < 100"), df.filter("id >= 100"), ["x", "y"], "bad", "id")
    got = p.select("id", "bad", "probability").collect()
    good, bad = [r["probability"] for r in got if not r["bad"]], [r["probability"] for r in got if r["bad"]]
    assert len(got) == 50 and np.mean([a < b for a in good for b in bad]) > 0.9
    assert L.soft_vote(df.limit(5), df, ["x", "y"], "bad", "id") is None and L.soft_vote(df.filter("bad"), df, ["x", "y"], "bad", "id") is None
    few = df.filter("not bad or id in (%s)" % ",".join(str(r[0]) for r in [r for r in rows if r[3]][:1]))  # one row of a class: no folds to compare
    assert L.soft_vote(few, few, ["x", "y"], "bad", "id").count() == few.count()
