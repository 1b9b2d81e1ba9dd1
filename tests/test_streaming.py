"""Streams replayed to their end against their batch twins."""

import datetime as dt
import hashlib

import pytest

from tenderlens.operators import sequences as S
from tenderlens.streaming import feeds

DAY = dt.datetime(2024, 5, 1)
EVENTS = "event_id bigint, ts timestamp, user_id bigint, action string, details string, value double"


class Feed:
    """Files that arrive one after another; each ``add`` is a micro-batch, each ``replay`` goes on from the checkpoint."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, str(folder)

    def add(self, *rows):
        """Rows (event_id, seconds after the day began, user_id, value)."""
        made = [(i, DAY + dt.timedelta(seconds=s), u, "bid", "", float(v)) for i, s, u, v in rows]
        self.spark.createDataFrame(made, EVENTS).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def stream(self):
        return self.spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")

    def replay(self, build):
        return feeds.replay(build(self.stream()), f"{self.folder}/{build.__name__}")


def test_an_auction_without_a_later_bid_is_awarded(spark, tmp_path):
    """Three micro-batches and a restart: the end moves once, the timer awards, later bids are closed out, and then a new auction opens."""

    def auction(s):
        return feeds.auction_stream(s, seconds=3600, extension=120, pause=86_400)

    feed = Feed(spark, tmp_path)
    feed.add((1, 0, 1, 100), (2, 60, 1, 90), (3, 70, 2, 50))
    feed.add((4, 3550, 1, 80))  # in the last moments: the end moves by two minutes
    rows = {(r["event_id"], r["verdict"]): r for r in feed.replay(auction).collect()}
    assert set(rows) == {(1, "accepted"), (2, "accepted"), (3, "accepted"), (4, "accepted")}
    start = int(DAY.timestamp())
    assert rows[4, "accepted"]["end"] - rows[2, "accepted"]["end"] == 120
    feed.add((5, 3680, 2, 40), (6, 3700, 1, 85))  # user 2's end has passed: the bid itself finds it; user 1's bid is in time but not lower
    feed.add((7, 20_000, 3, 1))  # only time passes
    rows = [(r["event_id"], r["user_id"], r["verdict"], r["best"]) for r in feed.replay(auction).collect()]
    assert sorted(rows)[4:] != [] and (3, 2, "awarded", 50.0) in rows and (4, 1, "awarded", 80.0) in rows
    assert (5, 2, "closed", 50.0) in rows and (6, 1, "not lower", 80.0) in rows and (7, 3, "accepted", 1.0) in rows and len(rows) == 9
    feed.add((8, 200_000, 1, 500), (9, 200_001, 1, 600))
    rows = {(r["event_id"], r["verdict"]): r for r in feed.replay(auction).collect()}
    assert rows[8, "accepted"]["end"] == int((DAY + dt.timedelta(seconds=200_000 + 3600)).timestamp()) and (9, "not lower") in rows and (7, "awarded") in rows
    assert len(rows) == 12 and start > 0


@pytest.mark.parametrize("feed", ["ewma_stream", "auction_stream", "rate_violations"])
def test_results_do_not_depend_on_batches(spark, data, feed):
    events = spark.read.parquet(f"{data}/events.parquet").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type as action", "props as details", "value")
    once, often = ({tuple(r) for r in feeds.replay(getattr(feeds, feed)(feeds.arrivals(events, "ts", parts))).collect()} for parts in (1, 5))
    assert once == often and once


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add((1, 10, 1, 1), (2, 20, 1, 1), (3, 7200, 1, 1))
    feed.add((4, 30, 1, 1), (5, 6601, 1, 1), (6, 6600, 1, 1), (7, 15_000, 1, 1))  # the watermark is at 6,600
    feed.add((8, 40, 1, 1), (9, 14_500, 1, 1))
    late = [tuple(r) for r in feeds.late_rows(feed.stream()).orderBy("batch").collect()]
    assert late == [(0, 3, 0), (1, 4, 2), (2, 2, 1)]
    start = int(DAY.timestamp())
    counts = {(r["start"] - start): r["n"] for r in feed.replay(feeds.windowed_counts).collect()}
    assert counts[0] == 3 and counts[3600] == 2  # 4 still meets its window in the batch that closes it; 8 came too late; 3, 5 and 6 are in time
    sessions = [(r["start"] - start, r["members"]) for r in feed.replay(feeds.burst_sessions).collect()]
    assert all(start < 14_000 for start, _ in sessions) and max(members for _, members in sessions) == 3


def test_average_spike_is_flagged(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    values = [100.0 + i % 3 for i in range(25)]
    values[10] = 400.0
    for part in (range(8), range(8, 17), range(17, 25)):
        feed.add(*[(i, 60 * i, 1, values[i]) for i in part])

    def ewma(s):
        return feeds.ewma_stream(s, span=5)

    rows = {r["event_id"]: r["alert"] for r in feed.replay(ewma).collect()}
    assert len(rows) == 25 and rows[10] and not any(rows[i] for i in range(10))


def test_a_sealed_chain_goes_on(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add((1, 0, 1, 1), (2, 1, 2, 1))
    feed.add((3, 2, 1, 1))
    before = hashlib.sha256(b"sealed earlier").hexdigest()

    def sealed(s):
        return feeds.seal_stream(s, spark.createDataFrame([(1, before)], "user_id bigint, last string"))

    rows = {r["event_id"]: r for r in feed.replay(sealed).collect()}
    assert rows[1]["prev_hash"] == before and rows[3]["prev_hash"] == rows[1]["hash"] and rows[2]["prev_hash"] == "0" * 64
    feed.add((4, 3, 1, 1))
    assert {r["event_id"]: r for r in feed.replay(sealed).collect()}[4]["prev_hash"] == rows[3]["hash"]


def test_known_texts_pass_once_over_batches(spark, tmp_path):
    docs = [(1, "a", "solar power and recycling here"), (2, "a", "solar power and recycling here"), (3, "b", "solar power and recycling here"), (4, "a", "nothing of the kind to see"), (5, "a", "solar power and recycling here"), (6, None, "x")]
    stream = feeds.arrivals(spark.createDataFrame(docs, "doc_id bigint, source string, text string"), "doc_id", cuts=[2, 4])
    told = [(r["source"], r["n"], r["mean_esg"]) for r in feeds.replay(feeds.running_esg(stream)).collect()]
    assert sorted(told) == [("", 1, 0.0), ("a", 1, 10.0), ("a", 2, 12.5), ("b", 1, 10.0)]


def test_sealed_stream_equals_batch(spark, data):
    stream = {r["event_id"]: r["hash"] for r in feeds.replay(feeds.seal_stream(feeds.event_stream(spark, data))).collect()}
    rows = spark.read.parquet(f"{data}/events.parquet").selectExpr("event_id", "user_id", "event_type as action", "props as details")
    batch = {r["event_id"]: r["hash"] for r in S.seal(rows, "user_id", "event_id", ["event_id", "user_id", "action", "details"]).collect()}
    assert stream == batch


def test_auction_accepts_only_lower_bids(spark, data):
    out = feeds.replay(feeds.auction_stream(feeds.event_stream(spark, data), pause=10**9)).collect()
    best: dict = {}
    at = {r["event_id"]: (r["ts"], r["value"]) for r in spark.read.parquet(f"{data}/events.parquet").collect()}
    for r in sorted(out, key=lambda r: (at[r["event_id"]][0], r["event_id"])):
        value = at[r["event_id"]][1]
        if r["verdict"] == "accepted":
            assert value < best.get(r["user_id"], float("inf"))
            best[r["user_id"]] = value
        elif r["verdict"] == "not lower":
            assert value >= best[r["user_id"]]


def test_ingest_passes_equal_texts_once(spark, data):
    out = feeds.replay(feeds.ingest_documents(feeds.document_stream(spark, data)))
    assert out.count() == spark.read.parquet(f"{data}/documents.parquet").select("source", "text").distinct().count()
