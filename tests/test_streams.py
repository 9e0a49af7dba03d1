import datetime

from auditlake.streaming import streams

SCHEMA = "user_id long, event_id long, ts timestamp, event_type string"


def at(day: int) -> datetime.datetime:
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day)


def test_latest_states_across_a_restart_a_late_event_and_an_idle_key(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path / "run")

    def arrive(*rows):
        frame = spark.createDataFrame([(u, e, at(day), kind) for u, e, day, kind in rows], SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(source)

    def states():
        stream = streams.read_table_stream(spark, source, SCHEMA)
        out = streams.run_once(streams.latest_states(stream, idle_days=20, lateness="5 days"), "update", ("user_id",), base)
        return {r.user_id: (r.state, r.last_event_id, r.n_events, r.expired) for r in out.collect()}

    arrive((1, 10, 10, "view"), (1, 11, 10, "click"), (2, 12, 9, "view"))
    assert states() == {1: ("click", 11, 2, False), 2: ("view", 12, 1, False)}
    # after a restart: an event that is older than the last one is counted, but not the latest; same time: the larger id
    arrive((1, 5, 8, "error"), (3, 13, 11, "view"), (2, 14, 9, "click"))
    assert states() == {1: ("click", 11, 3, False), 2: ("click", 14, 2, False), 3: ("view", 13, 1, False)}
    # a key stays active; the others are idle for more than 20 days and are forgotten
    arrive((3, 20, 40, "buy"))
    arrive((3, 21, 41, "view"))
    got = states()
    arrive((3, 22, 42, "view"))
    got = states()
    assert got == {1: ("click", 11, 3, True), 2: ("click", 14, 2, True), 3: ("view", 22, 4, False)}
    # one that comes back counts anew; an event before the watermark is dropped
    arrive((1, 30, 43, "buy"), (2, 31, 1, "view"))
    assert states() == {1: ("buy", 30, 1, False), 2: ("click", 14, 2, True), 3: ("view", 22, 4, False)}
