import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from notefold.operators.instants import to_instants

MACHINES = [("m1", "Asia/Shanghai", "ymd"), ("m2", "America/New_York", "mdy"), ("m3", "Europe/Berlin", "dmy"), ("m4", "Europe/Berlin", None), ("m5", None, None)]


def run(spark, rows, extra=""):
    df = spark.createDataFrame(rows, f"note_id bigint, machine string, saved_at timestamp_ntz, created string{extra}")
    machines = spark.createDataFrame(MACHINES, "machine string, zone string, date_order string")
    return {r["note_id"]: r["utc_second"] for r in to_instants(df, machines, ["created"]).collect()}


def at(text, zone):
    return int(dt.datetime.fromisoformat(text).replace(tzinfo=ZoneInfo(zone)).timestamp())


CASES = [
    ("m1", "2024-05-06", at("2024-05-06T00:00:00", "Asia/Shanghai")),
    ("m1", '"2024-05-06 07:08:09"', at("2024-05-06T07:08:09", "Asia/Shanghai")),
    ("m1", "２０２４－０５－０６　０７：０８：０９", at("2024-05-06T07:08:09", "Asia/Shanghai")),
    ("m1", "2024-05-06T07:08:09.999Z", at("2024-05-06T07:08:09", "UTC")),
    ("m1", "2024-05-06T07:08:09,5", at("2024-05-06T07:08:09", "Asia/Shanghai")),
    ("m1", "2024-05-06 07:08:09+05:30", at("2024-05-06T07:08:09", "Asia/Kolkata")),
    ("m1", "2024-05-06 07:08:09 UTC-4", at("2024-05-06T07:08:09", "UTC") + 4 * 3600),
    ("m1", "2024-05-06 07:08:09 -0330", at("2024-05-06T07:08:09", "UTC") + 3 * 3600 + 1800),
    ("m1", "2024-05-06 07:08:09 America/Chicago", at("2024-05-06T07:08:09", "America/Chicago")),
    ("m1", "2024-05-06 07:08:09[Europe/Berlin]", at("2024-05-06T07:08:09", "Europe/Berlin")),
    ("m1", "2024-05-06 07:08:09 (Nowhere/Land)", None),
    ("m1", "2024-05-06 07:08:09 CST", at("2024-05-06T07:08:09", "Asia/Shanghai")),
    ("m2", "5/6/2024 7:08", at("2024-05-06T07:08:00", "America/New_York")),
    ("m3", "5.6.2024", at("2024-06-05T00:00:00", "Europe/Berlin")),
    ("m2", "May 6, 2024 12:08 AM", at("2024-05-06T00:08:00", "America/New_York")),
    ("m2", "May 6, 2024 12:08 PM", at("2024-05-06T12:08:00", "America/New_York")),
    ("m3", "Mon, 06 May 2024 07:08:09 +0200", at("2024-05-06T07:08:09", "Europe/Berlin")),
    ("m1", "2024年5月6日 下午3:04", at("2024-05-06T15:04:00", "Asia/Shanghai")),
    ("m1", "2024年5月6日上午12:04", at("2024-05-06T00:04:00", "Asia/Shanghai")),
    ("m1", "2024年5月6日 07时08分", at("2024-05-06T07:08:00", "Asia/Shanghai")),
    ("m1", "20240506", at("2024-05-06T00:00:00", "Asia/Shanghai")),
    ("m1", "20240506T070809Z", at("2024-05-06T07:08:09", "UTC")),
    ("m1", "1714980000", 1714980000),
    ("m1", "1714980000999", 1714980000),
    ("m1", "1714980000999999", 1714980000),
    ("m1", "1714980000.9", 1714980000),
    ("m2", "5/6/24 7:08", at("2024-05-06T07:08:00", "America/New_York")),
    ("m1", "99-05-06", at("1999-05-06T00:00:00", "Asia/Shanghai")),
    ("m3", "31.12.99", at("1999-12-31T00:00:00", "Europe/Berlin")),
    ("gone", "2024-05-06 07:08:09 JST", at("2024-05-06T07:08:09", "Asia/Tokyo")),
    # Repeated local times mean the earlier instant, skipped ones take the offset before the change.
    ("m3", "2024-10-27 02:30:00", at("2024-10-27T02:30:00", "Europe/Berlin")),
    ("m3", "2024-10-27 02:30:00 CET", at("2024-10-27T02:30:00", "Europe/Berlin")),
    ("m3", "2024-03-31 02:30:00", int(dt.datetime(2024, 3, 31, 1, 30, tzinfo=dt.UTC).timestamp())),
    ("m1", "2024-02-30", None),
    ("m1", "2024-13-05 10:00", None),
    ("m1", "0000-00-00 00:00:00", None),
    ("m1", "25:61", None),
    ("m1", "昨天", None),
    ("m1", "last week", None),
    ("m1", "", None),
    ("m1", None, None),
    ("gone", "2024-05-06", None),
    (None, "2024-05-06T07:08:09Z", at("2024-05-06T07:08:09", "UTC")),
]


def test_spellings(spark):
    rows = [(i, m, dt.datetime(2024, 6, 1), v) for i, (m, v, _) in enumerate(CASES)]
    got = run(spark, rows)
    assert {CASES[i][:2]: got[i] for i in got} == {c[:2]: c[2] for c in CASES}


def series(spark, values, machine):
    return run(spark, [(i, machine, dt.datetime(2024, 3, 1) + dt.timedelta(days=i), v) for i, v in enumerate(values)])


DAY_FIRST = ["03.02.2024", "05.02.2024", "07.02.2024", "13.02.2024", "25.02.2024"]
MONTH_FIRST = ["02/03/2024", "02/05/2024", "02/07/2024", "02/13/2024", "02/25/2024", "03/01/2024"]
ZONED = ["2024-01-05 01:00:00 CST", "2024-01-05T00:00:00Z", "2024-01-05 08:30:00 CST", "2024-01-05T01:00:00Z", "2024-01-05 09:30:00 CST"]


def days(values, shape):
    return {i: int(dt.datetime.strptime(v, shape).replace(tzinfo=ZoneInfo("Europe/Berlin")).timestamp()) for i, v in enumerate(values)}


def planted(spark):
    """What the pass makes of planted records whose values fit several conventions each."""
    return {
        "day first": series(spark, DAY_FIRST, "m4") == days(DAY_FIRST, "%d.%m.%Y"),
        "month first": series(spark, MONTH_FIRST, "m4") == days(MONTH_FIRST, "%m/%d/%Y"),
        # Read with China's offset the abbreviated times lie between their neighbours, with America's they jump back.
        "zone": [series(spark, ZONED, "m5")[i] for i in (2, 4)] == [int(dt.datetime(2024, 1, 5, h, 30, tzinfo=dt.UTC).timestamp()) for h in (0, 1)],
    }


def test_viterbi_decides_what_no_machine_declares(spark):
    assert planted(spark) == {"day first": True, "month first": True, "zone": True}


def test_without_path_costs_the_planted_records_come_out_wrong(spark, monkeypatch):
    monkeypatch.setattr("notefold.operators.instants.SWITCH", 0.0)
    monkeypatch.setattr("notefold.operators.instants.BACKWARD", 0.0)
    from notefold.operators import instants

    reads = [[{"ord": 1, "alt": -1, "sec": 20}, {"ord": 2, "alt": -1, "sec": 5}], [{"ord": -1, "alt": -1, "sec": 10}]]
    assert pick(instants, reads)[0] == 20
    monkeypatch.undo()
    assert pick(instants, reads)[0] == 5


def pick(instants, reads):
    costs, picks, _, _ = instants._stretch(reads, [None] * len(reads))
    return [int(p[0] if len(p) == 1 else p[costs.argmin()]) for p in picks]


def test_stretches_of_any_size_equal_one_pass(spark):
    import random

    from notefold.operators import instants

    r = random.Random(4)
    for _ in range(20):
        reads = [[{"ord": -1, "alt": -1, "sec": r.randrange(50)}] if r.random() < 0.4 else [{"ord": o, "alt": a, "sec": r.randrange(50)} for o in (1, 2) for a in (0, 1)] for _ in range(12)]
        whole = min(instants._stretch(reads, [None] * 12)[0])
        rows = []
        for k, (a, b) in enumerate(((0, 5), (5, 6), (6, 12))):
            costs, picks, first, last = instants._stretch(reads[a:b], [None] * (b - a))
            rows.append({"source": "s", "part": k, "costs": costs, "first_sec": first, "last_sec": last, "picks": picks})
        frame = instants.pd.DataFrame(rows)
        pairs = instants._chain(frame)["pair"].tolist()
        chosen = [int(p[0] if len(p) == 1 else p[pair]) for row, pair in zip(rows, pairs) for p in row["picks"]]
        assert sum(chosen[i] < chosen[i - 1] for i in range(1, 12)) * instants.BACKWARD <= whole


def test_viterbi_across_partitions_equals_one_pass(spark):
    values = [f"{d:02d}/{m:02d}/2024" for m in range(1, 7) for d in range(1, 29, 3)]
    rows = [(i, "m4", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    few = run(spark, rows)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        many = run(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert few == many
    assert few[0] == at("2024-01-01T00:00:00", "Europe/Berlin") and few[3] == at("2024-01-10T00:00:00", "Europe/Berlin")


def test_empty_table_ties_and_clashing_columns(spark):
    assert run(spark, []) == {}
    same = dt.datetime(2024, 1, 1)
    rows = [(1, "m1", None, "2024-05-06", "x", 1), (2, "m1", same, "2024-05-06", "y", 2), (2, "m1", same, "2024-05-06", "y", 2)]
    got = run(spark, rows, ", zone string, readings int")
    assert got == {1: at("2024-05-06T00:00:00", "Asia/Shanghai"), 2: at("2024-05-06T00:00:00", "Asia/Shanghai")}


@pytest.mark.parametrize("length", [10_000])
def test_very_long_value(spark, length):
    assert run(spark, [(1, "m1", None, "9" * length)]) == {1: None}
