from datetime import datetime, timezone

import pandas as pd
import pytest

from threadloom.operators.timestamps import layout, parse, same_tables, sending_times, transitions, zone_table_version

NOON = int(datetime(2012, 1, 2, 12, 0, 5, tzinfo=timezone.utc).timestamp())


@pytest.mark.parametrize(
    "value",
    [
        "Mon, 02 Jan 2012 13:00:05 +0100", "Monday, 2 January 2012 13:00:05 +0100 (CET)", "2012-01-02T12:00:05Z", "2012-01-02t12:00:05.999999999z", "2012-01-02 13:00:05", "2012-01-02 13:00:05,123",
        "Mon Jan 02 13:00:05 CET 2012", "20120102T120005Z", "1325505605", "1325505605123", "1325505605123456", "1325505605.5", "2/1/12 13:00:05", "lun. 2 janv. 2012 13:00:05 +0100",
        "2012-Jan-02-Mon-13-00-05-CET", "2012-01-02T07:00:05[America/New_York]", "2012-01-02 07:00:05 America/New_York", " \tMon, 02 Jan 2012 12:00:05 UT ", "Mo., 2. Jan. 2012 13:00:05 +0100", "2012-01-02T13:00:05+01",
    ],
)
def test_notations(value):
    assert parse(pd.Series([value]), pd.Series(["Europe/Paris"]), pd.Series(["dmy"]))[0] == NOON


@pytest.mark.parametrize("value", ["", None, "-", "NaN", "31/02/2010 10:00", "2012-13-41T00:00:00Z", "0000-00-00 00:00:00", "Thu, 32 Foo 2011 25:61:00 +0000", "Date: ", "2012-01-02T13:00:05[Mars/Base]", "Mon, 02 Jan 2012 13:00:05 QQQ", "x" * 5000])
def test_no_time(value):
    assert parse(pd.Series([value], dtype=object), pd.Series(["UTC"]), pd.Series(["dmy"])).isna()[0]


def test_short_notations():
    got = parse(pd.Series(["02.01.2012 13:00", "January 2, 2012 1:00 pm", "2 janv. 2012 à 13h00", "2. ene. 2012, 13:00", "01/02/2012 7:00:00 AM", "2012-01-02T13:00+01:00"]), pd.Series(["Europe/Paris"] * 4 + ["America/New_York", "UTC"]), pd.Series(["dmy"] * 4 + ["mdy", "dmy"]))
    assert list(got) == [NOON - 5] * 6


def test_changes_of_the_clock():
    got = parse(pd.Series(["2012-10-28 02:30:00", "2012-03-25 02:30:00", "2012-03-25 03:30:00", "2012-10-28 03:00:00"]), pd.Series(["Europe/Paris"] * 4), pd.Series(["dmy"] * 4))
    utc = [datetime.fromtimestamp(int(x), timezone.utc).strftime("%d %H:%M") for x in got]
    assert utc == ["28 00:30", "25 01:30", "25 01:30", "28 02:00"]


def test_abbreviations_are_those_of_the_country():
    got = parse(pd.Series(["Mon, 02 Jan 2012 12:00:05 EST"] * 2), pd.Series(["Australia/Sydney", "America/New_York"]), pd.Series(["dmy"] * 2))
    assert list(got) == [NOON - 10 * 3600, NOON + 5 * 3600]


def test_tables():
    assert transitions("No/Zone") is None and layout("nonsense") is None and zone_table_version()
    assert transitions("UTC")[0].size == 0


def test_query(messages, mailboxes):
    m = messages([{"seq": 1, "msg_date": "2012-01-02T13:00:05"}, {"seq": 2}, {"seq": 3, "msg_date": "1/2/2012 7:00", "mailbox": "us"}, {"seq": 4, "msg_date": "2012-01-02T12:00:05", "mailbox": "none"}], ", _tz STRING, epoch_s BIGINT")
    assert {(r.seq, r.epoch_s) for r in sending_times(m, mailboxes).collect()} == {(1, NOON), (3, NOON - 5), (4, NOON)}
    assert sending_times(messages([]), mailboxes.limit(0)).count() == 0


def test_other_zone_tables_are_refused():
    same_tables(zone_table_version())
    with pytest.raises(RuntimeError):
        same_tables("2001a-0")
