"""The catalogue service against a server on this machine."""

import threading
import urllib.parse
from datetime import datetime, timedelta, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tesseral.operators import ingest
from tesseral.sources import catalogue
from tesseral.sources.service import fetch_events, time_windows, utc

FIRST = datetime(2020, 1, 1, tzinfo=timezone.utc)
#: One event every six hours, so that many lie on the bounds of windows.
EVENTS = [FIRST + timedelta(hours=6 * i) for i in range(400)]


class Service(BaseHTTPRequestHandler):
    asked: list = []

    def do_GET(self):
        q = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
        Service.asked.append(q)
        code = {"1": 503, "2": 204}.get(q.get("fail"), 200)
        self.send_response(code)
        self.end_headers()
        if code != 200:
            return
        head = "time,latitude,longitude,mag,place" if q.get("fail") == "3" else "time,latitude,longitude,depth,mag,magType,place"
        held = [t for t in EVENTS if utc(q["starttime"]) <= t <= utc(q["endtime"])]
        rows = [f'{t.strftime("%Y-%m-%dT%H:%M:%S.%fZ")},40.5,70.5,,3.{i % 10},mb,"north, ""x""\nof y"' for i, t in enumerate(held)]
        self.wfile.write("\n".join([head, *rows, ""]).encode())

    def log_message(self, *args):
        pass


@pytest.fixture()
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Service.asked.clear()
    yield f"http://127.0.0.1:{server.server_port}/query"
    server.shutdown()


PARAMS = catalogue.request_params(start="2020-01-01", end="2020-03-01")


def test_windows_meet_and_keep_each_event_once(spark, url):
    df = fetch_events(spark, url, PARAMS, days=7)
    assert df.rdd.getNumPartitions() == 9
    got = sorted(utc(r.time) for r in df.collect())
    assert got == [t for t in EVENTS if t <= utc("2020-03-01")]
    assert {q["minlatitude"] for q in Service.asked} == {"38.0"} and {q["format"] for q in Service.asked} == {"csv"}


def test_answers_are_raw_events(spark, url):
    df = fetch_events(spark, url, PARAMS)
    row = df.orderBy("time").head()
    assert df.schema == catalogue.RAW_SCHEMA
    assert (row.depth, row.mag, row.place) == (None, "3.0", 'north, "x"\nof y')
    assert ingest.clean_catalogue(df).count() == 241


@pytest.mark.parametrize(("fail", "message"), [("1", "HTTP status 503"), ("3", "no columns depth")])
def test_errors_are_raised(spark, url, fail, message):
    with pytest.raises(Exception, match=message):
        fetch_events(spark, url, {**PARAMS, "fail": fail}, days=7).collect()


def test_no_content_is_no_event(spark, url):
    assert fetch_events(spark, url, {**PARAMS, "fail": "2"}).collect() == []


def test_silent_server_fails(spark):
    import socket

    with socket.socket() as silent:
        silent.bind(("127.0.0.1", 0))
        silent.listen()
        with pytest.raises(Exception, match="timed out"):
            fetch_events(spark, f"http://127.0.0.1:{silent.getsockname()[1]}/", PARAMS, timeout=0.3).collect()


def test_time_windows():
    day = timedelta(days=1)
    windows = time_windows(FIRST, FIRST + 2.5 * day, 1)
    assert [(w.start, w.end, w.last) for w in windows] == [
        (FIRST, FIRST + day, False), (FIRST + day, FIRST + 2 * day, False), (FIRST + 2 * day, FIRST + 2.5 * day, True),
    ]
    assert len(time_windows(FIRST, FIRST, 1)) == 1
    with pytest.raises(ValueError):
        time_windows(FIRST + day, FIRST, 1)
