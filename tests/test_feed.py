"""The paged feed against a server of its own, which counts what it is asked for."""

import threading
from datetime import date, datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from quillfin.sources import feed
from quillfin.sources.readers import atom_entries
from quillfin.streaming import streams as st

BEGIN = datetime(2024, 1, 1)


def atom(entries):
    body = "".join(f'<entry><title>{t}</title><updated>{u.isoformat()}-05:00</updated><link href="{k}"/></entry>' for t, u, k in entries)
    return f'<feed xmlns="http://www.w3.org/2005/Atom">{body}</feed>'


class Server:
    """entries: (title, moment, link), the latest first."""

    def __init__(self, entries):
        self.entries, self.asked = entries, []
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
                mine = [e for e in outer.entries if not q.get("dateb") or e[1].strftime("%Y%m%d") < q["dateb"]]
                part = mine[int(q["start"]) :][: int(q["count"])]
                outer.asked.append([e[1].date() for e in part])
                data = atom(part).encode()
                self.send_response(200)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *_):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}/?start={{start}}&count={{count}}"


@pytest.fixture
def served():
    s = Server([("4 - F" if i % 3 else "424B2 - O", BEGIN + timedelta(hours=6 * i), f"http://x/{i}") for i in range(400)][::-1])
    yield s
    s.http.shutdown()


def links(df):
    return sorted(int(r["link"].rsplit("/", 1)[1]) for r in df.collect())


def test_pages_before_the_first_day_are_not_fetched(spark, served):
    first = date(2024, 3, 20)
    got = feed.read_feed(spark, served.url, count=40).filter(f"filed >= DATE '{first}'")
    assert links(got) == [i for i in range(400) if (BEGIN + timedelta(hours=6 * i)).date() >= first]
    assert len(served.asked) == 3 and all(max(page) >= first for page in served.asked)


def test_days_are_partitions(spark, served):
    df = feed.read_feed(spark, served.url + "&dateb={before}", count=20, parts=5).filter("filed between DATE '2024-02-01' and DATE '2024-02-20' and title like '4 -%'")
    assert df.rdd.getNumPartitions() == 5
    assert links(df) == [i for i in range(400) if i % 3 and date(2024, 2, 1) <= (BEGIN + timedelta(hours=6 * i)).date() <= date(2024, 2, 20)]
    assert all(any(date(2024, 2, 1) <= d <= date(2024, 2, 20) for d in page) for page in served.asked)


@pytest.mark.parametrize("condition", ["filed > DATE '2024-03-01'", "filed < DATE '2024-01-05'", "filed = DATE '2024-02-02'", "filed >= DATE '2024-03-01' and filed < DATE '2024-02-01'", "filed <> DATE '2024-02-02' and filed <= DATE '2024-02-03'", "1 = 1"])
def test_filters_are_right_whatever_is_pushed(spark, served, condition):
    every = feed.read_feed(spark, served.url, count=100)
    kept = spark.createDataFrame(every.collect(), every.schema).filter(condition)
    assert links(every.filter(condition)) == links(kept)


def test_stream_takes_each_entry_once(spark, served, tmp_path):
    run = lambda: links(st.drain(feed.stream_feed(spark, served.url, count=40), f"{tmp_path}/out", f"{tmp_path}/checkpoint", "append"))
    assert run() == list(range(400))
    same = served.entries[0][1]
    # Two newer ones, and one more of the moment that was the newest, which sorts before it.
    served.entries = [("4 - F", same + timedelta(hours=2), "http://x/501"), ("4 - F", same + timedelta(hours=1), "http://x/500"), ("4/A - P", same, "http://x/399000"), *served.entries]
    asked = len(served.asked)
    assert run() == [*range(400), 500, 501, 399000]
    assert len(served.asked) - asked <= 4
    assert run() == [*range(400), 500, 501, 399000]


def test_forms_of_the_feed(spark, served):
    rows = atom_entries(feed.read_feed(spark, served.url, count=40), "2024-04-01", 10)
    assert [r["title"][:2] for r in rows.collect()] == ["4 "] * 10


def test_bad_entries_and_an_empty_feed(spark):
    s = Server([])
    assert feed.read_feed(spark, s.url).collect() == []
    entries, n = feed.entries_of('<feed><entry><title>4 - x</title><updated>never</updated></entry><entry><title> 4 - y </title><updated>2024-01-02T23:30:00-05:00</updated><link href="u"/></entry></feed>')
    assert n == 2 and [(e.title, str(e.filed), e.updated.isoformat(), e.link) for e in entries] == [("4 - y", "2024-01-02", "2024-01-03T04:30:00+00:00", "u")]
    s.http.shutdown()
