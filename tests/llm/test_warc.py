import gzip
import random

import pytest
from pyspark.sql import functions as F

from curatrix.llm import warc


def test_canonical(spark):
    pairs = [
        ("HTTP://www.Example.com:80/a/?utm_source=x&b=2&a=1#top", "example.com/a?a=1&b=2"),
        ("https://example.com/a/", "example.com/a"),
        ("https://user@example.com:443", "example.com"),
        ("example.com/A?ref=x", "example.com/A"),
        ("", ""),
        (None, None),
    ]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(pairs)], "i int, u string")
    assert [r.c for r in df.select(warc.canonical_url(F.col("u")).alias("c"), "i").orderBy("i").collect()] == [c for _, c in pairs]


def test_records_round_trip():
    bodies = [b"", b"a\r\n\r\nb", b"WARC/1.1 inside", bytes(range(256)) * 50]
    data = b"".join(warc.write_record("response", {"WARC-Target-URI": f"http://x/{i}"}, b) for i, b in enumerate(bodies))
    got = list(warc.read_records(data))
    assert [b for _, b in got] == bodies and got[2][0]["warc-target-uri"] == "http://x/2"
    assert list(warc.read_records(data[:-40]))[-1][1] == bodies[-1][:-36]
    assert list(warc.read_records(b"")) == []


def test_read_files(spark, tmp_path):
    full = b"HTTP/1.1 200 OK\r\nETag: a\r\nContent-Type: text/html\r\n\r\n<p>hi</p>"
    revisit = b"HTTP/1.1 304 Not Modified\r\nETag: a\r\nDate: later\r\n\r\n"
    head = lambda t: {"WARC-Target-URI": "http://x/a", "WARC-Date": t}
    data = warc.write_record("warcinfo", {}, b"x") + warc.write_record("response", head("2020-01-01T00:00:00Z"), full)
    data += warc.write_record("revisit", head("2020-01-02T00:00:00Z") | {"WARC-Profile": warc.NOT_MODIFIED}, revisit)
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(warc.write_record("revisit", head("not a date"), revisit)))
    captures = warc.read_warc(spark, str(tmp_path))
    assert captures.count() == 3
    got = {r.outcome: r for r in warc.resolve(captures).collect()}
    r = got["resolved"]
    assert bytes(r.payload) == b"<p>hi</p>" and r.headers == {"etag": "a", "date": "later", "content-type": "text/html"}
    assert got["no earlier response"].payload is None


def brute(rows):
    out = []
    for i, url, ts, kind, headers, _, status in rows:
        if kind == "response":
            continue
        if kind != "revisit" or status not in (304, None):
            out.append((i, None, "another profile", {k.lower(): v for k, v in (headers or {}).items()}, None))
            continue
        before = [r for r in rows if r[3] == "response" and r[6] == 200 and url is not None and ts is not None and r[1] == url and r[2] is not None and (r[2], r[0]) < (ts, i)]
        hit = max(before, key=lambda r: (r[2], r[0]), default=None)
        own = {k.lower(): v for k, v in (headers or {}).items()}
        if hit is None:
            out.append((i, None, "no earlier response", own, None))
            continue
        its = {k.lower(): v for k, v in (hit[4] or {}).items()}
        both = [k for k in ("etag", "last-modified", "warc-payload-digest") if k in own and k in its]
        if any(own[k] != its[k] for k in both):
            out.append((i, None, "validators differ", own, None))
        elif not both:
            out.append((i, None, "no shared validator", own, None))
        else:
            out.append((i, hit[0], "resolved", its | {k: v for k, v in own.items() if k in warc.PERMITTED}, hit[5]))
    return sorted(out, key=lambda x: x[0])


@pytest.mark.parametrize("bucket", [1, 7, 4096])
def test_equals_brute_force(spark, bucket):
    rng = random.Random(bucket)
    rows = []
    for i in range(500):
        kind = rng.choice(("response", "response", "revisit", "revisit", "revisit", "revisit of another profile"))
        status = rng.choice((200, 200, 200, 206, 404, None)) if kind == "response" else rng.choice((304, 304, 304, None, 200))
        headers = {k: rng.choice("ab") for k in rng.sample(["ETag", "Last-Modified", "Content-Type", "Date", "X"], rng.randrange(5))}
        if rng.random() < 0.05:
            headers = None
        url = rng.choice(["x/a"] * 6 + ["x/b", "x/c", None])
        rows.append((i, url, rng.choice([None, *range(0, 90)]), kind, headers, f"p{i}".encode() if kind == "response" else None, status))
    df = spark.createDataFrame([(i, u, t, k, s, h, p, 1) for i, u, t, k, h, p, s in rows], warc.CAPTURE + ", b int")
    got = [(r.record_id, r.refers_to, r.outcome, r.headers, None if r.payload is None else bytes(r.payload)) for r in warc.resolve(df, bucket).orderBy("record_id").collect()]
    assert got == brute(rows)


def test_empty(spark):
    assert warc.resolve(spark.createDataFrame([], warc.CAPTURE)).count() == 0


def test_broken_parts(spark, tmp_path):
    """Parts that are cut off or damaged don't stop the others."""
    head = lambda n: {"WARC-Target-URI": f"http://x/{n}", "WARC-Date": "2020-01-01T00:00:00Z", "WARC-Record-ID": f"<urn:{n}>"}
    full = lambda n: gzip.compress(warc.write_record("response", head(n), b"HTTP/1.1 200 OK\r\n\r\n" + bytes(random.Random(n).randrange(256) for _ in range(500))))
    damaged = bytearray(full(2))
    damaged[40:60] = bytes(20)
    (tmp_path / "a.warc.gz").write_bytes(full(1) + bytes(damaged) + full(3) + full(4)[:-300])
    (tmp_path / "b.warc.gz").write_bytes(b"")
    (tmp_path / "c.warc.gz").write_bytes(b"\x1f\x8bnot gzip")
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert {"http://x/1", "http://x/3"} <= {r.url for r in rows} and len({r.record_id for r in rows}) == len(rows)


def test_repeated_record_ids(spark):
    rows = [(7, "x", 1, "response", 200, {"etag": "a"}, b"p"), (7, "x", 1, "response", 200, {"etag": "a"}, b"p"), (8, "x", 2, "revisit", 304, {"etag": "a"}, None), (8, "x", 2, "revisit", 304, {"etag": "a"}, None)]
    got = warc.resolve(spark.createDataFrame(rows, warc.CAPTURE)).collect()
    assert [(r.record_id, r.refers_to, bytes(r.payload)) for r in got] == [(8, 7, b"p")] * 2
