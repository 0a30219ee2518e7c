"""WARC records, and resolution of not-modified revisits.

A revisit of a server-not-modified profile has headers but no payload. It is joined as of its time to the latest earlier full response (status 200) with the
same canonical URL; if they share a validator (ETag, Last-Modified, payload digest) and all that both carry agree, it gets that response's payload,
and that response's headers, updated by those that a 304 may change.

The as-of join goes over time buckets: inside a bucket by a window, from bucket to bucket by each bucket's last response. A URL with very
many captures is so spread over tasks. Captures of equal time are ordered by record id, and a response counts as earlier than a revisit of its time only if its
record id is smaller. Revisits without a URL, a time or an earlier response are unresolved, as are those whose validators differ or that share none, and
those of another profile or status; they keep their own headers and have a null payload. Repeated revisits are separate rows; of responses with one record id, one gives the payload. Null headers count as none; empty tables give no rows; further
columns of captures are dropped.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, ship

# Headers that a not-modified response may update, those that describe the payload as it is stored, and the profile's name.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "set-cookie", "vary", "age", "server")
VALIDATORS = ("etag", "last-modified", "warc-payload-digest")
NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
#: Seconds of a time bucket.
BUCKET = 4096
#: First bytes of a compressed part, and bytes of payloads handed on at once.
GZIP, HELD = b"\x1f\x8b", 1 << 24
CAPTURE = "record_id long, url string, ts long, kind string, status int, headers map<string,string>, payload binary"


# ---------------------------------------------------------------- the format


def write_record(kind: str, headers: dict[str, str], body: bytes) -> bytes:
    """One record of WARC 1.1; Content-Length is set here."""
    fields = {"WARC-Type": kind, **headers, "Content-Length": str(len(body))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, body) of each record; a record that is cut off has the bytes that are there."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(n) if (n := headers.get("content-length", "0")).isdigit() else 0
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def members(data: bytes) -> Iterator[bytes]:
    """The parts of a file that are compressed one by one, or the whole of a plain one. A broken or cut-off part gives the bytes before the fault, and reading
    goes on at the next part."""
    at = 0 if data[:2] == GZIP else -1
    if at < 0:
        yield data
    while 0 <= at < len(data):
        inflate, out = zlib.decompressobj(31), []
        try:
            for k in range(at, len(data), 1 << 16):
                out.append(inflate.decompress(data[k : k + (1 << 16)]))
                if inflate.eof:
                    break
            at = k + len(data[k : k + (1 << 16)]) - len(inflate.unused_data) if inflate.eof else len(data)
        except zlib.error:
            at = data.find(GZIP + b"\x08", at + 1)
        yield b"".join(out)
        if 0 <= at < len(data) and data[at : at + 2] != GZIP:
            at = data.find(GZIP + b"\x08", at)


def profile(header: str | None) -> str:
    """Which kind of revisit a WARC-Profile names."""
    return "revisit" if header is None or header.rsplit("/", 1)[-1] == NOT_MODIFIED.rsplit("/", 1)[-1] else "revisit of another profile"


def http_message(body: bytes) -> tuple[int | None, dict[str, str], bytes]:
    """Status, headers with lower-case names, and payload of an HTTP message."""
    head, _, payload = body.partition(b"\r\n\r\n")
    first, *lines = head.decode("latin-1").split("\r\n")
    code = first.split(" ")[1:2]
    return (int(code[0]) if code and code[0].isdigit() else None), {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The captures in WARC files (plain, or compressed with gzip), one part of a file in memory unpacked at a time. record_id: 63 bits of a digest of the
    record's id, or else of its file's path and its place there. Empty files have no captures, repeated records are separate rows; unreadable times are null."""
    ship(spark)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from datetime import datetime, timezone

        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary())
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], [x.split()[0] for x in CAPTURE.split(", ")])
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, held = [], 0
                for n, (head, body) in enumerate(r for part in members(content) for r in read_records(part)):
                    kind = head.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    status, headers, payload = http_message(body)
                    try:
                        ts = int(datetime.fromisoformat(head.get("warc-date", "").replace("Z", "+00:00")).replace(tzinfo=timezone.utc).timestamp())
                    except ValueError:
                        ts = None
                    own = hashlib.blake2b((head.get("warc-record-id") or f"{name} {n}").encode("utf-8", "surrogatepass"), digest_size=8).digest()
                    headers |= {k: head[k] for k in ("warc-payload-digest",) if k in head}
                    whole = kind == "response"
                    rows.append((int.from_bytes(own, "big") >> 1, head.get("warc-target-uri"), ts, kind if whole else profile(head.get("warc-profile")), status, list(headers.items()), payload if whole else None))
                    held += len(payload)
                    if held > HELD:
                        yield made(rows)
                        rows, held = [], 0
                yield made(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, CAPTURE)


# ---------------------------------------------------------------- resolution


def canonical_url(url: Column) -> Column:
    """Scheme, "www.", user, default port, fragment, tracking parameters, their order and a closing slash don't count; host names have no case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?]*@)?", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^www\.|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(?:utm_[^=]*|ref|fbclid|gclid)(?:=|$)"))
    kept = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def _agree(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) == F.col(b), F.lit(True))


def resolve(captures: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Revisits of captures (record_id, url, ts, kind, status, headers, payload): record_id, url, ts, refers_to, outcome, headers, payload.

    outcome: resolved, validators differ, no shared validator, no earlier response, or another profile."""
    names = F.transform_keys(F.coalesce("headers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, _: F.lower(k))
    all_ = captures.select("record_id", "url", "ts", "kind", "status", names.alias("headers"), canonical_url(F.col("url")).alias("canon"))
    all_ = all_.withColumn("b", F.floor(F.col("ts") / bucket)).withColumn("full", F.when((F.col("kind") == "response") & (F.col("status") == 200), F.struct("ts", "record_id", "headers")))
    usable = all_.where(F.col("canon").isNotNull() & F.col("ts").isNotNull())
    inside = Window.partitionBy("canon", "b").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = usable.withColumn("near", F.last("full", True).over(inside)).where("kind like 'revisit%'")
    closing = usable.where("full is not null").groupBy("canon", "b").agg(F.max_by("full", F.struct("ts", "record_id")).alias("end"))
    wanted = near.where("near is null").select("canon", "b").distinct().withColumn("end", F.lit(None).cast(closing.schema["end"].dataType))
    steps = closing.unionByName(wanted).groupBy("canon", "b").agg(F.first("end", True).alias("end"))
    before = Window.partitionBy("canon").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.withColumn("far", F.last("end", True).over(before)).select("canon", "b", "far")
    found = near.join(carried, ["canon", "b"], "left").withColumn("hit", F.coalesce("near", "far")).drop("near", "far", "canon", "b", "full")
    lost = all_.where(F.col("kind").startswith("revisit") & (F.col("canon").isNull() | F.col("ts").isNull())).withColumn("hit", F.lit(None).cast(found.schema["hit"].dataType))
    found = found.unionByName(lost.select(*found.columns))
    h = lambda c, name: F.element_at(c, F.lit(name))
    for n in VALIDATORS:
        found = found.withColumn(f"own {n}", h(F.col("headers"), n)).withColumn(f"its {n}", h(F.col("hit.headers"), n))
    a, b, c = (_agree(f"own {n}", f"its {n}") for n in VALIDATORS)
    agree = a & b & c
    shared = [F.col(f"own {n}").isNotNull() & F.col(f"its {n}").isNotNull() for n in VALIDATORS]
    other = (F.col("kind") != "revisit") | (F.coalesce("status", F.lit(304)) != 304)
    outcome = F.when(other, "another profile").when(F.col("hit").isNull(), "no earlier response").when(~agree, "validators differ").when(shared[0] | shared[1] | shared[2], "resolved").otherwise("no shared validator")
    found = found.withColumn("outcome", outcome)
    update = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    rest = F.map_filter("hit.headers", lambda k, v: ~F.map_contains_key(F.col("update"), k))
    found = found.withColumn("update", update).withColumn("merged", F.when(F.col("outcome") == "resolved", F.map_concat(rest, "update")).otherwise(F.col("headers")))
    found = found.select("record_id", "url", "ts", F.when(F.col("outcome") == "resolved", F.col("hit.record_id")).alias("refers_to"), "outcome", F.col("merged").alias("headers"))
    # only resolved revisits take part in the join with payloads, so no key is null; one of very many revisits is dealt anew when it is skewed
    found = Scratch(captures.sparkSession, "warc").put(found)
    payloads = captures.where("kind = 'response' and status = 200").select(F.col("record_id").alias("refers_to"), "payload")
    if not payloads.groupBy("refers_to").count().where("count > 1").isEmpty():
        payloads = payloads.dropDuplicates(["refers_to"])
    out = ["record_id", "url", "ts", "refers_to", "outcome", "headers", "payload"]
    rest = found.where("outcome <> 'resolved'").withColumn("payload", F.lit(None).cast("binary"))
    return found.where("outcome = 'resolved'").join(payloads, "refers_to").select(out).unionByName(rest.select(out))
