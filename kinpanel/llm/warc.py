"""WARC archives: writing with duplicate payloads as revisits, and reading with boundary-chain verification.

Writing is Spark's text writer with the record end as line separator, so it works on every file system that Spark
knows. Reading cuts the files at the record magic, wherever it stands. Each task emits the candidates of its split with
the offset that their header gives for the next record. A candidate is a record only if the chain that starts at the
beginning of its file reaches it: chains are first followed inside each split to where they leave it, then pointer
jumping over these exits finds the entry of every split in a logarithmic number of joins, and each split is walked once
from its entry. Magic inside a payload is never reached, and its bytes are given back to the record around it.

Defined cases: a null payload is empty, a null url has no target line; rows that repeat the smallest page_id of a
payload are all responses; a null page_id is never the one referred to; equal payloads without any page_id are all
responses. Control characters and blanks in a url are written as %20. An empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kinpanel.llm.common import map_groups
from kinpanel.session import checkpointed

MAGIC = b"WARC/1.0\r\n"
END = b"\r\n\r\n"
_B32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: 15 hexadecimal digits are 12 digits of base 32."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, at, n), 16, 32), width, "0")
             for at, n, width in ((1, 15, 12), (16, 15, 12), (31, 10, 8))]
    return F.translate(F.upper(F.concat(*parts)), *_B32)


def write_archive(pages: DataFrame, path: str, least: int = 0, date: str = "2020-01-01T00:00:00Z") -> None:
    """One record per row of ``pages`` (page_id, url, html) below ``path``, one file per task.

    Of equal payloads of at least ``least`` bytes only the one with the smallest page_id is stored. The table of
    repeated digests is written first, so Spark knows its size and broadcasts it only if it is small.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20").alias("url"),
        body.alias("body"), F.octet_length(body).cast("long").alias("size"), base32_sha1(body.cast("binary")).alias("digest"))
    repeated = rows.filter(F.col("size") >= least).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    repeated = checkpointed(repeated.select(F.col("digest").alias("repeated"), "first"))
    rows = rows.join(repeated, (F.col("digest") == F.col("repeated")) & (F.col("size") >= least), "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("body")))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))

    def urn(page: Column) -> Column:
        return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))

    record = F.concat(
        F.lit(MAGIC.decode()), line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        line("WARC-Refers-To", F.when(again, urn(F.col("first")))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)
    rows.select(record.alias("value")).write.option("lineSep", END.decode()).text(path)


_SPLIT = "file string, block long, seq long"
_CANDIDATE = (f"{_SPLIT}, local long, bytes long, succ long, whole boolean, type string, record_id string, "
              "refers_to string, target_uri string, payload_bytes long, payload_digest string")


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """The stretches between magics with their file and split; in a split, rows come in file order."""
    df = spark.read.option("lineSep", MAGIC.decode()).option("pathGlobFilter", "*.txt").text(path)
    return df.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("block"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """file, split, number in the split, bytes before it in the split, the stretch."""
    at, seq, local = None, 0, 0
    for batch in batches:
        for value, file, block in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if at != (file, block):
                at, seq, local = (file, block), 0, 0
            yield file, block, seq, local, value
            seq += 1
            local += len(value) + len(MAGIC)


def _header(text: bytes) -> dict[str, str]:
    pairs = (line.split(b":", 1) for line in text.split(b"\r\n") if b":" in line)
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, v in pairs}


def _payload(block: bytes) -> tuple[bytes, int]:
    """Payload of an HTTP response block, and the length that its own header states."""
    head, _, payload = block.partition(END)
    stated = _header(head).get("content-length", "")
    return payload, int(stated) if stated.isdigit() else len(payload)


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _describe(value: bytes) -> tuple | None:
    """(length from the end of the magic to the next record, whole here?, header, payload length, digest) or None."""
    cut = value.find(END)
    head = _header(value[:cut]) if cut >= 0 else {}
    length = head.get("content-length", "")
    if not length.isdigit():
        return None
    begin, end = cut + len(END), cut + len(END) + int(length)
    whole = len(value) >= end + len(END)
    if not whole:
        return end + len(END), False, head, None, None
    payload, stated = _payload(value[begin:end])
    revisit = head.get("warc-type") == "revisit"
    digest = head.get("warc-payload-digest", "").rpartition(":")[2] if revisit else _digest(payload)
    return end + len(END), True, head, stated if revisit else len(payload), digest


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = re.findall(r"(\w+) \w+", _CANDIDATE)
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[k] for k in re.findall(r"\w+ (\w+)", _CANDIDATE)]
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for file, block, seq, local, value in _numbered(batches):
        found = _describe(value)
        if found:
            length, whole, head, size, digest = found
            rows.append((file, block, seq, local, len(value), length, whole, head.get("warc-type"), head.get("warc-record-id"),
                         head.get("warc-refers-to"), head.get("warc-target-uri"), size, digest))
        else:
            rows.append((file, block, seq, local, len(value), None, False, None, None, None, None, None, None))
        if len(rows) >= 5000:
            yield flush()
            rows = []
    if rows:
        yield flush()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, type, record_id, refers_to, target_uri, payload_bytes, payload_digest of every verified record.

    ``payload_bytes`` and ``payload_digest`` of responses are computed from the stored bytes. ``block`` and ``seq`` name
    the stretch where a record begins.
    """
    raw = _raw(spark, path)
    found = checkpointed(raw.mapInArrow(_candidates, _CANDIDATE))
    # splits of a file are few; their sizes give the offset at which each begins
    splits = found.groupBy("file", "block").agg((F.sum("bytes") + F.count("*") * len(MAGIC)).alias("size"))
    in_file = Window.partitionBy("file").orderBy("block")
    splits = splits.select("file", "block", F.coalesce(F.sum("size").over(in_file.rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.row_number().over(in_file).alias("nth"))
    splits = checkpointed(splits)
    most = splits.agg(F.max("nth")).first()[0] or 0
    placed = found.join(splits.drop("nth"), ["file", "block"]).withColumn("offset", F.col("base") + F.col("local") - len(MAGIC))
    placed = placed.withColumn("succ", F.col("offset") + len(MAGIC) + F.col("succ"))
    links = placed.select("file", "block", "seq", "offset", "succ")

    def leave(rows: pd.DataFrame) -> pd.DataFrame:
        """Where the chain from each candidate leaves the split (null: it ends inside it)."""
        offset, succ = rows["offset"].tolist(), rows["succ"].tolist()
        last = max(offset)
        exit_: dict[int, float] = {}
        for o, s in sorted(zip(offset, succ), reverse=True):
            exit_[o] = s if s != s or s > last else exit_.get(int(s), float("nan"))
        out = pd.DataFrame({"file": rows["file"], "offset": offset, "exit": pd.array([exit_[o] for o in offset], "Float64")})
        return out[out["exit"].notna()].astype({"exit": "Int64"})

    exits = checkpointed(map_groups(links, ["file", "block"], leave, "file string, offset long, exit long"))
    # chains can only enter a split at an exit of another one or at the start of the file
    entered = exits.select("file", F.col("exit").alias("offset")).distinct()
    jump = exits.join(entered, ["file", "offset"], "left_semi").union(exits.filter("offset = 0")).distinct()
    reach = found.select("file").distinct().withColumn("offset", F.lit(0).cast("long"))
    for _ in range(math.ceil(math.log2(most + 1)) if most > 1 else 0):
        ahead = reach.join(jump, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        reach = checkpointed(reach.union(ahead).distinct())
        on = jump.select("file", F.col("offset").alias("exit"), F.col("exit").alias("far"))
        jump = checkpointed(jump.join(on, ["file", "exit"]).select("file", "offset", F.col("far").alias("exit")))
    entries = links.join(reach, ["file", "offset"]).select("file", "block", F.col("offset").alias("entry"))
    walked = links.join(entries, ["file", "block"], "left")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        """Owner of every stretch: the last record on the chain at or before it (null before the entry)."""
        rows = rows.sort_values("offset")
        succ = dict(zip(rows["offset"], rows["succ"]))
        on, at = set(), rows["entry"].iloc[0]
        while at == at and at in succ:
            on.add(int(at))
            at = succ[at]
        owner = pd.array([o if o in on else None for o in rows["offset"]], "Int64")
        return pd.DataFrame({"file": rows["file"], "block": rows["block"], "seq": rows["seq"], "offset": rows["offset"],
                             "owner": pd.Series(owner, index=rows.index).ffill()})

    owned = checkpointed(map_groups(walked, ["file", "block"], walk, f"{_SPLIT}, offset long, owner long"))
    # stretches before a split's entry belong to the last record of an earlier split
    tails = owned.groupBy("file", "block").agg(F.max("owner").alias("tail"))
    tails = tails.select("file", "block", F.last("tail", True).over(in_file.rowsBetween(
        Window.unboundedPreceding, -1)).alias("before"))
    owned = owned.join(tails, ["file", "block"]).withColumn("owner", F.coalesce("owner", "before")).drop("before")
    records = found.drop("local", "bytes", "succ").join(
        owned.filter("owner = offset").drop("owner"), ["file", "block", "seq"])
    broken = checkpointed(records.filter("NOT whole").select("file", F.col("offset").alias("owner")))
    if not broken.isEmpty():
        need = checkpointed(owned.join(broken, ["file", "owner"], "left_semi").select("file", "block", "seq", "owner", "offset"))
        mended = payloads(spark, path, need, keep=False)
        records = records.join(mended, ["file", "offset"], "left").withColumn(
            "payload_bytes", F.coalesce("payload_bytes", "mended_bytes")).withColumn(
            "payload_digest", F.coalesce("payload_digest", "mended_digest")).drop("mended_bytes", "mended_digest")
    return records.drop("whole")


def payloads(spark: SparkSession, path: str, stretches: DataFrame, keep: bool = True) -> DataFrame:
    """Payloads of records that are given by all their stretches (file, block, seq, owner, offset).

    Returns file, offset, mended_bytes, mended_digest and, with ``keep``, the payload itself.
    """
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for file, block, seq, _, value in _numbered(batches):
            rows.append((file, block, seq, value))
            held += len(value)
            if held > 8 << 20:
                yield pa.RecordBatch.from_pydict(dict(zip(("file", "block", "seq", "value"), map(list, zip(*rows)))))
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(("file", "block", "seq", "value"), map(list, zip(*rows)))))

    pieces = _raw(spark, path).mapInArrow(number, f"{_SPLIT}, value binary").join(stretches, ["file", "block", "seq"])

    def mend(rows: pd.DataFrame) -> pd.DataFrame:
        value = MAGIC.join(rows.sort_values("offset")["value"])
        found = _describe(value)
        cut = value.find(END) + len(END)
        size, digest, payload = None, None, None
        if found and found[1]:
            payload, size, digest = _payload(value[cut:found[0] - len(END)])[0], found[3], found[4]
        out = {"file": rows["file"].iloc[0], "offset": rows["owner"].iloc[0], "mended_bytes": size, "mended_digest": digest}
        return pd.DataFrame([out | {"payload": payload} if keep else out])

    return map_groups(pieces.select("file", "owner", "offset", "value"), ["file", "owner"], mend,
                      "file string, offset long, mended_bytes long, mended_digest string" + ", payload binary" * keep)


def page_of(urn: str) -> Column:
    return F.nullif(F.regexp_extract(urn, r"<urn:x-page:(-?\d*)>", 1), F.lit("")).cast("long")
