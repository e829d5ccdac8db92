r"""WARC archives and an external merge of their capture indexes.

`write_archive` turns rows into WARC/1.1 records (response, or revisit for a repeated payload) and lets Spark's text
writer store them gzipped, so archives can lie in any store Spark writes to; `read_archive` parses whole files back by their
Content-Length. Every archive file yields one capture run, sorted by URL key and time. `merge_runs` joins the runs to
one global order: keys are dealt to ranges of RANGE_ROWS captures or so, and within a range a loser tree merges what each run
has there. A task reads a file as one, so files are cut by running bytes: a file holds FILE_BYTES at most, or one longer record by itself.

Defined cases: a null payload is empty; a null URL is written as an empty target and has the empty URL key; a null key
comes after all others, so a null-keyed row never outranks a keyed copy of its payload; rows with equal key and payload
are all responses; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh_path, materialize, small_batches

#: Records of one archive file at most, and bytes of its records (heads counted as HEAD); captures of one range of the merge.
RECORDS_PER_FILE, FILE_BYTES, RANGE_ROWS = 2000, 32 << 20, 50_000
HEAD = 600
#: Bytes of payload that a task hands on at a time.
HAND_ON = 4 << 20
#: Parts that the copies of one payload are dealt to.
SALTS = 32
#: First capture time; a row without a time is taken one second after the row with the next smaller key.
EPOCH = 1_577_836_800
CRLF = "\r\n"


def digest_column(payload) -> F.Column:
    """Bare upper-case base32 SHA-1 of a string column's UTF-8 bytes, by arithmetic on its hexadecimal digits."""
    digits = F.array(*[F.lit(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"])
    hexed = F.sha1(payload.cast("binary"))
    out = []
    for k in range(4):  # 40 bits are 10 hexadecimal or 8 base32 digits
        number = F.conv(F.substring(hexed, 10 * k + 1, 10), 16, 10).cast("long")
        out += [F.element_at(digits, (F.shiftright(number, 35 - 5 * j).bitwiseAND(31) + 1).cast("int")) for j in range(8)]
    return F.concat(*out)


def mark_revisits(pages: DataFrame, key: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """Adds _digest, _bytes, _refers (the first key with the payload, null for a response).

    The smallest key is aggregated by digest and salt first, so that copies of one payload never meet in one task.
    """
    own = pages.withColumn(payload, F.coalesce(F.col(payload), F.lit(""))).withColumn("_digest", digest_column(F.col(payload))).withColumn("_bytes", F.octet_length(payload).cast("long"))
    own = own.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    parts = own.groupBy("_digest", "_salt").agg(F.min(key).alias("_first"))
    firsts = parts.groupBy("_digest").agg(F.min("_first").alias("_first"), F.collect_set("_salt").alias("_salts"))
    own = own.join(firsts.select("_digest", "_first", F.explode("_salts").alias("_salt")), ["_digest", "_salt"])
    again = (F.col("_bytes") >= least_bytes) & ~F.col(key).eqNullSafe(F.col("_first"))
    return own.withColumn("_refers", F.when(again, F.col("_first"))).drop("_salt", "_first")


def file_numbers(most: int):
    """Numbers the files of a task as its rows come: a record that would take its file beyond `most` bytes begins the next one. Sizes alone go to Python."""

    @F.pandas_udf("int")
    def number(sizes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        file, held = 0, 0
        for batch in sizes:
            out = []
            for n in batch.tolist():
                if held and held + n > most:
                    file, held = file + 1, 0
                held += n
                out.append(file)
            yield pd.Series(out, dtype="int32")

    return number


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> None:
    marked = mark_revisits(pages.select(key, url, payload), key, payload, least_bytes)
    target = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]", "")
    when = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce(F.col(key), F.lit(0)), F.lit(4_000_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("_refers").isNotNull()
    body = F.when(revisit, "").otherwise(F.col(payload))
    text = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(F.col(key).cast("string"), F.lit("")),
        F.lit(f">{CRLF}WARC-Date: "), when, F.lit(f"{CRLF}WARC-Target-URI: "), target,
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("_digest"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: <urn:page:"), F.col("_refers").cast("string"), F.lit(">"))).otherwise(""),
        F.lit(f"{CRLF}X-Payload-Length: "), F.col("_bytes").cast("string"),
        F.lit(f"{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2), body,
    )
    made = marked.withColumn("_file", file_numbers(FILE_BYTES)(F.octet_length(body) + F.octet_length(target) + HEAD))
    made.select(text.alias("value"), "_file").write.partitionBy("_file").option("lineSep", CRLF * 2).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


def url_key(url: str) -> str:
    """Sort-friendly form: scheme dropped, host labels reversed, lower case."""
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://(?:www\d*\.)?", "", url.lower())
    host, slash, path = rest.partition("/")
    host, _, port = host.partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port != "80" else "") + ")" + slash + path if host else ""


CAPTURE = "run string, offset long, url_key string, time string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, payload string"


def _records(name: str, data: bytes):
    at, number = 0, re.compile(rb"<urn:page:(-?\d*)>")
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        head = dict(line.split(b": ", 1) for line in data[at:stop].split(b"\r\n")[1:])
        n = int(head[b"Content-Length"])
        body = data[stop + 4 : stop + 4 + n]
        kind, url = head[b"WARC-Type"].decode(), head[b"WARC-Target-URI"].decode()
        own, refers = number.match(head[b"WARC-Record-ID"])[1], head.get(b"WARC-Refers-To")
        said = head[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
        size = int(head[b"X-Payload-Length"])
        if kind == "response" and (base64.b32encode(hashlib.sha1(body).digest()).decode() != said or n != size):
            raise ValueError(f"{name}: the record at {at} is damaged")
        yield name, at, url_key(url), head[b"WARC-Date"].decode(), int(own) if own else None, kind, int(number.match(refers)[1]) if refers else None, size, said, url, body.decode() if kind == "response" else None
        at = stop + 4 + n + 4


def read_archive(spark, path: str, payloads: bool = True) -> DataFrame:
    """One row per record; payload is null for a revisit (and throughout, if payloads are not asked for, though all are checked)."""
    columns = [c.split()[0] for c in CAPTURE.split(", ")]

    def frame(rows):
        out = pd.DataFrame(rows, columns=columns)
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    def parse(batches):
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                rows, held = [], 0
                for row in _records("/".join(name.split("/")[-2:]), gzip.decompress(data)):
                    rows.append(row if payloads else (*row[:-1], None))
                    held += len(row[-1] or "") if payloads else 64
                    if held > HAND_ON:
                        yield frame(rows)
                        rows, held = [], 0
                yield frame(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInPandas(parse, CAPTURE)


class LoserTree:
    """Merges sorted runs: every inner node keeps the loser of its match, the winner moves up; log2(k) matches a pop."""

    def __init__(self, runs: list[list]):
        self.runs, self.k = runs, max(1, len(runs))
        self.at, self.tree = [0] * len(runs), [-1] * self.k
        for r in range(len(runs)):
            self._replay(r)

    def _head(self, r: int):
        return self.runs[r][self.at[r]] if self.at[r] < len(self.runs[r]) else None

    def _less(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return y is None or x is not None and (x, a) <= (y, b)

    def _replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:  # the first to arrive waits here
                self.tree[node] = winner
                return
            if self._less(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.runs and (head := self._head(self.tree[0])) is not None:
            yield head
            self.at[self.tree[0]] += 1
            self._replay(self.tree[0])


def merge_runs(captures: DataFrame) -> DataFrame:
    """Capture histories in global order of URL key, time and page: rows of partition p come before those of p + 1.

    Ranges are cut by the whole key (URL key, time, page), so a URL with very many captures spans several ranges.
    """
    n = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // RANGE_ROWS))
    narrow = captures.drop("payload")
    dealt = narrow.repartitionByRange(n, "url_key", "time", "page_id").sortWithinPartitions("run", "url_key", "time", "page_id", "offset")

    def merge(batches):
        runs: dict[str, list] = {}
        frames = list(batches)
        if not frames:
            return
        rows = pd.concat(frames, ignore_index=True)
        rows["_null"] = rows["page_id"].isna()
        for i, key in enumerate(zip(rows["run"], rows["url_key"], rows["time"], rows["_null"], rows["page_id"].fillna(0), rows["offset"])):
            runs.setdefault(key[0], []).append((*key[1:5], key[0], key[5], i))
        for own in runs.values():
            own.sort()  # already so but for null pages
        order = [x[-1] for x in LoserTree(list(runs.values()))]
        out = rows.iloc[order].drop(columns="_null")
        for c in ("page_id", "refers_to"):
            out[c] = out[c].astype("Int64")
        yield out

    return dealt.mapInPandas(merge, narrow.schema)


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes the archives and their runs, reads them back and merges: one row per page, in global capture order."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archive(pages, path, key, url, payload, least_bytes)
    with small_batches(spark, 2):  # of whole files
        runs = materialize(read_archive(spark, path, payloads=False).drop("payload").sortWithinPartitions("run", "url_key", "time", "page_id"), "capture-runs")
    return merge_runs(runs)
