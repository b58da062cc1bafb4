"""WARC derivatives: each response becomes a linked metadata record and a plain-text conversion record.

Both name the response in WARC-Refers-To, keep its target and date, its own WARC and HTTP headers and its digests (as
given, or made where none are), and carry digests of their own block. The metadata record also holds the outgoing links.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import by_bytes, stored, table
from tallyloom.llm.pages import blocks

SLICE_BYTES = 4 << 20
#: The table of pages has no dates; records made from it bear this one.
DATE = "2000-01-01T00:00:00Z"
_LINK = re.compile(r"<(a|link|img|script|iframe)\b[^>]*?\b(href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.I | re.S)
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """An identifier that depends on nothing but its parts: a task that runs again gives the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def headers_of(head: bytes) -> list[tuple[str, str]]:
    """Header fields of a block of lines; a line that starts with white space continues the one before."""
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], out[-1][1] + " " + line.strip())
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def record_bytes(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


#: What lies between a record's block and the next record; the reader parts files there.
BETWEEN = "\r\n\r\nWARC/1."


def parsed(piece: bytes) -> tuple[list[tuple[str, str]], bytes, int | None]:
    """(header fields, what follows them, the length that they state) of a record without what parts it from others."""
    head, _, rest = piece.partition(b"\r\n\r\n")
    fields = headers_of(head.partition(b"\r\n")[2])
    size = next((v for k, v in fields if k.lower() == "content-length"), "")
    return fields, rest, int(size) if size.isascii() and size.isdigit() else None


Record = tuple[list[tuple[str, str]], bytes, str | None]


def record_of(piece: bytes) -> Record:
    """(header fields, block, error) of a whole record. One cut short, without a readable length or without an id, as
    what a block only quotes may be, has an error."""
    fields, rest, size = parsed(piece)
    if size is None:
        return fields, rest, "Content-Length is missing or no number"
    if len(rest) < size:
        return fields, rest, f"cut short: {len(rest)} of {size} bytes"
    known = any(k.lower() == "warc-record-id" and v for k, v in fields)
    return fields, rest[:size], None if known else "WARC-Record-ID is missing"


def gathered_pieces(pieces: Iterator[tuple[str, bytes, int, bool]]) -> Iterator[tuple[str, bytes, bool, bool]]:
    """(place, record, last of its place, goes on elsewhere) from (place, piece, skip, opened) rows in order.

    A place is one part of one file. A block that holds ``BETWEEN`` itself is put together again by its stated length.
    The first ``skip`` pieces of a place belong to a record that began in an earlier one, and are passed over; where
    ``opened`` holds, a place's last record goes on in the next.
    """
    held: bytes | None = None
    at, nth, goes_on = "", 0, False
    for place, piece, skip, opened in pieces:
        if place != at:
            if held is not None:
                yield at, held, True, goes_on
            held, at, nth, goes_on = None, place, 0, opened
        nth += 1
        if nth <= skip:
            continue
        if held is not None:
            _, rest, size = parsed(held)
            if size is not None and len(rest) < size:
                held += BETWEEN.encode() + piece
                continue
            yield at, held, False, False
        held = piece
    if held is not None:
        yield at, held, True, goes_on


def records(pieces: Iterator[tuple[str, bytes, int, bool]]) -> Iterator[Record]:
    """The records that begin and end in their place; after a compressed file that can't be read to its end, whose last
    piece then lacks the record's closing lines, comes an error alone."""
    for place, piece, last, goes_on in gathered_pieces(pieces):
        if goes_on or not piece.strip():
            continue
        yield record_of(piece)
        if last and place.partition("|")[0].endswith(".gz") and not piece.endswith(b"\r\n\r\n"):
            yield [], b"", "the file can't be read beyond the record before"


def crossings(starts: list[int], rest: list[int], whole: list[int], stated: list[int | None]) -> tuple[dict[int, tuple[int, int]], set[int]]:
    """({split: (pieces of it that belong to an earlier record, the split where that begins)}, splits whose last record
    goes on), from a file's pieces in order: the split of each, its bytes behind a header and in all, and its stated length."""
    skipped: dict[int, tuple[int, int]] = {}
    opened: set[int] = set()
    i = 0
    while i < len(starts):
        have, j = rest[i], i + 1
        while j < len(starts) and stated[i] is not None and have < stated[i]:
            have += len(BETWEEN) + whole[j]
            j += 1
        if stated[i] is not None and have < stated[i]:
            # A length that the whole file doesn't hold is wrong, or the file is cut short: no later split is drawn in.
            j = next((k for k in range(i + 1, j) if starts[k] != starts[i]), j)
        for start in starts[i + 1 : j]:
            if start != starts[i]:
                skipped[start] = (skipped.get(start, (0, 0))[0] + 1, starts[i])
                opened.add(starts[i])
        i = j
    return skipped, opened


def payload_of(block: bytes) -> tuple[str, list[tuple[str, str]], bytes, bytes]:
    """(status, headers, payload as sent, payload decoded) of an HTTP response; broken encodings are left as they are."""
    head, _, body = block.partition(b"\r\n\r\n")
    first, _, rest = head.partition(b"\r\n")
    fields = headers_of(rest)
    named = {k.lower(): v.lower() for k, v in fields}
    status = (first.decode("latin-1").split(" ") + ["", ""])[1]
    plain = body
    if "chunked" in named.get("transfer-encoding", ""):
        out, at = [], 0
        while (end := plain.find(b"\r\n", at)) >= 0:
            try:
                size = int(plain[at:end].split(b";")[0], 16)
            except ValueError:
                break
            if not size:
                break
            out.append(plain[end + 2 : end + 2 + size])
            at = end + 2 + size + 2
        plain = b"".join(out) or plain
    try:
        if "gzip" in named.get("content-encoding", ""):
            plain = gzip.decompress(plain)
        elif "deflate" in named.get("content-encoding", ""):
            plain = zlib.decompress(plain)
    except (OSError, EOFError, zlib.error):
        pass
    return status, fields, body, plain


def decoded(plain: bytes, content_type: str) -> str:
    found = _CHARSET.search(content_type.encode()) or _CHARSET.search(plain[:2048])
    try:
        return plain.decode(found[1].decode() if found else "utf-8", "replace")
    except LookupError:
        return plain.decode("utf-8", "replace")


def derivatives(source: str, target: str | None, date: str | None, block: bytes, headers: list[tuple[str, str]]) -> list[dict[str, object]]:
    """The metadata and the conversion record of one response: WARC fields by column name, and the block.

    ``headers``: the response's own WARC fields. Digests that stand there are kept as they are.
    """
    status, fields, body, plain = payload_of(block)
    kind = next((v for k, v in fields if k.lower() == "content-type"), "")
    text = decoded(plain, kind) if kind.startswith("text/") or "xml" in kind or not kind else ""
    page = "html" in kind or "<" in text[:1000]
    given = {k.lower(): v for k, v in headers}
    digests = {"source_block_digest": given.get("warc-block-digest") or digest(block), "source_payload_digest": given.get("warc-payload-digest") or digest(body)}
    sources = [(f"warc-header-{k.lower()}", v) for k, v in headers] + [(f"http-header-{k.lower()}", v) for k, v in fields]
    lines = [("http-status", status), *sources, *((k.replace("_", "-"), v) for k, v in digests.items())]
    if page:
        title = _TITLE.search(text)
        if title:
            lines.append(("title", " ".join(unescape(title[1]).split())))
        for m in _LINK.finditer(text):
            try:
                url = urljoin(target or "", unescape(m[3] or m[4] or m[5] or "").strip())
            except ValueError:  # not an address
                continue
            lines.append(("outlink", f"{' '.join(url.split())} {'E' if m[2].lower() == 'src' else 'L'} {m[1].lower()}/@{m[2].lower()}"))
    readable = "\n".join(b.text for b in blocks(text)) if page else text
    out = []
    for name, content, data in (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in lines).encode("utf-8", "replace")), ("conversion", "text/plain; charset=utf-8", readable.encode("utf-8", "replace"))):
        out.append({"warc_type": name, "record_id": record_id(source, name), "refers_to": source, "target_uri": target, "warc_date": date, "content_type": content, "content_length": len(data), "block_digest": digest(data), **digests, "source_headers": [{"name": k, "value": v} for k, v in sources], "block": data.decode()})
    return out


def as_bytes(row: dict) -> bytes:
    """A derivative as a record of a WARC file; what it keeps of its source goes into fields that begin with Source-."""
    fields = [("WARC-Type", row["warc_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Refers-To", row["refers_to"]), ("WARC-Target-URI", row["target_uri"]), ("WARC-Date", row["warc_date"]), ("WARC-Block-Digest", row["block_digest"]), ("Content-Type", row["content_type"])]
    fields += [("Source-Block-Digest", row["source_block_digest"]), ("Source-Payload-Digest", row["source_payload_digest"])]
    if row["warc_type"] == "conversion":
        fields += [(f"Source-{h['name']}", h["value"]) for h in row["source_headers"]]
    return record_bytes([(k, " ".join(v.split())) for k, v in fields if v], row["block"].encode())


_HEADERS = "array<struct<name: string, value: string>>"
_OUT = f"warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_block_digest string, source_payload_digest string, source_headers {_HEADERS}, block string"


def derive(responses: DataFrame, keep: str | None = None) -> DataFrame:
    """Two rows per response (record_id, target_uri, warc_date, block): its metadata and its conversion record.

    ``keep`` names a column to carry along. A null block is an empty response: no status, no headers, no text. A null
    record id is made from target and block. If there is a column warc_headers, it holds the response's own WARC fields;
    rows of a column error that isn't null are no responses and are passed over. Repeated responses give repeated rows
    with equal ids; an empty table gives none; other columns are not read.
    """
    if "error" in responses.columns:
        responses = responses.where("error is null")
    headers = F.col("warc_headers") if "warc_headers" in responses.columns else F.lit(None).cast(_HEADERS)
    src = responses.select(*([F.col(keep).alias("kept_")] if keep else []), F.col("record_id").alias("rid_"), F.col("target_uri").alias("uri_"), F.col("warc_date").alias("date_"), F.col("block").alias("raw_"), headers.alias("heads_"))
    schema = T.StructType.fromDDL(_OUT)
    out = T.StructType([*([T.StructField(keep, src.schema["kept_"].dataType)] if keep else []), *schema.fields])
    kinds = {"content_length": pa.int64(), "source_headers": pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "raw_", SLICE_BYTES):
            rows, at = [], []
            for i, r in enumerate(batch.select(["rid_", "uri_", "date_", "raw_", "heads_"]).to_pylist()):
                block = r["raw_"] or b""
                source = r["rid_"] or record_id(r["uri_"] or "", digest(block))
                made = derivatives(source, r["uri_"], r["date_"], block, [(h["name"], h["value"]) for h in r["heads_"] or ()])
                rows += made
                at += [i] * len(made)
            columns = [pa.array([x[f.name] for x in rows], kinds.get(f.name, pa.string())) for f in schema.fields]
            yield pa.RecordBatch.from_arrays([*([batch.column("kept_").take(pa.array(at, pa.int64()))] if keep else []), *columns], names=out.names)

    return src.mapInArrow(run, out)


_SPLITS = "place string, skip long, owner string, opened boolean"


def _crossed(pieces: DataFrame) -> DataFrame:
    """The splits of plain files that records reach into or out of: place, skip, owner, opened.

    A pass over the files brings forth only the lengths of their pieces; those of one file are followed in one task.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nth = "", 0
        for batch in batches:
            rows = []
            for place, piece in zip(batch.column("place").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                at, nth = place, nth + 1 if place == at else 0
                _, rest, size = parsed(piece)
                file, _, start = place.rpartition("|")
                rows.append((file, int(start), nth, len(rest), len(piece), size))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=["file", "start", "nth", "rest", "whole", "stated"])

    def follow(file: pa.Table) -> pa.Table:
        file = file.sort_by([("start", "ascending"), ("nth", "ascending")])
        name = file.column("file")[0].as_py()
        skipped, opened = crossings(*(file.column(c).to_pylist() for c in ("start", "rest", "whole", "stated")))
        rows = [(f"{name}|{s}", *((skipped[s][0], f"{name}|{skipped[s][1]}") if s in skipped else (0, None)), s in opened) for s in sorted({*skipped, *opened})]
        kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_())
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["place", "skip", "owner", "opened"])

    plain = pieces.where(~F.col("file").endswith(".gz")).select("place", "piece")
    sizes = plain.mapInArrow(measure, "file string, start long, nth long, rest long, whole long, stated long")
    return sizes.groupBy("file").applyInArrow(follow, _SPLITS)


def read_responses(spark: SparkSession, path: str, tolerant: bool = True) -> DataFrame:
    """Response records of WARC files, plain or .gz: record_id, target_uri, warc_date, block, warc_headers, error.

    Files are read as streams of records: plain ones in splits, compressed ones member by member in one task each, and
    only the record at hand is in memory. A record that reaches over splits, because its block holds what parts records,
    is put together by its stated length. What of a broken record can be read comes with an ``error``. If ``tolerant``,
    a compressed file that breaks off, or has other bytes after its last member, gives the records before that place and
    an error; the record that reaches to that place may be lost.
    """
    reader = spark.read.option("lineSep", BETWEEN).option("ignoreCorruptFiles", str(tolerant).lower())
    file = F.col("_metadata.file_path")
    place = F.concat_ws("|", file, F.col("_metadata.file_block_start").cast("string"))
    pieces = reader.text(path).select(file.alias("file"), place.alias("place"), F.col("value").cast("binary").alias("piece"))
    kind = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    out = f"record_id string, target_uri string, warc_date string, block binary, warc_headers {_HEADERS}, error string"

    def told(found: Iterator[Record]) -> Iterator[pa.RecordBatch]:
        for fields, block, error in found:
            named = {k.lower(): v for k, v in fields}
            if named.get("warc-type") == "response" or error:
                values = [named.get("warc-record-id"), named.get("warc-target-uri"), named.get("warc-date")]
                columns = [*(pa.array([v], pa.string()) for v in values), pa.array([block], pa.binary()), pa.array([[{"name": k, "value": v} for k, v in fields]], kind), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["record_id", "target_uri", "warc_date", "block", "warc_headers", "error"])

    def rows(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...] = ("place", "piece", "skip", "opened")) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from told(records(rows(batches)))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What crossing records have in each split: the last record where one goes on, and the pieces passed over."""
        owners: dict[str, str | None] = {}
        nth: dict[str, int] = {}
        rows_out: list[tuple[str, int, int, bytes]] = []

        def seen() -> Iterator[tuple[str, bytes, int, bool]]:
            for place, piece, skip, opened, owner in rows(batches, ("place", "piece", "skip", "opened", "owner")):
                owners[place] = owner
                nth[place] = nth.get(place, 0) + 1
                if nth[place] <= skip:
                    rows_out.append((owner, int(place.rpartition("|")[2]), nth[place], piece))
                yield place, piece, skip, opened

        def flush() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows_out], k) for i, k in enumerate(kinds)], names=["owner", "start", "nth", "piece"])
            rows_out.clear()
            return made

        for place, piece, _, goes_on in gathered_pieces(seen()):
            if goes_on:
                rows_out.append((place, int(place.rpartition("|")[2]), 0, piece))
            if rows_out:
                yield flush()
        if rows_out:
            yield flush()

    def joined(group: pa.Table) -> pa.Table:
        pieces_ = group.sort_by([("start", "ascending"), ("nth", "ascending")]).column("piece").to_pylist()
        made = list(told(iter([record_of(BETWEEN.encode().join(pieces_))])))
        return pa.Table.from_batches(made, schema=pa.schema([("record_id", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("block", pa.binary()), ("warc_headers", kind), ("error", pa.string())]))

    crossed = stored(spark, _crossed(pieces), "crossed")
    if crossed.isEmpty():
        return pieces.select("place", "piece", F.lit(0).cast("long").alias("skip"), F.lit(False).alias("opened")).mapInArrow(whole, out)
    # At most one row per split of a file, and only of those that records cross.
    marked = pieces.join(F.broadcast(crossed), "place", "left").select("place", "piece", F.coalesce("skip", F.lit(0)).alias("skip"), F.coalesce("opened", F.lit(False)).alias("opened"))
    few = pieces.join(F.broadcast(crossed), "place").select("place", "piece", "skip", "opened", "owner")
    over = few.mapInArrow(parts, "owner string, start long, nth long, piece binary").groupBy("owner").applyInArrow(joined, out)
    return marked.mapInArrow(whole, out).unionByName(over)


def responses_from_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as response records: the page behind a minimal HTTP header; the id depends on page id, url and page."""
    body = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    head = F.encode(F.format_string("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n", F.octet_length(body)), "UTF-8")
    name = F.sha1(F.concat_ws("|", F.col(id_col).cast("string"), F.col(url_col), F.sha1(body)))
    urn = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.substring(name, 1, 32), "^(.{8})(.{4}).(.{3}).(.{3})(.{12})", "$1-$2-5$3-a$4-$5"), F.lit(">"))
    return pages.select(F.col(id_col).alias("page_id"), urn.alias("record_id"), F.col(url_col).alias("target_uri"), F.lit(DATE).alias("warc_date"), F.concat(head, body).alias("block"))


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses_from_pages(table(spark, sf_dir, "pages")), keep="page_id")
