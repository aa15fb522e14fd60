"""Posting codecs: the binary stream, the push buffer and YAML documents, as Spark readers and writers."""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import INDEX, PAGE, TERM
from . import yaml_text
from .yaml_text import Tagged, Translator

#: Version mark at the head of each binary entry (fixed value).
MAGIC = 0xF23194B7F015560C
ENTRY = "term string, entry_type int, target string, title string, rel double, positions array<int>, fragments map<int,string>"
_ARROW = pa.schema(
    [("term", pa.string()), ("entry_type", pa.int32()), ("target", pa.string()), ("title", pa.string()), ("rel", pa.float64()), ("positions", pa.list_(pa.int32())), ("fragments", pa.map_(pa.int32(), pa.string()))]
)
TAGS = {TERM: "!TermTermEntry", INDEX: "!TermIndexEntry", PAGE: "!TermPageEntry"}
#: Header lines of a push buffer, by the name of what they say (fixed values).
HEADER = {"name": "index.title", "owner": "index.owner.name", "owner_email": "index.owner.email", "total_pages": "totalPages"}
HEADERS = "name string, owner string, owner_email string, total_pages long"
#: Entries of a push buffer, at most.
BUFFER = 10_000


class CodecError(ValueError):
    pass


def _utf(out: io.BytesIO, text: str) -> None:
    data = text.encode()
    out.write(struct.pack(">H", len(data)) + data)


def encode_entry(e: dict) -> bytes:
    """Mark, type, subject, relevance (single precision), then the target; for pages a count of positions, inverted when a
    title follows, and position with fragment ("" for none) each."""
    out = io.BytesIO()
    out.write(struct.pack(">Qi", MAGIC, e["entry_type"]))
    _utf(out, e["term"])
    out.write(struct.pack(">f", e["rel"]))
    _utf(out, e["target"])
    if e["entry_type"] == PAGE:
        fragments = dict(e.get("fragments") or {})
        places = sorted(set(e.get("positions") or []) | set(fragments))
        n = len(places)
        out.write(struct.pack(">i", n if e.get("title") is None else ~n))
        if e.get("title") is not None:
            _utf(out, e["title"])
        for p in places:
            out.write(struct.pack(">i", p))
            _utf(out, fragments.get(p) or "")
    return out.getvalue()


def decode_entries(data: bytes) -> Iterator[dict]:
    at = 0

    def take(form: str):
        nonlocal at
        size = struct.calcsize(form)
        if at + size > len(data):
            raise CodecError("the data end inside an entry")
        value = struct.unpack_from(form, data, at)[0]
        at += size
        return value

    def utf() -> str:
        nonlocal at
        n = take(">H")
        if at + n > len(data):
            raise CodecError("the data end inside an entry")
        at += n
        return data[at - n : at].decode()

    while at < len(data):
        if take(">Q") != MAGIC:
            raise CodecError("not an entry of this version")
        kind = take(">i")
        if kind not in TAGS:
            raise CodecError(f"no such entry type: {kind}")
        e = {"entry_type": kind, "term": utf(), "rel": take(">f"), "target": utf(), "title": None, "positions": None, "fragments": None}
        if kind == PAGE:
            n = take(">i")
            if n < 0:
                e["title"], n = utf(), ~n
            pairs = [(take(">i"), utf() or None) for _ in range(n)]
            e["positions"] = sorted(p for p, _ in pairs) if n else None
            if any(f for _, f in pairs):
                e["fragments"] = pairs
        yield e


def encode_buffer(meta: dict, entries: list[dict]) -> bytes:
    """A push buffer: header lines, a line with `End`, entries to the end."""
    head = "".join(f"{HEADER[k]}={meta[k]}\n" for k in HEADER if meta.get(k) is not None)
    return (head + "End\n").encode() + b"".join(map(encode_entry, entries))


def decode_buffer(data: bytes) -> tuple[dict, Iterator[dict]]:
    meta = {"total_pages": -1}
    names = {line: name for name, line in HEADER.items()}
    at = 0
    while True:
        end = data.find(b"\n", at)
        if end < 0:
            raise CodecError("the header has no end")
        line, at = data[at:end].decode(), end + 1
        if line == "End":
            break
        key, _, value = line.partition("=")
        if key in names:
            meta[names[key]] = int(value) if key == "totalPages" else value
    return meta, decode_entries(data[at:])


def _batch(entries: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(entries, schema=_ARROW)


def _decode_files(buffered: bool, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                if kind == "yaml":
                    found: Iterator[dict] = from_yaml(data.decode())
                else:
                    found = decode_buffer(data)[1] if buffered else decode_entries(data)
                some: list[dict] = []
                for e in found:
                    some.append(e)
                    if len(some) >= 20_000:
                        yield _batch(some)
                        some = []
                yield _batch(some)

    return run


def read_binary(spark: SparkSession, path: str, buffered: bool = False) -> DataFrame:
    """Entries of binary files (or push buffers); each file is decoded by one task."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_decode_files(buffered, "binary"), ENTRY)


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_decode_files(False, "yaml"), ENTRY)


def encode_buffers(postings: DataFrame, meta: dict | None = None, size: int = BUFFER) -> DataFrame:
    """(data, made): push buffers of at most size entries, each with the header; made where the rows lie.  A batch of rows from Spark is
    never joined with the next, so there can be more buffers than size asks for; made is the same for all of one call."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                yield pa.RecordBatch.from_arrays([pa.array([encode_buffer(meta or {}, batch.slice(at, size).to_pylist())], pa.binary())], ["data"])

    return _entries(postings).mapInArrow(run, "data binary").withColumn("made", F.lit(uuid.uuid4().hex))


def decode_buffers(buffers: DataFrame, column: str = "data") -> DataFrame:
    """The entries of a column of push buffers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield _batch(list(decode_buffer(data)[1]))

    return buffers.select(column).where(F.col(column).isNotNull()).mapInArrow(run, ENTRY)


def buffer_headers(buffers: DataFrame, column: str = "data") -> DataFrame:
    """name, owner, owner_email, total_pages of each push buffer; -1 pages where a header does not say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [decode_buffer(data)[0] for data in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[pa.array([h.get(n) for h in heads], pa.string()) for n in ("name", "owner", "owner_email")], pa.array([h["total_pages"] for h in heads], pa.int64())], list(HEADER))

    return buffers.select(column).where(F.col(column).isNotNull()).mapInArrow(run, HEADERS)


def encode_yaml(postings: DataFrame) -> DataFrame:
    """(value): the entries of each batch as YAML in block style, for a sink of text; files put together are YAML again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([to_yaml(batch.to_pylist())], pa.string())], ["value"])

    return _entries(postings).mapInArrow(run, "value string")


def _entries(postings: DataFrame) -> DataFrame:
    return postings.select("term", F.col("entry_type").cast("int"), "target", "title", "rel", "positions", "fragments")


def encode_rows(postings: DataFrame) -> DataFrame:
    """(data): each row as a binary entry, to be written by any sink of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encode_entry(e) for e in batch.to_pylist()], pa.binary())], ["data"])

    return _entries(postings).mapInArrow(run, "data binary")


def decode_rows(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([e for d in batch.column("data").to_pylist() for e in decode_entries(d)])

    return rows.select("data").mapInArrow(run, ENTRY)


class _Entry(dict):
    """An entry on its way to or from YAML."""


def _plain(e: dict) -> dict:
    body: dict = {"subj": e["term"], "rel": float(e["rel"])}
    if e["entry_type"] == PAGE:
        fragments = dict(e.get("fragments") or {})
        return body | {"page": e["target"], "title": e.get("title"), "positions": e.get("positions"), "posFragments": fragments or None}
    return body | {"term" if e["entry_type"] == TERM else "index": e["target"]}


def _entry(kind: int, body: dict) -> _Entry:
    if not isinstance(body, dict) or "subj" not in body or "rel" not in body:
        raise CodecError(f"not an entry: {str(body)[:60]}")
    # relevances are of single precision; files of others may give addresses a tag of their own
    rel = struct.unpack(">f", struct.pack(">f", body["rel"]))[0]
    target = body.get("page" if kind == PAGE else "term" if kind == TERM else "index")
    target = target.value if isinstance(target, Tagged) else target
    if target is None:
        raise CodecError("an entry without a target")
    fragments, positions = body.get("posFragments"), body.get("positions")
    if isinstance(positions, dict):  # places with their fragments in one map
        fragments, positions = fragments or {p: f for p, f in positions.items() if f is not None}, sorted(positions)
    return _Entry(term=str(body["subj"]), entry_type=kind, target=str(target), title=body.get("title"), rel=rel, positions=positions, fragments=[(int(k), v) for k, v in fragments.items()] if fragments else None)


def _translators() -> list[Translator]:
    return [Translator(tag, _Entry, _plain, lambda body, kind=kind: _entry(kind, body)) for kind, tag in TAGS.items()]


def to_yaml(entries: list[dict], translators: list[Translator] = ()) -> str:
    """A sequence of tagged entries in block style."""
    return yaml_text.dump([Tagged(TAGS[e["entry_type"]], _plain(e)) for e in entries], list(translators)) if entries else ""


def from_yaml(text: str, translators: list[Translator] = ()) -> Iterator[dict]:
    """Entries of a YAML sequence, block or flow style."""
    try:
        found = yaml_text.load(text, [*_translators(), *translators])
    except yaml_text.YamlError as e:
        raise CodecError(str(e)) from e
    for e in found or []:
        if not isinstance(e, _Entry):
            raise CodecError(f"not an entry: {str(e)[:60]}")
        yield dict(e)
