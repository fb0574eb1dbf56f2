"""Binary and card formats: tag-length-value data, machine-readable lines in running text, audit and session exports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_tlv(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Tags (hex) and values of consecutive elements; a cut-off element ends the reading."""
    at = 0
    while at < len(data):
        start = at
        at += 1
        if data[start] & 0x1F == 0x1F:
            while at < len(data) and data[at] & 0x80:
                at += 1
            at += 1
        tag = data[start:at].hex().upper()
        if at >= len(data):
            return
        size, at = data[at], at + 1
        if size & 0x80:
            more = size & 0x7F
            size, at = int.from_bytes(data[at : at + more], "big"), at + more
        if at + size > len(data):
            return
        yield tag, data[at : at + size]
        at += size


def tlv_elements(table: DataFrame, key: str, data: str) -> DataFrame:
    """key, place, tag and value of every element of a binary column; a null has none."""
    kind = table.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("place", T.IntegerType()), T.StructField("tag", T.StringType()), T.StructField("value", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, place, tag, value) for i, raw in enumerate(batch.column(1).to_pylist()) for place, (tag, value) in enumerate(read_tlv(raw or b""))]
            rows, places, tags, values = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(places, pa.int32()), pa.array(tags, pa.string()), pa.array(values, pa.binary())], names=schema.names)

    return table.select(key, data).mapInArrow(run, schema)


#: What tags stand for: groups of data in the list of a card, and details of the holder.
GROUPS = {0x61: "DG1", 0x75: "DG2", 0x67: "DG7", 0x6B: "DG11", 0x6C: "DG12", 0x6F: "DG15"}
DETAILS = {"5F0E": "native_name", "5F11": "birthplace", "5F42": "address", "5F12": "telephone", "5F13": "profession", "5F10": "personal_number"}
JPEG, JPEG_END, JP2 = b"\xff\xd8\xff", b"\xff\xd9", b"\x00\x00\x00\x0c\x6a\x50"


def inside(data: bytes, outer: str) -> Iterator[tuple[str, bytes]]:
    """Elements of all elements of a tag."""
    for tag, value in read_tlv(data):
        if tag == outer:
            yield from read_tlv(value)


def card_file(data: bytes) -> dict:
    """What a file of a card says, whichever it is: groups listed, machine-readable text, picture, details of the holder."""
    out: dict = {"groups": [GROUPS[b] for tag, value in inside(data, "60") if tag == "5C" for b in value if b in GROUPS]}
    texts = [value.decode("utf-8", "replace") for tag, value in inside(data, "61") if tag == "5F1F"]
    if not texts:  # the whole content, if long enough, ends with the lines
        texts = [t[-90:] for t in (v.decode("utf-8", "replace") for tag, v in read_tlv(data) if tag == "61") if len(t) >= 88]
    out["mrz"] = texts[0] if texts else None
    if (at := data.find(JPEG)) >= 0:
        end = data.rfind(JPEG_END, at + 1)
        out |= {"format": "jpeg", "picture": data[at : end + 2] if end > at else data[at:]}
    elif (at := data.find(JP2)) >= 0:
        out |= {"format": "jp2", "picture": data[at:]}
    return out | {DETAILS[tag]: value.decode("utf-8", "replace") for tag, value in inside(data, "6B") if tag in DETAILS}


def card_files(table: DataFrame, key: str, data: str) -> DataFrame:
    """key and the contents of a binary column's card files (:func:`card_file`), null where a file says nothing of it; a null file is empty."""
    kind = table.schema[key].dataType
    names = ["mrz", "format", *DETAILS.values()]
    schema = T.StructType([T.StructField(key, kind), T.StructField("groups", T.ArrayType(T.StringType())), *(T.StructField(n, T.StringType()) for n in names), T.StructField("picture", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [card_file(raw or b"") for raw in batch.column(1).to_pylist()]
            text = [pa.array([r.get(n) for r in read], pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r["groups"] for r in read], pa.list_(pa.string())), *text, pa.array([r.get("picture") for r in read], pa.binary())], names=schema.names)

    return table.select(key, data).mapInArrow(run, schema)


def mrz_lines(text: Column) -> Column:
    """Up to three lines of 30 characters that look machine-readable, the last ones of a text."""
    clean = F.upper(F.regexp_replace(text, "[«»{}()\\[\\]—–_-]", "<"))
    lines = F.transform(F.split(clean, "\r?\n"), lambda x: F.substring(F.regexp_replace(F.regexp_replace(F.trim(x), "O(?=[0-9])", "0"), "[^A-Z0-9<]", ""), 1, 30))
    good = F.transform(F.filter(lines, lambda x: F.length(x) >= 28), lambda x: F.rpad(x, 30, "<"))
    return F.slice(good, F.greatest(F.size(good) - 2, F.lit(1)), F.lit(3))


def mrz_line_score(line: Column) -> Column:
    return F.when(F.length(line) >= 28, F.length(F.regexp_replace(line, "[^A-Z0-9<]", "")) / 30).otherwise(0.0)


def frame_rows(sessions: DataFrame, key: str = "id", frames: str = "frames") -> DataFrame:
    """One row for each frame of a session; the truth is the corrected reading, else the accepted one."""
    return sessions.select(key, F.posexplode_outer(frames).alias("frame_no", "frame"), F.coalesce(F.col("corrected.lines"), F.col("accepted.lines")).alias("truth"))


def audit_rows(transactions: DataFrame) -> DataFrame:
    """Flattened metrics of each transaction, scores to three digits."""
    return transactions.select("id", "ts", "session_id", F.size("patients").alias("n_patients"), F.format_number(F.col("quality.raw_score"), "0.000").alias("raw_score"), F.col("engine.name").alias("engine"))
