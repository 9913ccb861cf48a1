"""Document fingerprints by one-permutation MinHash.

Every shingle (five lower-cased words) is hashed once; the hash's top bits name a bin and the bin keeps its smallest
hash. Empty bins copy the bin that a fixed random sequence of attempts reaches first (optimal densification). Of each
bin the lowest ``BITS`` bits are stored, packed, as hexadecimal text; the share of equal bins is corrected for the
chance that unequal ones agree, ``(share - 2**-BITS) / (1 - 2**-BITS)``.

The query also follows each document to the next one in descending order of id. Rows are sorted over ranges (Spark samples
the keys), a task goes through its range batch by batch, and the last row of each range meets the first one of the next
range afterwards: texts move once, and no task holds more than two batches of them.

Defined cases: a null text counts as empty; an empty text has an empty fingerprint (its likeness is 1 to another
empty one and 0 to any other); a text with fewer than five words has its whole sequence as one shingle; rows of equal
id, and rows with a null id or one that is no whole number, which come last in the descending order, are ordered by the MD5
of their text, so they spread over ranges like others; a single document follows itself; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import bytetext as bt
from tidemark.llm.shared import written

BINS = 256
BITS = 4
WIDTH = 5
RANGE_ROWS = 4000
RANGE_BYTES = 16_000_000  # of text in a range, on average
TOGETHER = 500  # documents that are fingerprinted together
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def minima(texts: list[str], bins: int = BINS, width: int = WIDTH) -> np.ndarray:
    """[text, bin]: the smallest shingle hash of each bin, NONE where there is none."""
    found = np.full((len(texts), bins), NONE)
    shift = np.uint64(64 - bins.bit_length() + 1)
    for first, end, data, offsets in bt.slices(pa.array(texts, pa.large_string())):
        data = bt.lower(data)
        starts, ends, rows = bt.word_spans(data, offsets)
        shingle, rows = bt.shingles(bt.span_hashes(data, starts, ends), rows, end - first, width)
        place = rows * bins + (shingle >> shift).astype(np.int64)
        part = np.full((end - first) * bins, NONE)
        np.minimum.at(part, place, shingle)
        found[first:end] = part.reshape(-1, bins)
    return found


def densify(found: np.ndarray) -> np.ndarray:
    """Empty bins filled from the first non-empty bin of their own fixed sequence of attempts; rows of NONE stay."""
    bins = found.shape[1]
    out = found.copy()
    row, place = np.nonzero((found == NONE) & (found != NONE).any(1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        start = place.astype(np.uint64) if attempt <= 64 * bins else (place + attempt).astype(np.uint64)
        to = (bt.mix64(start * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        if attempt > 64 * bins:  # never reached in practice: step on bin by bin
            to = (place + attempt) % bins
        value = found[row, to]
        hit = value != NONE
        out[row[hit], place[hit]] = value[hit]
        row, place = row[~hit], place[~hit]
    return out


def packed(texts: list[str], bins: int = BINS, bits: int = BITS, width: int = WIDTH) -> np.ndarray:
    """[text, bin] low bits of the densified minima; a text without words has 255 everywhere."""
    found = densify(minima(texts, bins, width))
    low = (bt.mix64(found) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    low[(found == NONE).all(1)] = 255
    return low


def as_text(low: np.ndarray, bits: int = BITS) -> list[str]:
    if bits == 4:
        joined = (low[:, ::2] << 4) | (low[:, 1::2] & 15)
    elif bits == 8:
        joined = low
    else:
        raise ValueError("bits is 4 or 8")
    return ["" if row[0] == 255 else x.tobytes().hex() for row, x in zip(low, joined, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    chance = 2.0**-bits
    share = (a == b).mean(1)
    found = np.clip((share - chance) / (1 - chance), 0, 1)
    empty_a, empty_b = a[:, 0] == 255, b[:, 0] == 255
    return np.where(empty_a | empty_b, (empty_a & empty_b).astype(float), found)


def fingerprint(docs: DataFrame, text: str = "text", bins: int = BINS, bits: int = BITS, width: int = WIDTH) -> DataFrame:
    """Every row with a column ``fingerprint``; texts stay where they are."""

    @F.pandas_udf("string")
    def prints(column):
        import pandas as pd

        return pd.Series(as_text(packed(column.fillna("").tolist(), bins, bits, width), bits), index=column.index)

    return docs.withColumn("fingerprint", prints(F.col(text)))


def _out(kind: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("part", pa.int32()), ("kind", pa.int32()), ("doc_id", kind), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string()),
    ])


_COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
DONE, FIRST, LAST = 0, 1, 2


def _figures(ids: list, kind: pa.DataType, texts: list[str], low: np.ndarray) -> dict[str, pa.Array]:
    """The columns of every text but the last, each followed by the one after it."""
    edited = []
    for own, other in zip(texts, texts[1:], strict=False):
        m = len(own) // 3
        edited.append(own[: len(own) - m] + other[:m])
    a, b = low[:-1], packed(edited)
    return {
        "doc_id": pa.array(ids[:-1], kind), "n_chars": pa.array([len(x) for x in texts[:-1]], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
        "fingerprint": pa.array(as_text(a), pa.string()), "edited_fingerprint": pa.array(as_text(b), pa.string()),
        "near_edited": pa.array(likeness(a, b)), "near_next": pa.array(likeness(a, low[1:])),
    }


def _row(schema: pa.Schema, part: int, kind: int, doc_id, text: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"part": part, "kind": kind, "doc_id": doc_id, "text": text}], schema)


def _follow(batches):
    """Done rows of a sorted range, and its first and last row with their texts."""
    held = None  # id, text and bits of the row before
    for batch in batches:
        out = _out(batch.column("doc_id").type)
        for at in range(0, len(batch), TOGETHER):
            rows = batch.slice(at, TOGETHER)
            ids, texts = rows.column("doc_id").to_pylist(), [t or "" for t in rows.column("text").to_pylist()]
            part = rows.column("part")[0].as_py()
            if held is None:
                yield _row(out, part, FIRST, None, texts[0])
            low = packed(texts)
            if held is not None:
                ids, texts, low = [held[0], *ids], [held[1], *texts], np.concatenate([held[2], low])
            if len(texts) > 1:
                found = _figures(ids, out.field("doc_id").type, texts, low)
                n = len(texts) - 1
                same = {"part": pa.array(np.full(n, part, np.int32)), "kind": pa.array(np.full(n, DONE, np.int32)), "text": pa.nulls(n, pa.string())}
                yield pa.RecordBatch.from_arrays([(found | same)[c] for c in out.names], schema=out)
            held = ids[-1], texts[-1], low[-1:]
    if held is not None:
        yield _row(out, part, LAST, held[0], held[1])


def _finish(batches):
    """Last rows of ranges with the text that follows."""
    names = ["doc_id", *(c.split()[0] for c in _COLUMNS.split(", "))]
    for batch in batches:
        for doc_id, text, follower in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "follower")), strict=True):
            found = _figures([doc_id, None], batch.column("doc_id").type, [text, follower], packed([text, follower]))
            yield pa.RecordBatch.from_arrays([found[c] for c in names], names)


def followed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of every document and of its text with the last third taken from the next document."""
    columns = f"doc_id {dict(docs.dtypes)[doc_id]}, {_COLUMNS}"
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = max(1, -(-n // range_rows), min(n, -(-(size or 0) // RANGE_BYTES)))
    order = [F.col("doc_id").desc_nulls_last(), F.md5("text").desc()]
    ranges = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    found = written(ranges.mapInArrow(_follow, f"part int, kind int, {columns}, text string"), "ranges")
    done = found.where(F.col("kind") == DONE).drop("part", "kind", "text")
    first = found.where(F.col("kind") == FIRST).select(F.col("part").alias("next"), F.col("text").alias("follower"))
    # the range after each one that has rows, the first one after the last: two numbers a range
    along = Window.orderBy("next")
    ring = first.select(F.col("next").alias("part"), F.coalesce(F.lead("next").over(along), F.min("next").over(Window.partitionBy())).alias("next"))
    last = found.where(F.col("kind") == LAST).select("part", "doc_id", "text").join(ring, "part").join(first, "next")
    return done.unionByName(last.select("doc_id", "text", "follower").mapInArrow(_finish, columns))


def op6_fingerprints(spark, sf_dir):
    return followed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_fingerprints": op6_fingerprints}
ORACLES: dict[str, str] = {}
