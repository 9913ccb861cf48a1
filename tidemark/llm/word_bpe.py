"""Byte-level BPE from a table of distinct words.

A text is cut the way the vocabulary's own splitter cuts it (words with the space before them, numbers, signs, English
endings, white space, and the special tokens that stand in it), as merges never cross such a cut. The cut runs block by
block in arrays, over code points whose kind (letter, digit, sign, space) is asked from the installed library once in a
process. Each block of about ``BLOCK_BYTES`` of text is written as one row: its distinct words, and for each document the
numbers of its words by position. The words that the blocks ask for are dealt out and sorted by word, so each distinct
word is encoded once, by the library, and its ids go back to the blocks that have it, those for one block packed. Blocks are a table bucketed by their
number: the ids come to them, and they don't move again. There a document's ids are put together by position.

Decoding joins ids with pieces. Pieces are as many as the vocabulary has (50,257, a megabyte), so ``encode`` broadcasts them
and joins them to the ids of a block's distinct words, whose bytes are then put together by position as the ids are;
``decode`` takes ids from anywhere: exploded by position, joined with the table of pieces, grouped by row. The words grow
with the corpus; they are never broadcast or collected, and no word has more rows than there are blocks.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to an empty one; repeated rows are encoded
alike; ids beyond the vocabulary are passed over in decoding, null ids decode to null; the text column leaves and ``ids``
and ``decoded`` join the others, replacing columns of those names; an empty table gives an empty result.
"""

from __future__ import annotations

import importlib.util
import json
import re
import uuid
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from tidemark.llm import bytetext as bt
from tidemark.llm.shared import written
from tidemark.tables import folder

BLOCK_BYTES = 32_000_000
TOGETHER = 256  # documents that are put together at once
HELD = 300_000  # answers that a task keeps before it hands them over
LETTER, NUMBER, SIGN, SPACE, UNKNOWN = range(5)
#: English endings that follow an apostrophe as one word with it.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer files are installed."""
    return str(Path(importlib.util.find_spec("public_tokenizers").origin).parent / name)


@lru_cache(maxsize=2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class Splitter:
    """Cuts texts into the words that BPE encodes one by one."""

    def __init__(self, path: str):
        self.cut = tokenizer(path).pre_tokenizer.pre_tokenize_str
        special = [t["content"] for t in json.loads(Path(path).read_text())["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))).encode()) if special else None
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)

    def kinds(self, points: np.ndarray) -> np.ndarray:
        """The kind of each code point; one not met before is put beside a letter, a digit and a sign to see which it joins."""
        found = self.kind[points]
        new = np.unique(points[found == UNKNOWN])
        for c in new.tolist():
            joins = (k for k, mate in ((LETTER, "a"), (NUMBER, "1"), (SIGN, "!")) if len(self.cut(mate + chr(c))) == 1)
            self.kind[c] = next(joins, SPACE)
        return self.kind[points] if len(new) else found

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, row) of every word of the texts, as byte positions."""
        raw = data.tobytes()
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        n = len(points)
        if not n:
            return (np.zeros(0, np.int64),) * 3
        lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        edge = np.zeros(n + 1, bool)  # where nothing joins: texts and special tokens begin and end
        edge[np.searchsorted(lead, offsets)] = True
        edge[n] = True
        kind = self.kinds(points)
        inside = np.zeros(n, bool)
        for m in self.special.finditer(raw) if self.special else ():
            if np.searchsorted(offsets, m.start(), "right") == np.searchsorted(offsets, m.end(), "left"):
                a, b = np.searchsorted(lead, m.span())
                edge[[a, b]], inside[a + 1 : b] = True, True
        run = edge[:-1].copy()
        run[1:] |= kind[1:] != kind[:-1]
        start = run & ~inside
        first = np.flatnonzero(start)
        last = np.append(first[1:], n) - 1
        follows = ~edge[last + 1]  # a run of the same stretch follows
        spaces = (kind[first] == SPACE) & follows
        start[last[spaces]] = True  # the last space is apart from those before it
        joined = last[spaces & (points[last] == ord(" "))]
        start[joined + 1] = False  # and goes with what follows
        mark = first[(first == last) & (points[first] == ord("'")) & follows & start[first]]
        mark = mark[kind[mark + 1] == LETTER]
        ahead = [np.where((mark + k < n) & ~edge[np.minimum(mark + k, n)] if k > 1 else mark + k < n, points[np.minimum(mark + k, n - 1)], 0) for k in (1, 2)]
        for ending in ENDINGS:
            fits = np.all([ahead[k] == ord(c) for k, c in enumerate(ending)], axis=0)
            after = mark[fits] + 1 + len(ending)
            start[mark[fits] + 1] = False
            start[after[after < n]] = True
        at = np.flatnonzero(start)
        ends = lead[np.append(at[1:], n)]
        return lead[at], ends, np.searchsorted(offsets, lead[at], "right") - 1


def _packed(codes: np.ndarray) -> bytes:
    """Word numbers, the bytes of equal weight together, which compress well."""
    planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


class Gathered:
    """What has been cut for one block: per slice its distinct words and which of them stands where."""

    def __init__(self):
        self.hashes, self.words, self.places, self.counts, self.rows, self.size = [], [], [], [], [], 0

    def add(self, split: Splitter, data: np.ndarray, offsets: np.ndarray, kept: list[pa.Array]) -> None:
        starts, ends, rows = split.words(data, offsets)
        hashes, where, place, count = np.unique(bt.span_hashes(data, starts, ends), return_index=True, return_inverse=True, return_counts=True)
        raw = data.tobytes()
        self.words += [raw[a:b].decode() for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        self.places.append(place.astype(np.uint32))
        self.hashes.append(hashes)
        self.counts.append(count)
        self.rows.append([pa.array(np.bincount(rows, minlength=len(offsets) - 1), pa.int32()), *kept])
        self.size += len(data)

    def batch(self, block: int, names: list[str]) -> pa.RecordBatch:
        hashes, counts = np.concatenate(self.hashes), np.concatenate(self.counts)
        _, where, merged = np.unique(hashes, return_index=True, return_inverse=True)
        words = [self.words[i] for i in where.tolist()]
        by_name = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        # small numbers for common words, and equally common ones by name: both compress well
        common = by_name[np.argsort(-np.bincount(merged, counts, len(where))[by_name], kind="stable")]
        number = np.empty(len(common), np.uint32)
        number[common] = np.arange(len(common))
        bounds = np.cumsum([0, *map(len, self.hashes)])
        codes = [number[merged[a:b]][place] for a, b, place in zip(bounds[:-1], bounds[1:], self.places, strict=True)]
        kept = pa.StructArray.from_arrays([pa.concat_arrays(x) for x in zip(*self.rows, strict=True)], names)
        columns = [
            pa.array([block]), pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept),
            pa.array([_packed(np.concatenate(codes))], pa.binary()), pa.array([[words[i] for i in common.tolist()]], pa.list_(pa.string())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["block", "rows", "codes", "words"])


def _cut(path: str, others: list[str]):
    """For each block its documents' other columns and numbers of words, its distinct words, and their numbers by position."""

    def run(batches):
        split, block, held = splitter(path), TaskContext.get().partitionId() << 32, Gathered()
        for batch in batches:
            for first, end, data, offsets in bt.slices(batch.column(0)):
                if held.size and held.size + len(data) > BLOCK_BYTES:
                    yield held.batch(block, ["_n", *others])
                    block, held = block + 1, Gathered()
                held.add(split, data, offsets, [batch.column(i + 1).slice(first, end - first) for i in range(len(others))])
        if held.rows:
            yield held.batch(block, ["_n", *others])

    return run


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """``df`` as a table of the shared folder whose buckets a join or grouping by ``column`` reads without moving it."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.option("path", f"{folder(spark).rstrip('/')}/{table}").option("compression", "zstd")
    writer.bucketBy(buckets, column).saveAsTable(table)
    return spark.table(table)


def _answers(blocks: list[pa.Array], codes: list[pa.Array], ids: list[bytes]) -> pa.RecordBatch:
    """A row for each block: numbers of words, how many ids each has, and the ids, packed."""
    at, code = (pa.concat_arrays(x).to_numpy() for x in (blocks, codes))
    order = np.lexsort((code, at))
    first = np.flatnonzero(np.append(True, np.diff(at[order]) != 0))
    out = []
    for low, high in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
        own = order[low:high]
        found = [ids[i] for i in own.tolist()]
        size = np.array([len(x) // 4 for x in found], np.uint32)
        out.append((int(at[own[0]]), _packed(code[own]), _packed(size), _packed(np.frombuffer(b"".join(found), "<u4"))))
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["at", "codes", "sizes", "ids"])


def _encoded(path: str):
    """The ids of (block, code, word) rows sorted by word, for the blocks that ask: each distinct word is encoded as it comes up."""

    def run(batches):
        encode, kind = tokenizer(path).encode_batch, np.dtype("<u4")
        last, last_ids = None, b""
        blocks, codes, found = [], [], []
        for batch in batches:
            for low in range(0, len(batch), 5_000):
                part = batch.slice(low, 5_000)
                words = part.column(2).to_pylist()
                new = [w for w, before in zip(words, [last, *words], strict=False) if w != before]
                ids = iter([np.array(e.ids, kind).tobytes() for e in encode(new, add_special_tokens=False)])
                for w in words:
                    if w != last:
                        last, last_ids = w, next(ids)
                    found.append(last_ids)
                blocks.append(part.column(0))
                codes.append(part.column(1))
            if len(found) >= HELD:
                yield _answers(blocks, codes, found)
                blocks, codes, found = [], [], []
        if found:
            yield _answers(blocks, codes, found)

    return run


def piece_bytes(path: str) -> list[bytes]:
    """The bytes of every id of the vocabulary, empty for numbers that are no id."""
    # fixed values: byte-level vocabularies write bytes as themselves where printable, else as the next code points from 256 on
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ids = tokenizer(path).get_vocab()
    found = [b""] * (max(ids.values(), default=-1) + 1)
    for piece, i in ids.items():
        found[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
    return found


def pieces(spark, path: str) -> DataFrame:
    """(id, piece) of the vocabulary."""
    found = piece_bytes(path)
    return spark.createDataFrame(pd.DataFrame({"id": range(len(found)), "piece": found}), "id int, piece binary")


@F.pandas_udf(BinaryType())
def _joined(parts: pd.Series) -> pd.Series:
    return parts.map(lambda x: b"".join(p for p in x))


@F.pandas_udf(StringType())
def _text(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: None if x is None else bytes(x).decode("utf-8", "replace"))


def _decoded_by(key: str, table: DataFrame, path: str, ids: str) -> DataFrame:
    """(key, raw): the pieces of each row's ids in their order, by a join of ids with pieces."""
    places = table.select(key, F.posexplode(ids).alias("pos", "id"))
    found = places.join(F.broadcast(pieces(table.sparkSession, path)), "id").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    return found.select(key, _joined(F.col("p.piece")).alias("raw"))


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The values of each code's list one after another."""
    size = sizes[codes]
    before = np.cumsum(size) - size
    return values[np.arange(int(size.sum())) + np.repeat(starts[codes] - before, size)]


def _texts(raw: bytearray, ends: np.ndarray) -> pa.Array:
    """The texts that stand one after another; invalid bytes become U+FFFD."""
    found = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(raw))
    try:
        found.validate(full=True)
    except pa.ArrowInvalid:
        found = pa.array([bytes(raw[a:b]).decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.large_string())
    return found.cast(pa.string())


def _assembled(others: list[str], shared):
    """The documents of a block: their words' ids and the bytes of these ids' pieces, by position."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pieces = shared.value
        code, n_ids, flat = (np.concatenate([np.zeros(0, np.uint32), *(_unpacked(x.as_py()) for x in right.column(c))]) for c in ("codes", "sizes", "ids"))
        order, n_ids, flat = np.argsort(code), n_ids.astype(np.int64), flat.astype(np.int32)
        begin, n_ids = (np.cumsum(n_ids) - n_ids)[order], n_ids[order]
        words = np.empty(len(order), object)  # the bytes of each distinct word
        words[:] = [b"".join([pieces[i] for i in flat[a : a + n].tolist()]) for a, n in zip(begin.tolist(), n_ids.tolist(), strict=True)]
        rows = left.column("rows").combine_chunks().flatten()
        codes = _unpacked(left.column("codes")[0].as_py())
        bounds = np.append(0, np.cumsum(rows.field("_n").to_numpy().astype(np.int64)))
        length = np.array([len(x) for x in words], np.int32)
        ends = lambda size: np.append(0, np.cumsum(size[codes], dtype=np.int64))[bounds]
        id_ends, byte_ends = ends(n_ids), ends(length)
        own, text = np.empty(id_ends[-1], np.int32), bytearray(byte_ends[-1])
        for low in range(0, len(rows), TOGETHER):  # some documents at a time, into arrays that are made once
            a, b = low, min(low + TOGETHER, len(rows))
            here = codes[bounds[a] : bounds[b]]
            own[id_ends[a] : id_ends[b]] = _gathered(flat, begin, n_ids, here)
            text[byte_ends[a] : byte_ends[b]] = b"".join(words[here].tolist())
        found = pa.LargeListArray.from_arrays(pa.array(id_ends), pa.array(own)).cast(pa.list_(pa.int32()))
        return pa.table([*(rows.field(c) for c in others), found, _texts(text, byte_ends)], names=[*others, "ids", "decoded"])

    return run


def encode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Every row without its text, with ``ids``, array<int>, and ``decoded``, the text that the ids give."""
    path = path or vocabulary_path()
    spark, kinds = docs.sparkSession, dict(docs.dtypes)
    others = [c for c in docs.columns if c not in (text, "ids", "decoded")]
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), *[F.col(f"`{c}`") for c in others])
    fields = "".join(f", `{c}`: {kinds[c]}" for c in others)
    cut = rows.mapInArrow(_cut(path, others), f"block long, rows array<struct<_n: int{fields}>>, codes binary, words array<string>")
    blocks = bucketed(cut, "blocks", "block")
    asked = blocks.select("block", F.posexplode("words").alias("code", "word"))
    ids = asked.repartition("word").sortWithinPartitions("word").mapInArrow(_encoded(path), "at long, codes binary, sizes binary, ids binary")
    shared = spark.sparkContext.broadcast(piece_bytes(path))  # as many as the vocabulary has
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "ids array<int>", "decoded string"])
    return blocks.select("block", "rows", "codes").groupBy("block").cogroup(ids.groupBy("at")).applyInArrow(_assembled(others, shared), schema)


def decode(table: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """Every row with ``decoded``, the text of its ids; invalid bytes become U+FFFD."""
    path = path or vocabulary_path()
    others = [c for c in table.columns if c != "decoded"]
    rows = written(table.select(*[F.col(f"`{c}`") for c in others], F.monotonically_increasing_id().alias("_row")), "ids")
    found = rows.join(_decoded_by("_row", rows, path, ids), "_row", "left")
    empty = F.when(F.col(ids).isNotNull(), F.lit(b""))
    return found.select(*[F.col(f"`{c}`") for c in others], _text(F.coalesce("raw", empty)).alias("decoded"))


def op12_word_bpe(spark, sf_dir):
    """Digests of every document's ids and of what they decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    digest = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256)
    return encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op12_word_bpe": op12_word_bpe}
ORACLES: dict[str, str] = {}
