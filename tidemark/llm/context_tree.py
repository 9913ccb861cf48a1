"""LM scoring by context-tree weighting over bytes.

A text is its words in order, lower-cased, each closed by a space, then one end symbol. A byte is predicted from up to
``DEPTH`` bytes before it, across words; before the text stand spaces. Each byte is eight binary decisions; at every
context and decision node a Krichevsky-Trofimov estimate is kept for each depth from 0, and the depths are mixed with
the context-tree weights ``P_w(s) = 1/2 P_kt(s) + 1/2 prod P_w(children of s)``. Learning is done once, on the training
rows; scoring mixes the frozen estimates along the context's path, and a context that was never seen is no part of the
tree: the deepest one seen takes what weight is left.

Layout. Documents are dealt into blocks of some megabytes by a hash, compressed. A block asks for its distinct words
and its distinct (context, byte) pairs, with its training counts, in buckets by hash: a pair that is in every block is
one entry a block. Buckets add the counts; their distinct pairs go on to parts by the last two bytes of the context,
where the trees from depth 2 on are weighted. What the trees of depth 2 give to depths 1 and 0 is added up by (last
byte, decision), 65,280 sums at most, which every part gets. Log probabilities go back to the buckets and from there to
the blocks, which sum them over their documents. So the model is as large as the corpus makes it and is never whole in
any task or in the driver; a part is as large as the distinct pairs of its contexts, whatever their counts.

Defined cases: a null text counts as empty; an empty text is the end symbol alone; rows with a null id are held out;
repeated rows count as often as they occur; with no training rows every byte has probability 1/256; other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytetext as bt
from tidemark.llm.shared import blocks_for

DEPTH = 6
BLOCK_BYTES = 12_000_000
HELD = 8_000_000  # bytes of text that are compressed together
SPACE, END = 0x20, 0x0A
END_WORD = np.uint64(0x8E51ECFD9A3B17C5)
LOG_HALF = np.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0: Stirling's series after eight steps up."""
    down = np.log(x)
    for k in range(1, 8):
        down = down + np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - down


_SMALL = 1 << 14
_TABLE = {more: log_gamma(np.arange(_SMALL) + more) for more in (0.5, 1.0)}


def _log_gamma_of(count: np.ndarray, more: float) -> np.ndarray:
    """log_gamma(count + more) of whole numbers; most are small."""
    found = _TABLE[more][np.minimum(count, _SMALL - 1).astype(np.int64)]
    large = count >= _SMALL
    found[large] = log_gamma(count[large] + more)
    return found


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the KT probability of any sequence with so many zeros and ones."""
    return _log_gamma_of(zeros, 0.5) + _log_gamma_of(ones, 0.5) - _log_gamma_of(zeros + ones, 1.0) - np.log(np.pi)


def packed(x: np.ndarray) -> bytes:
    """Numbers as bytes: all first bytes, all second ones and so on, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(data[8:], decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).reshape(-1).view(kind)


def _column(table: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers of all rows of a packed column, where each row ends)."""
    found = [unpacked(x, kind) for x in table.column(name).to_pylist()]
    return np.concatenate([np.zeros(0, kind), *found]), np.cumsum([len(x) for x in found])


def merged(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values with their counts added."""
    unique, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *values]), return_inverse=True)
    return unique, np.bincount(at, weights=np.concatenate([np.zeros(0), *counts]), minlength=len(unique)).astype(np.int64)


def stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes to predict, row of each): words with a space behind each, and the end symbol."""
    starts, ends, rows = bt.word_spans(data, offsets)
    sizes, n_rows = ends - starts + 1, len(offsets) - 1
    word = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(len(word)) - (np.cumsum(sizes) - sizes)[word]
    closed = np.where(place < (sizes - 1)[word], data[np.minimum(starts[word] + place, max(len(data) - 1, 0))] if len(data) else 0, SPACE)
    length = np.bincount(rows, weights=sizes, minlength=n_rows).astype(np.int64) + 1
    out = np.full(int(length.sum()), END, np.uint8)
    out[np.arange(len(word)) + rows[word]] = closed
    return out, np.repeat(np.arange(n_rows), length)


def pairs_of(out: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
    """Each byte with its context as one number of depth + 1 bytes: the latest byte of the context first, the byte last."""
    place = np.arange(len(out)) - np.searchsorted(rows, np.arange(rows[-1] + 1 if len(rows) else 0))[rows]
    found = out.astype(np.uint64)
    for k in range(1, depth + 1):
        before = np.full(len(out), SPACE, np.uint8)
        before[k:] = out[: max(len(out) - k, 0)]
        before[place < k] = SPACE
        found |= before.astype(np.uint64) << np.uint64(8 * (depth + 1 - k))
    return found


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = bt.word_spans(data, offsets)
    return bt.span_hashes(data, starts, ends), rows


def counted_of(texts, train: np.ndarray, depth: int):
    """((words, training counts), (pairs, training counts)) of the texts, sorted and distinct, those without training too."""
    words, word_n, pairs, pair_n = [np.array([END_WORD])], [np.array([train.sum()])], [], []
    for first, end, data, offsets in bt.slices(texts):
        data, learned = bt.lower(data), train[first:end]
        hashes, rows = word_hashes(data, offsets)
        out, of = stream(data, offsets)
        for values, row, to, n in ((hashes, rows, words, word_n), (pairs_of(out, of, depth), of, pairs, pair_n)):
            mine = learned[row]
            unique, count = np.unique(values[mine], return_counts=True)
            other = np.unique(values[~mine])
            to += [unique, other]
            n += [count, np.zeros(len(other), np.int64)]
    return merged(words, word_n), merged(pairs, pair_n)


def placed_of(texts, depth: int):
    """(distinct words, distinct pairs, slices): of each slice its rows, and its distinct words and pairs with their places."""
    words, pairs, parts = [np.array([END_WORD])], [np.zeros(0, np.uint64)], []
    for first, end, data, offsets in bt.slices(texts):
        data = bt.lower(data)
        hashes, row = word_hashes(data, offsets)
        out, of = stream(data, offsets)
        word, at = np.unique(hashes, return_inverse=True)
        pair, where = np.unique(pairs_of(out, of, depth), return_inverse=True)
        words.append(word)
        pairs.append(pair)
        parts.append((first, end, (word, at.astype(np.int32), row.astype(np.int32)), (pair, where.astype(np.int32), of.astype(np.int32))))
    return np.unique(np.concatenate(words)), np.unique(np.concatenate(pairs)), parts


def _bucket(hashed: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashed >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _cut(to: np.ndarray, *columns: np.ndarray):
    """(number, columns) of the rows of each bucket in use; rows keep their order."""
    order = np.argsort(to, kind="stable")
    number, at = np.unique(to[order], return_index=True)
    for k, a, b in zip(number.tolist(), at, np.append(at, len(to))[1:], strict=True):
        yield k, [x[order[a:b]] for x in columns]


def _deal(batches):
    """Rows (block, docs): documents of one block, compressed together."""
    held, size = [], 0

    def flush():
        table = pa.Table.from_batches(held).sort_by("block")
        block = table.column("block").to_numpy()
        number, at = np.unique(block, return_index=True)
        docs = []
        for a, b in zip(at, np.append(at[1:], len(block)), strict=True):
            sink = pa.BufferOutputStream()
            part = table.slice(a, b - a).drop_columns("block").combine_chunks()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(part)
            docs.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(docs, pa.binary())], ["block", "docs"])

    for batch in batches:
        if len(batch):
            held.append(batch)
            size += batch.nbytes
        if size > HELD:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _documents(table: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in table.column("docs").to_pylist()])


def _trained(docs: pa.Table) -> np.ndarray:
    return ~docs.column("held_out").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)


def _ask(depth: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        docs = _documents(table)
        (words, word_n), (pairs, pair_n) = counted_of(docs.column("text"), _trained(docs), depth)
        of_word, of_pair = dict(_cut(_bucket(words, buckets), words, word_n)), dict(_cut(_bucket(bt.mix64(pairs), buckets), pairs, pair_n))
        none = [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        rows = []
        for k in sorted(of_word.keys() | of_pair.keys()):
            (w, wn), (p, pn) = of_word.get(k, none), of_pair.get(k, none)
            rows.append([w.tobytes(), packed(wn), packed(p), packed(pn)])
        kind = [pa.array(list(x), pa.binary()) for x in zip(*rows, strict=True)]
        bucket = pa.array(sorted(of_word.keys() | of_pair.keys()), pa.int32())
        block = pa.array(np.full(len(rows), table.column("block")[0].as_py(), np.int32))
        return pa.table([bucket, block, *kind], ["bucket", "block", "words", "word_n", "pairs", "pair_n"])

    return run


def _add(depth: int, buckets: int):
    """The distinct pairs of a bucket with their counts, dealt to parts by the last two bytes of the context.

    The first row has the bucket's distinct words of the training rows and their number.
    """

    def run(table: pa.Table) -> pa.Table:
        pairs, n = merged([_column(table, "pairs", np.uint64)[0]], [_column(table, "pair_n", np.int64)[0]])
        hashes = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
        totals = merged(hashes, [_column(table, "word_n", np.int64)[0]])[1]
        parts = list(_cut(_bucket(bt.mix64(pairs >> np.uint64(8 * (depth - 1))), buckets), pairs, n)) or [(0, [pairs, n])]
        first = np.arange(len(parts)) == 0
        return pa.table([
            pa.array([k for k, _ in parts], pa.int32()), pa.array(np.full(len(parts), table.column("bucket")[0].as_py(), np.int32)),
            *(pa.array([packed(x[i]) for _, x in parts], pa.binary()) for i in (0, 1)), pa.array(first * (totals > 0).sum()), pa.array(first * totals.sum()),
        ], ["part", "bucket", "pairs", "pair_n", "vocabulary", "tokens"])

    return run


class Tree:
    """The contexts of depth 2 and more of sorted distinct (context, byte) pairs, and the weights of each decision."""

    def __init__(self, pairs: np.ndarray, n: np.ndarray, depth: int):
        self.depth = depth
        self.keys, self.n, self.up = {depth: pairs}, {depth: n.astype(np.float64)}, {}
        for level in range(depth - 1, 1, -1):
            deep = self.keys[level + 1]
            short = ((deep >> np.uint64(16)) << np.uint64(8)) | (deep & np.uint64(255))
            self.keys[level], self.up[level + 1] = np.unique(short, return_inverse=True)
            self.n[level] = np.bincount(self.up[level + 1], weights=self.n[level + 1], minlength=len(self.keys[level]))

    def nodes(self, level: int, bit: int):
        """(node of each key, first key of each node, zeros, ones) of one decision."""
        keys, n = self.keys[level], self.n[level]
        prefix = keys >> np.uint64(8 - bit)
        edge = np.ones(len(keys), bool)
        edge[1:] = prefix[1:] != prefix[:-1]
        node, first = np.cumsum(edge) - 1, np.flatnonzero(edge)
        one = (keys >> np.uint64(7 - bit)) & np.uint64(1) == 1
        ones = np.bincount(node, weights=n * one, minlength=len(first))
        return node, first, np.bincount(node, weights=n, minlength=len(first)) - ones, ones

    def decisions(self, bit: int) -> dict[int, tuple]:
        """By depth: (node of each key, first key of each node, zeros, ones, log P_w, share of the node's own estimate)."""
        found, below = {}, None
        for level in range(self.depth, 1, -1):
            node, first, zeros, ones = self.nodes(level, bit)
            own = log_kt(zeros, ones)
            if below is None:
                whole, stop = own, np.ones(len(own))
            else:
                child_whole, child_first = below
                children = np.bincount(node[self.up[level + 1][child_first]], weights=child_whole, minlength=len(own))
                whole = np.logaddexp(LOG_HALF + own, LOG_HALF + children)
                stop = np.exp(LOG_HALF + own - whole)
            found[level] = (node, first, zeros, ones, whole, stop)
            below = (whole, first)
        return found

    def sums(self) -> np.ndarray:
        """[last byte * 256 + decision node, (log P_w, zeros, ones)] of the contexts of depth 2, added up."""
        total = np.zeros((65536, 3))
        for bit in range(8):
            _, first, zeros, ones, whole, _ = self.decisions(bit)[2]
            keys = self.keys[2][first]
            at = (((keys >> np.uint64(16)) << np.uint64(8)) | (np.uint64(1 << bit) + ((keys & np.uint64(255)) >> np.uint64(8 - bit)))).astype(np.int64)
            for i, x in enumerate((whole, zeros, ones)):
                total[:, i] += np.bincount(at, weights=x, minlength=65536)
        return total

    def scores(self, top: Top) -> np.ndarray:
        """Log10 probability of each pair."""
        score = np.zeros(len(self.keys[self.depth]))
        for bit in range(8):
            info, keys = self.decisions(bit), self.keys[2]
            one = (keys >> np.uint64(7 - bit)) & np.uint64(1) == 1
            node = (np.uint64(1 << bit) + ((keys & np.uint64(255)) >> np.uint64(8 - bit))).astype(np.int64)
            p, mixed, left = np.full(len(keys), 0.5), np.zeros(len(keys)), np.ones(len(keys))
            for zeros, ones, stop in top.path((keys >> np.uint64(16)).astype(np.int64), node):
                p, mixed, left = _mix(p, mixed, left, zeros, ones, stop, one)
            for level in range(2, self.depth + 1):
                node, _, zeros, ones, _, stop = info[level]
                if level > 2:
                    up = self.up[level]
                    p, mixed, left, one = p[up], mixed[up], left[up], one[up]
                p, mixed, left = _mix(p, mixed, left, zeros[node], ones[node], stop[node], one)
            score += np.log10(p)
        return score


def _mix(p, mixed, left, zeros, ones, stop, one):
    """One depth further down: (probability if the path ended here, the estimates so far, the weight that is left)."""
    kt, seen = (np.where(one, ones, zeros) + 0.5) / (zeros + ones + 1), zeros + ones > 0
    return np.where(seen, mixed + left * kt, p), np.where(seen, mixed + left * stop * kt, mixed), np.where(seen, left * (1 - stop), left)


class Top:
    """Depths 0 and 1, from the sums over the contexts of depth 2."""

    def __init__(self, sums: np.ndarray):
        whole, zeros, ones = (x.reshape(256, 256) for x in sums.T)
        self.zeros, self.ones = zeros, ones
        one = np.logaddexp(LOG_HALF + log_kt(zeros, ones), LOG_HALF + whole)
        self.stop = np.exp(LOG_HALF + log_kt(zeros, ones) - one)
        self.root = zeros.sum(0), ones.sum(0)
        own = log_kt(*self.root)
        self.root_stop = np.exp(LOG_HALF + own - np.logaddexp(LOG_HALF + own, LOG_HALF + np.where(zeros + ones > 0, one, 0).sum(0)))

    def path(self, last: np.ndarray, node: np.ndarray):
        yield self.root[0][node], self.root[1][node], self.root_stop[node]
        yield self.zeros[last, node], self.ones[last, node], self.stop[last, node]


def _tree(table: pa.Table, depth: int):
    """(the tree of a part, place of each of its rows' pairs among the tree's, where each row ends)."""
    table = table.sort_by("bucket")
    (pairs, ends), (n, _) = _column(table, "pairs", np.uint64), _column(table, "pair_n", np.int64)
    order = np.argsort(pairs, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return Tree(pairs[order], n[order], depth), place, ends, table.column("bucket")


def _sums(depth: int):
    def run(table: pa.Table) -> pa.Table:
        total = _tree(table, depth)[0].sums()
        at = np.flatnonzero(total[:, 1:].any(1))
        words = [[sum(table.column(c).to_pylist())] for c in ("vocabulary", "tokens")]
        rows = np.concatenate([total[at].T, np.array([*words, [0]])], 1)  # node -1 carries the numbers of words
        return pa.table([pa.array(np.append(at, -1).astype(np.int32)), *(pa.array(x) for x in rows)], ["node", "whole", "zeros", "ones"])

    return run


TOLD = pa.schema([("bucket", pa.int32()), ("pairs", pa.binary()), ("logs", pa.binary()), ("vocabulary", pa.int64()), ("tokens", pa.int64())])


def _logs(depth: int):
    def run(table: pa.Table, top: pa.Table) -> pa.Table:
        if not len(table):
            return TOLD.empty_table()
        total = np.zeros((65537, 3))  # the last one is node -1
        sums = top.column("sums").combine_chunks().flatten()
        total[sums.field("node").to_numpy()] = np.stack([sums.field(c).to_numpy() for c in ("whole", "zeros", "ones")], 1)
        tree, place, ends, bucket = _tree(table, depth)
        logs, pairs = tree.scores(Top(total[:-1])).astype(np.float32)[place], tree.keys[depth][place]
        cut = lambda x: pa.array([packed(y) for y in np.split(x, ends[:-1])], pa.binary())
        words = [pa.array(np.full(len(table), x, np.int64)) for x in total[-1, :2]]
        return pa.table([bucket, cut(pairs), cut(logs), *words], schema=TOLD)

    return run


def _answer():
    def run(asks: pa.Table, told: pa.Table) -> pa.Table:
        known, _ = _column(told, "pairs", np.uint64)
        logs, _ = _column(told, "logs", np.float32)
        order = np.argsort(known)
        known, logs = known[order], logs[order]
        hashes = [np.frombuffer(x, np.uint64) for x in asks.column("words").to_pylist()]
        counts = [unpacked(x, np.int64) for x in asks.column("word_n").to_pylist()]
        words, totals = merged(hashes, counts)
        answers = lambda found: pa.array([packed(x) for x in found], pa.binary())
        return pa.table({
            "block": asks.column("block"), "bucket": asks.column("bucket"),
            "counts": answers(totals[np.searchsorted(words, x)] for x in hashes),
            "logs": answers(logs[np.searchsorted(known, unpacked(x, np.uint64))] for x in asks.column("pairs").to_pylist()),
            **{c: pa.array(np.full(len(asks), max(told.column(c).to_pylist(), default=0), np.int64)) for c in ("vocabulary", "tokens")},
        })

    return run


def _placed(to: np.ndarray, answers: pa.Table, name: str, kind) -> np.ndarray:
    """What the buckets answer, in the block's own order."""
    found = np.empty(len(to), kind)
    found[np.argsort(to, kind="stable")] = _column(answers, name, kind)[0]
    return found


def _score(depth: int, buckets: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        docs, answers = _documents(table), answers.sort_by("bucket")
        words, pairs, parts = placed_of(docs.column("text"), depth)
        counts = _placed(_bucket(words, buckets), answers, "counts", np.int64)
        logs = _placed(_bucket(bt.mix64(pairs), buckets), answers, "logs", np.float32).astype(np.float64)
        v, n = (max(answers.column(c).to_pylist()) for c in ("vocabulary", "tokens"))
        base = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))
        at_end, rows = int(np.searchsorted(words, END_WORD)), len(docs)
        tokens, known = np.ones(rows, np.int64), np.full(rows, int(counts[at_end] > 0))
        unigram, score, size = np.full(rows, base[at_end]), np.zeros(rows), np.zeros(rows)
        for first, end, (hashes, word, row), (unique, pair, of) in parts:
            many = end - first
            where = np.searchsorted(words, hashes)
            tokens[first:end] += np.bincount(row, minlength=many)
            known[first:end] += np.bincount(row, weights=(counts[where] > 0)[word], minlength=many).astype(np.int64)
            unigram[first:end] += np.bincount(row, weights=base[where][word], minlength=many)
            score[first:end] = np.bincount(of, weights=logs[np.searchsorted(pairs, unique)][pair], minlength=many)
            size[first:end] = np.bincount(of, minlength=many)
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(tokens),
            "n_known": pa.array(known), "train_tokens": pa.array(np.full(rows, n, np.int64)), "base_score": pa.array(unigram),
            "score": pa.array(score), "bits_per_byte": pa.array(-score * np.log2(10) / size),
        })

    return run


def score(
    docs: DataFrame, held_out, text: str = "text", doc_id: str = "doc_id", depth: int = DEPTH, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Every row's id, held_out, token counts, base score, log10 probability and bits per predicted byte.

    ``held_out`` is a boolean column expression; what it marks is scored but not learned from. ``depth`` is 2 to 7, as a
    context and its byte are one 64-bit number.
    """
    if not 2 <= depth <= 7:
        raise ValueError(f"depth is 2 to 7, not {depth}")
    blocks = blocks_for(docs, text, block_bytes)
    block = F.pmod(F.xxhash64(doc_id, text), F.lit(blocks)).cast("int").alias("block")
    rows = docs.select(block, F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.col(text).alias("text"))
    dealt = rows.mapInArrow(_deal, "block int, docs binary").repartition(blocks, "block")
    asks = dealt.groupBy("block").applyInArrow(_ask(depth, blocks), "bucket int, block int, words binary, word_n binary, pairs binary, pair_n binary")
    asks = asks.repartition(blocks, "bucket")
    parts = asks.groupBy("bucket").applyInArrow(_add(depth, blocks), "part int, bucket int, pairs binary, pair_n binary, vocabulary long, tokens long")
    parts = parts.repartition(blocks, "part")
    sums = parts.groupBy("part").applyInArrow(_sums(depth), "node int, whole double, zeros double, ones double")
    sums = sums.groupBy("node").agg(F.sum("whole").alias("whole"), F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    # one row of 65,280 sums at most, for every part
    whole = sums.agg(F.collect_list(F.struct("node", "whole", "zeros", "ones")).alias("sums")).withColumn("all", F.lit(0))
    each = docs.sparkSession.range(blocks).select(F.col("id").cast("int").alias("part"), F.lit(0).alias("all"))
    top = each.join(F.broadcast(whole), "all").select("part", "sums")
    told = parts.groupBy("part").cogroup(top.groupBy("part")).applyInArrow(_logs(depth), "bucket int, pairs binary, logs binary, vocabulary long, tokens long")
    answers = asks.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(
        _answer(), "block int, bucket int, counts binary, logs binary, vocabulary long, tokens long"
    )
    kind = dict(docs.dtypes)[doc_id]
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score(depth, blocks),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double",
    )


def op1_context_tree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, F.crc32(F.col("doc_id").cast("string")) % 10 == 0)


QUERIES = {"op1_context_tree": op1_context_tree}
ORACLES: dict[str, str] = {}
