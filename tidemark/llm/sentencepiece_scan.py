"""SentencePiece encoding and decoding as a max-plus parallel scan.

The installed model is of the BPE kind. A segmentation of a text is what BPE makes of it exactly when every two
neighbouring pieces are what BPE makes of their join. So encoding is a best path through the lattice of pieces in
which the step from piece u to piece v weighs 0 if BPE leaves the two apart in ``u + v``, and minus infinity
otherwise: the max-plus sum has one finite path, and at each position one last piece that can end it.

No piece crosses a space that follows another character, nor a character outside the vocabulary (it becomes bytes):
there the lattice has one state. Documents up to ``GIANT`` characters are encoded whole, all their distinct
stretches at once in arrays. Longer ones are cut into chunks of ``CHUNK`` characters wherever that falls. A chunk's
boundary state is the piece that covers the cut (its id and how far it reaches past it); every chunk gives the matrix
of finite transfers from the states at its start to those at its end. Neighbouring matrices are multiplied in rounds, two
and two, until a document has one; its path is chosen there and handed down the same rounds as the states at each chunk's
two ends, and then each chunk walks back by itself. No task holds more than two matrices of a document at once.

Decoding joins the pieces, turns byte pieces into UTF-8 (invalid bytes into U+FFFD), the mark into spaces, and drops
the leading space. It gives the text back exactly unless the text contains the mark U+2581 itself, which reads as a
space.

Defined cases: a null text counts as empty; an empty text has no ids; a null id passes through; repeated rows are
encoded alike; other columns pass through ``encode``, and an input column with the name of an added one is replaced; an
empty table gives an empty result.
"""

from __future__ import annotations

import importlib.util
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytetext as bt
from tidemark.llm.shared import small_batches, written

GIANT = 65_536
CHUNK = 16_384
SLICE = 250_000  # characters encoded together
BATCH_ROWS = 1_000  # rows that Spark hands over at once: texts may be long
MARK = "▁"
KEPT = 200_000  # distinct stretches that a process keeps
KNOWN = 1_000_000  # pairs of pieces that a process keeps
TOGETHER = 10_000  # distinct stretches whose paths are found at once
LONG = 64  # stretches above this many characters are encoded one at a time


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public tokenizer files are installed."""
    return str(Path(importlib.util.find_spec("public_tokenizers").origin).parent / name)


class Pieces:
    """The vocabulary: pieces, scores, a trie of the normal pieces, and which neighbours BPE leaves apart."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.byte = {i: int(self.text[i][3:5], 16) for i in range(n) if model.is_byte(i)}
        self.plain = [t if i not in self.byte else chr(self.byte[i]) if self.byte[i] < 128 else None for i, t in enumerate(self.text)]
        self.of_byte = {b: i for i, b in self.byte.items()}
        normal = [i for i in range(n) if not (i in self.byte or model.is_control(i) or model.is_unknown(i))]
        self.id = {self.text[i]: i for i in normal}
        self.score = [model.get_score(i) for i in range(n)]
        self.length = np.array([len(t) for t in self.text])
        self.longest = max(len(t) for t in self.id)
        self.char = np.full(0x110000, -1, np.int32)
        singles = sorted(t for t in self.id if len(t) == 1)
        self.char[[ord(c) for c in singles]] = np.arange(len(singles))
        self.bits = max(1, len(singles).bit_length())
        nodes: dict[tuple[int, int], int] = {}
        tokens = [-1]
        for piece, i in self.id.items():
            at = 0
            for c in piece:
                code = int(self.char[ord(c)])
                if code < 0:
                    at = -1
                    break
                step = (at, code)
                if step not in nodes:
                    nodes[step] = len(tokens)
                    tokens.append(-1)
                at = nodes[step]
            if at > 0:
                tokens[at] = i
        self.token = np.array(tokens)
        edge = np.array([(a << self.bits) | c for a, c in nodes], np.int64)
        order = np.argsort(edge)
        self.edge, self.target = edge[order], np.array(list(nodes.values()))[order]
        self.known = np.zeros(0, np.int64)
        self.apart = np.zeros(0, bool)

    def merge(self, text: str) -> list[str]:
        """BPE by the book: again and again join the neighbours whose join has the highest score, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                joined = self.id.get(parts[i] + parts[i + 1])
                if joined is not None and (best is None or self.score[joined] > best):
                    best, at = self.score[joined], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def leaves_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE of the join is the two pieces; each pair is worked out once in a process."""
        code = left.astype(np.int64) * len(self.text) + right
        at = np.searchsorted(self.known, code)
        new = np.ones(len(code), bool) if not len(self.known) else self.known[np.minimum(at, len(self.known) - 1)] != code
        if new.any():
            if len(self.known) > KNOWN:  # start anew, which costs time only
                self.known, self.apart, new = np.zeros(0, np.int64), np.zeros(0, bool), np.ones(len(code), bool)
            missing, fresh = np.sort(code[new]), []
            missing = missing[np.append(True, missing[1:] != missing[:-1])]
            for c in missing.tolist():
                u, v = self.text[c // len(self.text)], self.text[c % len(self.text)]
                fresh.append(self.merge(u + v) == [u, v])
            to = np.searchsorted(self.known, missing)
            self.known, self.apart = np.insert(self.known, to, missing), np.insert(self.apart, to, fresh)
            at = np.searchsorted(self.known, code)
        return self.apart[at]

    def matches(self, codes: np.ndarray, room: np.ndarray) -> np.ndarray:
        """[position, length - 1]: the piece that starts there and has that length, -1 if none; ``room`` limits lengths."""
        found = np.full((len(codes), self.longest), -1, np.int32)
        at, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        for k in range(self.longest):
            inside = room[at] > k
            at, node = at[inside], node[inside]
            if not len(at):
                break
            step = (node << self.bits) | codes[at + k]
            place = np.minimum(np.searchsorted(self.edge, step), len(self.edge) - 1)
            hit = self.edge[place] == step
            at, node = at[hit], self.target[place[hit]]
            found[at, k] = self.token[node]
        return found


_loaded: dict[str, Pieces] = {}


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """A process keeps what it has encoded; beyond a size it starts anew, which costs time only."""
    found = _encoders.get(path)
    if found is None or len(found.hashes) > KEPT:
        found = _encoders[path] = Encoder(pieces(path))
    return found


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def paths(vocabulary: Pieces, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids one after the other, how many of each stretch): the finite path of every stretch, all stretches in step."""
    ends = np.cumsum(sizes)
    flat = codes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]
    begin = ends - sizes
    place = np.arange(len(flat)) - np.repeat(begin, sizes)
    match = vocabulary.matches(flat, np.repeat(sizes, sizes) - place)
    last = np.full(len(flat), -1, np.int32)  # the last piece of the path to behind each position
    for i in range(1, int(sizes.max(initial=0)) + 1):
        open_ = np.flatnonzero(sizes >= i)
        for length in range(min(i, vocabulary.longest), 0, -1):
            token = match[begin[open_] + i - length, length - 1]
            has = np.flatnonzero(token >= 0)
            if not len(has):
                continue
            where, token = open_[has], token[has]
            if length == i:
                fits = np.ones(len(where), bool)
            else:
                fits = vocabulary.leaves_apart(last[begin[where] + i - length - 1], token)
            last[begin[where[fits]] + i - 1] = token[fits]
            keep = np.ones(len(open_), bool)
            keep[has[fits]] = False
            open_ = open_[keep]
            if not len(open_):
                break
    # walk back, all stretches in step
    steps, at, who = [], ends.copy(), np.arange(len(ends))
    while len(who):
        token = last[at - 1]
        steps.append((who, token))
        at = at - vocabulary.length[token]
        more = at > begin[who]
        at, who = at[more], who[more]
    if not steps:
        return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
    owner = np.concatenate([w for w, _ in steps])
    back = np.concatenate([np.full(len(w), i) for i, (w, _) in enumerate(steps)])
    token = np.concatenate([t for _, t in steps])
    order = np.lexsort((-back, owner))
    return token[order], np.bincount(owner, minlength=len(sizes))


class Encoder:
    """Encodes many texts; distinct stretches are encoded once."""

    def __init__(self, vocabulary: Pieces):
        self.v = vocabulary
        self.hashes = np.zeros(0, np.uint64)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def stretches(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, character codes) of the parts of the text that no piece crosses."""
        codes = self.v.char[points]
        mark = points == ord(MARK)
        cut = np.zeros(len(points), bool)
        cut[1:] = mark[1:] & ~mark[:-1]
        cut |= codes < 0
        cut[1:] |= codes[:-1] < 0
        cut[offsets[:-1][offsets[:-1] < len(points)]] = True
        return np.flatnonzero(cut), codes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; how many of each text)."""
        return self.encode_marked([MARK + t.replace(" ", MARK) if t else "" for t in texts])

    def encode_marked(self, marked: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(t) for t in marked])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(marked), np.int64)
        starts, codes = self.stretches(points, offsets)
        ends = np.append(starts[1:], len(points))
        hashes = bt.span_hashes_of(bt.mix64(points.astype(np.uint64) + np.uint64(1)) | np.uint64(1), starts, ends)
        unique, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        where = np.searchsorted(self.hashes, unique)
        new = at[self.hashes[np.minimum(where, len(self.hashes) - 1)] != unique] if len(self.hashes) else at
        if len(new):
            self._learn(points, codes, starts[new], ends[new], hashes[new])
            where = np.searchsorted(self.hashes, unique)
        where = where[inverse]
        count, first = self.count[where], self.first[where]
        done = np.cumsum(count)
        ids = self.pool[np.arange(done[-1]) + np.repeat(first - (done - count), count)]
        row = np.searchsorted(offsets, starts, "right") - 1
        return ids, np.bincount(row, weights=count, minlength=len(marked)).astype(np.int64)

    def _learn(self, points, codes, starts, ends, hashes) -> None:
        sizes = ends - starts
        plain = codes[starts] >= 0
        count = np.zeros(len(starts), np.int64)
        order, pool = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        short = np.flatnonzero(plain & (sizes <= LONG))
        for low in range(0, len(short), TOGETHER):
            part = short[low : low + TOGETHER]
            token, count[part] = paths(self.v, codes, starts[part], sizes[part])
            order.append(part)
            pool.append(token)
        for i in np.flatnonzero(plain & (sizes > LONG)):
            pool.append(np.array(walk(self.v, codes[starts[i] : ends[i]]), np.int32))
            order.append(np.array([i]))
            count[i] = len(pool[-1])
        for i in np.flatnonzero(~plain):
            raw = chr(points[starts[i]]).encode("utf-8", "surrogatepass")
            pool.append(np.array([self.v.of_byte[b] for b in raw], np.int32))
            order.append(np.array([i]))
            count[i] = len(raw)
        placed, first = np.concatenate(order), np.zeros(len(starts), np.int64)
        first[placed] = len(self.pool) + np.cumsum(count[placed]) - count[placed]
        order = np.argsort(hashes)
        to = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, to, hashes[order])
        self.first, self.count = np.insert(self.first, to, first[order]), np.insert(self.count, to, count[order])
        self.pool = np.concatenate([self.pool, *pool])


def walk(v: Pieces, codes: np.ndarray) -> list[int]:
    """The path of one long stretch, position by position."""
    n = len(codes)
    match = v.matches(codes, np.minimum(n - np.arange(n), v.longest))
    last = [-1] * (n + 1)
    for i in range(1, n + 1):
        for length in range(min(i, v.longest), 0, -1):
            token = int(match[i - length, length - 1])
            if token >= 0 and (length == i or v.leaves_apart(np.array([last[i - length]]), np.array([token]))[0]):
                last[i] = token
                break
    out, at = [], n
    while at:
        out.append(last[at])
        at -= int(v.length[last[at]])
    return out[::-1]


# Giant documents. A state at a boundary is (how far the piece over it reaches past it, the piece); (0, -1) is the start
# of the text or the end of a character outside the vocabulary.

State = tuple[int, int]


class Chunk:
    """One chunk of a marked text with up to ``longest`` characters of it on either side."""

    def __init__(self, v: Pieces, left: str, body: str, right: str):
        self.v, self.a, self.b = v, len(left), len(left) + len(body)
        self.text = left + body + right
        points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.codes = v.char[points]
        mark, n = points == ord(MARK), len(points)
        self.cut = np.zeros(n + 1, bool)
        self.cut[1:n] = mark[1:] & ~mark[:-1]
        self.cut[:n] |= self.codes < 0
        self.cut[1:] |= self.codes < 0
        if not left:
            self.cut[0] = True
        stops = np.append(np.flatnonzero(self.cut), n)
        at = np.arange(n)
        room = np.minimum(stops[np.searchsorted(stops, at, "right")] - at, v.longest)
        self.match = v.matches(np.where(self.codes < 0, (1 << v.bits) - 1, self.codes), room)

    def entries(self) -> list[State]:
        if self.a == 0:
            return [(0, -1)]
        found = [(0, -1)] if self.codes[self.a - 1] < 0 else []
        for s in range(max(0, self.a - self.v.longest), self.a):
            for k in range(self.a - s - 1, self.v.longest):
                if self.match[s, k] >= 0:
                    found.append((s + k + 1 - self.a, int(self.match[s, k])))
        return found

    def forward(self, node: tuple[int, int], stop: int) -> tuple[dict, list]:
        """Lattice nodes (position, last piece) on finite paths from a node, each with the one before; those at or past stop."""
        before, queue, ends = {node: None}, {node[0]: [node]}, []
        at = node[0]
        while queue:
            at = min(queue)
            for u in queue.pop(at):
                if at >= stop:
                    ends.append(u)
                    continue
                free = self.cut[at] or u[1] < 0
                if self.codes[at] < 0:
                    steps = [(at + 1, -1)]
                else:
                    token = self.match[at]
                    length = np.flatnonzero(token >= 0)
                    if not free and len(length):
                        length = length[self.v.leaves_apart(np.full(len(length), u[1]), token[length])]
                    steps = [(at + int(k) + 1, int(token[k])) for k in length]
                for w in steps:
                    if w not in before:
                        before[w] = u
                        queue.setdefault(w[0], []).append(w)
        return before, ends

    def inner_cuts(self) -> tuple[int, int] | None:
        """The first cut of the chunk and the last one before its end."""
        found = np.flatnonzero(self.cut[self.a : self.b]) + self.a
        return (int(found[0]), int(found[-1])) if len(found) else None

    def transfers(self) -> list[tuple[State, State]]:
        """The finite entries of the chunk's max-plus matrix, all of weight 0."""
        cuts, found = self.inner_cuts(), []
        tail = [(e - self.b, t) for e, t in self.forward((cuts[1], -1), self.b)[1]] if cuts else []
        for reach, token in self.entries():
            node = (self.a + reach, token)
            if cuts is None:
                exits = [(e - self.b, t) for e, t in self.forward(node, self.b)[1]]
            else:
                exits = tail if node[0] <= cuts[0] and any(e == cuts[0] for e, _ in self.forward(node, cuts[0])[1]) else []
            found += [((reach, token), x) for x in exits]
        return found

    def between(self, entry: State, exit_: State, encoder: Encoder) -> list[int]:
        """The pieces after the entry's up to and with the exit's."""
        first, last = (self.a + entry[0], entry[1]), (self.b + exit_[0], exit_[1])
        cuts = self.inner_cuts()
        if cuts is None:
            return self._back(self.forward(first, self.b)[0], last)
        before, ends = self.forward(first, cuts[0])
        head = self._back(before, next(x for x in ends if x[0] == cuts[0]))
        middle = encoder.encode_marked([self.text[cuts[0] : cuts[1]]])[0].tolist() if cuts[1] > cuts[0] else []
        return head + middle + self._back(self.forward((cuts[1], -1), self.b)[0], last)

    def _back(self, before: dict, node) -> list[int]:
        out = []
        while before[node] is not None:
            if node[1] >= 0:
                out.append(node[1])
            else:
                raw = self.text[node[0] - 1].encode("utf-8", "surrogatepass")
                out += [self.v.of_byte[b] for b in reversed(raw)]
            node = before[node]
        return out[::-1]


def combine(one: list[tuple[State, State]], two: list[tuple[State, State]]) -> list[tuple[State, State]]:
    """The product of two transfer matrices."""
    onward: dict[State, list[State]] = {}
    for a, b in two:
        onward.setdefault(a, []).append(b)
    return sorted({(a, c) for a, b in one for c in onward.get(b, ())})


def middle(one: list[tuple[State, State]], two: list[tuple[State, State]], a: State, b: State) -> State:
    """The state between two neighbours on the one finite path from a to b."""
    ends = {y for x, y in one if x == a}
    return next(x for x, y in two if y == b and x in ends)


def chunks_of(text: str, v: Pieces, chunk: int = CHUNK):
    """(left, body, right) of each chunk of a text."""
    marked = MARK + text.replace(" ", MARK)
    for at in range(0, len(marked), chunk):
        yield marked[max(0, at - v.longest) : at], marked[at : at + chunk], marked[at + chunk : at + chunk + v.longest]


def decode(ids, v: Pieces) -> str:
    ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
    parts = list(map(v.plain.__getitem__, ids))
    if None in parts:  # bytes of characters outside ASCII: runs of bytes are read together
        at = 0
        while at < len(ids):
            if parts[at] is None:
                end = at
                while end < len(ids) and ids[end] in v.byte:
                    end += 1
                parts[at:end] = [bytes(v.byte[i] for i in ids[at:end]).decode("utf-8", "replace")] + [""] * (end - at - 1)
                at = end
            else:
                at += 1
    joined = "".join(parts)
    return (joined[1:] if joined.startswith(MARK) else joined).replace(MARK, " ")


STATE = "struct<reach:int,piece:int>"


def _encode_small(path: str, check: bool):
    def run(batches):
        v = pieces(path)
        for batch in batches:
            length = pa.compute.cumulative_sum(pa.compute.add(pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.num_columns - 1)), 0), 1))
            cut = np.searchsorted(length.to_numpy(), np.arange(1, 1 + length[-1].as_py() // SLICE) * SLICE, "right") if len(batch) else []
            bounds = np.unique([0, *cut, len(batch)])
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                part = batch.slice(low, high - low)
                texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
                ids, count = encoder_of(path).encode(texts)
                cuts = np.concatenate([[0], np.cumsum(count)])
                out = [*part.columns[:-1], pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int32)))]
                if check:
                    same = [decode(ids[a:b], v) == t.replace(MARK, " ") for t, a, b in zip(texts, cuts, cuts[1:], strict=False)]
                    out.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays(out, [*batch.schema.names[:-1], "ids", *(["round_trip"] if check else [])])

    return run


def _cut(path: str, chunk: int):
    def run(batches):
        v = pieces(path)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, part in enumerate(chunks_of(text, v, chunk)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key]), pa.array([i], pa.int32()), *[pa.array([x]) for x in part]], ["key", "no", "left", "body", "right"]
                    )

    return run


MATRIX = f"array<struct<a:{STATE},b:{STATE}>>"
_STATE = pa.struct([("reach", pa.int32()), ("piece", pa.int32())])
_MATRIX = pa.list_(pa.struct([("a", _STATE), ("b", _STATE)]))


def _as_rows(m: list[tuple[State, State]]) -> list[dict]:
    return [{"a": {"reach": a[0], "piece": a[1]}, "b": {"reach": b[0], "piece": b[1]}} for a, b in m]


def _as_pairs(rows: list[dict]) -> list[tuple[State, State]]:
    return [((x["a"]["reach"], x["a"]["piece"]), (x["b"]["reach"], x["b"]["piece"])) for x in rows]


def _states(path: str):
    """(key, no, m): the transfer matrix of each chunk."""

    def run(batches):
        v = pieces(path)
        for batch in batches:
            found = [_as_rows(Chunk(v, *x).transfers()) for x in zip(*(batch.column(c).to_pylist() for c in ("left", "body", "right")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("no"), pa.array(found, _MATRIX)], ["key", "no", "m"])

    return run


def _multiplied(batches):
    """(key, no, m, kids): the product of one or two neighbours, which stay beside it."""
    for batch in batches:
        kids = batch.column("kids")
        found = []
        for pair in kids.to_pylist():
            m = [_as_pairs(x["m"]) for x in pair]
            found.append(_as_rows(combine(*m) if len(m) == 2 else m[0]))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("no"), pa.array(found, _MATRIX), kids], ["key", "no", "m", "kids"])


def _chosen(batches):
    """(key, no, a, b) of each whole document: from the start of the text to the state that does not reach past its end."""
    for batch in batches:
        ends = [next(b for a, b in _as_pairs(m) if a == (0, -1) and b[0] == 0) for m in batch.column("m").to_pylist()]
        a = pa.array([{"reach": 0, "piece": -1}] * len(batch), _STATE)
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("no"), a, pa.array([{"reach": r, "piece": p} for r, p in ends], _STATE)], ["key", "no", "a", "b"])


def _handed_down(batches):
    """(key, no, a, b) of the neighbours that a product was made of."""
    state = lambda x: (x["reach"], x["piece"])
    for batch in batches:
        out = []
        for key, a, b, kids in zip(*(batch.column(c).to_pylist() for c in ("key", "a", "b", "kids")), strict=True):
            if len(kids) == 1:
                out.append((key, kids[0]["no"], a, b))
            else:
                reach, piece = middle(_as_pairs(kids[0]["m"]), _as_pairs(kids[1]["m"]), state(a), state(b))
                between = {"reach": reach, "piece": piece}
                out += [(key, kids[0]["no"], a, between), (key, kids[1]["no"], between, b)]
        kinds = (pa.string(), pa.int32(), _STATE, _STATE)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["key", "no", "a", "b"])


def _ends(parts: DataFrame, path: str) -> DataFrame:
    """(key, no, a, b): the states at both ends of every chunk, by products of matrices in rounds of neighbours and back."""
    level = written(parts.mapInArrow(_states(path), f"key string, no int, m {MATRIX}"), "transfers")
    most = level.agg(F.max("no")).first()[0] or 0
    products = []
    for _ in range(int(most).bit_length()):
        pairs = level.groupBy("key", F.expr("no DIV 2").cast("int").alias("no")).agg(F.array_sort(F.collect_list(F.struct("no", "m")), lambda x, y: x["no"] - y["no"]).alias("kids"))
        level = written(pairs.mapInArrow(_multiplied, f"key string, no int, m {MATRIX}, kids array<struct<no:int,m:{MATRIX}>>"), "transfers")
        products.append(level.select("key", "no", "kids"))
    found = level.select("key", "no", "m").mapInArrow(_chosen, f"key string, no int, a {STATE}, b {STATE}")
    for kids in reversed(products):
        found = found.join(kids, ["key", "no"]).mapInArrow(_handed_down, f"key string, no int, a {STATE}, b {STATE}")
    return found


def _backtrace(path: str):
    """(key, no, ids): each chunk's own walk between the states at its ends."""

    def run(batches):
        v = pieces(path)
        encoder = encoder_of(path)
        state = lambda x: (x["reach"], x["piece"])
        for batch in batches:
            found = [
                Chunk(v, *x[:3]).between(state(x[3]), state(x[4]), encoder)
                for x in zip(*(batch.column(c).to_pylist() for c in ("left", "body", "right", "a", "b")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("no"), pa.array(found, pa.list_(pa.int32()))], ["key", "no", "ids"])

    return run


def encode(
    docs: DataFrame, text: str = "text", path: str | None = None, giant: int = GIANT, chunk: int = CHUNK, check: bool = False
) -> DataFrame:
    """Every row with a column ``ids``, array<int>: what SentencePiece's own encoder gives.

    With ``check``, also with ``round_trip``: whether decoding the ids gives the text back, the mark read as a space.
    """
    path = path or model_path()
    added = ["ids", *(["round_trip"] if check else [])]
    others = [c for c in docs.columns if c not in added]
    chunk = max(chunk, 64)  # longer than any piece
    small_batches(docs.sparkSession, BATCH_ROWS)
    rows = docs.select(*[F.col(f"`{c}`") for c in others], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    is_giant = F.length("_text") > giant
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    small = rows.where(~is_giant).mapInArrow(_encode_small(path, check), f"{fields}, ids array<int>" + ", round_trip boolean" * check)
    large = rows.where(is_giant).withColumn("_key", F.sha2("_text", 256))
    distinct = large.groupBy("_key").agg(F.first("_text").alias("text"))
    parts = written(distinct.mapInArrow(_cut(path, chunk), "key string, no int, left string, body string, right string").repartition(F.col("key"), F.col("no")), "chunks")
    if parts.isEmpty():
        return small
    traced = parts.join(_ends(parts, path), ["key", "no"]).mapInArrow(_backtrace(path), "key string, no int, ids array<int>")
    whole = traced.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("no", "ids"))).alias("parts"))
    whole = whole.select(F.col("key").alias("_key"), F.flatten(F.col("parts.ids")).alias("ids"))
    found = large.join(whole, "_key")
    if check:
        found = found.withColumn("round_trip", decoded(path)("ids") == F.replace("_text", F.lit(MARK), F.lit(" ")))
    return small.unionByName(found.select(*others, *added))


def decoded(path: str):
    """A column function: the text of a column of ids."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        v = pieces(path)
        return column.map(lambda ids: None if ids is None else decode(ids, v))

    return run


def op5_sentencepiece(spark, sf_dir):
    """Ids of every document, and whether decoding them gives the text back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, check=True).select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


QUERIES = {"op5_sentencepiece": op5_sentencepiece}
ORACLES: dict[str, str] = {}
