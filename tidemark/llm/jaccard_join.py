"""N-gram Jaccard join by universe-partition pigeonhole.

A document is the set of its distinct word shingles (64-bit hashes). Sizes fall into bands so that partners lie in
the same band or in neighbours. For a band whose largest size is ``hi``, linked sets differ in at most
``H = (1 - t) / (1 + t) * 2 * hi`` shingles, so of ``m = H + 1 + spare`` equal ranges of the hash universe at least
``spare + 1`` hold the same shingles in both sets.

Allocation by cost: an empty range says nothing and would be a hot key, so it is skipped. A set with at most
``spare`` empty ranges still must share a non-empty one. Sets with more of them (rare: ``spare`` is more than sets of the
band's sizes leave empty as a rule) are indexed with the one-deletion neighbourhoods of their ranges as well. Two such
sets without a common key differ by one shingle at least in each range that one of them has and by two in each that
both have, so together they use no more than H ranges, and all but H shingles of either lie in its H / 2 fullest ranges: sets
so concentrated are indexed by each shingle, too.

The sets that share a key form a group; groups with the same members are one. From groups to links:

1. Count: a linked set shares at least ``spare + 1 - (its empty ranges)`` keys of a band with its partner, so a set that
   shares fewer with all sets together leaves the groups of that band. Passages that many documents share do not
   reach this number; copies do.
2. Stars: the member of a group that shares the most keys is its pivot. Copies of one text have the same pivot in
   almost all of their groups, so the distinct (pivot, member) pairs are few: they are compared exactly, and links
   give first classes. All pairs of a pivot in its group are settled by that, and it leaves the group.
3. Rest: a group whose remaining members are of two classes or more has pairs that are neither linked nor settled. Only
   pairs across classes matter: members outside the largest class meet all members, first on parity sketches (the
   number of differing bits never exceeds the number of differing shingles, so only pairs that cannot be linked
   fall), then on the shingle sets.

Units of comparison hold ``BLOCK`` documents a side. A group of n copies moves n sets; sets are moved more than once only
where more than BLOCK members of a group stand outside its largest class. Only spanning pairs (u, v) of what is connected
leave a task, never all pairs of a key or of a group of copies. Equal sets are one class from the start.

Defined cases: a null text counts as empty; a document without words has no shingles, is linked with nothing and is
its own component; a document with fewer words than ``width`` has its whole sequence as one shingle; repeated rows
are documents of their own and linked if they have words; a null id stays null (its component is the smallest other
id, if any); ids keep their type, whose order says which is smallest; other columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytetext as bt
from tidemark.llm.shared import blocks_for, components, written

SPARE_STEP = 8  # one more spare range for so many differences
BLOCK = 512  # documents of a large candidate group that are verified together
BLOOM_BITS = (16, 30)  # fewest and most bits of a bit set, as powers of 2
HELD = 400_000  # index entries that a task keeps before it hands them over
SLICE_BYTES = 1_000_000  # of text whose shingles are worked out together
SKETCHED = 300_000  # shingles that are sketched together


def document_sets(column, width: int):
    """Yields (first row, counts, sorted distinct shingles, their row) for slices of a text column."""
    for first, end, data, offsets in bt.slices(column, SLICE_BYTES):
        data = bt.lower(data)
        starts, ends, rows = bt.word_spans(data, offsets)
        shingle, rows = bt.shingles(bt.span_hashes(data, starts, ends), rows, end - first, width)
        order = np.lexsort((shingle, rows))
        shingle, rows = shingle[order], rows[order]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (shingle[1:] != shingle[:-1]) | (rows[1:] != rows[:-1])
        shingle, rows = shingle[fresh], rows[fresh]
        yield first, np.bincount(rows, minlength=end - first), shingle, rows


def set_ids(counts: np.ndarray, shingle: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set, 0 for the empty set."""
    sums = np.zeros(len(shingle) + 1, np.uint64)
    np.cumsum(bt.mix64(shingle), out=sums[1:])
    ends = np.cumsum(counts)
    ids = bt.mix64(sums[ends] - sums[ends - counts] + counts.astype(np.uint64)) >> np.uint64(1)
    return np.where(counts > 0, np.maximum(ids, np.uint64(1)), np.uint64(0)).astype(np.int64)


def bands(largest: int, percent: int) -> np.ndarray:
    """Upper ends of the size bands: a set's partners of at least its size are in its band or the next."""
    found, low = [0], 1
    while low <= largest or len(found) < 3:
        found.append(low * 100 // percent)
        low = found[-1] + 1
    return np.array([*found, low * 100 // percent])


def _family(counts: np.ndarray, shingle: np.ndarray, rows: np.ndarray, percent: int, step: int):
    """(band, most differences, spare, ranges, range of each shingle, first shingle of each range in use, its row, empty ranges)."""
    tops = bands(int(counts.max(initial=1)), percent)
    band = np.searchsorted(tops, counts) + step
    most = (100 - percent) * 2 * tops[band] // (100 + percent)
    spare = 1 + most // SPARE_STEP
    m = most + 1 + spare
    at = ((shingle >> np.uint64(32)) * m[rows].astype(np.uint64)) >> np.uint64(32)
    edge = np.ones(len(rows), bool)
    edge[1:] = (rows[1:] != rows[:-1]) | (at[1:] != at[:-1])
    first = np.flatnonzero(edge)
    return band, most, spare, m, at, first, rows[first], m - np.bincount(rows[first], minlength=len(counts))


def fewest_shared(counts: np.ndarray, shingle: np.ndarray, rows: np.ndarray, percent: int) -> np.ndarray:
    """[parity of the band, set]: how many keys of the band a set shares at least with any set it is linked with."""
    found = np.ones((2, len(counts)), np.int32)
    for step in (0, 1):
        band, _, spare, _, _, _, _, empty = _family(counts, shingle, rows, percent, step)
        found[band & 1, np.arange(len(counts))] = np.maximum(spare + 1 - empty, 1)
    return found


def segment_keys(counts: np.ndarray, shingle: np.ndarray, rows: np.ndarray, percent: int):
    """(key, row) of the index entries of every set, in its own band and as a smaller partner in the next one.

    The lowest bit of a key is that of its band.
    """
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    token = bt.mix64(shingle ^ np.uint64(0x5DEECE66D))
    for step in (0, 1):
        band, most, spare, m, at, first, owner, empty = _family(counts, shingle, rows, percent, step)
        if not len(first):
            continue
        size = np.diff(np.append(first, len(rows)))
        name = bt.mix64(at[first] + (band[owner].astype(np.uint64) << np.uint64(40)))
        total = np.add.reduceat(token, first)
        some = most[owner] > 0  # sets that may not differ at all are equal, and equal sets are one
        found, of_row = [bt.mix64(total ^ name)[some]], [owner[some]]
        rare = (empty > spare) & (counts > 0) & (most > 0)
        if rare.any():
            of = np.repeat(np.arange(len(first)), size)
            pick = rare[rows] & (size[of] > 1)
            found.append(bt.mix64((total[of[pick]] - token[pick]) ^ name[of[pick]]))
            of_row.append(rows[pick])
            for row in np.flatnonzero(rare & (m - empty < most)):
                a, b = np.searchsorted(owner, (row, row + 1))
                if np.sort(size[a:b])[::-1][: most[row] // 2].sum() >= counts[row] - most[row]:
                    mine = slice(first[a], first[a] + counts[row])
                    found.append(bt.mix64(token[mine] ^ np.uint64(int(band[row]) << 40 | 1 << 39)))
                    of_row.append(rows[mine])
        found, of_row = np.concatenate(found), np.concatenate(of_row)
        keys.append((found & ~np.uint64(1)) | (band[of_row] & 1).astype(np.uint64))
        owners.append(of_row)
    return np.concatenate(keys), np.concatenate(owners)


def sketches(counts: np.ndarray, shingle: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """Parity bits of each set: 2**k of them, at least two a shingle; halves folded by XOR give the next smaller size."""
    bits = 1 << np.ceil(np.log2(np.maximum(2 * counts, 64))).astype(np.int64)
    starts = np.cumsum(bits) - bits
    at = (bt.mix64(shingle + np.uint64(0x2545F491)) & (bits[rows] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(starts[rows] + at, minlength=int(bits.sum())) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [packed[a // 8 : (a + n) // 8] for a, n in zip(starts, bits, strict=True)]


def _infos(width: int, percent: int):
    def run(batches):
        for batch in batches:
            for first, counts, shingle, rows in document_sets(batch.column(1), width):
                ids = batch.column(0).slice(first, len(counts))
                even, odd = fewest_shared(counts, shingle, rows, percent)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(counts, pa.int64()), pa.array(set_ids(counts, shingle)), pa.array(even), pa.array(odd)],
                    ["id", "n", "sid", "even", "odd"],
                )

    return run


def _index(width: int, percent: int, buckets: int):
    """Rows (bucket, keys, sids): the entries of many documents for one range of keys, packed as arrays."""

    def pack(keys, sids):
        keys, sids = np.concatenate(keys), np.concatenate(sids)
        order = np.lexsort((sids, keys))
        keys, sids = keys[order], sids[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1])
        keys, sids = keys[fresh], sids[fresh]
        bucket, at = np.unique(((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), return_index=True)
        cut = pa.array(np.append(at, len(keys)).astype(np.int32))
        array = lambda x: pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), array(keys), array(sids)], ["bucket", "keys", "sids"])

    def run(batches):
        keys, sids, seen, held = [], [], np.zeros(0, np.int64), 0
        for batch in batches:
            for _, counts, shingle, rows in document_sets(batch.column(0), width):
                ids = set_ids(counts, shingle)
                _, fresh = np.unique(ids, return_index=True)
                use = np.zeros(len(ids), bool)
                use[fresh] = True
                use &= ~np.isin(ids, seen) & (ids != 0)
                seen = np.union1d(seen, ids)
                mine = use[rows]
                key, owner = segment_keys(np.where(use, counts, 0), shingle[mine], rows[mine], percent)
                keys.append(key)
                sids.append(ids[owner])
                held += len(key)
                if held > HELD:
                    yield pack(keys, sids)
                    keys, sids, held = [], [], 0
        if held:
            yield pack(keys, sids)

    return run


def _groups(table: pa.Table) -> pa.Table:
    """(gid, sid, keys) of every key with two distinct sets or more; keys of a band with the same members are one group.

    The lowest bit of a group's id is that of its band; ``keys`` is how many keys the group stands for.
    """
    flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    keys, sids = flat("keys"), flat("sids")
    order = np.lexsort((sids, keys))
    keys, sids = keys[order], sids[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1])
    keys, sids = keys[fresh], sids[fresh]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(keys)))
    start, size = start[size > 1], size[size > 1]
    sums = np.zeros(len(sids) + 1, np.uint64)
    np.cumsum(bt.mix64(sids.view(np.uint64)), out=sums[1:])
    name = bt.mix64(sums[start + size] - sums[start] + size.astype(np.uint64)) & ~np.uint64(1)
    gid, at, many = np.unique(name | (keys[start].view(np.uint64) & np.uint64(1)), return_index=True, return_counts=True)
    start, size = start[at], size[at]
    ends = np.cumsum(size)
    members = sids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]
    return pa.table({"gid": pa.array(np.repeat(gid.view(np.int64), size)), "sid": pa.array(members), "keys": pa.array(np.repeat(many, size).astype(np.int64))})


def bloom(ids: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """(k, a bit set of 2**k bits), about 16 bits a row, 128 MB at most: it only saves work, exact joins follow."""
    k = min(max(BLOOM_BITS[0], 4 + int(ids.count()).bit_length()), BLOOM_BITS[1])
    h = F.xxhash64(column)
    rows = ids.select(F.shiftrightunsigned(h, 64 - k + 6).alias("w"), h.bitwiseAND(63).cast("int").alias("b"))
    found = rows.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits")).toPandas()
    bits = np.zeros(1 << (k - 6), np.int64)
    bits[found["w"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return k, bits


def _in_bloom(shared: tuple[int, np.ndarray], h: np.ndarray) -> np.ndarray:
    k, bits = shared
    return (bits[(h.view(np.uint64) >> np.uint64(64 - k + 6)).astype(np.int64)] >> (h & 63)) & 1 == 1


def _wanted_sets(width: int, bits):
    def run(batches):
        seen = np.zeros(0, np.int64)
        for batch in batches:
            h = batch.column(1).to_numpy(zero_copy_only=False)
            texts = batch.column(0).filter(pa.array(_in_bloom(bits.value, h)))
            for _, counts, shingle, _ in document_sets(texts, width):
                ids = set_ids(counts, shingle)
                ends = np.cumsum(counts)
                _, fresh = np.unique(ids, return_index=True)
                fresh = fresh[~np.isin(ids[fresh], seen) & (ids[fresh] != 0)]
                seen = np.union1d(seen, ids[fresh])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[fresh]), pa.array(counts[fresh], pa.int64()), pa.array([shingle[ends[i] - counts[i] : ends[i]].tobytes() for i in fresh], pa.binary())],
                    ["sid", "n", "payload"],
                )

    return run


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share."""
    token = np.concatenate(sets)
    _, column, many = np.unique(token, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = many[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common, width = np.zeros((len(sets), len(sets)), np.int64), 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        part = np.zeros((len(sets), min(width, int(column[-1]) + 1 - low)), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        common += (part @ part.T).astype(np.int64)  # at most 4096 each, exact
    return common


def _linked_exactly(n: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    common = _common(sets)
    return 100 * common >= percent * (n[:, None] + n[None, :] - common)


def _linked_bytes(n: np.ndarray, payload: list[bytes], percent: int) -> np.ndarray:
    return _linked_exactly(n, [np.frombuffer(x, np.uint64) for x in payload], percent)


def _may_be_linked(n: np.ndarray, payload: list[bytes], percent: int) -> np.ndarray:
    """False only for pairs whose sizes or sketches rule a link out."""
    both = n[:, None] + n[None, :]
    may = 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
    length = np.array([len(x) for x in payload])
    for size in np.unique(length):
        rows = np.flatnonzero((length == size) | (length == 2 * size))
        if len(rows) < 2:
            continue
        halves = [np.frombuffer(payload[i], np.uint8) for i in rows]
        folded = np.stack([x if len(x) == size else x[:size] ^ x[size:] for x in halves])
        signs = np.unpackbits(folded, axis=1).astype(np.float32) * 2 - 1
        differing = (8 * size - signs @ signs.T) / 2
        inside = np.ix_(rows, rows)
        # sizes more than twice apart never meet here, and their sizes have ruled them out
        may[inside] &= (100 + percent) * differing <= (100 - percent) * both[inside]
    return may


def _connected(linked: np.ndarray) -> np.ndarray:
    """The smallest row that each row is connected to."""
    label = np.arange(len(linked))
    while True:
        new = np.where(linked, label[None, :], len(linked)).min(1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _units(table: pa.Table, *keys: str):
    """(table sorted by the keys and sid, the bounds of each unit with two rows or more)."""
    table = table.sort_by([(k, "ascending") for k in (*keys, "sid")])
    edge = np.ones(len(table) + 1, bool)
    edge[1:-1] = np.any([np.diff(table.column(k).to_numpy()) != 0 for k in keys], axis=0)
    cuts = np.flatnonzero(edge)
    return table, [(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if b - a > 1]


def _pairs(us: list, vs: list) -> pa.Table:
    none = np.zeros(0, np.int64)
    return pa.table({"u": pa.array(np.concatenate([none, *us])), "v": pa.array(np.concatenate([none, *vs]))})


def _with_pivot(n: np.ndarray, sets: list[np.ndarray], pivot: int, percent: int) -> np.ndarray:
    """Whether each set is linked with the pivot's."""
    centre = sets[pivot]
    token = np.concatenate(sets)
    hit = centre[np.minimum(np.searchsorted(centre, token), len(centre) - 1)] == token
    common = np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *map(len, sets[:-1])]))
    return 100 * common >= percent * (n + n[pivot] - common)


def _verify_stars(percent: int):
    def run(table: pa.Table) -> pa.Table:
        table, units = _units(table, "star", "block")
        star, sid, n = (table.column(c).to_numpy() for c in ("star", "sid", "n"))
        payload, us, vs = table.column("payload").combine_chunks(), [], []
        for a, b in units:
            size, mine = n[a:b].astype(np.int64), sid[a:b]
            sets = [np.frombuffer(x, np.uint64) for x in payload[a:b].to_pylist()]
            linked = _with_pivot(size, sets, int(np.flatnonzero(mine == star[a])[0]), percent)
            us.append(np.full(linked.sum(), star[a]))
            vs.append(mine[linked])
            if (~linked).sum() > 1:  # members that are not linked with the pivot may be linked with one another
                low = _connected(_linked_exactly(size, sets, percent))
                us.append(mine[low])
                vs.append(mine)
        return _pairs(us, vs)

    return run


def _stars(pivots: DataFrame, sets: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Linked pairs (u, v) from distinct (pivot, sid) pairs; large stars are cut, and each part has the pivot."""
    sizes = pivots.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    of_star = pivots.join(sizes, "pivot").select(F.col("pivot").alias("star"), F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int").alias("block"), "sid")
    centres = sizes.select(F.col("pivot").alias("star"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("pivot").alias("sid"))
    dealt = of_star.unionByName(centres).join(sets, "sid").withColumn("task", F.pmod(F.xxhash64("star", "block"), F.lit(tasks)))
    return dealt.groupBy("task").applyInArrow(_verify_stars(percent), "u long, v long")


def _verify(test, percent: int):
    def run(table: pa.Table) -> pa.Table:
        table, units = _units(table, "gid", "p", "q")
        sid, n, label = (table.column(c).to_numpy() for c in ("sid", "n", "label"))
        payload, us, vs = table.column("payload").combine_chunks(), [], []
        for a, b in units:
            same = label[a:b, None] == label[None, a:b]
            if not same.all():
                low = _connected(same | test(n[a:b].astype(np.int64), payload[a:b].to_pylist(), percent))
                us.append(sid[a:b][low])
                vs.append(sid[a:b])
        return _pairs(us, vs)

    return run


def _compare(members: DataFrame, payloads: DataFrame, test, percent: int, tasks: int) -> DataFrame:
    """Connected pairs (u, v) across the classes of each group; ``members`` is (gid, sid, label), ``payloads`` (sid, n, payload).

    Members outside the group's largest class (the rest) meet all members. Both sides are cut into blocks, and each two
    blocks are one unit; a group of one block is one unit.
    """
    counted = members.groupBy("gid", "label").agg(F.count("*").alias("many"))
    largest = counted.groupBy("gid").agg(F.max(F.struct("many", "label")).alias("top"), F.sum("many").alias("size"))
    blocks = lambda size: F.greatest(F.ceil(size / BLOCK), F.lit(1)).cast("int")
    shape = largest.select("gid", F.col("top.label").alias("top"), blocks(F.col("size")).alias("ps"), blocks(F.col("size") - F.col("top.many")).alias("qs"))
    each = lambda many: F.sequence(F.lit(0), many - 1)
    p, q = F.pmod(F.xxhash64("sid"), F.col("ps")).cast("int"), F.pmod(F.xxhash64("sid", F.lit(1)), F.col("qs")).cast("int")
    as_member = F.transform(each(F.col("qs")), lambda i: F.struct(p.alias("p"), i.alias("q")))
    as_rest = F.transform(each(F.col("ps")), lambda i: F.struct(i.alias("p"), q.alias("q")))
    units = F.when((F.col("label") == F.col("top")) | (F.col("ps") == 1), as_member).otherwise(F.array_union(as_member, as_rest))
    placed = members.join(shape, "gid").select("gid", "sid", "label", F.explode(units).alias("unit")).select("gid", "unit.*", "sid", "label")
    dealt = placed.join(payloads, "sid").withColumn("task", F.pmod(F.xxhash64("gid", "p", "q"), F.lit(tasks)))
    return dealt.groupBy("task").applyInArrow(_verify(test, percent), "u long, v long")


def _sketch_payloads(batches):
    for batch in batches:
        sizes = np.cumsum(batch.column("n").to_numpy())
        cuts = np.unique(np.searchsorted(sizes, np.arange(0, sizes[-1] if len(sizes) else 0, SKETCHED)))  # some shingles at a time
        for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(sizes)], strict=True):
            part = batch.slice(low, high - low)
            n = part.column("n").to_numpy()
            shingle = np.concatenate([np.frombuffer(x, np.uint64) for x in part.column("payload").to_pylist()])
            found = sketches(n, shingle, np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([part.column("sid"), part.column("n"), pa.array(found, pa.binary())], ["sid", "n", "payload"])


def _classes(docs: DataFrame, text: str, doc_id: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, sid, ...) of every row, and (sid, smallest id, root) of every set that is not empty."""
    spark = docs.sparkSession
    buckets = blocks_for(docs, text)
    tasks = 4 * buckets
    narrow = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    infos = written(narrow.mapInArrow(_infos(width, percent), f"id {dict(narrow.dtypes)['id']}, n long, sid long, even int, odd int"), "infos")
    one = infos.where("sid <> 0").groupBy("sid").agg(F.min("id").alias("id"), F.first("even").alias("even"), F.first("odd").alias("odd"))
    index = narrow.select("text").mapInArrow(_index(width, percent, buckets), "bucket int, keys array<bigint>, sids array<bigint>")
    found = written(index.groupBy("bucket").applyInArrow(_groups, "gid long, sid long, keys long"), "groups")

    # 1. sets that share enough keys of a band
    odd = (F.col("gid").bitwiseAND(1) == 1).alias("is_odd")
    shared = found.groupBy("sid", odd).agg(F.sum("keys").alias("shared")).join(one, "sid")
    enough = shared.where("shared >= IF(is_odd, odd, even)").select("sid", "is_odd", "shared")
    groups = written(found.select("gid", "sid", odd).distinct().join(enough, ["sid", "is_odd"]).select("gid", "sid", "shared"), "members")

    # the shingles of one document for each set of a group
    chosen = one.select("sid", "id").join(groups.select("sid").distinct(), "sid", "left_semi")
    bits = spark.sparkContext.broadcast(bloom(chosen.select("id"), "id"))
    sets = narrow.select("text", F.xxhash64("id")).mapInArrow(_wanted_sets(width, bits), "sid long, n long, payload binary")
    sets = written(sets.join(groups.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.first("n").alias("n"), F.first("payload").alias("payload")), "sets")

    # 2. stars
    pivots = groups.groupBy("gid").agg(F.max(F.struct("shared", "sid")).alias("top"), F.count("*").alias("size")).where("size > 1")
    placed = written(groups.join(pivots.select("gid", F.col("top.sid").alias("pivot")), "gid").where("sid <> pivot").select("gid", "sid", "pivot"), "placed")
    links = written(_stars(placed.select("pivot", "sid").distinct(), sets, percent, tasks).where("u <> v").distinct(), "links")
    linked = written(components(links).select(F.col("node").alias("sid"), F.col("root").alias("label")), "linked")

    # 3. groups whose remaining members are of several classes
    labelled = placed.select("gid", "sid").join(linked, "sid", "left").select("gid", "sid", F.coalesce("label", "sid").alias("label"))
    several = labelled.groupBy("gid").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("gid")
    rest = written(labelled.join(several, "gid", "left_semi"), "rest")
    root = F.coalesce("label", "sid")
    if not rest.isEmpty():
        small = sets.join(rest.select("sid").distinct(), "sid", "left_semi").mapInArrow(_sketch_payloads, "sid long, n long, payload binary")
        maybe = components(_compare(rest, small, _may_be_linked, percent, tasks))
        near = maybe.select(F.col("node").alias("sid"), F.col("root").alias("gid")).join(rest.select("sid", "label").distinct(), "sid")
        more = _compare(written(near, "near"), sets, _linked_bytes, percent, tasks)
        for end in ("u", "v"):  # links between classes
            more = more.join(linked.withColumnRenamed("sid", end), end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
        joined = written(components(more).select(F.col("node").alias("joined"), F.col("root").alias("top")), "joined")
        classes = one.select("sid", "id").join(linked, "sid", "left").withColumn("joined", root).join(joined, "joined", "left")
        return infos, written(classes.select("sid", "id", F.coalesce("top", "joined").alias("root")), "classes")
    return infos, written(one.select("sid", "id").join(linked, "sid", "left").select("sid", "id", root.alias("root")), "classes")


def join_components(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, percent: int = 85
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; links are pairs with 100 * common >= percent * united."""
    infos, firsts = _classes(docs, text, doc_id, width, percent)
    lowest = firsts.groupBy("root").agg(F.min("id").alias("component_id"))
    of_set = firsts.join(lowest, "root").select("sid", "component_id")
    # rows of the empty set take part in no join: they would be one hot key
    found = infos.where("sid <> 0").join(of_set, "sid").select("id", "n", "component_id")
    empty = infos.where("sid = 0").select("id", "n", F.col("id").alias("component_id"))
    return found.unionByName(empty).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, in the input's own columns; rows without words are copies of nothing and stay.

    It is the row with the smallest id, null ids last; among rows of that id the one with the smallest set id; among rows
    equal in both, the one with the smallest text. So a row is judged by its own text, not by other rows of its id.

    A bit set of the ids that go lets most texts stay where they are; only those that it may mean are joined.
    """
    infos, firsts = _classes(docs, text, doc_id, width, percent)
    first = firsts.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sid")).alias("first"))
    firsts = firsts.select("sid", "root").join(first, "root").select("sid", F.col("first.id").alias("first_id"), F.col("first.sid").alias("first_sid"))
    stays = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("sid") == F.col("first_sid"))
    # rows that are no first, and firsts that are there more than once
    counted = infos.where("sid <> 0").select("id", "sid").join(firsts, "sid").groupBy("id", "sid").agg(F.first(stays).alias("_one"), F.count("*").alias("n"))
    marks = written(counted.where("NOT _one OR n > 1").select(F.col("id").alias("_id"), F.col("sid").alias("_of"), "_one"), "marks")
    bits = docs.sparkSession.sparkContext.broadcast(bloom(marks, "_id"))

    def rows_that(may_be_meant: bool):
        """The rows that some mark may mean, each with its set id, or the others."""

        def run(batches):
            for batch in batches:
                maybe = _in_bloom(bits.value, batch.column("_hash").to_numpy(zero_copy_only=False))
                part = batch.filter(pa.array(maybe == may_be_meant))
                texts = part.column("_text") if may_be_meant else pa.nulls(0, pa.string())
                found = [set_ids(counts, shingle) for _, counts, shingle, _ in document_sets(texts, width)]
                own = pa.array(np.concatenate([np.zeros(0, np.int64), *found])) if may_be_meant else pa.nulls(len(part), pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("_row", "_text", "_key")), own], ["_row", "_text", "_key", "_own"])

        kind = {c: t for c, t in rows.dtypes}
        return rows.mapInArrow(run, f"_row {kind['_row']}, _text string, _key {kind['_key']}, _own long")

    own_id = F.col(doc_id)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).cast("string").alias("_text"), own_id.alias("_key"), F.xxhash64(own_id).alias("_hash"))
    meant = rows_that(True)
    same = F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_of"))
    stay = rows_that(False).select("_row.*").unionByName(meant.join(marks, same, "left_anti").select("_row.*"))
    repeated = marks.where("_one")
    if not repeated.isEmpty():
        row = F.min_by("_row", "_text").alias("row")
        stay = stay.unionByName(meant.join(repeated, same).groupBy("_id", "_own").agg(row).select("row.*"))
    return stay


def op8_jaccard_join(spark, sf_dir):
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_jaccard_join": op8_jaccard_join}
ORACLES: dict[str, str] = {}
