"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

Every text becomes a short vector of statistics. Standardised, they are mapped to random Fourier features, whose
inner products approximate a Gaussian kernel. Partitions sum the normal equations ``Z'Z`` and ``Z'y`` of the labelled
rows; the sums, of a size that depends on the number of features only, are solved with a ridge. Scores of the
labelled rows that were kept apart are counted in steps, and isotonic regression (pool adjacent violators) over the
steps turns scores into probabilities, joined linearly between the middles of its pools.

All labelled rows are used, all statistics cover all rows, and scoring needs no shuffle.

Defined cases: a null text counts as empty, which is a vector like any other; rows without a usable label are scored
only; labels of an id that occurs several times all count; without labelled rows every score is the share of label 1,
1/2 if there is none; repeated rows get equal scores; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytetext as bt
from tidemark.llm.shared import written

FEATURES = 256
GAMMA = 0.06  # of the Gaussian kernel on standardised statistics
RIDGE = 1e-3  # times the number of rows
STEPS = 2000
SLOTS = 16

_KINDS = np.zeros((256, 8), np.float32)
_KINDS[65:91, 0] = 1  # upper case
_KINDS[97:123, 1] = 1  # lower case
_KINDS[48:58, 2] = 1  # digits
for _c in b"#*$%&<>":
    _KINDS[_c, 3] = 1
for _c in b"|":
    _KINDS[_c, 4] = 1
for _c in b"!?":
    _KINDS[_c, 5] = 1
for _c in b".,;:":
    _KINDS[_c, 6] = 1
_KINDS[128:, 7] = 1  # bytes of other alphabets and accents
N_STATISTICS = 8 + 11


def statistics(column) -> np.ndarray:
    """[text, statistic] of a string column."""
    found = []
    for first, end, data, offsets in bt.slices(column):
        rows = end - first
        out = np.zeros((rows, N_STATISTICS))
        size = np.maximum(np.diff(offsets), 1)
        starts, ends, row = bt.word_spans(data, offsets)
        words = np.bincount(row, minlength=rows)
        some = np.maximum(words, 1)
        for k in range(8):
            sums = np.concatenate([[0], np.cumsum(_KINDS[data, k], dtype=np.float64)])
            out[:, k] = np.sqrt((sums[offsets[1:]] - sums[offsets[:-1]]) / size)
        lowered = bt.lower(data)
        hashes = bt.span_hashes(lowered, starts, ends)
        length = (ends - starts).astype(np.float64)
        total = np.bincount(row, weights=length, minlength=rows)
        out[:, 8] = np.log1p(words)
        out[:, 9] = total / some
        out[:, 10] = np.sqrt(np.maximum(np.bincount(row, weights=length**2, minlength=rows) / some - out[:, 9] ** 2, 0))
        out[:, 11] = _distinct(hashes, row, rows) / some
        pairs = bt.mix64(hashes[:-1] + bt.mix64(hashes[1:])) if len(hashes) > 1 else hashes[:0]
        inside = row[:-1] == row[1:] if len(hashes) > 1 else row[:0]
        n_pairs = np.maximum(words - 1, 1)
        out[:, 12] = _distinct(pairs[inside], row[:-1][inside] if len(hashes) > 1 else row[:0], rows) / n_pairs
        fours, four_rows = bt.shingles(hashes, row, rows, 4)
        out[:, 13] = _distinct(fours, four_rows, rows) / np.maximum(np.bincount(four_rows, minlength=rows), 1)
        out[:, 14] = np.bincount(row, weights=length > 12, minlength=rows) / some
        out[:, 15] = np.bincount(row, weights=length <= 2, minlength=rows) / some
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        lines = breaks[offsets[1:]] - breaks[offsets[:-1]] + 1
        out[:, 16] = np.log1p(words / lines)
        upper_first = (data[starts] >= 65) & (data[starts] < 91) if len(starts) else np.zeros(0)
        out[:, 17] = np.bincount(row, weights=upper_first, minlength=rows) / some
        last = data[ends - 1] if len(ends) else data[:0]
        stop = (last == 46) | (last == 33) | (last == 63)
        out[:, 18] = np.bincount(row, weights=stop, minlength=rows) / some
        found.append(out)
    return np.concatenate(found) if found else np.zeros((0, N_STATISTICS))


def _distinct(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return np.bincount(row[fresh], minlength=rows)


def _measure(batches):
    for batch in batches:
        x = statistics(batch.column(2))
        flat = pa.array(x.astype(np.float32).ravel())
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, N_STATISTICS, dtype=np.int32)), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vectors], ["doc_id", "held_out", "x"])


class Model:
    """Random features of standardised statistics, their weights and the calibration."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, gamma: float = GAMMA, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = rng.normal(0, np.sqrt(2 * gamma), (len(mean), features))
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.at, self.value = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        found = np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)
        return np.concatenate([found, np.ones((len(x), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.at, self.value)


def _vectors(batch) -> np.ndarray:
    values = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return values.reshape(-1, N_STATISTICS).astype(np.float64)


def _equations(shared, slots: int):
    """Each partition's sums, dealt to a few slots so that they are added in parallel."""

    def run(batches):
        model, total, n = shared.value, 0.0, 0
        for batch in batches:
            if not len(batch):
                continue
            z = model.features(_vectors(batch))
            y = batch.column("quality").to_numpy(zero_copy_only=False).astype(np.float64)
            total = total + np.concatenate([z.T @ z, (z.T @ y)[:, None]], 1)
            n += len(batch)
        if n:
            slot = int(bt.mix64(np.array([total[0, 0]]).view(np.uint64))[0] % np.uint64(slots))
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "sums"])

    return run


def _add(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x.as_buffer(), np.float64) for x in table.column("sums")], 0)
    return pa.table({"slot": table.column("slot").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def isotonic(at: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools of a rising fit: (weighted middle, value), each value drawn in by half a label of either kind."""
    pools: list[list[float]] = []
    for x, count, good in zip(at, n, ones, strict=True):
        pools.append([x * count, count, good])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    middle = np.array([x / count for x, count, _ in pools])
    value = np.array([(good + 0.5) / (count + 1) for _, count, good in pools])
    return middle, np.maximum.accumulate(value)


def classify(
    docs: DataFrame, labels: DataFrame, held_out: Column, calibrate: Column, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """(doc_id, held_out, score) of every row; ``labels`` is (doc_id, quality).

    Rows that ``held_out`` marks are never learned from; of the others, those that ``calibrate`` marks fit the isotonic
    step and the rest the ridge.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.col(text))
    kind = dict(docs.dtypes)[doc_id]
    vectors = written(rows.mapInArrow(_measure, f"doc_id {kind}, held_out boolean, x array<float>"), "statistics")
    moments = vectors.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    mean, spread = np.zeros(N_STATISTICS), np.ones(N_STATISTICS)
    for k, m, s in moments.collect():  # one row for each statistic
        mean[k], spread[k] = m, s
    model = Model(mean, spread)
    usable = labels.where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("double").alias("quality"))
    known = written(vectors.where("NOT held_out").join(usable, "doc_id").select("x", "quality", F.coalesce(calibrate, F.lit(False)).alias("apart")), "labelled")

    shared = spark.sparkContext.broadcast(model)
    sums = (
        known.where("NOT apart").mapInArrow(_equations(shared, SLOTS), "slot int, sums binary")
        .groupBy("slot").applyInArrow(_add, "slot int, sums binary").collect()  # SLOTS rows at most
    )
    size = FEATURES + 1
    if sums:
        total = np.sum([np.frombuffer(row.sums, np.float64) for row in sums], 0).reshape(size, size + 1)
        n = max(1.0, total[-1, size - 1])
        model.weights = np.linalg.solve(total[:, :size] + max(1.0, RIDGE * n) * np.eye(size), total[:, size])
    scorer = spark.sparkContext.broadcast(model)

    def raw(batches):
        for batch in batches:
            step = np.floor(np.clip(scorer.value.raw(_vectors(batch)), -1, 2) * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(step), batch.column("quality")], ["step", "quality"])

    fold = known.where("apart") if not known.where("apart").isEmpty() else known
    steps = fold.select("x", "quality").mapInArrow(raw, "step int, quality double")
    counted = steps.groupBy("step").agg(F.count("*").alias("n"), F.sum("quality").alias("ones")).orderBy("step").collect()
    if counted:  # 3 * STEPS rows at most
        at, n, ones = (np.array(x, np.float64) for x in zip(*counted, strict=True))
        model.at, model.value = isotonic((at + 0.5) / STEPS, n, ones)
    final = spark.sparkContext.broadcast(model)

    def scored(batches):
        for batch in batches:
            score = pa.array(final.value.score(_vectors(batch)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), score], ["doc_id", "held_out", "score"])

    return vectors.mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double")


def op10_kernel_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    found = classify(docs, labels, fold == 2, fold == 3)
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


QUERIES = {"op10_kernel_quality": op10_kernel_quality}
ORACLES: dict[str, str] = {}
