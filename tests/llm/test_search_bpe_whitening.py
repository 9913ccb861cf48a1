"""Ranked search, BPE by distinct words and whitening against plain versions, with odd rows and empty tables."""

import collections
import hashlib
import math
import os
import random
import re

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bytetext as bt
from tidemark.llm import lexical_search, whitening, word_bpe

DATA = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ODD = [
    (None, None), (None, "null id text here for all to see"), (1, ""), (2, None), (3, "one"), (4, "one"), (5, "word " * 3000),
    (6, "Ünïcode ßtraße 漢字 😀 ▁ mark"), (7, "a b c d a b c d"), (7, "a b c d a b c d"), (8, "it's  we'll\n\n 's <|endoftext|>x's <|endoftext|> "),
    (9, "\x00\x1c\x85  tab\there"), (10, "\n\n \t"), (11, "x" * 5000), (12, "ONE Two one"),
]


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns whose names clash with those that operators make."""
    rows = [(i, t, "k", 5, 1, [1], "b") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, block string, ids long, rank int, docs array<int>, term string")


def plain_search(docs, items, k=50):
    """(item, rank, doc, score) by scoring every document for every item."""
    terms = [TERM.findall(low(t or "")) for _, t in docs]
    n_docs, n_terms = sum(map(bool, terms)), sum(map(len, terms))
    counts = [collections.Counter(t) for t in terms]
    df = collections.Counter(t for c in counts for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        asked, scored = set(TERM.findall(low(text or ""))), []
        for (doc, _), count, own in zip(docs, counts, terms, strict=True):
            score = 0
            for t in asked & set(count):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 50 + (50 * len(own) * n_docs) // n_terms
                score += w * ((1000000000 * count[t]) // (1000 * count[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc is not None, doc))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(map(repr, out))


def found_by(df):
    return sorted(repr((r.item_id, r["rank"], r.doc_id, r.score)) for r in df.collect())


@pytest.mark.parametrize("sizes", [(4_000_000, 1024, 16, 64), (30_000, 40, 3, 2), (5_000, 8, 1, 3)])
def test_search_equals_scoring_everything(spark, odd, monkeypatch, sizes):
    monkeypatch.setattr(lexical_search, "REGION", sizes[2])
    monkeypatch.setattr(lexical_search, "WAVE", sizes[3])
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()][:8] + [(100, None), (101, ""), (102, "zzqq"), (0, "one"), (0, "one")]
    queries = spark.createDataFrame(items, "item_id long, text string")
    run = lambda docs, k: found_by(lexical_search.search(_indexed(docs, sizes), queries, k))
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5) == plain_search(rows, items, 5)
    mixed = spark.createDataFrame([(i, "one two one a b word all", "clash") for i in (3, 4, 5)], "item_id long, text string, doc_id string")
    assert found_by(lexical_search.search(_indexed(odd, sizes), mixed, 3)) == plain_search(ODD, [(i, "one two one a b word all") for i in (3, 4, 5)], 3)


def _indexed(docs, sizes):
    """An index of smaller blocks; they are made in this process, as workers do not see what a test sets."""
    import pyarrow as pa

    table, spark = docs.select("doc_id", "text").toArrow(), docs.sparkSession
    out, n = [], 0
    size = sizes[1]
    for first, end, data, offsets in bt.slices(table.column("text"), sizes[0]):
        for a in range(first, end, size):
            b = min(end, a + size)
            own = offsets[a - first : b - first + 1]
            out.append(lexical_search._block(table.column("doc_id").combine_chunks().slice(a, b - a), bt.lower(data[own[0] : own[-1]]), own - own[0], n))
            n += 1
    return lexical_search.written(spark.createDataFrame(pa.Table.from_batches(out)), "postings")


def test_equal_bounds_are_opened_and_ties_go_to_smaller_ids(spark):
    rows = [(i, "same words here") for i in range(200, 0, -1)] + [(0, "same words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = lexical_search.search(lexical_search.build(docs), spark.createDataFrame([(1, "same words")], "item_id long, text string"), 50)
    assert [(r["rank"], r.doc_id) for r in found.orderBy("rank").collect()] == [(i + 1, i) for i in range(50)]


def test_search_of_string_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "two")], "doc_id string, text string")
    queries = spark.createDataFrame([("q", "one"), (None, "two")], "item_id string, text string")
    assert {(r.item_id, r["rank"], r.doc_id) for r in lexical_search.search(lexical_search.build(docs), queries).collect()} == {
        ("q", 1, "a"), ("q", 2, "b"), (None, 1, None), (None, 2, "a"), (None, 3, "b"),
    }
    assert lexical_search.search(lexical_search.build(docs.limit(0)), queries).collect() == []
    assert lexical_search.search(lexical_search.build(docs), queries.limit(0)).collect() == []


def test_search_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        path = f"{DATA}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    sql = con.sql(lexical_search.SQL).fetchall()
    found = [tuple(r) for r in lexical_search.op11_lexical_search(spark, DATA).collect()]
    assert sorted(found) == sorted(sql) and len(found) > 100


# BPE


def library():
    return Tokenizer.from_file(word_bpe.vocabulary_path())


def plain_words(text, cut):
    out = []
    for part in re.split(r"(<\|endoftext\|>)", text):
        out += [part] if part == "<|endoftext|>" else [part[a:b] for _, (a, b) in cut(part)] if part else []
    return out


def test_words_are_cut_as_the_library_cuts_them():
    import pyarrow as pa

    split, cut, rng = word_bpe.splitter(word_bpe.vocabulary_path()), library().pre_tokenizer.pre_tokenize_str, random.Random(5)
    parts = [*"aasstmdrevelll '''  \n\t!?1290é漢 ́ßĀ😀\u0085 \u001c ½", "<|endoftext|>", "'s", "'re", " 's", "<|end"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(8000)]
    found = [[] for _ in texts]
    for first, _, data, offsets in bt.slices(pa.array(texts), 5_000):
        raw = data.tobytes()
        for a, b, row in zip(*split.words(data, offsets), strict=True):
            found[first + row].append(raw[a:b].decode())
    assert found == [plain_words(t, cut) for t in texts]


def test_a_special_token_is_not_found_across_texts():
    import pyarrow as pa

    split = word_bpe.splitter(word_bpe.vocabulary_path())
    ((_, _, data, offsets),) = bt.slices(pa.array(["a<|endof", "text|>", "", "<|endoftext|>"]))
    starts, ends, rows = split.words(data, offsets)
    raw = data.tobytes()
    assert [(raw[a:b].decode(), r) for a, b, r in zip(starts, ends, rows, strict=True)] == [
        ("a", 0), ("<|", 0), ("endof", 0), ("text", 1), ("|>", 1), ("<|endoftext|>", 3),
    ]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_ids_and_texts_equal_the_library(spark, odd, which):
    table = spark.read.parquet(f"{DATA}/documents.parquet") if which == "docs" else odd
    rows, t = [(r.doc_id, r.text or "") for r in table.collect()], library()
    encoded = word_bpe.encode(table)
    assert set(encoded.columns) == (set(table.columns) - {"text"}) | {"ids", "decoded"}
    ids = [e.ids for e in t.encode_batch([x for _, x in rows], add_special_tokens=False)]
    expected = sorted(repr((i, x, t.decode(x, skip_special_tokens=False))) for (i, _), x in zip(rows, ids, strict=True))
    assert sorted(repr((r.doc_id, list(r.ids), r.decoded)) for r in encoded.collect()) == expected


def test_decoding_ids_from_anywhere(spark):
    rng, t = random.Random(7), library()
    lists = [[rng.randrange(50257) for _ in range(rng.randrange(12))] for _ in range(300)] + [[50256, 50256], [1, 10**6, 2], []]
    rows = [(i, x, "clash") for i, x in enumerate(lists)] + [(None, None, "clash"), (0, lists[0], "clash")]
    found = word_bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>, decoded string")).collect()
    assert sorted(repr((r.doc_id, r.decoded)) for r in found) == sorted(repr((i, None if x is None else t.decode(x, skip_special_tokens=False))) for i, x, _ in rows)


def test_bpe_query_digests(spark):
    t = library()
    for r in word_bpe.op12_word_bpe(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id").collect():
        ids = t.encode(r.text, add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))


def test_bpe_of_empty_tables(spark, odd):
    assert word_bpe.encode(odd.limit(0)).collect() == []
    assert word_bpe.decode(spark.createDataFrame([], "ids array<int>")).collect() == []


# whitening


def plain_whitening(rows, k=16):
    usable = [(i, [math.floor(64 * float(c)) + 1000000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in usable}))
    n, s = len(fit), fit.sum(0)
    y = (n * fit - s) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in usable:
        d = n * np.array(x) - s
        out.setdefault(i, []).append((int((d**2).sum()), d / n @ vectors[:, :k] / np.sqrt(values[:k])))
    return n, out, values[:k] / values.sum()


def test_whitening_equals_the_plain_version(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    rows += [(-1, None), (-2, []), (-3, [None] * len(rows[0][1])), (-4, [float("nan")] * len(rows[0][1])), (-5, [float("inf")] + rows[0][1][1:]), (-6, [1.0]), (-7, rows[3][1]), (None, rows[4][1]), (-7, rows[3][1])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, x string")
    n, expected, share = plain_whitening([r for r in rows if r[0] != -6])
    found = collections.defaultdict(list)
    for r in whitening.whiten(table).collect():
        found[r.vec_id].append(r)
        assert r.n == n and r.identity_error < 1e-9 and abs(r.explained / share[r.component - 1] - 1) < 1e-6
    assert set(found) == set(expected)
    sign = None
    for i, group in found.items():
        own = sorted((r.component, r.whitened, r.deviation) for r in group)
        assert len(own) == 16 * len(expected[i]) and {x[2] for x in own} == {d for d, _ in expected[i]}
        mine = np.array([[w for c, w, _ in own if c == k][0] for k in range(1, 17)])
        plain = expected[i][0][1]
        sign = np.sign(mine * plain) if sign is None else sign
        assert np.allclose(mine, sign * plain, atol=1e-6)


def test_whitening_without_variance_and_of_empty_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [3.0, 2.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, r.n, round(abs(r.whitened), 9), r.explained) for r in flat) == [(1, 1, 2, 1.0, 1.0), (2, 1, 2, 1.0, 1.0), (3, 1, 2, 1.0, 1.0)]
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 2.0]), (2, [-1e300, 3.0]), (3, [0.5, 9.0])], schema)).collect()
    assert {r.deviation for r in huge if r.vec_id != 3} == {None} and all(r.identity_error < 1e-4 for r in huge if r.component == 1)


def test_deviations_are_exact_beyond_what_fits_64_bits():
    x = np.array([[2**61, 5], [1, 7]])
    sums = [2**61 + 1, 12]
    y = whitening.exact(x, 2, sums)
    assert y.tolist() == [[2**61 - 1, -2], [1 - 2**61, 2]]
    assert whitening.squares(y) == [None, None] and whitening.squares(np.array([[3, 4]])) == [25]
