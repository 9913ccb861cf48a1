"""Operators against plain versions on small tables, with nulls, empty and repeated rows."""

import collections
import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pytest

from tidemark.llm import (
    context_tree, fingerprints, html_blocks, jaccard_join, kernel_quality, licenses, mixing, pii, quality_rules, sentencepiece_scan,
)

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


ODD = [
    (None, None, None), (None, "null id text here for all to see", "b"), (1, "", "a"), (2, None, "a"), (3, "one", "a"), (4, "one", "a"),
    (5, "word " * 3000, "a"), (6, "Ünïcode ßtraße 漢字 😀 ▁ mark", "c"), (7, "a b c d e f g h\na b c d e f g h", None), (7, "a b c d e f g h\na b c d e f g h", None),
    (8, "Mail me@x.org, 10.0.0.1, +1 (555) 123-4567 or 4111 1111 1111 1111. token = \"a1b2c3d4e5f6a7b8c9d0\"", "b"),
    (9, "Released under the MIT License.", "b"), (10, "\n\n \t", "b"), (11, "x" * 5000, "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns whose names clash with those that operators make."""
    rows = [(i, t, s, "en", 1, "k") for i, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, block string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def rows_of(docs):
    return [(r.doc_id, r.text or "", r.source) for r in docs.collect()]


def shingle_sets(texts, width):
    out = []
    for t in texts:
        w = WORD.findall(low(t))
        out.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    return out


def plain_components(ids, sets, percent):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(ids)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    return {i: min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))}


@pytest.mark.parametrize("which,width,percent", [("docs", 4, 85), ("docs", 5, 80), ("odd", 4, 85)])
def test_join_finds_exactly_the_linked_components(which, width, percent, request):
    table = request.getfixturevalue(which)
    rows = rows_of(table)
    sets = shingle_sets([t for _, t, _ in rows], width)
    expected = plain_components([i for i, _, _ in rows], sets, percent)
    wanted = sorted((str(rows[i][0]), len(sets[i]), str(expected[i])) for i in range(len(rows)))
    found = jaccard_join.join_components(table, width=width, percent=percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == wanted


def test_join_of_near_copies_of_all_sizes(spark):
    rng = np.random.default_rng(3)
    texts = []
    for size in [*range(4, 60), 90, 150, 400, 900]:
        words = [f"w{x}" for x in rng.integers(0, 10**6, size)]
        for edits in (0, 1, 2, max(1, size // 50), max(1, size // 30)):
            copy = list(words)
            for at in rng.integers(0, size, edits):
                copy[at] = f"e{rng.integers(0, 10**6)}"
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = plain_components(list(range(len(texts))), shingle_sets(texts, 4), 85)
    found = {r.doc_id: r.component_id for r in jaccard_join.join_components(df).collect()}
    assert found == {i: expected[i] for i in range(len(texts))}


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[:k] + [f"x{k}"] + words[k + 1 :]) for k in range(0, 200, 5)]  # any two differ in two words
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in jaccard_join.join_components(df).collect()} == {0}


def test_one_row_of_each_component_stays(spark, odd):
    words = " ".join(f"w{i}" for i in range(300))
    near = words.replace("w150 ", "other ")
    rows = [(1, words), (1, words), (2, near), (2, "a text of its own that no other row has"), (None, words), (None, "only a null id has this text"),
            (None, "only a null id has this text"), (3, "one id and two texts with the same words"), (3, "one  id and two texts with the same words"), (4, ""), (4, "")]
    found = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in found) == sorted(
        (str(i), t) for i, t in [(1, words), rows[3], rows[5], min(rows[7:9], key=lambda x: x[1]), *rows[9:]]
    )
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns
    wanted = [i for i, t, _ in ODD if not (t or "").split()] + [i for i, t in {(i, t) for i, t, _ in ODD if (t or "").split()} if i != 4]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, wanted))


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_base_score_and_model(which, request):
    table = request.getfixturevalue(which)
    rows = rows_of(table)
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows]
    tokens = [WORD.findall(low(t)) + ["\n"] for _, t, _ in rows]
    counts = collections.Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    wanted = sorted((len(t), sum(counts[w] > 0 for w in t), round(sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for t in tokens)
    found = context_tree.score(table, context_tree.F.crc32(context_tree.F.col("doc_id").cast("string")) % 10 == 0).collect()
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == wanted
    assert all(np.isfinite(r.score) and r.score < 0 for r in found)


def plain_tree(streams, trained, depth):
    """log10 probability of each stream by the recursion: KT at every context and decision, half the weight to the children."""
    import math

    counts = collections.defaultdict(lambda: [0, 0])  # (context, latest byte last; bits so far)
    children = collections.defaultdict(set)

    def places(stream):
        for i, byte in enumerate(stream):
            bits = f"{byte:08b}"
            before = (b" " * depth + stream[:i])[-depth:]
            for k in range(8):
                yield [(before[depth - level :], bits[:k]) for level in range(depth + 1)], int(bits[k])

    for stream, learn in zip(streams, trained, strict=True):
        for path, bit in places(stream) if learn else ():
            for node in path:
                counts[node][bit] += 1
            for up, down in zip(path, path[1:]):
                children[up].add(down)

    def kt(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)

    weighted = {}

    def log_w(node):
        if node not in weighted:
            own = kt(*counts[node])
            weighted[node] = own if len(node[0]) == depth else math.log(0.5) + np.logaddexp(own, sum(map(log_w, children[node])))
        return weighted[node]

    def predict(path, bit):
        node = path[0]
        z, o = counts[node]
        p = ((o if bit else z) + 0.5) / (z + o + 1)
        if len(path) == 1 or path[1] not in counts:  # the deepest context of the tree
            return p
        stop = math.exp(math.log(0.5) + kt(z, o) - log_w(node))
        return stop * p + (1 - stop) * predict(path[1:], bit)

    return [sum(math.log10(predict(path, bit) if path[0] in counts else 0.5) for path, bit in places(s)) for s in streams]


@pytest.mark.parametrize("which,depth,block_bytes", [("odd", 6, 1000), ("few", 6, 1500), ("few", 3, 10**6), ("few", 2, 2000), ("few", 7, 3000)])
def test_scores_equal_the_plain_recursion(which, depth, block_bytes, odd, docs):
    table = odd.where("length(text) < 2000 OR text IS NULL") if which == "odd" else docs.where("length(text) < 500").limit(14)
    rows = rows_of(table)
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows]
    streams = [b"".join(w + b" " for w in re.findall(rb"[^\x20\x09-\x0d]+", low(t).encode())) + b"\n" for _, t, _ in rows]
    wanted = plain_tree(streams, [not h for h in held], depth)
    found = context_tree.score(table, context_tree.F.crc32(context_tree.F.col("doc_id").cast("string")) % 10 == 0, depth=depth, block_bytes=block_bytes).collect()
    mine, plain = sorted((str(r.doc_id), r.score) for r in found), sorted((str(rows[i][0]), wanted[i]) for i in range(len(rows)))
    assert [i for i, _ in mine] == [i for i, _ in plain]
    assert [x for _, x in mine] == pytest.approx([x for _, x in plain], rel=2e-6)  # answers travel as 32-bit numbers


def test_without_training_rows_every_byte_is_as_likely(spark):
    table = spark.createDataFrame([(1, "ab c"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in context_tree.score(table, context_tree.F.lit(True)).collect()}
    assert found[1].score == pytest.approx(-6 * 8 * np.log10(2), rel=1e-6) and found[2].score == pytest.approx(-8 * np.log10(2), rel=1e-6)
    assert found[1].train_tokens == 0 and found[1].bits_per_byte == pytest.approx(8, rel=1e-6)


def test_most_held_out_documents_score_above_the_base(spark):
    found = context_tree.op1_context_tree(spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    assert (found["score"] > found["base_score"]).mean() > 0.7 and found["score"].sum() > found["base_score"].sum()


def test_log_gamma():
    import math

    x = np.array([0.5, 1.0, 1.5, 10.0, 1e6])
    assert np.allclose(context_tree.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mixing_equals_sql_and_meets_its_targets(which, request):
    table = request.getfixturevalue(which)
    documents = table.select("doc_id", "text", "source").toPandas()
    con = duckdb.connect()
    con.register("documents", documents.astype({"doc_id": "Int64"}))
    sql = con.sql(mixing.ORACLES["op4_mixing"]).df()
    found = mixing.mix(table.select("doc_id", "text", "source")).toPandas()
    key = lambda d: sorted((str(i), int(s), int(c), round(float(t), 4)) for i, s, c, t in zip(d["doc_id"].fillna(-1).astype("int64"), d["size"], d["copies"], d["target"], strict=True))
    assert key(found) == key(sql)
    assert (found["copies"] <= 3).all()
    taken = found.assign(words=found["copies"] * found["size"]).groupby("source", dropna=False).agg(words=("words", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((taken["words"] - taken["target"]).abs() <= taken["most"] / 2 + 1).all()


def test_quality_counts(spark, odd, docs):
    for table in (docs, odd):
        found = quality_rules.judge(table.select("doc_id", "text")).collect()
        wanted = []
        for _, t, _ in rows_of(table):
            w = WORD.findall(t)
            grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
            inside = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
            lines = [x for x in t.split("\n") if WORD.search(x)]
            wanted.append((len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), len(w) < 20 or 100 * len(inside) > 30 * len(w)))
        assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found) == sorted(wanted)
        assert not any(r.kept and r.base_failed for r in found)


def test_line_rules_remove_furniture_only(spark):
    body = "The harbour was quiet that morning, and the first boats left before the fog had lifted from the bay."
    text = f"Home | News | About | Contact\n{body}\nClick here to subscribe to our newsletter\nBy noon a wind from the east had cleared the sky."
    kept = quality_rules.clean(spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")).collect()
    assert [r.text for r in kept] == [f"{body}\nBy noon a wind from the east had cleared the sky."]


def test_fingerprints_follow_the_next_document(odd, docs):
    for table in (docs, odd):
        rows = sorted(rows_of(table), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()), reverse=True)
        texts = [t for _, t, _ in rows]
        found = fingerprints.followed(table, range_rows=40).collect()
        sets = shingle_sets(texts, 5)
        wanted, near = [], {}
        for k, t in enumerate(texts):
            other = texts[(k + 1) % len(texts)]
            m = len(t) // 3
            edited = t[: len(t) - m] + other[:m]
            digest = hashlib.sha256(edited.encode()).hexdigest()
            wanted.append((str(rows[k][0]), len(t), digest))
            a, b = sets[k], shingle_sets([edited], 5)[0]
            near[digest] = len(a & b) / len(a | b) if a | b else 1.0
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in found) == sorted(wanted)
        error = [abs(r.near_edited - near[r.edited_sha256]) for r in found]
        assert np.mean(error) < (0.05 if table is docs else 0.2)


def test_equal_texts_have_equal_fingerprints(spark):
    found = fingerprints.fingerprint(spark.createDataFrame([(t,) for t in ("A b c d e f", "a B c d e f", "", None, "a")], "text string")).collect()
    prints = [r.fingerprint for r in found]
    assert prints[0] == prints[1] and prints[2] == prints[3] == "" and len(prints[4]) == 256


def test_pii_base_spans_and_masks(spark, odd):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for t in [*(t or "" for _, t, _ in ODD), "a@b.c@d.e x@@y.z a.b@c.d. f@g ..@a.b", "@a.b a@b a@b.c"]:
        assert [m.span() for m in email.finditer(t)] == pii.emails(t)
    found = {r.doc_id: r for r in pii.find(odd).collect() if r.doc_id is not None}
    assert (found[8].n_email, found[8].n_ip, found[8].n_card, found[8].n_phone) == (1, 1, 1, 1)
    assert found[1].spans == "" and found[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = {r.doc_id: r.text for r in pii.redact(odd).collect()}
    assert "@" not in masked[8] and "[EMAIL]" in masked[8] and masked[3] == "one" and masked[2] is None


def test_secrets_need_no_digit_in_the_text():
    for text in ("password: correct-horse-battery-staple", "the API key = abcdefghijklmnop, says he"):
        found = pii.loose_spans(text, [])
        assert [k for k, _, _ in found] == ["secret"] and found == pii.loose_spans(text + " 7", [])


def test_em_recovers_planted_reliabilities():
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.4
    votes = collections.Counter()
    for t in truth:
        v = "".join("y" if (rng.random() < q) == t else "n" for q in (0.95, 0.9, 0.85, 0.8, 0.7))
        votes[v, bool(t)] += 1
    rows = collections.Counter()
    for (v, _), n in votes.items():
        rows[v] += n
    p, share, table = pii.expectation_maximisation(["number"] * len(rows), list(rows), list(rows.values()))
    assert share[pii.KINDS.index("number")] == pytest.approx(0.4, abs=0.05)
    assert [table[j, 1, 0] for j in range(5)] == pytest.approx([0.95, 0.9, 0.85, 0.8, 0.7], abs=0.06)


def test_licenses_base_places_and_labels(odd, docs):
    for table in (docs, odd):
        found = sorted(licenses.scan(table).collect(), key=str)
        wanted = []
        for i, t, _ in rows_of(table):
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
            places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
            wanted.append((i, len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places}))))
        mine = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found]
        assert sorted(mine, key=str) == sorted(wanted, key=str)
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in found)


def test_license_templates_need_their_key_phrase(spark):
    texts = [text for _, text, _ in licenses.TEMPLATES] + ["licensed under the sun and moon", "license license license mit apache general public"]
    found = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(label in found[i].split(",") for i, (label, _, _) in enumerate(licenses.TEMPLATES))
    assert found[len(texts) - 2] == found[len(texts) - 1] == ""


def test_all_licenses_of_a_file_are_found(spark):
    texts = [text for _, text, _ in licenses.TEMPLATES]
    every = ",".join(sorted({label for label, _, _ in licenses.TEMPLATES}))
    notice = " other words between two notices ".join(texts)
    pairs = [f"{a}. {b}" for a, b in itertools.permutations(texts, 2)]
    rows = list(enumerate([notice, f"{notice} " * 30, *pairs]))
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in (0, 1):
        assert set(found[i].labels.split(",")) >= set(every.split(","))
    for i, (a, b) in enumerate(itertools.permutations([label for label, _, _ in licenses.TEMPLATES], 2)):
        assert {a, b} <= set(found[i + 2].labels.split(",")), pairs[i]


def test_html_main_text(spark):
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><div id=menu><a href=/>Home</a></div><article><h1>A &amp; B</h1>"
        "<p>First <b>bold</b>\n text.<br>More<p>Second</p><aside>advert</aside><p>Third</p><div class='comments'>nice</div></article><footer>f</footer>"
    )
    pages = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "plain words"), (5, "<p>a < b</p>")], "page_id long, html string")
    found = {r.page_id: r.text for r in html_blocks.extract(pages).collect()}
    assert found == {1: "A & B\n\nFirst bold text. More\n\nSecond\n\nThird", 2: "", 3: "", 4: "plain words", 5: "a < b"}


def test_html_articles_are_no_short_cut():
    body = "".join(f"<p>Paragraph {i} of the main text, which stands in a plain element of the page.</p>" for i in range(6))
    card = "<article class='teaser'><a href=/x>Another story</a></article>"
    comments = "<article class='comment'><p>I liked it very much.</p></article><article id=comment-2 class='comment-body'>Me too.</article>"
    whole = html_blocks.main_text(f"<body><div>{body}</div>")
    assert whole.count("\n\n") == 5
    assert html_blocks.main_text(f"<body><div>{body}</div><aside>x</aside>{card}<section>{comments}</section></body>") == whole
    assert html_blocks.main_text(f"<body><article class='post has-sidebar comments-open category-newsletter'>{body}</article>{comments}") == whole
    assert html_blocks.main_text(f"<body><main class=sidebar-right>{body}</main><article role=complementary>Other</article>") == whole


@pytest.mark.parametrize("size", [1, 20, 2000])
def test_html_ends_do_not_depend_on_the_length_of_the_body(size):
    body, ad = "<p>A sentence of the body that is neither long nor short.</p>" * size, "<div class=ad>Buy now!</div>"
    links, legal = "<div><a href=/1>One other story</a> <a href=/2>Two</a></div>", "<div>&copy; 2024 Someone</div>"
    count = lambda page: html_blocks.main_text(page).split("\n\n")
    for a, b in (("<article>", "</article>"), ("<div><div>", "</div></div>"), ("<body>", "</body>"), ("", "")):
        found = count(f"{a}<p>A lead</p>{ad}{body}{ad}<p>The end</p>{b}")
        assert (found[0], found[-1], len(found)) == ("A lead", "The end", size + 2)
    found = count(f"<div><p>A lead that tells much.</p></div>{ad}<div>{body}</div>{ad}<div><p>It ends so.</p></div>{ad}{links}{ad}{legal}")
    assert (found[0], found[-1], len(found)) == ("A lead that tells much.", "It ends so.", size + 2)
    found = count(f"<article><h1>Head</h1>{ad}<div>{body}</div>{ad}The end</article>{ad}{links}")
    assert (found[0], found[-1], len(found)) == ("Head", "The end", size + 2)


def test_classifier_separates_held_out_rows(spark):
    found = kernel_quality.op10_kernel_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = labels.merge(found, on="doc_id")
    held = both[both["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.93
    assert found["score"].between(0, 1).all()


def test_classifier_without_labels(spark, odd):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    none = kernel_quality.F.lit(False)
    assert {r.score for r in kernel_quality.classify(odd, empty, none, none).collect()} == {0.5}


def test_isotonic_rises():
    at, value = kernel_quality.isotonic(np.arange(6.0), np.full(6, 10.0), np.array([1, 3, 2, 8, 7, 10.0]))
    assert (np.diff(value) >= 0).all() and len(at) == len(value)


def test_sentencepiece_equals_the_library(spark, odd):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_scan.model_path())
    rng = np.random.default_rng(2)
    parts = ["a", "the", " ", "  ", "▁", "\n", "é", "漢", "😀", "in", "ing", "\t", "12", ".", "ß"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 90))) for _ in range(300)] + ["ab" * 400, " " * 90]
    df = spark.createDataFrame([(t,) for t in texts], "text string").unionByName(odd.select("text"))
    for giant, chunk in ((1 << 20, 1 << 14), (40, 64)):
        for r in sentencepiece_scan.encode(df, giant=giant, chunk=chunk, check=True).collect():
            assert r.ids == library.encode(r.text or "") and r.round_trip
            assert sentencepiece_scan.decode(r.ids, sentencepiece_scan.pieces(sentencepiece_scan.model_path())) == library.decode(r.ids)


def test_transfer_products_are_associative():
    v = sentencepiece_scan.pieces(sentencepiece_scan.model_path())
    text = "the inging of " * 9 + "abcab" * 60 + " end"
    m = [sentencepiece_scan.Chunk(v, *x).transfers() for x in sentencepiece_scan.chunks_of(text, v, 64)]
    c = sentencepiece_scan.combine
    assert c(c(m[0], m[1]), m[2]) == c(m[0], c(m[1], m[2]))


def test_giants_with_many_chunks_and_clashing_names(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_scan.model_path())
    rng = np.random.default_rng(4)
    words = ["inging", "the", "of", "ab" * 50, "x", "é", "漢字", "▁"]
    texts = [" ".join(rng.choice(words, n)) for n in (40, 333, 1500)] + ["abc" * 3000, " " * 700, "e" * 129]
    df = spark.createDataFrame([(t, [1], "k", 0) for t in texts * 2], "text string, ids array<int>, key string, no int")
    for r in sentencepiece_scan.encode(df, giant=64, chunk=64, check=True).collect():
        assert r.ids == library.encode(r.text) and r.round_trip and (r.key, r.no) == ("k", 0)


def test_what_a_process_keeps_is_bounded(monkeypatch):
    monkeypatch.setattr(sentencepiece_scan, "KNOWN", 50)
    v = sentencepiece_scan.Pieces(sentencepiece_scan.model_path())
    rng = np.random.default_rng(1)
    plain = np.array(sorted(v.id.values()))
    for _ in range(5):
        a, b = rng.choice(plain, 40), rng.choice(plain, 40)
        wanted = [v.merge(v.text[x] + v.text[y]) == [v.text[x], v.text[y]] for x, y in zip(a, b, strict=True)]
        assert v.leaves_apart(a, b).tolist() == wanted and len(v.known) <= 50 + 40


def plain_labels(texts):
    """(labels, score) of every text: at every place each template is laid, the share of its rarity-weighted words that stand there."""
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)) for t in texts]
    templates = [(label, re.findall(r"[a-z0-9]+", text), [k.split() for k in keys]) for label, text, keys in licenses.TEMPLATES]
    seen = collections.Counter(w for ws in words for w in set(ws))
    idf = lambda w: max(np.log((len(texts) + 1) / (seen[w] + 0.5)) + 0.01, 0.01)
    out = []
    for ws in words:
        labels = {label for phrase, label in licenses.BASE.items() for k in range(len(ws)) if ws[k : k + len(phrase.split())] == phrase.split()}
        best = 1.0 if labels else 0.0
        for label, text, keys in templates:
            begins = [k for key in keys for k in range(len(ws)) if ws[k : k + len(key)] == key]
            total = sum(map(idf, text))
            for shift in {b + d for b in begins for d in range(-len(text) - 1, 3)}:
                share = sum(idf(w) for q, w in enumerate(text) if 0 <= shift + q < len(ws) and ws[shift + q] == w) / total
                if share >= licenses.COVER - 1e-12:
                    labels.add(label)
                    best = max(best, share)
        out.append((",".join(sorted(labels)), round(best, 9)))
    return out


def test_license_labels_equal_the_plain_version(spark, odd, docs):
    rng = np.random.default_rng(8)
    texts = []
    for _, text, _ in licenses.TEMPLATES * 6:
        w = text.split()
        for _ in range(rng.integers(0, 6)):
            at = rng.integers(0, len(w))
            w[at : at + rng.integers(0, 2)] = ["other"] * rng.integers(0, 2)
        texts.append("before " * rng.integers(0, 4) + " ".join(w) + " after")
    mixed = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for table in (mixed, docs.select("doc_id", "text"), odd.select("doc_id", "text")):
        rows = [(r.doc_id, r.text or "") for r in table.collect()]
        wanted = sorted((str(i), *x) for (i, _), x in zip(rows, plain_labels([t for _, t in rows]), strict=True))
        assert sorted((str(r.doc_id), r.labels, round(r.score, 9)) for r in licenses.scan(table).collect()) == wanted


def plain_statistics(text):
    """The statistics of one text, one by one."""
    data, words = text.encode(), [w.encode() for w in WORD.findall(text)]
    size, n = max(len(data), 1), max(len(words), 1)
    kinds = [
        lambda c: 65 <= c < 91, lambda c: 97 <= c < 123, lambda c: 48 <= c < 58, lambda c: c in b"#*$%&<>", lambda c: c in b"|", lambda c: c in b"!?", lambda c: c in b".,;:", lambda c: c >= 128,
    ]
    x = [np.sqrt(sum(map(k, data)) / size) for k in kinds]
    lowered = [low(w.decode()) for w in words]
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    fours = [tuple(lowered[i : i + 4]) for i in range(len(lowered) - 3)] if len(lowered) >= 4 else [tuple(lowered)] * bool(lowered)
    x += [np.log1p(len(words)), mean, np.sqrt(max(sum(k * k for k in lengths) / n - mean**2, 0)), len(set(lowered)) / n]
    x += [len(set(zip(lowered, lowered[1:], strict=False))) / max(len(words) - 1, 1), len(set(fours)) / max(len(fours), 1)]
    x += [sum(k > 12 for k in lengths) / n, sum(k <= 2 for k in lengths) / n, np.log1p(len(words) / (text.count("\n") + 1))]
    return [*x, sum(65 <= w[0] < 91 for w in words) / n, sum(w[-1:] in (b".", b"!", b"?") for w in words) / n]


def test_classifier_equals_the_plain_version(spark, docs):
    """Statistics, random features, ridge and isotonic step, each written out, give the operator's scores."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = [(i, t) for i, t, _ in rows_of(docs)]
    x = np.array([plain_statistics(t) for _, t in rows]).astype(np.float32).astype(float)
    fold = np.array([zlib.crc32(str(i).encode()) % 4 for i, _ in rows])
    quality = {r.doc_id: r.quality for r in labels.collect()}
    y = np.array([quality.get(i, -1) for i, _ in rows], float)
    rng, k = np.random.default_rng(7), kernel_quality.FEATURES
    spread = x.std(0)
    w, b = rng.normal(0, np.sqrt(2 * kernel_quality.GAMMA), (x.shape[1], k)), rng.uniform(0, 2 * np.pi, k)
    z = np.clip((x - x.mean(0)) / np.where(spread > 1e-9, spread, 1), -6, 6)
    z = np.concatenate([np.sqrt(2 / k) * np.cos(z @ w + b), np.ones((len(z), 1))], 1)
    fit, apart = (fold < 2) & (y >= 0), (fold == 3) & (y >= 0)
    weights = np.linalg.solve(z[fit].T @ z[fit] + max(1.0, kernel_quality.RIDGE * fit.sum()) * np.eye(k + 1), z[fit].T @ y[fit])
    raw = z @ weights
    step = np.floor(np.clip(raw[apart], -1, 2) * kernel_quality.STEPS)
    at = np.unique(step)
    n = np.array([(step == s).sum() for s in at])
    ones = np.array([y[apart][step == s].sum() for s in at])
    # isotonic by its definition: the largest mean of a stretch that ends here or later, over the smallest beginning
    value = [max(min(ones[i : j + 1].sum() / n[i : j + 1].sum() for j in range(m, len(at))) for i in range(m + 1)) for m in range(len(at))]
    pools = [np.flatnonzero(np.isclose(value, v)) for v in dict.fromkeys(np.round(value, 12))]
    middle = [((at[p] + 0.5) / kernel_quality.STEPS * n[p]).sum() / n[p].sum() for p in pools]
    height = np.maximum.accumulate([(ones[p].sum() + 0.5) / (n[p].sum() + 1) for p in pools])
    wanted = dict(zip([i for i, _ in rows], np.interp(raw, middle, height), strict=True))
    found = {r.doc_id: r.score for r in kernel_quality.op10_kernel_quality(spark, DATA).collect()}
    assert found.keys() == wanted.keys()
    assert np.mean([abs(found[i] - wanted[i]) < 1e-3 for i in found]) > 0.98 and max(abs(found[i] - wanted[i]) for i in found) < 0.1


def test_a_large_group_of_near_copies_moves_few_sets(spark, monkeypatch):
    """3,000 near copies of one text: one component, and each set is moved a few times, not once for each block of the group."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(3000):
        copy = list(words)
        copy[int(rng.integers(0, 120))] = f"x{k}"
        texts.append(" ".join(copy))
    moved = []

    def counting(placed, *rest):
        moved.append(placed.count())
        return plain_stars(placed, *rest)

    plain_stars = jaccard_join._stars
    monkeypatch.setattr(jaccard_join, "_stars", counting)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    found = jaccard_join.join_components(df).collect()
    assert {r.component_id for r in found} == {0} and len(found) == 3000
    assert moved[0] <= 10 * 3000


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert jaccard_join.join_components(docs).count() == 0
    assert mixing.mix(docs).count() == mixing.take(docs).count() == 0
    assert quality_rules.clean(docs).count() == fingerprints.followed(docs).count() == 0
    assert pii.find(docs).count() == pii.redact(docs).count() == licenses.scan(docs).count() == 0
    assert sentencepiece_scan.encode(docs).count() == 0
    assert context_tree.score(docs, context_tree.F.lit(False)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert kernel_quality.classify(docs, labels, kernel_quality.F.lit(False), kernel_quality.F.lit(False)).count() == 0
    assert html_blocks.extract(spark.createDataFrame([], "html string")).count() == 0


def test_the_quota_may_end_among_equal_rows(spark):
    """40 equal rows without an id, of which half fit, beside a source that takes the rest; names clash with added ones."""
    rows = [(None, "w " * 10, "a", "x", -1)] * 40 + [(None, f"w{i} " * 10, "b", "x", -1) for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, whole string, size long")
    found = mixing.mix(table, weights=(1, 2)).toPandas()
    assert list(found.columns) == ["doc_id", "text", "source", "whole", "size", "source_size", "target", "copies"]
    words = found.assign(words=found["copies"] * found["size"]).groupby("source")["words"].sum()
    assert words["a"] == 200 and words["b"] == 400 and (found["size"] == 10).all() and (found["whole"] == "x").all()
    con = duckdb.connect()
    con.register("documents", table.drop("size").toPandas().astype({"doc_id": "Int64"}))
    same = con.sql(mixing.ORACLES["op4_mixing"].replace("1.0, 2.0, 3.0", "1.0, 2.0, 1.0")).df()
    assert sorted(same["copies"]) == sorted(found["copies"])
    assert mixing.take(table, weights=(1, 2)).count() == found["copies"].sum()


def test_inclusion_follows_the_probabilities(spark):
    """Over many draws each document is taken as often as its rate says: longer documents more often, whole copies always."""
    rows = [(i, "w " * (1 + i % 40), "a" if i % 3 else "b") for i in range(240)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    sized = table.select("source", mixing.word_count().alias("size")).withColumn("g", mixing.F.length(mixing.F.bin("size")))
    classes = sized.groupBy("source", "g").agg(mixing.F.sum("size").alias("words"))
    rates = {(r.source, r.g): r.whole + r.p for r in mixing.class_rates(classes, mixing.source_targets(sized)).collect()}
    assert max(rates.values()) > 1 and len(set(rates.values())) > 6
    draws, taken = 25, collections.Counter()
    for k in range(draws):
        for r in mixing.mix(table, seed=str(k)).select("doc_id", "copies").collect():
            taken[r.doc_id] += r.copies
    groups = collections.defaultdict(list)
    for i, t, s in rows:
        groups[s, len(t.split()).bit_length()].append(taken[i] / draws)
    for key, shares in groups.items():
        assert np.mean(shares) == pytest.approx(rates[key], abs=0.12), key


BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    """The base rule by its words: leftmost matches of each kind, those that fail dropped."""
    digits = lambda m: re.sub("[^0-9]", "", m.group())

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    ok = {
        "email": lambda m: True, "ip": lambda m: all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m.group().split(".")),
        "card": lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 10 <= len(digits(m)) <= 15,
    }
    return sorted(
        [(k, *m.span()) for k, p in BASE_PATTERNS.items() for m in re.finditer(p, text) if ok[k](m)], key=lambda s: (s[1], list(BASE_PATTERNS).index(s[0]))
    )


def test_pii_equals_the_base_rule_on_whole_tables(odd, docs):
    """Counts, digest and spans of the query against the plain rule; added spans overlap no base span and are candidates."""
    for table in (odd, docs):
        texts = collections.defaultdict(list)
        for i, t, _ in rows_of(table):
            texts[i].append(t)
        for r in pii.find(table).collect():
            matching = []
            for t in texts[r.doc_id]:
                base = plain_base(t)
                kinds = collections.Counter(k for k, *_ in base)
                joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
                matching.append((kinds["email"], kinds["ip"], kinds["card"], kinds["phone"], hashlib.sha256(joined.encode()).hexdigest(), joined))
            mine = [m for m in matching if m[:5] == (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)]
            assert mine, (r.doc_id, matching)
            spans = [s for s in r.spans.split(",") if s]
            base = [s for s in mine[0][5].split(",") if s]
            assert set(base) <= set(spans) and len(spans) == len(base) + r.n_added
            taken = [tuple(map(int, s.split(":")[1:])) for s in base]
            for s in set(spans) - set(base):
                a, b = map(int, s.split(":")[1:])
                assert all(b <= x or y <= a for x, y in taken)


def test_pii_of_random_odd_texts():
    rng = np.random.default_rng(11)
    parts = ["a", "@", ".", "b.c", "1", "25", "255", "300", "4111 1111 1111 1111", "+", "(", ")", " ", "-", "00", "é", "%", "+1 555 123 4567"]
    for _ in range(1500):
        text = "".join(rng.choice(parts, rng.integers(1, 24)))
        assert pii.base_spans(text) == plain_base(text), text


@pytest.mark.parametrize("text", [
    "1.1.1." + "0" * 5000 + "1", "7" * 1_000_000, "1." * 300_000, "a" * 1_000_000, "token " * 150_000, "+1(" * 300_000,
    "10.0.0.1 " * 100_000, "a@" * 400_000, "x.y@z " * 100_000, "555-123-4567 " * 70_000, "at (" * 200_000,
], ids=range(11))
def test_pii_time_is_linear_in_long_texts(text):
    import time

    began = time.perf_counter()
    found = pii.spans_of(text)
    assert time.perf_counter() - began < 20
    assert not text.startswith("1.1.1.0") or [(s["kind"], s["start"], s["end"]) for s in found] == [("ip", 0, len(text))]


def test_boilerplate_is_whole_phrases_that_make_up_a_good_part(spark):
    keeps = ["She read more books than he did in the first year.", "The catalog in the hall, the dialog in the play and the backlog in the office.",
             "    A sentence that is set far in, after spaces, of which no word is furniture.", "Her newsletter told of the boats that had come in that week, and of the harbour master's new house."]
    goes = ["Click here to subscribe to our newsletter.", "Read more...", "Sign up / Log in.", "Tous droits réservés.", "(c) 2024 Someone. All rights reserved."]
    body = "The harbour was quiet that morning, and the first boats left before the fog had lifted from the bay."
    text = "\n".join([body, *keeps, *goes])
    table = spark.createDataFrame([(1, text, len(text), -5, "mine", "w")], "doc_id long, text string, n_chars long, n_words long, kept string, _words string")
    (row,) = quality_rules.clean(table).collect()
    assert row.text.split("\n") == [body, *keeps] and row.n_chars == len(row.text)
    assert (row.n_words, row.kept, row._words) == (-5, "mine", "w")
    assert quality_rules.judge(table).columns == ["doc_id", "text", "n_chars", "_words", *quality_rules.ADDED]


def test_quality_verdicts_equal_sql(odd, docs):
    for table in (odd, docs):
        con = duckdb.connect()
        con.register("documents", table.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars")
        wanted = con.sql(f"SELECT doc_id, {', '.join(names)} FROM ({quality_rules.ORACLES['op9_quality_rules']})").fetchall()
        found = quality_rules.judge(table.select("doc_id", "text")).select("doc_id", *names).collect()
        assert sorted(map(str, map(tuple, found))) == sorted(map(str, wanted))


def plain_blocks(page):
    """The blocks of a page by the standard library's parser: those of its article, without furniture inside and outside."""
    from html.parser import HTMLParser

    class Blocks(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.held, self.stack = [], [], []

        def close_block(self):
            text = " ".join("".join(self.held).split())
            if text and not any(bad for _, bad in self.stack):
                self.out.append(text)
            self.held = []

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.held.append(" ")
                return
            if tag not in ("a", "b"):
                self.close_block()
            if tag == "meta":
                return
            names = {x for k, v in attrs if k in ("class", "id") for x in (v or "").split()}
            bad = tag in ("head", "title", "style", "script", "nav", "footer") or bool(names & {"ad", "comments", "comment"}) or "hidden" in dict(attrs)
            if bad:
                self.close_block()
            if tag in ("p", "li") and self.stack and self.stack[-1][0] == tag:
                self.stack.pop()
            self.stack.append((tag, bad))

        def handle_endtag(self, tag):
            if tag not in ("a", "b"):
                self.close_block()
            if any(t == tag for t, _ in self.stack):
                while self.stack.pop()[0] != tag:
                    pass

        def handle_data(self, data):
            if not any(bad for _, bad in self.stack):
                self.held.append(data)

    parser = Blocks()
    parser.feed(page)
    parser.close_block()
    return parser.out


@pytest.mark.parametrize("rename", [None, "div", "form"])
def test_html_of_whole_tables_equals_the_plain_version(spark, rename):
    """Every page, as it is, without article elements, and with a form around it: the same blocks outside furniture."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").toPandas()
    wanted = {i: plain_blocks(h or "") for i, h in zip(pages["page_id"], pages["html"], strict=True)}
    change = {
        None: lambda h: h, "div": lambda h: re.sub(r"<(/?)(?:article|main)\b", r"<\1div", h), "form": lambda h: re.sub(r"(<body[^>]*>)", r"\1<form class='page-form'>", h),
    }[rename]
    pages["html"] = [change(h or "") for h in pages["html"]]
    found = {r.page_id: r for r in html_blocks.extract(spark.createDataFrame(pages.assign(text="old"))).collect()}
    same = [i for i, blocks in wanted.items() if found[i].text == "\n\n".join(blocks)]
    assert len(same) == len(wanted), [(wanted[i], found[i].text) for i in wanted.keys() - set(same)][:2]
    assert all(r.n_chars == len(r.text) for r in found.values())


@pytest.mark.parametrize("tag", [
    '<article title="The hidden cost">', '<article data-id="comments-7">', '<article data-hidden="false">', '<section aria-label="hidden gems">',
    '<article style="display:none-x">', '<div class="post comments-enabled">', '<div class="content show-comments">', '<div class="article reply-on">',
    '<div id="reply-story">', '<details class="comment">', "<div title='a > b hidden' data-x=hidden>", '<div data-note="class=comments">', "<div onclick='x.hidden=true'>",
])
@pytest.mark.parametrize("head", ["<h1>Head</h1>", ""])
def test_html_attributes_are_read_as_attributes(tag, head):
    body = head + "".join(f"<p>Paragraph {i} of the main text, which stands in one element of the page.</p>" for i in range(9))
    whole = "\n\n".join((["Head"] if head else []) + [f"Paragraph {i} of the main text, which stands in one element of the page." for i in range(9)])
    page = f"<html><body><nav><a href=/>Home</a></nav>{tag}{body}</{tag.split()[0][1:]}><footer>About us.</footer></body></html>"
    assert html_blocks.main_text(page) == whole


@pytest.mark.parametrize("tag", [
    "<div hidden>", "<div HIDDEN=''>", "<div aria-hidden=true>", '<div style="color:red; display : none !important">', "<div class=comments>", '<section class="comment-list">',
    "<article class=comment>", "<div id='comment-7'>", "<ul class='user-replies'>", "<div class='post-comments'>",
])
@pytest.mark.parametrize("many", [1, 200])
def test_html_hidden_elements_and_comments_go(tag, many):
    body = "".join(f"<p>Paragraph {i} of the main text, which stands in one element of the page.</p>" for i in range(4))
    other = "<p>A reader or a script wrote this, and much more.</p>" * many
    found = html_blocks.main_text(f"<body><div class=story>{body}</div>{tag}{other}</{tag.split()[0].strip('<>')}></body>")
    assert found == "\n\n".join(f"Paragraph {i} of the main text, which stands in one element of the page." for i in range(4))


def test_html_names_do_not_delete_the_text():
    body = "".join(f"<p>Paragraph {i} of the main text, which stands in a plain element of the page.</p>" for i in range(6))
    whole = html_blocks.main_text(f"<body><div>{body}</div>")
    for a, b in (("<div class='content with-sidebar'>", "</div>"), ("<form action=/>", "</form>"), ("<div class=sidebar>", "</div>"), ("<div class='post newsletter'>", "</div>"), ("<div class='comments-closed'>", "</div>")):
        assert html_blocks.main_text(f"<body><nav><a href=/>Home</a></nav>{a}{body}{b}<footer>About us.</footer></body>") == whole, a
    comments = "<div class=comments>" + "<p>A reader wrote at length about something else, and more than the text itself.</p>" * 40 + "</div>"
    assert html_blocks.main_text(f"<body><article>{body}</article>{comments}<div class=footer>{body}{body}</div></body>") == whole


@pytest.mark.parametrize("page", [
    "<a " * 300_000, '<a ">' * 200_000, "<div>" * 100_000 + "</p>" * 100_000, "<p>x" * 100_000, "<" * 900_000, "<![CDATA[" * 100_000, "<a b='>" * 150_000 + "x>",
    "<b>" * 150_000 + "text</i>" * 100_000, "<li>a" * 100_000, "<!--" * 200_000, "&amp" * 300_000, "<p><div>" * 80_000, "<form>" * 100_000, "<table><tr><td>" * 60_000,
], ids=range(14))
def test_html_time_is_linear_in_long_pages(page):
    import time

    began = time.perf_counter()
    html_blocks.main_text(page)
    assert time.perf_counter() - began < 20


def test_links_of_very_long_sets_are_exact():
    small, large = np.arange(671_109, dtype=np.uint64), np.arange(789_540, dtype=np.uint64)  # 85 of 100, exactly
    n = np.array([len(small), len(large)])
    assert jaccard_join._linked_exactly(n, [small, large], 85)[0, 1]
    assert not jaccard_join._linked_exactly(np.array([len(small) - 1, len(large)]), [small[1:], large], 85)[0, 1]


def test_ids_that_are_no_numbers_stay(spark):
    words = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([("b2", words), ("a1", words + " more"), ("c3", "something else entirely"), (None, ""), ("", words)], "doc_id string, text string")
    found = {r.doc_id: r.component_id for r in jaccard_join.join_components(docs).collect()}
    assert found == {"b2": "", "a1": "", "": "", "c3": "c3", None: None}
    assert sorted(str(r.doc_id) for r in jaccard_join.keep_one(docs).collect()) == ["", "None", "c3"]
    prints = {r.doc_id: r for r in fingerprints.followed(docs).collect()}
    assert set(prints) == {"b2", "a1", "c3", "", None} and prints["c3"].near_next == 0.0 and prints["b2"].near_next > 0.8


def test_the_score_of_whole_templates_is_at_most_1():
    rng = np.random.default_rng(4)
    for _ in range(50):
        index = licenses.Index()
        index.weigh(1000, {i: int(n) for i, n in enumerate(rng.integers(0, 1000, len(index.words)))})
        for t, text in enumerate(index.texts):
            labels, score = index.match(np.arange(len(text)), np.array(text))
            assert score <= 1.0 and index.templates[t][0] in labels


def test_depths_that_do_not_fit_are_refused(docs):
    for depth in (1, 8):
        with pytest.raises(ValueError):
            context_tree.score(docs, docs.doc_id % 2 == 0, depth=depth)


def test_every_source_comes_near_its_target(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    taken = collections.Counter()
    target = {}
    for r in mixing.mix(table).collect():
        taken[r.source] += r["copies"] * r["size"]
        target[r.source] = r["target"]
    off = [abs(taken[s] / t - 1) for s, t in target.items()]
    assert max(off) < 0.05 and np.mean(off) < 0.015
