"""PII by weak supervision: labelers vote, EM weighs them, and a span classifier decides.

Base rules find e-mail addresses, IP addresses, card numbers and phone numbers; their spans always stay. Looser
patterns propose further candidates: secrets after a cue, obfuscated addresses, phone numbers without a plus,
identity numbers, long numbers. Labelers (form, cue words of gazetteers, surroundings, digit variety, domain lists)
vote yes, no or nothing on each candidate of either sort. The corpus is reduced to counts of (kind, votes, features),
a table of bounded size; expectation-maximisation estimates each labeler's reliability and each kind's share of true
spans from it, and a logistic classifier over the features is trained on the probabilities that come out. Candidates
that it accepts and that overlap no base span are added.

Each text is searched inside its own row: there is no shuffle but for the counts.

Defined cases: a null text counts as empty; a text without spans has counts 0 and empty span lists; equal texts get
equal spans; without candidates nothing is added; repeated rows are searched alike; other columns are not read by
``find`` and pass through ``redact``; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written

BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "obfuscated", "local_phone", "identity", "number")
KINDS = BASE + EXTRA
LABELERS = 5

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
#: A match can only begin where a run of digits does, so others are not tried: time stays linear in long runs.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_BYTES = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOOSE = {
    "secret": re.compile(r"(?i)\b(?:token|secret|passw(?:or)?d|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth)\b[\x20\x22']*+[:=][\x20\x22']*+([A-Za-z0-9_/+=-]{12,})"),
    "obfuscated": re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]++ ?[(\[{] ?at ?[)\]}] ?[A-Za-z0-9-]+(?: ?(?:[(\[{] ?dot ?[)\]}]|\.) ?[A-Za-z0-9-]+)+)"),
    "local_phone": re.compile(r"(?<![0-9+.-])(\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4})(?![0-9.-])"),
    "identity": re.compile(r"(?<![0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"),
    "number": re.compile(r"(?<![0-9A-Za-z.+-])([0-9]{9,19})(?![0-9A-Za-z-])"),
}
#: Words that speak for or against a kind when they stand shortly before a span.
CUES = {
    "email": "email e-mail mail contact write courriel correo adresse", "ip": "ip host server address addr login from client",
    "card": "card visa mastercard credit debit payment carte tarjeta karte", "phone": "tel phone call mobile fax telefon teléfono téléphone whatsapp",
    "secret": "token secret password passwd pwd key auth", "obfuscated": "email e-mail mail contact write",
    "local_phone": "tel phone call mobile fax telefon", "identity": "ssn social security insurance id", "number": "card account iban ssn passport id visa",
}
AGAINST = frozenset("version isbn issn page figure fig year chapter section table no price article vol serial".split())
TOP_DOMAINS = frozenset("com org net edu gov io de fr es it uk eu info biz co us ch at nl be example".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost, longest, non-overlapping matches of local@domain, searched from the at signs."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_BYTES:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            end = match.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base rules, by start and then kind."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if any(c in text for c in "0123456789"):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def loose_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further candidates that overlap neither base spans nor one another."""
    found, taken = [], []  # taken: disjoint intervals by start
    for _, a, b in sorted(base, key=lambda s: s[1:]):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    digits = any(c in text for c in "0123456789")
    for kind, pattern in _LOOSE.items():
        if not digits and kind not in ("obfuscated", "secret") or kind == "obfuscated" and "at" not in text:
            continue
        if kind == "secret" and ":" not in text and "=" not in text:
            continue
        if kind == "obfuscated" and not any(c in text for c in "([{"):
            continue
        for m in pattern.finditer(text):
            a, b = m.span(1)
            at = bisect.bisect_left(taken, (a, b))
            if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
                found.append((kind, a, b))
                taken.insert(at, (a, b))
    return found


def votes_and_features(text: str, kind: str, start: int, end: int) -> tuple[str, str]:
    """The labelers' votes (y, n or -) and the classifier's features, as short texts."""
    span = text[start:end]
    digits = re.sub(r"[^0-9]", "", span)
    before = text[max(0, start - 40) : start].lower()
    left, right = text[start - 1 : start], text[end : end + 1]
    words = set(re.findall(r"[^\W\d_]+", before))
    votes = []
    # form
    if kind == "email":
        votes.append("y" if re.search(r"\.[A-Za-z]{2,}$", span) and not span.startswith(".") else "n")
    elif kind == "ip":
        votes.append("y" if all(p == "0" or p[0] != "0" for p in span.split(".")) and not span.startswith("0") else "n")
    elif kind in ("card", "number"):
        votes.append("y" if luhn(digits) and len(digits) >= 13 else "n")
    elif kind == "secret":
        mixed = any(c.isdigit() for c in span) and any(c.isalpha() for c in span)
        votes.append("y" if mixed and len(span) >= 16 else "n")
    elif kind == "identity":
        votes.append("n" if span.startswith(("000", "666", "9")) else "y")
    else:
        votes.append("y" if kind == "obfuscated" or 10 <= len(digits) <= 15 else "n")
    # gazetteer of cue words
    votes.append("y" if words & set(CUES[kind].split()) else "n" if words & AGAINST else "-")
    # surroundings
    clean = (not left or left in " \n\t\"'(<[:;,=") and (not right or right in " \n\t\"')>].,:;!?#*$%&|")
    votes.append("y" if clean else "n")
    # variety of what stands in the span
    kinds_of = len(set(digits if kind not in ("email", "obfuscated", "secret") else span.lower()))
    votes.append("y" if kinds_of >= 5 else "n" if kinds_of <= 2 else "-")
    # gazetteer of domains
    top = re.split(r"[.\s)\]}]", span.lower())[-1]
    votes.append("-" if kind not in ("email", "obfuscated") else "y" if top in TOP_DOMAINS else "n")
    length = min(len(span) // 6, 7)
    share = min(4 * len(digits) // max(len(span), 1), 3)
    side = lambda c: "e" if not c else "w" if c.isspace() else "a" if c.isalnum() else "p"
    return "".join(votes), f"{length}{share}{min(kinds_of, 8)}{side(left)}{side(right)}"


def expectation_maximisation(kinds, votes, counts, rounds: int = 200):
    """(probability of each row, share of true spans by kind, [labeler, truth, vote] tables) from counted vote rows.

    Every labeler starts as right more often than wrong, which fixes what "true" means.
    """
    code = np.array([["yn-".index(c) for c in v] for v in votes]).reshape(-1, LABELERS)
    kind = np.array([KINDS.index(k) for k in kinds])
    n = np.asarray(counts, np.float64)
    share = np.full(len(KINDS), 0.5)
    table = np.tile(np.array([[0.2, 0.5, 0.3], [0.6, 0.1, 0.3]]), (LABELERS, 1, 1))
    p = np.zeros(len(n))
    for _ in range(rounds):
        log = [np.log(share[kind] if t else 1 - share[kind]) + sum(np.log(table[j, t, code[:, j]]) for j in range(LABELERS)) for t in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        for j in range(LABELERS):
            for t, w in enumerate((n * (1 - new), n * new)):
                prior = np.array([[0.4, 1.0, 0.6], [1.2, 0.2, 0.6]])[t]
                table[j, t] = np.bincount(code[:, j], weights=w, minlength=3) + prior
                table[j, t] /= table[j, t].sum()
        for k in range(len(KINDS)):
            share[k] = (1 + (n * new)[kind == k].sum()) / (2 + n[kind == k].sum())
        if len(p) and np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p, share, table


class SpanClassifier:
    """Logistic regression over one-hot features, fitted by Newton steps to soft labels."""

    def __init__(self):
        self.weights: dict[tuple[int, str], float] = {}
        self.bias = 0.0

    @staticmethod
    def _parts(kind: str, features: str):
        return [(0, kind), *((i + 1, c) for i, c in enumerate(features))]

    def fit(self, kinds, features, counts, p, ridge: float = 1.0, steps: int = 25):
        names = sorted({x for k, f in zip(kinds, features, strict=True) for x in self._parts(k, f)})
        index = {x: i for i, x in enumerate(names)}
        x = np.zeros((len(kinds), len(names) + 1))
        x[:, -1] = 1
        for i, (k, f) in enumerate(zip(kinds, features, strict=True)):
            for part in self._parts(k, f):
                x[i, index[part]] = 1
        n, w = np.asarray(counts, np.float64), np.zeros(len(names) + 1)
        for _ in range(steps):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (n * (p - q)) - ridge * w
            curve = (x * (n * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
            step = np.linalg.solve(curve, slope)
            w += np.clip(step, -3, 3)
        self.weights, self.bias = {x: float(w[i]) for x, i in index.items()}, float(w[-1])
        return self

    def probability(self, kind: str, features: str) -> float:
        z = self.bias + sum(self.weights.get(x, 0.0) for x in self._parts(kind, features))
        return 1 / (1 + float(np.exp(-np.clip(z, -30, 30))))


SPAN = "struct<kind:string,start:int,end:int,votes:string,features:string,base:boolean>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.string()), ("features", pa.string()), ("base", pa.bool_())]))


def spans_of(text: str | None) -> list[dict]:
    text = text or ""
    base = base_spans(text)
    every = [(*s, True) for s in base] + [(*s, False) for s in loose_spans(text, base)]
    found = []
    for kind, a, b, is_base in every:
        votes, features = votes_and_features(text, kind, a, b)
        found.append({"kind": kind, "start": a, "end": b, "votes": votes, "features": features, "base": is_base})
    return found


def _search(batches):
    for batch in batches:
        found = pa.array([spans_of(t) for t in batch.column(1).to_pylist()], _SPAN_TYPE)
        yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "spans"])


def train(candidates: DataFrame) -> SpanClassifier:
    """The classifier from a column ``spans`` of candidates; only counted combinations, of a bounded number, are read."""
    rows = (
        candidates.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.features").agg(F.count("*").alias("n"))
        .orderBy("kind", "votes", "features").toPandas()
    )
    if not len(rows):
        return SpanClassifier()
    p, _, _ = expectation_maximisation(rows["kind"], rows["votes"], rows["n"])
    return SpanClassifier().fit(rows["kind"], rows["features"], rows["n"], p)


def accepted(spans, model: SpanClassifier) -> list:
    return [s for s in spans if s["base"] or model.weights and model.probability(s["kind"], s["features"]) >= 0.5]


def _joined(spans) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"])))


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row."""
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    candidates = written(rows.mapInArrow(_search, f"doc_id {kind}, spans array<{SPAN}>"), "candidates")
    model = docs.sparkSession.sparkContext.broadcast(train(candidates))

    def report(batches):
        for batch in batches:
            lists = batch.column(1).to_pylist()
            base = [[s for s in x if s["base"]] for x in lists]
            final = [accepted(x, model.value) for x in lists]
            columns = [batch.column(0)]
            columns += [pa.array([sum(s["kind"] == k for s in x) for x in base], pa.int64()) for k in BASE]
            columns.append(pa.array([hashlib.sha256(_joined(x).encode()).hexdigest() for x in base], pa.string()))
            columns.append(pa.array([_joined(x) for x in final], pa.string()))
            columns.append(pa.array([len(x) - len(y) for x, y in zip(final, base, strict=True)], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added"])

    counts = ", ".join(f"n_{k} long" for k in BASE)
    return candidates.mapInArrow(report, f"doc_id {kind}, {counts}, base_sha256 string, spans string, n_added long")


def mask(text: str, spans) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    out, end = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= end:
            out += [text[end : s["start"]], f"[{s['kind'].upper()}]"]
        end = max(end, s["end"])
    return "".join(out) + text[end:]


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with personal data masked, in the input's own columns; n_chars follows the text."""
    candidates = written(docs.select(F.lit(0).alias("doc_id"), F.col(text)).mapInArrow(_search, f"doc_id int, spans array<{SPAN}>").where("size(spans) > 0"), "candidates")
    model = docs.sparkSession.sparkContext.broadcast(train(candidates))

    def masked(batches):
        for batch in batches:
            texts = [None if t is None else mask(t, accepted(spans_of(t), model.value)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_row", "_masked"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text))
    found = rows.mapInArrow(masked, f"_row {rows.schema['_row'].dataType.simpleString()}, _masked string")
    new = {text: F.col("_masked"), "n_chars": F.length("_masked").cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"_row.`{c}`") for c in docs.columns])


def op7_pii(spark, sf_dir):
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_pii": op7_pii}
ORACLES: dict[str, str] = {}
