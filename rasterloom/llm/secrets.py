"""Operator 5, secret scan with a battery of randomness tests.

Base patterns, leftmost and non-overlapping per kind, over whole texts:
``assign`` (a keyword assigned a value of 8+ characters), ``access`` (AKIA
keys of 16+ characters), ``hex`` (32+ hexadecimal digits). Spans are those of
whole matches in code points, end exclusive.

The battery adds spans of kind ``random``: maximal runs of 20 and more token
characters (``=`` only as padding at the end), cut at the borders of base spans,
with an encoding inferred from their characters (decimal, lower, upper, hex,
base32, base36, base62, base64, base64url, mixed). Three tests give p-values
against structure, that is names and prose in that encoding:

* chi-squared uniformity over the alphabet, merged to classes of enough
  expected characters in order of their frequency in prose: how seldom
  structured text is as even (``structured_shares``);
* serial correlation of neighbouring alphabet positions: how seldom it is as low
  where neighbours go together (``TOGETHER``);
* a runs test on character classes (lower, upper, digit, mark): how seldom
  there are as many class changes (``CHANGE_RATE``). Runs of one class have the
  other two tests only.

A run's p-values are combined to one by Cauchy's rule, which holds for
dependent tests. The combined values go through a Benjamini-Hochberg control
over the whole corpus within length classes (``FDR``). The control needs only a
histogram of p-values: at most 4 x ``BINS`` counts reach the driver, whatever
the corpus size.

Work is linear in the text: runs and base spans are walked together.

Defined results: a null or empty text has no span. Null and repeated ids are
kept, one row per input row. Extra columns don't matter.
"""

from __future__ import annotations

import math
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
# Runs shorter than the limit fail as a whole, so the limit can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")

FDR, BINS, CHANGE_RATE, TOGETHER, LENGTHS = 0.01, 300, 0.2, 0.1, (20, 32, 48, 64)
PROSE = "etaoinshrdlcumwfgypbvkjxqz"
DIGITS = "0123456789"
ALPHABETS = (
    ("decimal", DIGITS), ("lower", PROSE), ("upper", PROSE.upper()), ("hex", DIGITS + "abcdef"), ("hex", DIGITS + "ABCDEF"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", DIGITS + PROSE), ("base36", DIGITS + PROSE.upper()), ("base62", DIGITS + PROSE + PROSE.upper()),
    ("base64", DIGITS + PROSE + PROSE.upper() + "+/"), ("base64url", DIGITS + PROSE + PROSE.upper() + "-_"), ("mixed", DIGITS + PROSE + PROSE.upper() + "+/-_"),
)
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
CANDIDATE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("length_class", pa.int32()), ("p_bin", pa.int32())])
SCHEMA = "spans array<struct<kind:string,start:int,end:int>>, candidates array<struct<start:int,end:int,encoding:string,length_class:int,p_bin:int>>"


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns."""
    found = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def class_of(c: str) -> str:
    return "l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "m"


def infer_encoding(s: str) -> tuple[str, str]:
    """Name and alphabet of the first encoding that holds ``s``; runs hold no other characters than the last one's."""
    have = set(s)
    return next((n, a) for n, a in ALPHABETS if have <= set(a))


def normal_tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) for X ~ Binomial(n, p)."""
    return min(1.0, sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k, n + 1)))


@cache
def structured_shares(alphabet: str) -> tuple[float, ...]:
    """Shares of the characters in structured text: letters of one case fall off
    with their rank in prose, a tenth of all each for the other case, digits, marks."""
    weight = {"l": 0.7, "u": 0.1, "d": 0.1, "m": 0.1}
    if not any(c.islower() for c in alphabet):
        weight["u"] = 0.7
    share = [1 / (PROSE.index(c.lower()) + 3) if c.isalpha() else 1.0 for c in alphabet]
    sums = {k: sum(x for x, c in zip(share, alphabet, strict=True) if class_of(c) == k) for k in weight}
    there = sum(w for k, w in weight.items() if sums[k])
    return tuple(x / sums[class_of(c)] * weight[class_of(c)] / there for x, c in zip(share, alphabet, strict=True))


def battery(s: str, alphabet: str) -> tuple[float, ...]:
    """p-values of ``s`` against structure: evenness, serial correlation and, of several classes, class changes."""
    n, size, shares = len(s), len(alphabet), structured_shares(alphabet)
    at = [alphabet.index(c) for c in s]
    groups = min(size, max(2, n // 5))
    counts, even, known = [0] * groups, [0.0] * groups, [0.0] * groups
    for i in range(size):
        even[i * groups // size] += 1 / size
        known[i * groups // size] += shares[i]
    for i in at:
        counts[i * groups // size] += 1
    chi = sum((c - n * u) ** 2 / (n * u) for c, u in zip(counts, even, strict=True))
    # mean and variance of chi-squared against evenness when the shares are those of structure
    ratio = [q / u for q, u in zip(known, even, strict=True)]
    mean = sum((q * (1 - q) + n * (q - u) ** 2) / u for q, u in zip(known, even, strict=True))
    spread = 4 * n * (sum(q * r * r for q, r in zip(known, ratio, strict=True)) - sum(q * r for q, r in zip(known, ratio, strict=True)) ** 2)
    spread += 2 * sum((r * (1 - q)) ** 2 for q, r in zip(known, ratio, strict=True))
    uniform = normal_tail((mean - chi) / math.sqrt(spread))
    middle = sum(at) / n
    var = sum((x - middle) ** 2 for x in at)
    r = sum((a - middle) * (b - middle) for a, b in zip(at, at[1:], strict=False)) / var if var else 1.0
    one = len(set(map(class_of, alphabet))) == 1
    if one:  # vowels and consonants, or padded digits, alternate: neighbours that differ go together too
        r = abs(r)
    serial = normal_tail((math.atanh(TOGETHER) - math.atanh(max(-0.999, min(0.999, r)))) * math.sqrt(n - 3))
    kind = [class_of(c) for c in s]
    if one:
        return uniform, serial
    changes = sum(a != b for a, b in zip(kind, kind[1:], strict=False))
    return uniform, serial, binomial_tail(changes, n - 1, CHANGE_RATE)


def combined(ps: tuple[float, ...]) -> float:
    """Cauchy's combination of p-values that may depend on each other."""
    t = 0.0
    for p in ps:
        p = min(0.99, max(p, 1e-30))
        t += math.tan((0.5 - p) * math.pi) if p > 1e-10 else 1 / (p * math.pi)
    t /= len(ps)
    return 0.5 - math.atan(t) / math.pi if t < 1e10 else 1 / (t * math.pi)


def candidates(text: str, spans: list[tuple[int, str, int]]) -> list[dict]:
    """Runs outside the base spans with the bin of their combined p-value."""
    taken: list[list[int]] = []  # the base spans' union, in order
    for x, _, y in spans:  # by start
        if taken and x <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], y)
        else:
            taken.append([x, y])
    out, k = [], 0
    for m in TOKEN.finditer(text):
        a, end = m.span()
        parts = []
        while k < len(taken) and taken[k][0] < end:
            x, y = taken[k]
            if a < y:
                parts.append((a, x))
                a = y
            if y > end:  # it may reach into the next run
                break
            k += 1
        for x, y in [*parts, (a, end)]:
            s = text[x:y].rstrip("=")
            if len(s) < LENGTHS[0]:
                continue
            enc = infer_encoding(s)
            p = combined(battery(s, enc[1]))
            bin_ = min(BINS - 1, int(-10 * math.log10(max(p, 1e-300))))
            out.append({"start": x, "end": y, "encoding": enc[0], "length_class": sum(len(s) >= n for n in LENGTHS) - 1, "p_bin": bin_})
    return out


def _scan(batches):
    base.cached()
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            spans, cands = [], []
            for t in part.column(1).to_pylist():
                found = base_spans(t) if t else []
                spans.append([{"kind": k, "start": x, "end": y} for x, k, y in found])
                cands.append(candidates(t, found) if t else [])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, pa.list_(SPAN)), pa.array(cands, pa.list_(CANDIDATE))], names=["doc_id", "spans", "candidates"])


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return texts.mapInArrow(_scan, f"doc_id {docs.schema[id_col].dataType.simpleString()}, {SCHEMA}")


def thresholds(scanned: DataFrame, fdr: float = FDR) -> list[int]:
    """Benjamini-Hochberg by length class: the least p-value bin that counts as found."""
    seen = scanned.select(F.explode("candidates").alias("c")).groupBy("c.length_class", "c.p_bin").count().collect()  # <= 4 x BINS rows
    least = []
    for k in range(len(LENGTHS)):
        bins = {r["p_bin"]: r["count"] for r in seen if r["length_class"] == k}
        total, above, cut = sum(bins.values()), 0, BINS + 1
        for b in sorted(bins, reverse=True):
            above += bins[b]
            if 10 ** (-b / 10) <= fdr * above / total:  # the largest p-value of the bin
                cut = b
        least.append(cut)
    return least


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """One row per document: doc_id, spans (by start, then kind), encodings of the added ones apart in ``candidates``."""
    scanned = base.Scratch(docs.sparkSession, "secrets").table(scan(docs, id_col, text_col))
    least = thresholds(scanned, fdr)
    hit = F.filter("candidates", lambda c: c.p_bin >= F.element_at(F.array(*map(F.lit, least)), c.length_class + 1))
    added = F.transform(hit, lambda c: F.struct(F.lit("random").alias("kind"), c.start.alias("start"), c.end.alias("end")))
    order = F.array_sort(
        F.concat("spans", added),
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(_rank(a["kind"]) - _rank(b["kind"])),
    )
    return scanned.select("doc_id", order.alias("spans"), "candidates")


def _rank(kind):
    return F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; n_chars, if there, follows."""
    scanned = base.Scratch(docs.sparkSession, "secrets").table(scan(docs, id_col, text_col))
    least = thresholds(scanned, fdr)
    k = docs.columns.index(text_col)

    def run(batches):
        base.cached()
        for batch in batches:
            new = []
            for t in batch.column(k).to_pylist():
                if t:
                    spans = base_spans(t)
                    spans += [(c["start"], "random", c["end"]) for c in candidates(t, spans) if c["p_bin"] >= least[c["length_class"]]]
                    if spans:
                        parts, at = [], 0
                        for a, _, b in sorted(spans):
                            if a >= at:
                                parts += [t[at:a], mark]
                            at = max(at, b)
                        t = "".join([*parts, t[at:]])
                new.append(t)
            yield batch.set_column(k, batch.schema.field(k), pa.array(new, batch.schema.field(k).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns and text_col != "n_chars":
        same = F.col("n_chars").isNull() | F.col(text_col).isNull()
        out = out.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length(text_col)).cast(docs.schema["n_chars"].dataType))
    return out


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(base.read(spark, sf_dir, "documents"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    own = F.filter("spans", lambda s: s.kind != "random")
    n = [F.size(F.filter(F.col("spans.kind"), lambda s: s == kind)).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]
    return found.select("doc_id", *n, F.sha2(line(own), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
