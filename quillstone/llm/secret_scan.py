"""Secret scan: fixed patterns, and a battery of randomness tests for unknown formats.

One pass (``scan``) reads every whole text.  It finds the pattern spans (assign,
access, hex) and takes each run of 20 or more ``[A-Za-z0-9+/_-]`` that overlaps none of
them as a candidate.  For a candidate the encoding is inferred (the smallest alphabet
that holds it).  A run with both ``+`` or ``/`` and ``-`` or ``_`` is of no usual alphabet
and is cut first: its longest part of base64 or base64url becomes a candidate, then those
of what is left on both sides; if no part is 20 long, the run is judged whole over all 66
symbols.  Three tests ask whether its symbols are drawn uniformly and independently from
that alphabet: chi-squared uniformity, runs about the median symbol, and lag-1 serial
correlation.  Their least p-value, times three, is the battery's.

Random strings pass the battery; ordinary ones pass it seldom if they are long, often if
they are short.  How often is measured, not assumed: for each candidate the battery also
judges ``DECOYS`` stretches of the document's own other text, brought into the same
alphabet and of the same length.  Per encoding and length band the decoys' battery values
are counted over the whole corpus, and a candidate's p-value is the share of them that
look as random as it does.  On these p-values Benjamini-Hochberg holds the share of
ordinary runs among the spans added at ``fdr``, in each such stratum by itself, so that
many ordinary runs of one kind don't hide a few random ones of another.  All counts are of every document, in
bins, so what reaches the driver has a fixed size.

Defined results.  Null text counts as empty and has no spans.  Offsets are code
points, end exclusive.  Pattern spans always stay.  A document whose other text is
shorter than the candidate gives no decoys for it; a stratum without decoys adds nothing.
Decoys of runs over 4096 symbols have 4096.  Equal battery values are added or left
together.  Texts of any length are read whole.  Repeated rows are independent.  An empty
table gives an empty result.  Only the identifier and text columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quillstone.llm.rows import free_names, map_rows
from quillstone.sources.workspace import materialise

# Fixed patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
PARTS = (re.compile(r"[A-Za-z0-9+/]{20,}"), re.compile(r"[A-Za-z0-9_-]{20,}"))
KINDS = ("assign", "access", "hex", "random")

ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    # For runs of both of the last two whose parts are all short.
    "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
INDEX = {name: {c: i for i, c in enumerate(letters)} for name, letters in ALPHABETS.items()}
SETS = {name: frozenset(letters) for name, letters in ALPHABETS.items()}
#: Lower ends of the length bands.
BANDS = (20, 32, 48, 80, 160)
#: Stretches of ordinary text that a candidate is held against.
DECOYS = 199
DECOY_SYMBOLS = 4096
#: Battery values are binned by tenths of -log10, up to this bin.
TOP_BIN = 400
#: A candidate of a larger bin is not random: its battery value is under 0.001.
RANDOM_BIN = 30

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
CAND = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.string()), ("bin", pa.int32()), ("decoys", pa.list_(pa.int32()))])
SCAN = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("base", pa.list_(SPAN)), ("candidates", pa.list_(CAND))])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by start, then kind as listed."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    # A run that is too short holds no run that is long enough, so the bounds in the
    # two patterns find what "match greedily, then drop short matches" finds.
    found += [("access", *m.span()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def infer_encoding(token: str) -> str | None:
    """The smallest alphabet that holds every symbol of the token."""
    symbols = set(token)
    return next((name for name, letters in SETS.items() if symbols <= letters), None)


def tail(z: np.ndarray) -> np.ndarray:
    """P(|Z| >= |z|) of a standard normal."""
    return np.array([math.erfc(abs(x) / math.sqrt(2)) for x in z])


def codes(text: str, encoding: str) -> np.ndarray:
    """Indexes in the alphabet of those symbols of the text that it holds."""
    index = INDEX[encoding]
    return np.array([index[c] for c in text if c in index], np.int64)


def battery(x: np.ndarray, q: int) -> np.ndarray:
    """For each row of symbol indexes below q the p-value of "uniform and independent"."""
    m, n = x.shape
    counts = np.bincount((x + q * np.arange(m)[:, None]).ravel(), minlength=m * q).reshape(m, q)
    chi2 = ((counts - n / q) ** 2).sum(axis=1) * q / n
    z_chi = (chi2 - (q - 1)) / math.sqrt(2 * (q - 1) * (1 - 1 / n))
    p_chi = np.array([0.5 * math.erfc(z / math.sqrt(2)) for z in z_chi])  # one-sided: only too uneven counts against it
    above = x > (q - 1) / 2
    n1 = above.sum(axis=1)
    runs = 1 + (above[:, 1:] != above[:, :-1]).sum(axis=1)
    mean = 1 + 2 * n1 * (n - n1) / n
    spread = np.sqrt(np.maximum(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
    p_runs = np.where((n1 > 0) & (n1 < n), tail((runs - mean) / spread), 0.0)
    centred = x - x.mean(axis=1, keepdims=True)
    power = (centred**2).sum(axis=1)
    serial = (centred[:, 1:] * centred[:, :-1]).sum(axis=1) / np.maximum(power, 1e-9)
    p_serial = np.where(power > 0, tail((serial + 1 / n) * math.sqrt(n)), 0.0)
    return np.minimum(1.0, 3 * np.minimum(np.minimum(p_chi, p_runs), p_serial))


def bins(p: np.ndarray) -> np.ndarray:
    return np.minimum(TOP_BIN, np.floor(-10 * np.log10(np.maximum(p, 1e-60)))).astype(np.int64)


def decoy_bins(rest: str, token: str, encoding: str) -> list[int]:
    """Binned battery values of stretches of ordinary text like the token; none if it is too short."""
    letters = SETS[encoding]
    if not any(c.islower() for c in letters):
        rest = rest.upper()
    elif not any(c.isupper() for c in letters):
        rest = rest.lower()
    x, n = codes(rest, encoding), min(len(token), DECOY_SYMBOLS)
    if len(x) < n:
        return []
    starts = np.unique(np.linspace(0, len(x) - n, DECOYS).astype(np.int64))
    return bins(battery(x[starts[:, None] + np.arange(n)], len(letters))).tolist()


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple]:
    """start, end, stratum, bin, decoys' bins of each candidate that overlaps no base span."""
    found, at, rest = [], 0, []
    taken = [(a, b) for _, a, b in base]
    for m in CANDIDATE.finditer(text):
        taken.append(m.span())
        found += [(m.start() + start, token) for start, token in one_alphabet(m[0])]
    found = [(a, t) for a, t in found if not any(s < a + len(t) and a < e for _, s, e in base)]
    if not found:
        return []
    for start, end in sorted(taken):
        rest.append(text[at:start])
        at = max(at, end)
    ordinary, rows = "".join([*rest, text[at:]]), []
    for start, token in found:
        encoding = infer_encoding(token)
        band = max(b for b in BANDS if b <= len(token))
        own = int(bins(battery(codes(token, encoding)[None, :], len(SETS[encoding])))[0])
        rows.append((start, start + len(token), f"{encoding}/{band}", own, decoy_bins(ordinary, token, encoding)))
    return rows


def one_alphabet(run: str) -> list[tuple[int, str]]:
    """Start and text of the disjoint parts in which a run is judged, in order."""
    parts, todo = [], [(0, run)]
    while todo:
        at, rest = todo.pop()
        if len(rest) < BANDS[0]:
            continue
        if infer_encoding(rest) != "mixed":
            parts.append((at, rest))
            continue
        best = max((m for p in PARTS for m in p.finditer(rest)), key=lambda m: len(m[0]), default=None)
        if best is None:
            parts.append((at, rest))
        else:
            parts.append((at + best.start(), best[0]))
            end = best.start() + len(best[0])
            todo += [(at, rest[: best.start()]), (at + end, rest[end:])]
    return sorted(parts)


def scan_row(doc_id, text_hash, text) -> Iterator[tuple]:
    text = text or ""
    base = base_spans(text)
    names = [f.name for f in CAND]
    yield doc_id, text_hash, [{"kind": k, "start": a, "end": b} for k, a, b in base], [dict(zip(names, c, strict=True)) for c in candidates(text, base)]


def cutoff_bins(counts: list[Row], fdr: float) -> dict[str, int]:
    """Per stratum the largest bin whose candidates Benjamini-Hochberg accepts as random.

    ``counts``: stratum, bin, n (candidates), decoys.  There are at most len(ALPHABETS) *
    len(BANDS) strata of TOP_BIN + 1 bins.
    """
    own, decoys = defaultdict(Counter), defaultdict(Counter)
    for r in counts:
        own[r["stratum"]][r["bin"]] += r["n"]
        decoys[r["stratum"]][r["bin"]] += r["decoys"]
    cut = {}
    for stratum, found in own.items():
        total, m, taken, so_far, null = sum(decoys[stratum].values()), sum(found.values()), 0, 0, sorted(decoys[stratum].items(), reverse=True)
        for b in sorted(k for k, n in found.items() if n and k <= RANDOM_BIN):
            while null and null[-1][0] <= b:
                so_far += null.pop()[1]
            taken += found[b]
            if (1 + so_far) / (1 + total) <= fdr * taken / m:
                cut[stratum] = b
    return cut


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pass over the texts, written to the shared folder: base spans and candidates."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return materialise(map_rows(rows, ["doc_id", "text_hash", "text"], scan_row, SCAN), "secret-scan")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.01) -> DataFrame:
    """One row per document: doc_id, text_hash (xxhash64), base, spans: arrays of
    struct<kind,start,end>; spans include base."""
    scanned = scan(docs, id_col, text_col)
    each = scanned.select(F.explode("candidates").alias("c"))
    own = each.select("c.stratum", "c.bin", F.lit(1).alias("n"), F.lit(0).alias("decoys"))
    null = each.select("c.stratum", F.explode("c.decoys").alias("bin"), F.lit(0).alias("n"), F.lit(1).alias("decoys"))
    counts = own.union(null).groupBy("stratum", "bin").agg(F.sum("n").alias("n"), F.sum("decoys").alias("decoys")).collect()
    cut = F.create_map(*[F.lit(x) for item in (cutoff_bins(counts, fdr) or {"": -1}).items() for x in item])

    def flagged(c):
        return c["bin"] <= F.coalesce(F.try_element_at(cut, c["stratum"]), F.lit(-1))

    extra = F.transform(F.filter("candidates", flagged), lambda c: F.struct(F.lit("random").alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return scanned.select("doc_id", "text_hash", "base", ordered(F.concat("base", extra)).alias("spans"))


def ordered(spans):
    """Spans by start, then kind as listed."""
    kinds = F.array(*map(F.lit, KINDS))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def redact(docs: DataFrame, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.01) -> DataFrame:
    """``docs`` with every found span of the text replaced by ``mark``; all columns stay.

    Rows are matched to their spans by identifier (null equals null) and text, so rows
    that share an identifier lose their own secrets only.
    """
    key, hashed, spans = free_names(docs, "id", "hash", "spans")
    found = find_secrets(docs, id_col, text_col, fdr).filter(F.size("spans") > 0)
    found = found.groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(hashed)).agg(F.first("spans").alias(spans))
    same = (F.xxhash64(text_col) == F.col(hashed)) & F.col(id_col).cast("long").eqNullSafe(F.col(key))
    masked = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(mask(F.col(text_col), F.col(spans), mark))
    return docs.join(found, same, "left").withColumn(text_col, masked).drop(key, hashed, spans)


def mask(text, spans, mark: str):
    """Cut the spans out of the text from left to right; overlapping spans leave one mark."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(acc, s):
        gap = F.substring(text, acc["at"].cast("int") + 1, F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        inside = s["start"] < acc["at"]
        out = F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(mark)))
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    return F.aggregate(ordered(spans), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text))))


def joined(spans: str):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
