"""Secret scans: fixed patterns, and a battery of randomness tests for anything else.

Candidates are long runs of one encoding's characters: hexadecimal, base32, base36
of one case, base58, base62 or base64. A candidate must look random in its own
encoding, the smallest that holds it (chi-squared uniformity over the alphabet, the
share of digits, runs above and below the middle, serial correlation, combined)
and must not look like text: its likelihood ratio of uniform against fixed
letter models of plain and of all-capitals text is an e-value, which grows with length. Of a document's
candidates those are taken that the e-value form of the step-up procedure accepts
at the false-discovery level.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm.row_types import with_id

#: The patterns, their kinds and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
KINDS = ("assign", "access", "hex", "random")
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base58": "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Fixed values of the text model: the share of each class, and of each small letter in hundredths of that class.
CLASSES = {"lower": 0.93, "upper": 0.03, "digit": 0.02, "other": 0.02}
LETTERS = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (12.7, 9.1, 8.2, 7.5, 7, 6.7, 6.3, 6.1, 6, 4.3, 4, 2.8, 2.8, 2.4, 2.4, 2.2, 2, 2, 1.9, 1.5, 1, 0.8, 0.2, 0.2, 0.1, 0.1), strict=True))
#: The randomness tests' combined level, and the false-discovery level.
RANDOM_LEVEL, DISCOVERY_LEVEL = 1e-3, 1e-3


def encoding(text: str) -> str | None:
    """The smallest alphabet that holds all characters."""
    chars = set(text)
    return next((k for k, a in ALPHABETS.items() if chars <= set(a)), None)


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _share(k: int, n: int, p: float) -> float:
    """Two-sided p-value of ``k`` of ``n`` at rate ``p``: exact binomial tails, normal ones for long texts."""
    if n > 512:
        return _normal_tail((k - n * p) / math.sqrt(n * p * (1 - p)))
    mass = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
    return min(1.0, 2 * min(sum(mass[: k + 1]), sum(mass[k:])))


def randomness(text: str, alphabet: str) -> float:
    """Combined p-value of the battery, small where ``text`` isn't a uniform draw from ``alphabet``: the least of four, times four."""
    n, a = len(text), len(alphabet)
    value = [alphabet.index(c) for c in text]
    counts = [0] * a
    for v in value:
        counts[v] += 1
    chi = sum(c * c for c in counts) * a / n - n
    df = a - 1
    # Sparse counts make the statistic's spread differ from the table's; its exact mean and variance are used.
    spread = math.sqrt(2 * df * (n - 1) / n) or 1.0
    p_chi = _normal_tail(max(0.0, (chi - df) / spread))
    high = [v * 2 >= a for v in value]
    ones = sum(high)
    zeros = n - ones
    if ones and zeros:
        runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
        mean = 1 + 2 * ones * zeros / n
        var = (mean - 1) * (mean - 2) / max(1, n - 1)
        p_runs = _normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 0.5 ** (n - 1)
    centre = sum(value) / n
    total = sum((v - centre) ** 2 for v in value)
    p_serial = _normal_tail(math.sqrt(n) * sum((x - centre) * (y - centre) for x, y in zip(value, value[1:])) / total) if total else 0.0
    p_digits = _share(sum(c.isdigit() for c in text), n, sum(c.isdigit() for c in alphabet) / a)
    return min(1.0, 4 * min(p_chi, p_runs, p_serial, p_digits))


def log_evidence(text: str, size: int) -> float:
    """Log of the likelihood ratio of a uniform draw against text, plain or in capitals, whichever fits better, less what the choice among the alphabets is worth."""
    rest = {"upper": 26, "digit": 10, "other": 4}

    def ratio(t: str) -> float:
        out = 0.0
        for c in t:
            kind = "lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if c.isdigit() else "other"
            model = CLASSES["lower"] * LETTERS[c] / 100 if kind == "lower" else CLASSES[kind] / rest[kind]
            out -= math.log(size * model)
        return out

    return min(ratio(text), ratio(text.swapcase())) - math.log(len(ALPHABETS))


def battery(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of random-looking runs that touch none of ``taken``."""
    tried = []
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        body = m[0].rstrip("=")
        # Letters of one case throughout are words or names at any length; digits alone are numbers.
        if body.isalpha() and (body[1:].islower() or body.isupper()) or body.isdigit() or any(s < end and start < e for s, e in taken):
            continue
        if (name := encoding(body)) and randomness(body, ALPHABETS[name]) >= RANDOM_LEVEL:
            tried.append((log_evidence(body, len(ALPHABETS[name])), start, end))
        else:
            tried.append((-math.inf, start, end))
    tried.sort(key=lambda x: (-x[0], x[1]))
    best = max((k for k, x in enumerate(tried, 1) if x[0] >= math.log(len(tried) / (k * DISCOVERY_LEVEL))), default=0)
    return [(s, e) for _, s, e in tried[:best]]


def scan(text: str | None) -> dict:
    """``base`` and ``added`` spans (kind, start, end) of a whole text; null has none."""
    text = text or ""
    base = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [("access", *m.span()) for m in ACCESS.finditer(text)]
    base += [("hex", *m.span()) for m in HEX.finditer(text)]
    order = {k: i for i, k in enumerate(KINDS)}
    base.sort(key=lambda x: (x[1], order[x[0]], x[2]))
    added = [("random", s, e) for s, e in battery(text, [(s, e) for _, s, e in base])]
    return {"base": base, "added": added, "all": sorted(base + added, key=lambda x: (x[1], order[x[0]], x[2]))}


def secret_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_assign, n_access, n_hex, n_random, base_spans, spans)`` of every row; spans as ``kind:start:end`` in code points, joined by commas. Null and empty texts have no spans; rows may repeat, ids too or be null, each row is scanned by itself. A text is scanned whole in one task, in memory that grows with its length. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan(t.as_py()) for t in b.column(1)]
            counts = [pa.array([sum(s[0] == k for s in f["all"]) for f in found], pa.int64()) for k in KINDS]
            joined = [pa.array([",".join(f"{k}:{s}:{e}" for k, s, e in f[x]) for f in found], pa.string()) for x in ("base", "all")]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, *joined], names=[id_col, *[f"n_{k}" for k in KINDS], "base_spans", "spans"])

    return docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(run, with_id(docs, id_col, "n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_spans string, spans string"))
