"""Secret scans (operator 2): patterns, and sliding-window Shannon entropy.

Base patterns give assign, access and hex spans. Besides, every run of 20 or more token
characters is a candidate, whatever base spans it touches: for each character class (hex
digits, base64 letters) a window slides over the candidate's stretches of that class. The
entropy follows from the sum of c * log2(c) over the counts c of the window's characters; a
step changes two counts, so a window costs the same at any length. Windows over the class's
threshold are united to spans, unless the allow-list knows what they are. A value that a
base pattern finds as well has both spans.

Scale: a map over rows, whole texts, no shuffle; Arrow batches bound the memory; the time
is linear in a text's length."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

# The contract's patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
# class: (its characters, window, least bits a character)
CLASSES = {
    "hex": (re.compile(r"[0-9a-fA-F]+"), 20, 2.9),
    "base64": (re.compile(r"[A-Za-z0-9+/_=-]+"), 20, 3.7),
}
# What looks random but is public: matched against the whole candidate, then against it
# with what stands before it on its line, at most BEFORE characters.
BEFORE = 16
ALLOW = (
    r"[0-9]+\Z",
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z",
    r"(?i:.{0,16}\b(sha1|sha256|sha384|sha512|md5|commit|rev|etag)[\"']?[:=\s-]\s?).*",
    r"(?i:.*(example|dummy|placeholder|xxxxxx|changeme)).*",
)

_NLOGN = [0.0] + [c * math.log2(c) for c in range(1, 4097)]


def entropy_spans(text: str, window: int, least: float, start: int, end: int) -> list[tuple[int, int]]:
    """United windows within text[start:end] whose entropy is at least ``least`` bits and
    that hold both letters and digits."""
    if end - start < window:
        return []
    counts: dict[str, int] = {}
    total, digits, out = 0.0, 0, []
    limit = window * (math.log2(window) - least) + 1e-9  # entropy >= least, as a bound on total
    for i in range(start, end):
        c = text[i]
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _NLOGN[n + 1] - _NLOGN[n]
        digits += c <= "9" and c >= "0"
        if i - start >= window:
            o = text[i - window]
            n = counts[o]
            counts[o] = n - 1
            total += _NLOGN[n - 1] - _NLOGN[n]
            digits -= o <= "9" and o >= "0"
        if i - start + 1 >= window and total <= limit and 0 < digits < window:
            a, b = i + 1 - window, i + 1
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


# Runs of HEX that are long enough to count; shorter ones aren't even made into matches.
LONG_HEX = re.compile(rf"[0-9a-f]{{{LEAST['hex']},}}")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [("hex", *m.span()) for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def extra_spans(text: str, allow: list[re.Pattern]) -> list[tuple[str, int, int]]:
    """United entropy spans of all candidates that the allow-list doesn't know."""
    out: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        line = max(0, a - BEFORE, text.rfind("\n", max(0, a - BEFORE), a) + 1)
        if any(p.match(m[0]) or p.match(text[line:b]) for p in allow):
            continue
        found = [x for chars, window, least in CLASSES.values() for r in chars.finditer(text, a, b) for x in entropy_spans(text, window, least, *r.span())]
        first = len(out)  # candidates don't touch each other
        for x, y in sorted(found):
            if len(out) > first and x <= out[-1][1]:
                out[-1] = (out[-1][0], max(y, out[-1][1]))
            else:
                out.append((x, y))
    return [("entropy", *s) for s in out]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(text: str | None, allow: list[re.Pattern]) -> tuple[int, int, int, int, str, str]:
    base = base_spans(text) if text else []
    more = extra_spans(text, allow) if text else []
    n = [sum(s[0] == k for s in base) for k in KINDS[:3]]
    every = sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))
    return *n, len(more), joined(base), joined(every)


def find_secrets(docs: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_spans and spans for every row.

    Spans are kind:start:end in code points, end exclusive, by start and then by kind.
    Null text counts as empty and has no span; repeated rows come back as often as they
    are there; ``allow`` suppresses entropy spans only. An empty table gives an empty
    table. Extra columns are left behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [re.compile(p) for p in allow]
        for b in batches:
            cols = list(zip(*(scan(t, known) for t in b.column("text").to_pylist()))) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_spans", "spans"],
            )

    thin = only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), "text")
    return thin.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_spans string, spans string")

