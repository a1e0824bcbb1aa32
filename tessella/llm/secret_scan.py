"""Secrets in texts: three patterns that stand alone, and parts of credentials that count only together.

Strong spans (assign, access, hex) are always reported. Weak candidates - an
identifier named as such, a random-looking string, an endpoint - are common in
harmless texts. They are reported only where complementary parts lie in one
scope: a random-looking string with an identifier, or a strong secret or such a
string with an endpoint that an identifier goes with. A scope is a paragraph
(blank lines part them), and parts must begin within `reach` code points of
each other. The parts of a text are joined as intervals, by one sweep in order
of their starts; the text is the only group, so no group outgrows a row.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame

from tessella.llm.common import map_rows

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
IDENTIFIER = re.compile(r"""\b(?:client_?id|access_?key_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{4,})""", re.IGNORECASE | re.ASCII)
ENDPOINT = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]{4,}")
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
SCOPE_END = re.compile(r"\n[ \t]*\n")
KINDS = ("assign", "access", "hex", "identifier", "random", "endpoint")
REACH = 400

Span = tuple[int, int, int, int]  # start, kind, end, start of the secret value


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each strong kind that do not overlap within the kind."""
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def looks_random(value: str) -> bool:
    """Letters of both cases with digits, and an entropy of 3.5 bits a character or more."""
    if not (any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value)):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= 3.5


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak candidates that complementary parts of the same scope confirm; none overlaps a strong span."""
    has_url = "://" in text
    identifiers = [(m.start(), 3, m.end(), m.start(1)) for m in IDENTIFIER.finditer(text)] if "=" in text or ":" in text else []
    if not (identifiers or has_url or any(k == 1 for _, k, _, _ in base)):
        return []
    ends = [m.start() for m in SCOPE_END.finditer(text)]
    scope = lambda at: bisect_right(ends, at)
    taken = sorted((s, e) for s, _, e, _ in base)
    starts = [s for s, _ in taken]
    reached = list(itertools.accumulate((e for _, e in taken), max))  # the farthest end of the strong spans so far

    def free(s: int, e: int) -> bool:
        i = bisect_left(starts, e)
        return i == 0 or reached[i - 1] <= s

    weak = [x for x in identifiers if free(x[0], x[2])]
    weak += [(m.start(), 4, m.end(), m.start()) for m in RANDOM.finditer(text) if looks_random(m.group()) and free(*m.span())]
    weak += [(m.start(), 5, m.end(), m.start()) for m in ENDPOINT.finditer(text) if has_url and free(*m.span())]
    parts = sorted([*base, *weak])
    at = [p[0] for p in parts]
    last = {role: [-1] * len(parts) for role in ("id", "secret", "url")}  # the nearest part of the role at or before each part
    after = {role: [-1] * len(parts) for role in ("id", "secret", "url")}
    roles = {0: ("secret",), 1: ("id",), 2: ("secret",), 3: ("id",), 4: ("secret",), 5: ("url",)}
    for seen, order in ((last, range(len(parts))), (after, range(len(parts) - 1, -1, -1))):
        near = {"id": -1, "secret": -1, "url": -1}
        for i in order:
            for role in roles[parts[i][1]]:
                near[role] = i
            for role in near:
                seen[role][i] = near[role]

    def has(i: int, role: str) -> bool:
        return any(j >= 0 and abs(at[j] - at[i]) <= reach and scope(at[j]) == scope(at[i]) for j in (last[role][i], after[role][i]))

    keep = {3: lambda i: has(i, "secret"), 4: lambda i: has(i, "id"), 5: lambda i: has(i, "id") and has(i, "secret")}
    return [p for i, p in enumerate(parts) if p[1] > 2 and keep[p[1]](i)]


def spans(text: str | None, reach: int = REACH) -> tuple[list[Span], list[Span]]:
    """(strong spans, all spans), by start and kind. A null text has none."""
    base = base_spans(text or "")
    return base, sorted([*base, *linked_spans(text or "", base, reach)])


def written(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in found)


def redact(text: str, found: list[Span], mark: str = "[SECRET]") -> str:
    """The text with the value of each span replaced; values that overlap or touch are replaced once."""
    out, at = [], 0
    for start, end in sorted((v, e) for _, _, e, v in found):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(df: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of doc_id, text.

    Null and empty texts have no spans (the hash is that of the empty text).
    Repeated rows each have their result; an empty table gives no rows; only
    doc_id and text are read. Texts of any length are scanned whole.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                base, found = spans(text, reach)
                n = Counter(k for _, k, _, _ in base)
                for k, v in zip(out, (doc, n[0], n[1], n[2], hashlib.sha256(written(base).encode()).hexdigest(), written(found)), strict=True):
                    out[k].append(v)
            yield out

    return map_rows(df.select("doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(df: DataFrame, reach: int = REACH) -> DataFrame:
    """df with the secrets of text replaced and, where there is such a column, n_chars counted again for texts that changed. Null texts stay null."""
    names = df.columns

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for i, text in enumerate(b["text"]):
                if text and (found := spans(text, reach)[1]):
                    b["text"][i] = redact(text, found)
                    if "n_chars" in b:
                        b["n_chars"][i] = len(b["text"][i])
            yield {n: b[n] for n in names}

    return map_rows(df, run, df.schema)


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
