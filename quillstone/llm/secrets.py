"""Secret scan: three fixed patterns, and random strings found by how badly a public BPE vocabulary compresses them.

Text a vocabulary was made for needs one token for several characters; a random string needs one for one or two.
Runs of credential characters, less what the patterns found, are reported if their characters-per-token ratio is low;
of a run that is not, the parts between slashes and equals signs are looked at, and of those the parts between dots,
dashes and underscores. Known digests (hex of a digest's length), UUIDs, plain numbers, dates and versions are left out.

Null and empty texts have no spans. Spans are in code points of the whole text, end exclusive; repeated rows each
get their own row. One narrow stage: no shuffle, and a worker holds one chunk of texts at a time.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from quillstone.llm.arrays import chunks, texts

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
#: A run is taken whole, then cut at the first kind of separator, then at the second.
PARTS = (re.compile(r"[^/=]+"), re.compile(r"[A-Za-z0-9+]+"))
SEPARATORS = "._=/+-"
MIN_ASSIGN = 12
#: Hex digits of md5, sha1, sha224, sha256, sha384 and sha512 digests.
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
KNOWN = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-9._/+=-]+")
HEX_ONLY = re.compile(r"[0-9A-Fa-f]+")


@dataclass(frozen=True)
class SecretScan:
    """least: characters of a run with letters and digits; max_ratio: characters per token below which it is random.
    least_alpha, max_alpha_ratio: the same for letters only. Of random strings over a-z the ratio is 1.67 on average, of
    letters and digits 1.33; words of that many letters have 2 or more."""

    vocabulary: str
    least: int = 16
    max_ratio: float = 1.8
    least_alpha: int = 20
    max_alpha_ratio: float = 1.85


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tiktoken encoding of a file of ranks, once per process."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns. {n,} in ACCESS and HEX equals matching all and dropping the short ones,
    as a match that fails there holds no longer one; ASSIGN's failing matches use up text, so they are dropped after."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def is_random(run: str, scan: SecretScan) -> bool:
    if KNOWN.fullmatch(run) or (len(run) in DIGEST_LENGTHS and HEX_ONLY.fullmatch(run)):
        return False
    alpha = not any(c.isdigit() for c in run)
    if len(run) < (scan.least_alpha if alpha else scan.least):
        return False
    return len(run) < (scan.max_alpha_ratio if alpha else scan.max_ratio) * len(encoding(scan.vocabulary).encode_ordinary(run))


def random_parts(text: str, start: int, end: int, scan: SecretScan, level: int = 0) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of the random parts of a run."""
    while start < end and text[end - 1] in SEPARATORS:
        end -= 1
    while start < end and text[start] in SEPARATORS:
        start += 1
    if end - start < scan.least:
        return
    if is_random(text[start:end], scan):
        yield start, 3, end
    elif level < len(PARTS) and not KNOWN.fullmatch(text, start, end):
        for m in PARTS[level].finditer(text, start, end):
            yield from random_parts(text, m.start(), m.end(), scan, level + 1)


def random_spans(text: str, base: list[tuple[int, int, int]], scan: SecretScan) -> list[tuple[int, int, int]]:
    """Base spans are in ascending order of their starts; one pass over them, put together, and the runs."""
    taken: list[tuple[int, int]] = []
    for start, _, end in base:
        if taken and start <= taken[-1][1]:
            taken[-1] = (taken[-1][0], max(taken[-1][1], end))
        else:
            taken.append((start, end))
    found, at = [], 0
    for m in RUN.finditer(text):
        start, end = m.span()
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        here = at
        while here < len(taken) and taken[here][0] < end:
            found += random_parts(text, start, taken[here][0], scan)
            start = taken[here][1]
            here += 1
        found += random_parts(text, start, end, scan)
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_spans string, spans string"


def scan_secrets(docs: DataFrame, scan: SecretScan) -> DataFrame:
    """doc_id, text -> a row per document with its counts and spans (`kind:start:end`, by start, comma-joined)."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts(part.column("text")).to_pylist(), strict=True):
                base = pattern_spans(text)
                extra = random_spans(text, base, scan)
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((doc_id, *n, len(extra), joined(base), joined(sorted(base + extra))))
            types = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def redact(text: str, spans: str, mark: str = "[secret]") -> str:
    """The text with its spans (as scan_secrets() gives them) replaced; overlapping ones become one mark."""
    out, at = [], 0
    for item in spans.split(",") if spans else ():
        start, end = map(int, item.rsplit(":", 2)[1:])
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redacted(text: str, scan: SecretScan) -> str:
    """The text without its secrets."""
    base = pattern_spans(text)
    return redact(text, joined(sorted(base + random_spans(text, base, scan))))
