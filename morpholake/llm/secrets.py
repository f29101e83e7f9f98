"""Secret scan: Aho-Corasick finds keywords, anchored expressions run only at hits, checksums decide where tokens carry one.

Kinds: assign (a keyword, a separator, a value), access (AKIA ids), github and npm (tokens whose last six base-62 digits
are the CRC-32 of the rest), hex (runs of 16+ hex digits: no keyword can announce those, so one expression scans for them).
The keyword automaton is small and fixed; each text is scanned alone, so nothing is shuffled.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import column, map_batches, pieces, texts

KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
ASSIGN_CHARS, ACCESS_CHARS = 12, 18
BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase
KEYWORDS = {w: "assign" for w in ("password", "passwd", "secret", "token", "apikey", "api_key")} | {"akia": "access", "npm_": "npm"} | {f"gh{c}_": "github" for c in "pousr"}
LOWER = {c: c + 32 for c in range(65, 91)}


def base62(n: int, digits: int = 6) -> str:
    out = ""
    for _ in range(digits):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def checksum_holds(body: str, tail: str) -> bool:
    return base62(zlib.crc32(body.encode())) == tail


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for w, kind in KEYWORDS.items():
        out.add_word(w, (kind, len(w)))
    out.make_automaton()
    return out


def find(text: str, keywords: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then by the order of KINDS; code points, end exclusive.

    Each kind's matches are leftmost and do not overlap; a match that fails its length or checksum still uses up its text
    for assign and access, as if one expression had run over the whole text."""
    low = text.lower()
    if len(low) != len(text):  # some letters change length; A-Z alone never do
        low = text.translate(LOWER)
    hits = sorted((end - n + 1, kind) for end, (kind, n) in keywords.iter(low))
    ends = dict.fromkeys(KINDS, 0)
    found = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    for at, kind in hits:
        if at < ends[kind]:
            continue
        m = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM}[kind].match(text, at)
        if not m:
            continue
        if kind == "assign":
            ok = len(m[2]) >= ASSIGN_CHARS
        elif kind == "access":
            ok = m.end() - at >= ACCESS_CHARS
        else:
            ok = checksum_holds(m[1], m[2])
            if not ok:
                continue
        ends[kind] = m.end()
        if ok:
            found.append((at, m.end(), kind))
    place = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda x: (x[0], place[x[2]], x[1]))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)]), False)


def scan(docs: DataFrame, keep: list[str], text: str = "text", redact: str | None = None, made: tuple[str, str] = ("secret_spans", "redacted")) -> DataFrame:
    """keep columns and those that made names: spans (kind, start, end) and, with redact, the text with each span's union replaced.

    A null text has no spans and stays null when redacted; an empty text and an empty table give no spans and no rows.
    Repeated rows each keep their own.  keep must not name a made column (ValueError); other columns are not read."""
    if clash := {c.lower() for c in made} & {c.lower() for c in keep}:
        raise ValueError(f"columns {sorted(clash)} are made by this operator")
    source = docs.select(*(column(c) for c in dict.fromkeys([*keep, text])))
    fields = [T.StructField(made[0], SPANS, False)] + [T.StructField(made[1], T.StringType())] * (redact is not None)
    schema = T.StructType([source.schema[c] for c in keep] + fields)
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def blank(x: str, spans: list[tuple[int, int, str]]) -> str:
        out, at = [], 0
        for a, b, _ in spans:
            if a >= at:
                out += [x[at:a], redact]
            at = max(at, b)
        return "".join([*out, x[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in pieces(batches):
            spans = [find(x, keywords) for x in texts(batch, text)]
            cols = [*(batch.column(c) for c in keep), pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in s] for s in spans], arrow)]
            if redact is not None:
                cols.append(pa.array([x if x is None else blank(x, s) for x, s in zip(batch.column(text).to_pylist(), spans, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return map_batches(source, run, schema)
