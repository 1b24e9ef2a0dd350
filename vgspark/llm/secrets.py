"""Secret scan with multipart credential linking."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMED = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
#: Weak parts: each is far too common to be reported alone.
WEAK_ID = re.compile(r"""(?<![A-Za-z0-9_])(?:user(?:_?name)?|client_?id|account(?:_?id)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", re.I | re.A)
WEAK_KEY = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/]{32,88}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"(?:https?|ftp|s3|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:@/?#&=%+-]{4,}")
#: A scope ends at a blank line.
BREAK = re.compile(r"\n[\x20\t\r]*\n")
KINDS = ("assign", "access", "hex", "linked_id", "linked_key", "linked_endpoint")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if NAMED.search(text):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def linked_spans(text: str, base: list[tuple[int, int, str]], gap: int) -> list[tuple[int, int, str]]:
    """Weak candidates that have complementary parts at most ``gap`` code points away in their scope.

    Parts are identifiers, keys and endpoints. A weak key needs an identifier or an
    endpoint; a weak identifier or endpoint needs a key (assigned, hex or weak).
    """
    ends = "://" in text
    ids = [(*m.span(), "linked_id") for m in WEAK_ID.finditer(text)] if ends or base or "=" in text or ":" in text else []
    if not ids and not ends and not any(k == "access" for *_, k in base):
        return []
    points = [(*m.span(), "linked_endpoint") for m in ENDPOINT.finditer(text)] if ends else []
    mixed = (lambda s: any(c.isdigit() for c in s) and any("a" <= c <= "z" for c in s) and any("A" <= c <= "Z" for c in s))
    taken = sorted((s, e) for s, e, _ in base)
    reach = [-1, *accumulate((e for _, e in taken), max)]  # where the first spans end at the latest

    def free(span):  # not part of a base span
        return reach[bisect_left(taken, (span[1],))] <= span[0]

    keys = [x for m in WEAK_KEY.finditer(text) if mixed(m[0]) and free(x := (*m.span(), "linked_key"))]
    breaks = [m.start() for m in BREAK.finditer(text)]
    role = {"assign": "key", "hex": "key", "linked_key": "key", "access": "id", "linked_id": "id", "linked_endpoint": "point"}
    parts = sorted([*base, *filter(free, ids), *keys, *filter(free, points)])
    found, near = set(), {"key": [], "id": [], "point": []}
    for p in parts:  # an interval join by one sweep in order of starts
        scope = bisect_left(breaks, p[0])
        for other in near:
            near[other] = [q for q in near[other] if q[1] + gap >= p[0] and bisect_left(breaks, q[0]) == scope]
        mine = role[p[2]]
        for other in ("id", "point") if mine == "key" else ("key",):
            if near[other]:
                found |= {p, *near[other]}
                near[other] = [max(near[other], key=lambda q: q[1])]  # the rest are reported already
        near[mine].append(p)
    return [x for x in found if x[2].startswith("linked")]


def _scan(batches, gap):
    order = {k: i for i, k in enumerate(KINDS)}
    for b in batches:
        spans = []
        for text in b.column(1).to_pylist():
            base = base_spans(text or "")
            found = sorted(base + (linked_spans(text, base, gap) if text else []), key=lambda x: (x[0], order[x[2]], x[1]))
            spans.append([{"kind": k, "start": s, "end": e} for s, e, k in found])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["doc_id", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = 300) -> DataFrame:
    """``(doc_id, spans array<struct<kind, start, end>>)`` in code points, end exclusive, one row per input row.

    Spans are in order of start, then of kind as in ``KINDS``. A null or empty text has
    none, an empty table no rows. Texts are scanned whole, whatever their length; parts that start
    together are ordered by their ends. Repeated rows each give a row; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _scan(it, gap), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = 300, mark: str = "[SECRET]") -> DataFrame:
    """``(doc_id, text)`` with every span that ``find_secrets`` reports replaced by ``mark``; overlapping spans become one."""

    def run(batches):
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                if text is not None:
                    base = base_spans(text)
                    done, kept = 0, []
                    for s, e, _ in sorted(base + linked_spans(text, base, gap)):
                        if s >= done:
                            kept += [text[done:s], mark]
                        done = max(done, e)
                    text = "".join([*kept, text[done:]])
                out.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")



def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    text = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    base = "filter(spans, x -> x.kind IN ('assign', 'access', 'hex'))"
    counts = [f"CAST(size(filter(spans, x -> x.kind = '{k}')) AS BIGINT) AS n_{k}" for k in ("assign", "access", "hex")]
    linked = "CAST(size(filter(spans, x -> x.kind LIKE 'linked%')) AS BIGINT) AS n_linked"
    return found.selectExpr("doc_id", *counts, f"sha2({text.format(base)}, 256) AS base_sha256", f"{text.format('spans')} AS spans", linked)
