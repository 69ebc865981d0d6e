"""Secret scans with structural confirmation (operator 10).

Base rules are patterns.  Beyond them, runs of base64 or hex are decoded and
reported only if the bytes parse as what they would be: a private key whose
nested lengths add up, or a token whose header names how it is signed.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from binsight.llm.catalog import register
from binsight.llm.common import table

KINDS = ("assign", "access", "hex", "key", "signed")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40})-----([A-Za-z0-9+/=\s\\]+)-----END \1-----")
#: Two parts of a signed token and a third, possibly empty; each run of token characters is matched once.
THREE = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{10,}+)(?=(\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]*))", re.ASCII)
HEAD = re.compile(r"e[wy](?=[A-Za-z0-9_-]{8})")
#: How a JSON object with a first key begins; tried before the parser, whose errors count the lines before them.
OBJECT = re.compile(r"""\{[\x20\t\n\r]*+"(?:[^"\\\x00-\x1F]++|\\.)*+"[\x20\t\n\r]*+:""")
JSON = json.JSONDecoder()
#: What any text with a span has, for RE2: whole texts without it need no closer look.
HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA|[0-9a-f]{24}|[A-Za-z0-9+/_-]{40}|-----BEGIN |e[wy][A-Za-z0-9_-]{8,}\."""


def decoded(run: str) -> Iterator[bytes]:
    """What a run may stand for in hex or in either base64 alphabet."""
    if len(run) % 2 == 0 and re.fullmatch(r"[0-9A-Fa-f]+", run):
        yield bytes.fromhex(run)
    bare = re.sub(r"\\n|\s|=", "", run)
    if len(bare) % 4 != 1:
        try:
            yield base64.b64decode(bare.replace("-", "+").replace("_", "/") + "=" * (-len(bare) % 4), validate=True)
        except binascii.Error:
            return


def _der(b: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values in b[at:end]; None unless their lengths fill it exactly."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, n = b[at], b[at + 1]
        at += 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > end:
                return None
            n = int.from_bytes(b[at:at + width], "big")
            at += width
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


def der_key(b: bytes) -> bool:
    """A private key in DER: PKCS#1, DSA, SEC 1, PKCS#8 or encrypted PKCS#8."""
    if len(b) < 24 or b[0] != 0x30 or not (top := _der(b, 0, len(b))) or len(top) != 1:
        return False
    if not (inner := _der(b, *top[0][1:])):
        return False
    tags = [t for t, _, _ in inner]

    def oid(value):
        parts = _der(b, *value[1:]) if value[0] == 0x30 else None
        return bool(parts) and parts[0][0] == 0x06

    version = inner[0][2] - inner[0][1] == 1 and b[inner[0][1]] in (0, 1) if tags[0] == 0x02 else False
    if version and len(tags) >= 6 and set(tags) == {0x02}:
        return True
    if version and len(tags) >= 2 and tags[1] == 0x04 and set(tags[2:]) <= {0xA0, 0xA1}:
        return len(tags) > 2
    if version and len(tags) >= 3 and tags[2] == 0x04 and oid(inner[1]):
        return True
    return tags == [0x30, 0x04] and oid(inner[0])


def ssh_key(b: bytes) -> bool:
    """A private key of the openssh-key-v1 form whose nested lengths add up."""
    if not b.startswith(b"openssh-key-v1\0"):
        return False
    at, fields = 15, []
    for what in ("text", "text", "text", "count", "text", "text"):
        if at + 4 > len(b):
            return False
        n = int.from_bytes(b[at:at + 4], "big")
        at += 4
        if what == "text":
            if at + n > len(b):
                return False
            fields.append(b[at:at + n])
            at += n
    public = fields[3]
    named = int.from_bytes(public[:4], "big")
    return at == len(b) and 0 < named <= len(public) - 4


def signed_header(run: str) -> bool:
    """Three base64url parts of which the first two are JSON objects, the first naming an algorithm."""
    try:
        head, body = (json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))) for x in run.split(".")[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def _heads(run: str) -> Iterator[int]:
    """Places in a run of token characters from which the rest decodes to what may be a JSON object.

    The run is decoded once for each of the four ways its quadruples may lie,
    and parsed in place, so a long run of beginnings takes no quadratic time.
    """
    tails = {}
    for m in HEAD.finditer(run):
        at, way = m.start(), m.start() % 4
        if way not in tails:
            try:
                rest = run[way:]
                tail = base64.urlsafe_b64decode(rest + "=" * (-len(rest) % 4)).decode("latin-1").rstrip(" \t\n\r")
            except binascii.Error:  # a length that no base64 has
                tail = ""
            tails[way] = tail if tail.endswith("}") else ""
        start = (at - way) // 4 * 3
        if not OBJECT.match(tails[way], start):
            continue
        try:
            _, end = JSON.raw_decode(tails[way], start)
        except (ValueError, RecursionError):
            continue
        if end == len(tails[way]):
            yield at


def signed_spans(text: str) -> list[tuple[int, str, int]]:
    """Signed tokens, leftmost first; one may begin within a run whose beginning is none."""
    out, done = [], 0
    for m in THREE.finditer(text):
        if m.end() <= done:
            continue
        for at in _heads(m[1]):
            a, z = m.start() + at, m.end() + len(m[2])
            if a >= done and signed_header(text[a:z]):
                out.append((a, "signed", z))
                done = z
                break
    return out


def base_spans(text: str) -> list[tuple[int, str, int]]:
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return out


def confirmed_spans(text: str) -> list[tuple[int, str, int]]:
    """Spans that decode to a key or to a signed token."""
    out = []
    for m in PEM.finditer(text):
        if any(der_key(b) or ssh_key(b) for b in decoded(m[2])):
            out.append((m.start(), "key", m.end()))
    for m in LONG.finditer(text):
        if not any(a <= m.start() < z for a, _, z in out) and any(der_key(b) or ssh_key(b) for b in decoded(m[0])):
            out.append((m.start(), "key", m.end()))
    out += signed_spans(text)
    return out


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for a, k, z in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2])))


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, any more) -> a row per row: doc_id, n_assign,
    n_access, n_hex, n_key, n_signed, base_sha256, spans.

    Null texts count as empty: no spans.  Spans are in code points, end exclusive.
    """
    nothing = hashlib.sha256(b"").hexdigest()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def look(batches):
        for batch in batches:
            n = batch.num_rows
            counts = [[0] * n for _ in KINDS]
            base, spans = [nothing] * n, [""] * n
            texts = batch["text"]
            hit = pc.fill_null(pc.match_substring_regex(texts, HINT), False)
            for i in pc.indices_nonzero(hit).to_pylist():
                text = texts[i].as_py()
                own = base_spans(text)
                every = own + confirmed_spans(text)
                for _, kind, _ in every:
                    counts[KINDS.index(kind)][i] += 1
                base[i] = hashlib.sha256(joined(own).encode()).hexdigest()
                spans[i] = joined(every)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, pa.int64()) for c in counts), pa.array(base), pa.array(spans)],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        look, f"doc_id {id_type}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


@register("op10_secrets")
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
