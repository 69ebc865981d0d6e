import base64
import hashlib
import json
import re

import pytest

from binsight.llm import secrets as S


def length(n):
    return bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82, n >> 8, n & 255])


def tlv(tag, body):
    return bytes([tag]) + length(len(body)) + body


def number(i, n=1):
    return tlv(2, i.to_bytes(n, "big"))


RSA = tlv(0x30, number(0) + b"".join(number(0x7F00FF + i, 32) for i in range(8)))
PKCS8 = tlv(0x30, number(0) + tlv(0x30, tlv(6, bytes([42, 134, 72])) + tlv(5, b"")) + tlv(4, RSA))
EC = tlv(0x30, number(1) + tlv(4, bytes(range(32))) + tlv(0xA0, tlv(6, bytes([42, 134, 72, 206]))))
SPKI = tlv(0x30, tlv(0x30, tlv(6, bytes([42, 134, 72])) + tlv(5, b"")) + tlv(3, b"\0" + RSA))


def text(*parts):
    return b"".join(len(p).to_bytes(4, "big") + p for p in parts)


SSH = (b"openssh-key-v1\0" + text(b"none", b"none", b"") + (1).to_bytes(4, "big")
       + text(text(b"ssh-ed25519", bytes(32)), bytes(64)))


def url64(x):
    return base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()


JWT = f"{url64({'alg': 'HS256', 'typ': 'JWT'})}.{url64({'sub': 1})}.c2ln"


def test_structures():
    assert S.der_key(RSA) and S.der_key(PKCS8) and S.der_key(EC) and S.ssh_key(SSH)
    assert not S.der_key(SPKI) and not S.der_key(RSA[:-1]) and not S.der_key(RSA + b"x") and not S.ssh_key(SSH[:-1])
    assert S.signed_header(JWT) and not S.signed_header(JWT.replace(".", "x.", 1)) and not S.signed_header(f"{url64({'a': 1})}.{url64({})}.x")


@pytest.mark.parametrize("key", [RSA, PKCS8, EC, SSH])
def test_keys_are_found_in_either_coding(key):
    b = base64.b64encode(key).decode()
    lines = "\n".join(b[i:i + 64] for i in range(0, len(b), 64))
    pem = f"-----BEGIN PRIVATE KEY-----\n{lines}\n-----END PRIVATE KEY-----"
    for form in (b, base64.urlsafe_b64encode(key).decode(), key.hex(), key.hex().upper(), pem):
        found = [s for s in S.confirmed_spans(f"é x {form} y") if s[1] == "key"]
        assert (4, "key", 4 + len(form)) in found


def test_random_runs_are_not_reported():
    for seed in range(50):
        h = hashlib.sha512(bytes([seed])).digest() * 3
        for form in (base64.b64encode(h).decode(), h.hex()):
            assert S.confirmed_spans(f"x {form} y") == []


def plain(t):
    """The base rules as the contract words them."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


TEXTS = ["", None, "token = \"abc123def\" é PassWord:'x.y=z1'", "toKen=abcdef ſecret=abcdefgh toKen=abcdefg", "api_key : 12345",
         "APIKEY=123456 AKIA" + "A1" * 8 + " AKIA123 " + "0123456789abcdef" * 3, "ü" * 30 + "deadbeef" * 3 + "x" + "a" * 23,
         "password=secret=token=abcdefgh", "token=" * 2000, "a" * 100_000, JWT, f"key {base64.b64encode(RSA).decode()}"]


def test_scan_matches_the_base_rules(spark):
    rows = [(i, t, "n") for i, t in enumerate(TEXTS)] + [(None, TEXTS[2], "n"), (2, TEXTS[2], "n")]
    out = S.scan(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(out) == len(rows)
    for r, (i, t, _) in zip(out, rows):
        want = plain(t or "")
        joined = ",".join(f"{S.KINDS[k]}:{a}:{z}" for a, k, z in want)
        assert r.doc_id == i and r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in want) for x in range(3))
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
    assert out[10].n_signed == 1 and out[11].n_key == 1


def test_scan_nothing(spark):
    assert S.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_tokens_after_letters_that_look_like_a_start(spark):
    for before in ("key_", "view-", "x ", "eyeyey-", "key_" + JWT + " key_"):
        t = before + JWT + " end"
        spans = S.scan(spark.createDataFrame([(1, t)], "doc_id long, text string")).first().spans
        assert f"signed:{len(before)}:{len(before) + len(JWT)}" in spans.split(","), (before, spans)


def test_long_runs_take_linear_time():
    """A million characters each, of which any place might begin a token or a key."""
    import time

    n = 1_000_000
    head = url64({"alg": "HS256"})
    for run in ("ey" * (n // 2), "eyJ" * (n // 3), "ew" * (n // 2) + ".aa.bb", "eyJhIjoxfQ" * (n // 10) + ".aa.bb",
                "eyJ" * (n // 3) + "fQ.aa.bb", (head + ".") * (n // len(head)), "a." * (n // 2), "eyJh." * (n // 5)):
        t = time.process_time()
        spans = S.confirmed_spans("x " + run + " " + JWT)
        assert time.process_time() - t < 4, run[:20]
        assert (len(run) + 3, "signed", len(run) + 3 + len(JWT)) in spans


def test_signed_spans_of_mixed_runs():
    other = JWT.replace("c2ln", "")
    t = f"a.{JWT}.{JWT} {JWT}é{other} x.{JWT[:-4]}- eyJ.{JWT}"
    want = []
    for m in re.finditer(r"eyJhbGci", t):
        z = re.compile(r"[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*").match(t, m.start()).end()
        want.append((m.start(), "signed", z))
    assert S.signed_spans(t) == want and len(want) == 6
