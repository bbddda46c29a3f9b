import base64
import bz2
import gzip
import random
import re
import urllib.parse
import zlib

from starlens.llm import secrets
from starlens.llm.secrets import find_secrets, redact_secrets, scan

SLOW = {"assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                   lambda m: len(m[1]) >= 12),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16)}


def brute(t):
    return sorted(((k, *m.span()) for k, (p, ok) in SLOW.items() for m in re.finditer(p, t, re.ASCII) if ok(m)),
                  key=lambda x: (x[1], list(SLOW).index(x[0]), x[2]))


def test_base_against_plain_patterns():
    rng = random.Random(3)
    bits = ["password", "PASSWD", "api_key", "apikey", "Token", "secret", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGHIJ12345678",
            "0123456789abcdef", "deadbeef", "x.y/z+w==", "é", "🙂", "\n", "ſecret", "toKen", "K"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        base, spans = scan(t)
        assert base == brute(t) and set(base) <= set(spans)


def test_nested_layers():
    secret = "password=hunter2hunter2"
    for wrapped in (urllib.parse.quote(secret, safe=""), "".join(f"\\u{ord(c):04x}" for c in secret),
                    base64.b64encode(secret.encode()).decode(), base64.b64encode(gzip.compress(secret.encode())).decode(),
                    base64.urlsafe_b64encode(zlib.compress(base64.b64encode(secret.encode()))).decode(),
                    urllib.parse.quote(base64.b64encode(secret.encode()).decode(), safe="").replace("%", "%25")):
        t = f"É see {wrapped} end"
        got = scan(t)[1]
        assert any(k == "assign" and t[s:e].strip() and wrapped.startswith(t[s:e][:8]) for k, s, e in got), wrapped
    assert scan(None) == ([], []) and scan("%zz \\u12 " + "A" * 30) == ([], [])
    bomb = base64.b64encode(zlib.compress(b" " * 30_000_000 + secret.encode())).decode()
    assert scan(bomb)[1] == [("assign", 0, len(bomb.rstrip("=")) + bomb.count("="))]


def test_base64_of_any_language():
    secret = "password=hunter2hunter2"
    for before in ("Le mot de passe a été changé à Orléans : ", "Größe ändern für Jürgen: ", "密码已更改：", "пароль изменён: "):
        for code in ("utf-8", "utf-16", "utf-16-be", "latin-1"):
            raw = (before + secret).encode(code, "replace")
            for wrapped in (base64.b64encode(raw).decode(), base64.b64encode(gzip.compress(raw)).decode()):
                assert scan(f"É {wrapped} end")[1] == [("assign", 2, 2 + len(wrapped))], (before, code)


def test_archives_in_layers():
    secret, b64 = b"password=hunter2hunter2", lambda x: base64.b64encode(x).decode()
    noise = random.Random(1).randbytes(3000)
    whole = [gzip.compress(gzip.compress(secret)), zlib.compress(bz2.compress(secret)), gzip.compress(b"a") + gzip.compress(secret),
             bz2.compress(b"a") + bz2.compress(secret), gzip.compress(secret[:12]) + gzip.compress(secret[12:]),
             b"head" + gzip.compress(secret), gzip.compress(b" " * 9_000_000 + gzip.compress(noise + secret) + b" " * 9_000_000)]
    for raw in whole:
        t = f"É {b64(raw)} end"
        assert scan(t)[1] == [("assign", 2, len(t) - 4)]
    raw = gzip.compress(secret)
    for wrapped in (urllib.parse.quote(raw), "".join(f"%{b:02x}" for b in raw), "".join(f"\\x{b:02x}" for b in raw),
                    repr(raw)[2:-1], urllib.parse.quote(gzip.compress(raw)), urllib.parse.quote(zlib.compress(secret)),
                    urllib.parse.quote(urllib.parse.quote(raw))):
        t = f"É {wrapped} end"
        assert scan(t)[1] == [("assign", 2, len(t) - 4)], wrapped


def test_base64_over_lines():
    secret = b"password=hunter2hunter2"
    noise = random.Random(1).randbytes(200)
    for raw in (gzip.compress(noise + secret), b"e" * 40 + secret + noise, b"\xe9" * 53 + secret):
        for width, eol in ((64, "\n"), (76, "\r\n"), (10, "\n"), (64, "\n  ")):
            code = base64.b64encode(raw).decode()
            wrapped = eol.join(code[i:i + width] for i in range(0, len(code), width))
            for before, after in (("É ", " end"), ("Content-Transfer:\n\n", "\n\nend"), ("-----BEGIN SOMETHINGLONG-----\n", "\n-----END-----")):
                got = scan(before + wrapped + after)[1]
                assert any(s <= len(before) and e >= len(before + wrapped) for _, s, e in got), (width, before)
    words = "\n".join("w" * (k % 23 + 1) for k in range(20_000))
    assert scan(words) == ([], [])


def test_frames(spark):
    t = "É token = abcdefghijkl and 0123456789abcdef0 x"
    df = spark.createDataFrame([(1, t, "x", 5), (2, None, "y", 0), (2, None, "y", 0), (3, "", "z", 0)],
                               "doc_id long, text string, all_spans string, n_chars long")
    assert find_secrets(df).count() == 4 and find_secrets(df.limit(0)).count() == 0
    out = {r.doc_id: r for r in redact_secrets(df).collect()}
    assert {r.all_spans for r in out.values()} == {"x", "y", "z"} and redact_secrets(df).schema == df.schema
    assert out[1].text == "É [SECRET] and [SECRET] x" and out[1].n_chars == 25 and out[2].text is None


def test_runs_over_piece_borders(monkeypatch):
    """A coded secret cut by a border of the pieces, at every alignment."""
    monkeypatch.setattr(secrets, "PIECE", 1 << 14)
    noise = random.Random(2).randbytes(3000).replace(b"=", b".")
    raw = noise + b" password=hunter2hunter2 " + noise
    plain = random.Random(3).choices(b"., ;!?()", k=1 << 14)
    runs = {"base64": base64.b64encode(raw), "lines": base64.encodebytes(raw), "url": b"".join(b"%%%02X" % b for b in raw),
            "escape": b"".join(b"\\x%02x" % b for b in raw), "unicode": b"".join(b"\\u%04x" % b for b in raw)}
    for name, run in runs.items():
        for shift in range(8):
            for room in (len(run) // 2, 40, len(run) - 40):
                data = bytes(plain[:(1 << 14) - room + shift]) + run + b"." + bytes(plain[:100])
                t = f"É {base64.b64encode(zlib.compress(data)).decode()} end"
                assert scan(t)[1] == [("assign", 2, len(t) - 4)], (name, shift, room)


def test_very_long_runs(monkeypatch):
    """Runs beyond the bound are cut where the codes are in step."""
    monkeypatch.setattr(secrets, "PIECE", 1 << 14)
    monkeypatch.setattr(secrets, "CARRY", 1 << 14)
    for at in range(40_000, 40_012):
        raw = b"x" * at + b" password=hunter2hunter2 " + b"y" * 30_000
        for run in (base64.b64encode(raw), base64.encodebytes(raw), b"".join(b"%%%02X" % b for b in raw)):
            t = base64.b64encode(zlib.compress(b"., " + run)).decode()
            assert scan(t)[1] == [("assign", 0, len(t))], at


def test_windows_and_utf16():
    secret = b"password=hunter2hunter2"
    for bits in range(9, 16):
        packer = zlib.compressobj(wbits=bits)
        raw = packer.compress(secret * 3) + packer.flush()
        t = base64.b64encode(raw).decode()
        assert scan(t)[1] == [("assign", 0, len(t))], bits
    for code in ("utf-16-le", "utf-16-be"):
        for shift in (b"", b"\0", b"ab", b"abc"):
            t = base64.b64encode(shift + "é password=hunter2hunter2".encode(code)).decode()
            assert scan(t)[1] == [("assign", 0, len(t))], (code, shift)


def test_many_archives_and_spans():
    """Time in proportion: thousands of archives and of spans in one text."""
    import time
    run = "".join(f"%{b:02x}" for b in gzip.compress(b"password=hunter2hunter2"))
    t0 = time.process_time()
    assert len(scan(" ".join([run] * 3000))[1]) == 3000
    text = "token=abcdefabcdefxyz " * 50_000
    assert secrets.without_spans(text, scan(text)[1], "[S]") == "[S] " * 50_000
    assert time.process_time() - t0 < 30
