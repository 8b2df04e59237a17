import base64
import json
import random
import re
import time

from sluice.llm import secrets as S


def brute(text):
    text = text or ""
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_key", "apikey"))
    out = [(*m.span(), "assign") for m in re.finditer(rf"({word})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 8]
    out += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[0], S.BASE_KINDS.index(s[2])))


def der(tag, body):
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x82]) + size.to_bytes(2, "big")
    return bytes([tag]) + head + body


KEY = der(0x30, der(0x02, b"\0") + b"".join(der(0x02, bytes([1 + i] * 40)) for i in range(8)))
JWT = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (json.dumps({"alg": "HS256", "typ": "JWT"}).encode(), b'{"sub":"1"}', b"s" * 32))
CASES = [
    None, "", "token = short", 'token = "0cf1bbc67ab39b2ddebadc809bed189ed8c6ac4d"', "PASSWORD:hunter22hunter", "api_key'  =  'abc.def-ghi", "AKIA1234567890AB AKIA12",
    "ſecret=12345678", "toKen=12345678", "password=short token:longenough1", "é" * 10 + "secret=abcdefgh", "f" * 31, "f" * 32, "A" * 64, "passwd==abcdefgh=",
]


def test_base_spans_match_the_definition():
    rng = random.Random(8)
    parts = ["token", "Secret", "api_", "key", "=", ":", " ", '"', "'", "AKIA", "ABCDEF012345", "deadbeef" * 4, "abcdefgh", "é", ".", "\n"]
    texts = CASES + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for text in texts:
        assert [s for s in S.find_secrets(text) if s[2] in S.BASE_KINDS] == brute(text), text


def test_structure_confirms():
    kinds = lambda t: [s[2] for s in S.find_secrets(t)]
    b64 = base64.b64encode(KEY).decode()
    assert kinds(f"see {b64} here") == ["key"]
    assert "key" in kinds("hex " + KEY.hex().upper())
    assert kinds(base64.b64encode(KEY[:-1]).decode()) == []
    assert kinds(f"x {JWT} y") == ["token"]
    assert kinds("eyJhYmMiOjF9.eyJhIjoxfQ.c2ln") == []
    lines = "\n".join(b64[i : i + 64] for i in range(0, len(b64), 64))
    assert kinds(f"-----BEGIN PRIVATE KEY-----\n{lines}\n-----END PRIVATE KEY-----") == ["key"]
    assert kinds(base64.b64encode(b"password=correcthorse").decode()) == ["encoded"]
    assert kinds(base64.b64encode(b"only some quiet words, nothing else").decode()) == []


def test_short_and_wrapped_runs_are_decoded():
    found = lambda t: [t[a:b] for a, b, k in S.find_secrets(t) if k in ("key", "encoded")]
    for secret in (b"AKIAABCDEFGH1234", b"token=abcd1234", b"secret=abcd1234x", b"token=abcd12345"):
        run = base64.b64encode(secret).decode()
        for form in (run, run.rstrip("=")):
            assert found(f"see {form} here") == [form], secret
            assert found(rf'{{"a": "x\n{form}\n"}}') == [form], secret
        assert S.mask_secrets(f"see {run} here") == f"see {S.MASK} here"
    long = base64.b64encode(b"some words before and then password=correcthorse and some words after it, to the end").decode()
    openssh = base64.b64encode(b"openssh-key-v1\0" + bytes(range(256))).decode()
    key, text_hex = base64.b64encode(KEY).decode(), KEY.hex().upper()
    for run in (key, long, openssh, text_hex):
        for width in (38, 64, 70, 76):
            for end in ("\n", "\r\n", "\n    ", r"\n", r"\r\n", r"\\n"):
                body = end.join(run[i : i + width] for i in range(0, len(run), width))
                for before, after in (("", ""), ("key: ", " is it"), ("anextraordinarilylongword" + end, " is it"), ("quiet words" + end, end + "-- " + end)):
                    assert found(before + body + after) == [body], (width, end, before)
    for end in (r"\n", r"\\n", "\n"):
        pem = f"-----BEGIN PRIVATE KEY-----{end}{end.join(key[i : i + 64] for i in range(0, len(key), 64))}{end}-----END PRIVATE KEY-----{end}"
        assert S.mask_secrets(f'{{"private_key": "{pem}"}}') == f'{{"private_key": "{S.MASK}{end}"}}'
    assert found("\n".join(["internationalisation", "counterrevolutionary"] * 40)) == []


def test_nested_prefixed_and_encrypted_secrets():
    found = lambda t: [t[a:b] for a, b, k in S.find_secrets(t) if k in ("key", "encoded", "token")]
    b64 = lambda x: base64.b64encode(x).decode()
    once = b64(b"password=correcthorse")
    for run in (b64(once.encode()), b64(b64(once.encode()).encode()), once.encode().hex(), b64(b"see " + KEY.hex().upper().encode()), b64(JWT.encode())):
        assert found(f"before {run} after") == [run]
    assert found(f"sk_{once} x") == [once] and found(f"x_live-{b64(KEY)}") == [b64(KEY)]
    url = base64.urlsafe_b64encode(b"token=abcdefgh??>>~~").decode()
    assert ("-" in url or "_" in url) and found(f"v1_{url}.") == [url]
    body = b64(bytes(range(160)))
    for end in ("\n", "\r\n", r"\n"):
        head = f"Proc-Type: 4,ENCRYPTED{end}DEK-Info: AES-128-CBC,0123456789ABCDEF{end}{end}"
        for inside, label, is_it in ((head + body, "RSA PRIVATE KEY", True), (head + body, "MESSAGE", False), (head + b64(b"short"), "RSA PRIVATE KEY", False), (f"Comment: mine{end}{b64(KEY)}", "PRIVATE KEY", True)):
            pem = f"-----BEGIN {label}-----{end}{inside}{end}-----END {label}-----"
            assert (pem in found(f"a {pem} b")) == is_it, (label, inside)


def test_added_spans_against_planted_ones():
    rng = random.Random(12)
    for _ in range(300):
        text, want = "", []
        for _ in range(rng.randint(1, 6)):
            text += " ".join(rng.choice(["plain", "words", "über", "12", "x-y", "and-so_on", "AAAA"]) for _ in range(rng.randint(1, 9))) + rng.choice([" ", "\n\n", "(", "'"])
            inside = rng.choice([b"secret=%08d" % rng.randrange(10**8), KEY, b"AKIA%012d" % rng.randrange(10**12), bytes(rng.choices(range(128, 256), k=40))])
            run = base64.b64encode(inside).decode() if rng.random() < 0.7 else inside.hex().upper()
            if inside[0] < 128:
                want.append((len(text), len(text) + len(run), "key" if inside is KEY else "encoded"))
            text += run + rng.choice([" ", "; ", ")", ", "])
        assert [s for s in S.find_secrets(text) if s[2] not in S.BASE_KINDS] == want, text


def test_very_many_secrets_take_linear_time():
    run = base64.b64encode(b"password=correcthorse").decode()
    began = time.process_time()
    assert len(S.find_secrets(f"{run} " * 40_000)) == 40_000
    assert time.process_time() - began < 20


def test_masking():
    assert S.mask_secrets("a token=12345678 b") == "a [secret] b"
    assert S.mask_secrets(None) is None and S.mask_secrets("") == ""
    assert not [s for t in CASES for s in S.find_secrets(S.mask_secrets(t))]


def test_scan_and_mask(spark):
    rows = [(i, t, len(t or ""), "c") for i, t in enumerate(CASES)] + [(None, "secret=abcdefgh", 15, "c")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, found string")
    got = sorted(((r.doc_id, [tuple(s) for s in r.found]) for r in S.scan(df).collect()), key=str)
    assert got == sorted(((r[0], S.find_secrets(r[1])) for r in rows), key=str)
    masked = S.mask_documents(df)
    assert masked.schema == df.schema
    assert all(r.n_chars == len(r.text or "") for r in masked.collect())
    assert S.scan(df.limit(0)).count() == 0 and S.mask_documents(df.limit(0)).count() == 0
