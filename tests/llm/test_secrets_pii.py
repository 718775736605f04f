import base64
import hashlib
import json
import random
import re

from tidelog.llm import pii, queries, secrets


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | len(x := n.to_bytes((n.bit_length() + 7) // 8, "big"))]) + x
    return bytes([tag]) + size + body


def number(rng, size):
    return der(2, bytes([0]) + bytes([rng.randrange(1, 127)]) + rng.randbytes(size))


def rsa_like(rng, size=128):
    return der(0x30, der(2, b"\0") + b"".join(number(rng, n) for n in (size, 3, size, size // 2, size // 2, size // 2, size // 2, size // 2)))


def openssh(rng):
    field = lambda b: len(b).to_bytes(4, "big") + b
    return b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(rng.randbytes(51)) + field(rng.randbytes(136))


def kinds(text):
    return [(k, text[a:b]) for k, a, b in secrets.scan(text)[1]]


def test_structures_are_confirmed_and_lookalikes_are_not():
    rng = random.Random(1)
    key = rsa_like(rng)
    b64 = base64.b64encode(key).decode()
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{b64}\n-----END RSA PRIVATE KEY-----"
    url = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    jwt = f"{url({'alg': 'HS256', 'typ': 'JWT'})}.{url({'sub': '1', 'n': 'x'})}.c2lnbmF0dXJl"
    ssh = base64.b64encode(openssh(rng)).decode()
    public = base64.b64encode(b"\0\0\0\x07ssh-rsa\0\0\0\x03\x01\0\x01\0\0\0\x10" + rng.randbytes(16)).decode()
    algorithm = der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01") + der(5, b""))
    pkcs8 = base64.b64encode(der(0x30, der(2, b"\0") + algorithm + der(4, key))).decode()
    sec1 = base64.b64encode(der(0x30, der(2, b"\1") + der(4, rng.randbytes(32)) + der(0xA0, der(6, b"\x2b\x81\x04\0\x22")))).decode()
    locked = base64.b64encode(der(0x30, algorithm + der(4, rng.randbytes(96)))).decode()
    spki = base64.b64encode(der(0x30, algorithm + der(3, b"\0" + der(0x30, number(rng, 128) + number(rng, 3))))).decode()
    signature = base64.b64encode(der(0x30, number(rng, 32) + number(rng, 32))).decode()
    certificate = base64.b64encode(der(0x30, der(0x30, number(rng, 8) + algorithm) + algorithm + der(3, rng.randbytes(64)))).decode()
    blank = f"{base64.urlsafe_b64encode(json.dumps({'alg': 'none'}, indent=1).encode()).decode().rstrip('=')}.{url({'sub': '1'})}.c2ln"
    space = f"{base64.urlsafe_b64encode(b' ' + json.dumps({'alg': 'ES256'}).encode()).decode().rstrip('=')}.{url({'sub': '1'})}.c2ln"
    accented = base64.b64encode("le mot de passe é: password = hunter2hunter2".encode()).decode()
    nested = "password = hunter2hunter2 and more"
    for _ in range(6):
        nested = base64.b64encode(nested.encode()).decode()
    inner = base64.b64encode(b"password = hunter2hunter2 and more").decode()
    for kind, s in (("pem", pem), ("der", b64), ("jwt", jwt), ("ssh", ssh), ("encoded", inner), ("der", pkcs8), ("der", sec1), ("der", locked), ("jwt", blank), ("jwt", space), ("encoded", accented), ("encoded", nested)):
        assert (kind, s) in kinds(f"see {s} here"), kind
    assert [k for k, _ in kinds(key.hex())] == ["hex", "der"]
    for s in (b64[:-8], base64.b64encode(rng.randbytes(90)).decode(), f"{url({'typ': 'x'})}.{url({})}.abc", "MIIB" + "A" * 60, base64.b64encode(b"just some words in a line").decode(), public, spki, signature, certificate, f"-----BEGIN PUBLIC KEY-----\n{spki}\n-----END PUBLIC KEY-----", f"-----BEGIN CERTIFICATE-----\n{certificate}\n-----END CERTIFICATE-----"):
        assert not [k for k, _ in kinds(f"see {s} here") if k not in secrets.BASE], s
    assert secrets.der_items(b"\x30\x80\0\0") is None
    deep = b""
    for _ in range(60):
        deep = der(0x30, deep)
    assert len(secrets.der_items(deep)) == 60
    assert not secrets.is_ssh_key(openssh(rng)[:-1]) and not secrets.is_ssh_key(b"openssh-key-v1\0")


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_by_pattern(text):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6 and m[1].isascii()]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.BASE.index(s[0])))


def pii_by_pattern(text):
    d = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(d(m.group())) <= 19 and pii.luhn(d(m.group()))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(d(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.BASE.index(s[0])))


def noise(seed):
    r = random.Random(seed)
    bits = ["token", "Token", "API_KEY", "apikey", "secret", "password", '"', "'", " ", "  ", ":", "=", "AKIA", "AKIAAKIA", "ABCDEFGH1234567890", "abc", "0123456789abcdef", "deadbeef", ".", "-", "@", "+", "1", "4111111111111111", "255", "192", "(", ")", "4 ", "é", "ſecret", "a.b", "com", "\n", "%", "_"]
    return "".join(r.choice(bits) for _ in range(r.randint(1, 60)))


def test_base_spans_are_those_of_the_patterns():
    for seed in range(4000):
        t = noise(seed)
        assert secrets.scan(t)[0] == base_by_pattern(t), t
        assert sorted(pii.base_spans(t), key=lambda s: (s[1], pii.BASE.index(s[0]))) == pii_by_pattern(t), t


def check(rows, docs, by_pattern, names):
    assert sorted(r[0] if r[0] is not None else -1 for r in rows) == sorted(i if i is not None else -1 for i, _ in docs)
    text = {}
    for i, t in docs:
        text.setdefault(i, t or "")
    for r in rows:
        base = by_pattern(text[r["doc_id"]])
        assert [r[f"n_{k}"] for k in names] == [sum(s[0] == k for s in base) for k in names]
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(told.split(",") if told else []) <= set(spans) and [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


def test_queries(spark, sf, odd_dir, empty_dir):
    for d in (sf, odd_dir, empty_dir):
        docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
        check(queries.op2_secret_scan(spark, d).collect(), docs, base_by_pattern, secrets.BASE)
        check(queries.op3_personal_data(spark, d).collect(), docs, pii_by_pattern, pii.BASE)


def test_the_field_chooses_boundaries_and_types():
    model, wrong, total = pii.trained(), 0, 0
    for text, spans in pii.training_sentences(123, 150):
        win = pii.Window(text, 0, len(text))
        got = {(pii.TYPES[k], win.cuts[i], win.cuts[j]) for i, j, k, g in model.decode(win) if g >= pii.MARGIN}
        wrong += len(got ^ set(spans))
        total += len(spans)
    assert wrong < 0.15 * total
    t = "call +1 (569) 555-6633 4795326016703902 today"
    assert [(k, t[a:b]) for k, a, b in pii.scan(t, model)[1]] == [("phone", "+1 (569) 555-6633"), ("card", "4795326016703902")] or [k for k, *_ in pii.scan(t, model)[1]].count("card") == 1
    assert not pii.scan("In 2019-04-05 at 10:45:30 we paid 12,345.67 for #48392017 and 3.14159265358979.", model)[1]


def test_ibans_with_letters():
    model = pii.trained()
    for iban in ("FR14 2004 1010 0505 0001 3M02 606", "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "GB29 NWBK 6016 1331 9268 19", "FR1420041010050500013M02606", "MT84MALT011000012345MTLCAST001S", "DE89 3704 0044 0532 0130 00"):
        for t in (f"pay to iban {iban} today", f"the account is {iban}."):
            assert ("iban", iban) in [(k, t[a:b]) for k, a, b in pii.scan(t, model)[1]], t
    longest = " ".join(("XX00" + "A1" * 15)[k : k + 4] for k in range(0, 34, 4))
    assert len(pii._TOKENS.findall(longest)) <= pii.LONGEST


def test_decoding_is_the_best_of_all_segmentations():
    model = pii.trained()
    for text, _ in pii.training_sentences(5, 25):
        win = pii.Window(text[:60], 0, len(text[:60]))
        sc = model.scores(win)

        def best(j):
            if j == 0:
                return 0.0
            return max([best(j - 1)] + [best(i) + float(s.max()) for i, s in sc[j]])

        import functools

        best = functools.lru_cache(None)(best)
        assert abs(sum(g for *_, g in model.decode(win)) - best(len(sc) - 1)) < 1e-9
