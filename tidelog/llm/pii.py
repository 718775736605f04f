"""Personal data by a semi-Markov conditional random field.

Base spans come from fixed patterns. Beside them a semi-Markov CRF reads the neighbourhood of digits
and @ signs: features of a whole candidate span (its shape, separators, check digits, the word before
it) score it as each type, and dynamic programming over segments of at most ``LONGEST`` tokens chooses
boundaries and types together. An entity is bounded: it has an @ or seven digits, capital letters if any
(but for emails), and fewer than 25 other characters between two of its digits. A segment is reported if it beats the best reading without it by
``MARGIN`` and touches no base span. The model is trained here, on sentences made by rule
(``training_sentences``), by stochastic gradients of the conditional likelihood.

Defined results: null text is empty; an empty text has no spans, and base_sha256 is that of the empty
string; a repeated row is scanned again; an empty table gives an empty result; extra columns are ignored.
Spans are of code points, end exclusive. A text of any length is read whole; windows that meet are one.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

BASE = ("email", "ip", "card", "phone")
#: Types of the model; "other" is text that is no entity.
TYPES = ("other", *BASE, "iban", "ssn")
KINDS = TYPES[1:]
_RANK = {k: i for i, k in enumerate(KINDS)}
#: Tokens of the longest entity, an IBAN of 34 characters in groups of four whose letters and digits take turns: 34 and 8 blanks.
LONGEST, MARGIN = 42, 2.0
#: Characters on each side of a digit or @ that the model reads.
REACH = 32

Span = tuple[str, int, int]
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    # Emails: for each @ the longest local part that no match before it holds; the same matches as the pattern's.
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return out


# ---- the model ------------------------------------------------------------------------------

_TOKENS = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)
# Words that announce an entity.
_CUES = {
    "email": {"email", "mail", "e-mail", "correo", "courriel"}, "ip": {"ip", "host", "server", "address", "addr"}, "card": {"card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta", "credit"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "téléphone", "teléfono"}, "iban": {"iban", "account", "konto", "compte", "cuenta"}, "ssn": {"ssn", "social", "security"},
}
_SHAPES = (
    ("us_phone", r"\(?[2-9]\d\d\)?[ .-]?\d{3}[ .-]\d{4}"), ("plus_phone", r"\+\d[\d ().-]{7,17}\d"), ("zero_phone", r"0\d{1,4}[ /-]\d{2,4}(?:[ -]?\d{2,4}){1,3}"), ("ssn", r"\d{3}-\d{2}-\d{4}"), ("iban", r"[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"),
    ("email", r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+"), ("dotted", r"\d{1,3}(?:\.\d{1,3}){3}"), ("card", r"\d{4}(?:[ -]?\d{4}){2,3}(?:[ -]?\d{1,3})?|3\d{3}[ -]?\d{6}[ -]?\d{5}"), ("date", r"\d{4}[-/.]\d\d?[-/.]\d\d?|\d\d?[-/.]\d\d?[-/.]\d{2,4}"), ("time", r"\d\d?:\d\d(?::\d\d)?"), ("number", r"\d+(?:[.,]\d+)*"),
)
_SHAPE_RX = [re.compile(p, re.A) for _, p in _SHAPES]


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    if not 15 <= len(s) <= 34 or not s.isalnum() or not s.isascii():
        return False
    moved = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


_NAMES = [f"shape:{n}" for n, _ in _SHAPES] + ["luhn", "iban97", "bytes", "bad_bytes", "digits<7", "digits7-9", "digits10-11", "digits12-13", "digits14-19", "digits20+", "glued", "cut", "decimal_after", "bad_area", "one_token", "bias"] + [f"cue:{k}" for k in _CUES]
_AT = {n: i for i, n in enumerate(_NAMES)}


def span_features(text: str, a: int, b: int, cues: set[str]) -> list[int]:
    s = text[a:b]
    out = [_AT["bias"]]
    shape = {n for (n, _), rx in zip(_SHAPES, _SHAPE_RX) if rx.fullmatch(s)}
    out += [_AT[f"shape:{n}"] for n in shape]
    d = _digits(s)
    out.append(_AT["digits<7" if len(d) < 7 else "digits7-9" if len(d) < 10 else "digits10-11" if len(d) < 12 else "digits12-13" if len(d) < 14 else "digits14-19" if len(d) < 20 else "digits20+"])
    if "card" in shape and luhn(d):
        out.append(_AT["luhn"])
    if "iban" in shape and iban_ok(s):
        out.append(_AT["iban97"])
    if "dotted" in shape:
        out.append(_AT["bytes" if all(int(p) <= 255 for p in s.split(".")) else "bad_bytes"])
    if "ssn" in shape and (s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000"):
        out.append(_AT["bad_area"])
    before, after = text[a - 1 : a], text[b : b + 1]
    if before.isalnum() or after.isalnum() or before in ("-", "/", "#", "_", "$", "€") and before:
        out.append(_AT["glued"])
    if after in (".", "-", "_") and text[b + 1 : b + 2].isalnum() or before in (".", "-", "_", "+", "%") and text[a - 2 : a - 1].isalnum():
        out.append(_AT["cut"])
    if after in (".", ",", "-", "/", ":") and text[b + 1 : b + 2].isdigit() or before in (".", ",", ":") and text[a - 2 : a - 1].isdigit():
        out.append(_AT["decimal_after"])
    out += [_AT[f"cue:{c}"] for c in cues]
    return out


class Window:
    """Tokens of a stretch of text, and its candidate segments: (start, end, features or None for one plain token)."""

    def __init__(self, text: str, begin: int, end: int):
        toks = [m for m in _TOKENS.finditer(text, begin, end)]
        self.cuts = [m.start() for m in toks] + [end]
        self.segments: list[list[tuple[int, int, list[int]]]] = [[] for _ in range(len(toks) + 1)]
        word = [m.group().lower() for m in toks]
        space = [w.isspace() for w in word]
        digit = np.cumsum([0] + [w[0].isdigit() and w[0].isascii() for w in word]).tolist()
        digits = np.cumsum([0] + [sum(map(str.isdigit, w)) for w in word]).tolist()
        ats = np.cumsum([0] + [w == "@" for w in word]).tolist()
        for i in range(len(toks)):
            if space[i] or word[i] in ",.;:!?)|/":
                continue
            cues = {k for k, ws in _CUES.items() if any(w in ws for w in word[max(0, i - 6) : i])}
            for j in range(i + 1, min(len(toks), i + LONGEST) + 1):
                # An entity ends with a letter or digit, and has an @ or several digits.
                if not word[j - 1][0].isalnum() or not (ats[j] > ats[i] or digit[j] > digit[i]):
                    continue
                a, b = self.cuts[i], self.cuts[j]
                if ats[j] == ats[i] and digits[j] - digits[i] < 7:
                    continue
                self.segments[j].append((i, j, span_features(text, a, b, cues)))


class Model:
    def __init__(self, weights: np.ndarray):
        self.w = weights  # type by feature; "other" has score 0 for each of its tokens

    def scores(self, win: Window) -> list[list[tuple[int, np.ndarray]]]:
        return [[(i, self.w[1:, f].sum(1)) for i, _, f in segs] for segs in win.segments]

    def decode(self, win: Window) -> list[tuple[int, int, int, float]]:
        """Best (start token, end token, type, margin over reading it as other) segments."""
        sc = self.scores(win)
        best, back = [0.0], [None]
        for j in range(1, len(sc)):
            top, how = best[j - 1], None
            for i, s in sc[j]:
                k = int(s.argmax())
                if best[i] + s[k] > top:
                    top, how = best[i] + float(s[k]), (i, j, k + 1, float(s[k]))
            best.append(top)
            back.append(how)
        out, j = [], len(sc) - 1
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                out.append(back[j])
                j = back[j][0]
        return out[::-1]

    def gradient(self, win: Window, gold: set[tuple[int, int, int]]) -> dict[tuple[int, int], float]:
        """Of the log-likelihood: features of gold segments less those expected, by forward and backward sums."""
        sc = self.scores(win)
        n = len(sc) - 1
        fwd, bwd = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        fwd[0] = bwd[n] = 0.0
        for j in range(1, n + 1):
            terms = [fwd[j - 1]] + [fwd[i] + np.logaddexp.reduce(s) for i, s in sc[j]]
            fwd[j] = np.logaddexp.reduce(terms)
        for j in range(n, 0, -1):
            bwd[j - 1] = np.logaddexp(bwd[j - 1], bwd[j])
            for i, s in sc[j]:
                bwd[i] = np.logaddexp(bwd[i], bwd[j] + np.logaddexp.reduce(s))
        out: dict[tuple[int, int], float] = {}
        for j in range(1, n + 1):
            for (i, s), (_, _, f) in zip(sc[j], win.segments[j]):
                p = np.exp(np.minimum(0.0, fwd[i] + s + bwd[j] - fwd[n]))
                for k in range(len(s)):
                    g = ((i, j, k + 1) in gold) - float(p[k])
                    if abs(g) > 1e-4:
                        for x in f:
                            out[k + 1, x] = out.get((k + 1, x), 0.0) + g
        return out


def training_sentences(seed: int = 11, n: int = 260) -> list[tuple[str, list[Span]]]:
    """Sentences made by rule: plain words, entities with and without a cue, and numbers that are none."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvw") for _ in range(r.randint(2, 8)))

    def check_digit(body: str) -> str:
        return next(body + c for c in "0123456789" if luhn(body + c))

    def grouped(s: str, sep: str) -> str:
        return sep.join(s[k : k + 4] for k in range(0, len(s), 4))

    def iban() -> str:
        # Digits, letters and either, as countries form the account part.
        land, form = r.choice((("DE", "d18"), ("FR", "d10 x11 d2"), ("ES", "d20"), ("GB", "a4 d14"), ("NL", "a4 d10"), ("MT", "a4 d5 x18")))
        of = {"d": "0123456789", "a": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "x": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
        body = "".join(r.choice(of[p[0]]) for p in form.split() for _ in range(int(p[1:])))
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        return grouped(f"{land}{check:02d}{body}", r.choice((" ", "")))

    area = lambda: r.choice("23456789") + d(2)
    make = {
        "email": lambda: f"{word()}{r.choice(('.', '_', '', '+'))}{word()}{d(r.randint(0, 2))}@{word()}.{r.choice(('com', 'org', 'de', 'example.net'))}",
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": lambda: grouped(check_digit(r.choice("45") + d(14)), r.choice((" ", "-", ""))),
        "phone": lambda: r.choice((lambda: f"+{r.randint(1, 9)} ({area()}) {d(3)}-{d(4)}", lambda: f"({area()}) {d(3)}-{d(4)}", lambda: f"{area()}-{d(3)}-{d(4)}", lambda: f"{area()}.{d(3)}.{d(4)}", lambda: f"+49 {d(3)} {d(7)}", lambda: f"+{r.randint(30, 49)} {d(2)} {d(4)} {d(4)}"))(),
        "iban": iban, "ssn": lambda: f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}",
    }
    other = [lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"{r.randint(1, 999)},{d(3)}.{d(2)}", lambda: f"#{d(r.randint(7, 10))}", lambda: d(r.randint(7, 20)), lambda: f"{d(5)}-{d(5)}-{d(3)}", lambda: f"{r.randint(1900, 2000)}-{r.randint(2001, 2030)}", lambda: f"3.{d(9)}", lambda: f"{d(3)}-{d(3)}-{d(3)}", lambda: f"{word()}{d(8)}", lambda: f"v{d(1)}.{d(2)}.{d(3)}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(32)), lambda: f"{d(4)} {d(4)} {d(2)}", lambda: f"{d(2)}.{d(2)}.{d(4)}", lambda: f"ISBN 978-{d(1)}-{d(3)}-{d(5)}-{d(1)}", lambda: f"{d(3)}.{d(3)}.{d(3)},{d(2)}"]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(1, 4))) + " "
            if r.random() < 0.55:
                k = r.choice(KINDS)
                if r.random() < 0.4:
                    text += r.choice(sorted(_CUES[k])) + r.choice((" ", ": ", " is "))
                s = make[k]()
                spans.append((k, len(text), len(text) + len(s)))
                text += s + r.choice((" ", ". ", ", "))
            else:
                text += r.choice(other)() + r.choice((" ", ". ", ", "))
        out.append((text + word(), spans))
    return out


@lru_cache(1)
def trained(epochs: int = 8, rate: float = 0.5, ridge: float = 0.01) -> Model:
    w = np.zeros((len(TYPES), len(_NAMES)))
    w[1:, _AT["bias"]] = -2.0
    total = np.full_like(w, 1e-2)
    model, data, rng = Model(w), [], random.Random(5)
    for text, spans in training_sentences():
        win = Window(text, 0, len(text))
        at = {c: k for k, c in enumerate(win.cuts)}
        data.append((win, {(at[a], at[b], TYPES.index(k)) for k, a, b in spans if a in at and b in at}))
    for _ in range(epochs):
        rng.shuffle(data)
        for win, gold in data:
            for (k, x), g in model.gradient(win, gold).items():
                g -= ridge * w[k, x]
                total[k, x] += g * g
                w[k, x] += rate * g / total[k, x] ** 0.5
    return model


_MARKS = re.compile(r"[0-9@](?:[0-9A-Z .()/+@-]{0,24}[0-9@])*")


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches around each @ and each run with seven digits or more; those that meet are joined."""
    out: list[tuple[int, int]] = []
    for m in _MARKS.finditer(text):
        s = m.group()
        if "@" not in s and (len(s) < 7 or len(_digits(s)) < 7):
            continue
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def scan(text: str | None, model: Model, margin: float = MARGIN) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start, then kind."""
    text = text or ""
    base = base_spans(text)
    more: list[Span] = []
    taken = sorted((a, b) for _, a, b in base)
    for a, b in windows(text):
        win = Window(text, a, b)
        for i, j, k, gain in model.decode(win):
            x, y = win.cuts[i], win.cuts[j]
            if gain >= margin and not any(p < y and x < q for p, q in taken):
                more.append((TYPES[k], x, y))
    order = lambda s: (s[1], _RANK[s[0]], s[2])
    return sorted(base, key=order), sorted(base + more, key=order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans."""
    model = trained()
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf["text"].array:
                base, spans = scan(t, model, margin)
                n = [sum(s[0] == k for s in base) for k in BASE]
                out.append((*n, len(spans) - len(base), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            yield pd.DataFrame(out, columns=names[1:]).assign(doc_id=pdf["doc_id"].astype("Int64").to_numpy())[names]

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInPandas(run, schema)
