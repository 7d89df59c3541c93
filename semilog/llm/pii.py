"""Personal data by candidate gradient boosting.

High-recall generators propose spans that may overlap; boosted trees score each from its format and its context;
a calibrated threshold per kind selects. Four base patterns with fixed rules are always kept; what the trees select
is added where it overlaps no base span, best score first.

The trees are trained on synthetic sentences (``TRAIN_ROWS`` of them, made from a fixed seed), as no table labels
personal data; the driver fits them once and the model, a few kilobytes, goes along with the tasks.

Scans start only where a text has the character that a kind needs ('@', digits, '+'), and no pattern can walk the
same characters twice, so the time follows the length of the text.

Defined results: a null text has no spans; offsets are code points with the end exclusive; spans are ordered by
start, then kind; repeated rows give equal results; an empty table gives an empty table; other columns stay, and a
column named like an output is replaced. ``redact`` leaves null texts null.
"""

from __future__ import annotations

import random
import re
from bisect import bisect
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semilog.llm import boost
from semilog.llm.common import texts_of, with_arrow

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
TRAIN_ROWS, SEED, PRECISION = 6000, 7, 0.995

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Generators of candidates; each may propose what a base pattern has dropped or cannot see.
SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[({] ?(?i:at) ?[\])}] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({] ?(?i:dot) ?[\])}]) ?[A-Za-z0-9-]{1,63}){1,8}")
BARE = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: (?i:dot) [A-Za-z0-9_%+-]{1,63}){0,3} (?i:at) [A-Za-z0-9-]{1,63}(?:(?: (?i:dot) |\.)[A-Za-z0-9-]{1,63}){1,8}")
#: Names that mail domains often end with.
TOP = frozenset(("com", "org", "net", "edu", "gov", "info", "io", "eu", "de", "at", "ch", "fr", "es", "it", "nl", "uk", "us"))
NUMBER = re.compile(r"\(?[0-9](?:[ ().-]{0,2}[0-9])++")
DIGITS = re.compile(r"[0-9]+")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8}(?![A-Za-z0-9])")
CUES = {
    "email": re.compile(r"mail|contact|write|reach", re.I),
    "phone": re.compile(r"phone|call|tel\b|mobile|cell|fax|whatsapp|sms", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|debit|payment", re.I),
    "iban": re.compile(r"iban|account|bank|transfer", re.I),
    "ssn": re.compile(r"ssn|social|security|passport|national id", re.I),
    "other": re.compile(r"version|order|invoice|isbn|ticket|item|page|score|date|total|ref|serial|\$|€", re.I),
}
AROUND = 32
#: Proposals that are scored together; bounds memory for texts full of numbers.
SCORED_AT_ONCE = 1 << 14


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, each kind leftmost and non-overlapping."""
    out = []
    if "@" in text:
        floor = at = 0
        while m := DOMAIN.search(text, at):
            at = m.start()
            start = at
            while start > floor and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append((start, 0, m.end()))
                floor = at = m.end()
            else:
                at += 1
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(only_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def mod97(s: str) -> bool:
    moved = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all proposals, overlaps included."""
    out = []
    low = text if "@" not in text else text.replace("@", " ")
    if "(" in low or "[" in low or "{" in low:
        out += [(m.start(), 0, m.end()) for m in SPELLED.finditer(text)]
    if (" at " in text or " AT " in text) and re.search(r"\b(?i:dot)\b", text):
        out += [(m.start(), 0, m.end()) for m in BARE.finditer(text)]
    for m in NUMBER.finditer(text):
        groups = [g.span() for g in DIGITS.finditer(text, m.start(), m.end())]
        for i, (start, _) in enumerate(groups):
            # A number may stand beside others, so runs of whole groups are proposed too, if not of single digits mostly.
            n, start = 0, start - (start > m.start() and text[start - 1] == "(")
            start -= start > 0 and text[start - 1] == "+"
            for j in range(i, len(groups)):
                first, end = groups[j]
                n += end - first
                if n > 19 or end - start > 41:
                    break
                if n >= 7 and end - start >= 8 and (n >= 2 * (j - i) + 1 or i == 0 and j == len(groups) - 1):
                    out += [(start, k, end) for k, ok in ((2, n >= 12), (3, n <= 15), (5, n == 9)) if ok]
    if IBAN.search(text):
        out += [(m.start(), 4, m.end()) for m in IBAN.finditer(text)]
    return out


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    start, kind, end = span
    s = text[start:end]
    digits = only_digits(s)
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    left, right = before[-1:], after[:1]
    solid = s.replace(" ", "")
    return [
        kind, len(s), len(digits), len(digits) / len(s), len(groups), max(groups, default=0), min(groups, default=0),
        groups[0] if groups else 0, groups[-1] if groups else 0, s.count("-"), s.count("."), s.count(" "), "(" in s, s.startswith("+"),
        left.isalnum(), right.isalnum(), left in "$€£#", right in "%", luhn(digits) if kind == 2 else 0,
        kind == 4 and 15 <= len(solid) <= 34 and solid.isascii() and solid.isalnum() and mod97(solid),
        groups == [3, 2, 4], groups in ([3, 3, 4], [1, 3, 3, 4]), "dot" in s.lower(), len(set(digits)) if digits else 0,
        kind == 0 and re.split("[^A-Za-z]+", s.rstrip(")]} "))[-1].lower() in TOP, kind == 0 and any(c in s for c in "([{"), kind == 0 and len(re.findall(" dot ", s, re.I)),
        *(bool(c.search(before)) for c in CUES.values()), *(bool(c.search(after[:16])) for c in CUES.values()),
    ]


def synthetic(rows: int, seed: int) -> list[tuple[str, tuple[int, int, int], int]]:
    """Sentences with one marked span each, and whether it is personal data."""
    r = random.Random(seed)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice(["an", "the", "re", "on", "ti", "en", "ed", "or", "le", "de", "ung", "sch", "que"]) for _ in range(r.randint(1, 4)))

    def card() -> str:
        body = r.choice("3456") + num(r.choice((12, 14, 14, 14, 14)))
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = r.choice(("", " ", "-", "."))
        return sep.join(body[i : i + 4] for i in range(0, len(body), 4))

    def iban(good: bool) -> str:
        rest = num(r.randint(14, 20))
        if r.random() < 0.4:
            at = r.randrange(len(rest))
            rest = rest[:at] + "".join(r.choice("ABCDEFGHJKLMNPRSTUW") for _ in range(r.randint(1, 4))) + rest[at + 1 :]
        head = r.choice(("DE", "FR", "ES", "GB", "NL"))
        check = 98 - int("".join(str(int(c, 36)) for c in rest + head + "00")) % 97
        s = f"{head}{check if good else (check + r.randint(1, 90)) % 97 + 2:02d}{rest}"
        return s if r.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"0{num(2)} {num(3)} {num(4)}", f"0{num(3)} {num(3)} {num(4)}", f"0{num(2)} {num(6)} {num(2)}"))

    def spelled(good: bool) -> str:
        bare = r.random() < 0.4
        at, dot = (" at ", " dot ") if bare else (r.choice([" (at) ", "[at]", " [at] ", "(at)"]), r.choice([" (dot) ", "[dot]", "."]))
        top = r.choice(["com", "org", "net", "de", "fr", "ac dot uk", "edu"]) if good else word()
        return f"{word()}{r.choice(['.', '', '_'])}{word()}{at if good or bare else r.choice([' (at) ', ' (AT) '])}{word()}{dot if good or bare else ' . '}{top}"

    cue = {0: ["contact", "mail me:", "e-mail", "write to"], 2: ["card", "visa", "credit card number", "payment with"], 3: ["call", "phone:", "tel", "mobile", "fax"], 4: ["iban", "account", "bank transfer to"], 5: ["ssn", "social security number", "SSN:"]}
    wrong = ["version", "order", "invoice no", "isbn", "ticket", "item", "page", "score", "date", "total", "ref", "serial", "$"]
    out = []
    for _ in range(rows):
        kind, good, plain = r.choice((0, 2, 2, 3, 3, 4, 5)), r.random() < 0.5, r.random() < 0.3
        if kind == 0:
            s = spelled(good)
        elif kind == 2:
            s = card() if good else r.choice((num(16), num(13), " ".join(num(4) for _ in range(4)), num(12), f"{num(5)} {num(5)} {num(5)}"))
        elif kind == 3:
            s = phone() if good else r.choice((num(8), num(10), num(14), f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(3)}.{num(3)}.{num(3)}", f"{num(1)}.{num(2)}.{num(5)}", f"{num(4)} {num(4)}", f"{num(3)}-{num(10)}", f"{num(3)}-{num(2)}-{num(4)}", f"{num(3)}-{num(2)}-{num(4)}"))
        elif kind == 4:
            s = iban(good)
        else:
            s = f"{num(3)}-{num(2)}-{num(4)}" if good else r.choice((num(9), f"{num(3)}-{num(3)}-{num(3)}", f"{num(4)}-{num(2)}-{num(3)}", f"{num(3)} {num(2)} {num(4)}"))
        if good:
            hint = r.choice(cue[kind]) if not plain or kind in (3, 5) and r.random() < 0.8 else ""
        else:
            hint = r.choice([*wrong, *cue[5]] if kind == 3 else wrong) if r.random() < 0.5 else ""
        head = " ".join(word() for _ in range(r.randint(0, 6))) + (f" {hint} " if hint else " ")
        glued = kind in (2, 3, 5) and not good and r.random() < 0.3  # a number of something else, grown together with letters
        if glued and kind == 3 and r.random() < 0.7:
            s = phone()
        head, tail = (head + "A", " ") if glued and r.random() < 0.5 else (head, "X " if glued else " ")
        out.append((f"{head}{s}{tail}{' '.join(word() for _ in range(r.randint(0, 6)))}", (len(head), kind, len(head) + len(s)), int(good)))
    return out


class Selector:
    """Boosted trees, their calibration, and one threshold for each kind."""

    def __init__(self, rows: int = TRAIN_ROWS, seed: int = SEED, precision: float = PRECISION):
        made = synthetic(rows, seed)
        x = np.array([features(t, s) for t, s, _ in made], float)
        y = np.array([g for *_, g in made], float)
        fold = np.arange(len(y)) % 3
        self.model = boost.fit(x[fold == 0], y[fold == 0])
        self.slope, self.offset = boost.platt(self.model.margin(x[fold == 1]), y[fold == 1])
        p = self.probability(x)
        self.thresholds = {k: max(0.5, boost.precise_threshold(p[own], y[own], precision)) for k in range(len(KINDS)) if (own := (fold == 2) & (x[:, 0] == k)).any()}

    def probability(self, x: np.ndarray) -> np.ndarray:
        return boost.sigmoid(self.slope * self.model.margin(x) + self.offset)

    def spans(self, texts: list[str]) -> tuple[list[list], list[list]]:
        """Base spans and all spans of each text, ordered by start and kind."""
        base, proposals = [base_spans(t) for t in texts], []
        for i, t in enumerate(texts):
            own = candidates(t)
            if own and base[i]:
                own = [c for c in own if not any(c[0] < e and s < c[2] for s, _, e in base[i])] if len(own) * len(base[i]) < 4096 else clear(own, base[i])
            proposals += [(i, c) for c in own]
        every = [list(b) for b in base]
        if proposals:
            scored = [proposals[at : at + SCORED_AT_ONCE] for at in range(0, len(proposals), SCORED_AT_ONCE)]
            p = np.concatenate([self.probability(np.array([features(texts[i], c) for i, c in part], float)) for part in scored])
            chosen: dict[int, list] = {}
            for (i, c), score in sorted(zip(proposals, p.tolist()), key=lambda v: (v[0][0], -v[1], v[0][1])):
                if score >= self.thresholds.get(c[1], 1.1):
                    chosen.setdefault(i, []).append(c)
            for i, own in chosen.items():
                taken: list[tuple[int, int, int]] = []
                for c in own:
                    at = bisect(taken, c)
                    if (at == 0 or taken[at - 1][2] <= c[0]) and (at == len(taken) or c[2] <= taken[at][0]):
                        taken.insert(at, c)
                every[i] = sorted(base[i] + taken)
        return base, every


def clear(own: list[tuple[int, int, int]], taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those spans of ``own`` that overlap none of ``taken`` (ordered by start)."""
    starts = np.array([s for s, _, _ in taken], np.int64)
    reach = np.maximum.accumulate(np.array([e for *_, e in taken], np.int64)) if taken else starts
    return [c for c in own if (at := int(np.searchsorted(starts, c[2]))) == 0 or reach[at - 1] <= c[0]]


@lru_cache(maxsize=2)
def selector(rows: int = TRAIN_ROWS, seed: int = SEED) -> Selector:
    return Selector(rows, seed)


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, text_col: str = "text", model: Selector | None = None) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans`` (arrays of kind, start, end)."""
    model = model or selector()
    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make(texts: pa.Array) -> list[pa.Array]:
        rows = lambda lists: pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in own] for own in lists], arrow)
        return [rows(lists) for lists in model.spans(texts_of(texts))]

    return with_arrow(docs, [text_col], [T.StructField("base_spans", T.ArrayType(item)), T.StructField("spans", T.ArrayType(item))], make)


def redact(docs: DataFrame, text_col: str = "text", model: Selector | None = None) -> DataFrame:
    """``docs`` with every span of its text replaced by ``<KIND>``; overlapping spans become one, named by the first."""
    model = model or selector()

    def make(texts: pa.Array) -> list[pa.Array]:
        plain = texts_of(texts)
        out = []
        for raw, text, spans in zip(texts.to_pylist(), plain, model.spans(plain)[1]):
            parts, last = [], 0
            for s, k, e in spans:
                if s >= last:
                    parts += [text[last:s], f"<{KINDS[k].upper()}>"]
                last = max(last, e)
            out.append("".join([*parts, text[last:]]) if spans else raw)
        return [pa.array(out, pa.string())]

    return with_arrow(docs, [text_col], [docs.schema[text_col]], make).select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """Per document the base counts, the digest of the base spans, and all spans."""
    text_of = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    found = find(docs.select("doc_id", "text"))
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(text_of("base_spans").cast("binary"), 256).alias("base_sha256"), text_of("spans").alias("spans"))
