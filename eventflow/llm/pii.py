"""Personal data by weak supervision.

Four base kinds follow fixed grammars and are always reported.  Beyond them, candidate
spans (words with a digit, values of named fields, telephone-like groups, account and identity
numbers, dates, names after a title, streets) are judged by
labelers that vote for, against, or not at all: regular expressions of known key
formats, check digits, gazetteers of field names, given names and street words, the context in front, and the shape of the string.
Expectation-maximisation estimates each labeler's reliability from how the votes of all
candidates agree, without labels; its posteriors train the final span classifier, a logistic
model on the votes, the kind and binary features of shape and surroundings.  Both are drawn to prior counts and weights, which
decide for kinds that a corpus hardly shows.

Candidates are folded into counts of (votes, features) patterns by Spark, so the
estimates use every candidate of the corpus while the driver sees a table whose size
depends on the patterns possible, not on the data.

Spans are half-open code point ranges.  Null or empty texts have none.  Rows are judged one by one, so repeated rows and
null ids need no care.  Time and memory follow the length of a text, however many spans it has; texts are read a piece at a time, a very
long one alone.  Of candidates that overlap, the kind listed first counts.  Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventflow.llm.common import col, text_slices

KINDS = ("email", "ip", "card", "phone")
ADDED = ("iban", "national_id", "birth_date", "phone_local", "street", "person", "secret")
_ORDER = {k: i for i, k in enumerate((*KINDS, *ADDED))}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can only begin where a run of digits does, so looking elsewhere is spared.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i & 1:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of local@domain; the local part is the run in front of each @, so long words cost no rescans."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at + 1):
            s = at
            while s > floor and text[s - 1] in _LOCAL:
                s -= 1
            if s < at:
                out.append((s, m.end()))
                floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", s, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 12 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], _ORDER[x[0]]))


def spelled(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


# Candidates beyond the base kinds

# Where a pattern can begin is told by one set of characters, so that looking elsewhere is quick.
_TOKEN = re.compile(r"[A-Za-z0-9_\-./+~]++")
_TOKEN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-./+~")
_DIGITS = re.compile(r"[0-9]++")
_FIELD = re.compile(r"([A-Za-z_][A-Za-z0-9_-]{0,39})[\x20\t]?(=>|=|:|is)[\x20\t]?[\"']?$")
_LOCAL_PHONE = re.compile(r"[(0-9](?:(?<=\()[0-9]{3}\)\x20?|(?<=[0-9])[0-9]{2}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])")
_NUMERIC = re.compile(r"[0-9][0-9./-]*+")
_NATIONAL = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_DATE = re.compile(r"[0-3]?[0-9]([./-])[0-3]?[0-9]\1(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NAME = r"[A-Z\u00c0-\u00de][\w'-]{1,30}(?:\x20[A-Z\u00c0-\u00de][\w'-]{1,30}){0,2}"
_PERSON = re.compile(rf"\b(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Se\u00f1or|Se\u00f1ora|Sra?)\.?\x20|(?i:full[_\x20]?name|name|nom|nombre)\x20?[:=]\x20?[\"']?)({_NAME})")
_STREET = re.compile(
    r"(?<![0-9])[0-9]{1,5}\x20(?:[A-Z][a-z]{1,20}\x20){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Boulevard|Blvd|Way|Court)\b"
    r"|\b[A-Z\u00c4\u00d6\u00dc][a-z\u00e4\u00f6\u00fc\u00df]{2,30}(?:stra\u00dfe|strasse|weg|platz|gasse|allee)\x20[0-9]{1,4}[a-z]?\b"
    r"|(?<![0-9])[0-9]{1,4},?\x20(?:rue|avenue|boulevard|place)\x20(?:(?:de|du|des|la|le)\x20){0,2}[A-Z\u00c0-\u00de]\w{1,20}"
    r"|\b(?:[Cc]alle|[Aa]venida|[Pp]laza)\x20(?:(?:de|del|la)\x20){0,2}[A-Z\u00c0-\u00de]\w{1,20},?\x20[0-9]{1,4}\b"
)
_KEY_FORMAT = re.compile(r"A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+|[0-9a-f]{32,128}|[A-Z0-9]{20}")
#: Of each, a text holds one if it holds a match.
_PERSON_SIGNS = ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Mlle", "Monsieur", "Madame", "Se\u00f1or", "Sr")
_STREET_SIGNS = ("Street", " St", "Road", " Rd", " Ave", "Lane", " Ln", " Drive", " Boulevard", " Blvd", " Way", " Court", "stra\u00dfe", "strasse", "weg ", "platz ", "gasse ", "allee ", " rue ", " avenue ", " boulevard ", " place ", "alle ", "venida ", "laza ")
_VERSION = re.compile(r"v?[0-9]+(?:[./-][0-9]+)*[.-]?")
_DATE_FIRST = re.compile(r"[^0-9]+")

#: Names of fields that hold secrets; the gazetteer of the field labeler.
_FIELDS = frozenset("password passwd pwd pass passphrase pin secret token apikey api_key api-key key access_key secret_key private_key auth authorization bearer credential credentials session sessionid client_secret access_token refresh_token".split())
#: A named field whose value is a candidate whatever its letters.
_VALUE = re.compile(r"[=:]>?\x20?[\"']?([^\s\"'=:][^\s\"']{3,200})")
_NAMED = re.compile(r"(?<![A-Za-z0-9])(?:[A-Za-z]{1,20}[_-])?(?:password|passwd|pwd|passphrase|secret|api[_-]?key|apikey|token)[\"']?\x20?$", re.I)
#: Words that tell of a kind when they stand before it.
_BEFORE = {
    "phone_local": frozenset("tel telephone phone mobile cell call fax contact whatsapp".split()),
    "national_id": frozenset("ssn social security id identity number".split()),
    "iban": frozenset("iban account konto compte cuenta bank transfer pay".split()),
    "birth_date": frozenset("born birth birthday birthdate dob geboren geburtsdatum n\u00e9 n\u00e9e naissance nacido nacida nacimiento".split()),
    "street": frozenset("address live lives living at home adresse wohnhaft wohnt habite domicile direcci\u00f3n domicilio vive".split()),
    "person": frozenset("signed by from dear contact patient client employee author customer".split()),
    "secret": frozenset("password secret token key credential bearer login".split()),
}
#: Common given names.
_GIVEN = frozenset("james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen peter anna paul maria hans petra klaus ursula jean marie pierre nathalie jos\u00e9 carmen antonio ana luis laura carlos elena".split())

#: Names of the labelers, in the order of a pattern's votes.
LABELERS = ("key_format", "field_name", "assignment", "random_looking", "plain_number", "check_digits", "layout", "short_word", "context", "gazetteer", "embedded")
FEATURES = (*(f"for_{x}" for x in LABELERS), *(f"against_{x}" for x in LABELERS), *(f"is_{k}" for k in ADDED), "long", "letters_and_digits", "many_turns", "upper", "quoted", "mostly_digits", "varied", "line_start")
#: Prior weights of FEATURES and the constant, which decide where a corpus shows too little.
_PRIOR = {"for_key_format": 2.0, "for_field_name": 2.5, "for_assignment": 0.5, "for_random_looking": 1.0, "for_check_digits": 2.0, "for_layout": 1.0, "for_context": 2.0, "for_gazetteer": 1.5, "against_plain_number": -2.0, "against_random_looking": -1.0, "against_check_digits": -3.0, "against_short_word": -1.0, "against_context": -1.5, "against_embedded": -2.0}
_CONSTANT = -1.5


class Taken:
    """Disjoint ranges, for looking up whether a range meets any."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, s: int, e: int) -> bool:
        k = bisect_left(self.starts, e)
        return k > 0 and self.ends[k - 1] > s


def candidates(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, tuple[int, ...], tuple[int, ...]]]:
    """(kind, start, end, votes, features) of spans that neither a base span nor an earlier kind overlaps."""
    spans = [(s, e) for _, s, e in base]
    taken = Taken(spans)
    for kind, found in _found(text):
        new = [(s, e) for s, e in found if not taken.meets(s, e)]
        for s, e in new:
            yield _judged(kind, text, s, e)
        if new:
            spans += new
            taken = Taken(spans)
    end = 0
    for m in _DIGITS.finditer(text):
        if m.start() < end:
            continue
        s = m.start()
        while s > end and text[s - 1] in _TOKEN_CHARS:
            s -= 1
        end = e = _TOKEN.match(text, s).end()
        while e > s and text[e - 1] in ".-/+":
            e -= 1
        if e > s and not taken.meets(s, e):
            yield _judged("secret", text, s, e)


def _found(text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Places of each kind but words with digits, in the order in which kinds count."""
    yield "iban", [m.span() for m in _IBAN.finditer(text)]
    numbers = []
    for m in _NUMERIC.finditer(text):
        s, e = m.span()
        while text[e - 1] in "./-":
            e -= 1
        if 8 <= e - s <= 11 and text[s - 1 : s] not in (".", "/", "-") and text[e : e + 1] not in ("/", "-"):
            numbers.append((s, e))
    yield "national_id", [x for x in numbers if _NATIONAL.fullmatch(text, *x)]
    yield "birth_date", [x for x in numbers if _DATE.fullmatch(text, *x)]
    yield "phone_local", [m.span() for m in _LOCAL_PHONE.finditer(text) if text[m.start() - 1 : m.start()] != "+" and not text[m.start() - 1 : m.start()].isdigit()]
    if any(w in text for w in _STREET_SIGNS):
        yield "street", [m.span() for m in _STREET.finditer(text)]
    valued = ":" in text or "=" in text
    if any(w in text for w in _PERSON_SIGNS) or valued and any(w in text.lower() for w in ("name", "nom")):
        yield "person", [m.span(1) for m in _PERSON.finditer(text)]
    if valued:
        named = []
        for m in _VALUE.finditer(text):
            s, e = m.span(1)
            while e > s and text[e - 1] in ".,;:)]}":
                e -= 1
            if e - s >= 4 and _NAMED.search(text[max(0, m.start() - 50) : m.start()]):
                named.append((s, e))
        yield "secret", named


def _sound(kind: str, value: str) -> int:
    """1 or -1 if check digits or the numbers' own rules say so, else 0."""
    if kind == "iban":
        v = value.replace(" ", "")
        return 1 if 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1 else -1
    if kind == "national_id":
        area, group, serial = value.split("-")
        return -1 if area in ("000", "666") or area >= "900" or group == "00" or serial == "0000" else 1
    if kind == "birth_date":
        parts = [int(p) for p in _DATE_FIRST.split(value)]
        year, rest = (parts[0], parts[1:]) if parts[0] > 31 else (parts[2], parts[:2])
        return 0 if min(rest) >= 1 and min(rest) <= 12 and max(rest) <= 31 and 1900 <= year <= 2030 else -1  # being a date tells nothing of whose
    return 0


def _judged(kind: str, text: str, s: int, e: int) -> tuple[str, int, int, tuple[int, ...], tuple[int, ...]]:
    v, before = text[s:e], text[max(0, s - 60) : s]
    secret = kind == "secret"
    field = _FIELD.search(before)
    name = field.group(1).lower() if field else ""
    named = secret and (name in _FIELDS or any(name.endswith(x) for x in ("_key", "_token", "_secret", "password", "-key")))
    digits, letters = len(_NOT_DIGIT.sub("", v)), sum(c.isalpha() for c in v)
    mixed = digits > 0 and letters > 0
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(v, v[1:]))
    random = secret and len(v) >= 12 and mixed and turns >= 3
    known = secret and mixed and bool(_KEY_FORMAT.fullmatch(v))
    plain = secret and bool(_VERSION.fullmatch(v))
    near = {w.lower().strip(".:,=\"'(") for w in before.split()[-3:]}
    told = bool(near & _BEFORE[kind]) or name in _BEFORE[kind]
    after = text[e : e + 1]
    votes = (
        1 if known else 0,
        1 if named else (-1 if name and secret and not random else 0),
        1 if field and field.group(2) in ("=", "=>") else 0,
        1 if random else (-1 if secret and not named else 0),
        -1 if plain else 0,
        _sound(kind, v),
        1 if kind in ("phone_local", "street") or kind == "person" and " " in v else 0,
        -1 if secret and len(v) < 8 and not named else 0,
        1 if told else (-1 if kind in ("birth_date", "phone_local") else 0),
        1 if kind == "street" or kind == "person" and v.split()[0].lower() in _GIVEN or kind == "person" and not field else 0,
        -1 if not field and (before[-1:] in ("/", "#", "&", "?") or after in ("/", "@")) else 0,
    )
    shape = (len(v) >= 16, mixed, turns >= 5, v.isupper(), before[-1:] in ("\"", "'"), 2 * digits > len(v), len(set(v)) >= 10, before[-1:] in ("", "\n"))
    features = (*(int(x > 0) for x in votes), *(int(x < 0) for x in votes), *(int(kind == k) for k in ADDED), *map(int, shape))
    return kind, s, e, votes, features


# Reliabilities and the final classifier


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1): posteriors, P(vote | class) [labeler, class, vote + 1], and the share of positives.

    Prior counts say that a labeler is right more often than not.
    """
    vote = votes.astype(int) + 1
    post = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1)))  # start from the majority
    prior = np.array([[3.0, 2.0, 1.0], [1.0, 2.0, 3.0]])
    n_lab = votes.shape[1]
    table, share = np.full((n_lab, 2, 3), 1 / 3), 0.5
    for _ in range(rounds):
        share = min(max(float((counts * post).sum() / counts.sum()), 1e-4), 1 - 1e-4)
        for j in range(n_lab):
            for c, p in ((0, 1 - post), (1, post)):
                got = np.bincount(vote[:, j], weights=counts * p, minlength=3) + prior[c]
                table[j, c] = got / got.sum()
        log = np.stack([sum(np.log(table[j, c, vote[:, j]]) for j in range(n_lab)) for c in (0, 1)])
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1] + math.log((1 - share) / share), -50, 50)))
    return post, table, share


def span_classifier(features: np.ndarray, target: np.ndarray, counts: np.ndarray, ridge: float = 5.0, steps: int = 30) -> np.ndarray:
    """Weights (the last is the constant) of a logistic model of the posteriors, by Newton steps from the prior weights."""
    x = np.hstack([features.astype(float), np.ones((len(features), 1))])
    prior = np.array([*(_PRIOR.get(f, 0.0) for f in FEATURES), _CONSTANT])
    w = prior.copy()
    weight = counts / counts.sum() * min(counts.sum(), 1e4)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - target)) + ridge * (w - prior)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


_PATTERN = pa.schema([("votes", pa.string()), ("features", pa.string()), ("n", pa.int64())])


#: Text without any of these has neither base spans nor candidates.
_MARKS = r"[0-9@]|(?i:password|passwd|pwd|passphrase|secret|api[_-]?key|token|name|nom|nombre)[\"']?\x20?[:=]|\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señor|Señora|Sra?)\b"
_PIECE_BYTES = 4 << 20


def _worth_a_look(texts: pa.Array) -> np.ndarray:
    return np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring_regex(texts, _MARKS), False)))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        counts: dict[tuple[tuple[int, ...], tuple[int, ...]], int] = {}
        for _, texts in text_slices(rb.column(0), _PIECE_BYTES):
            for i in _worth_a_look(texts).tolist():
                t = texts[i].as_py()
                for *_, votes, features in candidates(t, base_spans(t)):
                    counts[votes, features] = counts.get((votes, features), 0) + 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([" ".join(map(str, k[i])) for k in keys], pa.string()) for i in (0, 1)] + [pa.array([counts[k] for k in keys], pa.int64())], schema=_PATTERN)


def train(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, dict[str, float]]:
    """Classifier weights, and each labeler's estimated accuracy where it votes."""
    rows = docs.select(col(text_col)).mapInArrow(_patterns, "votes string, features string, n long").groupBy("votes", "features").agg(F.sum("n").alias("n")).orderBy("votes", "features").collect()  # as many as there are patterns
    if not rows:
        return np.zeros(0), {}
    votes, features = (np.array([[int(x) for x in r[i].split()] for r in rows]) for i in (0, 1))
    counts = np.array([r[2] for r in rows], float)
    post, table, share = reliabilities(votes, counts)
    right = {}
    for j, name in enumerate(LABELERS):
        said = (1 - share) * (table[j, 0, 0] + table[j, 0, 2]) + share * (table[j, 1, 0] + table[j, 1, 2])
        right[name] = float(((1 - share) * table[j, 0, 0] + share * table[j, 1, 2]) / said) if said else 0.5
    return span_classifier(features, post, counts), right


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, base counts, base_sha256, ``spans`` (base spans and those the classifier adds, by start, then kind) and n_added, n_spans."""
    weights, _ = train(docs, text_col)
    names = [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"]
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for at, texts in text_slices(rb.column(1), _PIECE_BYTES):
                n, sha, spans = np.zeros((6, len(texts)), np.int64), [none] * len(texts), [""] * len(texts)
                for i in _worth_a_look(texts).tolist():
                    t = texts[i].as_py()
                    base = base_spans(t)
                    for k, _, _ in base:
                        n[_ORDER[k], i] += 1
                    added = [(k, s, e) for k, s, e, _, f in candidates(t, base) if float(np.dot(weights[:-1], f)) + weights[-1] > 0] if len(weights) else []
                    n[4, i], n[5, i] = len(added), len(added) + len(base)
                    sha[i] = hashlib.sha256(spelled(base).encode()).hexdigest()
                    spans[i] = spelled(sorted(base + added, key=lambda x: (x[1], _ORDER[x[0]])))
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(at, len(texts)), *(pa.array(x) for x in n[:4]), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(n[4]), pa.array(n[5])], names=names)

    made = docs.select(col(id_col)).schema
    for name in names[1:]:
        made = made.add(name, "string" if name in ("base_sha256", "spans") else "long")
    return docs.select(col(id_col), col(text_col).alias("__text")).mapInArrow(run, made)
