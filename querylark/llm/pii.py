"""Personal data in texts: base patterns and a semi-Markov conditional random field.

Base spans (email, ip, card, phone) are fixed patterns, found leftmost and without overlap within a kind. The field
adds spans that they miss: secrets, and the same kinds written in other ways. It runs over the runs of tokens
around anything that a shape of an added span needs: a digit, "@", "=", "[", "at" or "dot" as a word or in brackets, a
word like "password", or the beginning of a key ("at" only where a domain follows it); a token is a run of non-space characters.
Candidate segments are all windows of at most MAX_TOKENS tokens, each with every kind. They are scored as wholes: shapes that
the window has as a whole or lacks, digits, checksums, the word before it, whether a longer one would do; and pairs of
neighbouring labels have scores, too. Dynamic programming over segment ends picks the boundaries and types with the highest
joint score. The weights maximise the conditional likelihood (forward-backward sums over all segmentations, limited-memory
BFGS, a quadratic penalty) of sentences that a fixed generator writes; nothing is read from a corpus. A window without any
of what starts a run never has a positive score for any kind (tests hold the weights to it), so runs lose nothing.
Added spans never overlap base spans, which stay as they are.

Edge cases: null texts are empty and have no spans; a long text is scanned in linear time; repeated rows are treated
alike; rows without doc_id too; runs of more than REGION tokens are decoded in pieces that share MAX_TOKENS tokens, so that
any span lies whole in one; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import inf

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Kinds in their order; base patterns have the first four.
KINDS = ("email", "ip", "card", "phone", "secret", "id")
#: Tokens of the longest span that the shapes allow (iban: nine groups), but for spelled emails, which go on below.
MAX_TOKENS = 9
REGION = 512

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits begins: from later digits the same dots follow.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern from each @: the longest local part before it, then the longest domain."""
    end, at = 0, text.find("@")
    while at >= 0:
        if at >= end:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                end = m.end()
                yield start, end
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds, by start, then kind."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_only_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# The field ------------------------------------------------------------------------------------------------------

_CUES = {
    "email": frozenset("email e-mail mail contact mailto correo".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax telefon téléphone teléfono handy".split()),
    "secret": frozenset("password passwd pwd secret token api_key apikey key passwort contraseña bearer credential".split()),
    "card": frozenset("card visa mastercard amex karte carte tarjeta".split()),
    "id": frozenset("ssn social iban passport account konto license".split()),
    "ip": frozenset("ip host address server".split()),
}
#: The end of a sentence within a span.
_STOP = re.compile(r"\w\.\s")
_CUE_WORDS = {w: k for k, ws in _CUES.items() for w in ws}
_TOKEN = re.compile(r"\S+")
#: What starts a region: every shape that is allowed below needs one of these.
_TRIGGER = re.compile(r"[0-9@=\[]|\((?:at|dot)\)|(?<!\S)at\s+[A-Za-z0-9-]+\s*\.\s*[A-Za-z0-9-]|(?<!\S)dot(?!\S)|passw(?:or)?d|pwd|secret|token|api_?key|(?:AKIA|ASIA)[A-Z]{16}|(?:sk|pk|ghp|gho|xox[bap])[-_][a-z_-]{16}|[a-f]{32}", re.I)
_TRIM_LEFT, _TRIM_RIGHT = "\"'([{<“«", "\"')]}>.,;:!?”»"
_SHAPES: dict[str, re.Pattern[str]] = {
    "access_key": re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}"),
    "assigned": re.compile(r"(?:password|passwd|pwd|secret|token|api_?key)[=:][\"']?[^\s\"']{6,}[\"']?", re.I),
    "assigned_apart": re.compile(r"(?:password|passwd|pwd|secret|token|api_?key)\s*[=:]\s*[\"']?[A-Za-z0-9+/_-]{8,}[\"']?", re.I),
    "prefixed_key": re.compile(r"(?:sk|pk|ghp|gho|xox[bap])[-_][A-Za-z0-9_-]{16,}"),
    "hex_run": re.compile(r"[0-9a-f]{32,}", re.I),
    "local_phone": re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
    "zero_phone": re.compile(r"00[1-9][0-9 ().-]{8,16}[0-9]"),
    "spelled_email": re.compile(r"[A-Za-z0-9._%+-]+\s*(?:\[at\]|\(at\)|\sat\s)\s*[A-Za-z0-9-]+(?:\s*(?:\[dot\]|\(dot\)|\sdot\s|\.)\s*[A-Za-z0-9-]+)+", re.I),
    "ssn": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?"),
    "date": re.compile(r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}"),
    "number": re.compile(r"[0-9][0-9.,:]*%?"),
}
#: What begins a span of any shape but "none"; few places do.
_BEGINS = re.compile(
    r"[0-9(]|AKIA|ASIA|passw|pwd|secret|token|api|(?:sk|pk|ghp|gho|xox[bap])[-_]|[0-9a-f]{32}|[A-Z]{2}[0-9]{2}|[A-Za-z0-9._%+-]+\s*(?:\[at\]|\(at\)|\sat\s)", re.I
)
#: Shapes that have white space in them.
_SPACED = ("assigned_apart", "local_phone", "zero_phone", "spelled_email", "iban")
#: The longest iban at a place, and what of a spelled email goes on after MAX_TOKENS tokens.
_WHOLE_IBAN = re.compile(_SHAPES["iban"].pattern + r"(?![A-Za-z0-9])")
_LABELS = re.compile(r"(?:\s*(?:\[dot\]|\(dot\)|\sdot\s)\s*[A-Za-z0-9-]+)+", re.I)
#: Kinds that the field gives, and its labels: outside, then these.
FIELD = ("email", "phone", "secret", "id")
_LABELS_OF = len(FIELD) + 1


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def trimmed(text: str, token: tuple[int, int]) -> tuple[int, int]:
    """A token's first place that isn't punctuation before a span, and the place behind its last that isn't punctuation behind one."""
    a, b = token
    while a < token[1] and text[a] in _TRIM_LEFT:
        a += 1
    while b > token[0] and text[b - 1] in _TRIM_RIGHT:
        b -= 1
    return a, b


def window(text: str, tokens: list[tuple[int, int]], k: int, n: int) -> tuple[int, int]:
    """The span of tokens k..k+n-1 without the punctuation around it; empty if nothing is left."""
    a, b = trimmed(text, tokens[k])[0], trimmed(text, tokens[k + n - 1])[1]
    if a > tokens[k][0] and text[a - 1] == "(" and ")" in text[a:b]:
        a -= 1
    return a, b


def cue_before(text: str, tokens: list[tuple[int, int]], k: int) -> str | None:
    """The kind that the word before token k announces."""
    return _CUE_WORDS.get(text[slice(*tokens[k - 1])].lower().strip(_TRIM_LEFT + _TRIM_RIGHT + "=")) if k else None


def shapes_of(text: str, a: int, b: int, n: int) -> list[str]:
    """Names of the shapes that span (a, b), of n tokens, has as a whole."""
    if b - a < 6 or not _BEGINS.match(text, a):
        return []
    return [x for x in (_SHAPES if n == 1 else _SPACED) if _SHAPES[x].fullmatch(text, a, b)]


def features(text: str, tokens: list[tuple[int, int]], k: int, n: int, a: int, b: int) -> list[str]:
    """Whole-span features of a window with span (a, b)."""
    shapes, cue = shapes_of(text, a, b, n), cue_before(text, tokens, k)
    if not shapes:
        return ["bias", "shape=none", *([f"cue={cue}|none"] if cue else [])]
    span = text[a:b]
    out = ["bias", f"tokens={n}", *(f"shape={x}" for x in shapes), *([f"cue={cue}"] if cue else [])]
    digits = _only_digits(span)
    out.append(f"digits={min(len(digits), 16) // 2}")
    if "iban" in shapes:
        out.append(f"iban={_iban_ok(span)}")
        if not _iban_ok(span) and (_iban_ok(span.rpartition(" ")[0]) or (m := _WHOLE_IBAN.match(text, a)) and m.end() > b):
            out.append("iban|other")
    if "spelled_email" in shapes and k + n < len(tokens) and _LABELS.match(text, b):
        out.append("email|longer")
    if span[:1] in "\"'[{<" or span[-1:] in _TRIM_RIGHT:
        out.append("ragged")
    if _STOP.search(span):
        out.append("stop")
    if 13 <= len(digits) <= 19 and luhn(digits):
        out.append("luhn")
    return out


class Field:
    """Weights: for each feature one a kind of FIELD; for each pair of labels that follow each other one."""

    def __init__(self, names: list[str], weights: np.ndarray, follow: np.ndarray) -> None:
        self.weights = {x: tuple(w) for x, w in zip(names, weights.tolist())}
        self.follow: list[list[float]] = follow.tolist()
        self.none = (0.0,) * len(FIELD)
        #: Scores of windows without a shape, by the kind that the word before announces.
        self.shapeless = {cue: self.score(["bias", "shape=none", *([f"cue={cue}|none"] if cue else [])]) for cue in (None, *KINDS)}

    def score(self, names: list[str]) -> tuple[float, ...]:
        own = [self.weights.get(x, self.none) for x in names]
        return tuple(map(sum, zip(*own)))


def decode(text: str, tokens: list[tuple[int, int]], field: Field) -> list[tuple[int, int, Span]]:
    """The segmentation with the highest score, as (first token, count, span); of equal ones the one with fewer and shorter segments."""
    follow, labels = field.follow, range(_LABELS_OF)
    edges = [trimmed(text, t) for t in tokens]
    cues = [cue_before(text, tokens, k) for k in range(len(tokens))]
    begins = [bool(_BEGINS.match(text, a) or a > t[0] and text[a - 1] == "(") for (a, _), t in zip(edges, tokens)]
    # best[k][y]: the best of the first k tokens whose last segment has label y; enter[k][y]: the same with label y to follow.
    best = [[0.0, *[-inf] * len(FIELD)]]
    enter: list[list[tuple[float, int]]] = []
    back: list[list[tuple[int, int, Span | None]]] = [[(0, 0, None)] * _LABELS_OF]
    plain: list[list[tuple[float, int]]] = []  # for each k, enter[k][y] with the score of a window without a shape
    for end in range(1, len(tokens) + 1):
        own = best[end - 1]
        enter.append([max((own[x] + follow[x][y], -x) for x in labels) for y in labels])
        none = field.shapeless[cues[end - 1]]
        plain.append([(s + none[y - 1], x) if y else (s, x) for y, (s, x) in enumerate(enter[-1])])
        now = [enter[end - 1][0][0], *[-inf] * len(FIELD)]
        from_ = [(1, -enter[end - 1][0][1], None), *[(0, 0, None)] * len(FIELD)]
        b = edges[end - 1][1]
        for n in range(1, min(MAX_TOKENS, end) + 1):
            k = end - n
            a = edges[k][0]
            if begins[k]:
                a = window(text, tokens, k, n)[0]
                if a >= b:
                    continue
                scores = field.score(features(text, tokens, k, n, a, b))
                reached = [(s + scores[y - 1], x) if y else (s, x) for y, (s, x) in enumerate(enter[k])]
            elif a < b:
                reached = plain[k]
            else:
                continue
            for y in range(1, _LABELS_OF):
                if reached[y][0] > now[y]:
                    now[y], from_[y] = reached[y][0], (n, -reached[y][1], (FIELD[y - 1], a, b))
        best.append(now)
        back.append(from_)
    out, end = [], len(tokens)
    y = max(labels, key=lambda y: (best[end][y], -y))
    while end:
        n, x, span = back[end][y]
        if span:
            out.append((end - n, n, span))
        end, y = end - n, x
    return out[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


class Likelihood:
    """Negative conditional log likelihood of sentences and its gradient, by forward-backward sums over all segmentations."""

    def __init__(self, data: list[tuple[str, list[Span]]], penalty: float) -> None:
        self.penalty = penalty
        ids: dict[str, int] = {}
        at: list[tuple[int, int, int]] = []
        flat: list[int] = []
        sizes: list[int] = []
        gold: list[list[float]] = []
        self.length: list[int] = []
        follow = np.zeros((_LABELS_OF, _LABELS_OF))
        for text, spans in data:
            tokens = [m.span() for m in _TOKEN.finditer(text)]
            wanted = {(a, b): FIELD.index(kind) for kind, a, b in spans}
            found: dict[int, tuple[int, int]] = {}
            rows = []
            for end in range(1, len(tokens) + 1):
                for n in range(1, min(MAX_TOKENS, end) + 1):
                    a, b = window(text, tokens, end - n, n)
                    if a < b:
                        kind = wanted.get((a, b))
                        rows.append((end, n, features(text, tokens, end - n, n, a, b), kind))
                        if kind is not None:
                            found[end - n] = n, kind + 1
            if len(found) != len(spans):
                continue  # a span that no window has
            s = len(self.length)
            self.length.append(len(tokens))
            for end, n, names, kind in rows:
                at.append((s, end, n))
                flat += [ids.setdefault(x, len(ids)) for x in names]
                sizes.append(len(names))
                gold.append([float(kind == y) for y in range(len(FIELD))])
            k, y = 0, 0
            while k < len(tokens):
                n, z = found.get(k, (1, 0))
                follow[y, z] += 1
                k, y = k + n, z
        self.names = list(ids)
        self.at, self.flat, self.gold, self.gold_follow = np.array(at), np.array(flat), np.array(gold), follow
        self.first, self.row = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(sizes)), sizes)
        self.ends = np.array(self.length)

    def __call__(self, v: np.ndarray) -> tuple[float, np.ndarray]:
        kinds, labels, most = len(FIELD), _LABELS_OF, MAX_TOKENS
        f = len(self.names)
        w, follow = v[: f * kinds].reshape(f, kinds), v[f * kinds :].reshape(labels, labels)
        score = np.add.reduceat(w[self.flat], self.first, axis=0)
        s, e, n = self.at.T
        count, t = len(self.ends), int(self.ends.max())
        phi = np.full((count, t + 1, most + 1, kinds), -np.inf)
        phi[s, e, n] = score
        alpha, enter = np.full((count, t + 1, labels), -np.inf), np.full((count, t + 1, labels), -np.inf)
        alpha[:, 0, 0] = 0
        for k in range(t + 1):
            if k:
                alpha[:, k, 0] = enter[:, k - 1, 0]
                m = min(most, k)
                alpha[:, k, 1:] = _log_sum(enter[:, k - m : k, 1:][:, ::-1] + phi[:, k, 1 : m + 1], 1)
            enter[:, k] = _log_sum(alpha[:, k, :, None] + follow[None], 1)
        rows = np.arange(count)
        z = _log_sum(alpha[rows, self.ends], 1)
        beta, leave = np.full((count, t + 1, labels), -np.inf), np.full((count, t + 1, labels), -np.inf)
        for k in range(t, -1, -1):
            m = min(most, t - k)
            if m:
                leave[:, k, 0] = beta[:, k + 1, 0]
                steps = np.arange(1, m + 1)
                leave[:, k, 1:] = _log_sum(phi[:, k + steps, steps] + beta[:, k + steps, 1:], 1)
                beta[:, k] = _log_sum(follow[None] + leave[:, k, None, :], 2)
            beta[self.ends == k, k] = 0
        inside = np.exp(enter[s, e - n, 1:] + score + beta[s, e, 1:] - z[s][:, None])
        gap = inside - self.gold
        grad = np.stack([np.bincount(self.flat, weights=gap[self.row, y], minlength=f) for y in range(kinds)], 1)
        with np.errstate(invalid="ignore"):
            turns = np.exp(alpha[:, :, :, None] + follow[None, None] + leave[:, :, None, :] - z[:, None, None, None])
        turns = np.where(np.arange(t + 1)[None, :, None, None] < self.ends[:, None, None, None], np.nan_to_num(turns), 0.0).sum((0, 1))
        value = z.sum() - (score * self.gold).sum() - (follow * self.gold_follow).sum()
        return float(value + self.penalty * (v @ v) / 2), np.concatenate([grad.ravel(), (turns - self.gold_follow).ravel()]) + self.penalty * v


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with halved steps."""
    value, grad = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, used = grad.copy(), []
        for d, g in reversed(past):
            r = (d @ q) / (d @ g)
            used.append(r)
            q -= r * g
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.abs(grad).sum()))
        for (d, g), r in zip(past, reversed(used)):
            q += d * (r - (g @ q) / (d @ g))
        step, slope = 1.0, float(grad @ q)
        while True:
            new, new_grad = f(x - step * q)
            if new <= value - 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        d, g = -step * q, new_grad - grad
        if d @ g > 1e-10:
            past = [*past, (d, g)][-memory:]
        done = value - new < 1e-4 * max(1.0, abs(new))
        x, value, grad = x - step * q, new, new_grad
        if done:
            break
    return x


def _generated(seed: int = 11, n: int = 300) -> Iterator[tuple[str, list[Span]]]:
    """Sentences with known spans, and with numbers, dates, versions and digests of files that are none."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    low, hexa, up = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    word = lambda: pick(low, r.randrange(2, 9))

    def iban() -> str:
        country, body = pick(up[:26], 2), pick(r.choice([up, up[26:]]), r.randrange(12, 31))
        check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97
        s = f"{country}{check if r.random() < 0.7 else r.randrange(2, 99):02}{body}"
        return s if r.random() < 0.3 else " ".join(s[k : k + 4] for k in range(0, len(s), 4))

    makers: list[Callable[[], tuple[str, str, str]]] = [
        lambda: ("", "secret", "AKIA" + pick(up, 16)),
        lambda: ("", "secret", f"{r.choice(['password', 'token', 'secret', 'api_key'])}={pick(hexa, r.randrange(8, 30))}"),
        lambda: ("", "secret", f'{r.choice(["token", "password", "api_key"])} = "{pick(hexa, r.randrange(16, 41))}'),
        lambda: ("", "secret", f"sk_{pick(up + low, 24)}"),
        lambda: (r.choice(["token", "key", "secret"]) + " ", "secret", pick(hexa, 40)),
        lambda: (r.choice(["call ", "phone: ", "tel ", ""]), "phone", f"({r.randrange(200, 999)}) {r.randrange(200, 999)}-{r.randrange(1000, 9999)}"),
        lambda: (r.choice(["call ", "tel ", ""]), "phone", f"{r.randrange(200, 999)}-{r.randrange(200, 999)}-{r.randrange(1000, 9999)}"),
        lambda: (r.choice(["call ", ""]), "phone", f"00{r.randrange(1, 99)} {r.randrange(100, 999)} {r.randrange(1000000, 9999999)}"),
        lambda: (r.choice(["mail ", ""]), "email", f"{word()} [at] {word()} [dot] com"),
        lambda: (r.choice(["ssn ", "SSN: ", ""]), "id", f"{r.randrange(100, 999)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}"),
    ]
    none: list[Callable[[], str]] = [
        lambda: str(r.randrange(10**9)), lambda: f"{r.randrange(1900, 2100)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}", lambda: f"v{r.randrange(9)}.{r.randrange(20)}.{r.randrange(50)}",
        lambda: f"{r.randrange(100)}.{r.randrange(100)}%", lambda: f"sha256 {pick(hexa, 64)}", lambda: f"commit {pick(hexa, 40)}", lambda: "password policy", lambda: f"x={r.randrange(99)}", lambda: f"{word()} at {word()} dot.",
    ]
    more: list[Callable[[], tuple[str, str, str]]] = [
        lambda: (r.choice(["mail ", ""]), "email", f"{word()} at {word()} dot {r.choice(['com', 'org', 'net'])}"),
        lambda: (r.choice(["mail ", ""]), "email", f"{word()} {r.choice(['(at)', '[at]', 'at'])} {word()}.{r.choice(['com', 'org', 'net'])}"),
        lambda: ("", "secret", f"{r.choice(['password', 'token', 'secret'])}: {pick(low, r.randrange(8, 30))}"),
        lambda: ("", "secret", f"{r.choice(['sk', 'ghp'])}_{pick(low, r.randrange(16, 30))}"),
        lambda: (r.choice(["iban ", "IBAN: ", ""]), "id", iban()),
    ]
    ends: list[Callable[[], str]] = [
        lambda: f"{word()} at {word()}.{r.choice(' ' + chr(10))}{word().title()}",
        lambda: f"{word()} at {word()}. {word().title()}. {word().title()}",
        lambda: f"{word()}. At {word()}.{r.choice(' ' + chr(10))}{word().title()}",
    ]
    for k in range(n + n // 2):
        if k == n:
            makers, none = more, ends
        text, spans = "", []
        for _ in range(r.randrange(1, 4)):
            text += " ".join(word() for _ in range(r.randrange(1, 6))) + " "
            if r.random() < 0.5:
                cue, kind, span = r.choice(makers)()
                text += cue
                spans.append((kind, len(text), len(text) + len(span)))
                text += span + ('"' if span.count('"') == 1 else "")
            else:
                text += r.choice(none)()
            text += r.choice([" ", ". ", ", "])
        yield text, spans


@lru_cache(maxsize=1)
def trained(penalty: float = 0.02, steps: int = 40) -> Field:
    """The field of the generated sentences."""
    f = Likelihood(list(_generated()), penalty)
    n = len(f.names) * len(FIELD)
    v = minimise(f, np.zeros(n + _LABELS_OF**2), steps)
    return Field(f.names, v[:n].reshape(-1, len(FIELD)), v[n:].reshape(_LABELS_OF, _LABELS_OF))


def regions(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of tokens near a trigger, as far as a span with it and the word before can reach, in pieces of at most REGION tokens."""
    run: list[tuple[int, int]] = []
    behind = 0
    recent: list[tuple[int, int]] = []
    starts = (m.start() for m in _TRIGGER.finditer(text))
    start = next(starts, None)
    for m in _TOKEN.finditer(text):
        if start is not None and start < m.end():
            while start is not None and start < m.end():
                start = next(starts, None)
            if not run:
                run = recent
            behind = MAX_TOKENS
        if behind or run:
            if behind:
                run.append(m.span())
                behind -= 1
            else:
                yield run
                run = []
        if start is None and not behind:
            break
        if len(run) >= REGION:
            yield run
            run = run[-MAX_TOKENS:]
        recent = [*recent[1 - MAX_TOKENS :], m.span()]
    if run:
        yield run


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text; ordered by start, then kind."""
    if not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    more: set[Span] = set()
    for tokens in regions(text):
        for _, _, (kind, a, b) in decode(text, tokens, field):
            if kind == "email" and (m := _LABELS.match(text, b)):
                b = m.end()
            more.add((kind, a, b))
    added: list[Span] = []
    end, k = 0, 0
    cover = sorted((a, b) for _, a, b in base)
    for kind, a, b in sorted(more, key=lambda s: (s[1], -s[2])):
        while k < len(cover) and cover[k][1] <= a:
            k += 1
        if a >= end and not any(x < b and a < y for x, y in cover[k : k + 4]):
            added.append((kind, a, b))
            end = b
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) for every row: the base spans and all spans as joined strings."""
    common.prepare(docs.sparkSession)
    field = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, full = [], []
            for t in pc.fill_null(batch.column(1), ""):
                a, b = all_spans(t.as_py(), field)
                base.append(_joined(a))
                full.append(_joined(b))
            yield pa.record_batch([batch.column(0), pa.array(base, pa.string()), pa.array(full, pa.string())], ["doc_id", "base", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "doc_id long, base string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """text with each span (overlapping ones as one) replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data in text replaced; n_chars, if there is such a column, counts the new text."""
    common.prepare(docs.sparkSession)
    field = trained()
    schema = docs.schema
    at = schema.fieldNames().index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [None if (t := x.as_py()) is None else redacted(t, s) if (s := all_spans(t, field)[1]) else t for x in batch.column(at)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            names = schema.fieldNames()
            if "n_chars" in names and text_col == "text":
                k = names.index("n_chars")
                columns[k] = pa.array([old if t is None else len(t) for t, old in zip(new, columns[k].to_pylist())], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.read(spark, sf_dir, "documents"))
    counts = [F.regexp_count("base", F.lit(f"{k}:")).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")
