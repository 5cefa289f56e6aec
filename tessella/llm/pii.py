"""Personal data: four fixed patterns, and a semi-Markov conditional random field for what they can't describe.

The field scores whole segments: a segment's features are its shape, digit groups, check digits (Luhn, mod 97),
spelled-out separators and the words before it; a label's transition counts too. Candidate segments (`lengths`) hold at
most MAX_TOKENS tokens, between MIN_DIGITS and MAX_DIGITS digits, or an @ or a spelled-out "dot", and neither begin nor
end inside a word or number. Tokens that no candidate covers are outside any entity. A Viterbi pass over (end, label)
chooses boundaries and types together; it reads a text's tokens once, from left to right, and gives out entities as
soon as all surviving paths agree on them, so a long dense text is decoded as a whole in little memory.

Weights are learned by gradient ascent on the conditional likelihood of labelled sentences, made by `labelled` from a
seed; other labelled sentences can be given.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_batches, spans_text

#: The base patterns, in the order in which kinds are listed.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")

#: Labels of the field; the first is outside. Those after the base kinds are what the method adds.
LABELS = ("O", *KINDS, "email_spelled", "phone_local", "national_id", "account")
ADDED = LABELS[5:]
MAX_TOKENS, MIN_DIGITS, MAX_DIGITS = 14, 7, 24
#: Tokens before a segment that its features look at.
BEFORE = 4
TOKEN = re.compile(r"[A-Za-zÀ-ɏ]+|[0-9]+|[^\sA-Za-z0-9À-ɏ]|\n")
TRIGGER = re.compile(r"[0-9]+|@|(?<![A-Za-z])(?:dot|DOT)(?![A-Za-z])")
SENTENCES, EPOCHS, RATE, L2 = 220, 6, 0.4, 1e-3
#: What an added span needs of log-odds over leaving it outside.
MARGIN = 1.0
#: Tokens after which the decoder looks for entities that all surviving paths share, and remembered scores of segments.
SETTLE, REMEMBERED = 1024, 100_000
Token = tuple[str, int, int]
Span = tuple[str, int, int]
ZEROS = str.maketrans("123456789", "000000000")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(s: str) -> bool:
    """International account numbers: the first four characters moved behind, letters as numbers, rest 1."""
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """Matches of the base patterns, by kind as listed, then by start."""
    out = []
    at, free = t.find("@"), 0
    while at >= 0:
        s = at
        while s > free and t[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(t, at) if s < at else None
        if m:
            out.append(("email", s, m.end()))
            free = m.end()
        at = t.find("@", m.end() if m else at + 1)
    out += [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(x[-4:]) <= 255 and not x[:-3].strip("0") for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = digits_of(m[0]) if m.end() - m.start() < 64 else ""
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in t:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


CUES = {"tel": "phone", "telefon": "phone", "phone": "phone", "call": "phone", "fax": "phone", "mobile": "phone", "cell": "phone", "ssn": "id", "social": "id", "security": "id", "insurance": "id", "id": "id", "iban": "account", "account": "account", "konto": "account", "compte": "account", "cuenta": "account", "email": "mail", "mail": "mail", "contact": "mail", "write": "mail"}


ACCOUNT = re.compile("[A-Z]{2}[0-9]{2}[A-Z0-9]+")
QUAD = re.compile(r"[0-9]+(\.[0-9]+){3}")
MAIL = re.compile(r"[a-z0-9._%+-]+@[a-z0-9-]+(\.[a-z0-9-]+)+")
SPELLED = re.compile(r"[a-z0-9_]+( dot [a-z0-9_]+| ?[\[(]dot[\])] ?[a-z0-9_]+)*( at | ?[\[(]at[\])] ?)[a-z0-9]+(( dot | ?[\[(]dot[\])] ?)[a-z0-9]+)+")
LOCAL_FORM = re.compile(r"(\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}")
ID_FORM = re.compile("[0-9]{3}-[0-9]{2}-[0-9]{4}")
NUMBERS, LETTERS = re.compile("[0-9]+"), re.compile("[^\\W\\d_]+")
#: What a segment must not hold for its features to depend on no more than its form.
WORDY = re.compile("[A-Za-z@]|[^\x00-\x7f]")


def shape_of(text: str) -> str:
    shape = NUMBERS.sub(lambda m: f"{min(len(m[0]), 20)}d", LETTERS.sub("a", text))
    return f"shape={shape}" if len(shape) < 24 else "shape=long"


def cues_before(tokens: list[Token], a: int) -> list[str]:
    return sorted({CUES.get(w.lower()) for w, _, _ in tokens[max(0, a - BEFORE) : a]} - {None})


def glue(tokens: list[Token], a: int, b: int) -> str:
    """Which ends of tokens[a:b] touch a neighbour that is no usual punctuation."""
    left = tokens[a - 1] if a else ("", -9, -9)
    right = tokens[b] if b < len(tokens) else ("", 10**9, 0)
    return ("l" if left[2] == tokens[a][1] and left[0] not in "(:=\"'<,;[\n" else "") + ("r" if right[1] == tokens[b - 1][2] and right[0] not in ".,;:)>\"'!?]\n" else "")


def features(tokens: list[Token], a: int, b: int) -> list[str]:
    """Features of tokens[a:b] as one segment."""
    words = [w for w, _, _ in tokens[a:b]]
    text, pos = "", tokens[a][1]
    for w, s, e in tokens[a:b]:
        text += " " * (s > pos) + w
        pos = e
    low = text.lower()
    digits = digits_of(text)
    shape = shape_of(text)
    glued = glue(tokens, a, b)
    cues = cues_before(tokens, a)
    out = ["bias", shape, f"digits={min(len(digits), 24)}", f"glued={glued}", f"tokens={b - a}", f"first={'9' if words[0][0].isdigit() else 'a' if words[0][0].isalpha() else words[0]}", f"last={'9' if words[-1][-1].isdigit() else 'a' if words[-1][-1].isalpha() else words[-1]}"]
    out += [f"cue={c}" for c in cues] or ["cue=none"]
    if 13 <= len(digits) <= 19 and len(digits) == len(re.sub("[ -]", "", text)):
        out.append(f"luhn={luhn(digits)}")
    flat = text.replace(" ", "")
    if 15 <= len(flat) <= 34 and ACCOUNT.fullmatch(flat):
        out.append(f"mod97={mod97(flat)}")
    if QUAD.fullmatch(text):
        out.append(f"quad={all(int(x[-4:]) <= 255 for x in text.split('.'))}")
    spelled = " dot " in f" {low} " or "[dot]" in low or "(dot)" in low
    out.append(f"spelled={spelled}{' at ' in f' {low} ' or '[at]' in low or '(at)' in low}{'@' in low}")
    if "@" in low and MAIL.fullmatch(low):
        out.append("mailform")
    if spelled and SPELLED.fullmatch(low):
        out.append("spelledform")
    if LOCAL_FORM.fullmatch(text):
        out.append("localform")
    if ID_FORM.fullmatch(text):
        out.append("idform")
    return out


def labelled(seed: int = 11, size: int = SENTENCES) -> list[list[tuple[str, str]]]:
    """A bounded labelled sample: sentences as lists of (text, label)."""
    r = random.Random(seed)
    n = lambda k: "".join(r.choices("0123456789", k=k))
    names = ["anna", "john", "maria", "luis", "petra", "info", "sales", "j_doe", "team9", "und"]
    hosts = ["example", "mail7", "post", "corp", "uni3"]
    tops = ["com", "org", "net", "de", "fr", "es"]
    filler = "the of and reth on that erion thha der und ver lich que les eau mente los cion as by at in version page room year chapter to".split()

    def card() -> str:
        d = n(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return r.choice((d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4))))

    def account() -> str:
        body = n(18)
        head = f"DE{98 - int(body + str(int('D', 36)) + str(int('E', 36)) + '00') % 97:02d}"
        s = head + body
        return r.choice((s, " ".join(s[i : i + 4] for i in range(0, len(s), 4))))

    def spelled() -> str:
        at, dot = r.choice(((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) ")))
        return r.choice(names) + (dot + r.choice(names)) * r.randint(0, 1) + at + r.choice(hosts) + dot + r.choice(tops)

    make = {
        "email": lambda: f"{r.choice(names)}.{n(2)}@{r.choice(hosts)}.{r.choice(tops)}",
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: f"+{r.randint(1, 99)} ({n(3)}) {n(3)}-{n(4)}",
        "email_spelled": spelled,
        "phone_local": lambda: r.choice((f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"{n(3)} {n(3)} {n(4)}", f"{n(3)}.{n(3)}.{n(4)}")),
        "national_id": lambda: f"{n(3)}-{n(2)}-{n(4)}",
        "account": account,
    }
    cue = {"phone_local": ["call", "tel:", "phone", "Fax"], "national_id": ["SSN", "social security no", "id:"], "account": ["IBAN", "account", "Konto:"], "email_spelled": ["write to", "mail", "contact"]}
    plain = [lambda: n(r.randint(1, 12)), lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}", lambda: f"{r.randint(1900, 2030)}-{n(2)}-{n(2)}", lambda: f"{n(2)}/{n(2)}/{n(4)}", lambda: f"{n(2)}:{n(2)}", lambda: f"{n(3)},{n(3)}", lambda: f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}", lambda: f"{n(5)}-{n(4)}", lambda: f"{n(3)}-{n(3)}-{n(3)}", lambda: r.choice(["the dot on", "a dot in", "dot"]), lambda: "ab" + n(4), lambda: ".".join(n(3) for _ in range(5)), lambda: n(16), lambda: f"{n(8)}-{n(4)}-{n(4)}-{n(4)}-{n(12)}", lambda: " ".join(n(2) for _ in range(r.randint(2, 6)))]
    out = []
    for k in range(size):
        s = [(" ".join(r.choices(filler, k=r.randint(1, 4))), "O")]
        for _ in range(r.randint(1, 2)):
            label = LABELS[1 + k % (len(LABELS) - 1)] if r.random() < 0.6 else "O"
            if label != "O" and label in cue and r.random() < 0.5:
                s.append((r.choice(cue[label]), "O"))
            s.append((make[label]() if label != "O" else r.choice(plain)(), label))
            s.append((r.choice(("", ",", ".")) + " " + " ".join(r.choices(filler, k=r.randint(1, 3))), "O"))
        out.append(s)
    return out


def tokens_of(text: str, offset: int = 0) -> list[tuple[str, int, int]]:
    return [(m[0], m.start() + offset, m.end() + offset) for m in TOKEN.finditer(text)]


def is_number(w: str) -> bool:
    return "0" <= w[0] <= "9"


def lengths(tokens: list[Token], shut: list[bool], i: int) -> list[int]:
    """Lengths of the candidates whose last token is tokens[i]; tokens[i + 1], if there is one, must be known.

    A candidate crosses no shut token (a line end or a base span) and no gap of over one character, begins with a letter,
    digit, plus or bracket, ends with a letter or digit, and is cut out of no longer run of letters and digits.
    """
    w, _, end = tokens[i]
    if shut[i] or not w[-1].isalnum():
        return []
    if i + 1 < len(tokens) and tokens[i + 1][1] == end and tokens[i + 1][0][0].isalnum():
        return []
    out, digits, fired, start = [], 0, False, end
    for a in range(i, max(-1, i - MAX_TOKENS), -1):
        w, s, e = tokens[a]
        if shut[a] or start - e > 1:
            break
        start = s
        if is_number(w):
            digits += e - s
            if digits > MAX_DIGITS:
                break
        elif w == "@" or w == "dot" or w == "DOT":
            fired = True
        if (digits >= MIN_DIGITS or fired) and (w[0].isalnum() and not (a and tokens[a - 1][2] == s and tokens[a - 1][0][-1].isalnum()) or w in "+(["):
            out.append(i - a + 1)
    return out


def shut_tokens(tokens: Iterable[Token], blocked: list[tuple[int, int]]) -> Iterator[tuple[Token, bool]]:
    """Tokens, and whether each is a line end or overlaps one of the disjoint, sorted `blocked` spans."""
    k = 0
    for t in tokens:
        while k < len(blocked) and blocked[k][1] <= t[1]:
            k += 1
        yield t, t[0] == "\n" or k < len(blocked) and blocked[k][0] < t[2]


def candidates(tokens: list[Token]) -> list[tuple[int, int]]:
    """All candidates of a short text, by their end."""
    shut = [w == "\n" for w, _, _ in tokens]
    return [(i + 1 - n, i + 1) for i in range(len(tokens)) for n in lengths(tokens, shut, i)]


def disjoint(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def reach(text: str, at: int, ahead: bool) -> int:
    """A token's edge with MAX_TOKENS + BEFORE + 1 tokens or more between it and `at`, or the text's edge."""
    need, step = MAX_TOKENS + BEFORE + 1, 128
    while True:
        lo, hi = (at, min(len(text), at + step)) if ahead else (max(0, at - step), at)
        edges = [m.end() if ahead else m.start() for m in TOKEN.finditer(text, lo, hi)]
        if ahead and hi == len(text) or not ahead and lo == 0:
            return hi if ahead else lo
        if len(edges) > need:  # the outermost token of the slice may be cut
            return edges[need - 1] if ahead else edges[-need]
        step *= 4


def windows(text: str, blocked: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Parts of a text that hold all its candidates, far enough apart to be decoded by themselves. Triggers belong
    together if a candidate could hold both: no line end and fewer than MAX_TOKENS words between them."""
    k, group, last = 0, None, None
    for m in chain(TRIGGER.finditer(text), (None,)):
        if m:
            s, e = m.span()
            while k < len(blocked) and blocked[k][1] <= s:
                k += 1
            if k < len(blocked) and blocked[k][0] <= s:
                continue
            number = is_number(m[0])
            if group:
                between = text[group[1] : s]
                if "\n" not in between and len(between.split(None, MAX_TOKENS)) < MAX_TOKENS:
                    group = (group[0], e, group[2] + (e - s) * number, group[3] or not number)
                    continue
        if group and (group[2] >= MIN_DIGITS or group[3]):
            lo, hi = reach(text, group[0], False), reach(text, group[1], True)
            if last and lo <= last[1]:
                last = (last[0], max(hi, last[1]))
            else:
                if last:
                    yield last
                last = (lo, hi)
        if m:
            group = (s, e, (e - s) * number, not number)
    if last:
        yield last


class SemiMarkov:
    """Whole-segment features and label transitions, learned by stochastic gradient ascent with running scales."""

    def __init__(self, sentences: list[list[tuple[str, str]]], epochs: int = EPOCHS):
        self.index: dict[str, int] = {}
        data = [self.prepare(s) for s in sentences]
        y = len(LABELS)
        self.known: dict[tuple, np.ndarray] = {}
        self.forms: dict[str, tuple] = {}
        self.w = np.zeros((len(self.index) + 1, y))
        self.t = np.zeros((y, y))
        gw, gt = np.full_like(self.w, 1e-2), np.full_like(self.t, 1e-2)
        order = list(range(len(data)))
        shuffle = random.Random(3).shuffle
        for _ in range(epochs):
            shuffle(order)
            for k in order:
                dw, dt, rows = self.gradient(*data[k])
                dw -= L2 * self.w[rows]
                gw[rows] += dw**2
                gt += dt**2
                self.w[rows] += RATE * dw / np.sqrt(gw[rows])
                self.t += RATE * dt / np.sqrt(gt)

    def prepare(self, sentence: list[tuple[str, str]]):
        text, gold = "", {}
        for part, label in sentence:
            text += " " * bool(text and not part.startswith((",", ".", " "))) + ""
            if label != "O":
                gold[(len(text), len(text) + len(part))] = label
            text += part
        tokens = tokens_of(text)
        segs = [(i, i + 1, None) for i in range(len(tokens))] + [(a, b, features(tokens, a, b)) for a, b in candidates(tokens)]
        truth, covered = {}, set()
        for i, (a, b, f) in enumerate(segs):
            label = f and gold.get((tokens[a][1], tokens[b - 1][2]))
            if label:
                truth[a] = (i, b, LABELS.index(label))
                covered |= set(range(a, b))
        path, at = [], 0
        while at < len(tokens):
            i, b, label = truth.get(at, (at, at + 1, 0))
            path.append((i, label))
            at = b
        ids = [[self.index.setdefault(x, len(self.index) + 1) for x in f or ()] for _, _, f in segs]
        width = max(map(len, ids), default=1) or 1
        feats = np.zeros((len(segs), width), int)
        for i, x in enumerate(ids):
            feats[i, : len(x)] = x
        return len(tokens), segs, feats, path

    def scores(self, segs, feats) -> np.ndarray:
        """Score of each segment under each label; single tokens are outside, candidates are entities."""
        s = self.w[feats].sum(1)
        plain = np.array([f is None for _, _, f in segs], bool)
        s[plain, 1:] = -np.inf
        s[plain, 0] = 0
        s[~plain, 0] = -np.inf
        return s

    def gradient(self, n, segs, feats, path):
        y = len(LABELS)
        self.w[0] = 0
        s = self.scores(segs, feats)
        ending, starting = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for i, (a, b, _) in enumerate(segs):
            ending[b].append(i)
            starting[a].append(i)
        start = np.full(y, -np.inf)
        start[0] = 0
        alpha, into = [start], [lse(start[:, None] + self.t, 0)]
        for b in range(1, n + 1):
            m = lse(np.array([into[segs[i][0]] + s[i] for i in ending[b]]), 0)
            alpha.append(m)
            into.append(lse(m[:, None] + self.t, 0))
        z = lse(alpha[n], 0)
        beta, out = [None] * (n + 1), [None] * (n + 1)
        beta[n] = np.zeros(y)
        for a in range(n - 1, -1, -1):
            out[a] = lse(np.array([s[i] + beta[segs[i][1]] for i in starting[a]]), 0)
            beta[a] = lse(self.t + out[a][None, :], 1)
        p = np.exp(np.array([into[a] + s[i] + beta[b] - z for i, (a, b, _) in enumerate(segs)]))
        dt = np.zeros((y, y))
        for a in range(n):
            dt -= np.exp(np.nan_to_num(alpha[a][:, None] + self.t + out[a][None, :] - z, nan=-np.inf))
        before = 0
        p = -p
        for i, label in path:
            p[i, label] += 1
            dt[before, label] += 1
            before = label
        rows, inverse = np.unique(feats, return_inverse=True)
        dw = np.zeros((len(rows), y))
        np.add.at(dw, inverse.reshape(feats.shape), p[:, None, :])
        dw[rows == 0] = 0
        return dw, dt, rows

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "forms": {}}

    def form(self, form: str) -> tuple:
        """All that features tell of a segment without letters whose digits are written 0, but for its check digits."""
        n = form.count("0")
        known = (self.index.get(shape_of(form), 0), n, len(TOKEN.findall(form)), form[0], form[-1], bool(LOCAL_FORM.fullmatch(form)), bool(ID_FORM.fullmatch(form)))
        cards = 13 <= n <= 19 and n + form.count(" ") + form.count("-") == len(form)
        return known, cards, bool(QUAD.fullmatch(form))

    def segment(self, tokens: list[Token], a: int, b: int, text: str, cues: list[str]) -> np.ndarray:
        """Scores of tokens[a:b], of this text, under each label."""
        key = check = None
        if not WORDY.search(text):
            form = text.translate(ZEROS)
            found = self.forms.get(form)
            if found is None:
                if len(self.forms) >= REMEMBERED:
                    self.forms.clear()
                found = self.forms[form] = self.form(form)
            if found[1]:
                check = luhn(digits_of(text))
            elif found[2]:
                check = all(int(x[-4:]) <= 255 for x in text.split("."))
            key = (found[0], check, glue(tokens, a, b), *cues)
            s = self.known.get(key)
            if s is not None:
                return s
        get = self.index.get
        s = self.w[[get(f, 0) for f in features(tokens, a, b)]].sum(0)
        s[0] = -np.inf
        if key:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[key] = s
        return s

    def entities(self, tokens: Iterable[Token], blocked: list[tuple[int, int]]) -> Iterator[tuple[str, int, int, float]]:
        """The best segmentation's entities (label, start, end, log-odds over outside) in order of their place.

        Positions are the edges between tokens. A position's entry in `back` has, for each label of an entity that ends
        there, its length, the label before it, its score and its start. Entries are given up as soon as all paths that
        can still win run through one of their states.
        """
        y, t, rows = len(LABELS), self.t, np.arange(len(LABELS))
        edge = t[0] + t[:, 0]
        start = np.full(y, -np.inf)
        start[0] = 0
        m = start[:, None] + t
        none = [0] * y
        into, came, back = [m.max(0)], [none], [None]
        seen: list[Token] = []
        shut: list[bool] = []
        pos, first, root = 0, 0, 0  # position reached, position of the lists' first entries, label at it
        fired, cued, due, state = -MAX_TOKENS, -MAX_TOKENS - BEFORE, SETTLE, start

        def before(p: int, label: int) -> tuple[int, int]:
            x = back[p - first]
            return (p - x[0][label], x[1][label]) if label else (p - 1, came[p - 1 - first][0])

        def found(p: int, label: int) -> list[tuple[str, int, int, float]]:
            out = []
            while p > first:
                if label:
                    x = back[p - first]
                    out.append((LABELS[label], x[3][label], x[4], float(x[2][label] + edge[label] - (x[0][label] + 1) * t[0, 0])))
                p, label = before(p, label)
            return out[::-1]

        feed = shut_tokens(tokens, blocked)
        nxt = next(feed, None)
        while nxt:
            token, closed = nxt
            nxt = next(feed, None)
            seen.append(token)
            shut.append(closed)
            if nxt:  # the neighbour on the right
                seen.append(nxt[0])
                shut.append(nxt[1])
            i = len(seen) - 1 - bool(nxt)
            pos += 1
            if is_number(token[0]) or token[0] in ("@", "dot", "DOT"):
                fired = pos
            elif token[0].lower() in CUES:
                cued = pos
            sizes = lengths(seen, shut, i) if pos - fired < MAX_TOKENS else ()
            if sizes:
                text, scores, k = "", [], 0
                for n in range(1, sizes[-1] + 1):
                    w, _, e = seen[i + 1 - n]
                    text = w + " " * (n > 1 and seen[i + 2 - n][1] > e) + text
                    if n == sizes[k]:
                        scores.append(self.segment(seen, i + 1 - n, i + 1, text, cues_before(seen, i + 1 - n) if pos - cued < MAX_TOKENS + BEFORE else []))
                        k += 1
                s = np.array(scores)
                x = np.array([into[pos - n - first] for n in sizes]) + s
                at = x.argmax(0)
                state = x[at, rows]
                state[0] = into[-1][0]
                size = [sizes[j] for j in at.tolist()]
                back.append((size, [came[pos - n - first][j] for j, n in enumerate(size)], s[at, rows], [seen[i + 1 - n][1] for n in size], token[2]))
                m = state[:, None] + t
                into.append(m.max(0))
                came.append(m.argmax(0).tolist())
            else:
                state = start + into[-1][0]
                into.append(into[-1][0] + t[0])
                came.append(none)
                back.append(None)
            if nxt:
                seen.pop()
                shut.pop()
            if len(seen) > 4 * (MAX_TOKENS + BEFORE):
                del seen[: -(MAX_TOKENS + BEFORE + 1)], shut[: -(MAX_TOKENS + BEFORE + 1)]
            if pos - first >= due:
                alive = {(p, label) for p in range(max(first, pos - MAX_TOKENS), pos + 1) for label in (range(y) if back[p - first] else (0,))}
                while len(alive) > 1 and (last := max(alive))[0] > first:
                    alive.remove(last)
                    alive.add(before(*last))
                if len(alive) == 1 and next(iter(alive))[0] > first:
                    p, root = alive.pop()
                    yield from found(p, root)
                    del into[: p - first], came[: p - first], back[: p - first]
                    first = p
                    due = SETTLE
                else:
                    due *= 2
        yield from found(pos, int(state.argmax()) if pos > first else root)

    def best(self, tokens: Iterable[Token], blocked: list[tuple[int, int]]) -> list[Span]:
        """The best segmentation's entities whose odds reach MARGIN."""
        return [(k, s, e) for k, s, e, odds in self.entities(tokens, blocked) if odds >= MARGIN]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Entities of the added kinds that overlap no base span, by start."""
        blocked = disjoint((s, e) for _, s, e in base)
        out: list[Span] = []
        for lo, hi in windows(text, blocked):
            tokens = ((m[0], m.start(), m.end()) for m in TOKEN.finditer(text, lo, hi))
            inside = blocked[bisect_left(blocked, lo, key=lambda x: x[1]) : bisect_left(blocked, hi, key=lambda x: x[0])]
            out += [x for x in self.best(tokens, inside) if x[0] in ADDED]
        return out


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = np.max(x, axis, keepdims=True)
    m = np.where(np.isfinite(m), m, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


@lru_cache(maxsize=1)
def field() -> SemiMarkov:
    return SemiMarkov(labelled())


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
SPAN_SQL = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan(model: SemiMarkov, text: str | None) -> list[tuple[str, int, int]]:
    """Base spans by kind and start, then the field's spans by kind and start."""
    if not text:
        return []
    base = base_spans(text)
    if not TRIGGER.search(text):
        return base
    return base + sorted(model.added(text, base), key=lambda x: (ADDED.index(x[0]), x[1]))


def find_pii(df: DataFrame, text_col: str = "text", out: str = "pii", model: SemiMarkov | None = None) -> DataFrame:
    """`df` with an array `out` of spans (kind, start, end) in code points, end exclusive: the base kinds' as listed,
    then the field's. A null or empty text has none. Other columns pass through; one called `out` is replaced.
    """
    df = df.drop(out)
    at = df.columns.index(text_col)
    model = model or field()  # learned once, in the driver; its weights are a few thousand numbers

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = [[{"kind": k, "start": i, "end": j} for k, i, j in scan(model, t)] for t in b.column(at).to_pylist()]
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.list_(SPAN))], names=[*b.schema.names, out])

        return batch

    return map_batches(df, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` {SPAN_SQL}")


def redact(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", model: SemiMarkov | None = None) -> DataFrame:
    """`df` with every span in `text_col` replaced by its kind in angle brackets; where spans overlap, the longest
    stands (the earlier of equals). Null texts stay null. `chars_col`, if `df` has it, is brought up to date in changed
    rows; other columns pass through.
    """
    at = df.columns.index(text_col)
    size_at = df.columns.index(chars_col) if chars_col in df.columns else -1
    model = model or field()

    def clean(t: str | None) -> str | None:
        spans = scan(model, t)
        if not spans:
            return t
        kept: list[tuple[int, int, str]] = []  # disjoint, by start
        for k, s, e in sorted(spans, key=lambda x: (x[1] - x[2], x[1])):
            i = bisect_left(kept, (s, e))
            if not (i < len(kept) and kept[i][0] < e or i and s < kept[i - 1][1]):
                kept.insert(i, (s, e, k))
        parts, pos = [], 0
        for s, e, k in kept:
            parts += [t[pos:s], f"<{k}>"]
            pos = e
        return "".join(parts) + t[pos:]

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            cols = list(b.columns)
            old = b.column(at).to_pylist()
            new = [clean(t) for t in old]
            cols[at] = pa.array(new, pa.string())
            if size_at >= 0:
                sizes = cols[size_at].to_pylist()
                cols[size_at] = pa.array([n if x is y else len(y) for n, x, y in zip(sizes, old, new, strict=True)], cols[size_at].type)
            return pa.RecordBatch.from_arrays(cols, names=b.schema.names)

        return batch

    return map_batches(df, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))


def pii_digest(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one for each row of `df`, repeated rows included.

    A null or empty text has no spans: counts of 0, the hash of no bytes, an empty string. Null ids pass through; an empty
    table gives an empty result; columns other than `id_col` and text are not read.
    """
    found = find_pii(df.select(id_col, "text")).select(id_col, "pii")
    base = F.filter("pii", lambda s: s["kind"].isin(*KINDS))
    of = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(id_col, *map(of, KINDS), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("pii")).alias("spans"))
