"""Secret scans: three fixed patterns, and probabilistic automata learned from labelled credentials.

Each credential format has a sample of labelled strings (made by `labelled` from a seed; another labelled sample can
be given). Its prefix tree is folded by merging states whose outgoing frequencies agree within a Hoeffding bound
(the ALERGIA scheme), which leaves a small probabilistic automaton. One more automaton is learned from strings that
are no credentials. Every candidate of a text, an assigned value or a run of at least MIN_RUN key characters with letters
and digits, is scored by the best format's log-likelihood and by its margin over the background.
"""

from __future__ import annotations

import math
import random
import re
import string
from bisect import bisect_left, bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_batches, spans_text

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
WORDS = ("password", "passwd", "secret", "token", "api")

MIN_RUN = 16
RUN = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}")
#: Labelled strings of a format, the merging test's confidence, and the scores that a secret needs (nats).
SAMPLE, ALPHA, MARGIN, PER_SYMBOL = 250, 0.05, 12.0, -2.6
UNSEEN = math.log(1e-5)
END = ""

ALNUM = string.ascii_letters + string.digits
B64 = ALNUM + "+/"
URL64 = ALNUM + "-_"


def labelled(seed: int = 7, size: int = SAMPLE) -> dict[str, list[str]]:
    """A bounded labelled sample: credentials by format, and under `background` strings that are none."""
    r = random.Random(seed)
    some = lambda chars, n: "".join(r.choices(chars, k=n))
    low = string.ascii_lowercase
    syllables = ["the", "er", "tion", "ing", "and", "ung", "heit", "eau", "que", "mente", "ado", "ble", "est", "ou", "ar", "in"]
    word = lambda n: "".join(r.choices(syllables, k=n))
    return {
        "access_key": ["AKIA" + some(string.ascii_uppercase + string.digits, 16) for _ in range(size)],
        "forge_token": [r.choice(("ghp_", "gho_", "ghs_")) + some(ALNUM, 36) for _ in range(size)],
        "chat_token": [r.choice(("xoxb-", "xoxp-")) + some(string.digits, 11) + "-" + some(string.digits, 12) + "-" + some(ALNUM, 24) for _ in range(size)],
        "payment_key": [r.choice(("sk_live_", "sk_test_")) + some(ALNUM, 24) for _ in range(size)],
        "map_key": ["AIza" + some(URL64, 35) for _ in range(size)],
        "web_token": ["eyJ" + some(URL64, 33) + "." + "eyJ" + some(URL64, r.randint(40, 80)) + "." + some(URL64, 43) for _ in range(size)],
        "random_key": [some(B64, 40) for _ in range(size)],
        "hex_key": [some("0123456789abcdef", r.choice((32, 40, 64))) for _ in range(size)],
        "background": [word(r.randint(4, 8)) for _ in range(size)]
        + [word(r.randint(2, 4)).capitalize() + r.choice("-_./") + word(r.randint(2, 4)) + r.choice(("", str(r.randint(0, 999)))) for _ in range(size)]
        + [some(string.digits, r.randint(10, 19)) for _ in range(size)]
        + [f"{r.randint(1, 255)}.{r.randint(1, 255)}.{r.randint(1, 255)}.{r.randint(1, 255)}" for _ in range(size // 4)]
        + [f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}T{r.randint(0, 23):02d}" for _ in range(size // 4)]
        + ["/".join(word(r.randint(1, 3)) for _ in range(r.randint(2, 5))) + r.choice(("", ".html", ".py", "/" + str(r.randint(1, 9999)))) for _ in range(size)]
        + [word(1) + "." + word(2) + str(r.randint(1, 99)) + "." + r.choice(("com", "org", "net")) for _ in range(size)]
        + ["-".join(some(low, r.randint(3, 8)) for _ in range(r.randint(2, 5))) + "-" + some(string.digits, r.randint(1, 4)) for _ in range(size)],
    }


def symbols(s: str) -> list[str]:
    """The first four characters stand for themselves; later letters and digits for their class."""
    return [*s[:4], *s[4:].translate(CLASSES)]


CLASSES = str.maketrans(ALNUM, "".join("a" if c in "abcdef" else "g" if c.islower() else "A" if c.isupper() else "0" for c in ALNUM))


class Automaton:
    """A probabilistic automaton folded from the prefix tree of a sample."""

    def __init__(self, sample: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]  # by symbol; END for strings that stop here
        for s in sample:
            at = 0
            for c in symbols(s):
                self.count[at][c] = self.count[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                at = self.next[at][c]
            self.count[at][END] = self.count[at].get(END, 0) + 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        while blue:
            parent, c = blue.pop(0)
            q = self.next[parent][c]
            for p in red:
                if self.compatible(p, q):
                    self.next[parent][c] = p
                    self.fold(p, q)
                    break
            else:
                red.append(q)
            reds = set(red)
            blue = sorted({(p, c) for p in red for c, x in self.next[p].items() if x not in reds})
        number = {q: i for i, q in enumerate(red)}
        self.next = [{c: number[x] for c, x in self.next[q].items()} for q in red]
        self.count = [self.count[q] for q in red]
        self.log = []
        for counts in self.count:
            n = sum(counts.values())
            self.log.append({c: math.log(k / (n + 1)) for c, k in counts.items()})

    def compatible(self, p: int, q: int) -> bool:
        """Outgoing frequencies of both states, and of what follows them, agree within the bound. A bound of 1 or more says
        nothing, nor can it below, where counts are smaller still; so the test ends there."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            a, b = self.count[p], self.count[q]
            n, m = sum(a.values()), sum(b.values())
            if not n or not m:
                continue
            gap = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if gap < 1 and any(abs(a.get(c, 0) / n - b.get(c, 0) / m) > gap for c in a.keys() | b.keys()):
                return False
            if gap < 1:
                todo += [(self.next[p][c], x) for c, x in self.next[q].items() if c in self.next[p]]
        return True

    def fold(self, p: int, q: int) -> None:
        """Add the tree below q to p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            for c, k in self.count[q].items():
                self.count[p][c] = self.count[p].get(c, 0) + k
            for c, x in self.next[q].items():
                if c in self.next[p]:
                    todo.append((self.next[p][c], x))
                else:
                    self.next[p][c] = x

    def score(self, syms: list[str]) -> float:
        """Log-likelihood; after an unseen symbol the machine stays where it is."""
        at, total = 0, 0.0
        for c in syms:
            total += self.log[at].get(c, UNSEEN)
            at = self.next[at].get(c, at)
        return total + self.log[at].get(END, UNSEEN)


class SecretScanner:
    def __init__(self, sample: dict[str, list[str]] | None = None):
        sample = sample or labelled()
        self.background = Automaton(sample["background"])
        self.formats = {k: Automaton(v) for k, v in sample.items() if k != "background"}

    def best(self, candidate: str) -> tuple[str, float, float]:
        """The likeliest format of a candidate, its log-likelihood per symbol and its margin over the background."""
        syms = symbols(candidate)
        k, ll = max(((k, a.score(syms)) for k, a in self.formats.items()), key=lambda x: x[1])
        return k, ll / (len(syms) + 1), ll - self.background.score(syms)

    def scan(self, text: str | None) -> list[tuple[str, int, int, bool]]:
        """(kind, start, end, base) by start, then by kind as listed, the formats after the base kinds."""
        if not text:
            return []
        base, values = [], []
        low = text.lower()
        if any(w in low for w in WORDS):
            for m in ASSIGN.finditer(text):
                values.append(m)
                if len(m[2]) >= 6:
                    base.append((m.start(), 0, m.end()))
        if "AKIA" in text:
            base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        base.sort()
        # candidates: what is assigned, and every run that touches no assignment
        starts, ends = [m.start() for m in values], [m.end() for m in values]
        found = [m.span(2) for m in values] + [m.span() for m in RUN.finditer(text) if bisect_left(starts, m.end()) == bisect_right(ends, m.start())]
        more = []
        for s, e in found:
            c = text[s:e].rstrip(".-/")
            if len(c) >= MIN_RUN and re.search("[0-9]", c) and re.search("[A-Za-z]", c):
                kind, per, margin = self.best(c)
                if per >= PER_SYMBOL and margin >= MARGIN:
                    more.append((kind, s, s + len(c), False))
        order = (*KINDS, *self.formats).index
        return sorted([(KINDS[k], s, e, True) for s, k, e in base] + more, key=lambda x: (x[1], order(x[0])))


@lru_cache(maxsize=1)
def scanner() -> SecretScanner:
    return SecretScanner()


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
SPAN_SQL = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows (id, secrets), one for each row of `df`: an array of spans (kind, start, end, base) in code points, end
    exclusive. A null or empty text has none. Every candidate is scored, also what a base pattern holds already: its span
    then tells the format beside the base span. Null ids pass through, repeated rows get equal spans each, an empty table
    gives an empty result, other columns are not read.
    """

    def make():
        s = SecretScanner(sample) if sample else scanner()

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = [[{"kind": k, "start": i, "end": j, "base": f} for k, i, j, f in s.scan(t)] for t in b.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(SPAN))], names=[id_col, "secrets"])

        return batch

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(F.col(id_col), F.col(text_col)), make, f"`{id_col}` {kind}, secrets {SPAN_SQL}")


def secret_digest(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, n_assign, n_access, n_hex, base_sha256, spans), one for each row of `df`; as `find_secrets` otherwise. A
    text without spans has counts of 0, the hash of no bytes and an empty string."""
    found = find_secrets(df, id_col)
    base = F.filter("secrets", lambda s: s["base"])
    of = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(id_col, *map(of, KINDS), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("secrets")).alias("spans"))
