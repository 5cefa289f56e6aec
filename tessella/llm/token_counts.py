"""Token counts by a compiled transducer.

A piece model merges the best-ranked adjacent pair again and again. Two tokens stand side by side in a result
exactly if that pair alone encodes to itself, so the encoding of every prefix of a text has one last token that
follows from the last tokens of a few shorter prefixes. What a transition needs to know is thus finite: for
every start that can still grow into a vocabulary entry, the pending characters, the token before them and its
count relative to the present one. Such states are numbered as they are met; each transition holds the next
state and by how many tokens the encoding grows (a later character can also shrink it).

No vocabulary entry holds a space mark after another character, so a mark after another character resets the
machine. A chunk of text is therefore a map from states to states that needs the incoming state only up to its
first reset; such maps compose associatively, and every text is counted by a scan over its chunks' maps. A map holds
its state itself, not a number of it, so it means the same whatever states a machine has met or forgotten.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_batches

MARK = "▁"
CHUNK = 1 << 16
#: Cached words and machine states of a task; beyond that both start anew, so memory is bounded.
CACHE = 300_000
STATES = 250_000
#: Words of fewer characters are cached.
SHORT = 64
START = 0


class PieceTransducer:
    """Counts tokens as the sentencepiece BPE model at `path` emits them."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.bytes = any(sp.is_byte(i) for i in range(size))
        self.resets = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.score)
        self.alphabet = set("".join(self.score))
        self.whole = {p for p in self.score if len(p) == 1 or self.merged(p) == [p]}
        self.heads = {p[:k] for p in self.whole for k in range(1, len(p))}
        self.fits: dict[tuple[str, str], bool] = {}
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple] = [(("", "", 0),)]
        self.number = {self.states[0]: START}
        self.next: list[dict[str, tuple[int, int]]] = [{}]
        self.counts: dict[str, int] = {}

    def merged(self, s: str) -> list[str]:
        """Plain merging, best score first and leftmost among equals; used to compile, not to count texts."""
        parts = list(s)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], float("-inf")), -i))
            if parts[best] + parts[best + 1] not in self.score:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def cost(self, piece: str) -> int:
        """Tokens of a final piece: an unknown character falls back to its bytes, or to one unknown token."""
        return 1 if piece in self.score or not self.bytes else len(piece.encode())

    def beside(self, a: str, b: str) -> bool:
        if not a:
            return True
        key = (a, b)
        if key not in self.fits:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            self.fits[key] = self.merged(a + b) == [a, b]
        return self.fits[key]

    def step(self, state: int, ch: str) -> tuple[int, int]:
        """The transition of `state` on `ch`, compiled when it is first taken."""
        if ch not in self.alphabet:  # never merges
            return START, self.cost(ch)
        grown, found = [], None
        for s, last, count in self.states[state]:
            t = s + ch
            if found is None and (t in self.whole or not s) and self.beside(last, t):
                found = (t, count + self.cost(t))
            if t in self.heads:
                grown.append((t, last, count))
        token, count = found
        new = (*((s, last, c - count) for s, last, c in grown), ("", token, 0))
        return self.numbered(new), count

    def run(self, state: int, text: str) -> tuple[int, int]:
        total, table = 0, self.next
        for ch in text:
            move = table[state].get(ch)
            if move is None:
                move = table[state][ch] = self.step(state, ch)
            state, n = move
            total += n
        return state, total

    def numbered(self, state: tuple) -> int:
        """The number of a state in this machine."""
        at = self.number.get(state)
        if at is None:
            at = self.number[state] = len(self.states)
            self.states.append(state)
            self.next.append({})
        return at

    def bound(self) -> None:
        """Start anew where the machine has grown too large; maps made before stay valid."""
        if len(self.states) > STATES:
            self.forget()
        if len(self.counts) > CACHE:
            self.counts = {}

    # A chunk's map is (head, None) or (head, (count, state)): the head is what precedes the first reset and must be
    # run from the incoming state; what follows starts at a reset and has a fixed count and end.
    def chunk_map(self, text: str) -> tuple[str, tuple[int, tuple] | None]:
        self.bound()
        cut = RESET.search(text) if self.resets else None
        if not cut:
            return text, None
        pieces = PIECE.findall(text, cut.end())
        counts, total = self.counts, 0
        last = pieces.pop()
        for p in pieces:
            n = counts.get(p)
            if n is None:
                n = self.run(START, p)[1]
                if len(p) < SHORT:
                    counts[p] = n
            total += n
        state, n = self.run(START, last)
        return text[: cut.end()], (total + n, self.states[state])

    def compose(self, a: tuple, b: tuple) -> tuple:
        if a[1] is None:
            return a[0] + b[0], b[1]
        self.bound()
        count, state = a[1]
        end, n = self.run(self.numbered(state), b[0])
        return (a[0], (count + n, self.states[end])) if b[1] is None else (a[0], (count + n + b[1][0], b[1][1]))

    def scan(self, maps: list[tuple]) -> tuple:
        """All maps composed in a balanced tree, the up-sweep of a parallel prefix scan."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str | None) -> int:
        """Tokens of a text; null and empty texts have none."""
        if not text:
            return 0
        s = MARK + text.replace(" ", MARK)
        head, tail = self.scan([self.chunk_map(s[i : i + CHUNK]) for i in range(0, len(s), CHUNK)])
        n = self.counts.get(head)
        if n is None:
            n = self.run(START, head)[1]
            if len(head) < SHORT:
                self.counts[head] = n
        return n + (tail[0] if tail else 0)


RESET = re.compile(f"[^{MARK}](?={MARK})")
PIECE = re.compile(f"{MARK}+[^{MARK}]*")


@lru_cache(maxsize=2)
def transducer(path: str) -> PieceTransducer:
    return PieceTransducer(path)


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_tokens), one for each row of `df`, repeated rows included.

    A null text counts as empty: 0 bytes, 0 tokens. Ids pass through, null ones too; other columns are not read.
    """

    def make():
        t = transducer(path)

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(1).to_pylist()
            return pa.RecordBatch.from_arrays([b.column(0), pa.array([len((x or "").encode()) for x in texts], pa.int64()), pa.array(map(t.count, texts), pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

        return batch

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(F.col(id_col), F.col(text_col)), make, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
