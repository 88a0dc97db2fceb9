"""SentencePiece BPE encoding and decoding with a merge-type prefix table.

For every prefix of a text, BPE's encoding of that prefix ends in one token. That last
token is unique and can be found without merging: among the pieces that end there (an
automaton lists them), exactly one is compatible with the last token of the prefix
before it. The table of last tokens is filled left to right; walking it backwards
from the end gives the ids.

Two tokens are compatible when BPE, run over their joint text, would keep them apart.
That is read off the merge tree: undo the later merge of the two facing tokens again
and again; if at some point the facing pair is itself a merge that would have come
earlier, BPE would have taken it.

Pieces never hold white space after another character, so texts fall apart at each
space that follows a non-space, and ids of frequent words are kept in a bounded cache.
The words of a batch that are not in it fill their tables together, one character of
all of them at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import column, packed, unpacked

SPACE = "▁"
#: A space that follows a non-space starts a new segment.
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Words whose ids are remembered in a worker; when it has more, those not met since the last time go.
CACHE_WORDS = 1 << 16
#: Token pairs whose compatibility is remembered.
KNOWN_PAIRS = 1_000_000
#: Code points of texts that are digested together, words whose tables are filled
#: together, and the longest of such words.
TEXT_CHARS, TABLE_WORDS, TABLE_CHARS = 1 << 20, 1 << 14, 64


class Remembered:
    """A function of whole numbers, worked out once for each: sorted keys and their values."""

    def __init__(self, work: Callable[[int], int], most: int):
        self.work, self.most = work, most
        self.keys, self.values = np.array([-1], dtype=np.int64), np.zeros(1, dtype=np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys, "right") - 1
        missed = self.keys[at] != keys
        if missed.any():
            if len(self.keys) > self.most:
                self.keys, self.values = self.keys[:1], self.values[:1]
                missed[:] = True
            new = np.unique(keys[missed])
            place = np.searchsorted(self.keys, new)
            found = np.fromiter(map(self.work, new.tolist()), dtype=np.int32, count=len(new))
            self.keys, self.values = np.insert(self.keys, place, new), np.insert(self.values, place, found)
            at = np.searchsorted(self.keys, keys, "right") - 1
        return self.values[at]


class Spelling(dict):
    """The text of a token by its number and, at the end of a word, with a mark behind it; filled as met."""

    def __init__(self, text: Callable[[int], str], inner: str, end: str):
        super().__init__()
        self.text, self.behind = text, (inner, end)

    def __missing__(self, key: int) -> str:
        out = self[key] = self.text(key >> 1) + self.behind[key & 1]
        return out


class PieceModel:
    """Tables of one model file (bytes): merges, automaton, compatible pairs, byte ids."""

    def __init__(self, data: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.byte_ids = {}
        self.pieces: list[str] = []
        self.byte_of: dict[int, int] = {}
        self.special = set()
        normal = {}
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            self.pieces.append(piece)
            if sp.is_byte(i):
                self.byte_of[i] = int(piece[3:5], 16)
                self.byte_ids[self.byte_of[i]] = i
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.special.add(i)
            else:
                normal[piece] = (-sp.get_score(i), i)
        self.unk = sp.unk_id()
        self.id_text = [str(i) for i in range(sp.vocab_size())]
        self.runs = {p: v for p, v in normal.items() if not p.strip(SPACE)}
        self.words = {p: v for p, v in normal.items() if p.strip(SPACE) or p == SPACE}
        if any(SPACE in p[1:] for p in self.words):
            raise ValueError("a piece holds white space inside; such models are not supported")
        # tokens by merge order: single characters first, then merges as BPE takes them
        order = sorted(self.words, key=lambda p: (len(p) > 1, self.words[p]))
        self.text = order
        self.rank = {p: k for k, p in enumerate(order)}
        self.ids = [self.words[p][1] for p in order]
        self.left, self.right = list(range(len(order))), list(range(len(order)))
        self.pairs: dict[int, int] = {}  # by left * len(text) + right
        self._known: dict[int, bool] = {}
        for k, p in enumerate(order):
            if len(p) == 1:
                continue
            # the last merge that makes this token: the one split whose halves BPE
            # would reach and keep apart up to here; none: BPE never makes the token
            for cut in range(1, len(p)):
                a, b = self.rank.get(p[:cut]), self.rank.get(p[cut:])
                if a is None or b is None or not (self._made(a) and self._made(b)):
                    continue
                if self.compatible(a, b, k):
                    self.left[k], self.right[k] = a, b
                    self.pairs[a * len(order) + b] = k
                    break
        self.size = [len(p) for p in order]
        self.chars = {p for p in order if len(p) == 1}
        self.made = {p: k for k, p in enumerate(order) if self._made(k)}
        # the automaton: states are the starts of tokens, moves and matches are filled as met
        self._states = list(dict.fromkeys(p[:i] for p in ["", *self.made] for i in range(len(p) + 1)))
        self._state_of = {p: i for i, p in enumerate(self._states)}
        self._moves: list[dict[str, int]] = [{} for _ in self._states]
        self._found: list = [None] * len(self._states)
        # segments met of late and before: ids joined by commas, and decoded text
        self._recent: tuple[dict[str, str], dict[str, str]] = ({}, {})
        self._older: tuple[dict[str, str], dict[str, str]] = ({}, {})
        # the same by numbers: the longest token that ends in a state, the next shorter one that ends in a token;
        # a character that is no piece has its code point behind the last token's number
        self._longest = np.full(len(self._states), -1, dtype=np.int32)
        self._shorter = np.full(len(order), -1, dtype=np.int32)
        self._sizes = np.array([*self.size, 1], dtype=np.int64)
        self._apart = Remembered(lambda pair: self.compatible(*divmod(pair, len(self.text))), KNOWN_PAIRS)
        self._next = Remembered(self._numbered_move, KNOWN_PAIRS)
        self._spelled_ids = Spelling(lambda k: ",".join([self.id_text[i] for i in self._ids_of(k)]), ",", "\n")
        self._spelled_text = Spelling(lambda k: self._shown(self._ids_of(k)), "", SPACE)

    def _made(self, k: int) -> bool:
        return len(self.text[k]) == 1 or self.left[k] != k

    def compatible(self, a: int, b: int, below: int | None = None) -> bool:
        """Whether BPE keeps a and b apart; with ``below``, only by merges before that one.

        ``limit`` is the first merge order that no longer matters: a pair merges only
        while both facing tokens exist, that is before either is merged into a larger
        one. Equal orders go leftmost first, which the +1 on the right side states.
        """
        step = len(self.text)
        limit = step if below is None else below
        left, right, pairs = self.left, self.right, self.pairs
        while True:
            if pairs.get(a * step + b, limit) < limit:
                return False
            if a > b:
                limit = a
                a = right[a]
                if a == limit:  # a single character; undo the other side's next
                    limit = b + 1
                    b = left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = left[b]
                if b + 1 == limit:
                    limit = a
                    a = right[a]
                    if a == limit:
                        return True

    def _move(self, state: int, c: str) -> int:
        """The automaton's state after c: the longest end of what was read that starts a token."""
        s = self._states[state] + c
        while s not in self._state_of:
            s = s[1:]
        to = self._state_of[s]
        if self._found[to] is None:
            ends = (s[i:] for i in range(len(s)))
            found = self._found[to] = tuple((self.made[e], len(e)) for e in ends if e in self.made)
            self._longest[to] = found[0][0]
            for (k, _), (shorter, _) in zip(found, found[1:]):
                self._shorter[k] = shorter
        self._moves[state][c] = to
        return to

    def _numbered_move(self, move: int) -> int:
        """The state after a character; the first one after a character that is no piece."""
        c = chr(move & 0x1FFFFF)
        return self._move(move >> 21, c) if c in self.chars else 0

    def _ids_of(self, k: int) -> list[int]:
        """Ids of a token's number; of a character that is no piece, those of its bytes."""
        return [self.ids[k]] if k < len(self.ids) else [self.byte_ids[b] for b in chr(k - len(self.ids)).encode()]

    def _shown(self, ids: list[int]) -> str:
        """The decoded text of ids inside a text, where a leading space stays."""
        return self.decode([self.words["."][1], *ids])[1:]

    def _stretch(self, text: str) -> list[int]:
        """Ids of a text whose characters are all pieces, by the prefix table."""
        whole = self.made.get(text)
        if whole is not None:
            return [self.ids[whole]]
        last: list[int] = []  # by prefix: its encoding's last token
        known, moves, found, step, state = self._known, self._moves, self._found, len(self.text), 0
        for at, c in enumerate(text):
            move = moves[state].get(c)
            state = self._move(state, c) if move is None else move
            for k, size in found[state]:  # the longest first
                start = at - size
                if start >= 0:
                    pair = last[start] * step + k
                    apart = known.get(pair)
                    if apart is None:
                        if len(known) > KNOWN_PAIRS:
                            known.clear()
                        apart = known[pair] = self.compatible(last[start], k)
                    if not apart:
                        continue
                last.append(k)
                break
        if len(last) != len(text):
            raise AssertionError("a prefix has no last token; the merge table is inconsistent")
        out, at, ids, size = [], len(text), self.ids, self.size
        while at:
            k = last[at - 1]
            out.append(ids[k])
            at -= size[k]
        return out[::-1]

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of the texts, one after the other, and where each one's end: all prefix tables, place by place.

        A character that is no piece is a token of its own, with which nothing merges.
        """
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        order = np.argsort(-sizes, kind="stable")
        code = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        first, longest, step = (np.cumsum(sizes) - sizes)[order], int(sizes.max(initial=0)), len(self.text)
        alive = np.searchsorted(-sizes[order], -np.arange(longest), "left")  # texts with a character at each place
        last = np.empty((longest, len(texts)), dtype=np.int32)  # by prefix and text: its encoding's last token
        state = np.zeros(len(texts), dtype=np.int64)
        for at, n in enumerate(alive.tolist()):
            c = code[first[:n] + at]
            state = self._next(state[:n] << 21 | c).astype(np.int64)
            token = np.where(state > 0, self._longest[state], step + c)
            open_ = np.flatnonzero(state)
            while len(open_):  # the longest first
                k = token[open_]
                if (k < 0).any():
                    raise AssertionError("a prefix has no last token; the merge table is inconsistent")
                start = at - self._sizes[k]
                open_, k, start = open_[start >= 0], k[start >= 0], start[start >= 0]
                before = last[start, open_].astype(np.int64)
                open_, k, before = open_[before < step], k[before < step], before[before < step]
                merge = self._apart(before * step + k) == 0
                open_ = open_[merge]
                token[open_] = self._shorter[k[merge]]
            last[at, :n] = token
        # backwards from the ends; each round finds one more token of every text that has one
        at, rows, found, many = sizes[order] - 1, np.flatnonzero(sizes[order]), [], np.zeros(len(texts), dtype=np.int64)
        while len(rows):
            k = last[at[rows], rows]
            found.append((rows, k))
            many[rows] += 1
            at[rows] -= self._sizes[np.minimum(k, step)]
            rows = rows[at[rows] >= 0]
        ends = np.cumsum(many[np.argsort(order)])
        flat, place = np.empty(int(many.sum()), dtype=np.int64), ends[order] - 1
        for r, (rows, k) in enumerate(found):
            flat[place[rows] - r] = k
        return flat, ends

    @lru_cache(maxsize=4096)  # noqa: B019
    def _run(self, n: int) -> tuple[int, ...]:
        """Ids of n spaces. All their merges rank alike, so the leftmost goes first."""
        parts = [SPACE] * n
        best = min((v[0] for p, v in self.runs.items() if len(p) > 1), default=0)
        if any(v[0] != best for p, v in self.runs.items() if len(p) > 1):
            raise ValueError("white-space pieces of different scores are not supported")
        done, rest = [], parts
        while rest:  # grow the leftmost token as far as it goes, backing up when a later one fits it
            done.append(rest.pop())
            while len(done) > 1 and (done[-2] + done[-1]) in self.runs:
                done[-2:] = [done[-2] + done[-1]]
        return tuple(self.runs[p][1] for p in done)

    def segment(self, s: str) -> list[int]:
        """Ids of a segment: spaces, then characters without a space."""
        word = s.lstrip(SPACE)
        spaces = len(s) - len(word)
        if not word:
            return list(self._run(spaces))
        body = SPACE + word if spaces else word
        out: list[int] = []
        # characters that are no piece become bytes, and nothing merges across them
        for stretch, odd in [(body, "")] if self.chars.issuperset(body) else self._cuts(body):
            if stretch:
                out.extend(self._stretch(stretch))
            for byte in odd.encode():
                out.append(self.byte_ids.get(byte, self.unk))
        if spaces:
            alone = out[0] == self.words[SPACE][1]
            run = spaces if alone else spaces - 1
            out[: 1 if alone else 0] = self._run(run) if run else ()
        return out

    def _cuts(self, body: str) -> list[tuple[str, str]]:
        found, stretch, odd = [], [], []
        for c in body:
            if c in self.chars:
                if odd:
                    found.append(("".join(stretch), "".join(odd)))
                    stretch, odd = [], []
                stretch.append(c)
            else:
                odd.append(c)
        found.append(("".join(stretch), "".join(odd)))
        return found

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            for s in SEGMENT.findall(SPACE + text.replace(" ", SPACE)):
                out.extend(self.segment(s))
        return out

    def decode(self, ids) -> str:
        """The text of ids: pieces joined, bytes put together, one leading space dropped."""
        parts: list[str] = []
        held = bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                parts.append(_utf8(bytes(held)))
                held.clear()
            if i == self.unk:
                parts.append(" ⁇ ")
            elif i not in self.special:
                piece = self.pieces[i]
                if not parts and piece.startswith(SPACE):
                    piece = piece[1:]
                    parts.append("")
                parts.append(piece.replace(SPACE, " "))
        if held:
            parts.append(_utf8(bytes(held)))
        return "".join(parts)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text."""
        return self.digests([text])[0]

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """For each text, number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text.

        Every segment's ids hold whole characters and start afresh, so the decoded text
        is the decoded segments joined, but for the first one's leading space. Segments
        that are not remembered are encoded together.
        """
        out, held, chars = [], [], 0
        for text in texts:
            held.append(SEGMENT.findall(SPACE + text.replace(" ", SPACE)) if text else [])
            chars += len(text or "")
            if chars >= TEXT_CHARS:
                out.extend(self._digested(held))
                held, chars = [], 0
        return out + self._digested(held)

    def _digested(self, texts: list[list[str]]) -> list[tuple[int, str, str]]:
        if len(self._recent[0]) >= CACHE_WORDS:
            self._recent, self._older = ({}, {}), self._recent
        ids_of, text_of = self._recent
        new = set().union(*texts).difference(ids_of)
        for s in new & self._older[0].keys():
            ids_of[s], text_of[s] = self._older[0][s], self._older[1][s]
        long = self._spell(new.difference(ids_of))
        out = []
        for segments in texts:
            ids = ",".join(map(ids_of.__getitem__, segments))
            text = "".join(map(text_of.__getitem__, segments))[1:]
            n = ids.count(",") + 1 if ids else 0
            out.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        for s in long:
            del ids_of[s], text_of[s]
        return out

    def _spell(self, segments: set[str]) -> list[str]:
        """Remembers segments, those of a few spaces or characters together; returns the long ones, to be forgotten."""
        ids_of, text_of = self._recent
        whole = len(self.byte_ids) == 256
        plain = [s for s in segments if len(s) <= TABLE_CHARS and s[1:2] not in ("", SPACE) and (whole or self.chars.issuperset(s))]
        for a in range(0, len(plain), TABLE_WORDS):
            part = plain[a : a + TABLE_WORDS]
            flat, ends = self.tokens(part)
            keys = flat << 1
            keys[ends - 1] += 1
            keys = keys.tolist()
            ids_of.update(zip(part, "".join(map(self._spelled_ids.__getitem__, keys)).split("\n")))
            text_of.update(zip(part, "".join(map(self._spelled_text.__getitem__, keys)).split(SPACE)))
        for s in segments.difference(plain):
            own = self.segment(s)
            ids_of[s], text_of[s] = ",".join([self.id_text[i] for i in own]), self._shown(own)
        return [s for s in segments if len(s) > TABLE_CHARS]


def _utf8(data: bytes) -> str:
    """Bytes as text; each byte that belongs to no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def load_model(data: bytes) -> PieceModel:
    """The tables of a model, built once in each Python worker."""
    return PieceModel(data)


def model_bytes(path: str) -> bytes:
    """The model file, read on the driver; it goes to the tasks with the code (about 0.5 MB)."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, text_col: str = "text", into: str = "ids") -> DataFrame:
    """All rows and columns and the ids of each whole text, as the model's library gives them.

    Null and empty texts have no ids. A column named as ``into`` is replaced; other
    extra columns pass through.
    """

    @F.pandas_udf("array<int>")
    def ids(text: pd.Series) -> pd.Series:
        m = load_model(model)
        return pd.Series([m.encode(t) for t in text])

    return docs.withColumn(into, ids(F.col(text_col)))


def decode(rows: DataFrame, model: bytes, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """All rows and columns and the text of the ids. Null or empty ids give an empty text."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        m = load_model(model)
        return pd.Series([m.decode(x if x is not None else ()) for x in ids])

    return rows.withColumn(into, text(F.col(ids_col)))


def digests(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """All rows and columns and n_tokens, ids_sha256, decoded_sha256 of each whole text.

    The ids and texts are those of encode() and decode(), digested in the task. Null
    text is empty: no tokens, the digests of nothing. Columns of these names are replaced.
    """

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digest(text: pd.Series) -> pd.DataFrame:
        m = load_model(model)
        return pd.DataFrame(m.digests(text.tolist()), columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    new = ("n_tokens", "ids_sha256", "decoded_sha256")
    rows = docs.select(packed(docs).alias("row"), digest(column(text_col)).alias("d"))
    return rows.select(*unpacked(rows, "row", {c: F.col(f"d.{c}") for c in new}))
