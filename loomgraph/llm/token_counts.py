"""Token counts by a compiled finite-state transducer.

A byte-pair vocabulary is compiled to a deterministic transducer over characters.
After each character the encoding of what was read ends in one settled token;
which one depends only on the tokens that ended where a vocabulary entry in
progress began. Those, with their counts relative to now, and the automaton node
of the entries in progress make up a state. A transition carries the change of
the token count, so the count of a text is the sum along its path. Transitions
are compiled when first met, many at a time in numpy, and many words walk in step.

No entry holds a space after another character, so a word's first space leads to
the same state from anywhere. A chunk of a long text therefore maps every state
to one exit state after its first word start, and has one count between its first
and last word start; such maps compose, in a tree, into the map of the whole text.
Whole words are remembered as single transitions. A long word is cut into chunks
too: each has a map from entry states to exit states and counts. The chunks walk
in step, first from where a few characters before each lead from the start, then
from the exits met before it, until no exit is missing among the next entries;
the maps then compose by a scan in a tree.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.piece_model import BPE, NORMAL, SPACE, read_model
from loomgraph.llm.row_types import with_id

#: Characters a chunk of a long text has, and a batch of texts.
CHUNK_CHARS = 1 << 16
BATCH_CHARS = 1 << 22
#: Words and states a worker remembers before it starts again (speed only, no result depends on them).
WORDS_KEPT = 600_000
STATES_KEPT = 600_000
#: Bounds what the remembered words may hold, in characters (speed only).
CHARS_KEPT = 1 << 25
#: Words longer than this are cut into chunks of so many characters, a block of chunks at a time; a chunk's first entry is guessed from so many characters before it (speed only).
LONG_WORD, STEP_CHARS, BLOCK_CHARS, GUESS_CHARS = 96, 256, 1 << 18, 32
DEEP = 17  # one more than the characters of the longest entry
FREE, NONE = -2, -1  # no entry in progress began there; one did, at a start or behind a character of no entry


class Table:
    """Whole numbers to whole numbers, looked up many at a time (open addressing)."""

    def __init__(self, keys: np.ndarray = (), values: np.ndarray = ()):
        self.n, self.keys, self.values = 0, np.full(1 << 12, -1), np.zeros(1 << 12, np.int64)
        if len(keys):
            self.add(np.asarray(keys, np.int64), np.asarray(values, np.int64))

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (len(self.keys).bit_length() - 1))).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that differ and aren't there."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            held = self.keys >= 0
            keys, values = np.concatenate([self.keys[held], keys]), np.concatenate([self.values[held], values])
            size = 1 << int(4 * len(keys)).bit_length()
            self.n, self.keys, self.values = 0, np.full(size, -1), np.zeros(size, np.int64)
        self.n += len(keys)
        at = self._at(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & (len(self.keys) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key isn't there."""
        out = np.full(len(keys), -1)
        at, left = self._at(keys), np.arange(len(keys))
        while len(left):
            found = self.keys[at]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (found != -1)
            left, at = left[on], (at[on] + 1) & (len(self.keys) - 1)
        return out


class Transducer:
    """Counts the tokens of words. State 0 is the start of a word."""

    def __init__(self, scores: dict[str, float]):
        """``scores``: entry to score, spaces written as plain spaces; higher scores merge first, the leftmost of equals."""
        self.scores, self.names = scores, sorted(scores, key=lambda p: -scores[p])
        if any(" " in p.lstrip(" ") or (p.startswith("  ") and p.strip(" ")) for p in scores) or max(map(len, scores)) >= DEEP:
            raise ValueError("an entry holds a space after another character, or is too long")
        self.id = {p: i for i, p in enumerate(self.names)}
        equal = [scores[p] == scores[q] for p, q in zip(self.names, self.names[1:])]
        self.tied = np.array([False, *equal]) | np.array([*equal, False])
        self.length = np.array([len(p) for p in self.names])
        self.rank = np.where(self.length > 1, np.arange(len(self.names)), -1)
        self._compile_entries()
        self._compile_merges()
        self.slow_fits = lru_cache(1 << 16)(self._slow_fits)
        self._reset()

    def _compile_entries(self) -> None:
        """The automaton of entries in progress: a trie, each node's next shorter suffix, the entries that end there."""
        goto: list[dict[str, int]] = [{}]
        depth, ends = [0], [-1]
        for i, piece in enumerate(self.names):
            at = 0
            for c in piece:
                if c not in goto[at]:
                    goto[at][c] = len(goto)
                    goto.append({})
                    depth.append(depth[at] + 1)
                    ends.append(-1)
                at = goto[at][c]
            ends[at] = i
        fail, order = [0] * len(goto), list(goto[0].values())
        for at in order:
            for c, to in goto[at].items():
                f = fail[at]
                while f and c not in goto[f]:
                    f = fail[f]
                fail[to] = goto[f].get(c, 0)
                order.append(to)
        lists: list[list[int]] = [[] for _ in goto]
        chain = np.ones(len(goto), np.int64)
        for at in order:
            lists[at] = ([ends[at]] if ends[at] >= 0 else []) + lists[fail[at]]
            chain[at] = chain[fail[at]] | 1 << depth[at]
        self.fail = np.array(fail)
        most = max(map(len, lists))
        self.ends = np.array([x + [-1] * (most - len(x)) for x in lists])
        self.in_progress = (chain[:, None] >> np.arange(DEEP) & 1).astype(bool)
        edges = [(at << 21 | ord(c), to) for at, way in enumerate(goto) for c, to in way.items()]
        self.edges = Table(*np.array(edges).T)

    def _compile_merges(self) -> None:
        """Of each entry the last merge that makes it, if its own text is encoded as it; of each pair that can merge, what it makes."""
        n = len(self.names)
        self.valid, self.split = np.ones(n, bool), np.zeros((n, 2), np.int64)
        pairs = []
        for i, piece in enumerate(self.names):
            if len(piece) > 1:
                pairs += [(self.id[piece[:k]] * n + self.id[piece[k:]], i) for k in range(1, len(piece)) if piece[:k] in self.id and piece[k:] in self.id]
                parts = self.merged(piece, 2)
                self.valid[i] = len(parts) == 2
                if self.valid[i] and parts[0] in self.id and parts[1] in self.id:
                    self.split[i] = self.id[parts[0]], self.id[parts[1]]
        self.pairs = Table(*np.array(pairs).T)

    def merged(self, text: str, least: int = 1) -> list[str]:
        """The encoding of a short text by its definition: merge the adjacent pair of the best score, the leftmost of equals; stops at ``least`` parts."""
        parts, rank = list(text), self.scores
        while len(parts) > least:
            best = max(range(len(parts) - 1), key=lambda i: (rank.get(parts[i] + parts[i + 1], float("-inf")), -i))
            if parts[best] + parts[best + 1] not in rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _slow_fits(self, before: int, piece: int) -> bool:
        a, b = "" if before < 0 else self.names[before], self.names[piece]
        return self.merged(a + b) == ([a, b] if a else [b])

    def fits(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece can follow the token before it: what the two spell is encoded as these two.

        Merges are undone from the last one on. Where the two pieces that then meet
        would have merged earlier than what is undone, they don't stay apart; of
        equal merges the left one comes first.
        """
        ok = self.valid[piece]
        odd = self.tied[piece] | (self.tied[before] & (before >= 0))
        for i in np.flatnonzero(odd):
            ok[i] = self.slow_fits(int(before[i]), int(piece[i]))
        at = np.flatnonzero(ok & ~odd & (before >= 0))
        left, right, limit = before[at], piece[at], np.full(len(at), 4 * len(self.names))
        while len(at):
            made = self.pairs.get(left * len(self.names) + right)
            bad = (made >= 0) & (2 * made < limit)
            ok[at[bad]] = False
            a, b = self.rank[left], self.rank[right]
            on = ~bad & ((a >= 0) | (b >= 0))
            at, left, right, a, b = at[on], left[on], right[on], a[on], b[on]
            undo_left = a > b
            limit = np.where(undo_left, 2 * a, 2 * b + 1)
            left, right = np.where(undo_left, self.split[left, 1], left), np.where(undo_left, right, self.split[right, 0])
        return ok

    def _reset(self, keep: int = 0) -> int:
        """Forgets all states but the start and ``keep``, whose new number is returned."""
        kept = [x[keep : keep + 1].copy() for x in (self.node, self.in_word, self.token, self.count)] if keep else []
        self.states = 0
        self.node, self.in_word = np.zeros(1, np.int64), np.zeros(1, bool)
        self.token, self.count = np.full((1, DEEP), FREE, np.int32), np.zeros((1, DEEP), np.int16)
        self.token[0, 0] = NONE
        self.states = 1
        self.ids: dict[int, int] = {}
        self.moves = Table()
        self.mix = np.random.default_rng(7).integers(1, 1 << 62, 2 * DEEP + 2, np.int64) | 1
        return int(self._store(*kept)[0]) if keep else 0

    def _store(self, *columns: np.ndarray) -> np.ndarray:
        """Numbers of new states: node, in_word, token, count."""
        begin, end = self.states, self.states + len(columns[0])
        for name, new in zip(("node", "in_word", "token", "count"), columns, strict=True):
            old = getattr(self, name)
            if end > len(old):
                old = np.concatenate([old, np.zeros((max(end, 2 * len(old)) - len(old), *old.shape[1:]), old.dtype)])
                setattr(self, name, old)
            old[begin:end] = new
        self.states = end
        return np.arange(begin, end)

    def _compile_moves(self, keys: np.ndarray) -> np.ndarray:
        """Transitions of (state, character) keys: next state and change, packed as in ``moves``."""
        state, char = keys >> 21, keys & 0x1FFFFF
        token, count = self.token[state].astype(np.int64), self.count[state].astype(np.int64)
        space = char == 32
        again = space & self.in_word[state]
        token[again], count[again] = self.token[0], 0
        node = np.where(again, 0, self.node[state])
        to, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
        while len(left):
            got = self.edges.get(node[left] << 21 | char[left])
            to[left] = np.maximum(got, 0)
            left = left[(got < 0) & (node[left] > 0)]
            node[left] = self.fail[node[left]]
        chosen, rows = np.full(len(keys), -1), np.arange(len(keys))
        for piece in self.ends[to].T:
            at = rows[(chosen < 0) & (piece >= 0)]
            if not len(at):
                break
            before = token[at, self.length[piece[at]] - 1]
            at, before = at[before != FREE], before[before != FREE]
            at = at[self.fits(before, piece[at])]
            chosen[at] = piece[at]
        known = chosen >= 0
        # A character of no entry: as many byte tokens as UTF-8 bytes, and nothing merges over it.
        change = np.where(known, count[rows, self.length[chosen] - 1] + 1, 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF))
        to = np.where(known, to, 0)
        held = self.in_progress[to]
        token = np.where(held, np.concatenate([chosen[:, None], token[:, :-1]], 1), FREE)
        count = np.where(token == FREE, 0, np.concatenate([np.zeros((len(keys), 1), np.int64), count[:, :-1] - change[:, None]], 1))
        with np.errstate(over="ignore"):
            marks = (np.concatenate([to[:, None], ~space[:, None], token, count], 1) * self.mix).sum(1)
            marks ^= marks >> 29
        fresh: list[int] = []
        ids, base = np.zeros(len(keys), np.int64), self.states
        for i, mark in enumerate(marks.tolist()):
            found = self.ids.get(mark)
            if found is None:
                found = self.ids[mark] = base + len(fresh)
                fresh.append(i)
            ids[i] = found
        self._store(to[fresh], ~space[fresh], token[fresh], count[fresh])
        same = (self.node[ids] == to) & (self.in_word[ids] == ~space) & (self.token[ids] == token).all(1) & (self.count[ids] == count).all(1)
        if not same.all():  # two states of one mark: the second gets a number of its own
            ids[~same] = self._store(to[~same], ~space[~same], token[~same], count[~same])
        return ids << 8 | (change + 128)

    def walk(self, words: list[str], entry: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and counts of words or chunks that walk in step, from the start or from ``entry``."""
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        size = np.array([len(words[i]) for i in order])
        chars = np.frombuffer("".join([words[i] for i in order]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begin = np.cumsum(size) - size
        state, total = np.zeros(len(words), np.int64) if entry is None else entry[order], np.zeros(len(words), np.int64)
        for t in range(size[0] if len(size) else 0):
            n = np.searchsorted(-size, -t)  # those longer than t
            keys = state[:n] << 21 | chars[begin[:n] + t]
            got = self.moves.get(keys)
            if (new := got < 0).any():
                ask = np.unique(keys[new])
                for i in range(0, len(ask), 1 << 15):
                    self.moves.add(ask[i : i + (1 << 15)], self._compile_moves(ask[i : i + (1 << 15)]))
                got[new] = self.moves.get(keys[new])
            state[:n] = got >> 8
            total[:n] += (got & 255) - 128
        exits, counts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        exits[order], counts[order] = state, total
        return exits, counts

    def through(self, spans: list[tuple[str, int, int]], entry: list[int]) -> list[tuple[int, int]]:
        """Exit state and count of each span (word, begin, end) from its entry, by maps of its chunks."""
        rows = [[word[i : min(i + STEP_CHARS, end)] for i in range(begin, end, STEP_CHARS)] for word, begin, end in spans]
        before = [word[max(0, i - GUESS_CHARS) : i] for word, begin, end in spans for i in range(begin + STEP_CHARS, end, STEP_CHARS)]
        guess = iter(self.walk(before)[0].tolist())
        asked = {(c, next(guess) if i else first) for row, first in zip(rows, entry, strict=True) for i, c in enumerate(row)}
        links = {pair for row in rows for pair in zip(row, row[1:])}
        maps: dict[str, dict[int, tuple[int, int]]] = {c: {} for row in rows for c in row}
        while asked:
            ask = list(asked)
            exits, counts = self.walk([c for c, _ in ask], np.array([s for _, s in ask]))
            for (c, s), x, n in zip(ask, exits.tolist(), counts.tolist(), strict=True):
                maps[c][s] = x, n
            asked = {(b, x) for a, b in links for x, _ in maps[a].values() if x not in maps[b]}
        return [tree([maps[c] for c in row], self.compose)[first] for row, first in zip(rows, entry, strict=True)]

    @staticmethod
    def compose(a: dict[int, tuple[int, int]], b: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
        """The map of ``a`` and then ``b``, which has every exit of ``a`` among its entries."""
        return {s: (b[x][0], n + b[x][1]) for s, (x, n) in a.items()}

    def walk_long(self, words: list[str]) -> list[int]:
        """The counts of words of any length: many together, or one a block at a time."""
        out: list[int] = []
        part: list[tuple[str, int, int]] = []
        for k, word in enumerate(words):
            state = total = begin = 0
            while len(word) - begin > BLOCK_CHARS:
                state = self._reset(state) if self.states >= STATES_KEPT else state
                [(state, n)] = self.through([(word, begin, begin + BLOCK_CHARS)], [state])
                total, begin = total + n, begin + BLOCK_CHARS
            if begin:
                [(_, n)] = self.through([(word, begin, len(word))], [state])
                out += self._together(part)
                out.append(total + n)
                part = []
                continue
            part.append((word, 0, len(word)))
            if k + 1 == len(words) or sum(end for _, _, end in part[-1024:]) >= BLOCK_CHARS or len(part) >= 1024:
                out += self._together(part)
                part = []
        return out + self._together(part)

    def _together(self, part: list[tuple[str, int, int]]) -> list[int]:
        if part and self.states >= STATES_KEPT:
            self._reset()
        return [n for _, n in self.through(part, [0] * len(part))] if part else []


def tree(maps: list, compose: Callable):
    """The maps composed in order, neighbours first."""
    while len(maps) > 1:
        maps = [compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


class Counter:
    """Counts the tokens of whole texts of any length."""

    def __init__(self, model_path: str):
        model = read_model(model_path)
        if model.model_type != BPE or model.charsmap or not model.add_dummy_prefix or not model.escape_whitespaces or model.remove_extra_whitespaces or model.whitespace_suffix or not model.byte_fallback:
            raise ValueError("a byte-pair model with byte fallback and no normalisation is needed")
        if any(kind not in (1, 2, 3, 6) for _, _, kind in model.pieces):
            raise ValueError("user-defined and unused pieces aren't supported")
        self.machine = Transducer({p.replace(SPACE, " "): s for p, s, kind in model.pieces if kind == NORMAL})
        self.words: dict[str, int] = {}
        self.chars = 0

    def learn(self, words: set[str]) -> None:
        """Remembers the counts of words, written without one leading space."""
        if len(self.words) >= WORDS_KEPT or self.chars >= CHARS_KEPT:
            self.words.clear()
            self.chars = 0
        new = [" " + w for w in words.difference(self.words)]
        self.chars += sum(map(len, new))
        if self.machine.states >= STATES_KEPT:
            self.machine._reset()
        short, long = [w for w in new if len(w) <= LONG_WORD], [w for w in new if len(w) > LONG_WORD]
        for i in range(0, len(short), 1 << 16):
            part = short[i : i + (1 << 16)]
            self.words.update(zip([w[1:] for w in part], self.machine.walk(part)[1].tolist(), strict=True))
        self.words.update(zip([w[1:] for w in long], self.machine.walk_long(long), strict=True))

    def count(self, words: list[str]) -> int:
        self.learn(set(words))
        return sum(map(self.words.__getitem__, words))

    @staticmethod
    def split(text: str) -> list[str]:
        """``text`` starts with a space or is empty: its words without one leading space."""
        if not text:
            return []
        return [w[1:] for w in re.findall(" +[^ ]*", text)] if "  " in text else text[1:].split(" ")

    def chunk_map(self, chunk: str) -> tuple[str, int, str | None]:
        """(head, count, path): any entry state runs over head; count is that of the words between the first and the last word start; the exit state is where path, the last word so far, leads from the start (None: no word starts here)."""
        starts = [m.start() for m in re.finditer("(?<=[^ ]) ", chunk)]
        if not starts:
            return chunk, 0, None
        return chunk[: starts[0]], self.count(self.split(chunk[starts[0] : starts[-1]])), chunk[starts[-1] :]

    def compose(self, a: tuple[str, int, str | None], b: tuple[str, int, str | None]) -> tuple[str, int, str | None]:
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        if b[2] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.count(self.split(a[2] + b[0])) + b[1], b[2]

    def long_count(self, text: str) -> int:
        """The count of a text of any length, by maps of its chunks."""
        head, n, path = tree([self.chunk_map(text[i : i + CHUNK_CHARS]) for i in range(0, len(text), CHUNK_CHARS)], self.compose)
        return n + self.count(self.split(head)) + self.count(self.split(path or ""))

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        part: list[list[str] | int] = []
        chars = 0
        for i, text in enumerate(texts):
            text = " " + text.replace(SPACE, " ") if text else ""
            part.append(self.long_count(text) if len(text) > CHUNK_CHARS else self.split(text))
            chars += len(text)
            if chars >= BATCH_CHARS or i + 1 == len(texts):
                self.learn(set().union(*[x for x in part if not isinstance(x, int)]))
                out += [x if isinstance(x, int) else sum(map(self.words.__getitem__, x)) for x in part]
                part, chars = [], 0
        return out


@lru_cache(2)
def counter(model_path: str) -> Counter:
    return Counter(model_path)


def token_counts(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every row. Null text counts as empty: 0 bytes, 0 tokens. No shuffle, so repeated rows are counted each."""
    base = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array(counter(model_path).counts(b.column(2).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], names=[id_col, "n_bytes", "n_tokens"])

    sized = base.select(F.col(f"`{id_col}`"), F.octet_length("_text").cast("bigint").alias("n_bytes"), "_text")
    return sized.mapInArrow(count, with_id(docs, id_col, "n_bytes bigint, n_tokens bigint")).withColumn("over_limit", F.col("n_tokens") > limit)
