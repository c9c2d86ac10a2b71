"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed and rebuilt as a tokenizer: its normaliser,
the metaspace marker for spaces, unigram scores or byte-pair merges by score, and
byte fallback. Batches are encoded by several threads, and all ids are compared
with the sentencepiece library's; where they differ, that library's ids stand and
``parity`` is false.

In a byte-pair model without normalisation, where no piece has a space mark behind
another character, no merge crosses a word start. A text's ids are then those of
its words in a row. Workers encode, compare and decode each different word once;
texts with a word that differs are compared as a whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.piece_model import BPE, BYTE, CONTROL, NORMAL, SPACE, UNKNOWN, PieceModel, read_model
from loomgraph.llm.row_types import with_id

#: Characters encoded in one call, which bounds a worker's memory.
BATCH_CHARS = 1 << 21
#: Words a worker remembers before it starts again, and their longest (speed and memory only, no result depends on them).
WORDS_KEPT, LONG_WORD = 200_000, 64
#: Words encoded in a row.
ROW_WORDS = 512


def build(model_path: str):
    """The tokenizer of a SentencePiece model file."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    m = read_model(model_path)
    if any(kind not in (NORMAL, UNKNOWN, CONTROL, BYTE) for _, _, kind in m.pieces) or m.whitespace_suffix or not m.escape_whitespaces:
        raise ValueError("user-defined or unused pieces and spaces behind words aren't supported")
    if m.model_type == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        known = {p: s for p, s, kind in m.pieces if kind == NORMAL}
        pairs = ((-s, i, p[:k], p[k:]) for i, (p, s, kind) in enumerate(m.pieces) if kind == NORMAL for k in range(1, len(p)) if p[:k] in known and p[k:] in known)
        merges = [(a, b) for _, _, a, b in sorted(pairs)]
        tok = Tokenizer(models.BPE(vocab, merges, unk_token=m.pieces[m.unk_id][0], fuse_unk=not m.byte_fallback, byte_fallback=m.byte_fallback))
    else:
        tok = Tokenizer(models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=m.unk_id, byte_fallback=m.byte_fallback))
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(SPACE)] if m.add_dummy_prefix else []
    tok.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
    if not any(SPACE in p.lstrip(SPACE) for p, _, kind in m.pieces if kind == NORMAL):  # then words with the spaces before them encode alone, and repeated ones come from a cache
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}*[^{SPACE}]+|{SPACE}+"), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] if m.add_dummy_prefix else []
    tok.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse(), decoders.Replace(SPACE, " "), *tail])
    return tok


#: A word's ids as 32-bit integers or as decimal numbers each after a comma, its decoded text, whether both libraries agree.
Word = tuple[bytes | str, str, bool]


def by_words(m: PieceModel) -> bool:
    """Whether a text's ids are those of its words in a row."""
    return m.model_type == BPE and not m.charsmap and not m.remove_extra_whitespaces and m.add_dummy_prefix and not any(SPACE in p.lstrip(SPACE) for p, _, kind in m.pieces if kind == NORMAL)


class Codec:
    """Both libraries for one model file; ids are given as decimal numbers, or ``raw`` as 32-bit integers."""

    def __init__(self, model_path: str, raw: bool = True):
        import sentencepiece

        self.raw = raw
        self.tok, self.truth = build(model_path), sentencepiece.SentencePieceProcessor(model_file=model_path)
        m = read_model(model_path)
        self.by_words = by_words(m)
        self.begins = np.array([p.startswith(SPACE) for p, _, _ in m.pieces])
        self.number = [f",{i}" for i in range(len(m.pieces))]
        self.digits = np.array([len(x) for x in self.number])
        self.row_tok = build(model_path)
        self.row_tok.pre_tokenizer = None  # a row's words differ, so none would come from its cache
        self.words: dict[str, bytes | str] = {}  # ids of words on which both libraries agree and that decode to themselves
        self.odd: dict[str, Word] = {}  # other words

    def whole(self, texts: list[str], tok=None) -> list[tuple[list[int], str, bool]]:
        """(ids, decoded text, parity) of each text, compared as a whole."""
        tok = tok or self.tok
        out: list[tuple[list[int], str, bool]] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH_CHARS):
                size += len(texts[end])
                end += 1
            part = texts[at:end]
            ids = [e.ids for e in tok.encode_batch_fast(part, add_special_tokens=False)]
            want = self.truth.encode(part, num_threads=1)
            decoded = tok.decode_batch(want, skip_special_tokens=False)
            out += [(w, d, g == w) for g, w, d in zip(ids, want, decoded, strict=True)]
            at = end
        return out

    @staticmethod
    def split(text: str) -> list[str]:
        """A text's words, each without the one space (the first word's is the model's own) before it; further spaces stay in front."""
        text = text.replace(SPACE, " ")
        if not text:
            return []
        return text.split(" ") if "  " not in text and text[0] != " " else [w[1:] for w in re.findall(" +[^ ]*", " " + text)]

    def coded(self, ids: list[int]) -> bytes | str:
        return np.array(ids, np.int32).tobytes() if self.raw else "".join(map(self.number.__getitem__, ids))

    def learn(self, words: set[str]) -> None:
        """Remembers ``words``."""
        if len(self.words) + len(self.odd) > WORDS_KEPT:
            self.forget()
        new = words.difference(self.words, self.odd)
        if "" in new:  # the space mark alone, which neither library gives for an empty text
            new.remove("")
            i = self.truth.piece_to_id(SPACE)
            self.keep("", self.coded([i]), "", self.tok.token_to_id(SPACE) == i)
        plain, alone = [], []
        for w in new:
            (plain if len(w) <= LONG_WORD and w[0] != " " else alone).append(w)
        for at in range(0, len(plain), ROW_WORDS):
            alone += self.learn_row(plain[at : at + ROW_WORDS])
        for w, (ids, text, same) in zip(alone, self.whole(alone), strict=True):
            self.keep(w, self.coded(ids), text, same)

    def keep(self, word: str, ids: bytes | str, text: str, same: bool) -> None:
        if same and text == word and len(word) <= LONG_WORD:
            self.words[word] = ids
        else:
            self.odd[word] = ids, text, same

    def forget(self) -> None:
        self.words.clear()
        self.odd.clear()

    def learn_row(self, row: list[str]) -> list[str]:
        """Words in a row, encoded, compared and decoded as one text and cut where pieces with a space mark begin; all are given back where the libraries differ or the cuts don't fit."""
        ((ids, text, same),) = self.whole([" ".join(row)], self.row_tok)
        flat = np.array(ids, np.int32)
        begin = np.flatnonzero(self.begins[flat])
        texts = text.split(" ")
        if not same or len(begin) != len(row) or len(texts) != len(row):
            return row
        begin = np.append(begin, len(ids))
        if self.raw:
            joined, cuts = flat.tobytes(), (4 * begin).tolist()
        else:
            joined, cuts = self.coded(ids), np.concatenate([[0], np.cumsum(self.digits[flat])])[begin].tolist()
        parts = [joined[i:j] for i, j in pairwise(cuts)]
        if texts == row:
            self.words.update(zip(row, parts))
        else:
            for w, x, t in zip(row, parts, texts, strict=True):
                self.keep(w, x, t, True)
        return []

    def encode_decode(self, texts: list[str]) -> Iterator[tuple[bytes | str, int, str, bool]]:
        """(ids, how many, decoded text, parity) of each text, numbers joined by commas; a null or empty text has no ids."""

        def told(ids: bytes | str, text: str, same: bool) -> tuple[bytes | str, int, str, bool]:
            return (ids, len(ids) // 4, text, same) if self.raw else (ids[1:], ids.count(","), text, same)

        if not self.by_words:
            yield from (told(self.coded(ids), text, same) for ids, text, same in self.whole(texts))
            return
        parts = list(map(self.split, texts))
        self.learn(set().union(*parts))
        known, nothing = self.words.__getitem__, b"" if self.raw else ""
        for text, words in zip(texts, parts, strict=True):
            if self.odd.keys().isdisjoint(words):
                yield told(nothing.join(map(known, words)), " ".join(words), True)
                continue
            found = [self.odd[w] if w in self.odd else (known(w), w, True) for w in words]
            if all(same for _, _, same in found):
                yield told(nothing.join([x for x, _, _ in found]), " ".join([t for _, t, _ in found]), True)
            else:
                ((ids, decoded, same),) = self.whole([text])
                yield told(self.coded(ids), decoded, same)
        for w in [w for w in self.odd if len(w) > LONG_WORD]:  # long ones aren't remembered
            del self.odd[w]


@lru_cache(2)
def codec(model_path: str, raw: bool = True) -> Codec:
    return Codec(model_path, raw)


def encode_decode(texts: list[str], model_path: str) -> list[tuple[list[int], str, bool]]:
    """(ids, decoded text, parity) of each text."""
    return [(np.frombuffer(ids, np.int32).tolist(), text, same) for ids, _, text, same in codec(model_path).encode_decode(texts)]


def sentencepiece_codec(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", threads: int = 2, ids: bool = True) -> DataFrame:
    """``(id, n_tokens, token_ids, decoded, round_trip, parity)`` of every row, without a shuffle.

    Null text is encoded as empty: no ids, decoded to "", round trip true. Rows
    that repeat come each; other columns are left out. A text of any length is one
    row's work: its words in turn, a word without spaces in one call. With
    ``ids=False`` the ids and the decoded text come as SHA-256 digests only:
    ``ids_sha256`` (of the ids as decimal numbers joined by commas), ``decoded_sha256``.
    """
    base = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    names = ["n_tokens", *(["token_ids", "decoded"] if ids else ["ids_sha256", "decoded_sha256"]), "round_trip", "parity"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                texts = b.column(1).to_pylist()
                coded, n, decoded, same = zip(*codec(model_path, ids).encode_decode(texts))
                cols = [b.column(0), pa.array(n, pa.int64())]
                if ids:
                    flat = pa.Array.from_buffers(pa.int32(), sum(n), [None, pa.py_buffer(b"".join(coded))])
                    cols += [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), flat), pa.array(decoded, pa.string())]
                else:
                    cols += [pa.array([sha256(x.encode()).hexdigest() for x in coded]), pa.array([sha256(x.encode()).hexdigest() for x in decoded])]
                cols += [pa.array([d == t for d, t in zip(decoded, texts, strict=True)]), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, *names])
        codec(model_path, ids).forget()  # an idle worker holds no words

    own = "token_ids array<int>, decoded string" if ids else "ids_sha256 string, decoded_sha256 string"
    return base.mapInArrow(code, with_id(docs, id_col, f"n_tokens bigint, {own}, round_trip boolean, parity boolean"))
