"""Exact subword token counts by rank-synchronous array merging.

A SentencePiece BPE model is read once per Python worker. Text is cut into chunks that no vocabulary piece
can span, and the chunks not met before are merged together: their symbols lie in one ragged numpy array,
and each step merges the lowest-ranked pair of every chunk at once. Surviving symbols are counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NEVER = np.iinfo(np.int64).max
#: Chunks kept per Python worker before its memory of counts starts afresh, and the longest chunk that is kept.
CACHE_CHUNKS, CACHE_CHARS = 1_000_000, 48
_COUNTERS: dict[str, "PieceCounter"] = {}


class PieceCounter:
    """Counts the tokens that a SentencePiece BPE model with byte fallback gives a text, without special tokens."""

    def __init__(self, model_file: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        kinds = pb.ModelProto.SentencePiece.Type
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("a model with the identity normaliser is needed")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces aren't supported")
        self.dummy = SPACE if spec.add_dummy_prefix else ""
        score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in score):
            raise ValueError("a piece spans a word boundary")
        order = sorted(score, key=lambda p: -score[p])
        ids = {p: i for i, p in enumerate(order)}
        chars = sorted({c for p in order for c in p} | {"\n"})
        for c in chars:
            ids.setdefault(c, len(ids))
        self.n = len(ids)
        #: Tokens that a surviving symbol stands for: 1, or its bytes if it is no piece.
        self.weight = np.ones(self.n, np.int64)
        for c in chars:
            if c not in score:
                self.weight[ids[c]] = len(c.encode())
        self.char_id = np.full(0x110000, -1, np.int32)
        self.char_id[[ord(c) for c in chars]] = [ids[c] for c in chars]
        rank = {p: i for i, p in enumerate(order)}
        keys, made, unsafe = [], [], set()
        for p in order:
            for k in range(1, len(p)):
                x, y = ids.get(p[:k]), ids.get(p[k:])
                if x is not None and y is not None:
                    keys.append(x * self.n + y)
                    made.append(ids[p])
                    unsafe |= {i for i, s in ((x, p[:k]), (y, p[k:])) if s in rank and rank[s] > rank[p]}
        keys, made = np.array(keys, np.int64), np.array(made, np.int64)
        by = np.argsort(keys)
        self.keys, self.made = keys[by], made[by]
        #: Pieces after whose making a better-ranked pair can arise: these are merged one at a time.
        self.unsafe = np.zeros(self.n, bool)
        self.unsafe[list(unsafe)] = True
        self.newline_splits = not any("\n" in p for p in order if len(p) > 1)
        self.bare: dict[str, int] = {}
        self.spaced: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes (its rank too, as ids of pieces follow their rank), or NEVER."""
        key = np.where((left < 0) | (right < 0), -1, left.astype(np.int64) * self.n + right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], NEVER)

    def merge(self, chunks: list[str]) -> np.ndarray:
        """Tokens of each chunk."""
        total = np.zeros(len(chunks), np.int64)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        code = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(len(chunks)), sizes)
        sym = self.char_id[code].astype(np.int64)
        strange = sym < 0
        if strange.any():  # characters of no piece never merge; each is its bytes
            c = code[strange]
            np.add.at(total, owner[strange], 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF).astype(np.int64))
        r = np.full(len(sym), NEVER, np.int64)
        if len(sym) > 1:
            inside = owner[:-1] == owner[1:]
            r[:-1] = np.where(inside, self.ranks(sym[:-1], sym[1:]), NEVER)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(r, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            live = np.repeat(best < NEVER, sizes)
            if not live.all():
                done = ~live & (sym >= 0)
                np.add.at(total, owner[done], self.weight[sym[done]])
                sym, owner, r = sym[live], owner[live], r[live]
                if not len(sym):
                    break
                sizes, best = sizes[best < NEVER], best[best < NEVER]
            at = np.flatnonzero(r == np.repeat(best, sizes))
            fresh = np.r_[True, (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])]
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            take = run % 2 == 0  # of overlapping pairs of one rank, the leftmost goes first
            risky = self.unsafe[r[at]]
            if risky.any():
                first = np.r_[True, owner[at[1:]] != owner[at[:-1]]]
                take &= ~risky | first
            at = at[take]
            sym[at] = r[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))
            sym, owner, r = sym[keep], owner[keep], r[keep]
            stale = np.unique(np.r_[at, at[at > 0] - 1])
            nxt = np.minimum(stale + 1, len(sym) - 1)
            same = (stale + 1 < len(sym)) & (owner[stale] == owner[nxt])
            r[stale] = np.where(same, self.ranks(sym[stale], sym[nxt]), NEVER)
        return total

    def chunks(self, text: str) -> tuple[list[str], list[str], int]:
        """Words without and with one space mark before them (given without it), and tokens counted already."""
        bare, spaced, extra = [], [], 0
        lines = (self.dummy + text).replace(" ", SPACE)
        lines = lines.split("\n") if self.newline_splits else [lines]
        extra += (len(lines) - 1) * int(self.weight[self.char_id[10]])
        for line in lines:
            if SPACE * 2 in line or line.endswith(SPACE):
                bare += re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", line)
            elif line:
                head, *rest = line.split(SPACE)
                spaced += rest
                if head:
                    bare.append(head)
        return bare, spaced, extra

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        parts = [self.chunks(t) if t else ([], [], 0) for t in texts]
        if len(self.bare) + len(self.spaced) > CACHE_CHUNKS:
            self.bare, self.spaced = {}, {}
        long: dict[str, int] = {}
        for known, mark, k in ((self.bare, "", 0), (self.spaced, SPACE, 1)):
            fresh = list({w for p in parts for w in p[k] if w not in known})
            for i in range(0, len(fresh), 50_000):
                some = fresh[i : i + 50_000]
                got = self.merge([mark + w for w in some]).tolist()
                for w, c in zip(some, got, strict=True):
                    if len(w) <= CACHE_CHARS:
                        known[w] = c
                    else:
                        long[mark + w] = c
        for i, (bare, spaced, extra) in enumerate(parts):
            n = extra
            for known, mark, words in ((self.bare, "", bare), (self.spaced, SPACE, spaced)):
                try:
                    n += sum(map(known.__getitem__, words))
                except KeyError:
                    n += sum(known[w] if w in known else long[mark + w] for w in words)
            out[i] = n
        return out


def counter(model_file: str) -> PieceCounter:
    """The worker's counter for a model, read once."""
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = PieceCounter(model_file)
    return _COUNTERS[model_file]


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of docs; other columns are ignored.

    Null text counts as empty: 0 bytes, 0 tokens. Repeated rows give repeated results and null ids stay null.
    ``model_file`` must be readable at that path on every executor. A row-wise map: no shuffle, memory bounded by
    one slice of an Arrow batch and the worker's bounded memory of chunks.
    """

    def per_batch(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(model_file)
        for texts in batches:
            got, some, size = [], [], 0
            for t in texts:
                some.append(t or "")
                size += len(some[-1])
                if size > 4_000_000:
                    got.append(c.count(some))
                    some, size = [], 0
            got.append(c.count(some))
            yield pd.Series(np.concatenate(got))

    tokens = F.pandas_udf(per_batch, "long")
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
