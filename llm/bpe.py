"""Byte-level BPE by replaying the merges over many words at once."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import ref

#: White space as the Unicode property has it; the pattern's ``\s`` must not follow another definition.
_SPACE = r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_UNSAFE_CUT = re.compile(f"[{_SPACE}] ")
_PIECE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: Entries a worker keeps of pieces and of words; a full memory is emptied and filled again.
KEPT = 400_000
#: Characters of the longest word that is kept; longer ones are encoded whenever they come.
_REMEMBERED = 64
_NEVER = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class MergeReplay:
    """Encodes byte strings by the ranks of a vocabulary.

    All words are laid out as one sequence of tokens with links to the neighbours inside the word. An inverted index keeps,
    for each merge, the positions whose token and successor make it. Merges are applied from the lowest rank up, each at all
    its positions at once; only the neighbours of merged positions are looked up again and enter the index. Where a merge
    makes a pair of a lower rank, the rest of that word waits until the lower rank has been applied, so each word goes
    through the merges in the order in which it would alone.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens: dict[int, bytes] = {v: k for k, v in ranks.items()}
        single = [ranks.get(bytes([b]), -1) for b in range(256)]
        if min(single) < 0:
            raise ValueError("The vocabulary must hold all 256 single bytes.")
        pairs: dict[int, int] = {}
        for whole, rank in ranks.items():
            for cut in range(1, len(whole)):
                a, b = ranks.get(whole[:cut]), ranks.get(whole[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = sorted(pairs)
        self._pairs = np.array([*keys, _NEVER << 20], dtype=np.int64)
        self._ranks = np.array([*(pairs[k] for k in keys), _NEVER], dtype=np.int64)
        self._bytes = np.array(single, dtype=np.int64)

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, _NEVER for none. A negative token, the end of a word, merges with nothing."""
        keys = a << 32 | b
        at = np.searchsorted(self._pairs, keys)
        return np.where(self._pairs[at] == keys, self._ranks[at], _NEVER)

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        joined = np.frombuffer(b"\0".join(words) + b"\0", dtype=np.uint8)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        ends = np.cumsum(size) - 1
        token = self._bytes[joined]
        token[ends] = -1
        word = np.repeat(np.arange(len(words)), size)
        self._merge_all(token, word)
        kept = token >= 0
        flat = token[kept].astype("<u4").tobytes()
        stops = (np.cumsum(kept)[ends] * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def _merge_all(self, token: np.ndarray, word: np.ndarray) -> None:
        """Applies all merges in place. Tokens that were merged into the one before them become -2."""
        count = len(token)
        after, before = np.arange(1, count + 1), np.arange(-1, count - 1)
        after[-1] = count - 1
        rank_at = np.full(count, _NEVER)
        rank_at[:-1] = self._look_up(token[:-1], token[1:])
        index: dict[int, list[np.ndarray]] = {}
        todo: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            """Adds positions to the index, under the merges they make."""
            if len(places) == 1:
                groups = [(int(ranks[0]), places)]
            else:
                order = np.argsort(ranks, kind="stable")
                ranks, places = ranks[order], places[order]
                cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                starts = [0, *cuts.tolist(), len(ranks)]
                groups = [(rank, places[a:b]) for rank, a, b in zip(ranks[starts[:-1]].tolist(), starts, starts[1:], strict=False)]
            for rank, some in groups:
                if rank in index:
                    index[rank].append(some)
                else:
                    index[rank] = [some]
                    heapq.heappush(todo, rank)

        first = np.flatnonzero(rank_at < _NEVER)
        if len(first):
            enter(first, rank_at[first])
        while todo:
            rank = heapq.heappop(todo)
            found = index.pop(rank)
            places = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            places = places[rank_at[places] == rank]
            if not len(places):
                continue
            if len(places) > 1:
                every, places = places, self._apart(places, after)
                waits = self._waiting(rank, places, token, word, after, before)
                if waits is not None:  # with them wait the pairs that overlap theirs
                    places = places[~waits]
                    rest = np.setdiff1d(every, places, assume_unique=True)
                    if len(rest):
                        enter(rest, np.full(len(rest), rank))
            right = after[places]
            follow = after[right]
            token[places] = rank
            token[right] = -2
            rank_at[right] = _NEVER
            after[places] = follow
            before[follow] = places
            left = before[places]
            touched = np.unique(np.concatenate([places, left[left >= 0]]))
            touched = touched[token[touched] >= 0]
            now = self._look_up(token[touched], token[after[touched]])
            rank_at[touched] = now
            good = now < _NEVER
            if good.any():
                enter(touched[good], now[good])

    @staticmethod
    def _apart(places: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of positions whose pairs overlap, every second one, from the left."""
        follows = np.r_[False, after[places[:-1]] == places[1:]]
        if not follows.any():
            return places
        here = np.arange(len(places))
        start = np.maximum.accumulate(np.where(follows, 0, here))
        return places[(here - start) % 2 == 0]

    def _waiting(
        self, rank: int, places: np.ndarray, token: np.ndarray, word: np.ndarray, after: np.ndarray, before: np.ndarray
    ) -> np.ndarray | None:
        """Which positions must wait because a merge before them in their word makes a pair of a lower rank; None if none must."""
        of = word[places]
        again = of[1:] == of[:-1]
        if not again.any():
            return None
        follow = after[after[places]]
        ahead = before[places]
        behind = np.r_[False, follow[:-1] == places[1:]]  # what stands before was merged just now
        left = np.where(behind, rank, token[np.maximum(ahead, 0)])
        left[ahead < 0] = -1
        same = np.full(len(places), rank)
        lower = (self._look_up(same, token[follow]) < rank) | (self._look_up(left, same) < rank)
        if not lower.any():
            return None
        new = np.r_[True, ~again]
        seen = np.cumsum(lower) - lower  # lower pairs made by the positions before, and of those the ones in the same word
        return seen - seen[np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))] > 0


class Encoder:
    """Texts to token ids, packed as little-endian unsigned 32-bit integers.

    A text is cut before each white-space run; no match of the pattern crosses such a cut, so a piece has
    the same ids wherever it stands. Pieces and words met before are remembered up to ``KEPT`` entries; the new words of
    a whole batch go through the merges together.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.replay = MergeReplay(ranks)
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]"))
        self.pieces: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    @staticmethod
    def cut(text: str) -> list[str]:
        if _UNSAFE_CUT.search(text):
            return _PIECE.findall(text)
        head, *more = text.split(" ")
        return [head, *[f" {x}" for x in more]] if head else [f" {x}" for x in more]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        cuts = [self.cut(t) if t else [] for t in texts]
        if len(self.pieces) > KEPT:
            self.pieces.clear()
        fresh = {p for cut in cuts for p in cut if p not in self.pieces}
        own: dict[str, bytes] = self.pieces if len(fresh) <= KEPT else {}
        if own is not self.pieces:
            fresh = {p for cut in cuts for p in cut}
        split = {p: self.pattern.findall(p) for p in fresh}
        if len(self.known) > KEPT:
            self.known.clear()
        new = list({w for words in split.values() for w in words if w not in self.known})
        found = dict(zip(new, self.replay.words([w.encode() for w in new]), strict=True))
        for piece, words in split.items():
            own[piece] = b"".join([found[w] if w in found else self.known[w] for w in words])
        self.known.update((w, i) for w, i in found.items() if len(w) <= _REMEMBERED)
        for cut in cuts:
            yield b"".join(map(own.__getitem__, cut))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.replay.tokens.__getitem__, memoryview(packed).cast("I").tolist() if packed else ()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One per worker process and vocabulary."""
    return Encoder(read_ranks(path), pattern)


#: Characters whose new words go through the merges together.
_TOGETHER = 4_000_000


def _groups(texts: pa.Array) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        value = text.as_py() or ""
        group.append(value)
        size += len(value)
        if size >= _TOGETHER:
            yield group
            group, size = [], 0
    if group:
        yield group


def bpe_codes(text: Column, path: str, pattern: str, with_ids: bool = False) -> Column:
    """A struct of n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int)."""

    kind = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def codes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = encoder(path, pattern)
        for batch in batches:
            rows: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            packed: list[bytes] = []
            for group in _groups(batch):
                for ids in bpe.encode(group):
                    rows["n_tokens"].append(len(ids) // 4)
                    rows["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                    rows["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                    if with_ids:
                        packed.append(ids)
            columns = [pa.array(rows["n_tokens"], pa.int64()), pa.array(rows["ids_sha256"], pa.string()), pa.array(rows["decoded_sha256"], pa.string())]
            names = [*rows]
            if with_ids:
                flat = pa.Array.from_buffers(pa.int32(), sum(map(len, packed)) // 4, [None, pa.py_buffer(b"".join(packed))])
                ends = [0]
                for ids in packed:
                    ends.append(ends[-1] + len(ids) // 4)
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
                names.append("ids")
            yield pa.StructArray.from_arrays(columns, names)

    codes.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(codes, kind)(text)


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """Encodes every whole text and decodes the ids again: one row per input row with the id, n_tokens, the digests of the
    ids (little-endian unsigned 32-bit) and of the decoded bytes, and the ids themselves.

    Each match of the pattern is encoded separately; special tokens are ordinary text. A null text counts as empty: no ids.
    Repeated rows stay repeated, an empty table gives an empty one, other columns are not looked at. Texts
    must be valid UTF-8, as Spark's strings are.

    ``path`` is the vocabulary's file and must be readable by each worker, as an installed package's data are. Everything
    is done where the text is: nothing is shuffled. The inverted index covers the distinct new words of a few megabytes of text at a
    time, so all merges of all words go through it, and a worker's memory is bounded. (One index for all words of all texts
    would have to send each word's ids back to every text that holds it, a shuffle larger than the texts.)
    """
    code = "__code"
    out = docs.select(ref(id_col).alias(id_col), bpe_codes(ref(text_col).cast("string"), path, pattern, with_ids).alias(code))
    return out.select(ref(id_col), *[F.col(code)[f].alias(f) for f in ("n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] * with_ids))])


def decode_ids(ids: Iterable[int], path: str) -> bytes:
    tokens = {v: k for k, v in read_ranks(path).items()}
    return b"".join(tokens[i] for i in ids)
