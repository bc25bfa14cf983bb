"""Byte-level BPE with exact merges in linear time, for rank files in the tiktoken format.

Token bytes are mapped to Latin-1 text so that one Aho-Corasick automaton (pyahocorasick) finds every token that
starts at every position. A piece is then encoded from its longest matches, left to right: a token is accepted
when the merge order would really leave it beside the token before it, else the next shorter token that starts
there is tried, and when none is left the last accepted token is given back. Whether two tokens may stand side by
side depends on those two alone and is memoised, so each position is visited a bounded number of times.

Cases: null or empty text has no ids; bytes outside the vocabulary raise KeyError; decoding joins token bytes, so
it returns the text's UTF-8 exactly. Special tokens are not recognised: their spelling is ordinary text.
Repeated rows are encoded each; very long texts are encoded whole, each in a run of its own; an empty table gives no
rows; only the key and the text are read, so other columns' names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from quarry.llm.common import Known, Memo, distinct_words, gathered, map_arrow, resident

#: Words, and entries of each other memo, that a worker holds at most.
WORDS, MEMO = 600_000, 150_000

#: A space beside other white space: there the pattern's matches can cross a single space.
CROSSING = re.compile(r"  |[^\S ] (?:\s|\Z)| [^\S ]")


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        import ahocorasick

        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes = {r: t for t, r in self.rank.items()}
        self.pair, self.parts = self._merges()
        self.automaton = ahocorasick.Automaton()
        for token, r in self.rank.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), r))
        self.automaton.make_automaton()
        self.shorter = Memo(self._shorter)
        self.fits = Memo(self._fits)
        self.pieces = Memo(lambda piece: self.encode_piece(piece.encode()))
        self.spaced = Known(lambda word: self._split(" " + word), WORDS)
        # the pattern's white space is Unicode's, without the four separators that Python adds
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))

    def _merges(self) -> tuple[dict[tuple[int, int], int], dict[int, tuple[int, int]]]:
        """For each token the two that merge into it, and the reverse."""
        pair: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int]] = {}
        for token, r in sorted(self.rank.items(), key=lambda x: x[1]):
            ids = [self.rank[token[i : i + 1]] for i in range(len(token))]
            while len(ids) > 2:
                best, at = min(((pair.get((ids[i], ids[i + 1]), r), i) for i in range(len(ids) - 1)), default=(r, 0))
                if best >= r:
                    break
                ids[at : at + 2] = [best]
            if len(ids) == 2:
                pair[ids[0], ids[1]] = r
                parts[r] = (ids[0], ids[1])
        return pair, parts

    def _shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of ``token``."""
        b = self.bytes[token]
        return next((self.rank[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.rank), None)

    def _fits(self, key: tuple[int, int]) -> bool:
        """Whether merging in rank order leaves these two tokens side by side."""
        left, right = key
        ceiling = 1 << 62  # merges across the border from here on come too late
        while True:
            if self.pair.get((left, right), ceiling) < ceiling:
                return False
            # undo the later of the two merges that face the border
            undo_left = left in self.parts and (left > right or right not in self.parts)
            if undo_left:
                ceiling, left = left, self.parts[left][1]
            elif right in self.parts:
                ceiling, right = right + 1, self.parts[right][0]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        longest: list[int | None] = [None] * (len(piece) + 1)
        for end, (size, token) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = token  # ends only grow, so the last one written is the longest
        open_at = bytearray(b"\1") * (len(piece) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(piece):
            last = out[-1] if out else None
            while token is not None:
                end = at + len(self.bytes[token])
                if open_at[end] and (last is None or self.fits[last, token]):
                    break
                token = self.shorter[token]
            if token is not None:
                out.append(token)
                at, token = end, longest[end]
            elif out:
                open_at[at] = 0
                at -= len(self.bytes[out.pop()])
                token = last
            else:
                raise KeyError("no sequence of tokens spells this piece")
        return out

    def _split(self, text: str) -> list[int]:
        return [x for m in self.pattern.findall(text) for x in self.pieces[m]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an array of texts (null counts as empty), and where each text begins and the last ends.

        No match of the pattern crosses a space that stands between other characters, so the words between such
        spaces are encoded once each; texts with a space beside other white space are split by the pattern whole.
        """
        for memo in (self.pieces, self.fits):
            memo.bounded(MEMO)
        texts = pc.fill_null(texts, "")
        plain = texts.to_numpy(zero_copy_only=False).tolist()
        crossing = [bool(CROSSING.search(t)) for t in plain]
        split = pc.split_pattern(pc.if_else(pa.array(crossing, pa.bool_()), "", texts), " ")
        offsets = split.offsets.to_numpy()
        index, distinct = distinct_words(split.values.slice(offsets[0], offsets[-1] - offsets[0]))
        offsets = (offsets - offsets[0]).astype(np.int64)
        flat, starts, lens = self.spaced.find(distinct)
        index = index.astype(np.int64)
        index[offsets[:-1]] = len(distinct) + np.arange(len(plain))  # the first word of a text follows no space
        firsts = [np.array(self._split(t if c else t.partition(" ")[0]), "<u4") for t, c in zip(plain, crossing)]
        more = np.fromiter(map(len, firsts), np.int64, len(firsts))
        begun = len(flat) + np.cumsum(more) - more
        return gathered(index, np.concatenate([flat, *firsts]), np.concatenate([starts, begun]), np.concatenate([lens, more]), offsets)

    def encode_text(self, text: str) -> list[int]:
        """Ids of one text."""
        return self.encode(pa.array([text], pa.string()))[0].tolist()

    def runs(self, texts: pa.Array, most: int = 2 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """:meth:`encode` over runs of rows of about ``most`` bytes: memory stays bounded for long texts."""
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        run = (np.cumsum(size) - size) // most
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
        for a, z in zip(cuts, cuts[1:]):
            if z > a:
                yield self.encode(texts.slice(a, z - a))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


def key_of(path: str, pattern: str) -> tuple[str, str, str]:
    """What :func:`codec` keeps it under."""
    return "bpe", path, pattern


def codec(path: str, pattern: str) -> Codec:
    """One per worker process."""
    return resident(key_of(path, pattern), lambda: Codec(path, pattern))


def encoded(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (array of int) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            at = 0
            for flat, offsets in c.runs(batch.column(1)):
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(flat.astype(np.int32)))], [key, "ids"])
                at += n

    return map_arrow(docs.select(key, text), run, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>", key_of(path, pattern))


def decoded(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``data`` (binary) of each row's ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            data = [None if x is None else c.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], [key, "data"])

    return map_arrow(df.select(key, ids), run, f"{key} {df.schema[key].dataType.simpleString()}, data binary", key_of(path, pattern))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: number of ids, and SHA-256 of the ids and of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            n, a, b = [], [], []
            for flat, offsets in c.runs(batch.column(1)):
                offsets = offsets.tolist()
                for x, y in zip(offsets, offsets[1:]):
                    n.append(y - x)
                    a.append(hashlib.sha256(flat[x:y].tobytes()).hexdigest())
                    b.append(hashlib.sha256(c.decode(flat[x:y])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", key_of(path, pattern))
