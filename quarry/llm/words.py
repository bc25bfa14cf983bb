"""Ids from a ``tokenizers`` file, piece by piece, with memos of words and pieces.

For files whose pipeline is NFC, white space to one space, lower case, one pattern whose matches are kept, byte
mapping, BPE (checked when the file is loaded), no match crosses white space. So a text's ids are its words' ids in
order, and a word's are those of its matches, each distinct one encoded by the library's model. Special tokens
spelled in a text are recognised as the library does: such a word goes to the library whole. Any other pipeline gets
whole texts.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from quarry.llm.common import Known, distinct_words, gathered, resident

#: Words and pieces that a worker's memos hold at most, and bytes of text that are encoded together.
WORDS, PIECES, RUN = 600_000, 300_000, 2 << 20


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or 256 and up in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Words:
    """Encodes texts to ids."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        layout = json.loads(self.tokenizer.to_str())
        kinds = [n["type"] for n in (layout["normalizer"] or {}).get("normalizers", [])]
        splits = (layout["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_word = (
            kinds == ["NFC", "Replace", "Lowercase"]
            and layout["normalizer"]["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
            and [s["type"] for s in splits] == ["Split", "ByteLevel"]
            and (splits[0]["behavior"], splits[0]["invert"]) == ("Removed", True)
            and not (splits[1]["add_prefix_space"] or splits[1]["use_regex"])
        )
        if self.by_word:
            pattern = splits[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
            self.match = regex.compile(rf"(?:{pattern})|\n")
        letters = byte_letters()
        self.letters = np.array([ord(letters[b]) if b != 10 else 10 for b in range(256)], "<u4")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in layout["added_tokens"]) or r"(?!)")
        self.model = Tokenizer(self.tokenizer.model)
        suffix, vocabulary = layout["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if suffix and all(x + suffix in vocabulary for x in letters.values()):  # then each match's last id is such a token's
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.pieces = Known(None, PIECES, self._pieces)
        self.words = Known(None, WORDS, self._words)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of matches by the library's model alone."""
        odd = [i for i, p in enumerate(pieces) if not (p.isascii() and p.isprintable())]
        if odd:
            joined = np.frombuffer("\n".join(pieces[i] for i in odd).encode(), np.uint8)
            for i, p in zip(odd, self.letters[joined].tobytes().decode("utf-32-le").split("\n")):
                pieces[i] = p
        if not pieces:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        (found,) = self.model.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, np.uint32)
        last = np.flatnonzero(self.ends[ids])
        if len(last) == len(pieces):
            return ids, np.diff(last, prepend=-1)
        found = self.model.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        return np.array(found.ids, np.uint32), np.bincount(np.array(found.word_ids, np.int64), minlength=len(pieces))

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words: all are normalised and cut into matches as one text, a line each."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        whole = {i: self._whole(w) for i, w in enumerate(words) if "|" in w and self.special.search(w)}
        low = "\n".join("" if i in whole else w for i, w in enumerate(words)) if whole else "\n".join(words)
        if not low.isascii():
            low = unicodedata.normalize("NFC", low).replace("Σ", "σ")
        index, pieces = distinct_words(pa.array(self.match.findall(low.lower()), pa.string()))
        line = pieces.index("\n") if len(words) > 1 else len(pieces)
        flat, starts, lens = self.pieces.find(pieces[:line] + pieces[line + 1 :])
        starts, lens = np.insert(starts, line, 0), np.insert(lens, line, 0)  # a line's end has no ids
        ids, ends = gathered(index, flat, starts, lens, np.concatenate([[0], np.flatnonzero(index == line), [len(index)]]))
        sizes = np.diff(ends)
        if whole:
            rows, values = list(whole), list(whole.values())
            sizes[rows] = list(map(len, values))
            ids = np.insert(ids, np.repeat(ends[rows], sizes[rows]), [x for v in values for x in v])
        return ids, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an array of texts (null counts as empty), and where each text begins and the last ends."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            each = [np.array(self._whole(t), "<u4") for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, "<u4"), *each]), np.cumsum([0, *map(len, each)])
        split = pc.ascii_split_whitespace(texts)
        offsets = split.offsets.to_numpy()
        index, distinct = distinct_words(split.values.slice(offsets[0], offsets[-1] - offsets[0]))
        return gathered(index, *self.words.find(distinct), offsets - offsets[0])

    def encode_batches(self, texts: pa.Array, most: int = RUN):
        """(first row, ids, offsets) of runs of rows of about ``most`` bytes: memory stays bounded for long texts."""
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        run = (np.cumsum(size) - size) // most
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
        for a, z in zip(cuts, cuts[1:]):
            if z > a:
                yield (a, *self.encode(texts.slice(a, z - a)))


def key(path: str) -> tuple[str, str]:
    """What :func:`words` keeps it under."""
    return "words", path


def words(path: str) -> Words:
    """One per worker process."""
    return resident(key(path), lambda: Words(path))
