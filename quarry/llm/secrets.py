"""Secret scan: fixed patterns, and a linear-chain conditional random field that adds what they miss.

Words (between ASCII white space) are tagged as secret begin, inside or outside. A word's score comes from its shape
(length, character classes, mixing, known openings), the shapes of the words before and after it, and how much of its
text looks like code; a transition matrix joins neighbours, and Viterbi finds the best tags. The field is trained by
forward-backward on seeded synthetic lines, so it needs no pass over the data and is the same everywhere.

Most words are prose whose best tag cannot depend on the rest: where "outside" leads by more than all transitions and
the next word's begin-inside difference could undo, it is the tag in every best path (``Scanner.sure``). The Viterbi
steps run between such words only, which gives exactly the tags of the full decoding.

Pattern matches always stay; a tagged run is added whole as kind ``crf`` unless one of them holds all of it: a run that
only overlaps a match says what the match misses. Offsets are code points, ends exclusive.

Cases: null or blank text has no spans; very long texts and repeated rows are scanned whole; an empty table gives no
rows; extra columns stay, but for ``spans``, which is replaced.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm.common import Known, distinct_words, map_arrow, resident

# Fixed patterns of the base kinds; letters of the first in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORD = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
LONG_HEX = re.compile(r"[0-9a-f]{24}")
KINDS = ("assign", "access", "hex", "crf")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = re.compile(r"[^\W\d_]{1,28}[.,;!?]*")
OPENING = re.compile(r"""["'(<\[{]*(?:gh[opsu]_|github_pat_|sk[-_]|pk_|rk_|xox[abprs]-|eyJ|AIza|ya29\.|glpat-|npm_|SG\.|hf_)""")
ARMOUR = re.compile(r"-----(BEGIN|END)")
TAGS = 3  # outside, begin, inside
FEATURES = 32
MEMO = 600_000


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind in the order of ``KINDS``."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if LONG_HEX.search(text):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in map(s.count, set(s))) if s else 0.0


def shape(word: str) -> frozenset[int]:
    """Numbers of the features that a word has."""
    if PROSE.fullmatch(word) and not KEYWORD.search(word):
        return frozenset([1])
    core = word.strip("\"'`.,;:!?()[]{}<>")
    f = {2}
    n = len(core)
    f.add(3 + sum(n >= k for k in (1, 4, 8, 16, 24, 40)))  # 3 to 9
    lower, upper, digit = any(c.islower() for c in core), any(c.isupper() for c in core), any(c.isdigit() for c in core)
    switches = sum((a.isdigit() != b.isdigit()) or (a.isalpha() and b.isalpha() and a.islower() and b.isupper()) for a, b in zip(core, core[1:]))
    f |= {k for k, x in ((10, lower and digit), (11, upper and digit), (12, lower and upper and digit), (13, bool(core) and core.isdigit()), (14, not digit), (15, switches >= 4), (16, n >= 12 and _entropy(core) >= 3.2), (17, n >= 20 and _entropy(core) >= 4.0)) if x}
    f |= {k for k, x in ((18, "@" in core), (19, "://" in core or "/" in core and "." in core), (20, bool(re.fullmatch(r"[\d.:/+()-]+", core))), (21, bool(KEYWORD.search(word))), (22, bool(KEYWORD.search(word)) and bool(re.search(r"[:=].{6}", word))), (23, word[-1] in ":="), (24, word in ("=", ":", ":=", "=>")), (25, bool(OPENING.match(word)) and n >= 16), (26, bool(re.fullmatch(r"[A-Za-z0-9+/=_-]{24,}", core))), (27, bool(ARMOUR.search(word))), (28, "|" in word or word[-1] in "*#$%&!|"), (29, bool(re.fullmatch(r"[0-9a-f]{16,}", core))), (30, bool(re.match(r"AKIA[A-Z0-9]{12}", core))), (31, word[:1] in "\"'")) if x}
    return frozenset(f)


def file_feature(share: np.ndarray) -> np.ndarray:
    """A text's class by its share of words that are not prose: 0 under a tenth, 1 under a half, 2."""
    return (share >= 0.1).astype(np.int64) + (share >= 0.5)


# ---------------------------------------------------------------- training


def _synthetic(rng: random.Random) -> tuple[list[str], list[int]]:
    """One line of words and its tags."""
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "sch", "ung", "ción", "eau", "é", "ß", "ado"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda letters, a, b: "".join(rng.choice(letters) for _ in range(rng.randint(a, b)))
    hexed = lambda a, b: some("0123456789abcdef", a, b)
    key = lambda: rng.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "API_KEY", "Token", "client_secret"])
    words: list[str] = []
    tags: list[int] = []
    odd = rng.random()

    def plain(n: int) -> None:
        for _ in range(n):
            w, r = word(), rng.random()
            if odd > 0.93:
                w += rng.choice(["***", "###", "$$$", "%%%", "&&&", "!!"]) if r < 0.9 else ""
            elif odd > 0.88:
                w = w.upper() + "!!"
            elif odd > 0.84:
                w = rng.choice([w, "|"])
            elif r < 0.02:
                w = f"{word()}.{rng.randint(1, 999)}@{word()}.example.com"
            elif r < 0.04:
                w = ".".join(str(rng.randint(0, 255)) for _ in range(4))
            elif r < 0.07:
                w = rng.choice(["+1", "(555)", "555-0100", "2.0.", str(rng.randint(0, 99999)), f"{rng.randint(1990, 2030)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}"])
            elif r < 0.08:
                w = f"https://{word()}.example.org/{word()}/{rng.randint(1, 9999)}?page={rng.randint(1, 9)}"
            elif r < 0.10:
                w = rng.choice([key(), key() + ",", f"{word()}-{word()}", f"{word()}_{word()}", f"{word()}:", "=", "(" + word() + ")", "v1.2.3", "x86_64", word() + str(rng.randint(0, 99)), word().upper() + str(rng.randint(1, 9))])
            elif r < 0.2:
                w = w.capitalize() + rng.choice(["", ".", ","])
            words.append(w)
            tags.append(0)

    def secret(*ws: tuple[str, int]) -> None:
        for w, t in ws:
            words.append(w)
            tags.append(t)

    plain(rng.randint(3, 25))
    for _ in range(rng.randint(0, 2)):
        kind = rng.randint(0, 8)
        value = rng.choice([hexed(12, 40), some(alphabet, 14, 40), some(alphabet + "+/_-", 16, 44)])
        if kind == 0:
            secret((f"{key()}={value}", 1))
        elif kind == 1:
            secret((key(), 0), (rng.choice(["=", ":"]), 0), (rng.choice(['"{}"', "'{}'", "{}"]).format(value), 1))
        elif kind == 2:
            secret((key() + ":", 0), (value, 1))
        elif kind == 3:
            secret((f"AKIA{some('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 16, 16)}", 1))
        elif kind == 4:
            secret((hexed(32, 64), 1))
        elif kind == 5:
            secret((rng.choice(["ghp_", "gho_", "sk-", "sk_live_", "xoxb-", "glpat-", "hf_", "npm_"]) + some(alphabet, 20, 40), 1))
        elif kind == 6:
            secret((f"eyJ{some(alphabet, 16, 30)}.{some(alphabet, 20, 60)}.{some(alphabet + '_-', 20, 43)}", 1))
        elif kind == 7:
            secret(("-----BEGIN", 1), ("PRIVATE", 2), ("KEY-----", 2), *((some(alphabet + "+/", 64, 64), 2) for _ in range(rng.randint(1, 4))), ("-----END", 2), ("PRIVATE", 2), ("KEY-----", 2))
        else:
            secret((rng.choice(["Bearer", "Authorization:", "key", "credential"]), 0), (some(alphabet + "_-", 28, 48), 1))
        plain(rng.randint(2, 12))
    return words, tags


@lru_cache(maxsize=1)
def model(lines: int = 350, rounds: int = 120, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights learned by gradient ascent on the penalised likelihood of synthetic lines."""
    rng = random.Random(seed)
    data = [_synthetic(rng) for _ in range(lines)]
    longest = max(len(w) for w, _ in data)
    x = np.zeros((lines, longest, 3 * FEATURES + 3))
    y = np.zeros((lines, longest), np.int64)
    real = np.zeros((lines, longest), bool)
    for i, (words, tags) in enumerate(data):
        shapes = [shape(w) for w in words]
        whole = int(file_feature(np.array(np.mean([1 not in s for s in shapes]))))
        for t, s in enumerate(shapes):
            x[i, t, list(s)] = 1
            x[i, t, [FEATURES + f for f in (shapes[t - 1] if t else ())]] = 1
            x[i, t, [2 * FEATURES + f for f in (shapes[t + 1] if t + 1 < len(shapes) else ())]] = 1
            x[i, t, 3 * FEATURES + whole] = 1
        y[i, : len(tags)] = tags
        real[i, : len(tags)] = True
    n = real.sum(axis=1)
    w, trans = np.zeros((x.shape[2], TAGS)), np.zeros((TAGS, TAGS))
    allowed = np.ones((TAGS, TAGS), bool)
    allowed[0, 2] = False  # inside follows begin or inside
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)]
    rows = np.arange(lines)
    flat = x.reshape(-1, x.shape[2])
    wanted = flat.T @ (np.eye(TAGS)[y] * real[..., None]).reshape(-1, TAGS)
    seen = np.zeros((TAGS, TAGS))
    for t in range(1, longest):
        np.add.at(seen, (y[real[:, t], t - 1], y[real[:, t], t]), 1)
    for step in range(1, rounds + 1):
        emit = (flat @ w).reshape(lines, longest, TAGS)
        emit[:, 0, 2] = -30
        score = np.where(allowed, trans, -30.0)
        alpha = np.zeros((lines, longest, TAGS))
        beta = np.zeros((lines, longest, TAGS))
        alpha[:, 0] = emit[:, 0]
        for t in range(1, longest):
            alpha[:, t] = np.where(real[:, t, None], np.logaddexp.reduce(alpha[:, t - 1, :, None] + score, axis=1) + emit[:, t], alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(real[:, t + 1, None], np.logaddexp.reduce(score[None] + (emit[:, t + 1] + beta[:, t + 1])[:, None], axis=2), beta[:, t + 1])
        total = np.logaddexp.reduce(alpha[rows, n - 1], axis=1)
        node = np.exp(alpha + beta - total[:, None, None]) * real[..., None]
        edge = np.exp(alpha[:, :-1, :, None] + score + (emit[:, 1:] + beta[:, 1:])[:, :, None] - total[:, None, None, None]) * real[:, 1:, None, None]
        grads = [(wanted - flat.T @ node.reshape(-1, TAGS)) / lines - 1e-3 * w, (seen - edge.sum(axis=(0, 1))) / lines - 1e-3 * trans]
        for k, (p, g) in enumerate(zip((w, trans), grads)):
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * g
            moments[2 * k + 1] = 0.99 * moments[2 * k + 1] + 0.01 * g * g
            p += 0.12 * (moments[2 * k] / (1 - 0.9**step)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
    return {"word": w[:FEATURES], "before": w[FEATURES : 2 * FEATURES], "after": w[2 * FEATURES : 3 * FEATURES], "file": w[3 * FEATURES :], "trans": np.where(allowed, trans, -np.inf)}


# ---------------------------------------------------------------- decoding


def viterbi(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags of one sequence; the first cannot be inside."""
    score = emit[0] + np.array([0.0, 0.0, -np.inf])
    back = np.zeros((len(emit), TAGS), np.int64)
    for t in range(1, len(emit)):
        ways = score[:, None] + trans
        back[t] = ways.argmax(axis=0)
        score = ways.max(axis=0) + emit[t]
    tags = np.zeros(len(emit), np.int64)
    tags[-1] = int(score.argmax())
    for t in range(len(emit) - 1, 0, -1):
        tags[t - 1] = back[t, tags[t]]
    return tags


def _reach(trans: np.ndarray, befores: tuple, tags: tuple, nexts: tuple) -> float:
    """The most that transitions can lose when one word's tag (of ``tags``) becomes "outside".

    ``befores`` and ``nexts`` are its neighbours' tags, None at a text's end; a next word that was inside becomes a
    begin, which changes the transition after it too.
    """
    t = lambda a, b: 0.0 if a is None or b is None else float(trans[a, b])
    worst = -np.inf
    for a in befores:
        for x in tags:
            for c in nexts:
                for d in (None, 0, 1, 2) if c is not None else (None,):
                    new = 1 if c == 2 else c
                    lost = t(a, x) + t(x, c) + t(c, d) - t(a, 0) - t(0, new) - t(new, d)
                    worst = max(worst, lost) if np.isfinite(lost) else worst
    return worst


class Scanner:
    """Finds spans in texts; one per worker process."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = weights
        self.classes: dict[frozenset[int], int] = {}
        self.tables = {k: np.zeros((0, TAGS)) for k in ("word", "before", "after")}
        self.of = Known(lambda word: (self._class(word),), MEMO)
        trans = weights["trans"]
        self.stay = max(0.0, float(trans[np.isfinite(trans)].max() - trans[0, 0]))
        self.open = _reach(trans, (None, 0, 1, 2), (1, 2), (None, 0, 1))
        self.run = _reach(trans, (None, 0, 1, 2), (1, 2), (2,))
        self.start = _reach(trans, (None, 0), (1,), (2,))

    def _class(self, word: str) -> int:
        """Class of a word's features, times 2, plus 1 if a fixed pattern may touch the word."""
        s = shape(word)
        k = self.classes.get(s)
        if k is None:
            k = self.classes[s] = len(self.classes)
            for name, table in self.tables.items():
                self.tables[name] = np.vstack([table, self.w[name][list(s)].sum(axis=0)])
        return 2 * k + bool(1 not in s and (KEYWORD.search(word) or "AKIA" in word or LONG_HEX.search(word)) or len(word) >= 20 and LONG_HEX.search(word) or "AKIA" in word)

    def emissions(self, kinds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of all words of some texts; neighbours do not cross texts."""
        n = len(kinds)
        emit = self.tables["word"][kinds]
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        full = offsets[1:] > offsets[:-1]
        first[offsets[:-1][full]] = True
        last[offsets[1:][full] - 1] = True
        emit[1:] += np.where(first[1:, None], 0.0, self.tables["before"][kinds[:-1]])
        emit[:-1] += np.where(last[:-1, None], 0.0, self.tables["after"][kinds[1:]])
        prose = self.classes.get(frozenset([1]), -1)
        odd = np.concatenate([[0], np.cumsum(kinds != prose)])
        sizes = np.diff(offsets)
        share = (odd[offsets[1:]] - odd[offsets[:-1]]) / np.maximum(sizes, 1)
        return emit + np.repeat(self.w["file"][file_feature(share)], sizes, axis=0)

    def sure(self, emit: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Words that are outside in every best path.

        Take a block of such words and any path with other tags in it; setting them all to outside must gain. Inside
        the block that loses at most ``stay`` a transition, at its left edge and before an outside or begin at most
        ``open``. If the word after the block was inside, it becomes a begin: then the tags set reach the block's end,
        and either the last word was a begin after an outside, or the last two words (or all of a one-word block and
        what stands before it) were not outside.
        """
        lead = emit[:, 0] - emit[:, 1:].max(axis=1) - self.stay - 1e-9
        undo = np.concatenate([emit[1:, 2] - emit[1:, 1], [-np.inf]])
        full = offsets[1:] > offsets[:-1]
        undo[offsets[1:][full] - 1] = -np.inf  # nothing follows
        first = np.zeros(len(emit), bool)
        first[offsets[:-1][full]] = True
        begun = emit[:, 0] - emit[:, 1] - self.stay - 1e-9 > self.start + undo
        sure = lead > self.open
        while True:
            before = np.concatenate([[False], sure[:-1]]) & ~first
            two = lead + np.where(before, np.concatenate([[0.0], lead[:-1]]), 0.0)
            ends = sure & ~np.concatenate([sure[1:], [False]])
            drop = ends & np.isfinite(undo) & ~(begun & (two > self.run + undo))
            if not drop.any():
                return sure
            sure &= ~drop

    def tags(self, emit: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Viterbi tags of all texts' words."""
        sure = self.sure(emit, offsets)
        out = np.zeros(len(emit), np.int64)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        open_ = np.flatnonzero(~sure)
        if not len(open_):
            return out
        cut = np.flatnonzero((np.diff(open_) > 1) | (np.diff(text[open_]) > 0)) + 1
        for run in np.split(open_, cut):
            a, z = int(run[0]), int(run[-1]) + 1
            # one sure word on each side, inside the text, carries the transitions
            a -= a > offsets[text[a]]
            z += z < offsets[text[z - 1] + 1]
            out[a:z] = viterbi(emit[a:z], self.w["trans"])
        return out

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """All spans of each text, by start, then kind."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        offsets = split.offsets.to_numpy().astype(np.int64)
        flat = split.values
        real = pc.greater(pc.binary_length(flat), 0)
        offsets = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[offsets]
        index, distinct = distinct_words(flat.filter(real))
        found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not len(distinct):
            return found
        flat, starts, _ = self.of.find(distinct)
        coded = flat[starts].astype(np.int64)[index]
        touched = np.concatenate([[0], np.cumsum(coded & 1)])
        tags = self.tags(self.emissions(coded >> 1, offsets), offsets)
        tagged = np.concatenate([[0], np.cumsum(tags > 0)])
        for i in np.flatnonzero(np.diff(touched[offsets]) + np.diff(tagged[offsets])).tolist():
            text, own = texts[i], tags[offsets[i] : offsets[i + 1]]
            base = base_spans(text)
            more = []
            if own.any():
                at = [m.span() for m in WORD.finditer(text)]
                for t in np.flatnonzero(own == 1).tolist():
                    z = t + 1
                    while z < len(own) and own[z] == 2:
                        z += 1
                    a, b = at[t][0], at[z - 1][1]
                    if not any(x <= a and b <= y for x, y, _ in base):
                        more.append((a, b, "crf"))
            found[i] = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))
        return found


def _scanner(weights: dict[str, np.ndarray]) -> Scanner:
    """One per worker process."""
    key = hash(b"".join(np.ascontiguousarray(v).tobytes() for v in weights.values()))
    return resident(("secrets", key), lambda: Scanner(weights))


def joined(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end of each span, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` redacted (each merged span replaced by ``[SECRET]``; null stays null) and ``spans``
    (array of kind, start, end in the text as it was); a column already named ``spans`` is replaced."""
    weights = model()
    docs = docs.drop("spans")
    at = docs.columns.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(weights)
        for batch in batches:
            texts = batch.column(at).to_numpy(zero_copy_only=False).tolist()
            spans, clean = [], []
            for found, t in zip(_scanned_in_runs(scanner, texts), texts):
                spans.append([{"kind": k, "start": a, "end": b} for a, b, k in found])
                clean.append(redact(t, found))
            columns = [*batch.columns, pa.array(spans, kind)]
            columns[at] = pa.array(clean, pa.string())
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "spans"])

    return map_arrow(docs, run, StructType([*docs.schema.fields, *StructType.fromDDL("spans array<struct<kind:string,start:long,end:long>>").fields]))


def redact(text: str | None, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str | None:
    """``text`` with overlapping spans merged and each replaced by ``mark``."""
    if not spans:
        return text
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _scanned_in_runs(scanner: Scanner, texts: list[str | None], most: int = 3_000_000) -> Iterator[list[tuple[int, int, str]]]:
    held: list[str] = []
    size = 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size > most:
            yield from scanner.scan(held)
            held, size = [], 0
    if held:
        yield from scanner.scan(held)


def digests(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, a digest of their spans, and all spans as text."""
    spans = scanned(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return spans.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
