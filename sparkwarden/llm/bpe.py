"""Byte-level BPE: encoding by a walk over the trie of distinct words, and decoding.

A text is cut into pre-tokens.  The distinct ones of a chunk form a trie, visited depth first in sorted
order, so the path of a word starts where it leaves the word before it.  A node (a prefix) keeps one state:
the last token of the prefix's encoding.  The state of a node follows from its ancestors: it is the one
token ending there that the merges leave untouched next to the last token of the prefix before it.  A
prefix that many words share is therefore encoded once.

Pre-tokens are found and counted with array operations, so Python handles a distinct word once, not each
occurrence.  There is no shuffle.  A task's memory is bound by the chunk size (or the longest text) and
by ``CACHE_WORDS`` and ``SEAMS``, after which a worker starts its tables of words and of token pairs anew, and a task that ends leaves no vocabulary
in its worker; results do not depend on either.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkwarden.llm.common import LIGHT_CHARS, chunks, ranges, span_hashes, widened

CACHE_WORDS = 100_000
SEAMS = 200_000
OTHER, LETTER, NUMBER, SPACE, UNKNOWN = 0, 1, 2, 3, 4
# The byte alphabet's printable ranges, the contractions and the white space of the public pre-tokeniser.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point; those that this Python's Unicode does not know are settled when met."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((UNKNOWN if (c := unicodedata.category(chr(i))) == "Cn" else kinds.get(c[0], OTHER) for i in range(0x110000)),
                      np.uint8, 0x110000)
    out[WHITE_SPACE] = SPACE
    return out


class Vocabulary:
    """Merges and tokens of a ``tokenizers`` JSON file with the byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.source = f.read()
        spec = json.loads(self.source)
        symbols = {b: chr(b) for b in PRINTABLE}
        symbols |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in symbols)}
        byte_of = {s: b for b, s in symbols.items()}
        vocab = spec["model"]["vocab"]
        self.token = {bytes(byte_of[c] for c in name): i for name, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if (left, right) not in self.merged:
                self.merged[left, right] = whole
            if whole in self.parts:
                raise ValueError("a token made by two merges is not supported")
            self.parts[whole], self.rank[whole] = (left, right), rank
        size = max([*self.token.values(), *self.special.values()]) + 1
        names = [b""] * size
        for name, i in self.token.items():
            names[i] = name
        for name, i in self.special.items():
            names[i] = name.encode()
        self.width = np.array([len(x) for x in names], dtype=np.int64)
        self.offset = np.concatenate(([0], np.cumsum(self.width)))[:-1]
        self.flat = np.frombuffer(b"".join(names), np.uint8)
        self.beginnings = {name[:i] for name in self.token for i in range(len(name) + 1)}
        self.states: dict[bytes, int] = {}
        self.steps: list[dict[int, int]] = []
        self.reach: list[bytes] = []
        self.ending: list[tuple[tuple[int, int], ...]] = []
        self._adjacent: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._class = _classes().copy()
        self.forget()

    # --- merges -------------------------------------------------------------------------------

    def adjacent(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens leaves exactly these two."""
        key = left << 32 | right
        known = self._adjacent.get(key)
        if known is None:
            known = self._adjacent[key] = self._seam(left, right, len(self.rank))
        return known

    def _seam(self, left: int, right: int, bound: int) -> bool:
        """Whether no merge of a rank below ``bound`` crosses the seam of two tokens.

        Undo the merges of both, last to first.  At each moment the symbols that face each other over the
        seam are known; the seam holds if no merge of such a pair comes before the merge that would consume
        one of its sides.
        """
        rank, parts = self.rank, self.parts
        while True:
            over = self.merged.get((left, right))
            if over is not None and rank[over] < bound:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                bound, left = a, parts[left][1]
            else:
                # of two merges of one rank the left one is made first, here the seam's
                bound, right = b + 1, parts[right][0]

    def whole(self, token: int) -> bool:
        """Whether the bytes of a token are encoded as this token."""
        known = self._whole.get(token)
        if known is None:
            parts = self.parts.get(token)
            known = self._whole[token] = parts is None or (self.whole(parts[0]) and self.whole(parts[1]) and self._seam(*parts, self.rank[token]))
        return known

    # --- distinct words -----------------------------------------------------------------------

    def _state(self, suffix: bytes) -> int:
        """Number of the longest suffix that begins some token, with the tokens that end there, longest first."""
        while suffix not in self.beginnings:
            suffix = suffix[1:]
        if suffix not in self.states:
            self.states[suffix] = len(self.steps)
            self.steps.append({})
            self.reach.append(suffix)
            ending = ((len(suffix) - i, self.token.get(suffix[i:], -1)) for i in range(len(suffix)))
            self.ending.append(tuple((n, t) for n, t in ending if t >= 0 and self.whole(t)))
        return self.states[suffix]

    def encode_words(self, words: list[bytes]) -> Iterator[list[int]]:
        """Encodings of sorted distinct words, by depth-first traversal of their trie."""
        steps, ending, seams = self.steps, self.ending, self._adjacent
        last: list[int] = [-1]  # last[d]: last token of the path's first d bytes
        back: list[int] = [0]  # back[d]: where that token begins
        state: list[int] = [self._state(b"")]  # state[d]: which tokens may end there
        before = b""
        for word in words:
            shared, n = 0, min(len(word), len(before))
            if word[:n] == before[:n]:
                shared = n
            else:
                while word[shared] == before[shared]:
                    shared += 1
            del last[shared + 1:], back[shared + 1:], state[shared + 1:]
            at = state[shared]
            for end in range(shared + 1, len(word) + 1):
                byte = word[end - 1]
                to = steps[at].get(byte)
                if to is None:
                    to = steps[at][byte] = self._state(self.reach[at] + bytes((byte,)))
                at = to
                for n, t in ending[at]:
                    start = end - n
                    if start:
                        left = last[start]
                        fits = seams.get(left << 32 | t)
                        if not (self.adjacent(left, t) if fits is None else fits):
                            continue
                    last.append(t)
                    back.append(start)
                    state.append(at)
                    break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            out, stop = [], len(word)
            while stop:
                out.append(last[stop])
                stop = back[stop]
            out.reverse()
            before = word
            yield out

    def forget(self) -> None:
        """Empty the tables of known words and seams."""
        self._adjacent.clear()
        self.known = np.zeros(0, np.uint64)
        self.known_at = np.zeros(0, np.int64)
        self.known_count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[bytes], special: dict[int, int]) -> None:
        order = sorted((i for i in range(len(words)) if i not in special), key=words.__getitem__)
        encoded: list[list[int]] = [[]] * len(words)
        for at in range(0, len(order), CACHE_WORDS):
            if len(self._adjacent) > SEAMS:
                self._adjacent.clear()
            part = order[at: at + CACHE_WORDS]
            for i, ids in zip(part, self.encode_words([words[i] for i in part]), strict=True):
                encoded[i] = ids
        for i, t in special.items():
            encoded[i] = [t]
        counts = np.array([len(e) for e in encoded], dtype=np.int64)
        at = len(self.pool) + np.concatenate(([0], np.cumsum(counts)))[:-1]
        self.pool = np.concatenate((self.pool, np.array([t for e in encoded for t in e], dtype=np.uint32)))
        known = np.concatenate((self.known, hashes))
        order = np.argsort(known)
        self.known = known[order]
        self.known_at = np.concatenate((self.known_at, at))[order]
        self.known_count = np.concatenate((self.known_count, counts))[order]

    # --- texts --------------------------------------------------------------------------------

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        kinds = self._class[points]
        if (kinds == UNKNOWN).any():
            from tokenizers import Tokenizer

            split = Tokenizer.from_str(self.source).pre_tokenizer.pre_tokenize_str
            for c in np.unique(points[kinds == UNKNOWN]).tolist():
                seen = [span for _, span in split(f"a{chr(c)}1{chr(c)}!")]
                self._class[c] = LETTER if seen[0] == (0, 2) else NUMBER if (1, 4) in seen else OTHER if (3, 5) in seen else SPACE
            kinds = self._class[points]
        return kinds

    def starts(self, points: np.ndarray, bounds: np.ndarray, fixed: np.ndarray) -> np.ndarray:
        """Where pre-tokens start: ``bounds`` are segment starts, ``fixed`` marks code points of special tokens."""
        n = len(points)
        kinds = self._kinds(points)
        kinds[fixed] = 5
        begin = np.zeros(n + 1, bool)
        begin[1:n] = kinds[1:] != kinds[:-1]
        cut = np.zeros(n + 1, bool)
        cut[bounds] = True
        begin |= cut
        begin[n] = True
        runs = np.flatnonzero(begin[:n])
        ends = np.concatenate((runs[1:], [n]))[: len(runs)]
        inner = (kinds[runs] == SPACE) & ~cut[np.minimum(ends, n)] & (ends < n)
        edge = ends[inner]  # white space that something follows: its last character stands apart or joins that
        begin[edge - 1] = True
        begin[edge[points[edge - 1] == 32]] = False
        quote = runs[(points[runs] == 39) & (ends - runs == 1) & begin[runs]]
        quote = quote[quote + 1 < n]
        quote = quote[~cut[quote + 1]]
        if len(quote):
            first = points[quote + 1]
            second = np.where(quote + 2 < n, points[np.minimum(quote + 2, n - 1)], 0)
            second = np.where(cut[np.minimum(quote + 2, n)], 0, second)
            size = np.where(np.isin(first, [ord(c) for c in SHORT_ENDINGS]), 2, 0)
            for a, b in LONG_ENDINGS:
                size = np.where((first == ord(a)) & (second == ord(b)), 3, size)
            quote, size = quote[size > 0], size[size > 0]
            begin[quote + 1] = False
            begin[np.minimum(quote + size, n)] = True
        return np.flatnonzero(begin[:n])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in a row, and each text's bounds in them (n + 1 values)."""
        bounds, lengths, fixed_spans, at = [], [], [], 0
        for text in texts:
            text = text or ""
            bounds.append(at)
            for name in self.special:
                pos = text.find(name)
                while pos >= 0:
                    fixed_spans.append((at + pos, at + pos + len(name)))
                    pos = text.find(name, pos + len(name))
            lengths.append(len(text))
            at += len(text)
        if at == 0:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        joined = "".join(t or "" for t in texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        fixed = np.zeros(len(points), bool)
        cuts = [b for b in bounds if b < at]
        for a, b in fixed_spans:
            fixed[a:b] = True
            cuts += [x for x in (a, b) if x < at]
        begin = self.starts(points, np.array(cuts, dtype=np.int64), fixed)
        end = np.concatenate((begin[1:], [at]))
        hashes, first, word = np.unique(span_hashes(points, begin, end), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_WORDS:
            self.forget()
        place = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != hashes[inside]
        if new.any():
            spans = [(int(begin[i]), int(end[i])) for i in first[new]]
            words = [joined[a:b].encode() for a, b in spans]
            special = {i: self.special[joined[a:b]] for i, (a, b) in enumerate(spans) if fixed[a]} if fixed_spans else {}
            self._learn(hashes[new], words, special)
            place = np.searchsorted(self.known, hashes)
        counts = self.known_count[place][word]
        ids = self.pool[ranges(self.known_at[place][word], counts)]
        total = np.concatenate(([0], np.cumsum(counts)))
        return ids, total[np.searchsorted(begin, np.array([*bounds, at], dtype=np.int64))]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """UTF-8 bytes of each id sequence; what is no valid UTF-8 becomes the replacement character."""
        width = self.width[ids]
        data = self.flat[ranges(self.offset[ids], width)].tobytes()
        at = np.concatenate(([0], np.cumsum(width)))[bounds].tolist()
        out = []
        for a, b in zip(at, at[1:], strict=False):
            piece = data[a:b]
            try:
                piece.decode()
            except UnicodeDecodeError:
                piece = piece.decode("utf-8", "replace").encode()
            out.append(piece)
        return out


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@contextlib.contextmanager
def lent_vocabulary(path: str) -> Iterator[Vocabulary]:
    """A vocabulary for one task: workers are reused, and what they keep would add to the stages that follow."""
    try:
        yield vocabulary(path)
    finally:
        vocabulary.cache_clear()


def encode(df: DataFrame, vocab_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns and ``ids array<int>``, the encoding of every whole text.

    A null text counts as empty and has no ids.  A column named ``ids`` is replaced.  Repeated rows are
    encoded each; rows are never dropped.
    """
    out = df.drop(ids)
    fields = out.columns

    def run(batches):
        with lent_vocabulary(vocab_path) as v:
            for whole in batches:
                for batch in chunks(whole, text, LIGHT_CHARS):
                    got, bounds = v.encode(batch.column(text).to_pylist())
                    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(got.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in fields), lists], [*fields, ids])

    return out.mapInArrow(run, widened(out, **{ids: "array<int>"}))


def decode(df: DataFrame, vocab_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns and the decoded text of ``ids``; null ids decode to the empty text."""
    out = df.drop(text)
    fields = out.columns

    def run(batches):
        with lent_vocabulary(vocab_path) as v:
            for batch in batches:
                column = batch.column(ids).fill_null([]) if batch.column(ids).null_count else batch.column(ids)
                counts = np.array([len(x) for x in column], dtype=np.int64)
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                texts = v.decode(flat, np.concatenate(([0], np.cumsum(counts))))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in fields), pa.array([t.decode() for t in texts], pa.string())], [*fields, text])

    return out.mapInArrow(run, widened(out, **{text: "string"}))


def digests(df: DataFrame, vocab_path: str, keep: list[str], text: str = "text", with_ids: bool = False) -> DataFrame:
    """``keep``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each row, encoding and decoding in one pass.

    Ids are hashed as little-endian unsigned 32-bit integers, decoded text as UTF-8.  ``with_ids`` adds the column ``ids``.  One pass holds
    one vocabulary per task; encode and decode one after the other would hold two.
    """
    base = df.select(*keep, df[text].alias("__text"))

    def run(batches):
        with lent_vocabulary(vocab_path) as v:
            for whole in batches:
                for batch in chunks(whole, "__text", LIGHT_CHARS):
                    got, bounds = v.encode(batch.column("__text").to_pylist())
                    data, at = memoryview(np.ascontiguousarray(got, "<u4")).cast("B"), (4 * bounds).tolist()
                    ids = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)] if len(got) else [hashlib.sha256().hexdigest()] * len(batch)
                    texts = [hashlib.sha256(t).hexdigest() for t in v.decode(got, bounds)]
                    out = [*(batch.column(c) for c in keep), pa.array(np.diff(bounds), pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]
                    if with_ids:
                        out.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(got.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(out, schema.names)

    schema = widened(df.select(*keep), n_tokens="long", ids_sha256="string", decoded_sha256="string", **({"ids": "array<int>"} if with_ids else {}))
    return base.mapInArrow(run, schema)
