"""SentencePiece encoding and decoding by suffix-array matching.

For a batch of texts: the words of the batch are laid end to end and indexed by
a suffix array; every piece of the vocabulary is located in it by binary search,
which gives the range of all its occurrences; the occurrences are edges of a
lattice and are sorted by position; edges are then relaxed from left to right.

Departures from the plain method, which could not give right results in bounded
time and memory: a word that occurs again, in the batch or in one before, is
laid down once and its pieces are remembered (up to ``keep_chars`` characters of
words); the text is indexed in lots of ``LEARN`` characters; words of more than
``LONG`` characters and runs of blanks are merged directly.

The model is a BPE model, whose result is no cheapest path, so relaxing applies
the BPE rule: an edge extends the prefix before it if merging would keep the
prefix's last piece and the edge's piece apart. Exactly one edge into a position
of a word passes. Results equal those of the reference library piece by piece.

Normalisation of the model: identity with a leading blank; blanks become U+2581.
Characters without a piece become byte pieces. Words are what lies between
blanks; a vocabulary with a piece that crosses into a next word is refused.

Defined cases
    null or empty text: no pieces, decoded to the empty string; repeated rows:
    each encoded; empty table: no rows; extra columns are ignored; long texts:
    whole, in any number of words.

Scale: one pass without shuffle; a batch is cut to ``batch_chars`` characters,
so memory is bounded by that and by the longest text. The driver reads the
vocabulary from a path given as a parameter and ships it with the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_WORDS = re.compile(rf"{BLANK}*[^{BLANK}\n]+|\n|{BLANK}+")
NEVER = np.int64(1) << 40
#: Characters of new words that are indexed at once, and of a word that is merged directly.
LEARN, LONG = 150_000, 2_000


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the ``depth`` codes that follow.

    As many codes as fit are packed into one number, which is ranked; ranks are
    then doubled in width until ``depth`` is reached.
    """
    there = np.zeros(int(codes.max(initial=0)) + 1, np.int64)
    there[codes] = 1
    dense = np.cumsum(there)[codes]
    bits = int(dense.max(initial=1)).bit_length()
    width = max(1, 62 // bits)
    key = np.zeros(len(dense), np.int64)
    padded = np.r_[dense, np.zeros(width, np.int64)]
    for i in range(width):
        key = (key << bits) | padded[i : i + len(dense)]
    order = np.argsort(key)
    while width < depth:
        sorted_key = key[order]
        rank = np.empty_like(key)
        rank[order] = np.r_[1, 1 + np.cumsum(sorted_key[1:] != sorted_key[:-1])]
        if rank.max(initial=0) == len(rank):
            break
        after = np.zeros_like(rank)
        after[:-width] = rank[width:]
        key = rank * (len(rank) + 1) + after
        order = np.argsort(key)
        width *= 2
    return order


class Vocabulary:
    """Pieces, ranks and merge structure of a BPE model."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id_of = {self.pieces[i]: i for i in normal}
        if any(re.search(rf"[^{BLANK}]{BLANK}", self.pieces[i]) or ("\n" in self.pieces[i] and len(self.pieces[i]) > 1) for i in normal):
            raise ValueError("a piece crosses words")
        score = np.array([sp.get_score(i) for i in range(n)])
        self.rank = np.full(n, NEVER)
        self.rank[normal] = -score[normal]
        values, counts = np.unique(self.rank[normal], return_counts=True)
        tied = set(values[counts > 1].tolist())
        if any(len(self.pieces[i]) > 1 and int(self.rank[i]) in tied and set(self.pieces[i]) != {BLANK} for i in normal):
            raise ValueError("pieces other than runs of blanks share a rank")
        self.longest = max(len(self.pieces[i]) for i in normal)
        # Left and right part of every piece: its last merge.
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        pairs: dict[int, int] = {}
        for i in normal:
            p = self.pieces[i]
            if len(p) > 1:
                parts = self.merge(p, stop=2)
                if len(parts) == 2 and min(parts) >= 0:
                    self.left[i], self.right[i] = parts
        for i in normal:
            p = self.pieces[i]
            for cut in range(1, len(p)):
                a, b = self.id_of.get(p[:cut]), self.id_of.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * n + b] = int(self.rank[i])
        self.n = n
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_ranks = keys, np.array([pairs[k] for k in keys.tolist()], np.int64)
        # Pieces that merging can reach, for the search; runs of blanks are merged directly.
        reach = [i for i in normal if (len(self.pieces[i]) == 1 or self.left[i] >= 0) and not (len(self.pieces[i]) > 1 and set(self.pieces[i]) == {BLANK})]
        self.search_ids = np.array(sorted(reach, key=lambda i: self.pieces[i]), np.int64)
        self.search_sizes = np.array([len(self.pieces[i]) for i in self.search_ids.tolist()], np.int64)
        self.search_chars = np.zeros((len(reach), self.longest), np.int64)
        for row, i in enumerate(self.search_ids.tolist()):
            self.search_chars[row, : len(self.pieces[i])] = [ord(c) for c in self.pieces[i]]
        byte_ids = set(self.byte.values())
        self.spelled = [bytes([int(p[3:5], 16)]) if i in byte_ids else p.replace(BLANK, " ").encode() for i, p in enumerate(self.pieces)]

    def merge(self, text: str, stop: int = 1) -> list[int]:
        """Plain BPE: best rank first, leftmost on ties, until ``stop`` parts; -1 marks a character without piece."""
        parts: list[str] = list(text)
        after = [*range(1, len(parts)), -1]
        before = [-1, *range(len(parts) - 1)]
        heap: list[tuple[int, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (k := self.id_of.get(joined := parts[i] + parts[j])) is not None and (stop == 1 or len(joined) < len(text)):
                heappush(heap, (int(self.rank[k]), i, j, joined))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        left = len(parts)
        while heap and left > stop:
            _, i, j, joined = heappop(heap)
            if not parts[i] or not parts[j] or after[i] != j or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, ""
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            left -= 1
            offer(before[i], i)
            offer(i, after[i])
        return [self.id_of.get(p, -1) for p in parts if p]

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of two pieces; NEVER where there is none."""
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE of the joined text of two pieces keeps them apart.

        Undo the later of the two last merges again and again; the pair is kept
        apart unless a merge across the border would have come first.
        """
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), NEVER)
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            cross = self.pair_rank(x, y)
            bad = cross < limit[live]
            ok[live[bad]] = False
            rx = np.where(self.left[x] >= 0, self.rank[x], -1)
            ry = np.where(self.left[y] >= 0, self.rank[y], -1)
            undo_x = rx > ry
            # A merge left of the border wins a tie against one across it, one on the right loses it.
            lim = np.where(undo_x, rx, ry + 1)
            a[live] = np.where(undo_x, self.right[x], x)
            b[live] = np.where(undo_x | (ry < 0), y, self.left[y])
            limit[live] = lim
            live = live[~bad & (np.maximum(rx, ry) >= 0)]
        return ok


@lru_cache(maxsize=2)
def vocabulary(model_file: str) -> Vocabulary:
    return Vocabulary(model_file)


def _bound(column: np.ndarray, low: np.ndarray, high: np.ndarray, want: np.ndarray, above: bool) -> np.ndarray:
    """First place in each [low, high) whose code is at least (or above) the wanted one."""
    low, high = low.copy(), high.copy()
    while len(live := np.flatnonzero(low < high)):
        mid = (low[live] + high[live]) // 2
        got = column[mid]
        right = (got <= want[live]) if above else (got < want[live])
        low[live] = np.where(right, mid + 1, low[live])
        high[live] = np.where(right, high[live], mid)
    return low


def lattice(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges (begin, end, piece) in the joined words, and where words begin."""
    lengths = np.array([len(w) for w in words], np.int64)
    starts = np.r_[0, np.cumsum(lengths + 1)[:-1]]
    codes = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    order = suffix_array(codes, v.longest)
    padded = np.r_[codes, np.zeros(v.longest, np.int64)]
    # Binary search of all pieces at once, one character deeper each time.
    low, high = np.zeros(len(v.search_ids), np.int64), np.full(len(v.search_ids), len(order), np.int64)
    for depth in range(v.longest):
        at = np.flatnonzero((v.search_sizes > depth) & (low < high))
        column, want = padded[order + depth], v.search_chars[at, depth]
        low[at], high[at] = _bound(column, low[at], high[at], want, False), _bound(column, low[at], high[at], want, True)
    size = v.search_sizes
    count = np.maximum(high - low, 0)
    piece = np.repeat(v.search_ids, count)
    begin = order[np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())]
    end = begin + np.repeat(size, count)
    return begin, end, piece, starts


def _by_position(at: np.ndarray) -> np.ndarray:
    """Sorts small numbers (by radix where they fit 16 bits)."""
    return np.argsort(at.astype(np.uint16) if at.max(initial=0) < 1 << 16 else at, kind="stable")


def relax(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all words one after the other, and how many each word has.

    Edges are sorted by the position in the word at which they end; words are
    relaxed side by side, one position after the other. -1 stands for a
    character without piece.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    if not len(words):
        return np.zeros(0, np.int64), lengths
    begin, end, piece, starts = lattice(words, v)
    word = np.repeat(np.arange(len(words)), lengths + 1)[begin]
    at = end - starts[word]
    by = _by_position(at)
    begin, piece, word, at = begin[by], piece[by], word[by], at[by]
    total = int(starts[-1] + lengths[-1] + 1)
    last = np.full(total + 1, -2, np.int64)  # piece that ends here
    back = np.full(total + 1, -1, np.int64)
    last[starts] = -1
    longest = int(lengths.max())
    cuts = np.searchsorted(at, np.arange(1, longest + 2))
    for k in range(1, longest + 1):
        e = slice(cuts[k - 1], cuts[k])
        b, p, w = begin[e], piece[e], word[e]
        before = last[b]
        good = before == -1
        check = np.flatnonzero(before >= 0)
        if len(check):
            pairs, inverse = np.unique(before[check] * v.n + p[check], return_inverse=True)
            good[check] = v.apart(pairs // v.n, pairs % v.n)[inverse]
        stop = starts[w[good]] + k
        last[stop], back[stop] = p[good], b[good]
        here = starts[lengths >= k] + k
        none = here[last[here] == -2]
        last[none], back[none] = -1, none - 1
    # Back from every end, all words at once.
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    live, pos, turn = np.flatnonzero(lengths > 0), (starts + lengths)[lengths > 0], 0
    while len(live):
        found.append((live, last[pos], np.full(len(live), turn)))
        pos = back[pos]
        on = pos > starts[live]
        live, pos, turn = live[on], pos[on], turn + 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    of, ids, turns = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(of * (turn + 1) + (turn - turns))
    return ids[order], np.bincount(of, minlength=len(words))


class Encoder:
    """Encodes batches; keeps the words it has seen, up to a bound."""

    def __init__(self, v: Vocabulary, keep_chars: int = 2_000_000) -> None:
        self.v, self.keep_chars = v, keep_chars
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.chars = 0
        self.flat = np.zeros(0, np.int32)
        self.begin = np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        lot, size = [], 0
        for w in words:  # bounds the edges that are held at once
            if size + len(w) > LEARN and lot:
                self._learn_some(lot)
                lot, size = [], 0
            lot.append(w)
            size += len(w)
        self._learn_some(lot)
        self.chars += sum(map(len, words))

    def _learn_some(self, words: list[str]) -> None:
        long = [w for w in words if len(w) > LONG]
        words = [w for w in words if len(w) <= LONG]
        plain = [w for w in words if not w.startswith(BLANK + BLANK) and w != BLANK]
        ids, sizes = relax(plain, self.v)
        odd = [w for w in words if w.startswith(BLANK + BLANK) or w == BLANK]
        if (ids < 0).any():  # words with characters that have no piece, by bytes
            ends = np.cumsum(sizes)
            missing = np.unique(np.searchsorted(ends, np.flatnonzero(ids < 0), side="right")).tolist()
            parts = {i: self._bytes(plain[i], ids[ends[i] - sizes[i] : ends[i]].tolist()) for i in missing}
            keep = np.ones(len(plain), bool)
            keep[missing] = False
            ids, sizes = ids[np.repeat(keep, sizes)], sizes[keep]
            plain = [w for w, k in zip(plain, keep.tolist(), strict=True) if k] + [plain[i] for i in missing]
            ids = np.concatenate([ids, *(np.array(p, np.int64) for p in parts.values())])
            sizes = np.r_[sizes, [len(p) for p in parts.values()]]
        if odd:  # runs of blanks
            core = [w.lstrip(BLANK) for w in odd]
            inner = sorted({BLANK + c for c in core if c})
            got, n = relax(inner, self.v)
            ends = np.cumsum(n)
            of = {w: got[b - k : b].tolist() for w, b, k in zip(inner, ends.tolist(), n.tolist(), strict=True)}
            parts = [self._bytes(w, self._run(len(w) - len(c), of[BLANK + c] if c else [])) for w, c in zip(odd, core, strict=True)]
            ids = np.concatenate([ids, *(np.array(p, np.int64) for p in parts)])
            sizes = np.r_[sizes, [len(p) for p in parts]]
        for w in long:
            part = self._bytes(w, self.v.merge(w))
            ids, sizes = np.concatenate([ids, np.array(part, np.int64)]), np.r_[sizes, len(part)].astype(np.int64)
        base = len(self.begin) - 1
        self.at.update(zip([*plain, *odd, *long], range(base, base + len(sizes)), strict=True))
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes, dtype=np.int64)])

    def _run(self, blanks: int, ids: list[int]) -> list[int]:
        """A run of blanks before the pieces of a word that was given one blank."""
        alone = not ids or ids[0] == self.v.id_of[BLANK]
        return self.v.merge(BLANK * (blanks if alone else blanks - 1)) + (ids[1:] if ids and alone else ids)

    def _bytes(self, word: str, ids: list[int]) -> list[int]:
        out, pos = [], 0
        for i in ids:
            if i >= 0:
                out.append(i)
                pos += len(self.v.pieces[i])
            else:
                out += [self.v.byte[b] for b in word[pos].encode("utf-8", "replace")]
                pos += 1
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All piece ids, and the offsets of the texts in them."""
        if self.chars > self.keep_chars:
            self.clear()
        split = [_WORDS.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        fresh = set().union(*split) - self.at.keys() if split else set()
        if fresh:
            self._learn(sorted(fresh))
        at = self.at
        index = np.fromiter((at[w] for ws in split for w in ws), np.int64)
        flat, begin = self.flat, self.begin
        size = begin[index + 1] - begin[index]
        low = np.r_[0, np.cumsum(size)]
        ids = flat[np.repeat(begin[index] - low[:-1], size) + np.arange(low[-1])] if len(index) else np.zeros(0, np.int32)
        words = np.r_[0, np.cumsum([len(ws) for ws in split])].astype(np.int64)
        return ids, low[words]


def decode(ids: list[int], v: Vocabulary) -> str:
    """The text of piece ids."""
    raw = b"".join(map(v.spelled.__getitem__, ids)).decode("utf-8", "replace")
    return raw[1:] if raw.startswith(" ") else raw


def _coder(v: Vocabulary, batch_chars: int):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(v)
        for batch in batches:
            keys, low, chars = batch.column(0), 0, 0
            texts: list[str | None] = []
            for row in range(batch.num_rows):
                texts.append(batch.column(1)[row].as_py())
                chars += len(texts[-1] or "")
                if chars >= batch_chars or row == batch.num_rows - 1:
                    ids, offsets = encoder.encode(texts)
                    lists = ids.tolist()
                    decoded = [decode(lists[a:b], v) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [keys.slice(low, len(texts)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())],
                        names=["key", "ids", "decoded"],
                    )
                    texts, chars, low = [], 0, row + 1

    return code


def encode(docs: DataFrame, model_file: str = DEFAULT_MODEL, key: str = "doc_id", text: str = "text", batch_chars: int = 1_000_000) -> DataFrame:
    """key, ids and decoded (the text read back from the ids) of every row."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(_coder(vocabulary(model_file), batch_chars), f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)
