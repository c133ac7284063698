"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut into chunks that no piece can cross, and its distinct new chunks are laid end to end. A suffix array of that text
gives the occurrences of every piece as one range, found by binary search; occurrences become edges, sorted by where they end. Relaxing them in
that order gives every prefix of a chunk the last piece of its encoding. Of all edges into a position just one follows on from the
piece before it in the way that the model's merges would leave the two side by side, so one pass is enough and the
result is that of the merges themselves.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_documents

#: Where the model is. Chunks whose encoding a worker remembers, at most, before it begins anew. Characters of new chunks that are matched at once; a longer chunk is matched alone.
MODEL, REMEMBERED, MATCHED = "/opt/tokenizers/piece_bpe_32k.model", 400_000, 150_000
SPACE = "▁"
#: Bits of a character.
BITS = 21
#: Behind each chunk; no character.
END = 0x110000
_models: dict = {}


def _threes(characters: np.ndarray) -> np.ndarray:
    """Each character with the two behind it as one number, which orders as they do."""
    return characters[:-2] << 2 * BITS | characters[1:-1] << BITS | characters[2:]


class _Numbers(dict):
    """Numbers for keys, in the order in which they are first asked for."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


class Pieces:
    """A BPE model's pieces, and encodings by them. Needs a model that keeps white space, puts one space in front and falls back on bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        every = range(self.size)
        plain = [i for i in every if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        text = {i: model.id_to_piece(i) for i in every}
        self.score = {text[i]: model.get_score(i) for i in plain}
        self.id = {text[i]: i for i in plain}
        self.byte = {int(text[i][1:-1], 16): i for i in every if model.is_byte(i)}
        if len(self.byte) != 256 or any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError(f"{path}: not a model of this kind")
        self.bytes = [b""] * self.size
        for i in plain:
            self.bytes[i] = text[i].replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])
        # the two pieces that each piece is last merged from; one that merges don't make out of its own characters never comes up
        halves = {i: self.merged(text[i], 2) for i in plain}
        self.real = [i for i in plain if "".join(halves[i]) == text[i] and (len(text[i]) == 1 or len(halves[i]) == 2)]
        self.rank = np.full(self.size + 1, -1, np.int64)
        self.left, self.right = np.arange(self.size + 1), np.arange(self.size + 1)
        joined = {}
        for i in self.real:
            if len(t := text[i]) > 1:
                self.rank[i] = round(-self.score[t])
                self.left[i], self.right[i] = (self.id[x] for x in halves[i])
            joined |= {self.id[t[:k]] << 32 | self.id[t[k:]]: i for k in range(1, len(t)) if t[:k] in self.id and t[k:] in self.id}
        self.pairs = np.array(sorted(joined), np.int64)
        self.whole = np.array([joined[x] for x in sorted(joined)], np.int64)
        self.longest = max(len(text[i]) for i in self.real)
        self.length = np.zeros(self.size, np.int64)
        wide = -(-self.longest // 3) * 3
        matrix = np.zeros((len(self.real), wide + 2), np.int64)
        for k, i in enumerate(self.real):
            self.length[i] = len(text[i])
            matrix[k, : len(text[i])] = np.frombuffer(text[i].encode("utf-32-le"), np.int32)
        self.threes = _threes(matrix.T)[:wide:3].T.copy()  # each real piece in threes of characters, zeros behind its end
        self.single = np.zeros(END + 1, bool)
        self.single[[ord(text[i]) for i in self.real if len(text[i]) == 1] + [END]] = True
        self.forget()

    def forget(self) -> None:
        self.known = _Numbers()
        self.ids, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def merged(self, text: str, until: int = 1) -> list[str]:
        """The merges themselves: the best-scored piece of two neighbours, the first of equals, as long as there is one and more than `until` parts."""
        parts = list(text)
        while len(parts) > until:
            best = max((self.score.get(a + b, -np.inf), -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == -np.inf:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Would the merges of both pieces' characters together end with just these two?

        Merges are undone, the latest first, on the right edge of the left piece and the left edge of the right one. Whenever the two edges make a
        piece whose merge would have come before the one just undone, it would have joined them. Of equal merges the left one comes
        first.
        """
        unique, back = np.unique(left << 32 | right, return_inverse=True)
        x, y = (np.where(t < self.size, t, self.size) for t in (unique >> 32, unique & 0xFFFFFFFF))
        good, live, limit = np.ones(len(unique), bool), np.arange(len(unique)), np.full(len(unique), np.iinfo(np.int64).max)
        while len(live):
            key = x[live] << 32 | y[live]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joins = (self.pairs[at] == key) & (self.rank[self.whole[at]] < limit[live])
            good[live[joins]] = False
            rx, ry = self.rank[x[live]], self.rank[y[live]]
            go = ~joins & (np.maximum(rx, ry) >= 0)
            live, rx, ry = live[go], rx[go], ry[go]
            first = rx > ry
            limit[live] = np.where(first, rx, ry + 1)
            x[live] = np.where(first, self.right[x[live]], x[live])
            y[live] = np.where(first, y[live], self.left[y[live]])
        return good[back]

    def _suffixes(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes of text in the order of their first `longest` characters, by doubling; the threes of characters in text, and which of them is where."""
        n = len(text)
        threes, at = np.unique(_threes(np.concatenate([text, np.zeros(self.longest + 5, text.dtype)]).astype(np.int64)), return_inverse=True)
        rank, width = at[:n], 3
        while True:
            behind = np.zeros(n, np.int64)
            behind[:-width] = rank[width:] + 1
            key = rank * (n + self.longest + 7) + behind
            order = np.argsort(key)
            width *= 2
            if width >= self.longest:
                return order, threes, at
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))

    def _ranges(self, order: np.ndarray, threes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the suffix array the suffixes with each real piece in front begin and end, by binary search for three characters at a time.

        Suffixes with the same threes so far are one group; a piece is searched for in the group that it has come to, with its next three, or with all that begin with its last one or two.
        """
        low, high = np.zeros(len(self.real), np.int64), np.zeros(len(self.real), np.int64)
        live, mine, group = np.arange(len(self.real)), np.zeros(len(self.real), np.int64), np.zeros(len(order), np.int64)
        wide = self.length[self.real]
        for level in range(self.threes.shape[1]):
            key = group * len(threes) + at[order + 3 * level]
            code, rest = self.threes[live, level], np.minimum(wide[live] - 3 * level, 3)
            first, last = np.searchsorted(threes, code), np.searchsorted(threes, code + (np.int64(1) << BITS * (3 - rest)))
            low[live] = np.searchsorted(key, mine * len(threes) + first)
            high[live] = np.searchsorted(key, mine * len(threes) + last)
            group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if len(key) else group
            longer = wide[live] > 3 * (level + 1)
            go = longer & (low[live] < high[live])
            high[live[longer & ~go]] = low[live[longer & ~go]]
            live = live[go]
            mine = group[low[live]]
            if not len(live):
                break
        return low, high

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks that aren't known yet, and add them to ids and begin."""
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        start = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        text = np.full(lengths.sum() + len(chunks), END, np.int32)
        inside = np.ones(len(text), bool)
        inside[start + lengths] = False
        text[inside] = np.frombuffer("".join(chunks).encode("utf-32-le"), np.int32)
        order, threes, at = self._suffixes(text)
        low, high = self._ranges(order, threes, at)
        n = high - low
        # an edge for each occurrence, and one for each character that is no piece
        odd = np.flatnonzero(~self.single[text])
        begins = np.concatenate([order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], odd])
        piece = np.concatenate([np.repeat(np.array(self.real, np.int64), n), text[odd].astype(np.int64) + self.size])
        ends = begins + np.concatenate([np.repeat(self.length[self.real], n), np.ones(len(odd), np.int64)])
        # sorted by how far into its chunk an edge ends
        far = np.arange(len(text)) - np.repeat(start, lengths + 1)
        level = far[ends]
        by = np.argsort(level.astype(np.uint16) if len(level) and level.max() < 1 << 16 else level, kind="stable")
        begins, ends, piece, level = begins[by], ends[by], piece[by], level[by]
        last = np.full(len(text), -1, np.int64)  # the last piece of the prefix that ends here; a chunk's whole ends at its END
        first = far[begins] == 0
        cut = np.searchsorted(level, np.arange(1, (level[-1] if len(level) else 0) + 2))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            p, good = piece[a:b], first[a:b]
            before = last[begins[a:b]]
            rest = np.flatnonzero(~good & (before >= 0))
            good[rest] = self.fit(before[rest], p[rest])
            last[ends[a:b][good]] = p[good]
        # back from the end of each chunk, all chunks side by side; what ends where gives the order
        token = np.full(len(text), -1, np.int64)
        at, live = start + lengths, np.arange(len(chunks))
        while len(live):
            here = at[live]
            p = last[here]
            if (p < 0).any():
                raise ValueError("a prefix without an encoding")
            token[here] = p
            at[live] = here - np.where(p < self.size, self.length[np.minimum(p, self.size - 1)], 1)
            live = live[at[live] > start[live]]
        place = np.flatnonzero(token >= 0)
        tokens, owner = token[place], np.repeat(np.arange(len(chunks)), lengths + 1)[place]
        odd = np.flatnonzero(tokens >= self.size)
        if len(odd):  # characters that are no piece become their bytes
            each = [[self.byte[b] for b in chr(t - self.size).encode()] for t in tokens[odd].tolist()]
            times = np.ones(len(tokens), np.int64)
            times[odd] = np.fromiter(map(len, each), np.int64, len(each))
            begin = (np.cumsum(times) - times)[odd]
            tokens, owner = np.repeat(tokens, times), np.repeat(owner, times)
            tokens[np.concatenate([np.arange(a, a + len(e)) for a, e in zip(begin.tolist(), each, strict=True)])] = list(itertools.chain.from_iterable(each))
        count = np.bincount(owner, minlength=len(chunks))
        self.ids = np.concatenate([self.ids, tokens.astype(np.int32)])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(count)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after the other, and where each text's begin (one entry more than texts)."""
        if len(self.known) > REMEMBERED:
            self.forget()
        known, had = self.known, len(self.known)
        cut = re.compile(f"{SPACE}+[^{SPACE}]*").findall
        found = [np.fromiter(map(known.__getitem__, cut(SPACE + t.replace(" ", SPACE))), np.int64) if t else np.zeros(0, np.int64) for t in texts]
        part, total = [], 0
        for c in itertools.islice(known, had, None):
            if part and total + len(c) > MATCHED:
                self._learn(part)
                part, total = [], 0
            part.append(c)
            total += len(c)
        if part:
            self._learn(part)
        chunks = np.concatenate(found) if found else np.zeros(0, np.int64)
        n = self.begin[chunks + 1] - self.begin[chunks]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(self.begin[chunks] - upto[:-1], n) + np.arange(upto[-1])]
        return ids, upto[np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)]

    def decode(self, ids: list[int]) -> str:
        """Text of ids. A stretch of bytes that is no UTF-8 gives U+FFFD; the space in front goes."""
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def pieces(path: str = MODEL) -> Pieces:
    """A model, made once in a process."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


#: Characters of text that are encoded at once; a longer text is encoded alone.
AT_ONCE = 1_000_000


def _encoding(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            a, column = 0, batch.column("text")
            while a < len(column):
                texts, total = [], 0
                while a + len(texts) < len(column) and (not texts or total < AT_ONCE):
                    t = column[a + len(texts)].as_py() or ""
                    texts.append(t)
                    total += len(t)
                ids, begin = model.encode(texts)
                listed = ids.tolist()
                same = [model.decode(listed[begin[k] : begin[k + 1]]) == t.replace(SPACE, " ") for k, t in enumerate(texts)]
                lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, len(texts)), pa.array(np.diff(begin)), lists, pa.array(same)], names=["doc_id", "n_tokens", "ids", "round_trip"])
                a += len(texts)

    return encode


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip for every row of docs (doc_id long, text string).

    ids are what the model's own merges give. round_trip: decoding them gives the text back, U+2581 read as the space that it stands for. A null or
    empty text has no ids. Repeated rows are encoded alike; an empty table gives no rows; other columns are left alone. The whole of a text is encoded, however long.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encoding(model), "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text for rows (doc_id long, ids array of int). Null ids give a null text, no ids an empty one."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pieces(model).decode
        for batch in batches:
            texts = [None if x is None else of(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(decode, "doc_id long, text string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read_documents(spark, sf_dir))
