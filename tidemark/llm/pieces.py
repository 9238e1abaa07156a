"""SentencePiece encoding and decoding: suffix-array matching of all pieces in a batch, edges relaxed by end position."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, counted_ranges, mix, slices, span_hashes, utf8

BLANK = "▁"  # stands for a space in pieces
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _merged(symbols: list[str], scores: dict[str, float]) -> list[str]:
    """Merge the neighbours whose union scores highest, leftmost first, until none is a piece."""
    symbols = list(symbols)
    while True:
        best = max(((scores[a + b], -k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in scores), default=None)
        if best is None:
            return symbols
        k = -best[1]
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]


@dataclass
class PieceModel:
    """Pieces of a byte-fallback BPE model, and when two of them may stand side by side.

    `left` and `right` are the pieces that a piece was merged from last, `rank` orders the merges; `joins` holds the sorted
    pairs whose union is a piece, `joined` that piece's rank.
    """

    pieces: list[bytes]
    number: dict[str, int]
    bytes_at: np.ndarray
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    joins: np.ndarray
    joined: np.ndarray
    longest: int
    blanks: np.ndarray
    cache_keys: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    cache_fits: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    @classmethod
    def load(cls, path: str) -> PieceModel:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        total = model.get_piece_size()
        text = [model.id_to_piece(i) for i in range(total)]
        plain = [i for i in range(total) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        scores = {text[i]: model.get_score(i) for i in plain}
        bytes_at = np.full(256, -1)
        for i in range(total):
            if model.is_byte(i):
                bytes_at[int(text[i][3:-1], 16)] = i
        rank, left, right = np.zeros(total, np.int64), np.full(total, -1), np.full(total, -1)
        number = {}
        # Pieces by falling score; one is reachable if merging its characters ends in it, last from two pieces.
        order = sorted((i for i in plain if len(text[i].strip(BLANK)) or text[i] == BLANK), key=lambda i: (len(text[i]) > 1, -scores[text[i]], i))
        for place, i in enumerate(order):
            if len(text[i]) == 1:
                number[text[i]], left[i], right[i] = i, i, i
            else:
                symbols = list(text[i])
                lower = scores[text[i]]
                inner = _merged(symbols, {p: s for p in _parts(text[i]) if (s := scores.get(p)) is not None and s > lower})
                if len(inner) != 2 or any(p not in number for p in inner):
                    continue
                number[text[i]], left[i], right[i] = i, number[inner[0]], number[inner[1]]
            rank[i] = place
        found = [((number[t[:k]] << 32) | number[t[k:]], rank[i]) for t, i in number.items() for k in range(1, len(t)) if t[:k] in number and t[k:] in number]
        found.sort()
        blanks = np.array([next((i for i in plain if text[i] == BLANK * k), -1) for k in range(17)])
        raw = [bytes([int(t[3:-1], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else t.replace(BLANK, " ").encode() for i, t in enumerate(text)]
        return cls(raw, number, bytes_at, rank, left, right, np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64),
                   max(map(len, number)), blanks)

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """May piece b follow piece a, that is, do the characters of both merge into just these two?

        A direct-mapped cache holds what earlier calls found.
        """
        if not len(self.cache_keys):
            self.cache_keys, self.cache_fits = np.full(1 << 21, (1 << 64) - 1, U64), np.zeros(1 << 21, bool)
        key = (a.astype(U64) << U64(32)) | b.astype(U64)
        slot = (mix(key) & U64((1 << 21) - 1)).astype(np.int64)
        out = self.cache_fits[slot]
        new = np.flatnonzero(self.cache_keys[slot] != key)
        if len(new):
            out[new] = self._fit(a[new], b[new])
            self.cache_keys[slot[new]], self.cache_fits[slot[new]] = key[new], out[new]
        return out

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Take both pieces apart, latest merge first, and see whether some union over the seam would have come before."""
        fits = np.ones(len(a), bool)
        rows = np.arange(len(a))
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)  # rank of the merge undone last; a union over the seam must come earlier to disturb
        strict = np.zeros(len(a), bool)  # undone on the right side: equal ranks go to the left pair
        while len(rows):
            key = (a << 32) | b
            at = np.minimum(np.searchsorted(self.joins, key), len(self.joins) - 1)
            rank = np.where(self.joins[at] == key, self.joined[at], np.iinfo(np.int64).max)
            bad = (rank < limit) | ((rank == limit) & strict & (rank < np.iinfo(np.int64).max))
            fits[rows[bad]] = False
            split_a, split_b = self.left[a] != a, self.left[b] != b
            go = ~bad & (split_a | split_b)
            rows, a, b, split_a, split_b = rows[go], a[go], b[go], split_a[go], split_b[go]
            # Undo the merge that came later: a's last merge or b's last merge.
            on_a = split_a & (~split_b | (self.rank[a] > self.rank[b]))
            limit = np.where(on_a, self.rank[a], self.rank[b])
            strict = ~on_a
            a, b = np.where(on_a, self.right[a], a), np.where(on_a, b, self.left[b])
        return fits


def _parts(piece: str) -> set[str]:
    return {piece[i:j] for i in range(len(piece)) for j in range(i + 1, len(piece) + 1) if j - i < len(piece)}


class Encoder:
    """Encodes batches; words met before are looked up."""

    def __init__(self, model: PieceModel, batch_chars: int = 1 << 18, remembered: int = 1 << 19) -> None:
        self.model, self.batch_chars, self.remembered = model, batch_chars, remembered
        self.alphabet = np.unique([ord(c) for t in model.number for c in t if len(t) == 1])
        self.alone = np.arange(256) < 32  # control bytes that are in no piece stand alone
        self.alone[self.alphabet[self.alphabet < 256]] = False
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for text, i in model.number.items():
            self.by_length.setdefault(len(text), []).append((i, [ord(c) for c in text]))
        self.by_length = {n: (np.array([p[0] for p in found]), np.array([p[1] for p in found])) for n, found in self.by_length.items()}
        self._forget()

    def _forget(self) -> None:
        self.known, self.first, self.tokens = np.zeros(0, U64), np.zeros(1, np.int64), np.zeros(0, np.int32)

    # The words of one batch -------------------------------------------------------------------------------------------

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of words that have a blank at most in front, one after another, and how many each has."""
        sizes = np.array([len(t) for t in texts], np.int64)
        text = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        place = np.minimum(np.searchsorted(self.alphabet, text), len(self.alphabet) - 1)
        unknown = self.alphabet[place] != text
        # Characters that are no piece split a word; each becomes its bytes.
        start = np.zeros(len(text) + 1, bool)
        start[np.concatenate(([0], np.cumsum(sizes)))] = True
        start[:-1] |= unknown
        start[1:] |= unknown
        first = np.flatnonzero(start)
        runs = np.diff(first)
        tokens, many = self._relaxed(text, unknown, first[:-1], runs)
        if unknown.any():
            tokens, many = self._with_bytes(text, unknown, first[:-1], tokens, many)
        ends = np.concatenate(([0], np.cumsum(many)))[np.searchsorted(first, np.concatenate(([0], np.cumsum(sizes))))]
        return tokens, np.diff(ends)

    def _with_bytes(self, text: np.ndarray, unknown: np.ndarray, first: np.ndarray, tokens: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts, at = [], np.concatenate(([0], np.cumsum(many)))
        many = many.copy()
        done = 0
        for k in np.flatnonzero(unknown[first]):
            raw = self.model.bytes_at[list(chr(int(text[first[k]])).encode("utf-8", "replace"))]
            parts += [tokens[done : at[k]], raw]
            done = at[k]
            many[k] = len(raw)
        return np.concatenate([*parts, tokens[done:]]).astype(np.int32), many

    def _edges(self, text: np.ndarray, left: np.ndarray) -> np.ndarray:
        """edges[n - 1, e]: the piece of n characters that ends at place e, or 0.

        The suffixes of the text are sorted by their first characters (as many as a piece has at most), packed into 64-bit
        keys; a piece's occurrences are one range of that order, found by binary search key after key. `left` is the number
        of characters from a place to the end of its word; edges that leave the word do not count.
        """
        letters, code = np.unique(text, return_inverse=True)
        code = code + 1  # 0 stands behind the end
        width = int(len(letters) + 1).bit_length()
        each, longest = 64 // width, self.model.longest
        padded = np.concatenate((code, np.zeros(longest, np.int64))).astype(U64)
        keys = []
        for a in range(0, longest, each):
            key = np.zeros(len(text), U64)
            for k in range(a, a + each):
                key = (key << U64(width)) | (padded[k : k + len(text)] if k < longest else U64(0))
            keys.append(key)
        order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        edges = np.zeros((longest, len(text)), np.int32)
        for n, (ids, chars) in self.by_length.items():
            at = np.minimum(np.searchsorted(letters, chars), len(letters) - 1)
            here = (letters[at] == chars).all(axis=1)
            ids, coded = ids[here], (at[here] + 1).astype(U64)
            low, high = np.zeros(len(ids), np.int64), np.full(len(ids), len(text))
            for k, key in enumerate(keys):
                part = coded[:, k * each : (k + 1) * each]
                if not part.shape[1]:
                    break
                value = np.zeros(len(ids), U64)
                for c in range(part.shape[1]):
                    value = (value << U64(width)) | part[:, c]
                free = U64(width * (each - part.shape[1]))
                low, high = _within(key, value << free, low, high), _within(key, (value << free) | U64((1 << int(free)) - 1), low, high, True)
            count = high - low
            where = order[counted_ranges(low, count)]
            inside = left[where] >= n
            edges[n - 1, where[inside] + n - 1] = np.repeat(ids, count)[inside]
        return edges

    def _relaxed(self, text: np.ndarray, unknown: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all runs one after another, and their number in each run (none in a run of an unknown character).

        Every prefix of a run has one encoding. It ends with the only edge whose piece may follow the last piece of the
        prefix before that edge, so all runs advance together, end position by end position.
        """
        longest = self.model.longest
        last, fits = np.zeros(len(text), np.int64), self.model.fit
        if len(text):
            offset = np.arange(len(text)) - np.repeat(first, size)
            edges = self._edges(text, np.repeat(size, size) - offset)
            order = np.argsort(-size, kind="stable")
            order = order[~unknown[first[order]]]
            falling = -size[order]
            for k in range(1, int(size.max()) + 1):
                ends = first[order[: np.searchsorted(falling, -k, "right")]] + k - 1
                for n in range(min(k, longest), 0, -1):
                    piece = edges[n - 1, ends]
                    here = np.flatnonzero(piece)
                    if not len(here):
                        continue
                    if n < k:
                        here = here[fits(last[ends[here] - n], piece[here])]
                    last[ends[here]] = piece[here]
                    ends = np.delete(ends, here)
                    if not len(ends):
                        break
        length = np.zeros(int(max(self.model.number.values())) + 1, np.int64)
        for t, i in self.model.number.items():
            length[i] = len(t)
        # Walk back from the ends of the runs.
        live = np.flatnonzero(~unknown[first]) if len(first) else first
        at = first[live] + size[live] - 1
        found_run, found_piece = [], []
        while len(live):
            piece = last[at]
            found_run.append(live)
            found_piece.append(piece)
            at = at - length[piece]
            on = at >= first[live]
            live, at = live[on], at[on]
        if not found_run:
            return np.zeros(0, np.int32), np.zeros(len(first), np.int64)
        run, piece = np.concatenate(found_run[::-1]), np.concatenate(found_piece[::-1])
        order = np.argsort(run, kind="stable")
        return piece[order].astype(np.int32), np.bincount(run, minlength=len(first))

    # Whole texts ------------------------------------------------------------------------------------------------------

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts one after another, and the n + 1 offsets."""
        column = pc.fill_null(column, "")
        column = pc.replace_substring(column, BLANK, " ")
        column = pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise(" ", column, ""))
        data, offsets = utf8(column)
        start = np.zeros(len(data) + 1, bool)
        start[offsets] = True
        if len(data):
            alone = self.alone[data]
            start[:-1] |= alone | (data == 32)
            start[1:] |= alone
        starts = np.flatnonzero(start[:-1])
        ends = np.concatenate((starts[1:], [len(data)]))[: len(starts)]
        hashes = span_hashes(data, starts, ends)
        distinct, at, group = np.unique(hashes, return_index=True, return_inverse=True)
        row = self._remember(distinct, at, data, starts, ends)[group]
        many = (self.first[1:] - self.first[:-1])[row]
        tokens = self.tokens[counted_ranges(self.first[row], many)]
        total = np.concatenate(([0], np.cumsum(many)))
        cuts = total[np.searchsorted(starts, offsets)]
        return self._blank_runs(tokens, cuts)

    def _remember(self, hashes: np.ndarray, at: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows of the sorted distinct hashes in the memory, new words being encoded first."""
        if len(self.known) + len(hashes) > self.remembered:
            self._forget()
        place = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[place] != hashes) if len(self.known) else np.arange(len(hashes))
        raw = data.tobytes()
        words = [raw[a:b].decode().replace(" ", BLANK) for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist())]
        encoded, counts, a = [], [np.diff(self.first)], 0
        while a < len(words):
            b, held = a, 0
            while b < len(words) and (b == a or held + len(words[b]) <= self.batch_chars):
                held += len(words[b])
                b += 1
            tokens, many = self.words(words[a:b])
            encoded.append(tokens)
            counts.append(many)
            a = b
        if len(new):
            keys = np.concatenate((self.known, hashes[new]))
            many = np.concatenate(counts)
            first = np.cumsum(many) - many
            tokens = np.concatenate((self.tokens, *encoded))
            order = np.argsort(keys)
            self.known = keys[order]
            self.tokens = tokens[counted_ranges(first[order], many[order])]
            self.first = np.concatenate(([0], np.cumsum(many[order])))
        return np.searchsorted(self.known, hashes)

    def _blank_runs(self, tokens: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blanks side by side within a text merge from the left into the longest pieces of blanks."""
        blanks = self.model.blanks
        lone = tokens == blanks[1]
        pair = lone[:-1] & lone[1:]
        inner = cuts[(cuts > 0) & (cuts < len(tokens))]
        pair[inner - 1] = False
        if not pair.any():
            return tokens, cuts
        longest = int(np.flatnonzero(blanks >= 0).max())
        edge = np.diff(np.concatenate(([False], pair, [False])).astype(np.int8))
        keep = np.ones(len(tokens), bool)
        tokens = tokens.copy()
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            whole, rest = divmod(b - a + 1, longest)
            merged = [blanks[longest]] * whole
            while rest:
                most = int(np.flatnonzero(blanks[: rest + 1] >= 0).max())
                merged.append(blanks[most])
                rest -= most
            tokens[a : a + len(merged)] = merged
            keep[a + len(merged) : b + 1] = False
        return tokens[keep], np.concatenate(([0], np.cumsum(keep)))[cuts]


def _within(key: np.ndarray, value: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool = False) -> np.ndarray:
    """Binary search of each value in its own range of `key`: the first place that is not smaller (after: that is larger)."""
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        right = key[middle] <= value[open_] if after else key[middle] < value[open_]
        low[open_[right]], high[open_[~right]] = middle[right] + 1, middle[~right]
        open_ = open_[low[open_] < high[open_]]
    return low


_ENCODERS: dict[str, Encoder] = {}


def _encode(model: PieceModel, key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.setdefault(key, Encoder(model))  # a worker remembers words from task to task
        for batch in slices(batches, "text"):
            tokens, cuts = encoder.texts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(tokens, pa.int32()))], ["doc_id", "ids"])

    return encode


def encode_pieces(docs: DataFrame, model: str = DEFAULT_MODEL, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): texts as numbers of the pieces of a SentencePiece BPE model with byte fallback and dummy prefix.

    `model` is the path of the model file; only its pieces and scores are read, on the driver, and sent to the tasks (their
    number is that of the vocabulary). A batch's distinct words (each with the blank before it) are laid end to end and
    indexed by a suffix array up to the longest piece; every piece's range of occurrences gives edges from place to place,
    which are relaxed in order of their ends. As the model merges by score rather than adding scores up, an edge is taken
    when its piece may follow the piece before it, which holds for one edge at every place.

    Null and empty texts give no ids; nulls and repeats in doc_id are kept as they are; an empty table gives no rows; other
    columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return texts.mapInArrow(_encode(PieceModel.load(model), model), "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str = DEFAULT_MODEL, ids: str = "ids") -> DataFrame:
    """The rows with a column `decoded`: the text of the pieces without the dummy prefix; ids that are no piece give nothing."""
    pieces = PieceModel.load(model).pieces
    sizes = np.array([len(p) for p in pieces] + [0], np.int64)
    flat, first = np.frombuffer(b"".join(pieces), np.uint8), np.concatenate(([0], np.cumsum(sizes)[:-1]))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, max(whole.num_rows, 1), 500):
                batch = whole.slice(a, 500)
                column = batch.column(ids)
                values = pc.fill_null(column.flatten(), -1).to_numpy(zero_copy_only=False)
                values = np.where((values < 0) | (values >= len(pieces)), len(pieces), values)
                cuts = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))))
                raw = flat[counted_ranges(first[values], sizes[values])].tobytes()
                ends = np.concatenate(([0], np.cumsum(sizes[values])))[cuts]
                out = [raw[x + (raw[x : x + 1] == b" ") : y].decode("utf-8", "replace") if y > x else "" for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(decode, f"{schema}, decoded string")
