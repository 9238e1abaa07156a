"""Edit-aware token counts: a segment tree of pre-tokens per document, of which an edit re-encodes only the touched region."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-token pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Characters before an edit whose pre-tokens are always matched anew: the pattern looks ahead less far.
CONTEXT = 4


class Counter:
    """Token counts of pre-tokens by a byte-level BPE vocabulary; common ones are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, remembered: int = 300_000) -> None:
        import tiktoken

        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.remembered, self.known = regex.compile(pattern), remembered, {}

    def pieces(self, text: str) -> list[str]:
        return [m.group() for m in self.pattern.finditer(text)]

    def count(self, piece: str) -> int:
        found = self.known.get(piece)
        if found is None:
            found = len(self.encoding.encode_ordinary(piece))
            if len(piece) < 64:
                if len(self.known) >= self.remembered:
                    self.known.clear()
                self.known[piece] = found
        return found


class TokenTree:
    """Pre-tokens of a text in blocks, and a binary tree of the characters and tokens below each node."""

    BLOCK = 64

    def __init__(self, text: str, counter: Counter) -> None:
        self.text, self.counter, self.encoded = text, counter, 0
        self._build([(len(p), counter.count(p)) for p in counter.pieces(text)])

    def _build(self, leaves: list[tuple[int, int]]) -> None:
        self.blocks = [leaves[a : a + self.BLOCK] for a in range(0, len(leaves), self.BLOCK)] or [[]]
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, block in enumerate(self.blocks):
            self.chars[self.width + k], self.tokens[self.width + k] = sum(n for n, _ in block), sum(t for _, t in block)
        for node in range(self.width - 1, 0, -1):
            self._add_up(node)

    def _add_up(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _find(self, place: int) -> tuple[int, int, int]:
        """Block and number in it of the pre-token that holds the character, and where that pre-token starts."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if place >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        block = node - self.width
        for k, (size, _) in enumerate(self.blocks[block]):
            if place < start + size:
                return block, k, start
            start += size
        return block, len(self.blocks[block]), start

    def edit(self, start: int, stop: int, put: str) -> None:
        """Put `put` in place of the characters from start to stop (both within the text, else the nearest that are).

        Matching begins at a pre-token some characters before the edit and ends where a new pre-token's end falls on an old
        one's behind the edit: from there on the text, and so all pre-tokens, are the same as before.
        """
        start = min(max(start, 0), len(self.text))
        stop = min(max(stop, start), len(self.text))
        block, at, place = self._find(max(start - CONTEXT, 0))
        self.text = self.text[:start] + put + self.text[stop:]
        shift = len(put) - (stop - start)
        old_block, old_at, old_end = block, at, place  # old pre-tokens before this one end at old_end, in old characters
        new, done = [], place == len(self.text)
        end = place
        matches = self.counter.pattern.finditer(self.text, place)
        while True:
            # Old pre-tokens up to the place that the new end had before the edit.
            while old_end < max(end - shift, stop) and old_block < len(self.blocks):
                if old_at < len(self.blocks[old_block]):
                    old_end += self.blocks[old_block][old_at][0]
                    old_at += 1
                else:
                    old_block, old_at = old_block + 1, 0
            if end >= start + len(put) and old_end == end - shift and old_end >= stop or done:
                break
            match = next(matches, None)
            if match is None:
                done = True
                old_block, old_at, old_end = len(self.blocks) - 1, len(self.blocks[-1]), len(self.text) - shift
                break
            piece = match.group()
            new.append((len(piece), self.counter.count(piece)))
            end = match.end()
        self.encoded += len(new)
        self._splice(block, at, min(old_block, len(self.blocks) - 1), old_at if old_block < len(self.blocks) else len(self.blocks[-1]), new)

    def _splice(self, block: int, at: int, last: int, after: int, new: list[tuple[int, int]]) -> None:
        rest = self.blocks[last][after:]
        self.blocks[block] = self.blocks[block][:at] + new + rest
        for k in range(block + 1, last + 1):
            self.blocks[k] = []
        if len(self.blocks[block]) > 8 * self.BLOCK:
            self._build([leaf for b in self.blocks for leaf in b])
            return
        for k in range(block, last + 1):
            node = self.width + k
            self.chars[node], self.tokens[node] = sum(n for n, _ in self.blocks[k]), sum(t for _, t in self.blocks[k])
        low, high = (self.width + block) // 2, (self.width + last) // 2
        while low:
            for node in range(low, high + 1):
                self._add_up(node)
            low, high = low // 2, high // 2


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: base64 of the bytes and the rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


_COUNTERS: dict[str, Counter] = {}


def _counted(ranks: dict[bytes, int], key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _COUNTERS:
            _COUNTERS[key] = Counter(ranks)
        counter = _COUNTERS[key]
        for batch in slices(batches, "text"):
            rows = []
            for text, edits in zip(batch.column("text"), batch.column("edits")):
                tree = TokenTree(text.as_py() or "", counter)
                pieces, before = sum(map(len, tree.blocks)), tree.total
                for e in edits.as_py() or ():
                    if e is not None:
                        tree.edit(e["start"] or 0, e["stop"] or 0, e["put"] or "")
                rows.append((pieces, before, tree.total, tree.encoded, tree.text))
            columns = list(zip(*rows))
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds)]],
                                             ["doc_id", "n_pretokens", "n_tokens", "n_tokens_edited", "n_reencoded", "edited"])

    return count


def edited_token_counts(docs: DataFrame, edits: str = "edits", ranks: str = DEFAULT_RANKS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, n_tokens_edited, n_reencoded, edited): token counts before and after edits.

    `edits` is an array column of structs (start, stop, put): the characters from start to stop give way to `put`. The
    edits of a row are made one after another, each on the text that the one before left; ends outside the text are moved
    to its ends, a stop before its start to the start, and nulls count as 0 or nothing. Each document keeps a segment
    tree of its pre-tokens with token sums; an edit matches and encodes only the pre-tokens around it (`n_reencoded`) and
    updates the sums above them, and the counts equal those of the whole text. `ranks` is the path of a byte-level
    vocabulary, read on the driver and sent to the tasks (its size is that of the vocabulary).

    Null and empty texts have no tokens and can be edited; rows are independent, so null and repeated ids come back as they
    are; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"),
                       F.col(edits).cast("array<struct<start:int,stop:int,put:string>>").alias("edits"))
    return rows.mapInArrow(_counted(load_ranks(ranks), ranks), "doc_id long, n_pretokens long, n_tokens long, n_tokens_edited long, n_reencoded long, edited string")


def release_edits(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """`docs` with the `edits` that a release makes: the last line goes, the first e-mail address before it is masked, the source is put in front."""
    body = F.coalesce(F.col(text), F.lit(""))
    size = F.char_length(body)
    last = F.when(F.contains(body, F.lit("\n")), size - F.char_length(F.substring_index(body, "\n", -1)) - 1)
    mail = F.regexp_substr(body, F.lit(r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[A-Za-z]+"))
    at = F.instr(body, mail) - 1
    edit = lambda start, stop, put: F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), put.alias("put"))
    masked = F.when(at.isNotNull() & (at + F.char_length(mail) <= F.coalesce(last, size)), edit(at, at + F.char_length(mail), F.lit("[email]")))
    cut = F.when(last.isNotNull(), edit(last, size, F.lit("")))
    front = edit(F.lit(0), F.lit(0), F.concat(F.coalesce(F.col(source).cast("string"), F.lit("unknown")), F.lit(": ")))
    return docs.withColumn("edits", F.array_compact(F.array(cut, masked, front)))
