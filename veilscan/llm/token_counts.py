"""Token counts that follow edits: a segment tree over the pre-tokens of each document, of which only the parts that an edit touches are encoded again."""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import pieces, tidy
from .storage import plain_columns, small_batches

# Fixed value: the published pre-token pattern of the vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
EDIT_TYPE = "array<struct<start:int,stop:int,replacement:string>>"
RESULT = ("leaves", "n_pretokens", "n_tokens", "edits", "n_edits", "n_tokens_after", "n_reencoded")
PIECE = 1 << 19
KNOWN_PRE_TOKENS = 200_000

REDACTED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\+?\d[\d ().-]{6,}\d|[ \t]{2,}|\n{2,}")


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines `base64 rank`, read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PreTokenCounts(dict):
    """Pre-token -> tokens of it. Forgets all once it knows KNOWN_PRE_TOKENS, so its size is bounded."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex
        import tiktoken

        super().__init__()
        self.split = regex.compile(PRE_TOKEN).findall
        self.encode = tiktoken.Encoding("given", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, pre_token: str) -> int:
        if len(self) >= KNOWN_PRE_TOKENS:
            self.clear()
        self[pre_token] = n = len(self.encode(pre_token))
        return n

    def counts(self, pre_tokens: list[str]) -> list[int]:
        return list(map(self.__getitem__, pre_tokens))


class PreTokenTree:
    """Leaves are runs of whole pre-tokens, at first one each; every node has the characters and the tokens below it."""

    def __init__(self, lengths: np.ndarray, tokens: np.ndarray):
        self.width = 1 << max(0, len(lengths) - 1).bit_length()
        self.leaves = len(lengths)
        self.sums = np.zeros((2 * self.width, 2), dtype=np.int64)
        self.sums[self.width : self.width + len(lengths)] = np.stack([lengths, tokens], axis=1) if len(lengths) else np.zeros((0, 2))
        level = self.width
        while level > 1:
            below = self.sums[level : 2 * level]
            self.sums[level // 2 : level] = below[0::2] + below[1::2]
            level //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def length(self) -> int:
        return int(self.sums[1, 0])

    def ends(self) -> list[int]:
        """Where each leaf ends, in characters."""
        return np.cumsum(self.sums[self.width : self.width + self.leaves, 0]).tolist()

    def replace(self, first: int, stop: int, lengths: list[int], tokens: list[int]) -> None:
        """New pre-tokens stand where the leaves first .. stop - 1 stood, one each; the last takes what is over. The sums above are updated level by level."""
        room = stop - first
        new = np.zeros((room, 2), dtype=np.int64)
        alone = min(room - 1, len(lengths))
        new[:alone, 0], new[:alone, 1] = lengths[:alone], tokens[:alone]
        new[room - 1] += (sum(lengths[alone:]), sum(tokens[alone:]))
        self.sums[self.width + first : self.width + stop] = new
        low, high = (self.width + first) // 2, (self.width + stop - 1) // 2
        while low:
            below = self.sums[2 * low : 2 * high + 2]
            self.sums[low : high + 1] = below[0::2] + below[1::2]
            low, high = low // 2, high // 2

    def grow(self, length: int, tokens: int) -> None:
        """A tree without text takes one leaf."""
        fresh = PreTokenTree(np.array([length] if length else [], dtype=np.int64), np.array([tokens] if length else [], dtype=np.int64))
        self.width, self.leaves, self.sums = fresh.width, fresh.leaves, fresh.sums


def in_order(edits: list[tuple[int, int, str]], length: int) -> list[tuple[int, int, str]]:
    """The edits from left to right, apart from each other: bounds are clamped to the text, and an edit that reaches into one to its right ends where that starts."""
    out, right = [], length
    for start, stop, new in sorted(edits, key=lambda e: (e[0], e[1]), reverse=True):
        start, stop = max(0, min(start, right)), max(0, min(stop, right))
        out.append((start, max(start, stop), new))
        right = start
    return out[::-1]


def apply_edits(text: str, tree: PreTokenTree, edits: list[tuple[int, int, str]], counter: PreTokenCounts) -> tuple[str, int]:
    """The edited text, and how many pre-tokens were encoded again; the tree follows. Edits (start, stop, replacement) name characters of the text before any edit (see in_order).

    One pass from left to right. A pre-token depends on the text from its start on, and looks beyond its end at most over white space and one character. So encoding restarts a pre-token before the last
    character that isn't white space ahead of an edit, and goes on until an old boundary behind the edit is a new one too and has more than white space behind it in view. Edits that are met before that are taken
    up by the same run; what is settled of a run is not looked at again, so the work follows the edits and not their square."""
    edits = in_order(edits, len(text))
    parts, at = [], 0
    for start, stop, new in edits:
        parts += [text[at:start], new]
        at = stop
    if not tree.length:
        whole = "".join([*parts, text[at:]])
        counts = counter.counts(counter.split(whole))
        tree.grow(len(whole), sum(counts))
        return whole, len(counts)
    again, j, floor, ends = 0, 0, 0, tree.ends()
    while j < len(edits):
        first, begin = _context(text, ends, edits[j][0], floor)
        leaf, end, read = first, begin, begin  # the next old leaf and where it begins; old text is taken up to `read`
        carry, lengths, tokens, reach = "", [], [], 4
        while True:
            while j < len(edits) and (edits[j][0] <= end or _context(text, ends, edits[j][0], begin)[1] <= end):
                start, stop, new = edits[j]
                carry += text[read:start] + new
                read, j = stop, j + 1
                if end < read:
                    leaf = bisect_left(ends, read, leaf) + 1
                    end = ends[leaf - 1]
            limit = edits[j][0] if j < len(edits) else len(text)
            bounds, seen = {len(carry) + end - read: (leaf, end)}, end
            while leaf < tree.leaves and len(bounds) <= reach and seen < limit:
                seen = ends[leaf]
                leaf += 1
                bounds[len(carry) + seen - read] = (leaf, seen)
            upto = min(seen, limit)
            view = carry + text[read:upto]
            last = upto == len(text) and j == len(edits)
            least, place, settled_to, done = len(carry) + end - read, 0, 0, None
            solid = len(view) if last else len(view.rstrip())
            found = counter.split(view)
            for k, p in enumerate(found):
                place += len(p)
                if place >= solid and not (last and place == len(view)):
                    break
                settled_to = k + 1
                if place in bounds and place >= least and bounds[place][0] > first and not (j < len(edits) and _context(text, ends, edits[j][0], begin)[1] < bounds[place][1]):
                    done = bounds[place]
                    break
            lengths += map(len, found[:settled_to])
            tokens += counter.counts(found[:settled_to])
            if done or last:
                leaf, floor = done or (tree.leaves, len(text))
                break
            carry, read, end, reach = view[sum(map(len, found[:settled_to])) :], upto, seen, 2 * reach
        again += len(lengths)
        tree.replace(first, leaf, lengths, tokens)
    return "".join([*parts, text[at:]]), again


def _context(text: str, ends: list[int], start: int, floor: int) -> tuple[int, int]:
    """The leaf from which an edit at `start` may change pre-tokens, and its first character; none before `floor`, a boundary."""

    def holds(at: int) -> tuple[int, int]:
        leaf = bisect_right(ends, at)
        return leaf, ends[leaf - 1] if leaf else 0

    before = start - 1
    while before >= floor and text[before].isspace():
        before -= 1
    if before <= floor:
        return holds(floor)
    first, begin = holds(before - 1 if before == start - 1 else before)
    return holds(begin - 1) if begin > floor else (first, begin)


def pre_token_trees(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """docs (text, ...) -> the columns of docs, and leaves (binary: 32-bit length and tokens of each pre-token), n_pretokens, n_tokens.

    The leaves are the state to keep: node sums follow from them in one pass. A null text has none. Columns named like a result are replaced."""
    keep = [c for c in docs.columns if c not in ("leaves", "n_pretokens", "n_tokens")]
    small_batches(docs)
    given = docs.sparkSession.sparkContext.broadcast(ranks)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PreTokenCounts(given.value)
        for batch in batches:
            for part in pieces(batch, PIECE):
                leaves, n, tokens = [], [], []
                for text in part.column("text").to_pylist():
                    found = counter.split(text or "")
                    table = np.array([list(map(len, found)), counter.counts(found)], dtype=np.int32).T
                    leaves.append(np.ascontiguousarray(table).tobytes())
                    n.append(len(found))
                    tokens.append(int(table[:, 1].sum()))
                arrays = [*(part.column(c) for c in keep), pa.array(leaves, pa.binary()), pa.array(n, pa.int64()), pa.array(tokens, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "leaves", "n_pretokens", "n_tokens"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return docs.mapInArrow(run, ", ".join([*kinds, "leaves binary, n_pretokens long, n_tokens long"]))


def edited_counts(trees: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Trees with a column edits (array of start, stop, replacement, in characters) -> their columns with the edited text, without leaves and edits, and n_edits, n_tokens_after, n_reencoded (pre-tokens encoded again).

    A document without edits is not encoded again. Null edits are none; a null text stays null if nothing is put in; overlapping edits and bounds outside the text are handled as apply_edits says."""
    keep = [c for c in trees.columns if c not in ("leaves", "edits", "n_edits", "n_tokens_after", "n_reencoded")]
    small_batches(trees)
    given = trees.sparkSession.sparkContext.broadcast(ranks)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PreTokenCounts(given.value)
        for batch in batches:
            texts, after, again, n_edits = batch.column("text").to_pylist(), batch.column("n_tokens").to_pylist(), [], []
            all_edits, all_leaves = batch.column("edits").to_pylist(), batch.column("leaves")
            for i, edits in enumerate(all_edits):
                n_edits.append(len(edits or []))
                again.append(0)
                if edits:
                    leaves = np.frombuffer(all_leaves[i].as_py(), dtype=np.int32).reshape(-1, 2)
                    tree = PreTokenTree(leaves[:, 0], leaves[:, 1])
                    new, again[i] = apply_edits(texts[i] or "", tree, [(e["start"] or 0, e["stop"] or 0, e["replacement"] or "") for e in edits], counter)
                    texts[i], after[i] = (new if texts[i] is not None or new else None), tree.tokens
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_edits, pa.int64()), pa.array(after, pa.int64()), pa.array(again, pa.int64())], names=[*keep, "n_edits", "n_tokens_after", "n_reencoded"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in trees.select(*keep).schema]
    return trees.mapInArrow(run, ", ".join([*kinds, "n_edits long, n_tokens_after long, n_reencoded long"]))


def redaction_edits(docs: DataFrame) -> DataFrame:
    """The columns of docs, and edits: mail addresses and long numbers give way to a mark, runs of blanks or line breaks to one, in time that follows the length of the text.

    A null or empty text has none. Repeated rows have their own. Columns named like it are replaced."""
    small_batches(docs)
    keep = plain_columns(docs, "edits")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("replacement", pa.string())]))
        for batch in batches:
            edits = []
            for text in batch.column("text").to_pylist():
                found = REDACTED.finditer(text or "")
                edits.append([{"start": m.start(), "stop": m.end(), "replacement": m.group()[0] if m.group()[0].isspace() else "<removed>"} for m in found])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(edits, kind)], names=[*keep, "edits"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return docs.mapInArrow(run, ", ".join([*kinds, f"edits {EDIT_TYPE}"]))
