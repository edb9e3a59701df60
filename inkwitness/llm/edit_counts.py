"""Token counts that follow edits: a segment tree over each document's pre-tokens.

A single space between two other characters always ends one pre-token and begins the next, whatever stands further off.
Leaves are cut there, so a leaf's tokens are those of its own text, and a document's are the sum of its leaves'. Every
inner node holds the sums of characters and tokens of its two children. An edit goes down the tree by characters to the
leaves it touches, together with a neighbour whose boundary loses its space or one of the characters beside it; that
region alone is encoded again, and the sums above it are renewed.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches

#: Characters of a leaf, about; a run without a cut makes it longer.
LEAF = 512
_CUT = regex.compile(r"(?<=\S)(?= \S)")

EDIT = "struct<at: long, gone: long, text: string>"


@functools.lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def cut(text: str, leaf: int = LEAF) -> list[str]:
    """``text`` in leaves of about ``leaf`` characters, each but the first beginning with its boundary's space."""
    out, start = [], 0
    while len(text) - start > leaf:
        found = _CUT.search(text, start + leaf)
        if not found:
            break
        out.append(text[start:found.start()])
        start = found.start()
    out.append(text[start:])
    return out


class Tree:
    """Leaves of a text and, over them, the sums of characters and tokens; node 1 is the root, 2i and 2i + 1 are below i."""

    def __init__(self, leaves: list[str], tokens: list[int]):
        self.leaves, self.encoded = leaves, 0
        self._sum([(len(leaf), count) for leaf, count in zip(leaves, tokens, strict=True)])

    def _sum(self, sums: list[tuple[int, int]]) -> None:
        self.width = 1 << max(0, len(sums) - 1).bit_length()
        self.node = [(0, 0)] * self.width + sums + [(0, 0)] * (self.width - len(sums))
        for i in range(self.width - 1, 0, -1):
            self._renew(i)

    def _renew(self, i: int) -> None:
        (a, b), (c, d) = self.node[2 * i], self.node[2 * i + 1]
        self.node[i] = (a + c, b + d)

    @property
    def chars(self) -> int:
        return self.node[1][0]

    @property
    def tokens(self) -> int:
        return self.node[1][1]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at ``place`` (the last one at the end), and the place where it begins."""
        i, start = 1, 0
        while i < self.width:
            i, left = 2 * i, self.node[2 * i][0]
            if place - start >= left and self.node[i + 1][0]:
                i, start = i + 1, start + left
        return i - self.width, start

    def edit(self, at: int, gone: int, text: str, count) -> None:
        """Put ``text`` in the place of ``gone`` characters at ``at``; both are kept inside the text."""
        at = min(max(at, 0), self.chars)
        end = min(at + max(gone, 0), self.chars)
        # a boundary needs the space it stands before and the characters on both sides
        first, start = self.leaf_at(max(0, at - 2))
        last, last_start = self.leaf_at(min(self.chars, end + 2))
        old = "".join(self.leaves[first:last + 1])
        new = cut(old[:at - start] + text + old[end - start:])
        sums = [(len(leaf), count(leaf)) for leaf in new]
        self.encoded += sum(map(len, new))
        if len(new) == last - first + 1:
            self.leaves[first:last + 1] = new
            self.node[self.width + first:self.width + last + 1] = sums
            low, high = (self.width + first) // 2, (self.width + last) // 2
            while low:
                for i in range(low, high + 1):
                    self._renew(i)
                low, high = low // 2, high // 2
        else:
            kept = self.node[self.width:self.width + len(self.leaves)]
            self.leaves[first:last + 1] = new
            self._sum(kept[:first] + sums + kept[last + 1:])


def counted_edits(docs: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    """Token counts of each document before and after its edits, with how little was encoded again.

    ``docs`` has doc_id, text and ``edits``, an array of (at, gone, text) in code points: in order, ``gone`` characters at
    ``at`` of the text as it is by then give way to ``text``. Places beyond the text mean its end; a null edit, or one
    with a null part, does nothing; null texts are empty. Other columns are ignored. Returns doc_id, n_edits (of those
    that do something), chars_before, tokens_before, chars_after, tokens_after, chars_encoded (by the edits), leaves.
    Special tokens' strings are ordinary text. The edits of a document apply one after another, in the task of its row.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encode = encoding(tokenizer, pattern).encode_ordinary
        count = lambda text: len(encode(text))
        columns: list[list[int | None]] = [[] for _ in range(8)]
        for doc_id, text, edits in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            leaves = cut(text or "")
            tree = Tree(leaves, [count(leaf) for leaf in leaves])
            before = (tree.chars, tree.tokens)
            sound = [e for e in edits or [] if e and None not in (e["at"], e["gone"], e["text"])]
            for e in sound:
                tree.edit(e["at"], e["gone"], e["text"], count)
            for column, value in zip(columns, (doc_id, len(sound), *before, tree.chars, tree.tokens, tree.encoded, len(tree.leaves)), strict=True):
                column.append(value)
        names = ["doc_id", "n_edits", "chars_before", "tokens_before", "chars_after", "tokens_after", "chars_encoded", "leaves"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return over_batches(docs.select(F.col("doc_id").cast("long"), "text", F.col("edits").cast(f"array<{EDIT}>")), run,
                        "doc_id long, n_edits long, chars_before long, tokens_before long, chars_after long, tokens_after long, "
                        "chars_encoded long, leaves long")


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with ``edits``: the rows (doc_id, edit_no, at, gone, text) of each document, gathered in order of edit_no."""
    gathered = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("edit_no", "at", "gone", "text"))).alias("e"))
    ready = gathered.select("doc_id", F.transform("e", lambda e: F.struct(e["at"].alias("at"), e["gone"].alias("gone"), e["text"].alias("text"))).alias("edits"))
    return docs.drop("edits").join(ready, "doc_id", "left")
