"""Edit-aware token counts.

A document is kept as segments that are cut before white space, so that no token spans two of
them, under a binary tree of character and token sums.  An edit (start, end, replacement) finds
the first and last segment it touches by descending the tree, joins them with the replacement,
adds the segment before if the joined text no longer begins at white space, counts only that text
again and updates the sums on the paths to the root.

``build`` gives every document its segments' lengths and counts; ``apply_edits`` takes documents
with such segments and an ordered array of edits and returns the new text, segments and totals.

Edge cases: a null or empty text has no tokens and one empty segment; null edits are none; edit
positions are code points of the text as the edits before left it and are clipped to it, an end
before its start is the start, a null replacement is empty; repeated rows are counted each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.tokens import WordTokenizer, default_path

#: Least characters of a segment.
SEGMENT = 256
_CUT = re.compile(r"[ \n]")
EDITS = "array<struct<start:bigint,end:bigint,replacement:string>>"


def segments(text: str, least: int = SEGMENT) -> list[str]:
    """The text in runs of ``least`` characters or more; each but the first begins with a blank or line end."""
    out, at = [], 0
    while True:
        m = _CUT.search(text, at + least)
        if m is None:
            out.append(text[at:])
            return out
        out.append(text[at:m.start()])
        at = m.start()


class CountedText:
    """A text's segments under a tree of (characters, tokens) sums."""

    def __init__(self, parts: list[str], counts: list[int]):
        self.parts = parts
        self.width = 1 << max(0, (len(parts) - 1).bit_length())
        self.chars = [0] * (2 * self.width)
        self.tokens = [0] * (2 * self.width)
        for i, (p, c) in enumerate(zip(parts, counts)):
            self.chars[self.width + i], self.tokens[self.width + i] = len(p), c
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, at: int) -> tuple[int, int]:
        """Segment that holds the character ``at`` (the last, past the end) and the place in it."""
        node = 1
        at = min(at, self.chars[1])
        while node < self.width:
            left = self.chars[2 * node]
            if at < left or not self.chars[2 * node + 1]:
                node = 2 * node
            else:
                at, node = at - left, 2 * node + 1
        return node - self.width, at

    def put(self, leaf: int, part: str, count: int) -> None:
        self.parts[leaf] = part
        node = self.width + leaf
        self.chars[node], self.tokens[node] = len(part), count
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, start: int, end: int, replacement: str, tok: WordTokenizer) -> int:
        """Apply one edit; the number of characters counted again."""
        start = max(0, min(start, self.chars[1]))
        end = max(start, min(end, self.chars[1]))
        (a, x), (b, y) = self.find(start), self.find(end)
        new = self.parts[a][:x] + replacement + self.parts[b][y:]
        for i in range(b, a, -1):
            if self.parts[i]:
                self.put(i, "", 0)
        # the border before must still be at white space, else the segment before joins in
        before = a - 1
        while new and new[0] not in " \n" and before >= 0:
            if self.parts[before]:
                new = self.parts[before] + new
                self.put(a, "", 0)
                a = before
            before -= 1
        self.put(a, new, tok.count(new))
        return len(new)


def _known(row: tuple) -> list[str]:
    """A row's text at its segments' lengths."""
    out, at = [], 0
    for n in row[3]:
        out.append((row[1] or "")[at:at + n])
        at += n
    return out


def _counts(tok: WordTokenizer, parts: list[list[str]]) -> list[list[int]]:
    """Token counts of the segments of many texts."""
    sizes: list[int] = []
    for _, _, _, at in tok.batch(pa.array([p for x in parts for p in x], pa.large_string())):
        sizes += [(y - x) // 4 for x, y in zip(at, at[1:])]
    out, i = [], 0
    for x in parts:
        out.append(sizes[i:i + len(x)])
        i += len(x)
    return out


def _map(docs: DataFrame, edits_col: str | None, tokenizer_path: str, keep: bool, known: bool) -> DataFrame:
    fields = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("n_edits", pa.int32()),
              ("edited_chars", pa.int64()), ("edited_tokens", pa.int64()), ("recounted_chars", pa.int64())]
    ddl = ("doc_id long, n_chars long, n_tokens long, n_edits int, edited_chars long, edited_tokens long, "
           "recounted_chars long")
    if keep:
        fields += [("text", pa.string()), ("segment_chars", pa.list_(pa.int32())),
                   ("segment_tokens", pa.list_(pa.int32()))]
        ddl += ", text string, segment_chars array<int>, segment_tokens array<int>"
    schema = pa.schema(fields)
    cols = [F.col("doc_id").cast("long"), F.col("text"),
            (F.col(edits_col) if edits_col else F.lit(None)).cast(EDITS).alias("__edits")]
    cols += [F.col("segment_chars"), F.col("segment_tokens")] if known else []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = WordTokenizer.of(tokenizer_path)
        for b in batches:
            out = []
            rows = list(zip(*(b.column(i).to_pylist() for i in range(b.num_columns))))
            cut = [_known(r) if known and r[3] else segments(r[1] or "") for r in rows]
            counts_of = _counts(tok, [[] if known and r[3] else c for r, c in zip(rows, cut)])
            for row, parts, counts in zip(rows, cut, counts_of):
                doc, text, edits = row[0], row[1] or "", row[2] or []
                if known and row[3]:
                    counts = row[4]
                tree = CountedText(parts, counts)
                n, again = tree.tokens[1], 0
                for e in edits:
                    again += tree.edit(e["start"] or 0, e["end"] or 0, e["replacement"] or "", tok)
                got = [doc, len(text), n, len(edits), tree.chars[1], tree.tokens[1], again]
                if keep:
                    w = tree.width
                    live = [i for i, p in enumerate(tree.parts) if p] or [0]
                    got += ["".join(tree.parts), [tree.chars[w + i] for i in live], [tree.tokens[w + i] for i in live]]
                out.append(got)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return docs.select(*cols).mapInArrow(work, ddl)


def build(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Documents with their segments and token sums: the state that edits are applied to."""
    return _map(docs, None, tokenizer_path or default_path(), True, False)


def attach_edits(docs: DataFrame, edits: DataFrame, out: str = "edits") -> DataFrame:
    """``docs`` with the array ``out`` (in place of a column of that name), from rows (doc_id, seq, start, end,
    replacement) in ``seq`` order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "replacement"))),
                          lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"),
                                             e["replacement"].alias("replacement")))
    return docs.drop(out).join(edits.groupBy("doc_id").agg(ordered.alias(out)), "doc_id", "left")


def apply_edits(docs: DataFrame, edits_col: str = "edits", tokenizer_path: str | None = None,
                keep: bool = False, state: bool = False) -> DataFrame:
    """Counts before and after each document's edits; with ``keep`` also the new text and segments.

    With ``state`` the rows are those that :func:`build` or ``keep`` returned, and their ``segment_chars`` and
    ``segment_tokens`` are used; otherwise columns of these names are any columns and texts are counted anew.
    """
    return _map(docs, edits_col, tokenizer_path or default_path(), keep, state)
