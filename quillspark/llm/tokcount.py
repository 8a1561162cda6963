"""Edit-aware token counts: a segment tree of pre-tokens for each document, in which edits re-encode only what they touch.

The pre-tokens of a text are dealt into leaves; a binary tree over the leaves holds sums of characters and tokens. An edit
(position, characters to delete, text to insert; in code points of the text as it is then) finds its leaf by the character
sums, starts some pre-tokens earlier (the boundary context: what a pre-token is depends on the text from its start on, and no
more than a few characters behind it), and stops where a new boundary meets an old one behind the edit. Only the pre-tokens
between are encoded; the sums above the leaves touched are updated. A leaf that grows too large has the tree built anew.

Defined cases: a null text is empty; null edits are none; positions and lengths are clipped to the text; a null insertion is
empty; a text that holds a special token before or after an edit is counted anew as a whole (special tokens cut texts before
pre-tokens do); repeated rows are counted one by one. Extra columns pass through; one named like the result is replaced.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoder, slices, tokenizer_file
from .common import table

LEAF = 64
CONTEXT = 3
SLICE = 3_000_000

RESULT = T.StructType([T.StructField(n, T.LongType()) for n in ("n_before", "n_tokens", "n_pretokens", "n_reencoded", "n_edits")])
EDITS = "array<struct<at:bigint,remove:bigint,insert:string>>"


class PreTokenTree:
    """Pre-tokens (their numbers and lengths) in leaves, with a binary tree of sums over the leaves."""

    def __init__(self, numbers: np.ndarray, lengths: np.ndarray) -> None:
        self.build(numbers, lengths)

    def build(self, numbers: np.ndarray, lengths: np.ndarray) -> None:
        cuts = range(0, max(1, len(numbers)), LEAF)
        self.numbers = [numbers[c : c + LEAF] for c in cuts]
        self.lengths = [lengths[c : c + LEAF] for c in cuts]
        self.width = 1 << (len(self.numbers) - 1).bit_length()
        self.chars = self._sums([int(x.sum()) for x in self.lengths])
        self.tokens = None

    def _sums(self, leaves: list[int]) -> np.ndarray:
        tree = np.zeros(2 * self.width, np.int64)
        tree[self.width : self.width + len(leaves)] = leaves
        level = self.width
        while level > 1:
            tree[level // 2 : level] = tree[level : 2 * level].reshape(-1, 2).sum(1)
            level //= 2
        return tree

    def count(self, of: np.ndarray) -> int:
        """Fills the token sums; of: tokens of each pre-token number."""
        self.tokens = self._sums([int(of[x].sum()) for x in self.numbers])
        return int(self.tokens[1])

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character, and the characters before that leaf."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if at >= before + self.chars[node] and self.chars[node + 1]:
                before += int(self.chars[node])
                node += 1
        return min(node - self.width, len(self.numbers) - 1), before

    def _set(self, tree: np.ndarray, leaf: int, value: int) -> None:
        node = self.width + leaf
        change = value - tree[node]
        while node:
            tree[node] += change
            node //= 2

    def update_tokens(self, leaf: int, of: np.ndarray) -> None:
        self._set(self.tokens, leaf, int(of[self.numbers[leaf]].sum()))

    def edit(self, text: str, at: int, remove: int, insert: str, scan, number) -> tuple[str, list[int] | None, int]:
        """The new text, the leaves that changed (None: all), and how many pre-tokens were encoded anew."""
        new = text[:at] + insert + text[at + remove :]
        leaf, base = self.find(at)
        first = leaf
        inside = int(np.searchsorted(base + np.cumsum(self.lengths[leaf]), at, "right"))
        back = inside - CONTEXT
        while back < 0 and first:  # the context may begin in leaves before
            first -= 1
            back += len(self.lengths[first])
            base -= int(self.chars[self.width + first])
        back = max(0, back)
        start = base + int(self.lengths[first][:back].sum())
        # old boundaries from here on, a leaf at a time, shifted to where they are in the new text
        shift, behind, last = len(insert) - remove, at + len(insert), leaf
        end = base + sum(int(self.chars[self.width + i]) for i in range(first, leaf + 1))

        def boundaries(i: int, from_: int) -> set[int]:
            return {int(x) + shift for x in from_ + np.r_[0, np.cumsum(self.lengths[i])]}

        old, at_leaf = set(), base
        for i in range(first, leaf + 1):
            old |= boundaries(i, at_leaf)
            at_leaf += int(self.chars[self.width + i])
        found, sizes, p, meets = [], [], start, None
        for m in scan(new, start):
            if p >= behind and p - shift >= at + remove:
                while end + shift < p and last + 1 < len(self.numbers):
                    last += 1
                    old |= boundaries(last, end)
                    end += int(self.chars[self.width + last])
                if p in old:
                    meets = p
                    break
            found.append(number(m.group()))
            sizes.append(m.end() - m.start())
            p = m.end()
        if meets is None:  # up to the end of the text
            last, tail_numbers, tail_lengths = len(self.numbers) - 1, np.zeros(0, np.uint32), np.zeros(0, np.int64)
        else:
            while end + shift < meets and last + 1 < len(self.numbers):
                last += 1
                end += int(self.chars[self.width + last])
            ends = end - int(self.lengths[last].sum()) + np.r_[0, np.cumsum(self.lengths[last])] + shift
            k = int(np.flatnonzero(ends == meets)[0]) if (ends == meets).any() else len(self.numbers[last])
            tail_numbers, tail_lengths = self.numbers[last][k:], self.lengths[last][k:]
        numbers = np.concatenate([self.numbers[first][:back], np.array(found, np.uint32), tail_numbers])
        lengths = np.concatenate([self.lengths[first][:back], np.array(sizes, np.int64), tail_lengths])
        if len(numbers) > 8 * LEAF:
            self.build(np.concatenate([*self.numbers[:first], numbers, *self.numbers[last + 1 :]]), np.concatenate([*self.lengths[:first], lengths, *self.lengths[last + 1 :]]))
            return new, None, len(found)
        for i in range(first, last + 1):
            self.numbers[i], self.lengths[i] = (numbers, lengths) if i == first else (numbers[:0], lengths[:0])
            self._set(self.chars, i, int(self.lengths[i].sum()))
        return new, list(range(first, last + 1)), len(found)

    def size(self) -> int:
        return sum(map(len, self.numbers))


class EditCounter:
    """Counts the tokens of texts before and after edits with an Encoder."""

    def __init__(self, enc) -> None:
        self.enc = enc

    def _tree(self, text: str) -> PreTokenTree:
        parts = self.enc.find(text)
        return PreTokenTree(np.fromiter(map(self.enc.index.__getitem__, parts), np.uint32, len(parts)), np.fromiter(map(len, parts), np.int64, len(parts)))

    def _lengths(self) -> np.ndarray:
        self.enc.learn()
        return np.fromiter(map(len, self.enc.ids), np.int64, len(self.enc.ids)) // 4

    def count(self, texts: list, edits: list) -> list[dict]:
        special = list(self.enc.merges.special)
        holds = lambda t: any(s in t for s in special)
        state = [[t or "", None, 0, None] for t in texts]  # text, tree (None: whole texts), pre-tokens encoded anew, before
        for s in state:
            s[1] = None if holds(s[0]) else self._tree(s[0])
            s[3] = self.enc.words(s[0]) if s[1] is None else None
        of = self._lengths()
        before = [s[1].count(of) if s[1] else int(of[np.array(s[3], np.int64)].sum()) for s in state]
        touched: list[set | None] = [set() for _ in state]
        finder = self.enc.finder
        for k, (s, todo) in enumerate(zip(state, edits, strict=True)):
            for e in todo or []:
                if e is None:
                    continue
                text = s[0]
                at = min(max(0, e["at"] or 0), len(text))
                remove = min(max(0, e["remove"] or 0), len(text) - at)
                insert = e["insert"] or ""
                if s[1] is not None:
                    new, leaves, n = s[1].edit(text, at, remove, insert, finder, self.enc.index.__getitem__)
                    if holds(new):
                        s[1] = None
                    elif leaves is None:
                        touched[k] = None
                    elif touched[k] is not None:
                        touched[k] |= set(leaves)
                    s[2] += n
                else:
                    new = text[:at] + insert + text[at + remove :]
                s[0] = new
        for s in state:
            s[3] = self.enc.words(s[0]) if s[1] is None else None
        of = self._lengths()
        out = []
        for s, b, leaves, todo in zip(state, before, touched, edits, strict=True):
            if s[1] is None:
                numbers = np.array(s[3], np.int64)
                out.append({"n_before": b, "n_tokens": int(of[numbers].sum()), "n_pretokens": len(numbers), "n_reencoded": len(numbers)})
            else:
                if leaves is None:
                    s[1].count(of)
                else:
                    for leaf in leaves:
                        s[1].update_tokens(leaf, of)
                out.append({"n_before": b, "n_tokens": int(s[1].tokens[1]), "n_pretokens": s[1].size(), "n_reencoded": s[2]})
            out[-1]["n_edits"] = sum(e is not None for e in todo or [])
        self.enc.forget()
        return out


def count_tokens(df: DataFrame, text: str = "text", edits: str | None = None, into: str = "token_counts", path: str | None = None, keep: bool = True) -> DataFrame:
    """df with n_before and n_tokens (before and after its edits, a column of (at, remove, insert) applied in order), n_pretokens, n_reencoded, n_edits."""
    source, pattern = tokenizer_file(df.sparkSession, path)
    df = df.drop(*[c for c in df.columns if c.lower() == into.lower()])
    fields = [f for f in df.schema.fields if keep or f.name not in (text, edits)]
    kind = pa.struct([(f.name, pa.int64()) for f in RESULT.fields])

    def run(batches):
        counter = EditCounter(encoder(source.value, pattern))
        for batch in batches:
            for part in slices(batch, text, SLICE):
                texts = part.column(text).to_pylist()
                rows = counter.count(texts, part.column(edits).to_pylist() if edits else [None] * len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), pa.array(rows, kind)], names=[*(f.name for f in fields), into])

    return df.mapInArrow(run, T.StructType([*fields, T.StructField(into, RESULT)]))


def sample_edits(text):
    """Three edits of a text: a title in front, a word in its first third, a cut in its last third."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("bigint")
    edit = lambda at, remove, insert: F.struct(at.cast("bigint").alias("at"), F.lit(remove).cast("bigint").alias("remove"), F.lit(insert).alias("insert"))
    return F.array(edit(F.lit(0), 0, "Title: "), edit(F.floor(n / 3), 7, " revised"), edit(F.floor(n * 2 / 3), 20, "")).cast(EDITS)


def op7(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents, before and after three edits of each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs.withColumn("edits", sample_edits(F.col("text"))), edits="edits", keep=False)
    return counted.select("doc_id", "token_counts.*")
