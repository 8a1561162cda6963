"""SentencePiece encoding and decoding (BPE models with byte fallback) by backtracking.

The merges of such a model always join the neighbours whose union is the best piece, the leftmost first where pieces are equally
good. A sequence of pieces is what they end in exactly if every piece and every two neighbours, merged anew on their own, stay
what they are: until a merge crosses the border of two neighbours, both are merged as if they stood alone. So a text is encoded
without its merges: an Aho-Corasick automaton finds the longest piece that begins at every place; the encoder takes the longest
piece that agrees with the one before it (agreement is found by merging the two anew, and remembered), else the next shorter
piece that is its prefix, and steps back where none is left. What a prefix of a text is encoded to does not depend on what
follows, so a place from where no way leads on is marked as failed and never tried again: a bit for each place, and time in
proportion to the text.

Texts are cut before white space, between letters and signs and at line ends, where no piece of the model crosses; cuts are encoded
once and remembered, MAX_CACHED of them at most. Characters that are no piece become their bytes.

Defined cases: null and empty texts have no ids; control pieces that occur in a text are ordinary text; texts of any length are
encoded whole; repeated rows are encoded alike; empty tables have no rows. Extra columns pass through under whatever names;
those named like a result are replaced.
"""

import codecs
import re
from array import array
from functools import lru_cache
from itertools import groupby, pairwise
from string import ascii_letters

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import table, trimmed

#: Cuts, and pairs of pieces, that a worker remembers at most; then it starts anew.
MAX_CACHED = 200_000
#: Characters of the longest cut that is remembered.
MAX_CUT = 60

SPACE = "▁"
NEVER = float("inf")
#: The kinds of pieces in model files that are read here.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
_UNKNOWN_SHOWN = " ⁇ "


def read_model(path: str) -> tuple:
    """(pieces, scores, kinds, whether a space is put before a text) of a model file."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    n, t = model.normalizer_spec, model.trainer_spec
    kinds = tuple(p.type for p in model.pieces)
    if t.model_type != 2 or not t.byte_fallback or t.treat_whitespace_as_suffix or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("only BPE models with byte fallback and without pieces defined by users are read")
    if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces:
        raise ValueError("only models that leave texts as they are are read")
    return tuple(p.piece for p in model.pieces), tuple(p.score for p in model.pieces), kinds, n.add_dummy_prefix


class Pieces:
    """Encodes and decodes with one model; what is encoded is remembered within bounds."""

    def __init__(self, pieces: tuple, scores: tuple, kinds: tuple, prefix: bool) -> None:
        self.prefix = SPACE if prefix else ""
        self.id = {p: i for i, (p, kind) in enumerate(zip(pieces, kinds, strict=True)) if kind == NORMAL}
        self.rank = {p: -scores[i] for p, i in self.id.items()}
        self.byte = {int(p[3:5], 16): i for i, (p, kind) in enumerate(zip(pieces, kinds, strict=True)) if kind == BYTE}
        self.control = {i for i, kind in enumerate(kinds) if kind == CONTROL}
        self.shown = [self._bytes(p, kind) for p, kind in zip(pieces, kinds, strict=True)]
        self.leading = [kind == NORMAL and p.startswith(SPACE) for p, kind in zip(pieces, kinds, strict=True)]
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        inside = {a + b for p in self.id for a, b in pairwise(p)}
        chars = {c for p in self.id for c in p}
        self.cut = re.compile(self._cuts(inside, chars)).findall
        self.reset()

    @staticmethod
    def _bytes(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == CONTROL else (_UNKNOWN_SHOWN if kind == UNKNOWN else piece.replace(SPACE, " ")).encode()

    @staticmethod
    def _cuts(inside: set[str], chars: set[str]) -> str:
        """A pattern of the parts of a text that no piece leaves; inside: all pairs of neighbours within pieces.

        Parts begin before white space, and where characters that stand beside each other in pieces, the ASCII letters among them,
        meet others.
        """
        if any(a != SPACE and b == SPACE for a, b in inside):
            return r"(?s).+"
        near: dict[str, set[str]] = {}
        for a, b in inside:
            if a != SPACE:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        letters, rest = set(ascii_letters), [*ascii_letters]
        while rest:
            new = near.get(rest.pop(), set()) - letters
            letters |= new
            rest.extend(new)
        letter = "".join(map(re.escape, sorted(letters - {"\n"})))
        line = "" if "\n" in chars else "\n"
        parts = [rf"{SPACE}+(?:[{letter}]+|[^{SPACE}{line}{letter}]*)", rf"[{letter}]+", rf"[^{SPACE}{line}{letter}]+", line]
        return "|".join(filter(None, parts))

    def reset(self) -> None:
        pieces = self

        class Cuts(dict):
            def __missing__(self, cut: str) -> bytes:
                coded = pieces.encode_cut(cut)
                if len(cut) <= MAX_CUT:
                    self[cut] = coded
                return coded

        self.cuts, self.agreed, self.steps = Cuts(), {}, {}

    def forget(self) -> None:
        """Keeps the memory bounded."""
        if max(len(self.cuts), len(self.agreed), len(self.steps)) > MAX_CACHED:
            self.reset()

    def replayed(self, piece: str) -> list[tuple] | None:
        """How a piece's characters merge: (rank, what then ends it, what then begins it) by step; None if they end in anything else.

        The best union comes first, of equally good ones the leftmost.
        """
        if piece in self.steps:
            return self.steps[piece]
        parts, steps, rank = list(piece), [], self.rank
        while len(parts) > 1:
            unions = [rank.get(a + b, NEVER) for a, b in pairwise(parts)]
            best = min(unions)
            if best == NEVER:
                break
            at = unions.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append((best, parts[-1], parts[0]))
        steps = steps if len(parts) == 1 else None
        if len(piece) == 1 or piece in self.id:  # as many as the vocabulary has, and characters
            self.steps[piece] = steps
        return steps

    def agrees(self, before: str | None, piece: str) -> bool:
        """Whether two pieces, or the first piece of a text, stay what they are when merged anew."""
        known = self.agreed.get((before, piece))
        if known is None:
            known = self.agreed[before, piece] = self._agree(before, piece)
        return known

    def _agree(self, before: str | None, piece: str) -> bool:
        """Merges both again, always the better next step, until a union across the border comes first."""
        right = self.replayed(piece)
        if before is None or right is None:
            return right is not None
        left, rank = self.replayed(before), self.rank
        end, begin, i, j = before[-1], piece[0], 0, 0
        while True:
            across = rank.get(end + begin, NEVER)
            a = left[i][0] if i < len(left) else NEVER
            b = right[j][0] if j < len(right) else NEVER
            if across < a and across <= b and across != NEVER:
                return False
            if a == b == NEVER:
                return True
            if a <= b:
                end = left[i][1]
                i += 1
            else:
                begin = right[j][2]
                j += 1

    def shorter(self, piece: str) -> str | None:
        """The longest proper prefix that is a piece, or else its first character."""
        for n in range(len(piece) - 1, 0, -1):
            if piece[:n] in self.id or n == 1:
                return piece[:n]
        return None

    def split(self, text: str) -> list[str]:
        """The pieces of a text, by backtracking."""
        longest = list(text)  # a character that begins no piece stands for itself
        for end, piece in self.automaton.iter(text):
            at = end - len(piece) + 1
            if len(piece) > len(longest[at]):
                longest[at] = piece
        failed = bytearray((len(text) >> 3) + 1)
        taken, at = [], 0
        piece = longest[0] if text else None
        while at < len(text):
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1 and self.agrees(taken[-1] if taken else None, piece):
                taken.append(piece)
                at = end
                piece = longest[at] if at < len(text) else None
                continue
            piece = self.shorter(piece)
            if piece is None:  # nothing leads on from here
                failed[at >> 3] |= 1 << (at & 7)
                piece = taken.pop()
                at -= len(piece)
        return taken

    def encode_cut(self, cut: str) -> bytes:
        ids, get = array("i"), self.id.get
        for piece in self.split(cut):
            if (i := get(piece)) is not None:
                ids.append(i)
            else:
                ids.extend(self.byte[b] for b in piece.encode("utf-8", "replace"))
        return ids.tobytes()

    def encode(self, texts: list) -> list[bytes]:
        """Ids of each text, as 32-bit integers."""
        get = self.cuts.__getitem__
        out = [b"".join(map(get, self.cut(self.prefix + t.replace(" ", SPACE)))) if t else b"" for t in texts]
        self.forget()
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; every byte that is no UTF-8 becomes U+FFFD, and so do bytes of a character around a control piece."""
        if not self.control.isdisjoint(ids):
            parts = [list(part) for control, part in groupby(ids, self.control.__contains__) if not control]
            return "".join(self._shown(part, i == 0) for i, part in enumerate(parts))
        return self._shown(ids, True)

    def _shown(self, ids: list[int], begins: bool) -> str:
        data = b"".join(map(self.shown.__getitem__, ids))
        return (data[1:] if begins and self.prefix and ids and self.leading[ids[0]] else data).decode("utf-8", "quillspark_each_byte")


# UnicodeDecodeError.end is not used: each byte is replaced on its own.
codecs.register_error("quillspark_each_byte", lambda e: ("�", e.start + 1))


@lru_cache(maxsize=2)
def _pieces(model: tuple) -> Pieces:
    return Pieces(*model)


def piece_code(df: DataFrame, text: str = "text", ids: str = "ids", into: str = "decoded", path: str | None = None, keep: bool = True) -> DataFrame:
    """df with the ids of every whole text (array<int>) and the text decoded from these.

    path: the model file, read on the driver and broadcast (a vocabulary: its size does not depend on the data); keep=False leaves
    the text out.
    """
    import public_tokenizers

    model = df.sparkSession.sparkContext.broadcast(read_model(path or public_tokenizers.path("piece_bpe_32k.model")))
    gone = {ids.lower(), into.lower()} - {text.lower()}
    fields = [f for f in df.schema.fields if f.name.lower() not in gone and (keep or f.name != text)]
    schema = T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(into, T.StringType())])

    def run(batches):
        coder = _pieces(model.value)
        for batch in batches:
            for part in slices(batch, text):
                coded = coder.encode(part.column(text).to_pylist())
                lists = [np.frombuffer(c, np.int32) for c in coded]
                offsets = np.cumsum([0, *map(len, lists)])
                values = np.concatenate(lists) if lists else np.zeros(0, np.int32)
                decoded = [coder.decode(x.tolist()) for x in lists]
                columns = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), *columns], names=schema.names)
        coder.reset()

    return df.mapInArrow(trimmed(run), schema)


def op12(spark, sf_dir: str) -> DataFrame:
    """Encode and decode all documents; digests of both."""
    coded = piece_code(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=False)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
