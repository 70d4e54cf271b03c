"""Byte-level BPE by backtracking over longest matches.

Bytes are mapped to Latin-1 characters, so an Aho-Corasick automaton of all vocabulary entries finds
every token that starts at every byte in one pass. The encoder walks from left to right, takes the
longest token whose neighbour to the left is compatible with it, and steps back where none fits. Two
adjacent tokens are compatible when merging by rank would leave the border between them alone; this is
remembered per pair. A byte position found dead stays dead, so a piece costs linear time, and the only
sequence whose neighbours are all compatible is the one that merging by rank yields.

Defined results: a null text counts as empty and has no ids; an empty text has no ids; repeated rows each
get their own result; an empty table gives an empty table; a column that bears an output's name is replaced.
"""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import Column, DataFrame, functions as F, types as T

from refrain.llm.common import ship, whole_text, worker_cache

#: Remembered pieces (twice this many) and pairs per worker; a bound on memory, results do not depend on it.
REMEMBERED = 200_000
LONGEST_REMEMBERED = 64
ROWS = 256


class Vocabulary:
    """Token tables of a rank file: the automaton, each token's last merge, and compatible pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick
        self.ranks = ranks
        self.token_bytes = {i: b for b, i in ranks.items()}
        self.length = {i: len(b) for b, i in ranks.items()}
        self.parts = {i: None for i in self.token_bytes}
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[int, bool] = {}
        reachable = [i for i in sorted(self.token_bytes) if self._find_parts(i)]
        self.shorter = self._shorter({self.token_bytes[i]: i for i in reachable})
        self.automaton = ahocorasick.Automaton()
        for i in reachable:
            self.automaton.add_word(self.token_bytes[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pieces = Pieces(self)

    def _find_parts(self, token: int) -> bool:
        """Record the pair whose merge makes this token; False when merging by rank never makes it."""
        whole = self.token_bytes[token]
        if len(whole) == 1:
            return True
        for cut in range(len(whole) - 1, 0, -1):
            left, right = self.ranks.get(whole[:cut]), self.ranks.get(whole[cut:])
            if left is None or right is None or max(left, right) >= token:
                continue
            if self._keeps_border(left, right):
                self.parts[token], self.merged[left, right] = (left, right), token
                return True
        return False

    def _shorter(self, reachable: dict[bytes, int]) -> dict[int, int]:
        """Each token's longest shorter token that begins it, -1 for single bytes."""
        found = {}
        for whole, token in reachable.items():
            found[token] = next((reachable[whole[:n]] for n in range(len(whole) - 1, 0, -1) if whole[:n] in reachable), -1)
        return found

    def _keeps_border(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves the border between two finished tokens.

        Undo merges on the later-made side, one at a time. A merge over the border that ranks before
        everything still to be redone would have been taken first.
        """
        redone = None
        while True:
            across = self.merged.get((left, right))
            if across is not None and (redone is None or across < redone):
                return False
            undo_left = left > right
            parts = self.parts[left] if undo_left else self.parts[right]
            if parts is None:
                # This side is one byte; the other side may still come apart.
                undo_left = not undo_left
                parts = self.parts[left] if undo_left else self.parts[right]
                if parts is None:
                    return True
            if undo_left:
                redone, left = left, parts[1]
            else:
                # At equal rank the merge further left goes first, so the border wins ties here.
                redone, right = right + 1, parts[0]

    def compatible(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) >= REMEMBERED:
                self.fits.clear()
            known = self.fits[pair] = self._keeps_border(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, length, shorter, compatible = len(piece), self.length, self.shorter, self.compatible
        longest = [-1] * (n + 1)
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length[token]] = token  # ends ascend, so the longest stays
        alive = bytearray(b"\x01") * (n + 1)
        tokens: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = tokens[-1] if tokens else -1
            while token >= 0 and not (alive[at + length[token]] and (last < 0 or compatible(last, token))):
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                at += length[token]
                token = longest[at]
            else:
                alive[at] = 0
                token = tokens.pop()
                at -= length[token]
        return tokens

    def forget(self) -> None:
        self.pieces.clear()
        self.pieces.before = {}
        self.fits.clear()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, memoryview(ids).cast("I")))


class Pieces(dict):
    """Piece of text to its packed ids; remembers short pieces, the newest and the generation before."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.before = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        import array
        packed = self.before.get(piece)
        if packed is None:
            packed = array.array("I", self.vocabulary.encode_piece(piece.encode())).tobytes()
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[piece] = packed
        return packed


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def _shared(spark, path: str):
    """The rank file, read where the driver has it and sent once to each executor (a vocabulary, under 1 MB)."""
    with open(path, "rb") as f:
        data = f.read()
    return spark.sparkContext.broadcast(data), f"bpe_{hashlib.md5(data).hexdigest()}"


#: White space as Unicode lists it; the regex module's own class also takes the four separators U+001C to U+001F.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def spelled_out(pattern: str) -> str:
    """The pattern with its white-space classes written as Unicode's own list."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\s":
            out.append(SPACE if in_class else f"[{SPACE}]")
        elif two == r"\S":
            if in_class:
                raise ValueError("\\S inside a class is not supported")
            out.append(f"[^{SPACE}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            in_class = two[0] == "[" or (in_class and two[0] != "]")
            out.append(two[0])
            i -= 1
        i += 2
    return "".join(out)


def _added(df: DataFrame, value: Column, outs: list[str], maker) -> DataFrame:
    """``df`` with binary columns made from ``value`` by the functions ``maker()`` gives in the workers, each from the
    result before it; its last function ends a task.

    Rows leave in small batches, so that neither side ever holds the results of many texts at once.
    """
    kept = df.drop(*outs)
    schema = T.StructType([*kept.schema.fields, *[T.StructField(o, T.BinaryType()) for o in outs]])

    def run(batches):
        import pyarrow as pa
        *steps, done = maker()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                now, made = part.column(part.num_columns - 1), []
                for step in steps:
                    now = pa.array([step(v.as_py()) for v in now], pa.binary())
                    made.append(now)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=schema.names)
        done()

    return df.select(*[df[c] for c in kept.columns], value.alias("_value")).mapInArrow(run, schema)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add ``ids``: the text's token ids as little-endian unsigned 32-bit integers, no special tokens.

    ``decoded`` names a further column for the bytes that those ids stand for, decoded in the same pass.
    """
    ranks, key = _shared(df.sparkSession, ranks_path)
    split_by = spelled_out(pattern)

    def maker():
        import regex
        vocabulary = worker_cache(key, lambda: Vocabulary(read_ranks(ranks.value)))
        split, packed = regex.compile(split_by).findall, vocabulary.pieces.__getitem__
        # A worker lives on after the task; what it remembers should not.
        back = [vocabulary.decode] if decoded else []
        return (lambda t: b"".join(map(packed, split(t)))), *back, vocabulary.forget

    return _added(df, whole_text(text), [ids, decoded] if decoded else [ids], maker)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the bytes that packed ids stand for."""
    ranks, key = _shared(df.sparkSession, ranks_path)
    def maker():
        return worker_cache(key, lambda: Vocabulary(read_ranks(ranks.value))).decode, lambda: None

    return _added(df, F.coalesce(F.col(ids), F.lit(b"")), [out], maker)


ship(__name__)
