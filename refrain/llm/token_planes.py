"""Token ids in a binary format of bit-plane shuffled blocks.

Documents are dealt to parts by ranges of doc_id and sorted in them, so the parts in order hold all documents in
ascending doc_id. A task encodes its part's texts one after the other, appends the end id to each, and cuts the stream
of ids into chunks of a fixed number of ids; only a part's last chunk is shorter. A chunk's ids, as little-endian
unsigned 32-bit integers, are transposed into four byte planes (or 32 bit planes), and each plane is compressed by
zstandard. Ids below 65,536 so leave two planes of zeros, which cost nothing.

A stored row is a chunk: ``payload`` is the binary block (header, sizes of the planes, planes), which can be read by
itself, and the other columns are the chunk index: part, number, first id, number of ids, checksum, and the pieces of
documents it holds. They are columns of their own, so looking a place up reads no payload. Tables are written by Spark,
whose commit drops what lost tasks left.

White space borders are borders of the tokenizer's words, so words (up to ASCII blanks) are encoded by the tokenizers
library once and remembered; memory for that is bounded and results do not depend on it. Texts are encoded in stretches of
about a million characters, cut at blanks.

Reading decodes every chunk by itself. The checksums of a document's pieces are joined arithmetically (a CRC is linear),
so a document that spans chunks needs no chunk beside another.

Defined results: a null text counts as empty and holds the end id alone; documents of one doc_id follow each other by a
hash of the text, null ids come first; repeated rows are documents of their own; an empty table gives empty tables;
extra columns are not read. Strings that look like special tokens get the ids the library gives them by default.
"""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import DataFrame, Window as W, functions as F

from refrain.llm.common import ship, stage, stretches, whole_text, worker_cache

END_ID, CHUNK, LEVEL = 2, 1 << 16, 3
MAGIC = b"TKPL"
HEADER = "<4sBBHI"  # magic, kind of plane, bytes an id, planes, ids
KINDS = {"byte": 8, "bit": 32}
#: Words remembered (twice this many at most) and their longest length; bounds on memory, results do not depend on them.
REMEMBERED, LONGEST_REMEMBERED, STRETCH = 300_000, 48, 1 << 20
#: ASCII blanks as one blank, and A-Z lowered besides; signs that may follow a word.
BLANKS = bytes(32 if b in (9, 10, 13) else b for b in range(256))
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in BLANKS)
SIGNS = b".,;:!?)"

_STORED = ("part int, chunk int, first long, n int, crc32 long, payload binary, "
           "pieces array<struct<nth:long,doc_id:long,start:long,at:int,n:int,whole:boolean>>")
_PIECE = "part int, nth long, doc_id long, start long, seq int, n int, crc32 long, whole boolean"


# ---- the block -----------------------------------------------------------------------

def pack(ids, planes: str = "byte", level: int = LEVEL) -> bytes:
    """A chunk of ids as a binary block."""
    import numpy as np
    import zstandard
    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        rows, kind = octets.T, 0
    else:
        rows, kind = np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1, bitorder="little"), 1
    squeeze = zstandard.ZstdCompressor(level=level).compress
    parts = [squeeze(np.ascontiguousarray(r).tobytes()) for r in rows]
    return struct.pack(HEADER, MAGIC, kind, 4, len(parts), len(octets)) + struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


def unpack(block: bytes):
    """The ids of a binary block."""
    import numpy as np
    import zstandard
    magic, kind, _, planes, n = struct.unpack_from(HEADER, block)
    if magic != MAGIC:
        raise ValueError("not a block of token planes")
    sizes = struct.unpack_from(f"<{planes}I", block, struct.calcsize(HEADER))
    at, opened, widen = struct.calcsize(HEADER) + 4 * planes, [], zstandard.ZstdDecompressor().decompress
    for size in sizes:
        opened.append(np.frombuffer(widen(block[at:at + size]), dtype=np.uint8))
        at += size
    if kind == 0:
        octets = np.stack(opened, axis=1)
    else:
        octets = np.packbits(np.stack([np.unpackbits(p, count=n, bitorder="little") for p in opened], axis=1), axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").ravel()


# ---- encoding ------------------------------------------------------------------------

class Words(dict):
    """Packed ids of words (as bytes), encoded by the library when first met.

    The tokenizer lower-cases and splits letters from signs, so A-Z are lowered first, and signs behind a plain letter are
    words of their own. Neither is done where it could make a special token or where the letter could change its kind.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.encode, self.model, self.before = tokenizer.encode, tokenizer.model.tokenize, {}
        self[b""] = b""
        probe = "Ab, cd.\tIng 12 <|endoftext|>the\n!!"
        if list(memoryview(self.text(probe.encode())).cast("I")) != self.encode(probe, add_special_tokens=False).ids:
            raise ValueError("the tokenizer doesn't lower-case, or its words reach over blanks or signs")

    def __missing__(self, word: bytes) -> bytes:
        packed = self.before.get(word)
        if packed is None:
            core = word.rstrip(SIGNS)
            if word.isalpha():  # ASCII letters alone: neither normalising nor splitting changes them
                ids = [t.id for t in self.model(word.lower().decode())]
                packed = struct.pack(f"<{len(ids)}I", *ids)
            elif core and core != word and (last := core.decode()[-1]).isalpha() and last < "\u0250" and last != "\u0130":
                packed = self[core] + self[word[len(core):]]
            else:
                ids = self.encode(word.decode(), add_special_tokens=False).ids
                packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[word] = packed
        return packed

    def text(self, text: bytes) -> bytes:
        plain = text.translate(BLANKS if b"<|" in text else LOWERED)
        return b"".join(b"".join(map(self.__getitem__, piece.split(b" "))) for piece in stretches(plain, STRETCH))


def _open(state: bytes, key: str) -> Words:
    """A worker's words outlive its tasks."""
    def build():
        from tokenizers import Tokenizer
        return Words(Tokenizer.from_buffer(state))
    return worker_cache(key, build)


def _writer(shared, key: str, end_id: int, chunk: int, planes: str):
    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        part, words, tail = TaskContext.get().partitionId(), _open(shared.value, key), struct.pack("<I", end_id)
        held, n_held, pieces, done, number, nth = [], 0, [], 0, 0, 0

        def flush():
            nonlocal held, n_held, pieces, done, number
            octets = b"".join(held)
            row = {"part": part, "chunk": number, "first": done, "n": n_held, "crc32": zlib.crc32(octets),
                   "payload": pack(np.frombuffer(octets, dtype="<u4"), planes), "pieces": pieces}
            held, n_held, pieces, done, number = [], 0, [], done + n_held, number + 1
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("crc32", pa.int64()),
                            ("payload", pa.binary()), ("pieces", pa.list_(pa.struct(
                                [("nth", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("at", pa.int32()), ("n", pa.int32()),
                                 ("whole", pa.bool_())])))])
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                octets, at, start = words.text(text.as_py()) + tail, 0, done + n_held
                total = len(octets) // 4
                while at < total:
                    n = min(total - at, chunk - n_held)
                    pieces.append({"nth": nth, "doc_id": doc_id.as_py(), "start": start, "at": n_held, "n": n, "whole": n == total})
                    held.append(octets[4 * at:4 * (at + n)])
                    n_held, at = n_held + n, at + n
                    if n_held == chunk:
                        yield flush()
                nth += 1
        if n_held:
            yield flush()
    return run


def write(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, chunk: int = CHUNK, planes: str = "byte", text: str = "text") -> DataFrame:
    """Write the ids of ``docs(doc_id, text)`` in ascending doc_id order; returns the stored table of chunks.

    ``tokenizer_path`` is a file of the tokenizers library, read on the driver and sent to each executor (a vocabulary, a few MB).
    """
    if planes not in KINDS:
        raise ValueError(f"planes: one of {sorted(KINDS)}")
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    shared, key = docs.sparkSession.sparkContext.broadcast(data), f"tokenizer_{hashlib.md5(data).hexdigest()}"
    # The last key keeps repeated rows of one id from being one indivisible range.
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("text")).withColumn("_hash", F.xxhash64("text"))
    order = ["doc_id", "_hash", "_row"]
    dealt = keyed.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    octets = dealt.select("doc_id", F.col("text").cast("binary").alias("text"))
    return stage(octets.mapInArrow(_writer(shared, key, end_id, chunk, planes), _STORED), "token-planes")


# ---- reading -------------------------------------------------------------------------

def _times(a: int, b: int) -> int:
    """Product of two polynomials over two elements modulo the CRC's, bits reflected."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return out


def join_crc(first: int, second: int, n: int) -> int:
    """CRC of two byte strings end to end, from theirs and the second one's length."""
    power, shift = 0x80000000, 0x00800000  # one, and x to the eighth: a byte
    while n:
        if n & 1:
            power = _times(power, shift)
        shift, n = _times(shift, shift), n >> 1
    return _times(power, first) ^ second


def _reader(batches):
    import zlib

    import pyarrow as pa
    names = ["part", "nth", "doc_id", "start", "seq", "n", "crc32", "whole"]
    for batch in batches:
        for part, chunk, n, crc, payload, pieces in zip(*(batch.column(c) for c in ("part", "chunk", "n", "crc32", "payload", "pieces"))):
            octets = unpack(payload.as_py()).tobytes()
            if len(octets) != 4 * n.as_py() or zlib.crc32(octets) != crc.as_py():
                raise ValueError(f"chunk {chunk} of part {part} is damaged")
            view, found = memoryview(octets), pieces.values
            at, size = found.field("at").to_pylist(), found.field("n").to_pylist()
            k = len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.as_py()] * k, pa.int32()), found.field("nth"), found.field("doc_id"), found.field("start"),
                 pa.array([chunk.as_py()] * k, pa.int32()), found.field("n"),
                 pa.array([zlib.crc32(view[4 * a:4 * (a + m)]) for a, m in zip(at, size)], pa.int64()), found.field("whole")], names=names)


def part_offsets(stored: DataFrame) -> DataFrame:
    """``(part, before)``: ids of all earlier parts, from the index alone (one row a part: as many as the writer had tasks)."""
    totals = stored.groupBy("part").agg(F.sum("n").alias("ids"))
    before = F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    return totals.select("part", F.coalesce(before, F.lit(0)).alias("before"))


def read(stored: DataFrame) -> DataFrame:
    """Documents of a stored table: ``(doc_id, start, n_tokens, ids_crc32)``, all from the decoded files."""
    pieces = stage(stored.mapInArrow(_reader, _PIECE), "token-pieces")

    @F.arrow_udf("long")
    def joined(lists):
        import pyarrow as pa
        out = []
        for parts in lists:
            crc = None
            for p in parts.as_py():
                crc = p["crc32"] if crc is None else join_crc(crc, p["crc32"], 4 * p["n"])
            out.append(crc)
        return pa.array(out, pa.int64())

    # Only documents that span chunks have several pieces, one a chunk.
    split = (pieces.where("not whole").groupBy("part", "nth", "doc_id", "start")
             .agg(F.array_sort(F.collect_list(F.struct("seq", "n", "crc32"))).alias("p"), F.sum("n").alias("n_tokens")))
    split = split.select("part", "doc_id", "start", "n_tokens", joined("p").alias("ids_crc32"))
    whole = pieces.where("whole").select("part", "doc_id", "start", F.col("n").cast("long").alias("n_tokens"), F.col("crc32").alias("ids_crc32"))
    return whole.unionByName(split).join(F.broadcast(part_offsets(stored)), "part").select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def window(stored: DataFrame, start: int, n: int) -> DataFrame:
    """``(at, ids)``: the ids at places ``start`` to ``start + n``, by the chunks that the index names; ``at`` is the place of a run's first id."""
    at = F.col("before") + F.col("first")
    wanted = (stored.join(F.broadcast(part_offsets(stored)), "part").where((at < start + n) & (at + F.col("n") > start))
              .select(at.alias("at"), "payload"))

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            places, runs = [], []
            for a, payload in zip(batch.column("at").to_pylist(), batch.column("payload")):
                ids = unpack(payload.as_py())
                lo, hi = max(0, start - a), min(len(ids), start + n - a)
                places.append(a + lo)
                runs.append(ids[lo:hi].astype("int64"))
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(runs, pa.list_(pa.int64()))], names=["at", "ids"])

    return wanted.mapInArrow(run, "at long, ids array<long>")


ship(__name__)
