"""Token ids in grammar-compressed binary blocks, by Re-Pair.

Documents, in ascending order of their ids, are encoded and cut into blocks of bounded size. In each block the most
frequent pairs of adjacent symbols are replaced by nonterminals, again and again, until no pair occurs as often as its
rule needs to pay for itself. Counts are exact; a pass takes all pairs that occur as often as a floor, which goes down step by
step, and where two of them overlap, the more frequent one has the place. The block holds the rules, the length that
each expands to, and where each document's symbols begin, so that any stretch of any document is decoded from the
symbols that cover it alone.

A block is a value of a binary column of a Parquet table, so that Spark's commit protocol writes it once, whatever
tasks are lost, into any store. Layout, little-endian: magic, counts, then arrays of unsigned integers, then a CRC-32 of
all that.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, materialize, runs, spread, text_buffers, thrifty
from .tokens import Encoder

END = 2
#: Ids of a block (a longer document has a block of its own); least occurrences of a pair that is replaced: a rule takes 12
#: bytes, each replacement saves 4 at most; how many times lower each floor is than the one before;
#: places are this many times those that a pass has changed where these wait for the next pass over all.
BLOCK, LEAST, FACTOR, FEW = 1 << 20, 4, 4, 100
#: Floor from which on few buckets do, and up to which many are needed.
FREQUENT, RARE = 100, 20
_MAGIC = b"QRP1"
_NONE = np.iinfo(np.int32).max


def compress(ids: np.ndarray, lengths: np.ndarray, end: int = END, least: int = LEAST) -> bytes:
    """ids of documents one after another, each with the id `end` last; lengths: ids of each. Returns a block, in which no
    pair of symbols occurs `least` times (2 or more) within documents without overlaps."""
    if lengths.sum() != len(ids) or (len(lengths) and (lengths.min() < 1 or (ids[np.cumsum(lengths) - 1] != end).any())):
        raise ValueError("each document must end with the end id")
    present = np.zeros(int(ids.max(initial=0)) + 1, bool)
    present[ids] = True
    terminals = np.flatnonzero(present).astype(np.uint32)
    number = np.cumsum(present) - 1
    # symbol 0 ends a document and is part of no pair; terminal i is symbol i + 1
    seq = (number[ids] + 1).astype(np.uint32)
    seq[np.cumsum(lengths) - 1] = 0
    rules, seq = grammar_of(seq, len(terminals) + 1, max(2, least))
    n = len(terminals) + 1 + sum(map(len, rules))
    grammar = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    size = np.ones(n, np.uint64)
    at = len(terminals) + 1
    for pairs in rules:
        size[at : at + len(pairs)] = size[pairs[:, 0]] + size[pairs[:, 1]]
        at += len(pairs)
    starts = np.concatenate(([0], np.flatnonzero(seq == 0) + 1)).astype(np.uint64)
    wide = n > 1 << 16
    head = struct.pack("<4sBIIIIQ", _MAGIC, wide, end, len(terminals), len(grammar), len(lengths), len(seq))
    parts = (terminals, grammar.astype("<u4"), size[len(terminals) + 1 :].astype("<u4"), starts.astype("<u8"), seq.astype("<u4" if wide else "<u2"))
    body = head + b"".join(x.tobytes() for x in parts)
    return body + struct.pack("<I", zlib.crc32(body))


def _sorted(a: np.ndarray, b: np.ndarray, at: np.ndarray, out: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.uint64 | None]:
    """Pairs as numbers a * 2^width + b, sorted, without those in `out` (places in at); then either their places and None, or numbers with
    the places in so many low bits. a and b are less than n, at ascends."""
    bits, width = int(at[-1]).bit_length() if len(at) else 0, n.bit_length()
    key = a.astype(np.uint64)
    key <<= np.uint64(width)
    key |= b
    if bits + 2 * width >= 64:
        key[out] = np.iinfo(np.uint64).max
        order = np.argsort(key, kind="stable")[: len(key) - len(out)]
        return key[order], at[order], None
    # the place goes along in the bits below, as sorting numbers is many times faster than sorting their order
    key <<= np.uint64(bits)
    key |= at.view(np.uint64)
    key[out] = np.iinfo(np.uint64).max
    key.sort()
    key = key[: len(key) - len(out)]
    return key >> np.uint64(bits), key, np.uint64(bits)


def _replaced(seq: np.ndarray, n: int, at: np.ndarray, least: int, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """One pass over the pairs that begin at the places `at`: (rules of the symbols n, n + 1, .., the sequence with
    them in place, places of pairs that were taken or are new), or None if no pair occurs `floor` times. seq itself is
    written over."""
    a, b = seq.take(at), seq.take(at + 1)
    # of a run of equal symbols every other pair counts; none counts that the end of a document is part of
    same = np.flatnonzero(a == b)
    out = (a == 0) | (b == 0)
    if len(same):
        first = np.concatenate(([True], at[same[1:]] != at[same[:-1]] + 1))
        k = np.arange(len(same))
        out[same[(k - np.maximum.accumulate(np.where(first, k, 0))) % 2 == 1]] = True
    key, place, bits = _sorted(a, b, at, np.flatnonzero(out), n)
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, len(key)))
    if count.max(initial=0) < floor:
        return None
    pick = np.flatnonzero(count >= floor)
    pick = pick[np.argsort(-count[pick], kind="stable")]
    often = count[pick]
    taken = place[spread(begin[pick], often)]
    if bits is not None:
        taken = (taken & np.uint64((1 << int(bits)) - 1)).view(np.int64)
    rank = np.repeat(np.arange(len(pick), dtype=np.int32), often)
    # a pair has its place unless one that overlaps it is more frequent
    there = np.full(len(seq) + 2, _NONE, np.int32)
    there[taken + 1] = rank
    wins = (rank < there[taken]) & (rank < there[taken + 2])
    pos, rank = taken[wins], rank[wins]
    times = np.bincount(rank, minlength=len(pick))
    kept = np.flatnonzero(times >= least)
    symbol = np.zeros(len(pick), np.uint32)
    symbol[kept] = n + np.arange(len(kept))
    new = symbol[rank]
    pos, new = pos[new > 0], new[new > 0]
    keep = np.ones(len(seq), bool)
    keep[pos + 1] = False
    seq[pos] = new
    live = np.zeros(len(seq), bool)
    live[taken] = True
    live[pos] = True
    front = np.maximum(pos - 1, 0)
    live[front] = True
    # a pair in front of a symbol that has gone begins where the new symbol does; that in front of a pair replaced just before
    # begins at that one's symbol
    live[np.maximum(pos - 2, 0)] |= ~keep.take(front)
    if len(pos) < len(seq) // 20:
        seq, live = seq[keep], live[keep]
    else:
        # a mask of no pattern is several times slower
        stays = np.flatnonzero(keep)
        seq, live = seq.take(stays), live.take(stays)
    live[-1:] = False
    pair = key[begin[pick[kept]]]
    width = np.uint64(n.bit_length())
    rules = np.stack((pair >> width, pair & np.uint64((1 << int(width)) - 1)), 1).astype(np.uint32)
    return rules, seq, np.flatnonzero(live)


def _places(seq: np.ndarray, floor: int) -> np.ndarray:
    """Where pairs begin that may occur `floor` times: the bucket that they are hashed to does."""
    bucket = seq[:-1] * np.uint32(0x9E3779B1)
    bucket += seq[1:] * np.uint32(0x85EBCA77)
    # as few buckets as leave out most pairs, as counts that stay in the processor's cache are several times faster
    bucket >>= np.uint32(32 - (17 if floor >= FREQUENT else 18 if floor > RARE else 19))
    bucket = bucket.astype(np.intp)
    return np.flatnonzero((np.bincount(bucket) >= floor).take(bucket))


def grammar_of(seq: np.ndarray, n: int, least: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Symbols below n, 0 in no pair: the rules, pass by pass, and the sequence that is left, in which no pair occurs `least`
    times. Floors go down to `least`. After a pass over all places of a floor, the pairs that it took and those that its symbols
    make are looked at again while any of them is as frequent (all others have only become rarer); where these are few, the next
    pass over all has them, too."""
    rules: list[np.ndarray] = []
    floor = int(np.bincount(seq)[1:].max(initial=0))
    while len(seq) > 1:
        floor = floor // FACTOR if floor >= FACTOR * FACTOR * least else least
        done = _replaced(seq, n, _places(seq, floor), least, floor)
        if done is None and floor == least:
            break
        while done is not None:
            new, seq, live = done
            rules.append(new)
            n += len(new)
            if floor > least and len(live) < len(seq) // FEW:
                break
            done = _replaced(seq, n, live, least, floor)
    return rules, seq


class Block:
    """A block read back; ValueError where it is damaged."""

    def __init__(self, data: bytes):
        size = struct.calcsize("<4sBIIIIQ")
        if len(data) < size + 4 or data[:4] != _MAGIC or struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
            raise ValueError("not a block, or a damaged one")
        _, wide, self.end, terminals, rules, self.docs, n = struct.unpack_from("<4sBIIIIQ", data)
        at = size
        arrays = []
        for kind, count in (("<u4", terminals), ("<u4", 2 * rules), ("<u4", rules), ("<u8", self.docs + 1), ("<u4" if wide else "<u2", n)):
            arrays.append(np.frombuffer(data, kind, count, at))
            at += arrays[-1].nbytes
        self.terminals, pairs, expanded, self.starts, self.seq = arrays
        self.starts = self.starts.astype(np.int64)
        self.size = np.concatenate((np.ones(terminals + 1, np.int64), expanded.astype(np.int64)))
        # every symbol's expansion, one after another: those of rules are copies of what stands before them
        self.at = np.cumsum(self.size) - self.size
        flat = np.empty(int(self.size.sum()), np.uint32)
        flat[0] = self.end
        flat[1 : terminals + 1] = self.terminals
        pairs = pairs.reshape(-1, 2)
        done = terminals + 1
        while done < len(self.size):
            # rules whose parts are both ready: rounds stand one after another
            ready = int(np.argmax(np.concatenate((pairs[done - terminals - 1 :].max(1) >= done, [True]))))
            some = pairs[done - terminals - 1 : done - terminals - 1 + ready].ravel()
            flat[int(self.at[done]) : int(self.at[done] + self.size[done : done + ready].sum())] = flat[spread(self.at[some], self.size[some])]
            done += ready
        self.flat = flat

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        return self.flat[spread(self.at[symbols], self.size[symbols])]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents one after another, how many each has)."""
        run = np.concatenate(([0], np.cumsum(self.size[self.seq])))
        return self._expand(self.seq), np.diff(run[self.starts])

    def ids(self, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of a document, decoded from the symbols that cover them."""
        symbols = self.seq[self.starts[doc] : self.starts[doc + 1]]
        ends = np.cumsum(self.size[symbols])
        stop = int(ends[-1]) if stop is None else min(stop, int(ends[-1]))
        if start >= stop:
            return np.zeros(0, np.uint32)
        i, j = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        skip = start - (int(ends[i - 1]) if i else 0)
        return self._expand(symbols[i:j])[skip : skip + stop - start]


def encoded(texts: pa.Array, encoder: Encoder, end: int, most: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, ids with the end id after each text, how many each has), by runs of about `most` bytes."""
    texts = texts.fill_null("")
    at, _ = text_buffers(texts)
    for i, j in runs(at, most):
        ids, n = encoder.encode(texts.slice(i, j - i))
        out = np.full(len(ids) + len(n), end, np.uint32)
        own = np.ones(len(out), bool)
        own[np.cumsum(n + 1) - 1] = False
        out[own] = ids
        yield i, j - i, out, n + 1


def _pack(batches: Iterator[pa.RecordBatch], path: str, end: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    encoder, part = Encoder.of(path), TaskContext.get().partitionId()
    ids, sizes, names, held, block = [], [], [], 0, 0

    def flush() -> pa.RecordBatch:
        data = compress(np.concatenate(ids), np.concatenate(sizes), end)
        docs = pa.array([[x for a in names for x in a.to_pylist()]], pa.list_(kind))
        return pa.record_batch([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([held], pa.int64()), docs, pa.array([data], pa.binary())], ["part", "block", "n_ids", "docs", "data"])

    for batch in batches:
        for i, rows, got, n in encoded(batch.column("text"), encoder, end):
            ends, k = np.cumsum(n), 0
            while k < rows:
                # as many documents as bring the block to its size
                j = min(rows, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + BLOCK - held)) + 1)
                ids.append(got[ends[k - 1] if k else 0 : ends[j - 1]])
                sizes.append(n[k:j])
                names.append(batch.column("id").slice(i + k, j - k))
                held += len(ids[-1])
                k = j
                if held >= BLOCK:
                    yield flush()
                    ids, sizes, names, held, block = [], [], [], 0, block + 1
    if held:
        yield flush()


def write_tokens(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, parts: int | None = None) -> DataFrame:
    """Writes df's texts as a table of blocks (part, block, n_ids, docs, data) in the shared folder and returns it:
    documents stand in ascending order of (part, block, place in docs), null ids first, equal ids in the order of their
    texts' first 16 characters, then of a hash of them (and such rows may be several tasks'). Null is an empty text, which has the end id
    alone. No rows, no blocks. parts: tasks that encode (by default as many as read df, and at least spark.sql.shuffle.partitions)."""
    spark = bounded(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = parts or max(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = rows.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    # ids that many rows share, null among them, are told apart by text, and equal rows by where they were read
    told = rows.withColumns({"begin": F.substring("text", 1, 16), "tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    dealt = told.repartitionByRange(parts, "id", "begin", "tie", "row").sortWithinPartitions("id", "begin", "tie").select("id", "text")
    blocks = dealt.mapInArrow(thrifty(lambda b: _pack(b, tokenizer, end, arrow)), f"part int, block int, n_ids long, docs array<{kind.simpleString()}>, data binary")
    return materialize(blocks, "tokens", compression="none")


def read_tokens(blocks: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, part, block) for each document of a table of blocks, decoded from it: ids of all
    documents before it, its own, and the unsigned CRC-32 of those as little-endian 32-bit integers."""
    kind = blocks.schema["docs"].dataType.elementType

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, n = Block(batch.column("data")[r].as_py()).all()
                docs = batch.column("docs").slice(r, 1).flatten()
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(n)
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                where = [pa.array(np.full(len(n), batch.column(c)[r].as_py(), np.int32)) for c in ("part", "block")]
                yield pa.record_batch([*where, docs, pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())], ["part", "block", "id", "own", "n_tokens", "ids_crc32"])

    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    whole = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = blocks.select("part", "block", before.alias("inner")).join(whole, "part").select("part", "block", (F.col("base") + F.col("inner")).alias("base"))
    docs = blocks.select("part", "block", "docs", "data").mapInArrow(thrifty(read), f"part int, block int, id {kind.simpleString()}, own long, n_tokens long, ids_crc32 long")
    return docs.join(bases, ["part", "block"]).select("id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32", "part", "block")
