"""LM scoring: Stupid-backoff scores over n-gram counts of the corpus itself.

Documents are packed where they are read into blocks of about BLOCK_BYTES, n-grams are dealt by their
hash into buckets of the count table. Two rounds of joins:

1. A block explodes its documents' 1- and 2-grams to hashes, counts them (the partial aggregation)
   and hands each bucket its sorted distinct hashes and counts. A bucket is one partition of the n-gram
   count table: it sums all blocks' counts and joins back to each block what the others have.
2. The same for those 3-grams whose two 2-grams were both met outside of their document; no other
   3-gram can have been.

A block then joins the totals to its exploded n-grams and sums log10 scores per document. Rows of the
exchanges are packed, one for each block and bucket, as sorted arrays of about 7 bytes for each n-gram and
way. A block hands out 2^FAN_BITS rows at most: where the corpus asks for more buckets, blocks meet by groups first
(by the leading bits of the hash), and each group's sums go on to the buckets, so that rows grow in
proportion to the corpus however large it is. Every n-gram of every text takes part.

A hash keeps the bits of the first exchange's bucket and 48 more, 60 from some 30 GB on: of n distinct n-grams n^2 / 2^61 pairs
are expected to share a hash then, 16 of 6 billion, and their counts add up.

The score of a word is f(w-2 w-1 w) / f(w-2 w-1) if that n-gram was seen, else BACKOFF times the
score with one word less; a word never seen scores as BACKOFF / N. Counts leave out those of the
document itself, else every n-gram would have been seen. Words are what ASCII white space parts,
A-Z lower-cased.

Null and empty texts have no words and a null mean score. Repeated rows count as documents of their
own, wherever they are read, so none gathers in one block. A null doc_id stays null. An empty table gives an empty
result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.text import id_and_text
from varloom.storage import partitions

BACKOFF = 0.4
BLOCK_BYTES, BLOCK_ROWS = 6_000_000, 100_000
BUCKET_BYTES = 8_000_000
#: A block's or group's rows in an exchange are 2^FAN_BITS at most.
FAN_BITS = 12
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class _Block:
    """The exploded n-grams of a block's texts."""

    def __init__(self, packed: dict, bits: int):
        from xxhash import xxh64_intdigest as xxh

        raw, at, hashes = zstandard.decompress(packed["texts"]), 0, []
        for n in np.frombuffer(packed["sizes"], np.int64).tolist():
            w = raw[at : at + n].lower().split()
            at += n
            hashes.append(np.fromiter(map(xxh, w), np.uint64, len(w)))
        sizes = np.array([len(x) for x in hashes], np.int64)
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.n, self.sizes, self.doc = len(h), sizes, np.repeat(np.arange(len(sizes)), sizes)
        self.ids, self.has_id = np.frombuffer(packed["ids"], np.int64), np.frombuffer(packed["has_ids"], np.bool_)
        place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.second, self.third = np.flatnonzero(place >= 1), np.flatnonzero(place >= 2)
        two = np.zeros(len(h), np.uint64)
        two[self.second] = _mix(h[self.second - 1] * _U(0x9E3779B97F4A7C15) + _mix(h[self.second]) + _U(2))
        self._h, self._two, self._keep = h, two, ~((_U(1) << _U(max(0, 16 - bits))) - _U(1))

    def short(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all 1-grams, then 2-grams, and the document of each."""
        return np.concatenate([_mix(self._h + _U(1)), self._two[self.second]]) & self._keep, np.concatenate([self.doc, self.doc[self.second]])

    def long(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the 3-grams that end at these words, and the document of each."""
        return _mix(self._two[at - 1] * _U(0xD6E8FEB86659FD93) + _mix(self._h[at]) + _U(3)) & self._keep, self.doc[at]

    def counts(self, elsewhere: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts by word of its 1-gram and its 2-gram outside of the document."""
        seen, two = _outside(*self.short(), elsewhere), np.zeros(self.n, np.int64)
        two[self.second] = seen[self.n :]
        return seen[: self.n], two

    def promising(self, two: np.ndarray) -> np.ndarray:
        """Words at which a 3-gram may have been met outside of its document."""
        return self.third[(two[self.third] > 0) & (two[self.third - 1] > 0)]


def _outside(keys: np.ndarray, doc: np.ndarray, elsewhere: np.ndarray) -> np.ndarray:
    """For each n-gram its count outside of its document; elsewhere: counts outside of the block, by sorted distinct hash."""
    order = np.argsort(keys)
    s = keys[order]
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(np.r_[False, s[1:] != s[:-1]]) if len(s) else 0
    other = elsewhere
    inside = np.bincount(at, minlength=len(other))
    out = other[at]
    # Where the block has it once, that is the document's own.
    often = np.flatnonzero(inside[at] > 1)
    _, which, n = np.unique((doc[often] << 32) | at[often], return_inverse=True, return_counts=True)
    out[often] += inside[at[often]] - n[which]
    return out


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(keys)
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, np.int64)
    return s[at], np.diff(np.r_[at, len(s)]).astype(np.int32)


def _pack(keys: np.ndarray, bits: int) -> bytes:
    """The 48 bits under the bucket's of sorted hashes, as gaps: their number, the low four bytes of each, the high two compressed."""
    low = (keys << _U(bits)) >> _U(16)
    planes = np.diff(low, prepend=_U(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    high = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:, 4:6].T).tobytes())
    return len(low).to_bytes(4, "little") + planes[:, :4].tobytes() + high


def _packed_size(raw: bytes) -> int:
    return int.from_bytes(raw[:4], "little")


def _unpack(raw: bytes) -> np.ndarray:
    n = _packed_size(raw)
    out = np.zeros((n, 8), np.uint8)
    out[:, :4] = np.frombuffer(raw, np.uint8, 4 * n, 4).reshape(n, 4)
    out[:, 4:6] = np.frombuffer(zstandard.decompress(raw[4 + 4 * n :]), np.uint8).reshape(2, n).T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def _narrow(values: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as single bytes, and in a second part those of 255 or more."""
    return np.minimum(values, 255).astype(np.uint8).tobytes(), values[values >= 255].astype(np.int64).tobytes()


def _wide(small: bytes, large: bytes) -> np.ndarray:
    out = np.frombuffer(small, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(large, np.int64)
    return out


def _cells(keys: np.ndarray, counts: np.ndarray, first: int, parts: int, bits: int, block: int, words: int) -> pd.DataFrame:
    """A row for each of `parts` buckets from `first` on: sorted distinct hashes and their counts; one of the rows has the number of words."""
    at = np.arange(first, first + parts, dtype=np.uint64) << _U(64 - bits)
    ends = np.searchsorted(keys, at).tolist() + [len(keys)]
    rows = [(first + i, block, _pack(keys[s:e], bits), *_narrow(counts[s:e]), words if i == block % parts else 0) for i, (s, e) in enumerate(zip(ends, ends[1:], strict=False))]
    return pd.DataFrame(rows, columns=["bucket", "block", "hashes", "small", "large", "words"])


def _summed(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket's cells: the distinct 48 bits under the bucket's and their sums, and for each cell entry its place among those and its own count."""
    keys = np.concatenate([_unpack(x) for x in pdf["hashes"]])
    counts = _wide(b"".join(pdf["small"]), b"".join(pdf["large"]))
    order = np.argsort(keys)
    s = keys[order]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.empty(0, bool)
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    return s[new], np.bincount(at, weights=counts, minlength=0).astype(np.int64), at, counts


def _shared_out(pdf: pd.DataFrame, each: np.ndarray, words: int) -> pd.DataFrame:
    ends = np.cumsum([0, *map(_packed_size, pdf["hashes"])]).tolist()
    parts = [_narrow(each[s:e]) for s, e in zip(ends, ends[1:], strict=False)]
    return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "small": [p[0] for p in parts], "large": [p[1] for p in parts], "words": words})


def _sum_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each block, in the order of its hashes, what the other blocks count."""
    _, sums, at, counts = _summed(pdf)
    return _shared_out(pdf, sums[at] - counts, int(pdf["words"].sum()))


def _in_order(back: pd.DataFrame) -> np.ndarray:
    back = back.sort_values("bucket")
    return _wide(b"".join(back["small"]), b"".join(back["large"]))


_CELLS = "bucket int, block long, hashes binary, small binary, large binary, words long"
_BACK = "block long, bucket int, small binary, large binary, words long"


def _elsewhere(cells: DataFrame, blocks: int, bits: int, fan_bits: int) -> DataFrame:
    """For each cell, in the order of its hashes, what all other blocks count; cells are dealt by the leading bits that first_bits() gives."""
    lead = first_bits(bits, fan_bits)
    if lead == bits:
        return cells.groupBy("bucket").applyInPandas(_sum_bucket, _BACK)
    under = bits - lead
    groups = max(1, -(-blocks // (1 << under)))
    cells = cells.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        # The cells of a group of blocks in one bucket of the first exchange go on as one, dealt out by further bits.
        lead_at, low = int(pdf["bucket"].iloc[0]), _summed(pdf)
        keys = (_U(lead_at) << _U(64 - lead)) | ((low[0] << _U(16)) >> _U(lead))
        return _cells(keys, low[1], lead_at << under, 1 << under, bits, int(pdf["group"].iloc[0]), int(pdf["words"].sum()))

    def share(own: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("block")
        _, sums, at, counts = _summed(own)
        return _shared_out(own, (sums + _in_order(back))[at] - counts, int(back["words"].sum()))

    back = cells.groupBy("bucket", "group").applyInPandas(merge, _CELLS).groupBy("bucket").applyInPandas(_sum_bucket, _BACK)
    back = back.withColumns({"lead": F.shiftright("bucket", under), "group": F.col("block")})
    return cells.groupBy("bucket", "group").cogroup(back.groupBy("lead", "group")).applyInPandas(share, _BACK)


def first_bits(bits: int, fan_bits: int = FAN_BITS) -> int:
    """Bits of the first exchange's buckets: all of them up to fan_bits, else half of them."""
    return bits if bits <= fan_bits else -(-bits // 2)


def _packed(docs: DataFrame, block_bytes: int) -> DataFrame:
    """A row for each block, packed where the documents are read: ids, sizes and texts, the latter compressed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, part = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId()
        ids, texts, size, n = [], [], 0, 0

        def block() -> pa.RecordBatch:
            has, number = np.array([i is not None for i in ids], np.bool_), np.array([i or 0 for i in ids], np.int64)
            sizes = np.array([len(t) for t in texts], np.int64)
            row = ((part << 32) + n, number.tobytes(), has.tobytes(), sizes.tobytes(), squeeze.compress(b"".join(texts)))
            types = [pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["block", "ids", "has_ids", "sizes", "texts"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= block_bytes or len(ids) >= BLOCK_ROWS:
                    yield block()
                    ids, texts, size, n = [], [], 0, n + 1
        if ids:
            yield block()

    return docs.mapInArrow(run, "block long, ids binary, has_ids binary, sizes binary, texts binary")


def score(docs: DataFrame, backoff: float = BACKOFF, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, fan_bits: int = FAN_BITS) -> DataFrame:
    """Per document: doc_id, n_words, log10_sum, mean_log10 and how many words were scored with 3, 2, 1 and no words of evidence."""
    docs = id_and_text(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    bits = max(1, int(max(partitions(docs.sparkSession), -(-size // bucket_bytes)) - 1).bit_length())
    # Which documents a block holds follows from the order of its partition's rows; sorted, a task that runs anew makes the same blocks.
    d = _packed(docs.sortWithinPartitions(F.xxhash64("doc_id", "text")), block_bytes)
    lead = first_bits(bits, fan_bits)

    def count_short(own: pd.DataFrame) -> pd.DataFrame:
        row = own.iloc[0].to_dict()
        block = _Block(row, lead)
        return _cells(*_distinct(block.short()[0]), 0, 1 << lead, lead, row["block"], block.n)

    def count_long(own: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        row = own.iloc[0].to_dict()
        block = _Block(row, lead)
        at = block.promising(block.counts(_in_order(back))[1])
        return _cells(*_distinct(block.long(at)[0]), 0, 1 << lead, lead, row["block"], 0)

    def summed(own: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        block = _Block(own.iloc[0].to_dict(), lead)
        short, long = back[back["round"] == 1], back[back["round"] == 2]
        one, two = block.counts(_in_order(short))
        at = block.promising(two)
        three = np.zeros(block.n, np.int64)
        three[at] = _outside(*block.long(at), _in_order(long))
        n, words = len(block.sizes), block.n
        rest = np.maximum(int(short["words"].sum()) - block.sizes[block.doc], 1)
        previous_one, previous_two = np.r_[1, one[:-1]][:words], np.r_[1, two[:-1]][:words]
        evidence = np.where(three > 0, 3, np.where(two > 0, 2, np.where(one > 0, 1, 0)))
        # The first word of a document has no shorter context to back off from, the second one.
        tried = np.ones(words, np.int64)
        tried[block.second], tried[block.third] = 2, 3
        top = np.select([evidence == 3, evidence == 2, evidence == 1], [three, two, one], 1).astype(np.float64)
        under = np.select([evidence == 3, evidence == 2], [previous_two, previous_one], rest).astype(np.float64)
        sums = np.bincount(block.doc, weights=np.log10(top / under) + (tried - evidence) * np.log10(backoff), minlength=n)
        out = pd.DataFrame({"doc_id": block.ids, "has_id": block.has_id, "n_words": block.sizes, "log10_sum": sums})
        out["mean_log10"] = np.where(block.sizes > 0, sums / np.maximum(block.sizes, 1), np.nan)
        for k in (3, 2, 1, 0):
            out[f"seen_{k}"] = np.bincount(block.doc[evidence == k], minlength=n)
        return out

    short = _elsewhere(d.groupBy("block").applyInPandas(count_short, _CELLS), blocks, bits, fan_bits)
    long = _elsewhere(d.groupBy("block").cogroup(short.groupBy("block")).applyInPandas(count_long, _CELLS), blocks, bits, fan_bits)
    back = short.withColumn("round", F.lit(1)).unionByName(long.withColumn("round", F.lit(2)))
    schema = "doc_id long, has_id boolean, n_words long, log10_sum double, mean_log10 double, seen_3 long, seen_2 long, seen_1 long, seen_0 long"
    out = d.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(summed, schema)
    named = {"doc_id": F.when(F.col("has_id"), F.col("doc_id")), "mean_log10": F.when(F.col("n_words") > 0, F.col("mean_log10"))}
    return out.withColumns(named).drop("has_id")
