"""Encoding of a whole corpus with a public byte-level BPE tokenizer by reuse of content-defined chunks.

Texts are cut where a rolling hash over the last code points hits a pattern, so that copied passages give the same chunks
wherever they stand. Chunks meet in one shuffle on their hash, each distinct one is encoded once, and the ids go back to
their documents, where the joins are repaired by re-encoding until they agree exactly with the encoding of the whole text.

A place where a letter or digit is followed by white space ends a piece of the tokenizer's splitting pattern whatever stands
around it, so ids on both sides of such a cut never depend on each other. Rolling-hash cuts move on to the next such place;
where there is none within the longest chunk (unspaced scripts, long runs), the cut is open and its join is repaired: the
window from the last sure cut of the left chunk to the first sure cut of the right one is encoded anew and grows over chunks
without a sure cut.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from lodestrata.session import input_partitions

#: Fixed value: the splitting pattern of the byte_bpe_50k vocabulary.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_WINDOW = 24
_BASE = 0x9E3779B97F4A7C15
_ASCII = np.zeros(128, dtype=np.uint8)
for _c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789":
    _ASCII[ord(_c)] = 1
for _c in " \n\t\r":
    _ASCII[ord(_c)] = 2
#: Occurrences of a chunk in one task beyond this many are spread over further keys, so a chunk in a third of all texts is no hot key.
_SPREAD_AFTER, _SPREAD = 64, 251
_REMEMBER = 200_000


def sure_cuts(codes: np.ndarray) -> np.ndarray:
    """Places p with an ASCII letter or digit at p-1 and ASCII white space at p."""
    kind = np.where(codes < 128, _ASCII[np.minimum(codes, 127)], 0)
    return np.flatnonzero((kind[:-1] == 1) & (kind[1:] == 2)) + 1


def power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    return tuple(np.cumprod(np.full(n, b, dtype=np.uint64)) for b in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))))


def is_sure(text: str, p: int) -> bool:
    a, b = ord(text[p - 1]), ord(text[p])
    return a < 128 and b < 128 and _ASCII[a] == 1 and _ASCII[b] == 2


def chunk_bounds(text: str, mean: int, least: int, most: int, powers: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """Ends of the chunks of a text, the last one its length."""
    n = len(text)
    if n <= least:
        return [n]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sure = sure_cuts(codes)
    ends: list[int] = []
    at = 0
    if n > _WINDOW:
        up, down = powers if n <= len(powers[0]) else power_table(n)
        # code point k times base**-k; a window's sum times base**start depends on its content alone, not on its place
        sums = np.cumsum(codes.astype(np.uint64) * down[:n])
        window = (sums[_WINDOW:] - sums[:-_WINDOW]) * up[: n - _WINDOW]
        hits = np.flatnonzero((window >> np.uint64(40)) % np.uint64(mean) == 0) + _WINDOW + 1
    else:
        hits = np.empty(0, dtype=np.int64)
    moved = sure[np.minimum(np.searchsorted(sure, hits), len(sure) - 1)] if len(sure) else hits
    moved = np.where(moved >= hits, moved, hits)
    for p in np.unique(moved):
        p = int(p)
        while p - at > most:
            k = int(np.searchsorted(sure, at + most, side="right")) - 1
            cut = int(sure[k]) if k >= 0 and sure[k] > at + least else at + most
            ends.append(cut)
            at = cut
        if p - at >= least and p < n:
            ends.append(p)
            at = p
    while n - at > most:
        k = int(np.searchsorted(sure, at + most, side="right")) - 1
        cut = int(sure[k]) if k >= 0 and sure[k] > at + least else at + most
        ends.append(cut)
        at = cut
    ends.append(n)
    return ends


class Encoder:
    """tiktoken over the given ranks, no special tokens: their strings are ordinary text."""

    def __init__(self, ranks: bytes, pattern: str = SPLIT_PATTERN):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.size = max(table.values()) + 1
        self.encode = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.dtype = np.uint16 if self.size <= 65536 else np.uint32

    def piece(self, text: str, open_left: bool, open_right: bool) -> tuple[bytes, str, int, str, int, int]:
        """(ids, head, ids in head, tail, ids in tail, flags) of a chunk. flags: 1 it has a sure cut inside, 2 its left and 4 its
        right join is open. Head and tail reach to the first and from the last sure cut; a chunk without one is all head."""
        ids = self.encode(text)
        head = tail = ""
        n_head = n_tail = 0
        flags = 2 * open_left + 4 * open_right
        if flags:
            sure = sure_cuts(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
            if len(sure):
                flags += 1
                if open_left:
                    head = text[: sure[0]]
                    n_head = len(self.encode(head))
                if open_right:
                    tail = text[sure[-1] :]
                    n_tail = len(self.encode(tail))
            else:
                head = text
        return np.array(ids, dtype=self.dtype).tobytes(), head, n_head, tail, n_tail, flags

    def stitch(self, pieces: list[tuple[bytes, str, int, str, int, int]]) -> np.ndarray:
        """Ids of the whole text from those of its chunks in order."""
        if len(pieces) == 1:
            return np.frombuffer(pieces[0][0], dtype=self.dtype)
        out: list[np.ndarray] = []
        text = None  # an open window: text after the ids in out whose encoding is not settled

        def settle(window: str) -> None:
            out.append(np.array(self.encode(window), dtype=self.dtype))

        for raw, head, n_head, tail, n_tail, flags in pieces:
            ids = np.frombuffer(raw, dtype=self.dtype)
            sure, right = flags & 1, flags & 4
            if text is not None and not sure:  # the window grows over the whole chunk
                text += head
            elif text is not None:
                settle(text + head)
                ids, text = ids[n_head:], None
            elif right and not sure:
                text = head
            if text is None:
                out.append(ids[: len(ids) - n_tail] if right else ids)
                text = tail if right else None
            elif not right:
                settle(text)
                text = None
        return np.concatenate(out)


def encode_corpus(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = DEFAULT_RANKS,
    mean: int = 384, least: int = 96, most: int = 4096,
) -> DataFrame:
    """``(id_col, ids)`` of every row: ids ARRAY<INT> of its whole text without special tokens.

    Null and empty text give an empty list. Repeated rows, repeated and null ids each give a row of their own; other
    columns are ignored. mean, least and most (code points) shape the chunks, never the result. The text of a chunk is
    shuffled once for each task that meets it, its ids once for each use. The vocabulary file is read on the driver and sent
    to the tasks (under 1 MB).
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(Path(ranks_path).read_bytes())
    id_type = dict(docs.dtypes)[id_col]
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    parts = input_partitions(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        powers = power_table(65536)
        row = part << 33
        seen: dict[bytes, int] = {}
        emitted: set[tuple[bytes, int]] = set()
        for b in batches:
            for s in range(0, b.num_rows, 512):
                some = b.slice(s, 512)
                uid, at, pos, hashes, salts, texts = [], [], [], [], [], []
                for k, text in enumerate(some.column("text").to_pylist()):
                    text = text or ""
                    start, left = 0, 0
                    for p, end in enumerate(chunk_bounds(text, mean, least, most, powers)):
                        chunk = text[start:end]
                        right = int(end < len(text) and not is_sure(text, end))
                        h = xxhash.xxh3_128_digest(chunk.encode("utf-8", "surrogatepass")) + bytes([left + 2 * right])
                        start, left = end, right
                        n = seen[h] = seen.get(h, 0) + 1
                        salt = 0 if n <= _SPREAD_AFTER else 1 + part % _SPREAD
                        known = (h, salt) in emitted
                        if not known:
                            emitted.add((h, salt))
                        uid.append(row)
                        at.append(k)
                        pos.append(p)
                        hashes.append(h)
                        salts.append(salt)
                        texts.append(None if known else chunk)
                    row += 1
                    if len(emitted) > _REMEMBER:
                        seen, emitted = {}, set()
                yield pa.RecordBatch.from_arrays(
                    [some.column("id").take(pa.array(at, pa.int64())), pa.array(uid, pa.int64()), pa.array(pos, pa.int32()), pa.array(hashes, pa.binary()), pa.array(salts, pa.int32()), pa.array(texts, pa.string())],
                    names=["id", "uid", "pos", "h", "salt", "chunk"],
                )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(ranks.value)
        last, piece = None, None
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                some = b.slice(s, 2048)
                pieces = []
                for h, text in zip(some.column("h").to_pylist(), some.column("chunk").to_pylist()):
                    if h != last:
                        last, piece = h, enc.piece(text, bool(h[-1] & 1), bool(h[-1] & 2))
                    pieces.append(piece)
                cols = list(zip(*pieces))
                kinds = [pa.binary(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [some.column("id"), some.column("uid"), some.column("pos"), *(pa.array(c, t) for c, t in zip(cols, kinds))],
                    names=["id", "uid", "pos", "ids", "head", "n_head", "tail", "n_tail", "flags"],
                )

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(ranks.value)
        at, ident, held = None, None, []
        ids_out: list = []
        lists: list[np.ndarray] = []
        size = 0

        def flush():
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            values = np.concatenate(lists).astype(np.int32) if lists else np.empty(0, np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids_out, kind), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["id", "ids"]
            )

        kind = pa.int64()
        for b in batches:
            kind = b.column("id").type
            rows = zip(*(b.column(c).to_pylist() for c in ("id", "uid", "ids", "head", "n_head", "tail", "n_tail", "flags")))
            for i, u, *rest in rows:
                if u != at:
                    if held:
                        ids_out.append(ident)
                        lists.append(enc.stitch(held))
                        size += len(lists[-1])
                        if size > 1_000_000 or len(lists) >= 4096:
                            yield flush()
                            ids_out, lists, size = [], [], 0
                    at, ident, held = u, i, []
                held.append(tuple(rest))
        if held:
            ids_out.append(ident)
            lists.append(enc.stitch(held))
        if lists:
            yield flush()

    chunks = source.mapInArrow(cut, f"id {id_type}, uid bigint, pos int, h binary, salt int, chunk string")
    keyed = chunks.repartition(parts, "h", "salt").sortWithinPartitions("h", "salt", chunks["chunk"].isNull())
    coded = keyed.mapInArrow(
        encode, f"id {id_type}, uid bigint, pos int, ids binary, head string, n_head int, tail string, n_tail int, flags int"
    )
    back = coded.repartition(parts, "uid").sortWithinPartitions("uid", "pos")
    return back.mapInArrow(stitch, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)
