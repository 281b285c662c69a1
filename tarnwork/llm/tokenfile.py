"""Token ids in binary segments, written in id order and read back.

Documents are dealt by ranges of their id, sorted within a range, encoded with a tokenizer, and packed by
:mod:`rangecoder` into segments of whole documents.  A segment is a row of a Parquet file (shard, seg, n_docs, n_ids,
data), so that any file system Spark writes to will do and a lost task is simply run again.

Ids ascend, null first; rows of one id are ordered by text.  Null texts are empty: only the end id.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rangecoder
from .common import ship, sliced

#: Ids that a segment holds, but for a longer last document.
SEGMENT_IDS = 4_000_000
SEGMENTS = "shard int, seg long, n_docs long, n_ids long, data binary"


#: Letters that normalisation only lower-cases, then signs (no apostrophe): two pieces to the vocabulary's splitter.
_SIMPLE = "^(?P<head>[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)(?P<tail>[!-&(-/:-@\\[-`{-~]*)$"


class WordEncoder:
    """The library's encoding of whole texts, put together from its encodings of pieces of their words.

    The vocabularies' splitters never match across blanks, so a text's ids are those of its blank-separated words in
    turn.  The strings of special tokens have no blanks and letters between signs, so a word with one goes through the
    library whole and becomes that token.  Distinct words of plain letters, with or without signs behind them, are lower-cased and split into letters
    and signs; letters go to the library's model at once, as the characters that its byte level writes for their bytes.
    All other words, and signs, go through the library whole.  About ``cache`` pieces are remembered.  Words are
    split and counted as Arrow columns, and their ids gathered with numpy, so Python sees distinct pieces only.
    """

    def __init__(self, path: str, cache: int = 600_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.model, level = self.library.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # Characters of bytes of letters that are not the Latin-1 ones.
        self.written = {}
        for c in map(str.lower, map(chr, range(0xC0, 0x100))):
            self.written |= {a: b for a, b in zip(_bytes(c), level.pre_tokenize_str(c)[0][0], strict=True) if a != b}
        self.size, self.heads, self.whole = cache, {}, {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.split_pattern(pa.array(map(_plain, texts), pa.large_string()), " ")
        words = split.flatten().dictionary_encode()
        found = pc.extract_regex(words.dictionary, _SIMPLE)
        simple = found.is_valid()
        heads = pc.utf8_lower(pc.struct_field(found, "head").filter(simple)).dictionary_encode()
        tails = pc.struct_field(found, "tail").filter(simple).dictionary_encode()
        others = words.dictionary.filter(pc.invert(simple))
        pieces = self.pieces(_strings(heads.dictionary), _strings(tails.dictionary) + _strings(others))

        # A distinct word is letters and signs, or whole; words are put together once and then taken in the order of the texts.
        raw, n_heads, n_tails = pa.array(pieces, pa.large_binary()), len(heads.dictionary), len(tails.dictionary)
        both = pc.binary_join_element_wise(raw.slice(0, n_heads).take(heads.indices), raw.slice(n_heads, n_tails).take(tails.indices), pa.scalar(b"", pa.large_binary()))
        place = np.empty(len(words.dictionary), np.int64)
        known = simple.to_numpy(zero_copy_only=False)
        place[known], place[~known] = np.arange(len(both)), np.arange(len(others)) + len(both)
        taken = pa.chunked_array([both, raw.slice(n_heads + n_tails)]).combine_chunks().take(pa.array(place[words.indices.to_numpy()]))
        _, ends, data = taken.buffers()
        ends = np.frombuffer(ends, np.int64, len(taken) + 1, 8 * taken.offset)
        whole = np.frombuffer(data or b"", "<u4", ends[-1] // 4)
        bounds = (ends[split.offsets.to_numpy()] // 4).tolist()
        return [whole[a:b] for a, b in zip(bounds, bounds[1:])]

    def pieces(self, heads: list[str], whole: list[str]) -> list[bytes]:
        """Little-endian ids of lower-case letters, then of what needs the library whole."""
        if len(self.heads) + len(self.whole) + len(heads) + len(whole) > self.size:
            self.heads, self.whole = {}, {}
        return [*_cached(self.heads, heads, self._letters), *_cached(self.whole, whole, self._others)]

    def _letters(self, some: list[str], step: int = 2000) -> Iterable[bytes]:
        encode = self.model.tokenize
        for k in range(0, len(some), step):
            joined = _bytes(" ".join(some[k : k + step]))
            if not joined.isascii():
                for byte, character in self.written.items():
                    joined = joined.replace(byte, character)
            ids, stops = [], [0]
            for word in joined.split(" "):
                ids += [token.id for token in encode(word)]
                stops.append(4 * len(ids))
            data = np.array(ids, "<u4").tobytes()
            yield from (data[a:b] for a, b in zip(stops, stops[1:]))

    def _others(self, some: list[str], step: int = 2000) -> Iterable[bytes]:
        for k in range(0, len(some), step):
            for e in self.library.encode_batch_fast(some[k : k + step], add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes()


def _bytes(text: str) -> str:
    """A character for each byte of its UTF-8."""
    return text if text.isascii() else text.encode().decode("latin-1")


def _cached(cache: dict[str, bytes], names: list[str], encode: Callable[[list[str]], Iterable[bytes]]) -> list[bytes]:
    """What ``cache`` holds of each name; what it lacks is encoded and kept."""
    found = list(map(cache.get, names))
    lacks = [name for name, x in zip(names, found, strict=True) if x is None]
    if not lacks:
        return found
    fresh = list(encode(lacks))
    cache.update(zip(lacks, fresh, strict=True))
    rest = iter(fresh)
    return [next(rest) if x is None else x for x in found]


def _strings(column) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _plain(text: str) -> str:
    for blank in "\n\t\r\x0b\x0c":
        if blank in text:
            text = text.replace(blank, " ")
    return text


@lru_cache(2)
def _encoder(path: str) -> WordEncoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordEncoder(path)


def _segment(ids: list[np.ndarray], names: list, id_bits: int) -> tuple[int, int, bytes]:
    """n_docs, n_ids and the bytes: document ids and lengths, deflated, then the packed ids."""
    lengths = np.array([len(x) for x in ids], "<u4")
    known = np.array([x is not None for x in names], np.uint8)
    head = zlib.compress(known.tobytes() + np.array([x or 0 for x in names], "<i8").tobytes() + lengths.tobytes(), 6)
    body = rangecoder.pack(np.concatenate(ids), id_bits)
    return len(ids), int(lengths.sum()), struct.pack("<QI", len(ids), len(head)) + head + body


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_bits: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write segments of all documents to the folder ``path``."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        encoder, shard, seg = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, names, held = [], [], 0

        def close():
            n_docs, n_ids, data = _segment(ids, names, id_bits)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([seg], pa.int64()), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64()), pa.array([data], pa.binary())], names=["shard", "seg", "n_docs", "n_ids", "data"])

        for part in sliced(batches, 1, 8192, 8_000_000):
            texts = [t or "" for t in part.column(1).to_pylist()]
            for name, x in zip(part.column(0).to_pylist(), encoder.encode(texts), strict=True):
                ids.append(np.append(x, np.uint32(end_id)))
                names.append(name)
                held += len(x) + 1
                if held >= SEGMENT_IDS:
                    yield close()
                    ids, names, held, seg = [], [], 0, seg + 1
        if ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    rows.mapInArrow(run, SEGMENTS).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the segments at ``path``, in which blocks are checked."""
    import pyarrow as pa

    ship(spark)
    segments = spark.read.schema(SEGMENTS).parquet(path)

    def run(batches):
        for batch in batches:
            for shard, seg, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                n_docs, size = struct.unpack_from("<QI", data, 0)
                head = zlib.decompress(data[12 : 12 + size])
                known = np.frombuffer(head, np.uint8, n_docs)
                names = np.frombuffer(head, "<i8", n_docs, n_docs)
                lengths = np.frombuffer(head, "<u4", n_docs, 9 * n_docs)
                raw = rangecoder.unpack(data[12 + size :]).astype("<u4")
                ends = np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths
                sums = [zlib.crc32(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n_docs, shard, np.int32)), pa.array(np.full(n_docs, seg, np.int64)), pa.array(names, mask=known == 0), pa.array(starts), pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64())],
                    names=["shard", "seg", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    found = segments.select("shard", "seg", "data").mapInArrow(run, "shard int, seg long, doc_id long, at long, n_tokens long, ids_crc32 long")
    # Ids before a segment: those of earlier shards (a row a shard) and of earlier segments of its own.
    counts = segments.select("shard", "seg", "n_ids")
    shards = counts.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("seg")) - F.col("n_ids")
    offsets = counts.select("shard", "seg", inside.alias("within")).join(shards, "shard").select("shard", "seg", (F.col("within") + F.col("before")).alias("base"))
    return found.join(offsets, ["shard", "seg"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
