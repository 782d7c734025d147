"""Byte-level BPE by a global shuffle of distinct words, and its decoding.

The pre-tokens of a block of documents are kept as positions in the block's own list of distinct words. The words go, by
hash, to tasks that see all blocks' copies of a word together and encode each distinct word once; the ids come back to the
block, which puts them together by position. Decoding joins ids to the token-byte table, which the vocabulary bounds.

Words travel packed, one row for each block and bucket, so no row count follows the frequency of a word.

Defined results: a null text is an empty one (no ids); repeated rows each give a row; an empty table gives no rows; a long
text is a block of its own; extra columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import batches, num_partitions, python_rows
from voxlake.session import checkpoint_dir


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a base64 token and its id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pack_words(words: list[bytes]) -> bytes:
    import zstandard

    return zstandard.compress(np.array([len(words), *map(len, words)], "<u4").tobytes() + b"".join(words))


def unpack_words(blob: bytes) -> list[bytes]:
    import zstandard

    data = zstandard.decompress(blob)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64)).tolist()
    return [data[a:b] for a, b in zip([4 + 4 * n, *ends], ends)]


def _bucket(words: list[bytes], n: int) -> np.ndarray:
    import zlib

    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % n


_BLOCK = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("places", pa.binary()), ("words", pa.binary())])


def split_blocks(docs: DataFrame, pattern: str, block_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(block, doc_ids, lens, places, words): pre-tokens of a block of documents as places in its list of words."""

    def split(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import zstandard
        from pyspark import TaskContext

        pieces, part = regex.compile(pattern), TaskContext.get().partitionId()

        def rows():
            k, chars, ids, places = 0, 0, [], []
            place: dict[str, int] = defaultdict()
            place.default_factory = place.__len__

            def block():
                # Frequent words get the small numbers, and the bytes of equal weight lie together: this packs best.
                every, words = np.concatenate(places), list(place)
                order = np.argsort(-np.bincount(every, minlength=len(words)), kind="stable")
                rank = np.empty(len(words), np.uint32)
                rank[order] = np.arange(len(words))
                blob = zstandard.compress(rank[every].view(np.uint8).reshape(-1, 4).T.tobytes())
                return (part << 32) + k, ids, [len(p) for p in places], blob, pack_words([words[i].encode() for i in order.tolist()])

            for batch in parts:
                for doc_id, text in python_rows(batch):
                    found = pieces.findall(text or "")
                    ids.append(doc_id)
                    places.append(np.fromiter(map(place.__getitem__, found), np.uint32, len(found)))
                    chars += len(text or "")
                    if chars >= block_chars or len(ids) >= 100_000:
                        yield block()
                        k, chars, ids, places = k + 1, 0, [], []
                        place.clear()
            if ids:
                yield block()

        return batches(rows(), _BLOCK, 1)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(split, "block bigint, doc_ids array<bigint>, lens array<bigint>, places binary, words binary")


def encode_words(blocks: DataFrame, ranks: dict[bytes, int], pattern: str, n_buckets: int) -> DataFrame:
    """(block, bucket, ids): ids of a block's words of one bucket, in the order of the block's list."""
    shared = blocks.sparkSession.sparkContext.broadcast(ranks)

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in parts:
                for block, blob in python_rows(batch, 8):
                    words = unpack_words(blob)
                    to = _bucket(words, n_buckets)
                    order = np.argsort(to, kind="stable")
                    at = np.searchsorted(to[order], np.arange(n_buckets + 1)).tolist()
                    order = order.tolist()
                    for b in range(n_buckets):
                        if at[b] < at[b + 1]:
                            yield b, block, pack_words([words[i] for i in order[at[b] : at[b + 1]]])

        return batches(rows(), pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("words", pa.binary())]), 64)

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        codec = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})

        def rows():
            now, known = None, {}
            for batch in parts:
                for bucket, block, blob in python_rows(batch, 64):
                    if bucket != now:
                        now, known = bucket, {}
                    out = []
                    for word in unpack_words(blob):
                        ids = known.get(word)
                        if ids is None:
                            ids = known[word] = np.array(codec.encode_ordinary(word.decode()), "<u4").tobytes()
                        out.append(ids)
                    yield block, bucket, pack_words(out)

        return batches(rows(), pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("ids", pa.binary())]), 64)

    dealt = blocks.select("block", "words").mapInArrow(deal, "bucket int, block bigint, words binary")
    return dealt.repartition(n_buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(encode, "block bigint, bucket int, ids binary")


def _bucketed(blocks: DataFrame, n: int) -> DataFrame:
    """The blocks as a table in the shared folder, bucketed so that only the ids travel to meet them."""
    spark, name = blocks.sparkSession, f"token_blocks_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    blocks.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, "block").saveAsTable(name)
    return spark.table(name)


_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 1 << 22) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers."""
    n_buckets = num_partitions(docs.sparkSession)
    blocks = _bucketed(split_blocks(docs, pattern, block_chars, id_col, text_col), n_buckets)

    def together(block: pa.Table, coded: pa.Table) -> pa.Table:
        import zstandard

        out = []
        by_bucket = dict(zip(coded["bucket"].to_pylist(), coded["ids"].to_pylist()))
        for row in block.to_pylist():
            words = unpack_words(row["words"])
            to = _bucket(words, n_buckets)
            ids = np.empty(len(words), object)
            for b, blob in by_bucket.items():
                ids[np.flatnonzero(to == b)] = _objects(unpack_words(blob))
            at, ids = 0, ids.tolist()
            places = np.ascontiguousarray(np.frombuffer(zstandard.decompress(row["places"]), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
            for doc_id, n in zip(row["doc_ids"], row["lens"]):
                data = b"".join(map(ids.__getitem__, places[at : at + n].tolist()))
                out.append((doc_id, len(data) // 4, data))
                at += n
        return pa.Table.from_batches(list(batches(iter(out), _ENCODED)), _ENCODED)

    words = encode_words(blocks, ranks, pattern, n_buckets)
    return blocks.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(together, "doc_id bigint, n_tokens bigint, ids binary")


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The rows with ``decoded`` (binary) added: ids joined to the token-byte table, in order of position."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    schema = pa.schema([*_ENCODED, ("decoded", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {i: b for b, i in shared.value.items()}

        def rows():
            for batch in parts:
                for doc_id, n, ids in python_rows(batch):
                    yield doc_id, n, ids, b"".join(map(token.__getitem__, np.frombuffer(ids, "<u4").tolist()))

        return batches(rows(), schema, 512)

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded binary")
