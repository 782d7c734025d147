"""Token-id files with fixed-width bit packing.

A shard holds whole documents in ascending id order. Every token id takes the fewest bits that the vocabulary needs, and ids
lie in blocks of ``BLOCK`` whose byte offsets are listed, so that numpy unpacks many blocks at once or only those that a
range of tokens touches. Layout, little-endian:

    magic 8 bytes | bits u32 | ids per block u32 | documents u64 | tokens u64 | blocks u64
    doc_id i64[documents] | null u8[documents] | end u64[documents] | offset u64[blocks] | blocks

Spark range-partitions and sorts the texts; each task encodes its range and writes its shards under names of their own to
the shared folder. Only the shards that the written manifest lists are read, so a task that ran twice does no harm.

Defined results: a null text is an empty one (only the end id); null ids come first; rows with equal ids follow each other
in text order; a text of any length is encoded whole and is never cut by a shard; an empty table gives no shards and no rows;
extra columns are ignored.
"""

from __future__ import annotations

import re
import string
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.common import batches, cut_lineage
from voxlake.session import checkpoint_dir

MAGIC, HEAD, BLOCK = b"TOKBITS1", "<8sIIQQQ", 4096


def width(vocabulary: int) -> int:
    """Bits that hold ids below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """ids as a stream of ``bits`` each, the lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").view(np.uint8)
    return np.packbits((ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32) & 1).astype(np.uint8), bitorder="little")


def unpack(data: np.ndarray, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return data.view(f"<u{bits // 8}")[:n].astype(np.uint32)
    return (np.unpackbits(data, count=n * bits, bitorder="little").reshape(n, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def shard_bytes(doc_ids: list[int | None], docs: list[np.ndarray], bits: int) -> bytes:
    """The image of one shard."""
    ids = np.concatenate(docs)
    n_blocks = -(-len(ids) // BLOCK)
    ids = np.concatenate([ids, np.zeros(n_blocks * BLOCK - len(ids), ids.dtype)])
    per = BLOCK * bits // 8
    ends = np.cumsum([len(d) for d in docs], dtype=np.uint64)
    body = [pack(ids[i : i + 64 * BLOCK], bits).tobytes() for i in range(0, len(ids), 64 * BLOCK)]
    return b"".join([
        struct.pack(HEAD, MAGIC, bits, BLOCK, len(docs), int(ends[-1]), n_blocks), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(), ends.astype("<u8").tobytes(), (np.arange(n_blocks, dtype="<u8") * per).tobytes(), *body,
    ])


class Shard:
    """A shard image; ``ids(a, b)`` reads any range of tokens from the blocks it touches."""

    def __init__(self, image: bytes):
        magic, self.bits, self.block, n_docs, self.n_tokens, n_blocks = struct.unpack_from(HEAD, image)
        if magic != MAGIC:
            raise ValueError("not a token-id shard")
        at = struct.calcsize(HEAD)
        known, at = np.frombuffer(image, "<i8", n_docs, at), at + 8 * n_docs
        null, at = np.frombuffer(image, np.uint8, n_docs, at), at + n_docs
        self.ends, at = np.frombuffer(image, "<u8", n_docs, at).astype(np.int64), at + 8 * n_docs
        self.offsets, at = np.frombuffer(image, "<u8", n_blocks, at).astype(np.int64), at + 8 * n_blocks
        self.doc_ids = [None if x else int(d) for d, x in zip(known, null)]
        self.body = np.frombuffer(image, np.uint8, offset=at)

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.zeros(0, np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        data = self.body[self.offsets[first] : self.offsets[last] + self.block * self.bits // 8]
        return unpack(data, self.bits, (last - first + 1) * self.block)[a - first * self.block : b - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first token in the shard, ids)."""
        start = 0
        for doc_id, end in zip(self.doc_ids, self.ends.tolist()):
            yield doc_id, start, self.ids(start, end)
            start = end


def files_at(folder: str):
    """(file system, path) of a folder in any store that pyarrow reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", folder))


#: Pieces that a worker remembers, in each of two generations: those used since the last change, and those before.
PIECES = 600_000
#: Stands for a piece that can't be encoded by itself; no piece has this length.
_ODD = b"odd"


def text_encoder(tokenizer_json: str, split_special: bool = True):
    """encode(texts) -> arrays of ids, as the tokenizers library gives them for each whole text.

    ``split_special`` is the library's ``encode_special_tokens``: special tokens written out in a text are split like other
    words; without it (the library's default) they get their own ids. Texts with an added token are encoded in one go.

    A space between two characters that are not white space always begins a new pre-token, and a line end between such
    characters is one, so the piece from one of them to the next is encoded by itself and remembered; texts in which they
    touch other white space are encoded in one go. The memory is bounded and kept on the interpreter, for the next tasks of
    a reused worker.
    """
    from tokenizers import Tokenizer

    kept = sys.__dict__.setdefault("_token_pieces", {})
    key = zlib.crc32(tokenizer_json.encode()), split_special
    if key not in kept:
        made = Tokenizer.from_str(tokenizer_json)
        made.encode_special_tokens = split_special
        kept[key] = (made, {}, {}, {}, {})
    tok, pieces, older, first, tails = kept[key]
    added = [t.content for t in tok.get_added_tokens_decoder().values() if t.content and not (split_special and t.special)]
    #: Words put together could make an added token that has white space.
    joined = not any(c.isspace() for t in added for c in t)

    def each(texts: list[str]) -> Iterator[bytes]:
        return (array("I", e.ids).tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False))

    def words(new: list[str], lead: str) -> Iterator[bytes]:
        """Ids of words of letters: many go in one text, as pre-tokens of their own (each with its space, or between line ends)."""
        step = 1 if lead else 2
        for i in range(0, len(new), 500):
            part = new[i : i + 500]
            e = tok.encode(" " + " ".join(part) if lead else "\n".join(part), add_special_tokens=False)
            of, data = np.array(e.word_ids), array("I", e.ids).tobytes()
            at = [0, *(4 * (np.flatnonzero(of[1:] != of[:-1]) + 1)).tolist(), len(data)]
            if joined and len(at) == step * (len(part) - 1) + 2:
                yield from (data[a:b] for a, b in zip(at[::step], at[1::step]))
            else:
                yield from each([lead + w for w in part])

    def learn(new: list[str]) -> None:
        """Letters and the signs behind them are two pre-tokens, so such pieces are put together from known parts."""
        plain = [p for p in new if p.isalpha()]
        pieces.update(zip(plain, words(plain, " ")))
        plan, other = [], []
        for p in new:
            if p.isalpha():
                continue
            known, body = (first, p[1:]) if p[:1] == "\n" else (pieces, p)
            base = body.rstrip(string.punctuation)
            if base.isalpha():
                plan.append((p, known, base, body[len(base) :]))
            elif body == "" or body[0].isspace() or body[-1].isspace():
                pieces[p] = _ODD  # a space or line end here touches white space
            else:
                other.append((p, known, body))
        for known, lead in ((first, ""), (pieces, " ")):
            fresh = list({b for _, k, b, _ in plan if k is known and b not in known})
            known.update(zip(fresh, words(fresh, lead)))
        fresh = list({t for *_, t in plan if t not in tails})
        tails.update(zip(fresh, each(fresh)))
        for p, known, base, tail in plan:
            if p == base:
                continue
            pieces[p] = (line_end if known is first else b"") + known[base] + tails[tail]
        for (p, known, _), ids in zip(other, each([("" if k is first else " ") + b for _, k, b in other])):
            pieces[p] = (line_end if known is first else b"") + ids

    line_end = next(each(["\n"]))

    def encode(texts: list[str]) -> list[np.ndarray]:
        if len(pieces) > PIECES or len(first) > PIECES // 4 or len(tails) > PIECES // 4:
            older.clear()
            older.update(pieces)
            for d in (pieces, first, tails):
                d.clear()
        if not texts:
            return []
        # The first piece has no space before it either: as if a line ended there, whose ids are cut off again.
        plain = [not any(map(t.__contains__, added)) for t in texts]
        lines = pa.array([f"\n{t}" if p else "\n" for t, p in zip(texts, plain)], pa.large_string())
        split = pc.split_pattern(pc.replace_substring(lines, "\n", " \n"), " ")
        coded = split.values.dictionary_encode()
        distinct, of, bounds = coded.dictionary.to_pylist(), coded.indices.to_numpy(), split.offsets.to_numpy()
        found = list(map(pieces.get, distinct))
        missing = [w for w, v in zip(distinct, found) if v is None]
        pieces.update((w, older[w]) for w in missing if w in older)
        learn([w for w in missing if w not in pieces])
        found = [pieces[w] if v is None else v for w, v in zip(distinct, found)]
        # Each distinct piece has its ids once, side by side; a text is put together by the places of its pieces.
        size = np.fromiter(map(len, found), np.int64, len(found))
        odd = size == len(_ODD)
        for i in np.flatnonzero(odd).tolist():
            found[i] = b""
        known, size = np.frombuffer(b"".join(found), "<u4"), np.where(odd, 0, size // 4)
        first_id = np.cumsum(size) - size
        n = size[of]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(first_id[of] - ends[:-1], n)
        at += np.arange(ends[-1])
        ids = known[at]
        odds = np.concatenate([[0], np.cumsum(odd[of])])
        out, cut = [], len(line_end) // 4
        for p, a, b in zip(plain, bounds[:-1].tolist(), bounds[1:].tolist()):
            # The piece at ``a`` is empty: what is before the first line end.
            out.append(ids[ends[a] + cut : ends[b]] if p and odds[b] == odds[a + 1] else None)
        whole = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(whole, tok.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)):
            out[i] = np.array(e.ids, np.uint32)
        return out

    return encode, tok.get_vocab_size()


#: Characters of texts that are encoded together: a piece that is in many of them is looked up once.
CHUNK_CHARS = 4 << 20


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts of about ``CHUNK_CHARS``; a longer text is a run of its own or ends one."""
    a = held = 0
    for b, t in enumerate(texts, 1):
        held += len(t)
        if held >= CHUNK_CHARS or b == len(texts):
            yield a, b
            a, held = b, 0


_SHARD = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def write_shards(docs: DataFrame, tokenizer_json: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1 << 23, split_special: bool = True) -> DataFrame:
    """Encode and write all documents; the manifest: (file, n_docs, n_tokens, start), start being the tokens before it.

    ``split_special`` as in ``text_encoder``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, size = text_encoder(shared.value, split_special)
        bits = width(max(size, end_id + 1))
        files, top = files_at(folder)
        files.create_dir(top, recursive=True)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)

        def save(k: int, names: list, ids: list) -> tuple:
            name = f"{part:06d}-{k:04d}-{uuid.uuid4().hex}.tokens"
            with files.open_output_stream(f"{top}/{name}") as out:
                out.write(shard_bytes(names, ids, bits))
            return part, k, name, len(names), sum(map(len, ids))

        def rows():
            k, names, ids, held = 0, [], [], 0
            for batch in parts:
                doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
                for i, j in _chunks(texts):
                    for doc_id, x in zip(doc_ids[i:j], encode(texts[i:j])):
                        names.append(doc_id)
                        ids.append(np.concatenate([x, end]))
                        held += len(ids[-1])
                        if held >= shard_tokens:
                            yield save(k, names, ids)
                            k, names, ids, held = k + 1, [], [], 0
            if names:
                yield save(k, names, ids)

        return batches(rows(), _SHARD, 1)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = cut_lineage(ordered.mapInArrow(write, "part bigint, shard bigint, file string, n_docs bigint, n_tokens bigint"))
    # A row for each shard: this window sees as many rows as there are files.
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return made.select("file", "n_docs", "n_tokens", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files that the manifest lists."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = files_at(folder)

        def rows():
            for batch in parts:
                for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    with files.open_input_file(f"{top}/{name}") as f:
                        shard = Shard(f.read())
                    for doc_id, at, ids in shard.documents():
                        yield doc_id, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())

        return batches(rows(), schema)

    spark = manifest.sparkSession
    n = max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism))  # else few tasks would read all files
    return manifest.select("file", "start").repartition(n).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_folder(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
