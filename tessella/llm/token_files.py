"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

A file set is a table of blocks. A block is one binary value: header, the
documents' ids and counts, then the control bytes of all values (two bits a
value: its bytes less one) and, apart from them, the data bytes. The values
are ranks of ids by falling corpus frequency (ties: smaller id first), so that
common ids take one byte. Blocks lie in ascending order of doc_id over files
(shards) and within them; null ids come first, and rows that share an id (as
repeated rows do) lie in the order of the table they were tokenised to, so that
an id which very many rows share is spread over files. Empty or null texts hold
the end id alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.llm.common import TOKENIZER_FILE, map_rows, parts, table
from tessella.llm.tokens import encoder

MAGIC = b"TKB1"
BLOCK_TOKENS = 1 << 19
# For each control byte: the bytes of its four values.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def pack_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    wide = 2 if not len(values) or values.max() <= 0xFFFF else 4
    v = values.astype(f"<u{wide}")
    code = (v > 0xFF).astype(np.uint8)
    if wide == 4:
        code += (v > 0xFFFF).astype(np.uint8) + (v > 0xFFFFFF)
    four = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    four[: len(v)] = code
    control = four[0::4] | four[1::4] << 2 | four[2::4] << 4 | four[3::4] << 6
    data = v.view(np.uint8).reshape(-1, wide)[np.arange(wide, dtype=np.uint8) <= code[:, None]]
    return control.tobytes(), data.tobytes()


def unpack_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The inverse of pack_values by table lookup."""
    size = LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64)
    at -= size
    out = data[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        more = np.flatnonzero(size > k)
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack_block(docs: list[int | None], sizes: list[int], values: np.ndarray, before: int) -> bytes:
    """One block of documents whose values follow one another."""
    control, data = pack_values(values)
    head = np.array([[0 if d is None else d, d is None, n] for d, n in zip(docs, sizes, strict=True)], "<i8")
    return b"".join([MAGIC, struct.pack("<qqq", len(docs), before, len(control)), head.tobytes(), control, data])


def unpack_block(blob: bytes) -> tuple[int, list[int | None], np.ndarray, np.ndarray]:
    """Tokens before the block in its shard, the documents' ids and numbers of values, and all values."""
    if blob[:4] != MAGIC:
        raise ValueError("not a token block")
    docs, before, controls = struct.unpack_from("<qqq", blob, 4)
    head = np.frombuffer(blob, "<i8", docs * 3, 28).reshape(-1, 3)
    raw = np.frombuffer(blob, np.uint8, offset=28 + docs * 24)
    ids = [None if null else doc for doc, null, _ in head.tolist()]
    return before, ids, head[:, 2], unpack_values(raw[:controls], raw[controls:], int(head[:, 2].sum()))


def tokenize(df: DataFrame, file: str = TOKENIZER_FILE, end_id: int = 2) -> DataFrame:
    """doc_id, ids: the raw little-endian 16-bit ids of each text and end_id (32-bit where the vocabulary needs it).

    A null or empty text has the end id alone; repeated rows stay, an empty
    table gives no rows, and columns but doc_id and text are not read.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        enc = encoder(file)
        kind = id_type(enc.tokenizer.get_vocab_size())
        for b in batches:
            yield {"doc_id": b["doc_id"], "ids": [np.append(x, np.uint32(end_id)).astype(kind).tobytes() for x in enc.batch(b["text"])]}

    return map_rows(df.select("doc_id", "text"), run, "doc_id long, ids binary")


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def frequency_order(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """All ids by falling count over the whole table. The result has one entry for each id of the vocabulary."""
    kind = id_type(vocabulary)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b["ids"]), kind), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield {"id": used.tolist(), "n": total[used].tolist()}

    counted = map_rows(tokens.select("ids"), run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(vocabulary, np.int64)
    total[counted["id"].to_numpy(int)] = counted["n"].to_numpy(int)
    return np.lexsort((np.arange(vocabulary), -total)).astype(np.uint32)


def write_token_files(df: DataFrame, file: str = TOKENIZER_FILE, end_id: int = 2) -> tuple[DataFrame, np.ndarray]:
    """Writes the file set of doc_id, text in the shared folder. Returns its blocks and the ids by rank (the decoding table).

    Nulls, empties and repeats are as in tokenize(); no rows make no blocks.
    """
    vocabulary = encoder(file).tokenizer.get_vocab_size()
    kind = id_type(vocabulary)
    tokens = table(tokenize(df, file, end_id), "tokens")
    order = frequency_order(tokens, vocabulary)
    rank = np.empty(vocabulary, np.uint32)
    rank[order] = np.arange(vocabulary, dtype=np.uint32)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        docs, raws, sizes, held = [], [], [], 0
        width = np.dtype(kind).itemsize

        def put() -> dict:
            blob = pack_block(docs, sizes, rank[np.frombuffer(b"".join(raws), kind)], before)
            return {"shard": [shard], "block": [block], "n_tokens": [held], "blob": [blob]}

        for b in batches:
            for doc, raw in zip(b["doc_id"], b["ids"], strict=True):
                docs.append(doc)
                raws.append(raw)
                sizes.append(len(raw) // width)
                held += sizes[-1]
                if held >= BLOCK_TOKENS:
                    yield put()
                    before, block, docs, raws, sizes, held = before + held, block + 1, [], [], [], 0
        if docs:
            yield put()

    placed = tokens.withColumn("place", F.monotonically_increasing_id())
    by_id = placed.repartitionByRange(parts(df.sparkSession), "doc_id", "place").sortWithinPartitions("doc_id", "place").drop("place")
    return table(map_rows(by_id, run, "shard int, block int, n_tokens long, blob binary"), "token-files"), order


def read_token_files(blocks: DataFrame, order: np.ndarray, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (raw 32-bit, if asked for) from the files. The start of a shard is the sum of those before it: a row for each file."""
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    starts = shards.select("shard", (F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("shard_start"))

    kinds = ("doc_id long", "start long", "n_tokens long", "ids_crc32 long", "ids binary")[: 5 if with_ids else 4]
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for blob, start in zip(b["blob"], b["shard_start"], strict=True):
                before, docs, sizes, ranks = unpack_block(blob)
                ends = np.cumsum(sizes)
                ids = order[ranks].astype("<u4")
                raw = memoryview(ids.tobytes())
                cuts = [raw[4 * x : 4 * y] for x, y in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                out: dict[str, list] = {"doc_id": docs, "start": (start + before + ends - sizes).tolist(), "n_tokens": sizes.tolist(), "ids_crc32": [zlib.crc32(c) for c in cuts]}
                if with_ids:
                    out["ids"] = [c.tobytes() for c in cuts]
                yield out

    # bounded: one row for each file of the set
    return map_rows(blocks.join(F.broadcast(starts), "shard").select("blob", "shard_start"), run, ", ".join(kinds))


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    blocks, order = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_token_files(blocks, order, with_ids=False)
