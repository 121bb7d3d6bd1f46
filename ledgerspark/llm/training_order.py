"""Training-order materialisation: token ids in fixed-stride binary shards, in a keyed random order.

Every document becomes sequences of ``seq_len`` token ids (the last one filled up with the end token). A
sequence's number among all, counted by partition in a first pass, goes through a keyed Feistel
permutation; cycle-walking keeps it below the number of sequences, so the results are the slots 0 to N - 1,
each once. Slots are dealt to partitions by ranges; each writes whole shards in the order of slots. As all
sequences take the same number of bytes, a reader finds slot s at (s % shard_sequences) * stride of shard
s // shard_sequences and can start or go on anywhere (``read_slots``).

A shard is written under another name and then renamed, so a task that runs again does no harm. The first
and the second pass must split the input alike, as scans of files do; if a partition differs, it fails.

Cases: a null or empty text is one sequence that holds only the end token; a null doc_id stays null;
repeated rows are sequences of their own. An empty table gives no shards. Other columns play no part. Long
texts are tokenised whole, one text at a time.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, stored, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The split pattern and the free id that belong to this vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256

ROUNDS = 8
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids in 16 bits."""

    def __init__(self, ranks: bytes):
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        known = {base64.b64decode(word): int(rank) for word, rank in pairs}
        self.model = tiktoken.Encoding("given", pat_str=SPLIT, mergeable_ranks=known, special_tokens={})

        self.core = self.model._core_bpe.encode_ordinary

    def count(self, text: str) -> int:
        return len(self.core(text))

    def encode(self, text: str) -> bytes:
        # whole, as most words of a large corpus are too rare for a table of them to pay
        return array("H", self.core(text)).tobytes()


def _encoder(ranks: bytes) -> Encoder:
    """One a Python worker."""
    key = hashlib.sha256(ranks).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(ranks)
    return _encoders[key]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(numbers: np.ndarray, n: int, key: str) -> np.ndarray:
    """The slots of numbers in 0..n-1: a Feistel network on the next even number of bits, walked until below n."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = np.frombuffer(hashlib.blake2b(key.encode(), digest_size=8 * ROUNDS).digest(), "<u8")
    out = np.asarray(numbers, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right + k) & mask)
        out[todo] = x = (left << half) | right
        todo = todo[x >= np.uint64(n)]
    return out.astype(np.int64)


def _n_sequences(n_ids: int, seq_len: int) -> int:
    """n_ids and the end token."""
    return n_ids // seq_len + 1


def materialise(
    docs: DataFrame,
    path: str,
    vocabulary: str = VOCABULARY,
    key: str = "order",
    seq_len: int = 512,
    shard_sequences: int = 8192,
) -> DataFrame:
    """Writes docs' (doc_id, text) to shards in path. Returns slot, shard, row, doc_id, seq_no, n_tokens."""
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:  # on the driver; executors get its bytes, under a megabyte
        ranks = spark.sparkContext.broadcast(f.read())
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, n = _encoder(ranks.value), 0
        for batch in batches:
            for text in batch.column("text"):
                n += _n_sequences(encoder.count(text.as_py()), seq_len)
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": [n]})

    counts = dict(map(tuple, texts.mapInArrow(count, "part long, n long").collect()))  # a row a partition
    first, total = {}, 0
    for part in sorted(counts):
        first[part], total = total, total + counts[part]
    starts = spark.sparkContext.broadcast(first)
    n_shards = -(-total // shard_sequences)
    stride = 2 * seq_len

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(ranks.value), TaskContext.get().partitionId()
        at = starts.value.get(part, 0)
        for batch in batches:
            ids, numbers, lengths, records = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                tokens = encoder.encode(text.as_py()) + END.to_bytes(2, "little")
                for k in range(0, len(tokens), stride):
                    piece = tokens[k : k + stride]
                    ids.append(doc_id.as_py())
                    numbers.append(k // stride)
                    lengths.append(len(piece) // 2)
                    records.append(piece)
            slots = permuted(np.arange(at, at + len(ids)), total, key)
            at += len(ids)
            columns = [slots, slots // shard_sequences, ids, numbers, lengths, records]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, cut_schema, strict=True)], schema=cut_schema)
        if at != starts.value.get(part, 0) + counts.get(part, 0):
            raise RuntimeError(f"partition {part} was split otherwise than when it was counted")

    fields = [("slot", pa.int64()), ("shard", pa.int64()), ("doc_id", pa.int64()), ("seq_no", pa.int32())]
    cut_schema = pa.schema([*fields, ("n_tokens", pa.int32()), ("ids", pa.binary())])
    schema = "slot long, shard long, doc_id long, seq_no int, n_tokens int"
    out_schema = pa.schema([*fields, ("n_tokens", pa.int32())])
    filler = END.to_bytes(2, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        now, out, temporary = None, None, ""

        def close() -> None:
            if out is not None:
                out.close()
                store.move(temporary, f"{folder}/{shard_name(now)}")

        for batch in batches:
            for shard, ids in zip(batch.column("shard").to_pylist(), batch.column("ids"), strict=True):
                if shard != now:
                    close()
                    store.create_dir(folder)
                    now, temporary = shard, f"{folder}/.{shard_name(shard)}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(temporary)
                record = ids.as_py()
                out.write(record + filler * ((stride - len(record)) // 2))
            yield batch.select(out_schema.names)
        close()

    parts = max(1, min(n_shards, 32_768))
    dealt = texts.mapInArrow(cut, f"{schema}, ids binary").repartitionById(
        parts, F.floor(F.col("shard") * parts / max(n_shards, 1)).cast("int")
    )
    written = dealt.sortWithinPartitions("slot").mapInArrow(write, schema)
    manifest = stored(written, "training-order")
    note = {"sequences": total, "seq_len": seq_len, "stride": stride, "shard_sequences": shard_sequences, "end": END}
    _put(path, "manifest.json", json.dumps(note | {"key_sha256": hashlib.sha256(key.encode()).hexdigest()}).encode())
    return manifest.withColumn("row", F.col("slot") % shard_sequences)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _put(path: str, name: str, content: bytes) -> None:
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(path)
    store.create_dir(folder)
    with store.open_output_stream(f"{folder}/{name}") as out:
        out.write(content)


def read_slots(path: str, start: int = 0, stop: int | None = None) -> Iterator[np.ndarray]:
    """The ids of slots start to stop, in order; reads on from any slot without touching what lies before it."""
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{folder}/manifest.json") as f:
        note = json.loads(f.read())
    stop, per_shard, stride = min(stop or note["sequences"], note["sequences"]), note["shard_sequences"], note["stride"]
    while start < stop:
        shard, row = divmod(start, per_shard)
        n = min(per_shard - row, stop - start)
        with store.open_input_file(f"{folder}/{shard_name(shard)}") as f:
            f.seek(row * stride)
            for _ in range(n):
                yield np.frombuffer(f.read(stride), "<u2")
        start += n


def uri(path: str) -> str:
    """path as pyarrow's file systems take it."""
    return path if "://" in path else path.replace("file:/", "file:///", 1) if path.startswith("file:/") else f"file://{path}"


def ordered(docs: DataFrame, **options) -> DataFrame:
    """materialise() into a new folder in the shared one."""
    return materialise(docs, uri(fresh_path(docs.sparkSession, "shards")), **options)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered(table(spark, sf_dir, "documents"))
