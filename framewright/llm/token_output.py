"""Token-id output by a static range asymmetric numeral system (rANS).

All token ids are coded under one shared frequency table. A *segment*, the file unit, holds the whole documents of a range of
ids; its tokens are cut into independent blocks, each of which interleaves LANES coders over one stream of 32-bit words.
Checkpoints in a block (all coder states and the place in the stream) let a reader start there; each block has a checksum of
its ids. Encoding and decoding run in numpy over all lanes of all blocks of a segment at once.

Layout of a segment, little-endian. Header: magic ``FWR1``, then u32 scale bits, lanes, steps per block, steps per
checkpoint, number of blocks, crc32 of the frequency table; u64 number of tokens. Then for each block: u32 number of
tokens, number of words, crc32 of its ids as u32; then its checkpoints, the first at step 0: u32 place in the stream, u64
state of each lane; then its words, u32. Token i of a block is step i // lanes of lane i % lanes.

Segments are rows (part, segment, doc_ids, doc_tokens, n_tokens, data) of Parquet in the folder ``segments``, so that Spark's
committer makes them whole or not at all and any store Spark knows can hold them; ``table`` has the frequencies.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._encode import encoder
from ._spark import _STAGED, arrow_type, passed, shared_dir, small_batches, stage

LANES, STEPS, CHECK_STEPS = 64, 512, 128
SEGMENT_TOKENS = 1 << 21
GROUP_PARTS = 2048
LOW = np.uint64(1 << 31)
_U, _32 = np.uint64, np.uint64(32)
_HEAD = struct.Struct("<4s6IQ")


class Table:
    """Frequencies of symbols 0 to n - 1, which add up to 2**bits."""

    def __init__(self, freq: np.ndarray, bits: int):
        self.freq, self.bits = freq.astype(_U), bits
        self.start = np.cumsum(self.freq) - self.freq
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        """Each symbol that occurs gets a share of at least one; the rest goes by counts."""
        used = int((counts > 0).sum())
        bits = max(14, int(used).bit_length() + 2)
        total = max(1, int(counts.sum()))
        freq = np.where(counts > 0, np.maximum(1, (counts.astype(float) * (1 << bits) / total).astype(np.int64)), 0)
        if not used:
            freq[:1] = 1
        off = (1 << bits) - int(freq.sum())
        order = np.argsort(-freq, kind="stable")
        for k in order:  # the most frequent give or take what is left over
            step = off if off > 0 else max(off, 1 - int(freq[k]))
            freq[k] += step
            off -= step
            if not off:
                break
        return cls(freq, bits)

    def symbols(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))


def encode_segment(ids: np.ndarray, table: Table) -> bytes:
    """ids (unsigned 32 bits) as the bytes of a segment."""
    block = LANES * STEPS
    n_blocks = -(-len(ids) // block)
    padded = np.full(n_blocks * block, int(table.freq.argmax()), np.int64)
    padded[: len(ids)] = ids
    grid = padded.reshape(n_blocks, STEPS, LANES)
    state = np.full((n_blocks, LANES), LOW, _U)
    shift, bits = _U(63 - table.bits), _U(table.bits)
    words, owner, marks = [], [], []
    number = np.broadcast_to(np.arange(n_blocks)[:, None], state.shape)
    sent = np.zeros((STEPS, n_blocks), np.int64)
    for step in range(STEPS - 1, -1, -1):
        symbol = grid[:, step]
        freq = table.freq[symbol]
        full = state >= freq << shift
        words.append((state[full] & _U(0xFFFFFFFF)).astype(np.uint32))
        owner.append(number[full])
        sent[step] = full.sum(1)
        state = np.where(full, state >> _32, state)
        whole = state // freq
        state = (whole << bits) + (state - whole * freq) + table.start[symbol]
        if step % CHECK_STEPS == 0:
            marks.append(state.copy())  # the states from which this step is decoded
    words, owner = np.concatenate([*words[::-1], np.zeros(0, np.uint32)]), np.concatenate([*owner[::-1], np.zeros(0, np.int64)])
    words = words[np.argsort(owner, kind="stable")].astype("<u4")
    before = np.cumsum(sent, 0) - sent
    n_words = sent.sum(0)
    ends = np.cumsum(n_words)
    out = [_HEAD.pack(b"FWR1", table.bits, LANES, STEPS, CHECK_STEPS, n_blocks, table.crc, len(ids))]
    for b in range(n_blocks):
        own = ids[b * block : (b + 1) * block].astype("<u4")
        out.append(struct.pack("<3I", len(own), n_words[b], zlib.crc32(own.tobytes())))
        for k, mark in enumerate(marks[::-1]):
            out += [struct.pack("<I", before[k * CHECK_STEPS, b]), mark[b].astype("<u8").tobytes()]
        out.append(words[ends[b] - n_words[b] : ends[b]].tobytes())
    return b"".join(out)


def _blocks(data: bytes, table: Table) -> Iterator[tuple[int, int, list[int], list[np.ndarray], np.ndarray]]:
    magic, bits, lanes, steps, every, n_blocks, crc, _ = _HEAD.unpack_from(data)
    if magic != b"FWR1" or (bits, crc) != (table.bits, table.crc) or (lanes, steps, every) != (LANES, STEPS, CHECK_STEPS):
        raise ValueError("not a segment of this table")
    at = _HEAD.size
    for _ in range(n_blocks):
        n, n_words, check = struct.unpack_from("<3I", data, at)
        at += 12
        places, states = [], []
        for _ in range(steps // every):
            places.append(struct.unpack_from("<I", data, at)[0])
            states.append(np.frombuffer(data, "<u8", lanes, at + 4))
            at += 4 + 8 * lanes
        yield n, check, places, states, np.frombuffer(data, "<u4", n_words, at)
        at += 4 * n_words


def decode_segment(data: bytes, table: Table, symbols: np.ndarray) -> np.ndarray:
    """The ids of a segment: from every checkpoint of every block at once; raises ValueError if a checksum doesn't hold."""
    blocks = list(_blocks(data, table))
    if not blocks:
        return np.zeros(0, np.uint32)
    per = STEPS // CHECK_STEPS
    words = np.concatenate([*(b[4] for b in blocks), np.zeros(1, "<u4")]).astype(_U)
    begin = np.cumsum([0, *(len(b[4]) for b in blocks)])
    place = np.array([begin[k] + p for k, b in enumerate(blocks) for p in b[2]])
    state = np.array([s for b in blocks for s in b[3]], _U)
    out = np.empty((len(state), CHECK_STEPS, LANES), np.uint32)
    bits, mask = _U(table.bits), _U((1 << table.bits) - 1)
    for step in range(CHECK_STEPS):
        slot = state & mask
        symbol = symbols[slot]
        out[:, step] = symbol
        state = table.freq[symbol] * (state >> bits) + slot - table.start[symbol]
        low = state < LOW
        rank = np.cumsum(low, 1)
        state[low] = state[low] << _32 | words[np.minimum((place[:, None] + rank - 1)[low], len(words) - 1)]  # beyond the end only if damaged
        place = place + rank[:, -1]
    ids = out.reshape(len(blocks), per * CHECK_STEPS * LANES)
    parts = [ids[k, : b[0]] for k, b in enumerate(blocks)]
    for part, b in zip(parts, blocks):
        if zlib.crc32(part.astype("<u4").tobytes()) != b[1]:
            raise ValueError("a block's checksum doesn't hold")
    return np.concatenate(parts)


def _tokens(path: str, end: int, vocabulary: int):
    """Arrow rows (id, text_hash, text) -> (id, text_hash, n_tokens, ids), ids compressed and of 16 bits where the vocabulary allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encode, last, pack = encoder(path, glue=True).encode, np.array([end], "<u4"), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                ids = [np.concatenate([x, last]) for x in encode(some.column(2))]
                small = [pack((x.astype("<u2") if vocabulary <= 1 << 16 else x).tobytes()) for x in ids]
                yield pa.RecordBatch.from_arrays([*map(passed, some.columns[:2]), pa.array([len(x) for x in ids], pa.int64()), pa.array(small, pa.binary())], ["id", "text_hash", "n_tokens", "ids"])

    return run


def _unpacked(ids: pa.Array, vocabulary: int) -> Iterator[np.ndarray]:
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    for x in ids:
        yield np.frombuffer(open_(x.as_buffer()), "<u2" if vocabulary <= 1 << 16 else "<u4")


def _count(vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(np.concatenate(list(_unpacked(batch.column(0), vocabulary))), minlength=vocabulary)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["token", "n"])

    return run


def _segments(freq: np.ndarray, bits: int, vocabulary: int, id_type: pa.DataType):
    """Arrow rows (id, n_tokens, ids) in order -> rows of segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, number = Table(freq, bits), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        docs: list = []

        def segment() -> pa.RecordBatch:
            all_ids = np.concatenate(ids)
            columns = [pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([docs], pa.list_(id_type)), pa.array([[len(x) for x in ids]], pa.list_(pa.int64())), pa.array([len(all_ids)], pa.int64()), pa.array([encode_segment(all_ids, table)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "segment", "doc_ids", "doc_tokens", "n_tokens", "data"])

        held = 0
        for batch in batches:
            for id, own in zip(batch.column(0).to_pylist(), _unpacked(batch.column(2), vocabulary)):
                ids.append(own)
                docs.append(id)
                held += len(own)
                if held >= SEGMENT_TOKENS:
                    yield segment()
                    ids, docs, held, number = [], [], 0, number + 1
        if docs:
            yield segment()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, vocabulary: int, id: str = "doc_id", text: str = "text", end: int = 0) -> None:
    """Writes the ids of all texts, each with ``end`` after it, by ascending id (null first) to the folder path.

    A null text is empty. Rows with equal ids follow each other by text hash; each is a document of its own. Other columns are
    ignored. An empty table makes no segment. A document is never cut, so one longer than SEGMENT_TOKENS is a segment alone.
    """
    small_batches(docs.sparkSession)
    source = docs.select(docs[id].alias("id"), F.xxhash64(docs[text]).alias("text_hash"), docs[text].alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    tokens = stage(source.mapInArrow(_tokens(tokenizer, end, vocabulary), f"id {kind}, text_hash bigint, n_tokens bigint, ids binary"), compression="uncompressed")
    found = tokens.select("ids").mapInArrow(_count(vocabulary), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect()  # a row a symbol of the vocabulary
    counts = np.zeros(vocabulary, np.int64)
    for r in found:
        counts[r["token"]] = r["n"]
    table = Table.of(counts)
    spark = docs.sparkSession
    spark.createDataFrame([(table.bits, table.freq.astype("<u4").tobytes())], "bits int, freq binary").coalesce(1).write.parquet(f"{path}/table")
    n = max(1, -(-int(counts.sum()) // SEGMENT_TOKENS))
    ordered = tokens.repartitionByRange(n, "id", "text_hash").sortWithinPartitions("id", "text_hash").select("id", "n_tokens", "ids")
    run = _segments(table.freq, table.bits, vocabulary, arrow_type(ordered, "id"))
    ordered.mapInArrow(run, f"part bigint, segment bigint, doc_ids array<{kind}>, doc_tokens array<bigint>, n_tokens bigint, data binary").write.option("compression", "uncompressed").parquet(f"{path}/segments")


def _decoded(freq: np.ndarray, bits: int, kind: pa.DataType, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq, bits)
        symbols = table.symbols()
        for batch in batches:
            for row in range(batch.num_rows):
                part, segment, docs, sizes, data = (c[row] for c in batch.columns)
                ids, sizes = decode_segment(data.as_buffer().to_pybytes(), table, symbols).astype("<u4"), np.array(sizes.as_py(), np.int64)
                ends = np.cumsum(sizes)
                own = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist())]
                columns = [pa.array([part.as_py()] * len(own), pa.int64()), pa.array([segment.as_py()] * len(own), pa.int64()), pa.array(docs.as_py(), kind), pa.array(ends - sizes), pa.array(sizes), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(own, pa.binary())] if with_ids else [])], ["part", "segment", "id", "before", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return run


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """The documents of a folder that write_tokens() made: doc_id, start, n_tokens, ids_crc32 (and ids as packed integers)."""
    head = spark.read.parquet(f"{path}/table").first()
    freq = np.frombuffer(bytes(head["freq"]), "<u4").astype(_U)
    segments = spark.read.parquet(f"{path}/segments")
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    arrow = arrow_type(segments.select(F.explode("doc_ids").alias("id")), "id")
    # tokens before each segment: within its part, of the parts before it in its group, and of the groups before that; a row a
    # group of GROUP_PARTS parts (some billions of tokens) is all that meets in one task
    sizes = segments.select("part", "segment", "n_tokens", F.floor(F.col("part") / GROUP_PARTS).alias("group"))
    before = lambda order, by=(): F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("group", "part").agg(F.sum("n_tokens").alias("n"))
    groups = parts.groupBy("group").agg(F.sum("n").alias("n")).select("group", before(["group"]).alias("of_groups"))
    parts = parts.select("group", "part", before(["part"], ["group"]).alias("of_parts"))
    base = sizes.select("group", "part", "segment", F.col("n_tokens").alias("n")).withColumn("of_part", before(["segment"], ["part"]))
    base = base.join(parts, ["group", "part"]).join(groups, "group").select("part", "segment", (F.col("of_groups") + F.col("of_parts") + F.col("of_part")).alias("base"))
    columns = f"part bigint, segment bigint, id {kind}, before bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * ids
    out = segments.select("part", "segment", "doc_ids", "doc_tokens", "data").mapInArrow(_decoded(freq, head["bits"], arrow, ids), columns)
    return out.join(base, ["part", "segment"]).select(F.col("id").alias("doc_id"), (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: where each document's ids lie in the files, and what they are."""
    import public_tokenizers

    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"), 50257)
    return read_tokens(spark, path)
