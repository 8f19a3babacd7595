"""Token ids in files: a context-mixing range coder over independent, checksummed blocks.

Format. A data set is a folder of Parquet files; each row is one block: ``part`` and ``block`` give
its place (parts hold ascending ids of documents, blocks follow each other in a part) and
``record`` is self-contained::

    "TKR1", ids u32, payload bytes u32, index bytes u32, crc32 of the ids u32, crc32 of payload and
    index u32, index, payload

The index lists the documents that end in the block: zlib over (doc_id i64, null flag u8, end u32).
All integers are little-endian. The models of a block start from nothing, so blocks are coded and
decoded in any order, and many side by side as the lanes of one vector.

Coding of an id. Two tables, addressed by the last two ids and by the last one, each predict an id
with a confidence of 0 to 7. Adaptive counts, kept per pair of confidences, mix both predictions
with the order-0 model into one interval: first id, second id, or neither. In the last case the
order-0 model gives the id's class (its bit length) by its frequency so far, and the bits that the
class leaves open are coded evenly. Intervals go through a carry-less range coder of 64 bits that emits 16-bit words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlytics.llm.common import chunks, settings
from reviewlytics.llm.encoding import encoder, with_end

MAGIC = b"TKR1"
HEAD = struct.Struct("<4sIIIII")
BLOCK_IDS = 1024
#: Blocks that are coded side by side; a step of all costs little more than a step of a few.
LANES = 4096
#: Bytes of text that are encoded at once.
TEXT_BYTES = 1 << 20
#: Executors hold whole texts in batches of so many bytes and rows instead of 64 MB and 4,096 rows: a task gets no more
#: at once than it encodes at once, and scanned texts need no arrays of many MB.
SMALL_BATCHES = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(TEXT_BYTES), "spark.sql.parquet.columnarReaderBatchSize": "256",
}
#: Entries of each prediction table of a lane.
SLOTS = 1 << 9
#: Classes of the order-0 model: ids below 2^NARROW, one per bit length up to 16, and the rest, which
#: is coded by two halves.
NARROW = 5
WIDE = 16 - NARROW + 1
_LIMIT = 1 << 14
RECORDS = "part int, block int, n_ids int, record binary"

_U = np.uint64
_FULL, _WORD, _TOP = _U((1 << 64) - 1), _U(16), _U(48)
_LOW48 = _U((1 << 48) - 1)
_ONE, _DROP = _U(1), _U(12)


class _Model:
    """Adaptive predictions of all lanes; coder and decoder take the same steps. Counts stand in
    one row per symbol, so that sums over symbols run along the lanes."""

    def __init__(self, lanes: int):
        self.base = np.arange(lanes) * SLOTS
        self.two = np.zeros(lanes * SLOTS, np.int32)  # id << 3 | confidence
        self.one = np.zeros(lanes * SLOTS, np.int32)
        self.mix = np.ones(3 * lanes * 64, np.int32)
        self.mix_base = np.arange(lanes) * 64
        self.states = lanes * 64
        self.bits = np.ones((WIDE + 1, lanes), np.int32)
        self.sums = np.zeros((WIDE + 1, lanes), np.int32)
        self.lane = np.arange(lanes)
        self.lanes = lanes
        self.last = np.zeros(lanes, np.int64)
        self.before = np.zeros(lanes, np.int64)

    def predict(self, n: int):
        """Counts of: order 2 is right, else order 1 is right, else neither; of the first n lanes."""
        last = self.last[:n]
        h = last * 0x9E3779B1
        self.s1 = self.base[:n] + ((h >> 5) & (SLOTS - 1))
        self.s2 = self.base[:n] + (((h + self.before[:n] * 0x85EBCA6B) >> 7) & (SLOTS - 1))
        self.e2, self.e1 = self.two.take(self.s2), self.one.take(self.s1)
        self.p2, self.p1 = self.e2 >> 3, self.e1 >> 3
        self.state = self.mix_base[:n] + ((self.e2 & 7) << 3) + (self.e1 & 7)
        m = self.states
        return self.mix.take(self.state), self.mix.take(self.state + m), self.mix.take(self.state + 2 * m)

    def bit_sums(self, n: int) -> np.ndarray:
        """Running sums of the order-0 counts over the classes of ids."""
        self.sums[0, :n] = self.bits[0, :n]
        for k in range(1, WIDE + 1):
            np.add(self.sums[k - 1, :n], self.bits[k, :n], out=self.sums[k, :n])
        return self.sums

    def update(self, n: int, ids: np.ndarray, choice: np.ndarray, total: np.ndarray) -> None:
        self.mix[choice * self.states + self.state] += 24
        if total.max() > _LIMIT:
            for k in range(3):
                high = self.state[total > _LIMIT] + k * self.states
                self.mix[high] = (self.mix[high] >> 1) + 1
        new = (ids << 3).astype(np.int32)
        for table, slot, e, p in ((self.two, self.s2, self.e2, self.p2), (self.one, self.s1, self.e1, self.p1)):
            c = e & 7
            table[slot] = np.where(p == ids, e + (c < 7), np.where(c > 1, e - c + (c >> 1), new))
        self.before[:n] = self.last[:n]
        self.last[:n] = ids

    def saw(self, rows: np.ndarray, column: np.ndarray, total: np.ndarray) -> None:
        self.bits[column, rows] += 24
        if total.max() > _LIMIT:
            high = rows[total > _LIMIT]
            self.bits[:, high] = (self.bits[:, high] >> 1) + 1


def _column(ids: np.ndarray) -> np.ndarray:
    """Class of an id: 0 below 2^NARROW, then one per bit length, WIDE from 2^16 on."""
    length = np.frexp(ids.astype(np.float64))[1]
    return np.clip(length - NARROW, 0, WIDE).astype(np.int64)


#: Per class: evenly coded bits, and the id that stands for zeros in them.
_EVEN = np.array([NARROW, *range(NARROW, 16), 16], np.uint64)
_FLOOR = np.array([0, *(1 << k for k in range(NARROW, 16)), 0], np.int64)


def _share(size: np.ndarray, total: np.ndarray) -> np.ndarray:
    """A little less than size / total. The upper 52 bits are divided as doubles, exact to one."""
    whole = (size >> _DROP).astype(np.float64) / total
    return (whole.astype(np.uint64) - _ONE) << _DROP


def _renewed(low, size):
    """Which lanes have a settled first word, and their size with a stuck interval cut down."""
    settled = ((low ^ (low + (size - _ONE))) >> _TOP) == 0
    small = size <= _LOW48
    move = np.flatnonzero(settled | small)
    if len(move):
        stuck = (small & ~settled)[move]
        # All 2^48 values of a settled word lose one: shifted, their number would be 2^64, that is 0, and settled for ever.
        low, size = low[move], np.minimum(size[move], _LOW48)
        if stuck.any():
            size = np.where(stuck, (~low + _ONE) & _LOW48, size)
    return move, low, size


class _Coder:
    def __init__(self, lanes: int, words: int):
        self.low = np.zeros(lanes, np.uint64)
        self.size = np.full(lanes, _FULL)
        self.at = np.zeros(lanes, np.int64)
        self.out = np.zeros((lanes, words), np.uint16)

    def renew(self, n: int) -> None:
        rows = None
        low, size = self.low[:n], self.size[:n]
        while True:
            move, low, size = _renewed(low, size)
            if not len(move):
                return
            rows = move if rows is None else rows[move]
            at = self.at[rows]
            if at.max() >= self.out.shape[1]:
                self.out = np.concatenate([self.out, np.zeros_like(self.out)], axis=1)
            self.out[rows, at] = (low >> _TOP).astype(np.uint16)
            self.at[rows] = at + 1
            low, size = low << _WORD, size << _WORD
            self.low[rows], self.size[rows] = low, size

    def payload(self, lane: int) -> bytes:
        low = int(self.low[lane])
        tail = np.array([(low >> k) & 0xFFFF for k in (48, 32, 16, 0)], np.uint16)
        return np.append(self.out[lane, : self.at[lane]], tail).astype("<u2").tobytes()


class _Reader:
    def __init__(self, words: np.ndarray):
        lanes = len(words)
        self.words = words
        self.low = np.zeros(lanes, np.uint64)
        self.size = np.full(lanes, _FULL)
        self.code = np.zeros(lanes, np.uint64)
        for k in range(4):
            self.code = (self.code << _WORD) | words[:, k].astype(np.uint64)
        self.at = np.full(lanes, 4, np.int64)

    def renew(self, n: int) -> None:
        rows = None
        low, size = self.low[:n], self.size[:n]
        while True:
            move, low, size = _renewed(low, size)
            if not len(move):
                return
            rows = move if rows is None else rows[move]
            at = np.minimum(self.at[rows], self.words.shape[1] - 1)
            self.code[rows] = (self.code[rows] << _WORD) | self.words[rows, at]
            self.at[rows] += 1
            low, size = low << _WORD, size << _WORD
            self.low[rows], self.size[rows] = low, size


def _whole(part: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """part // unit for quotients of at most 16 bits, by doubles and a correction."""
    q = (part.astype(np.float64) / unit.astype(np.float64)).astype(np.uint64)
    q -= (q * unit > part).astype(np.uint64)
    return q + ((q + _ONE) * unit <= part).astype(np.uint64)


def _grid(sizes: np.ndarray):
    """Lanes that are still on at each step; sizes are descending."""
    return np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Payloads of blocks of ids below 2^28, coded side by side."""
    out: list[bytes] = [b""] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
    for begin in range(0, len(order), LANES):
        lanes = order[begin : begin + LANES]
        sizes = np.array([len(blocks[k]) for k in lanes])
        steps = int(sizes[0])
        grid = np.zeros((steps, len(lanes)), np.uint32)
        for j, k in enumerate(lanes):
            grid[: sizes[j], j] = blocks[k]
        model, coder = _Model(len(lanes)), _Coder(len(lanes), steps + 16)
        for t, n in enumerate(_grid(sizes).tolist()):
            ids = grid[t, :n].astype(np.int64)
            a, b, c = model.predict(n)
            hit2, hit1 = ids == model.p2, ids == model.p1
            total = a + b + c
            unit = _share(coder.size[:n], total)
            choice = np.where(hit2, 0, np.where(hit1, 1, 2))
            low = coder.low[:n] + unit * np.where(hit2, 0, np.where(hit1, a, a + b)).astype(np.uint64)
            size = unit * np.where(hit2, a, np.where(hit1, b, c)).astype(np.uint64)
            miss = choice == 2
            rows = np.flatnonzero(miss)
            if len(rows):
                column = _column(ids)
                value = np.where(column == WIDE, ids >> 16, ids - _FLOOR.take(column)).astype(np.uint64)
                sums = model.bit_sums(n)
                at = column * model.lanes + model.lane[:n]
                part = model.bits.ravel().take(at)
                start = sums.ravel().take(at) - part
                unit = _share(size, sums[-1, :n])
                narrow = (unit * part.astype(np.uint64)) >> _EVEN.take(column)
                lower = low + unit * start.astype(np.uint64) + narrow * value
                low = np.where(miss, lower, low)
                size = np.where(miss, narrow, size)
                model.saw(rows, column[rows], sums[-1].take(rows))
                far = rows[column[rows] == WIDE]
                if len(far):
                    coder.low[:n], coder.size[:n] = low, size
                    coder.renew(n)
                    low, size = coder.low[:n].copy(), coder.size[:n].copy()
                    size[far] >>= _WORD
                    low[far] += size[far] * (ids[far] & 0xFFFF).astype(np.uint64)
            coder.low[:n], coder.size[:n] = low, size
            coder.renew(n)
            model.update(n, ids, choice, total)
        for j, k in enumerate(lanes):
            out[k] = coder.payload(j)
    return out


def decode_blocks(payloads: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids of the blocks, decoded side by side."""
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(payloads)
    order = sorted(range(len(payloads)), key=lambda k: -sizes[k])
    for begin in range(0, len(order), LANES):
        lanes = order[begin : begin + LANES]
        n_ids = np.array([sizes[k] for k in lanes])
        words = np.zeros((len(lanes), max(4, *(len(payloads[k]) // 2 for k in lanes)) + 1), np.uint16)
        for j, k in enumerate(lanes):
            words[j, : len(payloads[k]) // 2] = np.frombuffer(payloads[k], "<u2")
        model, reader = _Model(len(lanes)), _Reader(words)
        grid = np.zeros((int(n_ids[0]), len(lanes)), np.uint32)
        for t, n in enumerate(_grid(n_ids).tolist()):
            a, b, c = model.predict(n)
            total = a + b + c
            unit = _share(reader.size[:n], total)
            low = reader.low[:n]
            off = reader.code[:n] - low
            not2, miss = off >= unit * a.astype(np.uint64), off >= unit * (a + b).astype(np.uint64)
            choice = not2.astype(np.int64) + miss
            low = low + unit * np.where(miss, a + b, np.where(not2, a, 0)).astype(np.uint64)
            size = unit * np.where(miss, c, np.where(not2, b, a)).astype(np.uint64)
            ids = np.where(not2, model.p1, model.p2).astype(np.int64)
            rows = np.flatnonzero(miss)
            if len(rows):
                sums = model.bit_sums(n)
                off = reader.code[:n] - low
                unit = _share(size, sums[-1, :n])
                column = np.zeros(n, np.int64)
                for k in range(WIDE):
                    column += off >= unit * sums[k, :n].astype(np.uint64)
                at = column * model.lanes + model.lane[:n]
                part = model.bits.ravel().take(at)
                start = unit * (sums.ravel().take(at) - part).astype(np.uint64)
                even = _EVEN.take(column)
                narrow = np.maximum((unit * part.astype(np.uint64)) >> even, _ONE)
                value = np.minimum(_whole(off - start, narrow), (_ONE << even) - _ONE)
                low = np.where(miss, low + start + narrow * value, low)
                size = np.where(miss, narrow, size)
                x = value.astype(np.int64) + _FLOOR.take(column)
                model.saw(rows, column[rows], sums[-1].take(rows))
                far = rows[column[rows] == WIDE]
                if len(far):
                    reader.low[:n], reader.size[:n] = low, size
                    reader.renew(n)
                    low, size = reader.low[:n].copy(), reader.size[:n].copy()
                    size[far] >>= _WORD
                    value = np.minimum(_whole(reader.code[far] - low[far], size[far]), _U(0xFFFF))
                    low[far] += size[far] * value
                    x[far] = (x[far] << 16) | value.astype(np.int64)
                ids = np.where(miss, x, ids)
            reader.low[:n], reader.size[:n] = low, size
            reader.renew(n)
            grid[t, :n] = ids
            model.update(n, ids, choice, total)
        for j, k in enumerate(lanes):
            out[k] = grid[: sizes[k], j].copy()
    return out


def make_records(ids: list[np.ndarray], ends: list[list[tuple[int | None, int]]]) -> list[bytes]:
    """Records of blocks, each with the (doc_id, end) of the documents that end in it."""
    records = []
    for x, payload, docs in zip(ids, encode_blocks(ids), ends):
        table = b"".join(struct.pack("<qBI", d or 0, d is None, e) for d, e in docs)
        index = zlib.compress(table, 1)
        checked = zlib.crc32(payload, zlib.crc32(index))
        plain = zlib.crc32(x.astype("<u4").tobytes())
        records.append(HEAD.pack(MAGIC, len(x), len(payload), len(index), plain, checked) + index + payload)
    return records


def read_records(records: list[bytes]) -> list[tuple[np.ndarray, list[tuple[int | None, int]]]]:
    """Ids and document ends of each record; a damaged record raises ValueError."""
    heads, payloads, ends = [], [], []
    for record in records:
        if len(record) < HEAD.size or record[:4] != MAGIC:
            raise ValueError("not a token record")
        head = HEAD.unpack_from(record)
        body = record[HEAD.size :]
        if len(body) != head[2] + head[3] or zlib.crc32(body) != head[5]:
            raise ValueError("damaged token record")
        heads.append(head)
        payloads.append(body[head[3] :])
        found = struct.iter_unpack("<qBI", zlib.decompress(body[: head[3]]))
        ends.append([(None if null else d, e) for d, null, e in found])
    ids = decode_blocks(payloads, [h[1] for h in heads])
    for x, head in zip(ids, heads):
        if zlib.crc32(x.astype("<u4").tobytes()) != head[4]:
            raise ValueError("damaged token record")
    return list(zip(ids, ends))


def _records(path: str, end_id: int, block_ids: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        number, rest, pending, ends = 0, np.zeros(0, np.uint32), [], []

        def flush():
            nonlocal number, pending, ends
            if pending:
                records = make_records(pending, ends)
                sizes = [len(x) for x in pending]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([part] * len(records), pa.int32()),
                        "block": pa.array(range(number, number + len(records)), pa.int32()),
                        "n_ids": pa.array(sizes, pa.int32()),
                        "record": pa.array(records, pa.binary()),
                    }
                )
                number, pending, ends = number + len(records), [], []

        open_ends: list[tuple[int | None, int]] = []
        for batch, data, offsets in chunks(batches, "text", TEXT_BYTES):
            ids, before = with_end(*encoder(path).encode(data, offsets), end_id)
            docs = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            open_ends += zip(docs, (before[1:] + len(rest)).tolist())
            ids = np.concatenate([rest, ids])
            full = len(ids) // block_ids * block_ids
            k = 0
            for begin in range(0, full, block_ids):
                pending.append(ids[begin : begin + block_ids])
                mine = []
                while k < len(open_ends) and open_ends[k][1] <= begin + block_ids:
                    mine.append((open_ends[k][0], open_ends[k][1] - begin))
                    k += 1
                ends.append(mine)
                if len(pending) >= LANES:
                    yield from flush()
            rest = ids[full:].copy()
            open_ends = [(d, e - full) for d, e in open_ends[k:]]
        if len(rest):
            pending.append(rest)
            ends.append(open_ends)
        yield from flush()

    return run


def write_tokens(
    docs: DataFrame, folder: str, path: str, end_id: int = 2, block_ids: int = BLOCK_IDS
) -> None:
    """Ids of every whole text, each followed by ``end_id``, in ascending order of doc_id.

    Null and empty texts are the end id alone; null doc_ids come first; rows with one doc_id keep
    some order among themselves and each its own entry. Other columns are ignored. An empty table
    gives a data set without blocks. A document may span blocks, never parts.
    """
    spread = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    spread = spread.repartitionByRange(F.col("doc_id").asc_nulls_first())
    spread = spread.sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    with settings(docs.sparkSession, SMALL_BATCHES):
        spread.mapInArrow(_records(path, end_id, block_ids), RECORDS).write.mode("overwrite").parquet(folder)


def _documents(with_ids: bool):
    def run(batches):
        part, held, crc, seen, at = None, [], 0, 0, 0
        records: list[tuple[int, bytes]] = []

        def emit():
            nonlocal part, held, crc, seen, at, records
            rows = []
            for (p, _), (ids, ends) in zip(records, read_records([r for _, r in records])):
                if p != part:
                    part, held, crc, seen, at = p, [], 0, 0, 0
                raw, begin = ids.astype("<u4").tobytes(), 0
                for doc, end in ends:
                    crc = zlib.crc32(raw[4 * begin : 4 * end], crc)
                    held.append(ids[begin:end] if with_ids else None)
                    n = seen + end - begin
                    rows.append((p, doc, at, n, crc, np.concatenate(held).tolist() if with_ids else None))
                    at, crc, seen, begin, held = at + n, 0, 0, end, []
                crc = zlib.crc32(raw[4 * begin :], crc)
                seen += len(ids) - begin
                held.append(ids[begin:] if with_ids else None)
            records = []
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            names = ["part", "doc_id", "start", "n_tokens", "ids_crc32", "ids"]
            made = [pa.array(c, t) for c, t in zip(columns, types)]
            return pa.RecordBatch.from_arrays(made[: 5 + with_ids], names=names[: 5 + with_ids])

        for batch in batches:
            parts = batch.column(batch.schema.get_field_index("part")).to_pylist()
            for p, record in zip(parts, batch.column(batch.schema.get_field_index("record"))):
                records.append((p, record.as_py()))
                if len(records) >= LANES:
                    yield emit()
        yield emit()

    return run


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of a data set, decoded from its
    blocks; with_ids adds the ids. ``start`` counts the ids of all documents before it."""
    blocks = spark.read.schema(RECORDS).parquet(folder)
    totals = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    base, starts = 0, []
    for part in sorted(totals):
        starts.append((part, base))
        base += totals[part]
    # One row per part, that is per task that wrote the data set.
    shift = F.broadcast(spark.createDataFrame(starts, "part int, base bigint"))
    ordered = blocks.select("part", "block", "record").repartitionById(max(totals, default=0) + 1, F.col("part"))
    ordered = ordered.sortWithinPartitions("part", "block")
    schema = "part int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    found = ordered.mapInArrow(_documents(with_ids), schema + (", ids array<bigint>" if with_ids else ""))
    names = ["doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32"]
    return found.join(shift, "part").select(*names, *(["ids"] if with_ids else []))
