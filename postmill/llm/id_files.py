"""Token ids in binary files, compressed by an adaptive context-mixing range coder.

Format of a file (little-endian): the magic, a version, the numbers of documents, ids, blocks and classes; doc_id, a null
mark and the number of ids per document; ids, payload words and checksums (payload, ids) per block; the payloads; a
checksum of everything before the payloads. A block is coded on its own: its models start anew, so blocks can be
read and checked one by one.

Model of a block. The order-2 and the order-1 context (hashed slots) each predict the id that last proved right there, with a
confidence of 0 to 3. Adaptive weights, one set for each pair of confidences, mix both predictions with the order-0 model;
predictions that agree add up. The order-0 model has adaptive counts of classes (leading bits of an id; lower ids are
commoner in merge-ordered vocabularies), the remaining bits are even. A range coder with 64-bit state and 32-bit words
codes the outcome.

All blocks of a file are coded in lockstep by array operations, one id of each block at a time, so the coder runs over many
blocks as vectors while each block stays independent.

Files are rows (shard, number, data) of a Parquet table in a folder that all executors share.

Defined results: a null text is empty and holds the end id only; a null doc_id comes last; rows with one doc_id follow each
other in the order of their texts; a very long text is encoded whole, in a file of its own if it must; an empty table makes no
file. Other columns of the table are not read.
"""

from __future__ import annotations

import itertools
import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import scratch_path
from .arrow import library_in_one_thread, process_cache, slices, strings
from .pieces import Bounded, Vocabulary, cut

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
MAGIC, VERSION = b"CMID", 1
BLOCK_IDS = 2048
# A shard of usual texts is one file, so its blocks are coded side by side in one go.
FILE_IDS = 8 << 20
SHARD_BYTES = 16 << 20
CHUNK_BYTES = 4 << 20
# What a worker keeps of earlier texts: pieces, their letters, and ids.
CACHED_PIECES, CACHED_LETTERS, CACHED_IDS = 500_000, 8 << 20, 2 << 20
ONE_BITS, TWO_BITS = 8, 9
STEP, MOST_WEIGHT, CLASS_STEP = 24, 4000, 24
# Up to here the counts of classes fit 16 bits.
MOST_BLOCK = (65535 - 256) // CLASS_STEP
_HASH = (np.int32(0x1E3779B1), np.int32(0x05EBCA6B), np.int32(0x2545F491))
_WORD = np.uint64(1 << 32)
_LOW = np.uint64((1 << 32) - 1)
_32 = np.uint64(32)
_CONF = 24
_ID = np.int32((1 << _CONF) - 1)
_SLOTS = (1 << ONE_BITS) + (1 << TWO_BITS)
# By whether a prediction was right.
_CONF_STEPS = np.array([-1, 1], dtype=np.int32)
# Three weights in a word, those of order 2, 1 and 0 from the lowest bits on.
_FIELD = 20
_U_FIELD, _U_FIELD_2 = np.uint64(_FIELD), np.uint64(2 * _FIELD)
_FIELD_MASK = np.uint64((1 << _FIELD) - 1)
# Halved weights: the lowest bit of a field falls into the one below.
_FIELD_MASKS = np.uint64(sum((1 << _FIELD - 1) - 1 << k * _FIELD for k in range(3)))
_FIELD_ONES = np.uint64(sum(1 << k * _FIELD for k in range(3)))
# By order 2 right, plus twice order 1 right.
_GAINS = np.array([STEP << 2 * _FIELD, STEP, STEP << _FIELD, STEP | STEP << _FIELD], dtype=np.uint64)


def class_table() -> np.ndarray:
    """The class of each id below 2 ** 16: below 8 the id itself, then the length and two bits behind the leading one."""
    ids = np.arange(1 << 16)
    bits = np.maximum(np.frexp(ids.astype(np.float64))[1] - 3, 0)
    return np.where(ids < 8, ids, 4 + bits * 4 + ((ids >> bits) & 3)).astype(np.uint8)


def class_of(ids: np.ndarray, classes: int) -> np.ndarray:
    table = process_cache("id_classes", class_table)
    if classes <= int(table[-1]) + 1:
        return table[ids]
    # Eight bits more move an id eight lengths up.
    high = ids >> 8
    return np.where(high >= 8, table[high] + np.uint8(32), table[ids & 0xFFFF])


def split_ids(ids: np.ndarray, classes: int):
    """(class, number of remaining bits, remaining bits)."""
    kind = class_of(ids, classes)
    bits = np.where(kind < 8, 0, (kind.astype(np.int32) - 8 >> 2) + 1)
    return kind, bits, ids & ((1 << bits) - 1)


class _Blocks:
    """Models and coder states of blocks that are coded side by side.

    Order 1 and 2 are two rows of one array, indexes are 64 bits wide and weights lie three to a word: a step's cost is in its
    calls and its accesses by index.
    """

    def __init__(self, lanes: int, classes: int):
        # The slots of a block's order-1 and order-2 contexts.
        self.table = np.zeros(lanes * _SLOTS, dtype=np.int32)
        self.weights = np.full(lanes << 4, 4 | 4 << _FIELD | 8 << 2 * _FIELD, dtype=np.uint64)
        # Cumulative counts, one row per class; all blocks have the same total.
        self.upto = np.repeat(np.arange(classes + 1, dtype=np.uint16)[:, None], lanes, axis=1)
        self.names = np.arange(classes + 1, dtype=np.int16)[:, None]
        self.total = classes
        self.last, self.before = np.zeros(lanes, dtype=np.int32), np.zeros(lanes, dtype=np.int32)
        self.low = np.zeros(lanes, dtype=np.uint64)
        self.range = np.full(lanes, (1 << 64) - 1, dtype=np.uint64)
        self.at = np.zeros(lanes, dtype=np.int64)
        self._size(lanes)

    def _size(self, lanes: int) -> None:
        self.lanes = lanes
        rows = np.arange(lanes, dtype=np.int64)
        # A block's column in one row of an array of blocks, and in the next.
        self.columns = np.stack([rows, rows + lanes])
        self.slots = np.stack([rows * _SLOTS, rows * _SLOTS + (1 << ONE_BITS)])
        self.sets = rows << 4
        # Where the outcomes begin: order 2, order 1, order 0, and the end.
        self.bounds = np.zeros((4, lanes), dtype=np.uint64)
        self.above = np.empty(self.upto.shape, dtype=np.int16)

    def trim(self, lanes: int) -> None:
        """Only the first blocks have one more id."""
        for name in ("last", "before", "low", "range", "at"):
            setattr(self, name, getattr(self, name)[:lanes])
        self.upto = np.ascontiguousarray(self.upto[:, :lanes])
        self._size(lanes)

    def predict(self) -> None:
        self.place = self.slots.copy()
        self.place[0] += (self.last * _HASH[0] >> 12) & ((1 << ONE_BITS) - 1)
        self.place[1] += (self.last * _HASH[1] + self.before * _HASH[2] >> 14) & ((1 << TWO_BITS) - 1)
        entries = self.table[self.place]
        self.ids, self.conf = entries & _ID, entries >> _CONF
        self.set = self.sets + ((self.conf[1] << 2) + self.conf[0])
        self.w = self.weights[self.set]
        a, b, c = self.w & _FIELD_MASK, (self.w >> _U_FIELD) & _FIELD_MASK, self.w >> _U_FIELD_2
        _, m2, m21, whole = self.bounds
        # Predictions that agree add up.
        np.add(a, b * (self.ids[0] == self.ids[1]), out=m2)
        np.add(a, b, out=m21)
        np.add(m21, c, out=whole)

    def narrow(self, part: np.ndarray, outcome: np.ndarray) -> np.ndarray:
        """Take the share of the outcome (0, 1: predicted by order 2, 1; 2: by neither); returns its places in ``bounds``."""
        places = self.columns + outcome * np.int64(self.lanes)
        start, end = self.bounds.reshape(-1)[places]
        self.low += part * start
        self.range = part * (end - start)
        return places[0]

    def learn(self, ids: np.ndarray, classes: np.ndarray) -> None:
        off, known, conf = ids - self.ids, self.ids, self.conf
        right = off == 0
        bits = right.view(np.uint8)
        weights = self.w + _GAINS[bits[1] + (bits[0] << 1)]
        over = self.bounds[3] > np.uint64(MOST_WEIGHT - 2 * STEP)
        self.weights[self.set] = ((weights >> _u(over)) & _FIELD_MASKS) | _FIELD_ONES
        # An id with confidence 0 that proved wrong is replaced.
        off *= conf == 0
        off += known
        conf += _CONF_STEPS[bits]
        np.maximum(conf, 0, out=conf)
        np.minimum(conf, 3, out=conf)
        conf <<= _CONF
        off += conf
        self.table[self.place] = off
        # -1 where the row's class is above, 0 elsewhere.
        np.subtract(classes.astype(np.int16), self.names, out=self.above)
        self.above >>= 15
        self.above &= CLASS_STEP
        self.upto += self.above.view(np.uint16)
        self.total += CLASS_STEP
        self.before, self.last = self.last, ids

    def counts(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, end = _u(self.upto.reshape(-1)[self.columns + classes * np.int64(self.lanes)])
        return begin, end - begin

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """(blocks whose range is short, the words they are done with); a range across a word boundary is cut there."""
        short = np.flatnonzero(self.range < _WORD)
        low, size = self.low[short], self.range[short]
        if len(short):
            across = (low ^ (low + size - np.uint64(1))) >= _WORD
            self.range[short] = np.where(across, _WORD - (low & _LOW), size) << _32
            self.low[short] = low << _32
        return short, low >> _32


def _u(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64)


def _sizes(n: int, block: int) -> tuple[int, int, int]:
    """(blocks, ids of the longer ones, number of longer ones): sizes differ by one at most."""
    lanes = max(1, -(-n // block))
    return lanes, -(-n // lanes), (n - 1) % lanes + 1


def _lay(ids: np.ndarray, lanes: int, long: int, longer: int) -> np.ndarray:
    """ids as [step, block]; the shorter blocks lack the last step."""
    table = np.zeros((lanes, long), dtype=np.int32)
    cut_at = longer * long
    table[:longer] = ids[:cut_at].reshape(longer, long)
    if longer < lanes:
        table[longer:, : long - 1] = ids[cut_at:].reshape(lanes - longer, long - 1)
    return np.ascontiguousarray(table.T)


def encode_ids(ids: np.ndarray, block: int = BLOCK_IDS):
    """(number of classes, list of (ids, payload) per block)."""
    if len(ids) == 0:
        return 1, []
    if int(ids.max()) > _ID or int(ids.min()) < 0:
        raise ValueError("ids have 24 bits at most")
    if block > MOST_BLOCK:
        raise ValueError("the counts of a block have 16 bits")
    lanes, long, longer = _sizes(len(ids), block)
    table = _lay(ids, lanes, long, longer)
    classes = int(class_of(np.array([ids.max()], dtype=np.int32), 256)[0]) + 1
    model = _Blocks(lanes, classes)
    words = np.zeros((lanes, 128), dtype=np.uint32)

    def put() -> None:
        short, done = model.settle()
        if len(short):
            at = model.at[short]
            words.reshape(-1)[short * words.shape[1] + at] = done
            model.at[short] = at + 1

    for step in range(long):
        if step == long - 1 and longer < lanes:
            tail = model.low[longer:].copy(), model.at[longer:].copy()
            model.trim(longer)
        # Two words a step at most.
        if step % 32 == 0 and words.shape[1] < int(model.at.max(initial=0)) + 66:
            words = np.concatenate([words, np.zeros_like(words)], axis=1)
        if step % 64 == 0:
            kinds, bits, rests = split_ids(table[step : step + 64], classes)
            bits, rests = _u(bits), _u(rests)
        now = table[step][: model.lanes]
        kind, bit, rest = [x[step % 64][: model.lanes] for x in (kinds, bits, rests)]
        model.predict()
        literal, wrong2 = now != model.ids
        literal &= wrong2
        model.narrow(model.range // model.bounds[3], wrong2.view(np.uint8) + literal.view(np.uint8))
        put()
        begin, count = model.counts(kind)
        part = model.range // np.uint64(model.total)
        size = (part * count) >> bit
        model.low += (part * begin + size * rest) * literal
        np.copyto(model.range, size, where=literal)
        put()
        model.learn(now, kind)
    low, at = model.low, model.at
    if longer < lanes:
        low, at = np.concatenate([low, tail[0]]), np.concatenate([at, tail[1]])
    # One word that lies in the range; the reader continues with zeros.
    words = np.concatenate([words, np.zeros((lanes, 2), dtype=np.uint32)], axis=1)
    words[np.arange(lanes), at] = (low + _LOW) >> _32
    out = []
    for i in range(lanes):
        out.append((long if i < longer else long - 1, words[i, : at[i] + 1].astype("<u4").tobytes()))
    return classes, out


def decode_ids(classes: int, blocks: list[tuple[int, bytes]]) -> np.ndarray:
    """The ids of blocks whose sizes differ by one at most, longer ones first."""
    if not blocks:
        return np.zeros(0, dtype=np.int64)
    lanes, long = len(blocks), blocks[0][0]
    longer = sum(n == long for n, _ in blocks)
    width = max(len(p) for _, p in blocks) // 4 + 4
    words = np.zeros((lanes, width), dtype=np.uint64)
    for i, (_, payload) in enumerate(blocks):
        words[i, : len(payload) // 4] = np.frombuffer(payload, dtype="<u4")
    model = _Blocks(lanes, classes)
    code = (words[:, 0] << _32) | words[:, 1]
    model.at += 2
    table = np.zeros((long, lanes), dtype=np.int32)
    class_bits = np.array([0 if k < 8 else (k - 8) // 4 + 1 for k in range(classes)], dtype=np.uint64)
    class_base = np.array([k if k < 8 else (4 | (k - 8) & 3) << (k - 8) // 4 + 1 for k in range(classes)], dtype=np.int32)

    found = np.empty((3, lanes), dtype=np.int32)

    def take() -> None:
        short, _ = model.settle()
        if len(short):
            at = model.at[short]
            code[short] = (code[short] << _32) | words.reshape(-1)[short * width + np.minimum(at, width - 1)]
            model.at[short] = at + 1

    for step in range(long):
        if step == long - 1 and longer < lanes:
            model.trim(longer)
            code = code[:longer]
            found = np.empty((3, longer), dtype=np.int32)
        model.predict()
        part = model.range // model.bounds[3]
        behind = code - model.low
        wrong2, literal = behind >= model.bounds[1] * part, behind >= model.bounds[2] * part
        places = model.narrow(part, wrong2.view(np.uint8) + literal.view(np.uint8))
        take()
        part = model.range // np.uint64(model.total)
        behind = code - model.low
        share = np.minimum(behind // part, np.uint64(model.total - 1)).astype(np.uint16)
        kind = np.add.reduce((model.upto[1:] <= share).view(np.uint8), axis=0, dtype=np.uint8)
        begin, count = model.counts(kind)
        size = (part * count) >> class_bits[kind]
        base = part * begin
        rest = (behind - base) // np.maximum(size, np.uint64(1))
        model.low += (base + size * rest) * literal
        np.copyto(model.range, size, where=literal)
        take()
        found[0], found[1] = model.ids[1], model.ids[0]
        np.add(class_base[kind], rest.astype(np.int32), out=found[2])
        now = found.reshape(-1)[places]
        # The class of an id that was predicted.
        kind = class_of(now, classes)
        table[step, : len(now)] = now
        model.learn(now, kind)
    flat = table.T
    if longer == lanes:
        return flat.reshape(-1)
    return np.concatenate([flat[:longer].reshape(-1), flat[longer:, : long - 1].reshape(-1)])


_HEAD = "<4sHHQQI"
_HEAD_SIZE = struct.calcsize(_HEAD)


def write_file(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    classes, blocks = encode_ids(ids)
    head = struct.pack(_HEAD, MAGIC, VERSION, classes, len(doc_ids), len(ids), len(blocks))
    nulls = np.array([d is None for d in doc_ids], dtype=np.uint8)
    known = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    sums, at = [], 0
    for n, payload in blocks:
        sums.append((n, len(payload) // 4, zlib.crc32(payload), zlib.crc32(ids[at : at + n].astype("<u4").tobytes())))
        at += n
    index = head + known.tobytes() + nulls.tobytes() + lengths.astype("<u4").tobytes() + np.array(sums, dtype="<u4").tobytes()
    return b"".join([index, struct.pack("<I", zlib.crc32(index)), *[p for _, p in blocks]])


def read_file(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a file; a wrong checksum raises ValueError."""
    if len(data) < _HEAD_SIZE:
        raise ValueError("file is cut off")
    magic, version, classes, docs, n_ids, n_blocks = struct.unpack_from(_HEAD, data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a file of token ids of this version")
    at = _HEAD_SIZE
    size = docs * 13 + n_blocks * 16
    if len(data) < at + size + 4 or zlib.crc32(data[: at + size]) != struct.unpack_from("<I", data, at + size)[0]:
        raise ValueError("checksum of the index is wrong")
    known = np.frombuffer(data, "<i8", docs, at)
    nulls = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(data, "<u4", docs, at + 9 * docs).astype(np.int64)
    sums = np.frombuffer(data, "<u4", 4 * n_blocks, at + 13 * docs).reshape(-1, 4)
    at += size + 4
    blocks = []
    for n, words, crc, _ in sums.tolist():
        payload = data[at : at + 4 * words]
        if zlib.crc32(payload) != crc:
            raise ValueError(f"checksum of block {len(blocks)} is wrong")
        blocks.append((n, payload))
        at += 4 * words
    ids = decode_ids(classes, blocks)
    upto = 0
    for k, (n, _, _, crc) in enumerate(sums.tolist()):
        if zlib.crc32(ids[upto : upto + n].astype("<u4").tobytes()) != crc:
            raise ValueError(f"ids of block {k} are wrong")
        upto += n
    if len(ids) != n_ids:
        raise ValueError("ids are missing")
    return [None if z else int(d) for d, z in zip(known, nulls)], lengths, ids


class PieceIds:
    """Ids of whole texts by the library, which encodes each distinct piece once."""

    def __init__(self, path: str):
        library_in_one_thread()
        self.words = Vocabulary(path)
        # The merges alone, which need no more than a piece.
        self.merges = Tokenizer.from_file(path).model
        self.known = Bounded(CACHED_PIECES)
        self._forget()

    def _forget(self) -> None:
        self.known.clear()
        self.letters = 0
        # The end id is the first entry of the store.
        self.flat = np.array([END_ID], dtype=np.uint32)
        self.firsts, self.sizes = np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.int64)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids per piece)."""
        special, spell, tokenize = self.words.special_ids, self.words.spell, self.merges.tokenize
        ids = [[special[p]] if p in special else [t.id for t in tokenize(spell(p))] for p in pieces]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), dtype=np.uint32, count=int(sizes.sum())), sizes

    def _slots(self, pieces: list[str]) -> np.ndarray:
        """Places of the pieces in the store; unknown ones are encoded."""
        known = self.known
        slots = np.fromiter(map(known.get, pieces, itertools.repeat(-1)), dtype=np.int64, count=len(pieces))
        fresh = np.flatnonzero(slots < 0)
        # Only unknown pieces need room.
        if len(fresh) and (known.make_room(len(fresh)) or self.letters > CACHED_LETTERS or len(self.flat) > CACHED_IDS):
            self._forget()
            fresh = np.arange(len(pieces))
        if len(fresh):
            new = [pieces[i] for i in fresh.tolist()]
            flat, sizes = self._encode(new)
            firsts = len(self.flat) + np.cumsum(sizes) - sizes
            slots[fresh] = np.arange(len(self.firsts), len(self.firsts) + len(new))
            known.update(zip(new, slots[fresh].tolist()))
            self.letters += sum(map(len, new))
            self.flat = np.concatenate([self.flat, flat])
            self.firsts, self.sizes = np.concatenate([self.firsts, firsts]), np.concatenate([self.sizes, sizes])
        return slots

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with the end id behind each, number of ids per text)."""
        found = cut(texts, self.words.specials, True, False, True)
        slots = self._slots(found.distinct)
        # The end id is one more piece behind the pieces of each text.
        each = slots[found.codes] if len(found.codes) else np.zeros(0, dtype=np.int64)
        codes = np.insert(each, found.bounds[1:], 0)
        counts = self.sizes[codes]
        upto = np.cumsum(counts)
        places = np.arange(upto[-1]) + np.repeat(self.firsts[codes] - (upto - counts), counts)
        ends = found.bounds[1:] + np.arange(1, len(texts) + 1)
        return self.flat[places], np.diff(np.append(0, upto[ends - 1]))


def _writer(tokenizer: str, path: str):
    def run(batches):
        encode = process_cache(f"piece_ids_{tokenizer}", lambda: PieceIds(path))
        shard, number = TaskContext.get().partitionId(), 0
        doc_ids, lengths, ids, held = [], [], [], 0

        def file():
            nonlocal doc_ids, lengths, ids, held, number
            data = write_file(doc_ids, np.concatenate(lengths), np.concatenate(ids))
            row = pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "number": pa.array([number], pa.int32()),
                 "n_ids": pa.array([held], pa.int64()), "data": pa.array([data], pa.binary())}
            )
            doc_ids, lengths, ids, held, number = [], [], [], 0, number + 1
            return row

        for part in slices(batches, max_bytes=CHUNK_BYTES):
            new, counts = encode(strings(part.column("text")))
            if held and held + len(new) > FILE_IDS:
                yield file()
            doc_ids += part.column("doc_id").to_pylist()
            lengths.append(counts)
            ids.append(new)
            held += len(new)
        if held:
            yield file()

    return run


def write_ids(docs: DataFrame, where: str, tokenizer: str = TOKENIZER) -> None:
    """Encode all texts and write their ids to files, documents in ascending order over the files."""
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    # Ranges of ids only: the driver samples these keys.
    dealt = docs.repartitionByRange(max(1, -(-size // SHARD_BYTES)), order[0]).sortWithinPartitions(*order)
    dealt.mapInArrow(
        _writer(tokenizer, public_tokenizers.path(tokenizer)), "shard int, number int, n_ids bigint, data binary"
    ).write.parquet(where)


def _reader(batches):
    for batch in batches:
        for shard, number, data in zip(
            batch.column("shard").to_pylist(), batch.column("number").to_pylist(), batch.column("data")
        ):
            doc_ids, lengths, ids = read_file(data.as_py())
            ends = np.cumsum(lengths)
            flat = ids.astype("<u4")
            sums = [zlib.crc32(flat[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths.tolist())]
            n = len(doc_ids)
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard] * n, pa.int32()), "number": pa.array([number] * n, pa.int32()),
                "doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(ends - lengths, pa.int64()),
                "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(sums, pa.int64()),
            })


def read_ids(spark, where: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document of the files."""
    files = spark.read.parquet(where)
    # One row per file.
    before = Window.orderBy("shard", "number").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select(
        F.col("shard").alias("_shard"), F.col("number").alias("_number"),
        F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("_before"),
    )
    rows = files.select("shard", "number", "data").mapInArrow(
        _reader, "shard int, number int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return rows.join(
        starts, (F.col("shard") == F.col("_shard")) & (F.col("number") == F.col("_number"))
    ).select("doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def report(docs: DataFrame) -> DataFrame:
    where = scratch_path(docs.sparkSession, "id-files")
    write_ids(docs, where)
    return read_ids(docs.sparkSession, where)
