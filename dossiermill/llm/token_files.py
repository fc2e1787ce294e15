"""Files of token ids, compressed by an adaptive context-mixing range coder.

**Model.** Three models predict each id: the id that last followed the two ids before it
(order 2), the one that last followed the id before it (order 1), and the counts of all ids
so far (order 0). Orders 2 and 1 have a confidence, raised by hits and halved by misses.
The three are mixed linearly: for each pair of confidences the share of hits so far gives
the weights of orders 2 and 1, and order 0 has the rest, so every id has a positive share.

**Coder.** A block's ids are cut into LANES runs that are coded in step: every step codes one
id of each lane by a range coder of its own, then the shared models learn from all of
them. Integers and exact quotients only take part, so the decoder repeats it exactly.

**Block.** Whole documents until BLOCK ids are reached; models and coders start anew.
A block is a header of fixed width (magic, numbers of documents and ids, vocabulary,
lanes, lengths and CRC-32 of the payload and of the ids as little-endian unsigned 32-bit
integers) and the payload: doc_ids with a flag for null, ids of each document, words of each
lane, and the lanes' words. **File.** Blocks, one after the other; each can be read and
verified without the others.
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .memo import Memo

WORD_BPE = "word_bpe_49k.json"
END_ID = 1

BLOCK = 1 << 20
LANES = 2_048
#: Ids of a lane at least, if a block is small.
LEAST_STEPS = 256
#: Bits of a slot number of orders 1 and 2, and steps between two sums of the counts.
SLOTS, REFRESH = 16, 8
#: What an occurrence adds to a count, and the sum at which counts are halved.
GAIN, LIMIT = 24, 1 << 25
#: The length of the line of all shares, and of order 0's own.
TOTAL, ORDER0_BITS = 1 << 24, 21
ORDER0 = 1 << ORDER0_BITS
#: Share that order 0 keeps at least.
FLOOR = 1 << 21
SURE = 15

HEADER = struct.Struct("<4sIQIIQQII")
MAGIC = b"TMX1"


class Model:
    """The mixed prediction of the next id of every lane."""

    def __init__(self, vocabulary: int, lanes: int):
        self.vocabulary = vocabulary
        self.guess = [np.zeros(1 << SLOTS, np.int64) for _ in range(2)]
        self.sure = [np.zeros(1 << SLOTS, np.int64) for _ in range(2)]
        self.counts = np.ones(vocabulary, np.int64)
        self.before = [np.zeros(lanes, np.int64) for _ in range(2)]
        self.numbers = np.arange(vocabulary + 1)
        kinds = 2 * (SURE + 1) ** 2
        # tries and hits of order 2 and 1; some are given in advance
        self.tries, self.hits = np.full(kinds, 4.0), [np.full(kinds, 0.5) for _ in range(2)]
        self.steps, self.seen = 0, []
        self._sum()
        self._weigh()

    def _sum(self) -> None:
        """Takes what was seen into the counts, their sums and the weights. Counts are scaled
        to ORDER0 in all, one for each id at least. Whole numbers this small are exact in
        double precision, so a decoder anywhere finds the same."""
        if self.seen:
            self.counts += np.bincount(np.concatenate(self.seen), minlength=self.vocabulary) * GAIN
            self.seen = []
        while (total := int(self.counts.sum())) > LIMIT:
            self.counts = (self.counts + 1) >> 1
        self.below = np.zeros(self.vocabulary + 1, np.int64)
        np.cumsum(self.counts, out=self.below[1:])
        self.below *= ORDER0 - self.vocabulary
        self.below //= total
        self.below += self.numbers

    def _weigh(self) -> None:
        """The weights of orders 2 and 1 for each pair of confidences."""
        self.shares = [np.floor((TOTAL - FLOOR) * h / self.tries).astype(np.int64) for h in self.hits]

    def look(self, live: int) -> None:
        """The guesses for the first ``live`` lanes and the weights of the three orders."""
        one, two = self.before[0][:live], self.before[1][:live]
        mask = (1 << SLOTS) - 1
        self.at = [((two * 0x9E3779B1 + one * 0x85EBCA6B) >> 9) & mask, ((one * 0x9E3779B1) >> 7) & mask]
        self.g = [g[at] for g, at in zip(self.guess, self.at, strict=True)]
        self.s = [s[at] for s, at in zip(self.sure, self.at, strict=True)]
        same = self.g[0] == self.g[1]
        self.kind = (self.s[0] * (SURE + 1) + self.s[1]) * 2 + same
        self.w = [s[self.kind] for s in self.shares]
        self.w[1] *= ~same
        self.rest = TOTAL - self.w[0] - self.w[1]

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids' shares begin, and their sizes."""
        low = self.below[ids] * self.rest >> ORDER0_BITS
        size = (self.below[ids + 1] * self.rest >> ORDER0_BITS) - low
        for g, w in zip(self.g, self.w, strict=True):
            low += w * (g < ids)
            size += w * (g == ids)
        return low, size

    def find(self, place: np.ndarray) -> np.ndarray:
        """The ids in whose shares the places lie."""
        (g, h), (w, v) = self.g, self.w
        found, rest = None, place.copy()
        for own, other, more, others in ((g, h, w, v), (h, g, v, w)):
            begin, size = self.below[own] * self.rest >> ORDER0_BITS, self.below[own + 1] * self.rest >> ORDER0_BITS
            size += more - begin
            begin += others * (other < own)
            past = place - begin
            inside = (past >= 0) & (past < size)
            rest -= more * (past >= size)
            found = np.where(inside, own, -1 if found is None else found)
        plain = np.flatnonzero(found < 0)
        # the greatest number of counts whose share of the line is not past the place
        wanted = np.floor(((rest[plain] + 1) * ORDER0 - 1) / self.rest[plain]).astype(np.int64)
        found[plain] = np.searchsorted(self.below, wanted, "right") - 1
        return found

    def learn(self, ids: np.ndarray) -> None:
        hits = [g == ids for g in self.g]
        kinds, live = len(self.tries), len(ids)
        for n in range(2):
            right, s, at = hits[n], self.s[n], self.at[n]
            self.sure[n][at] = np.where(right, np.minimum(s + 1, SURE), s >> 1)
            turn = np.flatnonzero(~right & (s < 2))
            self.guess[n][at[turn]] = ids[turn]
        self.tries += np.bincount(self.kind, minlength=kinds)
        self.hits[0] += np.bincount(self.kind[hits[0]], minlength=kinds)
        self.hits[1] += np.bincount(self.kind[hits[1] & ~hits[0]], minlength=kinds)
        self._weigh()
        self.before[1][:live] = self.before[0][:live]
        self.before[0][:live] = ids
        self.seen.append(ids)
        self.steps += 1
        if self.steps % REFRESH == 0 or self.steps < REFRESH:
            self._sum()


#: A range coder's state is 64 bits wide and gives 16 at a time.
_TOP, _LEAST, _WORD = np.uint64(1 << 48), np.uint64(1 << 40), np.uint64(16)
_BITS = np.uint64(24)


def _lanes(n: int) -> tuple[int, int]:
    """Lanes and steps for n ids. Lane j has the ids from j * steps on."""
    lanes = max(1, min(LANES, n // LEAST_STEPS))
    steps = -(-n // lanes)
    return (-(-n // steps), steps) if n else (0, 0)


def _live(n: int, lanes: int, steps: int, step: int) -> int:
    """How many lanes have an id in this step: all but the last always have one."""
    return lanes if (lanes - 1) * steps + step < n else lanes - 1


def encode(ids: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """(words of each lane, all lanes' words) of a block's ids."""
    n = len(ids)
    lanes, steps = _lanes(n)
    table = np.zeros(lanes * steps, np.int64)
    table[:n] = ids
    table = table.reshape(lanes, steps) if n else table.reshape(0, 0)
    model = Model(vocabulary, lanes)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    lane_of, words = [], []

    def emit(at: np.ndarray) -> None:
        lane_of.append(at)
        words.append((low[at] >> np.uint64(48)).astype(np.uint16))
        low[at] <<= _WORD
        width[at] <<= _WORD

    for step in range(steps):
        live = _live(n, lanes, steps, step)
        own = table[:live, step]
        model.look(live)
        begin, size = model.interval(own)
        unit = width[:live] >> _BITS
        low[:live] += begin.astype(np.uint64) * unit
        width[:live] = size.astype(np.uint64) * unit
        for at in _ready(low, width, live):
            emit(at)
        model.learn(own)
    for _ in range(4):
        emit(np.arange(lanes))
    if not n:
        return np.empty(0, np.uint32), np.empty(0, np.uint16)
    lane_of, words = np.concatenate(lane_of), np.concatenate(words)
    order = np.argsort(lane_of, kind="stable")
    return np.bincount(lane_of, minlength=lanes).astype(np.uint32), words[order]


def _ready(low: np.ndarray, width: np.ndarray, live: int) -> Iterator[np.ndarray]:
    """Lanes whose first word is settled, until none is. A range that is narrow and still
    astride a word's border is cut off there, so no carry is ever needed."""
    at = np.arange(live)
    while True:
        l, w = low[at], width[at]
        settled = (l ^ (l + w)) < _TOP
        narrow = ~settled & (w < _LEAST)
        if narrow.any():
            width[at[narrow]] = (~l[narrow] + np.uint64(1)) & (_LEAST - np.uint64(1))
        at = at[settled | narrow]
        if not len(at):
            return
        yield at


def decode(n: int, sizes: np.ndarray, words: np.ndarray, vocabulary: int) -> np.ndarray:
    """The ids of a block from its lanes' words."""
    lanes, steps = _lanes(n)
    if not n:
        return np.empty(0, np.uint32)
    table = np.zeros((lanes, steps), np.int64)
    model = Model(vocabulary, lanes)
    next_word = np.concatenate([[0], np.cumsum(sizes)])[:lanes].astype(np.int64)
    words = np.concatenate([words, np.zeros(4, np.uint16)]).astype(np.uint64)
    low, width, code = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64), np.zeros(lanes, np.uint64)

    def take(at: np.ndarray) -> None:
        code[at] = (code[at] << _WORD) | words[np.minimum(next_word[at], len(words) - 1)]
        next_word[at] += 1

    for _ in range(4):
        take(np.arange(lanes))
    for step in range(steps):
        live = _live(n, lanes, steps, step)
        model.look(live)
        unit = width[:live] >> _BITS
        # a damaged block may lead anywhere; its CRC tells
        place = np.minimum((code[:live] - low[:live]) // unit, np.uint64(TOTAL - 1)).astype(np.int64)
        ids = np.minimum(model.find(place), vocabulary - 1)
        table[:live, step] = ids
        begin, size = model.interval(ids)
        low[:live] += begin.astype(np.uint64) * unit
        width[:live] = np.maximum(size.astype(np.uint64) * unit, np.uint64(1))
        for at in _ready(low, width, live):
            low[at] <<= _WORD
            width[at] <<= _WORD
            take(at)
        model.learn(ids)
    return table.reshape(-1)[:n].astype(np.uint32)


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, vocabulary: int) -> bytes:
    """A block of whole documents."""
    sizes, words = encode(ids, vocabulary)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    index = zlib.compress(numbers.tobytes() + known.tobytes() + lengths.astype("<u4").tobytes() + sizes.astype("<u4").tobytes(), 6)
    payload = struct.pack("<Q", len(index)) + index + words.astype("<u2").tobytes()
    return HEADER.pack(MAGIC, len(doc_ids), len(ids), vocabulary, len(sizes), len(payload), len(words), zlib.crc32(payload), zlib.crc32(ids.astype("<u4").tobytes())) + payload


def unpack(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, ids of each document, all ids) of a block; ValueError if it is damaged."""
    magic, docs, n, vocabulary, lanes, size, n_words, payload_crc, ids_crc = HEADER.unpack_from(block)
    payload = block[HEADER.size : HEADER.size + size]
    if magic != MAGIC or len(payload) != size or zlib.crc32(payload) != payload_crc:
        raise ValueError("a block of token ids is damaged")
    (at,) = struct.unpack_from("<Q", payload)
    index = zlib.decompress(payload[8 : 8 + at])
    numbers, known = np.frombuffer(index, "<i8", docs), np.frombuffer(index, np.uint8, docs, 8 * docs)
    lengths, sizes = np.frombuffer(index, "<u4", docs, 9 * docs), np.frombuffer(index, "<u4", lanes, 13 * docs)
    ids = decode(n, sizes, np.frombuffer(payload, "<u2", n_words, 8 + at), vocabulary)
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("the ids of a block are not those that were written")
    return [int(d) if k else None for d, k in zip(numbers, known, strict=True)], lengths, ids


def blocks(file) -> Iterator[bytes]:
    """The blocks of an open file."""
    while head := file.read(HEADER.size):
        yield head + file.read(HEADER.unpack(head)[5])


class Encoder:
    """Ids of whole texts. White space ends every token of the vocabulary and is dropped, so
    the tokenizer is asked once for each piece between spaces or line ends that a bounded
    memo holds."""

    KEPT = 250_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = max(self.tokenizer.get_vocab_size(), END_ID + 1)
        self.ids = Memo(self._made, self.KEPT)

    def _made(self, pieces: list[str]) -> list[bytes]:
        out = []
        for lo in range(0, len(pieces), 4_096):
            found = self.tokenizer.encode_batch_fast(pieces[lo : lo + 4_096], add_special_tokens=False)
            out += [array("I", e.ids).tobytes() for e in found]
        return out

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text and the end id, as 32-bit integers of this machine."""
        pieces = [(t or "").replace("\n", " ").split(" ") for t in texts]
        found, end = iter(self.ids([p for own in pieces for p in own])), array("I", [END_ID]).tobytes()
        return [b"".join(islice(found, len(own))) + end for own in pieces]


@functools.lru_cache(1)
def _encoder(path: str) -> Encoder:
    """The worker's encoder, which later tasks use again."""
    return Encoder(path)


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def write(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text) to files in ``folder``, which driver and
    executors share, in ascending order of doc_id over the files: (file, number, docs,
    tokens, bytes), one row a file. An attempt writes a file of its own name, and only
    the row of the attempt that Spark keeps names its file, so lost tasks leave nothing
    that is read."""
    common.batch_rows(docs.sparkSession)
    # four files for each partition of a shuffle are small enough to sort in memory
    files = 4 * common.parallelism(docs.sparkSession)
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text").asc()]
    rows = docs.select("doc_id", "text").repartitionByRange(files, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        encoder = _encoder(tokenizer)
        path = f"{folder}/{number:06d}-{uuid.uuid4().hex}.ids"
        fs, local = _open(path)
        totals, held, out = [0, 0, 0], [], None

        def flush() -> None:
            ids = np.frombuffer(b"".join([own for _, own in held]), np.uint32)
            block = pack([d for d, _ in held], np.array([len(own) // 4 for _, own in held]), ids, encoder.vocabulary)
            out.write(block)
            for n, more in enumerate((len(held), len(ids), len(block))):
                totals[n] += more
            held.clear()

        waiting = 0
        for r in batches:
            ids_, texts = r["doc_id"].to_pylist(), r["text"].to_pylist()
            for lo in range(0, len(texts), 64):
                for doc_id, own in zip(ids_[lo : lo + 64], encoder(texts[lo : lo + 64]), strict=True):
                    if out is None:
                        fs.create_dir(os.path.dirname(local), recursive=True)
                        out = fs.open_output_stream(local)
                    held.append((doc_id, own))
                    waiting += len(own) // 4
                    if waiting >= BLOCK:
                        flush()
                        waiting = 0
        if held:
            flush()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "number", "docs", "tokens", "bytes"), (path, number, *totals), strict=True))], schema=pa.schema([("file", pa.string()), ("number", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]))

    return common.stored(rows.mapInArrow(run, "file string, number int, docs long, tokens long, bytes long"))


def read(files: DataFrame, digest_only: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in files that ``write``
    listed: start is the number of ids of all documents before it. With ``digest_only``
    without ids. ValueError if a block is damaged."""
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    # one row a file, so a window over all of them is small
    begun = files.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            for path, start in zip(r["file"].to_pylist(), r["start"].to_pylist(), strict=True):
                fs, local = _open(path)
                with fs.open_input_stream(local) as file:
                    for block in blocks(file):
                        doc_ids, lengths, ids = unpack(block)
                        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                        little = ids.astype("<u4")
                        columns = {
                            "doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(start + ends[:-1]), "n_tokens": pa.array(lengths.astype(np.int64)),
                            "ids_crc32": pa.array([zlib.crc32(little[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.int64()),
                        }
                        if not digest_only:
                            columns["ids"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                        yield pa.RecordBatch.from_pydict(columns)
                        start += int(ends[-1])

    spread = begun.repartition(4 * common.parallelism(files.sparkSession), "file")
    return spread.mapInArrow(run, kind)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents, each closed by the id 1, and gives (doc_id, start,
    n_tokens, ids_crc32) from the files as they are read back.

    Null texts are empty and have the end id only. Null doc_ids come first, and rows that
    share a doc_id follow each other by a hash of their text. An empty table has no files
    and gives no rows."""
    import public_tokenizers

    folder = f"{common.shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    files = write(common.table(spark, sf_dir, "documents"), folder, public_tokenizers.path(WORD_BPE))
    return read(files, digest_only=True)
