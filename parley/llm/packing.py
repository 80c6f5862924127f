"""Packing of token ids into fixed windows by minimum bin slack."""

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.tokens import encoder

WINDOW = 4096
EOS = 2
POOL, FLOOR = 4096, 1024
SEQUENCE_BITS = 33


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of each length fill ``room`` best, by a bitset over reachable sums.

    ``counts`` maps length to pieces at hand. Bit s of ``reach`` says that some multiset sums to
    s; each length enters in doubling bundles, and the states before the bundles are kept to walk
    back from the best sum. The walk ends early when ``room`` itself is reached.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, bundle = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(bundle, left)
            steps.append((length, take, reach))
            reach = (reach | reach << length * take) & mask
            left, bundle = left - take, bundle * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            used[length] += take
    return used


class Packer:
    """Collects pieces and gives rows (doc, start, ids, tokens of the doc, sequence, offset)."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.pool: dict[int, list] = defaultdict(list)
        self.held, self.rows = 0, []

    def add(self, doc, ids: np.ndarray) -> None:
        """Whole windows go out at once; what is left of the document joins the pool."""
        cut = len(ids) - len(ids) % self.window
        for start in range(0, cut, self.window):
            self._emit([(doc, start, ids[start:start + self.window], len(ids))])
        if cut < len(ids):
            self._keep((doc, cut, ids[cut:].copy(), len(ids)))  # a copy: the pool must not hold whole documents

    def _keep(self, piece) -> None:
        self.pool[len(piece[2])].append(piece)
        self.held += 1

    def _take(self, length: int):
        piece = self.pool[length].pop()
        if not self.pool[length]:
            del self.pool[length]
        self.held -= 1
        return piece

    def _emit(self, pieces) -> None:
        offset = 0
        for doc, start, ids, tokens in pieces:
            self.rows.append((doc, start, ids, tokens, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def fill(self, until: int) -> None:
        """Fill windows while more than ``until`` pieces are held."""
        while self.held > until and (until or sum(n * len(p) for n, p in self.pool.items()) >= self.window):
            pieces = [self._take(max(self.pool))]
            room = self.window - len(pieces[0][2])
            used = best_fill({n: len(p) for n, p in self.pool.items()}, room)
            for length, n in used.items():
                pieces += [self._take(length) for _ in range(n)]
            slack = room - sum(length * n for length, n in used.items())
            if slack and self.pool:  # all that is left is longer: cut one piece to close the window
                doc, start, ids, tokens = self._take(max(self.pool))
                pieces.append((doc, start, ids[:slack], tokens))
                self._keep((doc, start + slack, ids[slack:], tokens))
            self._emit(pieces)

    def finish(self) -> None:
        """The last pieces, less than one window, as sequences of power-of-two lengths."""
        self.fill(0)
        rest = [self._take(n) for n in sorted(self.pool, reverse=True) for _ in range(len(self.pool[n]))]
        size = sum(len(p[2]) for p in rest)
        for bit in reversed(range(size.bit_length())):
            room, pieces = size & 1 << bit, []
            while room:
                doc, start, ids, tokens = rest.pop(0)
                if len(ids) > room:
                    rest.insert(0, (doc, start + room, ids[room:], tokens))
                    ids = ids[:room]
                pieces.append((doc, start, ids, tokens))
                room -= len(ids)
            if pieces:
                self._emit(pieces)


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", window: int = WINDOW, eos: int = EOS,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of ``window`` tokens, without a shuffle.

    One row per piece: the document's id, start (its ids before the piece), ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id and offset in the sequence. A document's ids end with
    ``eos``. Documents stream through their own task: a pool of at most ``POOL`` leftovers is
    packed down to ``FLOOR`` whenever it is full, so memory is bounded and a retried task repeats
    its sequences. A window that no multiset fills is closed by cutting a piece; each task's last
    tokens form sequences of power-of-two lengths, so nothing is padded. Sequence ids carry the
    task's number in the high bits.

    Null texts count as empty (one piece, ``eos`` alone), repeated rows are packed as often as
    they stand, an empty table gives no rows, other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType())])
    tail = np.asarray([eos], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        packer = Packer(window, TaskContext.get().partitionId() << SEQUENCE_BITS)
        arrow = None

        def out():
            doc, start, ids, tokens, seq, offset = zip(*packer.rows, strict=True)
            packer.rows = []
            return pa.RecordBatch.from_arrays(
                [pa.array(doc, arrow), pa.array(start, pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary()),
                 pa.array(tokens, pa.int64()), pa.array(seq, pa.int64()), pa.array(offset, pa.int64())], schema.names)

        for batch in batches:
            arrow = batch.column(0).type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(texts), strict=True):
                    packer.add(doc, np.frombuffer(ids + tail, dtype="<u4"))
                    if packer.held >= POOL:
                        packer.fill(FLOOR)
                if len(packer.rows) >= 1024:
                    yield out()
        packer.finish()
        if packer.rows:
            yield out()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
