"""Cost-balanced packing of documents into fixed-length token sequences.

A document costs ``linear * tokens + quadratic * tokens ** 2`` (attention). Documents
longer than a sequence give full sequences of their own first; what remains is taken
by descending length, each piece going to the sequence of the lowest cost so far that
has room for it. Pieces that fit nowhere whole are cut into the room that is left, so
all but a task's last sequences are full. What is left at a task's end goes to
sequences of powers of two, which need no padding.

Tasks pack what they read, a pool of ``pool`` sequences at a time: memory is bounded
by the pool, no shuffle is needed, and a repeated task makes the same sequences. Null
text counts as empty (its only id is the end token). Long texts are cut. Repeated rows
are packed each for itself; ties in length keep the input's order; empty tables give
no pieces; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lexspark.llm.bpe import coder, slices
from lexspark.llm.common import map_batches, texts

Piece = tuple[int, int, int]  # document (its place in the pool), start, length


def pack_pool(rest: list[Piece], size: int, linear: float = 1.0, quadratic: float = 1.0 / 4096) -> tuple[list[list[Piece]], list[Piece]]:
    """Full sequences from pieces shorter than ``size``, and the pieces left over,
    which are fewer tokens than one sequence."""
    bins = sum(n for _, _, n in rest) // size
    rows: list[list[Piece]] = [[] for _ in range(bins)]
    room = [size] * bins
    # Sequences by cost; those without room for the present length wait in ``tight``,
    # by room, as later pieces are shorter.
    heap = [(0.0, k) for k in range(bins)]
    tight: list[tuple[int, float, int]] = []
    left: list[Piece] = []
    for piece in sorted(rest, key=lambda p: -p[2]):
        n = piece[2]
        while tight and -tight[0][0] >= n:
            _, cost, k = heapq.heappop(tight)
            heapq.heappush(heap, (cost, k))
        while heap and room[heap[0][1]] < n:
            cost, k = heapq.heappop(heap)
            heapq.heappush(tight, (-room[k], cost, k))
        if not heap:
            left.append(piece)
            continue
        cost, k = heapq.heappop(heap)
        rows[k].append(piece)
        room[k] -= n
        heapq.heappush(heap, (cost + linear * n + quadratic * n * n, k))
    over: list[Piece] = []
    gaps = [k for k in sorted(range(bins), key=lambda k: -room[k]) if room[k]]
    for doc, start, n in left:
        while n and gaps:
            k = gaps[-1]
            cut = min(n, room[k])
            rows[k].append((doc, start, cut))
            room[k] -= cut
            start, n = start + cut, n - cut
            if not room[k]:
                gaps.pop()
        if n:
            over.append((doc, start, n))
    return rows, over


def _power(total: int, size: int) -> int:
    """The largest power of two within both; 0 of nothing."""
    return 1 << min(total, size).bit_length() - 1 if total else 0


def pack_tail(over: list[Piece], size: int) -> list[list[Piece]]:
    """What is left at a task's end, as sequences of descending powers of two."""
    rows: list[list[Piece]] = []
    total = sum(n for _, _, n in over)
    row: list[Piece] = []
    room = _power(total, size)
    for doc, start, n in over:
        while n:
            cut = min(n, room)
            row.append((doc, start, cut))
            start, n, room, total = start + cut, n - cut, room - cut, total - cut
            if not room:
                rows.append(row)
                row, room = [], _power(total, size)
    return rows


def pack_documents(df: DataFrame, path: str, end_id: int = 2, size: int = 4096, pool: int = 512) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset``. Sequence ids hold the task's number in the upper bits."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    end = end_id.to_bytes(4, "little")

    def run(batches):
        bpe = coder(path)
        task = TaskContext.get()
        next_id = (task.partitionId() if task else 0) << 36
        docs: dict[int, tuple[object, bytes]] = {}
        rest: list[Piece] = []
        held, count = 0, 0

        def table(rows: list[list[Piece]]):
            nonlocal next_id
            cols: list[list] = [[] for _ in range(7)]
            for row in rows:
                offset = 0
                for doc, start, n in row:
                    name, ids = docs[doc]
                    part = ids[4 * start : 4 * (start + n)]
                    for c, v in zip(cols, (name, start, n, zlib.crc32(part), len(ids) // 4, next_id, offset), strict=True):
                        c.append(v)
                    offset += n
                next_id += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            rows, names = texts(batch), batch.column("doc_id").to_pylist()
            for a, b in slices(rows):
                full: list[list[Piece]] = []
                for name, (ids, _) in zip(names[a:b], bpe.encode_batch(rows[a:b], decode=False), strict=True):
                    ids += end
                    docs[count] = (name, ids)
                    n = len(ids) // 4
                    whole = n // size * size
                    full += [[(count, k, size)] for k in range(0, whole, size)]
                    if n > whole:
                        rest.append((count, whole, n - whole))
                        held += n - whole
                    count += 1
                if held >= pool * size:
                    packed, rest = pack_pool(rest, size)
                    full += packed
                    held = sum(n for _, _, n in rest)
                if full:
                    yield table(full)
                keep = {doc for doc, _, _ in rest}
                docs = {k: v for k, v in docs.items() if k in keep}
        bpe.forget()
        packed, rest = pack_pool(rest, size)
        packed += pack_tail(rest, size)
        if packed:
            yield table(packed)

    return map_batches(df.select("doc_id", "text"), run, schema)
