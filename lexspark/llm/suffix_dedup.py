"""Suffix-array dedup: exact removal of byte strings that occurred before.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier: in a
document before (smaller doc_id), or before in the same one. All is judged on the input.

1. Of each string of ``length`` bytes, the least hashed q-gram in it (leftmost of equals)
   is its anchor, so equal strings have equal anchors at equal places. Anchors carry a
   hash of the q-gram and one of the whole context that their strings reach. Each part
   of the input keeps the earliest anchor of a context and settles its later ones.
2. Grouped by q-gram, anchors of one context but the earliest are repeats with all their
   strings. Contexts that share the q-gram and half of the surroundings, but differ, may
   share some of their strings: their bytes are fetched.
3. On those the suffixes are sorted by bucket-pointer refinement (``refine``): buckets of
   short q-grams are refined by the bucket pointers at later offsets, and pointers that
   were updated are used at once, within the same round. Neighbours that agree on
   ``length`` bytes are repeats but for the earliest of them.

Contexts of one q-gram are sorted in one task, ``GROUP_CONTEXTS`` or a thousandth of all
at most. Of q-grams that have more (a line that a third of all rows hold), each string
goes by itself, keyed by 128 bits of hash: a part keeps the earliest and settles the
others, so a popular string reaches its group once per part.

Identity of contexts rests on a hash of 64 bits over the whole context, beside that of
the q-gram; that of partly shared strings on bytes (on 128 bits for hot q-grams).
Null text counts as empty; a null doc_id comes before all others. Rows equal in id and
text are one document that is reported for each row; rows that share an id (or have
none) but not the text are documents of their own (see ``names``). Texts shorter than
``length`` keep all. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import map_batches, ship, stored
from lexspark.llm.names import names
from lexspark.llm.packed import pack, split, unpack
from lexspark.llm.tokens import Hashed, mix, powers, spans

LENGTH, GRAM = 100, 40
#: Bytes of text whose anchors make up a group, and fetched contexts in a group.
GROUP_BYTES, GROUP_CONTEXTS = 8 << 20, 4_000
#: At most so many q-grams can exceed their share of contexts.
HOT = 1000

_FOUND = "doc long, kind int, gram long, pos long, lo int, hi int"


def anchors(h: Hashed, length: int = LENGTH, gram: int = GRAM):
    """Of every anchor: q-gram hash, context hash (64 bits), half-context hashes (2 x 8
    bits), row, place, first and last start of the strings that it stands for."""
    n = len(h.data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint16), none, none, none, none
    g = mix((h.sums[gram:] - h.sums[:-gram]) * h.inv[: n - gram + 1])
    # The leftmost of the least: compared by 32 bits of hash, then by place.
    m = (g >> np.uint64(32) << np.uint64(32)) | np.arange(len(g), dtype=np.uint64)
    width, span = length - gram + 1, 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
    size = np.diff(h.offsets)
    start = np.flatnonzero(np.repeat(h.offsets[1:], size)[: len(m)] >= np.arange(len(m)) + length)
    if not len(start):
        return none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint16), none, none, none, none
    at = (m[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    lo, hi, at = start[first], start[np.r_[first[1:] - 1, len(at) - 1]], at[first]
    row = np.searchsorted(h.offsets, at, "right") - 1
    left, right = np.maximum(at - (width - 1), h.offsets[row]), np.minimum(at + length, h.offsets[row + 1])
    context = mix(h.of(left, right) + (at - left).astype(np.uint64) * np.uint64(1000003), 1)
    half = (width - 1) // 2
    side = mix(h.of(np.maximum(at - half, left), at), 2) >> np.uint64(56) << np.uint64(8) | mix(h.of(at + gram, np.minimum(at + gram + half, right)), 3) >> np.uint64(56)
    return g[at], context, side.astype(np.uint16), row, at - h.offsets[row], lo - h.offsets[row], hi - h.offsets[row]


def _earliest(gram, context, doc, pos):
    """Order by (gram, context, doc, pos); which of these begin a gram, a context."""
    order = np.lexsort((pos, doc, context, gram))
    g, c = gram[order], context[order]
    new_g = np.r_[True, g[1:] != g[:-1]]
    return order, new_g, new_g | np.r_[True, c[1:] != c[:-1]]


def _merge(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Runs of starts of one document that touch or overlap, joined."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    if not len(doc):
        return doc, lo, hi
    # Ends grow along a document; lift documents apart so that one pass does it.
    _, nth = np.unique(doc, return_inverse=True)
    lift = nth.astype(np.int64) << 34
    reach = np.maximum.accumulate(hi + lift)
    new = np.r_[True, lo[1:] + lift[1:] > reach[:-1] + 1]
    first = np.flatnonzero(new)
    return doc[first], lo[first], (reach - lift)[np.r_[first[1:] - 1, len(doc) - 1]]



def _found(doc, kind, gram, pos, lo, hi) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"doc": pa.array(doc, pa.int64()), "kind": pa.array(np.broadcast_to(np.asarray(kind, np.int32), len(doc)), pa.int32()), "gram": pa.array(np.asarray(gram).astype(np.int64), pa.int64()), "pos": pa.array(pos, pa.int64()), "lo": pa.array(np.asarray(lo).astype(np.int32), pa.int32()), "hi": pa.array(np.asarray(hi).astype(np.int32), pa.int32())}
    )


def _refined(bucket: np.ndarray, depth: np.ndarray, places: np.ndarray, second: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Split the buckets of ``places`` (whole buckets) by ``second``. A bucket's identifier
    is the rank of its first suffix, so identifiers stay in the order of the suffixes.
    Returns the places that are still not alone, in order."""
    order = np.lexsort((second, bucket[places]))
    at = places[order]
    b, s = bucket[at], second[order]
    n = np.arange(len(at))
    outer = np.r_[True, b[1:] != b[:-1]]
    inner = outer | np.r_[True, s[1:] != s[:-1]]
    first = np.maximum.accumulate(np.where(inner, n, 0))
    bucket[at] = b + first - np.maximum.accumulate(np.where(outer, n, 0))
    depth[at] += gain[order]
    size = np.diff(np.r_[np.flatnonzero(inner), len(at)])
    return at[size.repeat(size) > 1]


def refine(data: np.ndarray, valid: np.ndarray, length: int = LENGTH, chunks: int = 8) -> np.ndarray:
    """Groups of places whose next ``length`` bytes are equal, by bucket-pointer refinement:
    numbers from 0, and -1 for places that are alone or have fewer bytes. ``valid``: the
    number of bytes from each place to the end of its context.

    ``depth`` bytes are known to be equal in a place's bucket. A round sorts buckets by the
    bucket pointers ``depth`` bytes later, a chunk of buckets at a time; pointers updated
    by a chunk serve the next one, so depths grow by more than twice in a round. Places
    in buckets that reach ``length`` or hold one suffix are done."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    q = min(8, length)
    word = np.zeros(n, np.uint64)
    for k in range(q):
        word[: n - k] |= np.where(valid[: n - k] > k, data[k:], 0).astype(np.uint64) << np.uint64(8 * (7 - k))
    known = np.minimum(valid, q)
    order = np.lexsort((known, word))
    new = np.r_[True, (word[order][1:] != word[order][:-1]) | (known[order][1:] != known[order][:-1])]
    bucket, depth = np.empty(n, np.int64), known.astype(np.int64)
    bucket[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    size = np.bincount(bucket, minlength=n)
    live = order[(size[bucket[order]] > 1)]
    while True:
        live = live[(depth[live] < length) & (valid[live] > depth[live])]
        if not len(live):
            break
        b = bucket[live]
        edge = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        cut = np.unique(np.r_[edge[np.linspace(0, len(edge) - 1, min(chunks, len(edge))).astype(int)], len(live)])
        left = []
        for a, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            part = live[a:e]
            ahead = part + depth[part]
            # Suffixes that end here come first; all of a bucket end alike or not at all.
            inside = valid[part] > depth[part]
            ahead = np.where(inside, ahead, 0)
            left.append(_refined(bucket, depth, part, np.where(inside, bucket[ahead], -1), np.where(inside, depth[ahead], 0)))
        live = np.concatenate(left)
    # Neighbours in the order of suffixes that agree on ``length`` bytes.
    able = np.flatnonzero(valid >= length)
    able = able[np.lexsort((able, bucket[able]))]
    out = np.full(n, -1, np.int64)
    if not len(able):
        return out
    x, y = able[:-1], able[1:]
    same = (bucket[x] == bucket[y]) & (depth[x] >= length)
    for a in range(0, len(x), 1 << 16):
        rest = a + np.flatnonzero(~same[a : a + (1 << 16)])
        for k in range(0, length, 20):
            at = np.arange(k, min(k + 20, length))
            rest = rest[(data[x[rest, None] + at] == data[y[rest, None] + at]).all(1)]
        same[rest] = True
    group = np.cumsum(np.r_[0, ~same])
    out[able] = np.where(np.bincount(group)[group] > 1, group, -1)
    return out


def _alike(key: np.ndarray, n: int) -> np.ndarray:
    """Identifiers of equal keys, in the order of the keys; -1 for keys that occur once."""
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.r_[True, s[1:] != s[:-1]]
    group = np.cumsum(new) - 1
    alone = np.bincount(group)[group] == 1
    out = np.empty(n, np.int64)
    out[order] = np.where(alone, -1, group)
    return out


def _strings(data: np.ndarray, offset: np.ndarray, begin: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int):
    """128 bits of hash of every string of the contexts, its context and its start."""
    count = np.maximum(hi - lo + 1, 0)
    owner = np.repeat(np.arange(len(lo)), count)
    start = lo[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = offset[owner] + start - begin[owner]
    power, inverse = powers(len(data) + 1)

    def of(weight: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weight * power[:-1])])
        return (sums[at + length] - sums[at]) * inverse[at]

    wide = data.astype(np.uint64)
    return mix(of(wide + np.uint64(1))).view(np.int64), mix(of(mix(wide, 5)), 1).view(np.int64), owner, start


def _earliest_string(one, two, doc, start):
    """The first of each string; and of the others, which they are."""
    order = np.lexsort((start, doc, two, one))
    new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])][: len(order)]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    late = ~new & ((doc[order] != doc[head]) | (start[order] != start[head]))
    return order[new], order[late]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group_contexts: int = GROUP_CONTEXTS):
    """The documents by group, and the ranges of starts of repeated strings in them."""
    spark = docs.sparkSession
    ship(spark)
    known = names(docs, id_col, text_col)
    base = known.of(docs, F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumnRenamed("name", "doc")
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(known.total / GROUP_BYTES))

    def gather(batches):
        """Rows (group, anchors, settled): packed anchors by q-gram, packed ranges by document."""
        for batch in batches:
            for part in spans(batch, most=3 << 20):
                ids = np.asarray(part.column("doc").to_numpy(zero_copy_only=False), np.int64)
                g, c, side, row, pos, lo, hi = anchors(Hashed(part.column("text"), fold=False), length, gram)
                if not len(g):
                    continue
                order, _, new = _earliest(g, c, ids[row], pos)
                # Rows equal in id and text repeat the earliest itself; that is no repeat.
                head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
                late = ~new & ((ids[row[order]] != ids[row[head]]) | (pos[order] != pos[head]))
                settled = _merge(ids[row[order[late]]], lo[order[late]], hi[order[late]])
                keep = np.sort(order[new])
                aim = (mix(settled[0].astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
                rows: dict[int, list[bytes]] = {}
                for k, cols in split((g[keep] % np.uint64(groups)).astype(np.int64), g[keep], c[keep], side[keep], ids[row[keep]], pos[keep], pos[keep] - lo[keep], pos[keep] - hi[keep]):
                    rows[k] = [pack(*cols), b""]
                for k, cols in split(aim, *settled):
                    rows.setdefault(k, [b"", b""])[1] = pack(*cols)
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), *(pa.array([r[q] for r in rows.values()], pa.binary()) for q in range(2))], names=["group", "anchors", "settled"])

    def match(table: pa.Table) -> pa.Table:
        parts = [unpack(b, 7) for b in table.column("anchors").to_pylist() if b]
        done = [unpack(b, 3) for b in table.column("settled").to_pylist() if b]
        out = [_found(d, 0, np.zeros(len(d), np.int64), np.zeros(len(d), np.int64), a, b) for d, a, b in done]
        if parts:
            g, c, side, doc, pos, lo, hi = (np.concatenate([p[k] for p in parts]) for k in range(7))
            del parts
            g, side, lo, hi = g.view(np.uint64), side.astype(np.uint16), pos - lo, pos - hi
            order, new_g, new = _earliest(g, c, doc, pos)
            head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            late = order[~new & ((doc[order] != doc[head]) | (pos[order] != pos[head]))]
            d, a, b = _merge(doc[late], lo[late], hi[late])
            out.append(_found(d, 0, np.zeros(len(d), np.int64), np.zeros(len(d), np.int64), a, b))
            # Different contexts of one q-gram that agree on the left or the right half.
            head, group = order[new], (np.cumsum(new_g) - 1)[new]
            near = np.zeros(len(head), bool)
            for part in (side[head] >> 8, side[head] & 255):
                key = group.astype(np.uint64) << np.uint64(8) | part.astype(np.uint64)
                near |= _alike(key, len(key)) >= 0
            i = head[near]
            out.append(_found(doc[i], 1, g[i].view(np.int64), pos[i], lo[i], hi[i]))
        return pa.Table.from_batches(out)

    packed = map_batches(base.select("doc", "text"), gather, "group int, anchors binary, settled binary")
    found = stored(packed.groupBy("group").applyInArrow(match, _FOUND))
    asking = found.where("kind = 1")
    asked = asking.count()
    context_groups = max(1, math.ceil(asked / group_contexts))
    limit = max(group_contexts, asked // HOT)
    hot = np.array(sorted(r.gram for r in asking.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("gram").collect()), np.int64)
    width = length - gram
    contexts_schema = "group int, doc long, begin long, lo int, hi int, content binary"

    def fetch(left: pa.Table, right: pa.Table) -> pa.Table:
        """The bytes of the contexts asked for; of hot q-grams their strings, packed: the
        earliest of each in this place, and in group -1 - place what it settles."""
        text = dict(zip(left.column("doc").to_pylist(), left.column("text").cast(pa.binary()).to_pylist(), strict=True))
        doc, pos, lo, hi, g = (np.asarray(right.column(c).to_numpy()).astype(np.int64) for c in ("doc", "pos", "lo", "hi", "gram"))
        begin = np.maximum(pos - width, 0)
        data = [(text.get(d) or b"")[b : p + length] for d, b, p in zip(doc.tolist(), begin.tolist(), pos.tolist(), strict=True)]
        aim = ((mix(g.view(np.uint64)) >> np.uint64(20)) % np.uint64(context_groups)).astype(np.int64)
        many = np.isin(g, hot)
        out = [pa.table({"group": pa.array(aim[~many], pa.int32()), "doc": pa.array(doc[~many]), "begin": pa.array(begin[~many]), "lo": pa.array(lo[~many], pa.int32()), "hi": pa.array(hi[~many], pa.int32()), "content": pa.array([data[k] for k in np.flatnonzero(~many)], pa.binary())})]
        rows: list[tuple[int, bytes]] = []
        for a in range(0, int(many.sum()), 4096):
            i = np.flatnonzero(many)[a : a + 4096]
            size = np.array([len(data[k]) for k in i], np.int64)
            one, two, owner, start = _strings(np.frombuffer(b"".join(data[k] for k in i), np.uint8), np.cumsum(size) - size, begin[i], lo[i], hi[i], length)
            who = doc[i][owner]
            first, late = _earliest_string(one, two, who, start)
            for k, cols in split(-1 - (one[first].view(np.uint64) % np.uint64(groups)).astype(np.int64), one[first], two[first], who[first], start[first], np.zeros(len(first), np.int64)):
                rows.append((k, pack(*cols)))
            if len(late):
                empty = np.zeros(len(late), np.int64)
                rows.append((-1, pack(empty, empty, who[late], start[late], empty + 1)))
        zero = pa.array([0] * len(rows), pa.int64())
        out.append(pa.table({"group": pa.array([r[0] for r in rows], pa.int32()), "doc": zero, "begin": zero, "lo": zero.cast(pa.int32()), "hi": zero.cast(pa.int32()), "content": pa.array([r[1] for r in rows], pa.binary())}))
        return pa.concat_tables(out)

    def sort(table: pa.Table) -> pa.Table:
        """Starts of strings that have an equal one earlier, by suffix order."""
        content = table.column("content").to_pylist()
        if table.column("group")[0].as_py() < 0:
            parts = [unpack(b, 5) for b in content]
            one, two, doc, start, settled = (np.concatenate([p[k] for p in parts]) for k in range(5))
            open_ = np.flatnonzero(settled == 0)
            _, late = _earliest_string(one[open_], two[open_], doc[open_], start[open_])
            late = np.r_[open_[late], np.flatnonzero(settled)]
            d, a, b = _merge(doc[late], start[late], start[late])
        else:
            size = np.array([len(x) for x in content], np.int64)
            data = np.frombuffer(b"".join(content), np.uint8)
            offset = np.cumsum(size) - size
            owner = np.repeat(np.arange(len(size)), size)
            valid = offset[owner] + size[owner] - np.arange(len(data))
            doc = np.asarray(table.column("doc").to_numpy())
            begin, lo, hi = (np.asarray(table.column(x).to_numpy()).astype(np.int64) for x in ("begin", "lo", "hi"))
            bucket = refine(data, valid, length)
            start = begin[owner] + np.arange(len(data)) - offset[owner]
            mine = np.flatnonzero((bucket >= 0) & (start >= lo[owner]) & (start <= hi[owner]))
            who, start, bucket = doc[owner[mine]], start[mine], bucket[mine]
            order = np.lexsort((start, who, bucket))
            who, start, bucket = who[order], start[order], bucket[order]
            new = np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)]
            head = np.maximum.accumulate(np.where(new, np.arange(len(bucket)), 0)) if len(bucket) else np.zeros(0, np.int64)
            late = ~new & ((who != who[head]) | (start != start[head]))
            d, a, b = _merge(who[late], start[late], start[late])
        zero = np.zeros(len(d), np.int64)
        return pa.Table.from_batches([_found(d, 0, zero, zero, a, b)])

    place = F.pmod(F.xxhash64("doc"), F.lit(groups)).cast("int")
    held = base.withColumn("place", place)
    ranges = found.withColumn("place", place)
    if asked:
        contexts = held.select("doc", "text", "place").groupBy("place").cogroup(ranges.where("kind = 1").groupBy("place")).applyInArrow(fetch, contexts_schema)
        partly = contexts.groupBy("group").applyInArrow(sort, _FOUND)
        ranges = ranges.where("kind = 0").unionByName(partly.withColumn("place", place))
    else:
        ranges = ranges.where("kind = 0")
    return held, ranges.select("place", "doc", "lo", "hi")


def removed_runs(lo: np.ndarray, hi: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by strings that start in the ranges [lo, hi]."""
    _, a, b = _merge(np.zeros(len(lo), np.int64), lo, hi + length - 1)
    return a, b + 1


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row; with ``keep_text``
    also ``starts``, ``ends`` of the runs removed and ``kept`` (binary), what is left."""
    held, ranges = repeats(docs, id_col, text_col, length, gram)
    return cut(held, ranges, length, keep_text)


def cut(held: DataFrame, ranges: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """Rows of ``held`` without the strings that start in the ranges."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", starts array<long>, ends array<long>, kept binary" if keep_text else "")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        doc = np.asarray(right.column("doc").to_numpy())
        lo, hi = (np.asarray(right.column(x).to_numpy()).astype(np.int64) for x in ("lo", "hi"))
        order = np.argsort(doc, kind="stable")
        doc, lo, hi = doc[order], lo[order], hi[order]
        out: list[tuple] = []
        for name, d, text in zip(left.column("doc").to_pylist(), left.column("id").to_pylist(), left.column("text").cast(pa.binary()).to_pylist(), strict=True):
            data = text or b""
            i, j = (np.searchsorted(doc, name), np.searchsorted(doc, name, "right"))
            starts, ends = removed_runs(lo[i:j], hi[i:j], length)
            parts, p = [], 0
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                parts.append(data[p:a])
                p = b
            kept = b"".join([*parts, data[p:]])
            out.append((d, len(data), len(data) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), starts.tolist(), ends.tolist(), kept))
        kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.binary())]
        return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(kinds[: 8 if keep_text else 5])})

    return held.groupBy("place").cogroup(ranges.groupBy("place")).applyInArrow(run, schema)
