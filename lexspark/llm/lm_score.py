"""Language-model scores by compression cross-entropy.

The size of a text under a compressor primed with a corpus is its code length under
that corpus. A corpus is all that its texts hold twice or more: its words, and its
phrases, runs of words that end where a word's hash says so (8 words on average), found
in at least two texts. Such a dictionary grows with the corpus, and no machine holds it.
But a text can only match what it holds itself. So each text is compressed by zstandard
under a dictionary of its own: those of its phrases that other texts of the corpus hold
too, after the words that save most bytes in the corpus (count times length;
``DICTIONARY`` bytes at most, as many for both corpora). The score is
(general - in_domain) / (general + in_domain): higher is more in-domain.

For the general corpus, which holds the texts themselves, a phrase counts if a second
document holds it; for the in-domain corpus, if any of its texts does. Texts of the
in-domain corpus that a document quotes thus raise its score: with a benchmark as the
in-domain corpus that is a sign of contamination, too.

Words and phrases are counted over all whole texts, by partial aggregates before the
shuffle. Texts are compressed in parts of ``PART`` bytes, of which almost all have one.
Null text counts as empty and scores 0. Repeated rows (equal in id and text) are one
document; rows that share an id but not the text are each their own. Equal texts score
alike. Ties among words go to the smaller word. An empty corpus gives an empty
dictionary. Words of any length count, but a dictionary has no word longer than itself.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import map_batches, ship, stored, text_bytes
from lexspark.llm.names import names
from lexspark.llm.tokens import Hashed, mix, spans

#: Bytes of words in a dictionary, and distinct words a task holds before it hands them on.
DICTIONARY = 112 << 10
HELD = 400_000
#: One word in so many ends a phrase; phrases of fewer words than ``LEAST`` don't count.
ENDS, LEAST = 8, 3
PART, GROUP_BYTES = 1 << 20, 8 << 20


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``word (binary), n`` over all whole texts; tasks count before the shuffle."""

    def run(batches):
        def out(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.binary()), pa.array(c.values(), pa.int64())], names=["word", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for x in text_bytes(batch, text_col):
                seen.update(x.split())
                if len(seen) > HELD:
                    yield out(seen)
                    seen = Counter()
        if seen:
            yield out(seen)

    part = map_batches(df.select(text_col), run, "word binary, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(df: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> bytes:
    """Words by the bytes they save, the best last, where matches are cheapest. A count of
    bytes by gain tells first which words can be among the best, so what is sorted and
    what reaches the driver is about ``size`` bytes."""
    words = word_counts(df, text_col).where(F.length("word") < size)
    words = stored(words.withColumn("gain", F.col("n") * F.length("word")))
    level = F.floor(F.log2("gain") * 8).cast("int")
    levels = words.groupBy(level.alias("level")).agg(F.sum(F.length("word") + 1).alias("bytes")).collect()
    least, held = 0, 0
    for r in sorted(levels, key=lambda r: -r.level):
        least, held = r.level, held + r.bytes
        if held >= size:
            break
    # At most size / 2 words fit; written before they are read, so one task merges the tasks' best.
    top = stored(words.where(level >= least).orderBy(F.desc("gain"), "word").limit(size // 2))
    picked, used = [], 0
    for r in sorted(top.collect(), key=lambda r: (-r.gain, bytes(r.word))):
        if used + len(r.word) + 1 > size:
            break
        picked.append(bytes(r.word))
        used += len(r.word) + 1
    return b" ".join(reversed(picked))


def phrases(h: Hashed) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, row, first and last byte (exclusive, among all rows' bytes) of every phrase."""
    start, end, at = h.words()
    ends = mix(h.of(start, end), 9) % np.uint64(ENDS) == 0
    tails = at[1:][at[1:] > at[:-1]] - 1
    ends[tails] = True
    last = np.flatnonzero(ends)
    first = np.r_[0, last[:-1] + 1][: len(last)]
    long = last - first + 1 >= LEAST
    first, last = first[long], last[long]
    row = np.searchsorted(at, first, "right") - 1
    return mix(h.of(start[first], end[last])), row, start[first], end[last]


def phrase_rows(df: DataFrame) -> DataFrame:
    """``name, hash``: the distinct phrases of each row of ``name, text``."""

    def run(batches):
        for batch in batches:
            for part in spans(batch):
                value, row, _, _ = phrases(Hashed(part.column("text"), fold=False))
                order = np.lexsort((value, row))
                v, r = value[order], row[order]
                new = np.r_[True, (v[1:] != v[:-1]) | (r[1:] != r[:-1])][: len(v)]
                yield pa.RecordBatch.from_arrays([part.column("name").take(pa.array(r[new])), pa.array(v[new].view(np.int64))], names=["name", "hash"])

    return map_batches(df.select("name", "text"), run, "name long, hash long")


def _compressor(content: bytes, level: int, keep: bool) -> zstandard.ZstdCompressor:
    if len(content) < 8:
        return zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    if keep:
        d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


class Coder:
    """Sizes of texts under a corpus' words and the phrases that a text shares with it."""

    def __init__(self, words: bytes, level: int):
        self.words, self.level = words, level
        self.plain = _compressor(words, level, True)

    def size(self, text: bytes, shared: list[bytes]) -> int:
        """``shared``: the text's phrases that the corpus holds, in order."""
        coder = _compressor(b" ".join([self.words, *dict.fromkeys(shared)]), self.level, False) if shared else self.plain
        return sum(len(coder.compress(text[a : a + PART])) for a in range(0, max(1, len(text)), PART))


def score(docs: DataFrame, in_domain: DataFrame, general: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", in_text_col: str = "text", level: int = 3, size: int = DICTIONARY) -> DataFrame:
    """``doc_id, n_bytes, in_domain_bytes, general_bytes, score``. ``general``: all of
    ``docs`` unless it is given."""
    spark = docs.sparkSession
    ship(spark)
    inner, outer = dictionary(in_domain, in_text_col, size), dictionary(general if general is not None else docs, text_col, size)
    n = min(len(inner), len(outer))
    inner, outer = (x[len(x) - n :] for x in (inner, outer))
    known = names(docs, id_col, text_col)
    groups = max(1, math.ceil(known.total / GROUP_BYTES))
    base = known.of(docs, F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    own = stored(phrase_rows(base))
    text_only = lambda df, c: df.select(F.xxhash64(F.col(f"`{c}`")).alias("name"), F.col(f"`{c}`").alias("text"))
    inside = phrase_rows(text_only(in_domain, in_text_col)).select("hash").distinct()
    each = own.distinct() if known.twins else own
    twice = each.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash") if general is None else phrase_rows(text_only(general, text_col)).select("hash").distinct()
    place = F.pmod(F.xxhash64("name"), F.lit(groups)).cast("int")
    shared = each.join(inside, "hash").withColumn("inner", F.lit(True)).unionByName(each.join(twice, "hash").withColumn("inner", F.lit(False))).withColumn("place", place)
    schema = "doc_id long, n_bytes long, in_domain_bytes long, general_bytes long, score double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        coders = Coder(outer, level), Coder(inner, level)
        sets = []
        for kind in (False, True):
            part = right.filter(pa.compute.equal(right.column("inner"), kind))
            name, value = (np.asarray(part.column(c).to_numpy()).astype(np.int64) for c in ("name", "hash"))
            order = np.argsort(name, kind="stable")
            sets.append((name[order], value[order]))
        out: list[tuple] = []
        batch = left.combine_chunks().to_batches()
        for whole in batch:
            for part in spans(whole):
                h = Hashed(part.column("text"), fold=False)
                value, row, a, b = phrases(h)
                value, data = value.view(np.int64), h.data.tobytes()
                edge = np.searchsorted(row, np.arange(part.num_rows + 1))
                for k, (name, doc) in enumerate(zip(part.column("name").to_pylist(), part.column("doc_id").to_pylist(), strict=True)):
                    text, x, y = data[h.offsets[k] : h.offsets[k + 1]], edge[k], edge[k + 1]
                    sizes = []
                    for coder, (names_, values) in zip(coders, sets, strict=True):
                        i, j = np.searchsorted(names_, name), np.searchsorted(names_, name, "right")
                        hit = x + np.flatnonzero(np.isin(value[x:y], values[i:j])) if j > i else []
                        sizes.append(coder.size(text, [data[a[q] : b[q]] for q in hit]))
                    g, s = sizes
                    out.append((doc, len(text), s, g, (g - s) / (g + s)))
        return pa.table({c: pa.array([r[q] for r in out], pa.float64() if c == "score" else pa.int64()) for q, c in enumerate(("doc_id", "n_bytes", "in_domain_bytes", "general_bytes", "score"))})

    held = base.withColumn("place", place)
    return held.groupBy("place").cogroup(shared.groupBy("place")).applyInArrow(run, schema)
