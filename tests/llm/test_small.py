"""Each operator against a brute-force version, and on awkward rows."""

import hashlib
import io
import random
import time
import wave
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexspark.llm import bpe, lm_score, media, ngram_join, packing, passage_dedup, quality, suffix_dedup, topk, toxicity
from lexspark.llm.common import stored
from lexspark.workers import shared_root

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int"
rng = random.Random(3)
VOCABULARY = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(3000)]


def words(n, seed):
    r = random.Random(seed)
    return [r.choice(VOCABULARY) for _ in range(n)]


PASSAGE = " ".join(words(70, 99))
TEXTS = [
    None,
    "",
    " \n ",
    "one",
    " ".join(words(300, 1)),
    " ".join(words(300, 1)),
    " ".join(words(100, 2)) + " " + PASSAGE + " " + " ".join(words(90, 3)),
    " ".join(words(40, 4)) + " " + PASSAGE,
    " ".join([w if k % 40 else "edited" for k, w in enumerate(words(300, 1))]),
    "a" * 1500,
    "ab" * 400 + PASSAGE,
    "né à <|endoftext|> 中文 İΣ ½ ’x’ " + " ".join(words(20, 5)),
    " ".join(words(30_000, 6)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", len(t or ""), None, None) for k, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id " + " ".join(words(80, 8)), None, None, None, None, None)]
    return stored(spark.createDataFrame(rows, SCHEMA).repartition(3))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_bpe_equals_the_library(docs, empty):
    library = Tokenizer.from_file(PATH)
    want = []
    for d, t in rows_of(docs):
        ids = library.encode(t, add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((d, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in bpe.encode_digests(docs, PATH).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.encode_digests(empty, PATH).count() == 0
    r = random.Random(1)
    pieces = [s.removesuffix("</w>") for s in bpe.coder(PATH).vocab]
    for _ in range(1500):
        s = "".join(r.choice(pieces) for _ in range(r.randint(1, 4)))
        ids = bpe.coder(PATH).encode(s)
        assert ids == library.encode(s, add_special_tokens=False).ids
        assert bpe.coder(PATH).decode(ids) == library.decode(ids, skip_special_tokens=False)
    full = bpe.encode_documents(docs, PATH).where("doc_id = 3").first()
    assert full.decoded == "one</w>" and len(full.ids) == 4


def test_packing_places_every_token_once(docs, empty):
    ids = {}
    for d, t in rows_of(docs):
        ids[d] = bpe.coder(PATH).encode(t) + [2]
    pieces = packing.pack_documents(docs, PATH).collect()
    copies = 2  # document 4 is there twice
    by, seq = {}, {}
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert len(part) == p.length > 0 and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        by.setdefault(p.doc_id, []).extend(range(p.start, p.start + p.length))
        seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(by) == set(ids)
    for d, places in by.items():
        assert sorted(places) == sorted(list(range(len(ids[d]))) * (copies if d == 4 else 1))
    for s in seq.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)
    assert packing.pack_documents(empty, PATH).count() == 0


def test_packing_balances_cost():
    rows, over = packing.pack_pool([(k, 0, random.Random(k).randint(1, 900)) for k in range(400)], 1000)
    assert all(sum(n for _, _, n in r) == 1000 for r in rows) and sum(n for _, _, n in over) < 1000


@pytest.mark.parametrize("group_contexts", [suffix_dedup.GROUP_CONTEXTS, 1])
def test_suffix_dedup_equals_brute_force(docs, empty, spark, monkeypatch, group_contexts):
    """Also with all q-grams taken for hot ones, rows without an id, and ids of two texts."""
    monkeypatch.setattr(suffix_dedup, "HOT", 1 << 60 if group_contexts == 1 else suffix_dedup.HOT)
    extra = [(100 + k, t) for k, t in enumerate(["x" * 99, "x" * 100, PASSAGE[:130], PASSAGE[15:160], PASSAGE[:100] + PASSAGE[40:150]])]
    extra += [(100 + 7 * k, PASSAGE[k : 150 + 2 * k] + f" {k}") for k in range(2, 40)]
    extra += [(None, "no id, and " + PASSAGE[:200]), (5, "under 5, " + " ".join(words(60, 77)) + PASSAGE[100:300])]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    held, ranges = suffix_dedup.repeats(more, group_contexts=group_contexts)
    got = sorted((tuple(r[c] for c in columns) for r in suffix_dedup.cut(held, ranges).collect()), key=str)
    # The order of texts under one id is that of a hash.
    known = suffix_dedup.names(more, "doc_id", "text")
    named = {(r.name, r.doc_id, r.text or "") for r in known.of(more, F.col("doc_id"), F.col("text")).collect()}
    seen, want = set(), {}
    for _, d, t in sorted(named, key=lambda x: x[0]):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[d, t] = (d, len(b), sum(gone), sum(1 for run in bytes(gone).split(b"\0") if run), hashlib.sha256(kept).hexdigest())
    assert got == sorted((want[d, t] for d, t in [*rows_of(docs), *extra]), key=str)
    assert suffix_dedup.dedup(empty).count() == 0
    assert suffix_dedup.dedup(docs).count() == docs.count()


def test_contexts_differ_in_their_hash():
    r = np.random.default_rng(6)
    text = pa.array(r.integers(97, 123, (200_000, 100), np.uint8).view("S100").ravel().astype(str).tolist())
    _, context, *_ = suffix_dedup.anchors(suffix_dedup.Hashed(text, fold=False))
    assert len(np.unique(context)) == len(context) == 200_000


def test_bucket_pointer_refinement():
    r = random.Random(2)
    data = np.array([r.choice(b"ab") for _ in range(3000)], np.uint8)
    bucket = suffix_dedup.refine(data, np.arange(3000, 0, -1), 12)
    raw = data.tobytes()
    strings = [raw[k : k + 12] for k in range(3000 - 11)]
    count = {s: strings.count(s) for s in set(strings)}
    assert all((bucket[k] >= 0) == (count[s] > 1) for k, s in enumerate(strings)) and (bucket[len(strings) :] < 0).all()
    ids = {}
    assert all(ids.setdefault(s, bucket[k]) == bucket[k] for k, s in enumerate(strings) if count[s] > 1)


def test_ngram_join_equals_brute_force(docs, empty):
    some = docs.where("doc_id IS NOT NULL")
    sets = {}
    for d, t in set(rows_of(some)):
        w = t.lower().split()
        sets[d] = t, frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)])
    first = {t: min(d for d, (u, _) in sets.items() if u == t) for t, _ in sets.values()}
    nodes = {first[t]: s for t, s in sets.values()}
    near = {a: {b for b in nodes if a != b and len(nodes[a] & nodes[b]) >= 0.5 * len(nodes[a] | nodes[b])} for a in nodes}
    group = {a: a for a in nodes}
    for _ in nodes:
        group = {a: min([group[a], *(group[b] for b in near[a])]) for a in nodes}
    for r in ngram_join.join(some).collect():
        node = first[sets[r.doc_id][0]]
        assert (r.text_class, r.class_id, r.n_links) == (node, group[node], len(near[node])), r
    assert ngram_join.join(docs).count() == docs.count()
    kept = {r.doc_id for r in ngram_join.keep_one(docs).collect()}
    assert kept == {group[a] for a in nodes} | {None}
    assert ngram_join.keep_one(empty).count() == 0 and ngram_join.join(empty).count() == 0


def test_near_copies_are_one_class(spark):
    """Every text of a cluster links to all others of it."""
    base = words(120, 21)
    rows = [(k, " ".join(base[:-1] + [f"w{k}"])) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.join(df).collect()
    assert len(got) == 3000 and {r.class_id for r in got} == {0}
    assert {r.n_links for r in got} == {2999}


def test_all_links_of_a_class_are_counted(spark):
    """Texts at all distances from one another, in classes that a few links connect."""
    r = random.Random(6)
    rows = []
    for k in range(240):
        base, other = ([f"{x}{k % 3}" for x in words(90, 600 + q + k % 3)] for q in (0, 50))
        cut = r.randrange(91)
        w = base[:cut] + other[cut:] if k % 2 else base[:]
        for q in r.sample(range(90), 1 + r.randrange(11)):
            w[q] = f"{w[q]}x{k}"
        rows.append((k, " ".join(w)))
    sets = [frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) for _, t in rows for w in [t.split()]]
    want = {a: sum(a != b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b]) for b in range(240)) for a in range(240)}
    got = {x.doc_id: x.n_links for x in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) > 20


def test_links_at_the_threshold(spark):
    """Recall of pairs whose Jaccard similarity is 0.508."""
    rows = []
    for k in range(300):
        w = [f"{k}w{i}" for i in range(100)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:40] + [f"{k}v{i}" for i in range(30)] + w[70:]))]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).where("n_links = 1").count() / 2
    assert got >= 0.975 * 300


def test_every_bin_has_a_tree(spark):
    rows = [(2 * k + q, f"w{k}" + " " * (1 + q) + f"v{k}") for k in range(300) for q in range(2)]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(k, k - k % 2, 1) for k in range(600)}


def test_media_round_trip(docs, empty):
    want = []
    for d, t in rows_of(docs):
        b = t.encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        file = io.BytesIO()
        with wave.open(file, "wb") as w:
            w.setparams((1, 1, media.RATE, 0, "NONE", ""))
            w.writeframes(p)
        wav = file.getvalue()
        want.append((d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(wav), hashlib.sha256(wav).hexdigest()))
    got = [(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in media.media_digests(docs).collect()]
    assert all(f"samples={r.payload_bytes};" in r.feature and r.feature.startswith("type=audio/wav;") for r in media.media_digests(docs).collect())
    assert sorted(got, key=str) == sorted(want, key=str)
    assert media.media_digests(empty).count() == 0 and media.media_columns(empty).count() == 0
    full = media.media_columns(docs).where("doc_id = 3").first()
    assert media.unpack_samples(full.media).rstrip(b"\0") == b"one" and full.media_type == "audio/wav" and full.corrected


def png() -> bytes:
    chunk = lambda k, b: len(b).to_bytes(4, "big") + k + b + zlib.crc32(k + b).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_sniffing(spark):
    import gzip

    image, wav = png(), media.pack_samples(b"x" * 64)
    s = media.Sniffer()
    assert s.sniff(image, "image/gif") == ("image/png", True, [])
    kind, wrong, inside = s.sniff(b"junk" + image + b"BM RIFF \xff\xd8\xff" + gzip.compress(b"hello") + wav, None)
    assert (kind, wrong) == (media.OCTETS, False) and [f.media_type for f in inside] == ["image/png", "application/gzip", "audio/wav"]
    assert s.sniff(image[:-5])[0] == media.OCTETS
    assert s.sniff(media.pack_samples(image * 2))[2][0].start == 44
    df = spark.createDataFrame([(1, bytearray(image), "image/png"), (2, None, None)], "id long, data binary, said string")
    assert {(r.id, r.media_type, r.corrected) for r in media.sniff_column(df, "data", "id", "said").collect()} == {(1, "image/png", False), (2, None, False)}
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a", b"x" * 50)
    pdf = b"%PDF-1.4 body startxref 9 %%EOF"
    both = s.objects(b"text " + packed.getvalue() + b" and " + pdf + b" tail")
    assert [(f.media_type, f.end - f.start) for f in both] == [("application/zip", len(packed.getvalue())), ("application/pdf", len(pdf))]
    began = time.process_time()
    s.objects(b"%PDF-1.4 PK\x03\x04 PK\x05\x06" * 60_000)  # in time linear in the value
    assert time.process_time() - began < 5
    for k in range(0, len(image), 3):  # damaged bytes never crash a validator
        s.objects(image[:k] + b"\xff" + image[k + 1 :])


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(k, [float(x) for x in r.normal(0, 1 + k % 3, 8).round(1)]) for k in range(300)]
    rows += [(1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (None, [1.0] * 8), rows[5], (301, rows[7][1]), (350, rows[50][1])]
    rows += [(350, [-1e12] + rows[50][1][1:]), (50, rows[51][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    good = [(k, np.floor(np.array(v, np.float32).astype(float) * 256)) for k, v in rows if k is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, (q, x) in enumerate(good):
        if q % 50 == 0:
            s = sorted((-sum(int(a) * int(b) for a, b in zip(x, y)), k) for j, (k, y) in enumerate(good) if j != i)[:5]
            want += [(q, i + 1, k, min(-x, 2**63 - 1)) for i, (x, k) in enumerate(s)]
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(want)
    assert topk.top_k(df.where("vec_id < 0")).count() == 0
    assert topk.top_k(df.where("vec_id IN (100, 101, 102)")).count() == 2


def test_passages(docs, empty):
    rows = passage_dedup.report(docs).collect()
    found = {(r.doc_id, r.source_doc_id) for r in rows}
    assert {(7, 6), (10, 6), (5, 4), (8, 4)} <= found
    assert all(d in (5, 7, 8, 10) for d, _ in found)
    r = next(r for r in rows if (r.doc_id, r.source_doc_id) == (7, 6))
    assert (r.start_word, r.end_word, r.source_start_word, r.jaccard) == (40, 110, 100, 1.0)
    cut = passage_dedup.dedup(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    text = {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}
    assert text[7][0].split() == words(40, 4) and text[6][0] == TEXTS[6] and text[5][0].strip() == "" and text[7][1] == len(text[7][0])
    assert passage_dedup.report(empty).count() == 0 and passage_dedup.dedup(empty).count() == 0


def test_passages_miss_no_exact_repeat(spark):
    """Every string of 50 words that an earlier document holds is reported, however many
    documents share a part of it."""
    a, b = words(25, 300), words(30, 301)
    lines = (a, b, a[-10:] + b[:10])
    rows = [words(20 + k % 30, 1000 + k) + lines[k % 3] + words(25, 2000 + k) for k in range(90)]
    for k in range(40):
        own = words(32, 400 + k)
        rows += [words(30, 3000 + 10 * k + q) + own[:16] + a + own[16:] + words(20, 3005 + 10 * k + q) for q in range(2)]
    rows += [words(35, 5000 + k) + a + b + words(35, 5100 + k) for k in range(3)]
    random.Random(1).shuffle(rows)
    covered = {}
    for r in passage_dedup.report(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string").repartition(4)).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    first, n = {}, 0
    for d, w in enumerate(rows):
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), d) < d:
                assert covered.get(d, set()) >= set(range(k, k + 50)), (d, k)
                n += 1
    assert n > 300


def test_passages_find_edited_copies(spark):
    """Recall on edited passages against verification of all pairs."""
    r = random.Random(7)
    rows = []
    for k in range(240):
        own = words(60, 9000 + k)
        share = (0.04, 0.1, 0.15)[k % 3]
        edited = [r.choice(VOCABULARY) if r.random() < share else w for w in own]
        rows += [words(40, 9300 + k) + own + words(30, 9600 + k), words(25, 9900 + k) + edited + words(40, 10200 + k)]
    number = {w: k for k, w in enumerate(VOCABULARY)}
    code = [np.array([number[w] for w in row], np.uint64) for row in rows]
    want = {k for k in range(1, 480, 2) if passage_dedup.align(code[k], code[k - 1], 50, 5, 0.7)}
    got = {(x.doc_id, x.source_doc_id) for x in passage_dedup.report(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string")).collect()}
    assert len(want) > 180 and {d for d, _ in got} <= want
    assert len({(k, k - 1) for k in want} & got) >= 0.98 * len(want)


def edited_pairs(levels, each, length=80):
    """Pairs of documents with a passage, in the second one with words changed at even
    distances so that the words' Jaccard similarity is the level."""
    r = random.Random(9)
    rows = []
    for k in range(each * len(levels)):
        own = [f"{w}{k}" if q % 3 == 0 else w for q, w in enumerate(words(length, 20_000 + k))]
        level = levels[k % len(levels)]
        n = round(length * (1 - level) / (1 + level))
        edited = list(own)
        for q in range(n):
            edited[int((q + r.random()) * length / n)] = f"new{k}x{q}"
        rows += [words(40, 30_000 + k) + own + words(30, 40_000 + k), words(25, 50_000 + k) + edited + words(40, 60_000 + k)]
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


def test_passage_recall_at_levels(spark):
    """Pairs found at levels of similarity, among those that verification accepts."""
    levels, each = (0.95, 0.88, 0.8, 0.76, 0.72), 60
    rows = edited_pairs(levels, each)
    code = {w: k for k, w in enumerate({x for _, t in rows for x in t.split()})}
    number = [np.array([code[x] for x in t.split()], np.uint64) for _, t in rows]
    want = {k for k in range(1, len(rows), 2) if passage_dedup.align(number[k], number[k - 1], 50, 5, 0.7)}
    got = {x.doc_id for x in passage_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x.source_doc_id == x.doc_id - 1}
    assert got <= want
    for q, level in enumerate(levels):
        mine = {k for k in want if (k // 2) % len(levels) == q}
        assert len(mine & got) >= 0.9 * len(mine), (level, len(mine), len(mine & got))
    assert len(want) > 0.7 * len(rows) / 2


def test_popular_passages_with_edits(spark):
    """Of a passage that many documents hold, each with its own edits, nearly all are found."""
    r = random.Random(4)
    base = words(70, 800)
    rows = [(k, " ".join(words(30, 70_000 + k) + [r.choice(VOCABULARY) if r.random() < 0.06 else w for w in base] + words(30, 80_000 + k))) for k in range(150)]
    got = {x.doc_id for x in passage_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) >= 0.95 * 149


def test_passages_of_frequent_lines(spark, monkeypatch):
    """Two documents share a passage in which only lines agree that 600 others hold apart."""
    monkeypatch.setattr(passage_dedup, "GROUP_BYTES", 200_000)
    text = lambda n, seed: " ".join(words(n, seed))
    lines = [text(10, 900 + k) for k in range(6)]
    apart = [" ".join(f"{text(20, 1000 + 10 * d + k)} {lines[k]}" for k in range(6)) for d in range(600)]
    both = [" ".join(f"{x} {side}{k}" for k, x in enumerate(lines)) for side in ("ours", "theirs")]
    rows = [(d, t) for d, t in enumerate(apart[:300])] + [(1000, f"{text(80, 1)} {both[0]} {text(80, 2)}")]
    rows += [(2000 + d, t) for d, t in enumerate(apart[300:])] + [(3000, f"{text(70, 3)} {both[1]} {text(70, 4)}")]
    got = passage_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [tuple(r)[:4] for r in got] == [(3000, 1000, 70, 135)]


def test_passages_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(passage_dedup, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(passage_dedup, "ASKS", 5)
    rows = edited_pairs((0.9, 0.8), 30) + [(1000 + k, " ".join(words(20 + k % 7, 90_000 + k) + words(60, 91_000 + k % 3) + words(20, 92_000 + k))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [sorted(map(tuple, passage_dedup.report(df.repartition(n)).collect())) for n in (1, 8)]
    assert found[0] == found[1] and len(found[0]) > 60


def test_passages_under_one_id(spark):
    """Rows that share an id, or have none, are documents of their own; other columns of
    any name pass through."""
    shared = " ".join(words(80, 501))
    rows = [(1, shared + " one", 1), (5, " ".join(words(60, 502)), 2), (5, " ".join(words(30, 503)) + " " + shared, 3), (None, " ".join(words(70, 504)), 4), (None, " ".join(words(20, 505)), 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _runs int").withColumn("name", F.col("_runs")).withColumn("place", F.lit("x"))
    out = passage_dedup.dedup(df)
    assert out.columns == df.columns
    text = {r._runs: r.text for r in out.collect()}
    assert len(text) == 5 and text[1] == rows[0][1] and text[3].split() == words(30, 503) and all(text[k] == rows[k - 1][1] for k in (2, 4, 5))
    assert sorted(r._runs for r in ngram_join.keep_one(df).collect()) == [1, 2, 4, 5]  # 3 is near 1


def test_compact_windows_hold_every_run():
    r = np.random.default_rng(4)
    value, offsets = r.integers(0, 1 << 63, 240).astype(np.uint64), np.array([0, 100, 103, 240])
    row, lo, at, hi = passage_dedup.compact_windows(value, offsets, 10)
    for k in range(3):
        v = value[offsets[k] : offsets[k + 1]]
        for a in range(len(v)):
            for b in range(a + 9, len(v)):
                c = a + int(np.argmin(v[a : b + 1]))
                assert ((row == k) & (at == c) & (lo <= a) & (hi >= b)).sum() == 1


def test_passages_leave_one_table(spark):
    """What is left on disk when rows are joined with their passages: no copy of texts."""
    import glob
    import shutil

    root = shared_root(spark).removeprefix("file://")
    rows = [(k, " ".join(words(60, 95_000 + k % 5) + words(30, 96_000 + k))) for k in range(20)]
    had = set(glob.glob(f"{root}/*"))
    found, _ = passage_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string"))
    new = set(glob.glob(f"{root}/*")) - had
    kept = [x for x in new if "text" in spark.read.parquet(x).columns]
    assert not kept and found.select("doc").distinct().count() == 15
    for x in new:
        shutil.rmtree(x)


def test_compact_windows_equal_a_plain_search():
    """Every window by its definition, on random, tied and sorted values; and sorted ones
    in about linear time."""
    r = np.random.default_rng(5)
    for kind in range(3):
        offsets = np.array([0, 0, 60, 63, 150])
        value = (r.integers(0, 1 << 63, 150).astype(np.uint64), r.integers(0, 4, 150).astype(np.uint64) << np.uint64(40), np.arange(150, 0, -1).astype(np.uint64) << np.uint64(33))[kind]
        want = []
        for k in range(4):
            v = (value[offsets[k] : offsets[k + 1]] >> np.uint64(32)).tolist()
            for c in range(len(v)):
                lo = max((i + 1 for i in range(c) if v[i] <= v[c]), default=0)
                hi = min((i - 1 for i in range(c + 1, len(v)) if v[i] < v[c]), default=len(v) - 1)
                if hi - lo + 1 >= 10:
                    want.append((k, lo, c, hi))
        for inside in (None, passage_dedup.whole_runs(offsets, 10)):
            got = passage_dedup.compact_windows(value, offsets, 10, inside)
            assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(want)
    began = time.process_time()
    passage_dedup.compact_windows(np.arange(1_000_000, 0, -1).astype(np.uint64) << np.uint64(33), np.array([0, 1_000_000]), 1)
    assert time.process_time() - began < 10


def test_lm_dictionary(docs, empty, spark):
    d = lm_score.dictionary(docs)
    counts = {}
    for _, t in rows_of(docs):
        for w in t.encode().split():
            counts[w] = counts.get(w, 0) + 1
    assert sum(r.n for r in lm_score.word_counts(docs).collect()) == sum(counts.values())
    best = sorted((w for w in counts if len(w) < 1000), key=lambda w: (-counts[w] * len(w), w))
    for size in (1000, lm_score.DICTIONARY):
        want, used = [], 0
        for w in sorted((w for w in counts if len(w) < size), key=lambda w: (-counts[w] * len(w), w)):
            if used + len(w) + 1 > size:
                break
            want.append(w)
            used += len(w) + 1
        assert lm_score.dictionary(docs, size=size) == b" ".join(reversed(want))
    assert best and len(d) <= lm_score.DICTIONARY and lm_score.dictionary(empty) == b""


def test_lm_scores_equal_brute_force(docs, empty, spark):
    """Sizes recomputed with phrases found by search among all texts."""
    import zstandard

    inside = spark.createDataFrame([(" ".join(words(300, 6)[:150]),), (" ".join(words(40, 50)),), (None,)], "text string")
    twice = [(70 + k, " ".join(words(120, 700 + k // 2) + [f"{k}"])) for k in range(6)] + [(5, "also five " + " ".join(words(50, 710))), (None, "also none")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(twice, "doc_id long, text string"))
    got = {(r.doc_id, r.n_bytes): (r.in_domain_bytes, r.general_bytes, r.score) for r in lm_score.score(df, inside, size=2000).collect()}

    def phrases(text):
        h = lm_score.Hashed(pa.array([text or ""]), fold=False)
        _, _, a, b = lm_score.phrases(h)
        data = (text or "").encode()
        return [data[x:y] for x, y in zip(a.tolist(), b.tolist())]

    rows = sorted({(d, t or "") for d, t in rows_of(df)}, key=str)
    general, inner = {}, {p for r in inside.collect() for p in phrases(r.text)}
    for k, (_, t) in enumerate(rows):
        for p in phrases(t):
            general.setdefault(p, set()).add(k)
    base = [lm_score.dictionary(inside, size=2000), lm_score.dictionary(df, size=2000)]
    n = min(map(len, base))

    def size(text, words_, known):
        content = b" ".join([words_[len(words_) - n :], *dict.fromkeys(p for p in phrases(text) if p in known)])
        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(c.compress(text.encode()))

    shared = {p for p, docs_ in general.items() if len(docs_) > 1}
    assert len(got) == len(rows)
    for d, t in rows:
        i, g = size(t, base[0], inner), size(t, base[1], shared)
        assert got[d, len(t.encode())] == (i, g, (g - i) / (g + i)), d
    # Texts that occur twice are known to the general corpus, those of the in-domain one to that.
    assert all(got[k, len(t)][2] < -0.3 for k, t in twice[:6])
    assert max(got.values(), key=lambda x: x[2]) == got[12, len(TEXTS[12])] or got[12, len(TEXTS[12])][2] > -0.3
    assert lm_score.score(empty, inside).count() == 0 and lm_score.score(docs, empty.select("text")).count() == docs.count()


def corpus(spark, n):
    r = random.Random(5)
    rows, labels = [], []
    for k in range(n):
        bad, toxic = k % 5 == 1, k % 5 == 2
        w = words(r.randint(20, 150), 100 + k)
        if bad:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            for _ in range(3):
                w[r.randrange(len(w))] = "zzqvile" + r.choice(["", "s", "ly", "ness"])
        rows.append((k, " ".join(w), len(" ".join(w))))
        labels.append((k, int(not bad), int(toxic)))
    return stored(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")), stored(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_hold_out(spark, docs, empty, module, label):
    train, labels = corpus(spark, 500)
    model = module.train(train, labels)
    got = module.predict(train, model).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 50 and (got.predicted == got[label]).mean() > 0.9
    out = module.predict(docs, model)
    assert out.count() == docs.count() and out.where("score BETWEEN 0 AND 1").count() == docs.count()
    assert module.predict(empty, model).count() == 0
    blank = module.train(empty, labels.limit(0))
    assert {r.score for r in module.predict(docs, blank).select("score").collect()} == {0.5}
    keep = module.keep_good if module is quality else module.keep_clean
    assert keep(docs, model).columns == docs.columns


def test_gradients():
    r = np.random.default_rng(2)
    net = toxicity.BiGru()
    for k, v in net.p.items():
        net.p[k] = v.astype(np.float64)
    rows = r.integers(0, 50, (toxicity.WINDOW, 3, toxicity.KINDS))
    mask = np.ones((toxicity.WINDOW, 3), bool)

    def logit():
        x = net.embed(rows.reshape(-1, toxicity.KINDS)).reshape(toxicity.WINDOW, 3, -1)
        return x, net.pooled({d: x @ net.p[f"W{d}"] + net.p[f"c{d}"] for d in "fb"}, mask, keep=True)

    x, (_, cache) = logit()
    grads = net.back(rows, x, mask, cache, np.ones(3))
    for name in ("Uf", "Wb", "cf", "v", "w"):
        at = tuple(r.integers(0, n) for n in net.p[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-3
        up = logit()[1][0].sum()
        net.p[name][at] = old - 1e-3
        down = logit()[1][0].sum()
        net.p[name][at] = old
        assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-2 * max(1, abs(grads[name][at])), name


def test_factorisation_identity(docs):
    r = np.random.default_rng(3)
    n = (1 << quality.BITS) + quality.DENSE
    m = quality.FactorisationMachine(0.1, r.normal(0, 1, n), r.normal(0, 1, (n, 4)), np.zeros(quality.DENSE), np.ones(quality.DENSE))
    begin, bucket, value, dense = quality.inputs(pa.array(["a b c a", "", None]), np.array([np.nan] * 3))
    got = m.logits(begin, bucket, value, dense)
    for k in range(3):
        idx = np.r_[bucket[begin[k] : begin[k + 1]], (1 << quality.BITS) + np.arange(quality.DENSE)]
        x = np.r_[value[begin[k] : begin[k + 1]], np.clip(dense[k], -5, 5)]
        pairs = sum(m.v[idx[i]] @ m.v[idx[j]] * x[i] * x[j] for i in range(len(x)) for j in range(i))
        assert abs(got[k] - (0.1 + m.w[idx] @ x + pairs)) < 1e-3


def test_pipeline_stages_move_no_row_twice(spark):
    """The rows that the n-gram join keeps and those that substring dedup cuts are read
    from the tables of texts and not from the input once more."""
    rows = [(k, " ".join(words(60, 97_000 + k % 9) + words(70, 98_000 + k)), f"x{k}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumn("a b.c", F.lit(1))
    for stage in (ngram_join.keep_one, passage_dedup.dedup):
        out = stage(df)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "FileScan parquet" in plan and "ExistingRDD" not in plan and out.columns == df.columns
        got = {r.doc_id: r for r in out.collect()}
        assert len(got) == 40 and all(got[k].row == f"x{k}" and got[k]["a b.c"] == 1 for k in got)
    assert sorted(len(r.text.split()) for r in got.values()) == [70] * 31 + [130] * 9
