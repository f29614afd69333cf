"""The pipeline's stages, one by one, against brute force on a small corpus."""

import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lexspark.llm.common import stored

r = random.Random(11)
VOCABULARY = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(2500)]


def words(n, seed):
    q = random.Random(seed)
    return [q.choice(VOCABULARY) for _ in range(n)]


def test_stages(spark, tmp_path):
    rows, labels = [], []
    shared = words(70, 1)
    for k in range(420):
        w = words(40 + k % 90, 1000 + k)
        kind = ("clean", "bad", "toxic", "copy", "near", "passage")[k % 6]
        if kind == "bad":
            w = [x.upper() + "!!" for x in w]
        elif kind == "toxic":
            w[3] = w[-3] = w[20] = "zzqvile"
        elif kind == "copy":
            w = words(80, 5000 + k // 60)
        elif kind == "near":
            w = words(90, 7000 + k // 30)
            w[r.randrange(90)] = f"edit{k}"
        elif kind == "passage" and k % 12 == 5:
            w = w[:20] + shared + w[20:]
        rows.append((k, " ".join(w), "en", "s", len(" ".join(w))))
        labels.append((k, int(kind != "bad"), int(kind == "toxic")))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kind = {k: ("clean", "bad", "toxic", "copy", "near", "passage")[k % 6] for k in range(420)}
    text = {k: t for k, t, *_ in rows}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "n-gram Jaccard join", "substring dedup", "packing"]

    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), [set(text)]
    results = []
    for _, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, str(tmp_path)))
        results.append(out)
        docs = out
        if "text" in out.columns:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            kept.append({x.doc_id for x in out.select("doc_id").collect()})
    before, clean, good, single, whole = kept
    assert sum(kind[k] == "toxic" for k in before - clean) >= 0.95 * 70 and sum(kind[k] != "toxic" for k in before - clean) <= 4
    assert sum(kind[k] == "bad" for k in clean - good) >= 0.95 * 70 and sum(kind[k] != "bad" for k in clean - good) <= 4

    sets = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k in good for w in [text[k].split()]}
    group = {k: k for k in good}
    near = [(a, b) for a in good for b in good if a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])]
    for _ in range(8):
        for a, b in near:
            group[a] = group[b] = min(group[a], group[b])
    assert single == set(group.values())

    assert whole == single
    cut = {x.doc_id: x.text for x in results[3].collect()}
    holders = sorted(k for k in single if " ".join(shared) in text[k])
    assert len(holders) > 10 and [k for k in holders if " ".join(shared) in cut[k]] == holders[:1]
    assert all(cut[k] == text[k] for k in single - set(holders))

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = results[4].orderBy("doc_id", "start").collect()
    for k in single:
        ids = library.encode(cut[k], add_special_tokens=False).ids + [2]
        mine = [p for p in pieces if p.doc_id == k]
        assert sum(p.length for p in mine) == len(ids) == mine[0].doc_tokens
    assert results[4].groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
    assert np.unique([p.doc_id for p in pieces]).tolist() == sorted(single)


def test_awkward_rows(spark, tmp_path):
    """Nulls, empty texts, repeats, shared ids, a long word, a column more; and no rows."""
    long = " ".join(words(3000, 50))
    rows = [(None, "no id " + " ".join(words(60, 51))), (1, None), (1, ""), (2, ""), (3, long), (3, long), (4, "y" * 5000), (5, " ".join(words(80, 52))), (5, " ".join(words(90, 53)))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, name string"
    for n, kept in ((len(rows), rows), (0, [])):
        path = tmp_path / str(n)
        df = spark.createDataFrame([(d, t, None, "s", None, "x") for d, t in kept], schema)
        df.write.parquet(str(path / "documents.parquet"))
        spark.createDataFrame([(k, 1, 0) for k in range(5)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
        pieces = corpus_pipeline.run(spark, str(path)).collect()
        library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        # Equal texts (empty ones too) leave one row; with labels of one class nothing is rejected.
        want = {(d, t or "") for d, t in [kept[0], *kept[1:2], kept[4], *kept[6:]]} if kept else set()
        tokens = sorted((len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in want))
        assert sum(p.length for p in pieces) == sum(tokens)
        assert sorted({p.doc_id for p in pieces}, key=str) == sorted({d for d, _ in want}, key=str)


def test_tables_of_texts_are_read_in_small_batches(spark, tmp_path, monkeypatch):
    """A scan of full rows, 4096 of them at a time, took the heap of a plain session."""
    from pyspark.sql.readwriter import DataFrameWriter

    from lexspark.llm import common, ngram_join

    spark.createDataFrame([(k, f"{k} " * 60) for k in range(20)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    seen, key = [], "spark.sql.parquet.columnarReaderBatchSize"
    for name in ("parquet", "saveAsTable"):
        write = getattr(DataFrameWriter, name)
        monkeypatch.setattr(DataFrameWriter, name, lambda self, *a, write=write, **k: (seen.append(int(spark.conf.get(key))), write(self, *a, **k))[1])
    before = spark.conf.get(key)
    assert ngram_join.keep_one(spark.read.parquet(f"{tmp_path}/docs")).count() == 20
    assert seen and max(seen) <= common.ROWS and spark.conf.get(key) == before


def test_full_rows_are_sorted_only_where_their_key_lies(spark, tmp_path, monkeypatch):
    """Repeats went by a sort beside the scan of full rows, and names read 4096 texts at a
    time: a plain session ran out of heap at 0.6 GB."""
    from pyspark.sql.readwriter import DataFrameWriter

    from lexspark.llm import common, ngram_join

    rows = [(k % 20, f"{k % 25} " * 60) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    plans, batches = [], []
    kind = type(spark.range(1))
    save, first = DataFrameWriter.saveAsTable, kind.first
    monkeypatch.setattr(DataFrameWriter, "saveAsTable", lambda self, *a, **k: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), save(self, *a, **k))[1])
    monkeypatch.setattr(kind, "first", lambda self: (batches.append(int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize"))), first(self))[1])
    kept = ngram_join.keep_one(spark.read.parquet(f"{tmp_path}/docs")).collect()
    assert len(kept) == len({r.text for r in kept}) == len({t for _, t in rows})
    assert plans and all("SortAggregate" not in p.split("REPARTITION_BY_NUM")[-1] for p in plans)
    assert batches and batches[0] <= common.ROWS
