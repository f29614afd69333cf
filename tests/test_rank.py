import random

from pyspark.sql import functions as F

from lexspark.config import DEFAULT
from lexspark.operators import rank


def fold(ps, first, r, doc_start):
    """The Python model of the proximity fold: (span counts, occurrences)."""
    n = len(ps)
    c, occ, span = [0] * n, [0] * n, list(first)
    count = dict.fromkeys(("short", "top", "ordered", "phrase", "triple", "double"), 0)
    for a in ps[r]:
        for i in range(n):
            if i == r:
                continue
            p, m = ps[i], len(ps[i])
            if c[i] >= m:
                continue
            c1 = c[i] + 1
            if c1 >= m:
                occ[i] += 1
                c[i] = c1
                continue
            k = c1
            while k < m and p[k] < a:
                k += 1
            if k == m:
                occ[i] += m - c1 + 1
                c[i] = m
            else:
                occ[i] += 2 + k - c1
                c[i] = k
                span[i] = p[k - 1] if p[k - 1] <= a and a - p[k - 1] < p[k] - a else p[k]
        span[r] = a
        count["short"] += max(span) - min(span) < 3 * n
        count["top"] += max(span) < doc_start + 100
        if n > 1:
            phrase = all(span[i] == span[i - 1] + 1 for i in range(1, n))
            near = [sum(abs(span[i] - span[j]) <= 3 for j in range(n) if j != i) for i in range(n)]
            triple = not phrase and max(near) >= 2
            count["ordered"] += all(span[i] >= span[i - 1] for i in range(1, n))
            count["phrase"] += phrase
            count["triple"] += triple
            count["double"] += not triple and max(near) >= 1
    return count, occ


def test_fold_equals_its_model(spark):
    r = random.Random(7)
    for n in (1, 2, 3):
        rows = []
        for k in range(120):
            start = r.randint(1, 50)
            ps = [sorted(r.sample(range(start, start + 60), r.randint(0, 9))) for _ in range(n)]
            first = [p[0] if p else start + 60 + r.randint(0, 200) for p in ps]
            rows.append((k, ps, first, r.randrange(n), start))
        df = spark.createDataFrame(rows, "k int, ps array<array<long>>, first array<long>, r int, start long")
        got = df.select("k", rank.span_features(F.col("ps"), F.col("first"), F.col("r"), F.col("start"), n, DEFAULT).alias("f")).collect()
        assert len(got) == 120
        for row in got:
            _, ps, first, at, start = rows[row.k]
            count, occ = fold(ps, first, at, start)
            assert {x: row.f[x] for x in count} == {x: int(v) for x, v in count.items()}
            assert [w.occ for w in row.f.w] == occ


def test_distinct_top(spark):
    rows = [(0, 1, "u1", "t", 5), (0, 2, "u1", "x", 9), (0, 3, "u3", "x", 9), (0, 4, "u4", "t", 5), (1, 5, "u5", "t", 1)]
    df = spark.createDataFrame(rows, "chunk_id int, doc_id long, url string, title string, score long")
    assert [r.doc_id for r in rank.distinct_top(df, 30).collect()] == [2, 4, 5]
    assert [r.doc_id for r in rank.distinct_top(df, 1).collect()] == [2]


def test_scores(spark):
    row = spark.range(1).select(
        rank.static_score(F.lit("https://www.umich.edu"), F.lit(3), DEFAULT).alias("a"),
        rank.url_score(F.lit("https://www.umich.edu"), ["of", "umich"], F.lit(1), DEFAULT).alias("b"),
        rank.url_score(F.lit("https://www.umich.edu/x"), ["umich", "of"], F.lit(1), DEFAULT).alias("c"),
        rank.title_score(F.lit(0), F.lit(0), DEFAULT).alias("d"),
        rank.title_score(F.lit(3), F.lit(4), DEFAULT).alias("e"),
    )
    assert tuple(row.first()) == (60, 500, 70, 0, 90)
