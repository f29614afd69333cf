"""The request path, ranked search end to end, and the crawl against a Python model."""

import pytest
from pyspark.sql import functions as F

from lexspark.config import DEFAULT
from lexspark.functions import urls as U
from lexspark.operators import crawl, index, match
from lexspark.plans import search
from lexspark.plans.query import QueryTooLong, parse
from lexspark.sources import html
from lexspark.workers import shared_root


@pytest.fixture(scope="module")
def ix(spark):
    rows = []
    for k in range(45):
        words = ["pad"] * (k % 7 + 6) + ["quick", "fox"] + ["tail"] * (k % 3) + (["quick"] if k % 2 else [])
        rows.append((k, f"https://www.site{k}.org/{'x' * (k % 40)}", ["story", f"about{chr(97 + k % 26)}", "fox"][: 1 + k % 3], words))
    rows.append((45, "https://www.other.org/", ["other"], ["lazy", "dog", "and", "more", "words", "here", "too"]))
    built = index.build(spark.createDataFrame(rows, "doc_id long, url string, title_words array<string>, words array<string>")).kept()
    yield built
    built.release()


def test_search_by_status(ix):
    assert search.search(ix, "   ").status == "blank"
    assert search.search(ix, "unicorn").status == "no_result"
    assert search.search(ix, "()").status == "no_result"
    first = search.search(ix, "QUICK fox")
    assert (first.status, first.pages) == ("ok", 3)
    rows = [search.search(ix, "quick fox", k).rows.collect() for k in (1, 2, 3)]
    assert [len(r) for r in rows] == [10, 10, 10]
    order = [(-r.score, r.chunk_id, r.doc_id) for p in rows for r in p]
    assert order == sorted(order) and len(set(order)) == 30
    late = search.search(ix, "quick fox", 4)
    assert (late.status, late.rows, late.pages) == ("too_many", None, 3)
    assert search.search(ix, "quick fox", 0).status == "too_many"
    with pytest.raises(QueryTooLong):
        search.search(ix, "q" * 39)
    first.close()


def test_pages_and_requests(ix):
    assert search.request("/?2?a%20b") == (2, "a%20b") and search.request("/style.css") is None
    page = search.render(search.search(ix, "lazy"), '"lazy"')
    assert "&quot;lazy&quot;" in page and page.count("<li>") == 1 and "https://www.other.org/" in page
    assert "no_result" in search.render(search.search(ix, "unicorn"), "unicorn")


def test_percent_escapes(spark):
    cases = {"a%20b": "a b", "caf%C3%A9": "caf\u00e9", "100%": "100%", "%zz+1": "%zz+1", "%2B": "+", "": ""}
    df = spark.createDataFrame(list(cases.items()), "typed string, want string")
    assert df.where(U.percent_decode(F.col("typed")) != F.col("want")).count() == 0


def test_a_written_index_answers_alike(spark, ix):
    path = f"{shared_root(spark)}/written"
    ix.write(path)
    back = index.Index.read(spark, path)
    for text in ("quick fox", '"fox quick"', "lazy | quick", "tail dog"):
        assert sorted(match.match(back, parse(text)).select("doc_id").collect()) == sorted(match.match(ix, parse(text)).select("doc_id").collect())
        assert search.top(back, parse(text)).collect() == search.top(ix, parse(text)).collect()
    for name in ("term_stats", "chunk_stats"):
        a, b = getattr(back, name), getattr(ix, name)
        assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))
    plan = back.postings.where("term = 'lazy'")._jdf.queryExecution().toString()
    assert "EqualTo(term,lazy)" in plan


def test_crawl_equals_its_model(spark):
    body = lambda k: "".join(f'<a href="https://h{j % 5}.org/{j}">x</a>' for j in (2 * k, 2 * k + 1, k // 2, k + 7))
    rows = [(k, f"https://h{k % 5}.org/{k}", f"<p>{body(k)}</p>") for k in range(60)]
    parsed = html.parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    links = {}
    for r in crawl.outlinks(parsed).collect():
        links.setdefault(r.src_url, set()).add(r.dst_url)
    score = {r.url: r.s for r in spark.createDataFrame([(f"https://h{k % 5}.org/{k}",) for k in range(140)], "url string").select("url", U.priority(F.col("url")).alias("s")).collect()}
    done, frontier, k = {}, {f"https://h{j % 5}.org/{j}" for j in (0, 1)}, 0
    while frontier:
        batch = sorted(frontier, key=lambda u: (-score[u], u))[:9]
        done |= dict.fromkeys(batch, k)
        frontier = (frontier | {d for u in batch for d in links.get(u, ())}) - done.keys()
        k += 1
    seeds = spark.createDataFrame([(f"https://h{j % 5}.org/{j}",) for j in (0, 1, 0)], "url string")
    got = crawl.crawl_rounds(parsed, seeds, per_round=9).collect()
    assert {r.url: r.round for r in got} == done and len(got) == len(done) > 60
    assert {r.url for r in crawl.crawl_rounds(parsed, seeds, per_round=9, rounds=2).collect()} == {u for u, n in done.items() if n < 2}


def _crawl_model(score, links, seeds, per_round):
    done, frontier, k = {}, set(seeds), 0
    while frontier:
        batch = sorted(frontier, key=lambda u: (-score(u), u))[:per_round]
        done |= dict.fromkeys(batch, k)
        frontier = (frontier | {d for u in batch for d in links.get(u, ())}) - done.keys()
        k += 1
    return done


@pytest.mark.parametrize(("step", "hops"), [(crawl.STEP, crawl.HOPS), (12, 8), (40, 2)])
def test_many_rounds_to_a_job(spark, monkeypatch, step, hops):
    """Each round was some jobs over all of the frontier, so time grew with the square of it."""
    import random

    r = random.Random(step)
    names = [f"https://h.{r.choice(('org', 'net', 'biz', 'to'))}/{'x' * r.randrange(9)}{k}" for k in range(150)]
    links = {u: {r.choice(names) for _ in range(3)} for u in names[:90]}
    score = lambda u: (850 if ".org" in u else 750 if ".net" in u else 700 if ".biz" in u else 650) - 4 - len(u)
    seeds = names[:70]
    parsed = spark.createDataFrame([(u, "", [(d, []) for d in to]) for u, to in links.items()], "url string, base string, links array<struct<url:string,anchor:array<string>>>")
    played = []
    play = crawl._play
    monkeypatch.setattr(crawl, "HOPS", hops)
    monkeypatch.setattr(crawl, "_play", lambda *a: (played.append(a[-1]), play(*a))[1])
    got = crawl.crawl_rounds(parsed, spark.createDataFrame([(u,) for u in [*seeds, None]], "url string"), per_round=4, step=step).collect()
    want = _crawl_model(score, links, seeds, 4)
    assert {x.url: x.round for x in got} == want and len(got) == len(want)
    assert sum(played) == max(want.values()) + 1 and len(played) < sum(played)


def test_frontier_state(spark):
    urls = spark.createDataFrame([("https://abc.org/x",), ("https://abc.org/x",), ("https://bad.org/y.pdf",), ("https://de.net/z",)], "url string")
    path = f"{shared_root(spark)}/frontier"
    crawl.save_frontier(urls, path)
    back = {r.url: r.score for r in crawl.load_frontier(spark, path).collect()}
    assert back == {r.url: r.s for r in urls.where("url NOT LIKE '%pdf'").select("url", U.priority(F.col("url")).alias("s")).collect()}
    routed = crawl.exchange(spark.range(200).select(F.concat(F.lit("https://h.org/"), F.col("id")).alias("url")), 4)
    where = routed.select("machine", F.spark_partition_id().alias("p")).distinct().collect()
    assert len({r.machine for r in where}) == 4 and len({(r.machine, r.p) for r in where}) == 4


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    from lexspark.streaming import crawl as stream

    def add(a, b):
        spark.createDataFrame([(j, f"https://h{j % 2}.org/{j}", "") for j in range(a, b)], "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    for a, b in ((0, 4), (2, 9)):
        add(a, b)
        pages = stream.url_stream(spark, str(tmp_path / "in"))
        stream.run_to_table(stream.capped(stream.new_urls(pages), 3), str(tmp_path / "out"), str(tmp_path / "state"))
    rows = [r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(rows) == len(set(rows)) == 6 and {f"https://h{j % 2}.org/{j}" for j in range(4)} <= set(rows)


def test_raw_pages(spark, tmp_path):
    pages = spark.createDataFrame([("https://a.org/b", "<p>x")], "url string, html string")
    html.write_raw(pages, str(tmp_path / "raw"))
    assert tuple(spark.read.parquet(str(tmp_path / "raw")).first()) == ("https@a.org@@b", "https://a.org/b", "<p>x")
    assert DEFAULT.pick_count == 400
