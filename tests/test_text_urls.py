import pytest
from pyspark.sql import functions as F

from lexspark.config import DEFAULT
from lexspark.functions import text as T
from lexspark.functions import urls as U
from lexspark.operators import crawl, index
from lexspark.sources import html, parsed


def column(spark, values, kind, **exprs):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [tuple(r)[1:] for r in df.select("k", *[e.alias(n) for n, e in exprs.items()]).orderBy("k").collect()]


def test_varint(spark):
    cases = [(0, 1, "00"), (1, 1, "01"), (17, 1, "11"), (31, 1, "1f"), (32, 2, "2020"), (81, 2, "2051"), (8191, 2, "3fff"), (8192, 3, "402000"), (28709, 3, "407025"), (2097151, 3, "5fffff"), (2097152, 4, "60200000"), (2305843009213693951, 8, "ffffffffffffffff")]
    v = F.col("v")
    got = column(spark, [c[0] for c in cases], "long", n=T.varint_length(v), h=T.varint_hex(v), d=T.varint_decode(T.varint_hex(v)))
    assert got == [(n, h, x) for x, n, h in cases]


def test_url_priority(spark):
    cases = [
        ("https://www.baidu.com/", 824, 802), ("https://web.eecs.edu/rl", 823, 803), ("https://web.eecs.edu/r/wer/s", 818, 798), ("https://web.eecs.gov/rl", 823, 803), ("https://youtube.com/", 826, 808),
        ("https://hi-t.com/newurl", 823, 711), ("https://hit.org/newurl", 824, 814), ("https://hit.net/newurl", 724, 714), ("https://hit.to/newurl", 625, 617),
    ]
    assert column(spark, [c[0] for c in cases], "string", a=U.priority(F.col("v")), b=U.priority(F.col("v"), by_host=True)) == [c[1:] for c in cases]


def test_fix_relative(spark):
    man = "https://man7.org/linux/man-pages/man2/read.2.html"
    cases = [
        ("https://scripts.mit.edu/web", "../start/", "https://scripts.mit.edu/start/"), ("https://scripts.mit.edu/web", "../start", "https://scripts.mit.edu/start"), ("https://scripts.mit.edu/web", "../", "https://scripts.mit.edu/"),
        (man, "../index.html", "https://man7.org/linux/man-pages/index.html"), (man, "../../../style.css", "https://man7.org/style.css"), (man, "//h/p", "https://h/p"), (man, "/p", "https://man7.org/p"), (man, "#f", man + "#f"), (man, "p", "p"),
    ]
    df = spark.createDataFrame(cases, "base string, rel string, want string")
    assert all(r.got == r.want for r in df.select("want", U.fix_relative(F.col("base"), F.col("rel")).alias("got")).collect())


def test_small_url_functions(spark):
    got = column(spark, ["https://www.umich.edu", "https://lib.umich.edu/a"], "string", s=U.simplify(F.col("v")), n=U.domain_name(U.simplify(F.col("v"))), h=U.is_home_page(U.simplify(F.col("v"))), k=U.doc_key(F.col("v")))
    assert got == [("umich.edu", "umich", True, "https@www.umich.edu@@"), ("lib.umich.edu/a", "umich", False, "https@lib.umich.edu@@a")]
    assert column(spark, ["a%20b+c%zz%4", "%41"], "string", d=U.percent_decode(F.col("v"))) == [("a b+c%zz%4",), ("A",)]
    assert column(spark, ["/a.HTML", "/b", "x.tar.gz"], "string", m=U.mime_type(F.col("v"))) == [("text/html",), ("application/octet-stream",), ("application/gzip",)]
    assert column(spark, ["example.org/a", "https://a.org/1", "", "nodot", "a.network"], "string", v=U.valid(F.col("v"))) == [(True,), (False,), (False,), (False,), (False,)]


def test_messages(spark):
    rows = [(5, [(f"title{k}", f"abstract{k}", f"url{k}", k + 4) for k in (1, 2, 3)])]
    df = spark.createDataFrame(rows, "seq int, rows array<struct<title:string,abstract:string,url:string,score:long>>")
    coded = df.select(U.encode_results(F.col("seq"), F.col("rows")).alias("m"))
    assert coded.first().m == "5@3@title1@abstract1@url1@5@title2@abstract2@url2@6@title3@abstract3@url3@7"
    assert [tuple(x) for x in coded.select(U.decode_results(F.col("m")).alias("r")).first().r] == rows[0][1]


def test_a_message_is_split_once(spark):
    """A split for each field took time with the square of a message's rows."""
    rows = [(k, [(f"t{j}", "", f"u{j}", j) for j in range(k)]) for k in (0, 1, 400)]
    df = spark.createDataFrame(rows, "seq int, rows array<struct<title:string,abstract:string,url:string,score:long>>")
    back = df.select("seq", U.decode_results(U.encode_results(F.col("seq"), F.col("rows"))).alias("r"))
    assert {r.seq: [tuple(x) for x in r.r] for r in back.collect()} == dict(rows)
    assert back._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_parsed_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("https://www.example.org/a\n2\n6\n#quick\n#fox\none\ntwo\nthree\nfour\nfive\nsix\n")
    (tmp_path / "b.bin").write_text("x")
    (tmp_path / "c.txt").write_text("broken")
    docs = parsed.read_parsed(spark, str(tmp_path))
    ix = index.build(docs)
    meta = ix.docs.first()
    assert (meta.doc_start, meta.doc_end, meta.title, meta.abstract) == (1, 9, "quick fox", "six")
    assert [(r.field, r.term, r.loc) for r in ix.postings.orderBy("loc").collect()] == [("title", "quick", 1), ("title", "fox", 2)] + [("body", w, k + 3) for k, w in enumerate(("one", "two", "three", "four", "five", "six"))]
    assert parsed.to_lines(docs).first().value == (tmp_path / "a.txt").read_text()
    parsed.write_parsed(docs, str(tmp_path / "out"))
    ix.write(str(tmp_path / "ix"))
    assert index.Index.read(spark, str(tmp_path / "ix")).postings.count() == 8


def test_index_codec_round_trip(spark):
    docs = spark.createDataFrame([(1, "u", ["a"], ["b", "a", "b", "x" * 20]), (2, "v", [], ["b"])], "doc_id long, url string, title_words array<string>, words array<string>")
    ix = index.build(docs)
    back = index.undelta(index.deltas(ix.postings)).collect()
    assert back and all(r.loc == r.decoded for r in back)
    assert ix.chunk_stats.first().asDict() == {"chunk_id": 0, "n_posts": 7, "n_unique": 4, "n_docs": 2}


def test_documents_are_spread_by_their_size(spark, tmp_path, monkeypatch):
    """As many partitions as cores, whatever the size, were read whole by one task each."""
    import uuid

    from lexspark.plans import catalogue

    spark.createDataFrame([(k, f"{uuid.UUID(int=k * 7919**9 % 2**128)} of the", "s", "en") for k in range(3000)], "doc_id long, text string, source string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(index, "PART", 4096, raising=False)
    ix = catalogue.documents_index(spark, str(tmp_path))
    words = next(w for (_, d), (_, w) in catalogue._built.items() if d == str(tmp_path))
    assert words.rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
    assert ix.chunk_stats.first().n_docs == 3000
    catalogue._release(spark)


PAGE = """<html><TITLE>Good Day, all</title><base href="https://b.org/x/"><script>var a = "<p>no";</script><p>One two3 THREE<a
href="/l" class="x">Link text</a> tail <a>none</a><svg><svg>in</svg>in</svg> end <unknown> word <!--x--> <!-- gone --> last"""


def test_html():
    p = html.parse_html(PAGE)
    assert p.title_words == ["good", "all"]
    assert p.words == ["one", "three", "link", "text", "tail", "none", "end", "word", "last"]
    assert p.links == [("/l", ["link", "text"])] and p.base == "https://b.org/x/"


def test_pages_are_parsed_in_pieces():
    """All pages of a batch at once took a worker's memory with the batch's size."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"page_id": list(range(700)), "html": ["x" * (20_000 if k < 100 else 10) for k in range(700)]})
    parts = list(html.pieces([batch, batch.slice(0, 0), batch.slice(600)]))
    assert [x for p in parts for x in p.column("page_id").to_pylist()] == [*range(700), *range(600, 700)]
    assert len(parts) > 2 and max(p.num_rows for p in parts) <= html.PIECE_ROWS


@pytest.mark.parametrize("text", ["", "<", "<p", "a <p", "</p", "<a href=", '<a href="', "<script>x", "<title>t", "<<<", "< p>x", "<svg/>", '<p a=">">x'])
def test_html_ends(text):
    html.parse_html(text)


def test_robots(spark):
    files = spark.createDataFrame([("h.org", "User-agent: x\nDisallow: /\nUser-agent: *\nDisallow: /a\nAllow: /a/*b$\nDisallow: /last")], "host string, content string")
    urls = spark.createDataFrame([(f"https://h.org{p}",) for p in ("/", "/a/1", "/a/1b", "/a/b1", "/last")] + [("https://other.org/",)], "url string")
    got = {r.url[13:]: r.allowed for r in crawl.robots_allowed(urls, crawl.robots_rules(files)).collect()}
    assert got == {"/": True, "/a/1": False, "/a/1b": True, "/a/b1": False, "/last": True, ".org/": False}


def test_crawl_sets(spark):
    urls = spark.createDataFrame([("h", f"u{k}", k) for k in range(5)], "host string, url string, arrival int")
    assert {r.url for r in crawl.host_cap(urls, 2).collect()} == {"u0", "u1"}
    assert {r.url for r in crawl.host_cap(urls, 2, skip_first=True).collect()} == {"u1", "u2"}
    assert crawl.not_seen(urls, urls.where("arrival < 3")).count() == 2
    assert crawl.admit(urls, DEFAULT.frontier_limit - 5) and not crawl.admit(urls, DEFAULT.frontier_limit)
    hops = spark.createDataFrame([(f"https://r/{k}", f"https://r/{k + 1}") for k in range(7)], "src string, dst string")
    got = {r.src: (r.final, r.hops) for r in crawl.resolve_redirects(hops).collect()}
    assert got["https://r/6"] == ("https://r/7", 1) and got["https://r/2"] == ("https://r/7", 5) and got["https://r/1"] == (None, 5)


def test_stream(spark, tmp_path):
    from lexspark.streaming import crawl as stream

    for k in range(2):
        spark.createDataFrame([(j, f"https://h{j % 2}.org/{j}", "") for j in range(k, k + 6)], "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    pages = stream.url_stream(spark, str(tmp_path / "in"))
    stream.run_to_table(stream.capped(stream.new_urls(pages), 2), str(tmp_path / "out"), str(tmp_path / "state"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len({r.url for r in rows}) == len(rows) == 4
