"""N-gram Jaccard join by a MinHash LSH forest, in DataFrame operations only.

Texts are sets of word n-grams with ``VALUES`` MinHash values. Each of ``trees`` prefix
tries holds every text under its own order of the values; a prefix of the path is one
64-bit label, and texts under one label are candidates of one another. Only the subtrees
of the shortest prefix in use that hold two texts or more are kept.

Prefixes are tried from the longest down. Under a prefix length,

1. each class (first: each text) is compared with the least text that it meets, so
   copies fall together by one comparison each, not in all pairs;
2. then every text is compared with all texts of other classes under its labels, so no
   link between classes depends on what step 1 happened to compare.

From the links that step 2 finds, each of which had a known chance to be seen, the share
of links seen is estimated (Horvitz-Thompson). Prefixes are shortened until it reaches
``recall``; fewer than ``EVIDENCE`` links are no evidence. The shortest prefix gives
pairs at the threshold itself a chance of ``recall`` to meet, whatever the others do.

Links within a class are counted exactly, all of them, copies without making their pairs.
The symmetric difference of n-gram sets is a metric, and a pair links where it is at most
``(1 - threshold) / (1 + threshold)`` of both sizes together. So the distances to one text
of the class, its hub, decide: texts near the hub all link to one another and are counted
as a number; pairs of the others are made within the class, and those that the distances
leave open are verified.

A candidate is verified exactly on both n-gram sets. Sizes (exact) and the two lowest
bits of all values (four standard deviations below the threshold, none for short texts)
rule out pairs before; nothing is capped.

Hot groups: equal texts are one node from the start (their digests combine before the
shuffle). Labels of one class go after step 1, counted by partial aggregates. Under a
label, all texts meet only those outside its largest class, ``PART`` of these at a time,
in rows spread over tasks; pairs are never collected, and only likely ones are written.

Null text counts as empty; texts without n-grams (fewer words than n) have one gram of
all their words. Words are split at white space and lower-cased. Rows equal in id and
text are one document; rows that share an id (or have none) but not the text are each
their own (see ``names``). Empty tables give empty results; only the named columns are
read, and ``keep_one`` passes all others on, whatever their names.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import discard, placed, stored, whole
from lexspark.llm.names import Names, names

#: MinHash values of a text; two bits of each make its sketch, 32 values to a word.
VALUES, WORDS = 192, 6
TREES, DEPTHS, THRESHOLD, RECALL = 96, (9, 6, 4), 0.5, 0.99
#: Links between classes that an estimate of recall needs at least.
EVIDENCE = 200
#: Texts outside a label's largest class that meet the others in one task's row group.
PART = 512


def grams(text: Column, n: int) -> Column:
    """64-bit hashes of the word n-grams of a text (with repeats)."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def of(w: Column) -> Column:
        return F.when(F.size(w) < n, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        )

    return _let(words, of)


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _bin(top: Column, bins: int) -> Column:
    """The bin of a hash by its top 32 bits (signed): ``bins`` equal ranges in order."""
    return F.shiftright((top.cast("long") + F.lit(1 << 31)) * bins, 32).cast("int")


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def orders(trees: int, depth: int) -> list[list[int]]:
    """Of each tree, the places of the values along its paths."""
    r = random.Random(17)
    return [r.sample(range(VALUES), depth) for _ in range(trees)]


def recall_of(depth: int, trees: int, jaccard: float) -> float:
    """The chance that a pair shares a prefix of a length in some tree."""
    return 1 - (1 - jaccard**depth) ** trees


def signature(hashes: Column) -> Column:
    """``VALUES`` MinHash values (32 bits) of sorted n-gram hashes by one permutation: the
    range of the hashes is cut into bins, and a bin's least hash is its value. An empty
    bin takes the value of the next full one before it (the last one, for the first
    bins), which keeps the chance of equal values at the Jaccard similarity."""
    slot = lambda x: _bin(x, VALUES)

    def of(s: Column) -> Column:
        full = F.filter(s, lambda x, i: (i == 0) | (slot(x) != slot(F.get(s, F.greatest(i - 1, F.lit(0))))))

        def spread(v: Column) -> Column:
            upto = lambda i: F.coalesce(slot(F.get(v, i + 1)), F.lit(VALUES))
            runs = F.flatten(F.transform(v, lambda x, i: F.array_repeat(x, upto(i) - slot(x))))
            return F.concat(F.array_repeat(F.element_at(v, -1), slot(F.get(v, F.lit(0)))), runs)

        return _let(full, spread)

    return _let(F.transform(hashes, lambda x: F.shiftright(x, 32).cast("int")), of)


def forest_nodes(texts: DataFrame, n: int) -> DataFrame:
    """``node, size`` (its distinct n-grams), ``values``, ``s0..`` (the sketch) per text."""
    rows = texts.select("node", F.sort_array(F.array_distinct(grams(F.col("text"), n))).alias("g"))
    rows = rows.select("node", F.size("g").alias("size"), signature(F.col("g")).alias("values"))
    word = lambda k: F.aggregate(F.slice("values", 32 * k + 1, 32), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 2).bitwiseOR(x.bitwiseAND(F.lit(3)).cast("long")))
    return rows.select("node", "size", "values", *[word(k).alias(f"s{k}") for k in range(WORDS)])


def forest(nodes: DataFrame, trees: int, depths: tuple[int, ...]) -> DataFrame:
    """``node`` and its labels ``k<depth>`` in every tree whose shortest prefix it shares
    with another text."""
    places = orders(trees, max(depths))
    least = min(depths)
    label = lambda t: F.xxhash64(F.lit(t), *[F.get("values", F.lit(p)) for p in places[t][:least]])
    spread = nodes.select("node", F.posexplode(F.array(*[label(t) for t in range(trees)])).alias("tree", "label"))
    spread = spread.select("node", F.col("tree").cast("byte").alias("tree"), "label")
    # Counted by partial aggregates, so a label that many texts share is one row per task;
    # by half of the label, which tells nearly all apart and halves what is moved.
    half = F.col("label").bitwiseAND(F.lit(0xFFFFFFFF))
    shared = spread.groupBy(half.alias("half")).agg(F.count("*").alias("n")).where("n > 1").select("half")
    met = spread.withColumn("half", half).join(shared, "half").drop("half")
    along = F.array(*[F.array(*[F.lit(p) for p in places[t]]) for t in range(trees)])

    def deeper(depth: int) -> Column:
        if depth == least:
            return F.col("label")
        return F.xxhash64("tree", *[F.get("values", F.get("along", F.lit(k))) for k in range(depth)])

    rows = met.join(nodes.select("node", "values"), "node").withColumn("along", F.get(along, F.col("tree").cast("int")))
    return rows.select("node", *[deeper(d).alias(f"k{d}") for d in depths])


def verified(texts: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """``a, b, jaccard`` of pairs of nodes, on their n-gram sets. Sets are made once for
    each node, where its text lies; one of the two moves."""

    def sets(side: str) -> DataFrame:
        ids = pairs.select(F.col(side).alias("node")).distinct()
        return texts.join(ids, "node", "left_semi").select(F.col("node").alias(side), F.array_distinct(grams(F.col("text"), n)).alias(f"set_{side}"))

    both = pairs.join(sets("a"), "a").join(sets("b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.select("a", "b", (common / (F.size("set_a") + F.size("set_b") - common)).alias("jaccard"))


def components(pairs: DataFrame) -> DataFrame:
    """``node, class_id`` (the smallest node of its connected component) of every node
    in a pair: labels fall to the least among neighbours, then jump along labels."""
    edges = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(pairs.select(F.col("b"), F.col("a")))
    edges = stored(edges.distinct(), release=False)
    labels = stored(edges.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("class_id")).withColumnRenamed("src", "node"), release=False)
    while True:
        near = edges.join(labels, edges["dst"] == labels["node"]).groupBy("src").agg(F.min("class_id").alias("near"))
        low = labels.join(near, F.col("node") == F.col("src")).select("node", F.least("class_id", "near").alias("low"), F.col("class_id").alias("was"))
        jump = labels.select(F.col("node").alias("at"), F.col("class_id").alias("then"))
        step = stored(low.join(jump, F.col("low") == F.col("at"), "left").select("node", F.least("low", F.coalesce("then", "low")).alias("class_id"), "was"), release=False)
        labels = step.select("node", "class_id")
        if step.where("class_id <> was").isEmpty():
            return labels


def merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Classes after links between them."""
    of = lambda side: classes.select(F.col("node").alias(side), F.col("class_id").alias(f"c{side}"))
    edges = links.join(of("a"), "a").join(of("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    edges = stored(edges, release=False)
    if edges.isEmpty():
        return classes
    joined = components(edges).select(F.col("node").alias("class_id"), F.col("class_id").alias("least"))
    return stored(classes.join(joined, "class_id", "left").select("node", F.coalesce("least", "class_id").alias("class_id")), release=False)


def _first_met(met: DataFrame) -> DataFrame:
    """``a, b``: of each class, the least text that it meets under a label of its own, and
    its own least text there. At most one pair per class."""
    each = met.groupBy("label", "class_id").agg(F.min("node").alias("low"))
    heads = each.groupBy("label").agg(F.min("low").alias("head"), F.min_by("class_id", "low").alias("head_class"), F.count("*").alias("k")).where("k > 1")
    best = each.join(heads, "label").where("class_id <> head_class").groupBy("class_id").agg(F.min(F.struct("head", "low")).alias("p"))
    return best.select(F.col("p.head").alias("a"), F.col("p.low").alias("b"))


def _likely(a: str, b: str, threshold: float) -> Column:
    """Whether sizes and sketches allow the threshold. Values of texts with fewer n-grams
    than bins depend on one another, so they count as fewer."""
    small, large = F.least(f"{a}.size", f"{b}.size"), F.greatest(f"{a}.size", f"{b}.size")
    unlike = F.lit(0)
    for k in range(WORDS):
        x = F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))
        unlike = unlike + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    chance = 0.75 * (1 - threshold)
    effective = F.least(F.lit(float(VALUES)), large / 2)
    return (small >= threshold * large) & (unlike <= VALUES * (chance + 4 * (chance * (1 - chance)) ** 0.5 / F.sqrt(effective)))


def _across(met: DataFrame, nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``a < b``: likely pairs of different classes under a label, each once; and the
    written table that they are read from."""
    each = met.groupBy("label", "class_id").agg(F.count("*").alias("n"))
    mixed = each.groupBy("label").agg(F.max_by("class_id", F.struct("n", "class_id")).alias("main"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    rows = met.join(mixed.withColumn("parts", F.ceil(F.col("others") / PART).cast("int")).drop("others"), "label").withColumn("other", F.col("class_id") != F.col("main")).drop("main")
    rows = stored(rows.join(nodes.drop("values"), "node"))
    # The largest class only meets the others; these also meet one another.
    x = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("x")
    y = rows.where("other").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).alias("y")
    apart = (F.col("x.class_id") != F.col("y.class_id")) & (~F.col("x.other") | (F.col("x.node") < F.col("y.node")))
    pairs = x.join(y, (F.col("x.label") == F.col("y.label")) & (F.col("x.part") == F.col("y.part")) & apart & _likely("x", "y", threshold))
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), rows


def _counted(texts: DataFrame, nodes: DataFrame, classes: DataFrame, tried: DataFrame, n: int, threshold: float) -> DataFrame:
    """``node, n_links``: of each text that has some, its links to other texts, all of its
    class held against it. ``tried``: the pairs verified so far."""
    slack, share = 1e-6, (1 - threshold) / (1 + threshold)
    members = classes.join(classes.groupBy("class_id").agg(F.count("*").alias("k")).where("k > 1").select("class_id"), "class_id")
    ends = tried.where(F.col("jaccard") >= threshold).select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    hubs = members.join(ends, "node").groupBy("class_id").agg(F.min_by("node", F.struct(-F.col("degree"), "node")).alias("hub"))
    rows = stored(members.join(hubs, "class_id").join(nodes.select("node", "size"), "node"), release=False)
    apart = rows.where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    tried_hubs = tried.join(apart, ["a", "b"], "left_semi")
    known = stored(tried_hubs.unionByName(verified(texts, stored(apart.join(tried, ["a", "b"], "left_anti"), release=False), n)))
    both = known.select("a", "b", "jaccard").union(known.select("b", "a", "jaccard")).toDF("node", "hub", "jaccard")
    sizes = rows.where("node = hub").select("hub", F.col("size").alias("hub_size"))
    total = F.col("size") + F.col("hub_size")
    # The overlap is a whole number, so it comes back from the share.
    distance = F.when(F.col("node") == F.col("hub"), F.lit(0)).otherwise(total - 2 * F.round(F.col("jaccard") * total / (1 + F.col("jaccard"))))
    rows = rows.join(both, ["node", "hub"], "left").join(sizes, "hub").withColumn("d", distance.cast("long"))
    rows = stored(rows.select("node", "class_id", "size", "d", (F.col("d") - share * F.col("size") + slack).alias("over")), release=False)
    near, far = rows.where("over <= 0"), rows.where("over > 0")
    some = near.join(near.groupBy("class_id").agg((F.count("*") - 1).alias("n_links")), "class_id").select("node", "n_links")
    parts = far.groupBy("class_id").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    x = far.join(parts, "class_id").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts").alias("x")
    y = rows.join(parts, "class_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").alias("y")
    once = (F.col("y.over") <= 0) | (F.col("x.node") < F.col("y.node"))
    small, large = F.least("x.size", "y.size"), F.greatest("x.size", "y.size")
    able = (small + slack >= threshold * large) & (F.abs(F.col("x.d") - F.col("y.d")) <= share * (small + large) + slack)
    pairs = x.join(y, (F.col("x.class_id") == F.col("y.class_id")) & (F.col("x.part") == F.col("y.part")) & once & able)
    pairs = stored(pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), (F.col("x.over") + F.col("y.over") <= 0).alias("sure")))
    done = tried.unionByName(known).dropDuplicates(["a", "b"])
    open_ = pairs.where("NOT sure").select("a", "b")
    new = verified(texts, stored(open_.join(done, ["a", "b"], "left_anti"), release=False), n)
    good = open_.join(done, ["a", "b"]).unionByName(new).where(F.col("jaccard") >= threshold).select("a", "b").union(pairs.where("sure").select("a", "b"))
    others = good.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    return stored(some.unionByName(others).groupBy("node").agg(F.sum("n_links").alias("n_links")).where("n_links > 0"))


def link(docs: DataFrame, n: int = 3, threshold: float = THRESHOLD, trees: int = TREES, depths: tuple[int, ...] = DEPTHS, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", counted: bool = True, row: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None, Names, DataFrame | None]:
    """``digest, node`` of all texts; ``node, class_id``; ``node, n_links`` (where they are
    to be counted); the names of rows; and ``node, row``, a row of each text (where one is
    asked for), kept by node."""
    spark = docs.sparkSession
    known = names(docs, id_col, text_col)
    rows = known.of(docs, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    full = rows if row is None else known.of(docs, row.alias("row"))
    found = stored(rows.select("name", digest(F.col("text")).alias("digest")).groupBy("digest").agg(F.min("name").alias("node")), release=False)
    one = full.join(found.select(F.col("node").alias("name")), "name", "left_semi")
    held = placed(one.withColumnRenamed("name", "node"), "node", int(spark.conf.get("spark.sql.shuffle.partitions")), once=known.twins)
    texts = held if row is None else held.select("node", F.coalesce(F.col("row").getField(text_col), F.lit("")).alias("text"))
    nodes = stored(forest_nodes(texts, n))
    tries = stored(forest(nodes, trees, depths))
    classes = stored(found.select("node", F.col("node").alias("class_id")), release=False)
    tried = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("jaccard"))

    def checked(pairs: DataFrame) -> DataFrame:
        new = stored(pairs.join(tried, ["a", "b"], "left_anti"), release=False)
        out = stored(verified(texts, new, n))
        discard(new)
        return out

    for depth in sorted(depths, reverse=True):
        met = lambda c, d=depth: tries.select(F.col(f"k{d}").alias("label"), "node").join(c, "node")
        first = checked(_first_met(met(classes)))
        classes = merged(classes, first.where(F.col("jaccard") >= threshold))
        tried = tried.unionByName(first)
        if depth == max(depths):
            continue
        pairs, rows_met = _across(met(classes), nodes, threshold)
        second = checked(pairs)
        discard(rows_met)
        good = second.where(F.col("jaccard") >= threshold)
        classes = merged(classes, good)
        tried = tried.unionByName(second)
        chance = 1 - F.pow(1 - F.pow("jaccard", F.lit(depth)), F.lit(trees))
        seen, all_ = good.agg(F.count("*"), F.sum(1 / chance)).first()
        if seen >= EVIDENCE and seen >= recall * all_:
            break
    discard(tries)
    counts = _counted(texts, nodes, classes, tried, n, threshold) if counted else None
    discard(*[held] * (row is None), nodes)
    return found, classes, counts, known, held if row is not None else None


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, text_class`` (the smallest id with an equal text), ``class_id`` (the
    smallest id of the connected near-duplicates), ``n_links`` (the other texts of the class
    that meet the threshold with it, all of them) of every row. Classes are given by name:
    the id itself (-2**63 for none) unless rows share ids."""
    found, classes, counts, _, _ = link(docs, id_col=id_col, text_col=text_col, **options)
    each = found.join(classes, "node").join(counts, "node", "left")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), digest(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("digest"))
    return rows.join(each, "digest").select("doc_id", F.col("node").alias("text_class"), "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row, with all columns, of each class: that of the smallest id."""
    row = whole(docs)
    _, classes, _, known, held = link(docs, id_col=id_col, text_col=text_col, counted=False, row=row, **options)
    kept = classes.where("node = class_id").select("node")
    if held is not None:
        # A text's rows lie by node already, so no row moves.
        return held.join(kept, "node", "left_semi").select("row.*")
    rows = known.of(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(kept.withColumnRenamed("node", "name"), "name", "left_semi")
    return (rows.dropDuplicates(["name"]) if known.twins else rows).select("row.*")
