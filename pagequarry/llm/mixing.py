"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each document of a source wants f = target / source_size copies. floor(f) copies are certain; the fraction p is rounded
dependently: two documents move mass (p times size) from one to the other until one of them has 0 or 1, so that the taken
words of the pair stay the same and every document keeps its expected share. A block of documents is folded this way to
whole copies and one document with a fraction left; those go on to the next level of a reduction tree, whose last level
rounds one document per source to the nearer number. The words taken from a source thus differ from its target by at most
half a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.llm.base import as_row, cut, n_spaced_words, row_columns

#: Weights of the sources in turn, most copies of a document, documents of a block, sources of a range.
WEIGHTS, MAX_COPIES, BLOCK, RANGE, SEED = (1, 2, 3), 3, 256, 100_000, 20240
_EPS = 1e-9


def _sums_before(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each row, the sums over all rows before it in order. The rows are dealt out by ranges; only one row per
    range passes through one task."""
    ranges = max(1, -(-df.count() // RANGE))
    dealt = cut(df.repartitionByRange(ranges, *order).withColumns({"range": F.spark_partition_id(), **{f"{n} here": c for n, c in sums.items()}}))
    earlier = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0.0)
    per = dealt.groupBy("range").agg(*[F.sum(f"{n} here").alias(f"{n} all") for n in sums])
    per = per.select("range", *[F.coalesce(F.sum(f"{n} all").over(earlier), zero).alias(f"{n} earlier") for n in sums])
    inside = W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(per), "range")
    return out.select(*df.columns, *[(F.col(f"{n} earlier") + F.coalesce(F.sum(f"{n} here").over(inside), zero)).alias(n) for n in sums])


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source of (source, size): skey, source_size, n_docs, target.

    Sources in code point order, null last, take the weights in turn. The targets share all words by weight; none is above
    max_copies times its source, and what is above goes to the others by weight. That is one level: target =
    least(cap, level * weight), found by sorting the sources by cap / weight. There may be very many sources.
    """
    named = F.col("source").asc_nulls_last()
    per = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    per = _sums_before(per, [named], {"turn": F.lit(1.0)})
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights)).cast("int") + 1))
    per = per.withColumn("cap", F.col("source_size") * float(max_copies)).withColumn("ratio", F.col("cap") / F.col("weight")).drop("turn")
    per = cut(_sums_before(per, [F.col("ratio"), named], {"cap_before": F.col("cap"), "weight_before": F.col("weight")}))
    whole = per.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(float(whole["size"] or 0)) - F.col("cap_before")) / (F.lit(float(whole["weight"] or 0)) - F.col("weight_before"))
    first = per.where(level <= F.col("ratio")).agg(F.min(F.struct("ratio", "weight_before", level.alias("level"))).alias("x")).first()["x"]
    found = F.lit(first["level"]) if first else F.lit(float("inf"))
    return per.select(_key("source").alias("skey"), "source_size", "n_docs", F.least("cap", found * F.col("weight")).alias("target"))


def _key(source: str) -> Column:
    """Null-safe text key of a source."""
    return F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source)))


def _uniform(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


def _pivot(acc: Column, x: Column, seed: int) -> Column:
    """One step of the fold: acc.cur and x move mass until one of them is whole; it goes to acc.done."""
    cur = acc["cur"]
    m1, m2 = cur["size"] * cur["p"], x["size"] * x["p"]
    up, down = F.least((1 - cur["p"]) * cur["size"], m2), F.least((1 - x["p"]) * x["size"], m1)
    goes_up = _uniform(cur["h"], x["h"], F.lit(seed)) < F.try_divide(down, up + down)

    def unit(of: Column, p: Column) -> Column:
        return F.struct(of["order"].alias("order"), of["h"].alias("h"), of["doc_id"].alias("doc_id"), of["tag"].alias("tag"), of["dup"].alias("dup"), of["size"].alias("size"), of["base"].alias("base"), p.alias("p"))

    def step(whole: Column, extra: int, left: Column) -> Column:
        one = F.struct(whole["doc_id"].alias("doc_id"), whole["tag"].alias("tag"), whole["dup"].alias("dup"), whole["size"].alias("size"), (whole["base"] + extra).alias("copies"))
        return F.struct(left.alias("cur"), F.concat(acc["done"], F.array(one)).alias("done"))

    up_full, down_full = (1 - cur["p"]) * cur["size"] <= m2, (1 - x["p"]) * x["size"] <= m1
    moved = (
        F.when(goes_up & up_full, step(cur, 1, unit(x, (m2 - up) / x["size"])))
        .when(goes_up, step(x, 0, unit(cur, (m1 + up) / cur["size"])))
        .when(down_full, step(x, 1, unit(cur, (m1 - down) / cur["size"])))
        .otherwise(step(cur, 0, unit(x, (m2 + down) / x["size"])))
    )
    return F.when(cur.isNull(), F.struct(x.alias("cur"), acc["done"].alias("done"))).otherwise(moved)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = SEED, block: int = BLOCK, size: str | None = None, tag: str | None = None) -> DataFrame:
    """Copies of each document that bring the sources to their weights.

    docs: doc_id, source and text, whose words [^\\x20\\x09-\\x0D]+ count (null: 0), or a column of sizes named by size. Returns
    doc_id, tag, dup, size, source_size, target, copies (0 to max_copies), taken = copies * size, skey.
    Rows with one doc_id, source, size and tag (a column of whole numbers named by tag, else 0) are documents of their own; dup
    numbers them from 1. Null sources are one source, the last. A source without words has target 0. Empty input gives no
    rows. Other columns are ignored, whatever their names. Reruns give the same copies: the random numbers are hashes.
    """
    own_size = F.col(f"`{size}`").cast("long") if size else n_spaced_words(F.col("text"))
    own_tag = F.col(f"`{tag}`").cast("long") if tag else F.lit(0).cast("long")
    rows = docs.select("doc_id", own_tag.alias("tag"), _key("source").alias("skey"), "source", own_size.alias("size"))
    equal = rows.groupBy("doc_id", "tag", "skey", "source", "size").agg(F.count("*").cast("int").alias("n"))
    sized = cut(equal.select("doc_id", "tag", "skey", "source", "size", F.explode(F.sequence(F.lit(1), "n")).alias("dup")))
    targets = cut(source_targets(sized, weights, max_copies))
    most, docs_in_all = (x or 0 for x in targets.agg(F.max("n_docs"), F.sum("n_docs")).first())
    tasks = max(1, -(-docs_in_all // 8192))  # of the first level; the data are small, so Spark would put them in too few
    share = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    base = F.floor(share + _EPS).cast("int")
    all_docs = sized.drop("source").join(targets, "skey").withColumn("base", base)
    all_docs = all_docs.withColumn("p", F.greatest(share - F.col("base"), F.lit(0.0)))
    open_ = (F.col("p") > _EPS) & (F.col("size") > 0)
    # Large documents first: only partners of about their size can make them whole, so the one left over is rather a small one.
    unit = F.struct((-F.col("size")).alias("order"), F.xxhash64("skey", "doc_id", "tag", "dup", "size", F.lit(seed)).alias("h"), "doc_id", "tag", "dup", F.col("size"), "base", "p")
    left = all_docs.where(open_).select("skey", "n_docs", unit.alias("u"))
    kind = all_docs.select(unit.alias("u")).schema["u"].dataType.simpleString()
    start = F.struct(F.lit(None).cast(kind).alias("cur"), F.array().cast("array<struct<doc_id:{},tag:bigint,dup:int,size:bigint,copies:int>>".format(dict(docs.dtypes)["doc_id"])).alias("done"))
    whole = [all_docs.where(~open_).select("skey", "doc_id", "tag", "dup", "size", F.col("base").alias("copies"))]
    blocks = most
    while True:
        blocks = -(-blocks // block)  # for the largest source; smaller ones have their own number
        n = F.greatest(F.ceil(F.col("n_docs") / float(block)), F.lit(1)).cast("long")
        parted = left.select("skey", n.alias("blocks"), "u").withColumn("b", F.pmod(F.col("u.h"), F.col("blocks")))
        folded = parted.repartition(tasks, "skey", "b").groupBy("skey", "blocks", "b").agg(
            F.aggregate(F.array_sort(F.collect_list("u")), start, lambda a, x: _pivot(a, x, seed)).alias("f")
        )
        folded = cut(folded)
        whole.append(folded.select("skey", F.explode("f.done").alias("d")).select("skey", "d.*"))
        left = folded.where(F.col("f.cur").isNotNull()).select("skey", F.col("blocks").alias("n_docs"), F.col("f.cur").alias("u"))
        tasks = -(-tasks // block)
        if blocks <= 1:
            break
    last = (F.col("u.p") >= 0.5).cast("int")  # one document of a source: to the nearer, which leaves half its size at most
    whole.append(left.select("skey", "u.doc_id", "u.tag", "u.dup", "u.size", (F.col("u.base") + last).alias("copies")))
    out = whole[0]
    for part in whole[1:]:
        out = out.unionByName(part)
    taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
    return out.join(targets, "skey").select("doc_id", "tag", "dup", "size", "source_size", "target", "copies", taken, "skey")


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The documents themselves, each as often as the mix takes it (0 to max_copies times), with all their columns.

    A document is known again by its id, source, size and a hash of its text. Only where all these repeat are rows numbered, by
    a window over each set of such rows.
    """
    row = F.col("row")
    told = docs.select(as_row(docs).alias("row")).select("row", row["doc_id"].alias("doc_id"), row["source"].alias("source"), n_spaced_words(row["text"]).alias("size"), F.xxhash64(row["text"]).alias("tag"))
    copies = cut(mix(told, size="size", tag="tag", **params))
    told = told.withColumn("skey", _key("source"))
    key = ["skey", "doc_id", "size", "tag"]
    if copies.where("dup > 1").isEmpty():
        told = told.withColumn("dup", F.lit(1))
    else:
        told = told.withColumn("dup", F.row_number().over(W.partitionBy(*key).orderBy(F.xxhash64("row"))))
    taken = copies.where("copies > 0").select(*[F.col(c).alias(f"of_{c}") for c in (*key, "dup")], "copies")
    same = F.lit(True)
    for c in (*key, "dup"):
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}")) if c == "doc_id" else F.col(c) == F.col(f"of_{c}")
    return told.join(taken, same).select("row", F.explode(F.sequence(F.lit(1), "copies"))).select(*row_columns(docs, "row"))
