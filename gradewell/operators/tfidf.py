"""TF-IDF similarities inside row groups (OP-140), relational and exact, in one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_FEATURES = 20_000
TERM = r"[\p{L}\p{N}_]{2,}"
#: Characters of text whose terms a task holds on average.
TASK_CHARS = 1_000_000


def spread(rows: DataFrame, keys: list[str], chars: Column) -> DataFrame:
    """``rows`` dealt by key over as many partitions as their texts need, so that a task's memory doesn't follow the input; read once before."""
    whole = rows.agg(F.sum(chars.cast("long"))).first()[0] or 0
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-whole // TASK_CHARS)), *keys)


def similarities(texts: DataFrame, anchors: list[str], max_features: int = MAX_FEATURES, keep: tuple[str, ...] = (), groups: tuple[str, ...] = ("grp",)) -> DataFrame:
    """``texts`` (grp, doc, text) -> grp, doc, the columns ``keep`` of the text's row, and a cosine to each anchor text of the group.

    Unit-length TF-IDF of words and word pairs, fitted on each group by itself:
    idf = ln((1 + n) / (1 + df)) + 1 with n texts in the group. A group with
    more terms keeps the most frequent ones (ties: the smaller term). A text
    without terms has cosines of zero; the anchors are rows of the result.
    ``groups`` are the columns that name a group.

    All is windows and aggregates whose keys begin with the group, so rows that
    are partitioned by it (see ``spread``) aren't moved, and others once. Terms
    are counted and summed by hash and sorted twice; a row without a term stands
    for its text and alone carries what is kept of it.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    split = texts.select(*groups, "doc", *keep, words.alias("w"))
    each = split.select(*groups, "doc", *keep, F.explode(F.concat(F.coalesce(F.concat("w", pairs), none), F.array(F.lit(None).cast("string")))).alias("term"))
    text = F.col("term").isNull()
    kept = [F.when(text, F.col(c)).alias(c) for c in keep]
    tf = each.select(*groups, "doc", "term", *kept).groupBy(*groups, "doc", "term", *keep).agg(F.count("*").alias("tf"))
    of_term = Window.partitionBy(*groups, "term")
    terms = tf.withColumns({"df": F.count("*").over(of_term), "total": F.sum("tf").over(of_term), **{f"__{a}": F.max(F.when(F.col("doc") == a, F.col("tf"))).over(of_term) for a in anchors}})
    # the rows of texts come first: their total is the number of the group's texts
    order = Window.partitionBy(*groups).orderBy(F.desc(text), F.desc("total"), "term")
    placed = terms.withColumns({"rank": F.dense_rank().over(order) - 1, "n": F.max(F.when(text, F.col("total"))).over(order)})
    idf = F.when(~text & (F.col("rank") <= max_features), F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).otherwise(0.0)
    x = F.col("tf") * F.col("idf")
    products = {"__square": x * x, **{f"__{a}": x * F.coalesce(f"__{a}", F.lit(0)) * F.col("idf") for a in anchors}}
    sums = placed.withColumn("idf", idf).groupBy(*groups, "doc", *keep).agg(*[F.sum(v).alias(k) for k, v in products.items()])
    of_doc = sums.groupBy(*groups, "doc").agg(*[F.first(c, ignorenulls=True).alias(c) for c in keep], *[F.sum(k).alias(k) for k in products])
    length, whole = F.sqrt("__square"), Window.partitionBy(*groups)
    lengths = of_doc.withColumns({f"__of_{a}": F.max(F.when(F.col("doc") == a, length)).over(whole) for a in anchors})
    sims = [F.when((length > 0) & (F.col(f"__of_{a}") > 0), F.col(f"__{a}") / (length * F.col(f"__of_{a}"))).otherwise(0.0).alias(f"sim_{a}") for a in anchors]
    return lengths.select(*groups, "doc", *keep, *sims)
