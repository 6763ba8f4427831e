"""Mixing sources to target weights by pivotal dependent rounding.

Sources share all words by weight, capped at ``most`` times their own size. A document
of a source with factor f = target / size is taken floor(f) times, and once more with
probability p, the fraction of f. These last copies are not drawn independently: two
open documents meet and words move from one to the other, in a random direction that
keeps both expectations, until one of them is wholly in or out; the other one goes on.
So the words a source takes differ from its target by less than one document. To make
that a short one, long documents are settled first and meet in order of size; what
rounding the last long one adds or lacks is spread over the open documents of the next
size class before these are settled.

The meetings form a reduction tree. Blocks of at most ``block`` documents are folded in
one row each, every block passes its one open document on, and the open documents of
many blocks form the next level's blocks, until one is left per source. A hot source
thus has many blocks; nothing collects it. Random numbers are hashes of the seed and of
both documents, so reruns agree and no random state is kept.

Defined cases: a null text has size 0; a null source is a source, last in order; repeated
rows are documents of their own and interchangeable; empty tables give empty results;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opslens.llm.common import let, written

WORD = r"[^\x20\x09-\x0D]+"
#: The weights that sources get in turn.
WEIGHTS = (5, 2, 1)
ITEM = "struct<doc_id:bigint,text_hash:bigint,size:double,mass:double>"
DONE = "struct<doc_id:bigint,text_hash:bigint,size:double,taken:int>"


def sized(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size, text_hash) of every document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"),
                            F.xxhash64(F.col("text").isNull(), "text").alias("text_hash"))


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank``, the place of each source in code-point order from 0, null last.

    The sources are range-sorted; a part's first rank is the number of rows before it,
    worked out over one row per part.
    """
    last = F.col("source").isNull()
    ordered = sources.repartitionByRange(last, "source").sortWithinPartitions(last, "source")
    ordered = written(ordered.withColumn("id", F.monotonically_increasing_id()), "mix-sources")
    ordered = ordered.withColumn("part", F.shiftright("id", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    in_part = F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.join(parts, "part").withColumn("rank", F.col("start") + in_part).drop("id", "part", "start")


def targets(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, rank, n, source_size, target) from the sized documents: shares by weight, capped, the excess reshared.

    The level L at which ``sum(min(most * size, L * weight))`` equals all words is found
    by Newton steps; each is one aggregate row, and a step that caps no further source ends it.
    """
    sums = documents.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = written(ranked(sums).withColumn("weight", turn), "mix-targets")
    whole = table.agg(F.sum("source_size"), F.sum("weight")).first()
    total, free = float(whole[0] or 0), float(whole[1] or 0)
    level, capped = (total / free if free else 0.0), -1
    while free:
        full = F.col("source_size") * most <= F.col("weight") * F.lit(level)
        row = table.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("source_size") * most)),
                        F.sum(F.when(~full, F.col("weight")))).first()
        if row[0] == capped or not row[2]:
            break
        capped, level = row[0], (total - float(row[1] or 0)) / float(row[2])
    target = F.least(F.col("source_size") * F.lit(float(most)), F.col("weight") * F.lit(level))
    return table.select("source", "rank", "n", "source_size", target.alias("target"))


def _chance(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def _fold(items: Column, seed: int) -> Column:
    """Lets the documents of an array meet one after the other: struct(done, open)."""
    def meet(state: Column, item: Column) -> Column:
        open_ = state["open"]
        up = F.least(open_["size"] - open_["mass"], item["mass"])          # words the open one can gain
        down = F.least(open_["mass"], item["size"] - item["mass"])         # words it can lose
        gains = _chance(seed, open_["doc_id"], open_["text_hash"], item["doc_id"], item["text_hash"]) * (up + down) < down
        open_mass = F.when(gains, open_["mass"] + up).otherwise(open_["mass"] - down)
        item_mass = F.when(gains, item["mass"] - up).otherwise(item["mass"] + down)
        # the one that reached its bound is settled; which bound it was decides whether it is taken
        open_settled = F.when(gains, open_["size"] - open_["mass"] <= item["mass"]).otherwise(open_["mass"] <= item["size"] - item["mass"])
        settled = F.when(open_settled, F.struct(open_["doc_id"], open_["text_hash"], open_["size"], gains.cast("int")).cast(DONE)).otherwise(
            F.struct(item["doc_id"], item["text_hash"], item["size"], (~gains).cast("int")).cast(DONE))
        rest = F.when(open_settled, F.struct(item["doc_id"], item["text_hash"], item["size"], item_mass).cast(ITEM)).otherwise(
            F.struct(open_["doc_id"], open_["text_hash"], open_["size"], open_mass).cast(ITEM))
        return F.struct(F.concat(state["done"], F.array(settled)).alias("done"), rest.alias("open"))

    start = F.struct(F.array().cast(f"array<{DONE}>").alias("done"), F.element_at(items, 1).cast(ITEM).alias("open"))
    return F.aggregate(F.slice(items, 2, F.size(items)), start, meet)


def rounded(open_documents: DataFrame, seed: int = 17, block: int = 128) -> tuple[DataFrame, DataFrame]:
    """Settles open documents (rank, n, doc_id, text_hash, size, mass); rank is the source's, n its number of documents.

    Gives (rank, doc_id, text_hash, size, taken) and, per source, ``carry``: the words by
    which its last document missed what it should have given.
    """
    item = F.struct("doc_id", "text_hash", F.col("size").cast("double").alias("size"), F.col("mass").cast("double").alias("mass")).cast(ITEM)
    blocks = F.greatest(F.ceil(F.col("n") / block), F.lit(1)).cast("long")
    order = F.xxhash64(F.lit(seed), "doc_id", "text_hash")
    level = open_documents.select("rank", F.pmod(order, blocks).alias("block"), item.alias("item"), order.alias("order"))
    settled = []
    while True:
        place = F.row_number().over(Window.partitionBy("rank", "block").orderBy("order", "item"))
        met = F.struct((-F.col("item.size")).alias("large"), "order", "item")
        level = level.repartition("rank", "block")  # a join before may have dealt a hot source to one task
        grouped = (level.withColumn("sub", F.floor((place - 1) / (4 * block)))
                   .groupBy("rank", "block", "sub").agg(F.sort_array(F.collect_list(met)).alias("items")))
        folded = grouped.select("rank", "block", "sub", F.explode(F.array(
            let(F.col("items.item"), lambda items: _fold(items, seed)))).alias("f"))
        folded = written(folded.select("rank", "block", "sub", "f.done", "f.open"), "mix-level")
        settled.append(folded.select("rank", F.explode("done").alias("d")).select("rank", "d.*"))
        left = folded.agg(F.count(F.lit(1)), F.max("block"), F.max("sub")).first()
        level = folded.select("rank", F.floor(F.col("block") / block).alias("block"), F.col("open").alias("item"),
                              F.xxhash64(F.lit(seed), "block", "sub").alias("order"))
        if not left[0] or not (left[1] or left[2]):
            break
    taken = F.col("item.mass") > _chance(seed + 1, F.col("item.doc_id"), F.col("item.text_hash")) * F.col("item.size")
    last = level.select("rank", "item.*", taken.cast("int").alias("taken"))
    done = last.drop("mass")
    for part in settled:
        done = done.unionByName(part)
    return done, last.select("rank", (F.col("mass") - F.col("taken") * F.col("size")).alias("carry"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 17, block: int = 128,
        classes: tuple[float, ...] = (1.0, 0.25)) -> DataFrame:
    """One row per document: doc_id, source, text_hash, size, source_size, target, copies, taken.

    ``classes`` are the bounds between size classes, as multiples of a source's mean size.
    """
    table = written(sized(documents), "mix-sizes")
    shares = targets(table, weights, most)
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    factor = F.when(F.abs(factor - F.round(factor)) < 1e-9, F.round(factor)).otherwise(factor)
    shares = shares.withColumn("always", F.floor(factor).cast("long")).withColumn("p", factor - F.floor(factor))
    own = table.join(shares.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    is_open = (F.col("p") > 0) & (F.col("size") > 0)
    mean, step = F.col("source_size") / F.col("n"), F.lit(0)
    for bound in classes:
        step = step + (F.col("size") <= mean * bound).cast("int")
    waiting = own.filter(is_open).select("rank", "n", "doc_id", "text_hash", "size", step.alias("step"),
                                         (F.col("p") * F.col("size")).alias("mass"))
    done, carry = None, None
    for i in range(len(classes) + 1):
        part = waiting.filter(F.col("step") == i)
        if carry is not None:
            open_size = part.groupBy("rank").agg(F.sum("size").alias("open_size"))
            extra = carry.join(open_size, "rank").select("rank", (F.col("carry") / F.col("open_size")).alias("extra"))
            mass = F.col("mass") + F.coalesce("extra", F.lit(0.0)) * F.col("size")
            part = part.join(extra, "rank", "left").withColumn("mass", F.least(F.greatest(mass, F.lit(0.0)), F.col("size").cast("double")))
        settled, missed = rounded(part, seed + i, block)
        done = settled if done is None else done.unionByName(settled)
        if carry is not None:
            missed = missed.unionByName(carry.join(missed.select("rank"), "rank", "left_anti"))
        carry = written(missed, "mix-carry")
    columns = ["doc_id", "source", "text_hash", "size", "source_size", "target"]
    last = done.withColumn("size", F.col("size").cast("long")).join(shares, "rank")
    last = last.select(*columns, (F.col("always") + F.col("taken")).alias("copies"))
    rest = own.filter(~is_open).select(*columns, F.col("always").alias("copies"))
    return last.unionByName(rest).withColumn("taken", F.col("size") * F.col("copies"))


RESULT = ["doc_id", "size", "source_size", "target", "taken"]


def repeated(documents: DataFrame, **options) -> DataFrame:
    """The rows of the documents, each as often as the mix takes it.

    Rows of one id, text and source share their copies evenly, the first of them taking what
    is left over. The texts are shuffled once, and the rows of a key are counted where the
    join has put them.
    """
    key = lambda id, source: F.xxhash64(id.isNull(), id, source.isNull(), source)
    taken = mix(documents, **options).select(key(F.col("doc_id"), F.col("source")).alias("k"), F.col("text_hash").alias("h"), "copies")
    taken = taken.groupBy("k", "h").agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("copies")).filter("copies > 0")
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")  # names of the columns may be any
    own = documents.select(row, key(F.col("doc_id").cast("long"), F.col("source")).alias("k"), F.xxhash64(F.col("text").isNull(), "text").alias("h"))
    both = own.join(taken, ["k", "h"])
    place = F.row_number().over(Window.partitionBy("k", "h").orderBy(F.lit(1)))
    each = F.floor(F.col("copies") / F.col("rows")) + (place <= F.col("copies") % F.col("rows")).cast("int")
    both = both.withColumn("own", each.cast("int")).filter("own > 0")
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("own")))).select("row.*")
