"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies, target /
source size. The whole part is certain; the fractional part is rounded by
pivotal steps: two documents with fractions exchange mass, weighted by their
sizes so that the words taken stay the same, until one of them is 0 or 1, and
the other is paired again. Each block of at most a few dozen documents leaves
one fraction; these residuals are blocked and folded again, level by level,
until each source has one, which is drawn by its fraction. The words taken
from a source thus miss its target by less than one document.

All of it is DataFrame expressions; the number of levels is the logarithm of
the largest source to the base ``block``.

Defined results. Null text: size 0. Null source: a source of its own, last in
the order. Null or repeated ``doc_id``: every row is a document of its own;
equal rows (id, source and size) are folded as one row with a multiplicity
and dealt out again. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ordered_rank
from ..session import materialise
from .common import WORD, key_of, let, text_of

#: Weights dealt to the sources in turn.
WEIGHTS = (5, 2, 1)
#: No target exceeds this many times the size of its source.
CAP = 3
#: Rows folded by one task step; the base of the tree.
BLOCK = 64
SEED = 20


def unit(*parts) -> Column:
    """A number in [0, 1) fixed by the values of ``parts``."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(2**53))


def size_in_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(key, source_size, target) of every source of (key, source_size).

    The water level rises from total / weights: sources whose share would
    exceed ``cap`` times their size stop there and the excess is shared by the
    others, until none is above. One aggregate row a round reaches the driver.
    """
    ranked = ordered_rank(sizes, [], ["key"])
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = materialise(
        ranked.withColumn("weight", F.get(table, F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int"))), "sources"
    )
    most = F.lit(float(cap)) * F.col("source_size")
    total, free = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level, stopped = (float(total or 0) / free if free else 0.0), -1
    while free:
        above = F.lit(level) * F.col("weight") > most
        n, capped, rest = ranked.agg(
            F.count_if(above), F.coalesce(F.sum(F.when(above, most)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
        ).first()
        if n == stopped or not rest:
            break
        level, stopped = (total - capped) / rest, n
    return ranked.select("key", "source_size", F.least(most, F.lit(level) * F.col("weight")).alias("target"))


def _meet(carry: Column, item: Column) -> Column:
    """One pivotal step: (done: rows settled by it, carry: the row still open)."""

    def with_x(row: Column, x: Column) -> Column:
        return row.withField("x", x)

    def exchanged(moves: Column) -> Column:
        # up: the carry rises to 1 or the item falls to 0; down: the other way
        rises = moves["u"] < moves["down"] / (moves["up"] + moves["down"])
        top = F.when(rises, 1 - carry["x"] <= moves["up"]).otherwise(carry["x"] <= moves["down"])
        end = F.when(rises, F.lit(1.0)).otherwise(F.lit(0.0))
        shift = F.when(rises, moves["up"]).otherwise(-moves["down"])
        # the side that reaches its end is set to it exactly
        mine = F.when(top, end).otherwise(carry["x"] + shift)
        theirs = F.when(
            top, F.least(F.greatest(item["x"] - shift * moves["ratio"], F.lit(0.0)), F.lit(1.0))
        ).otherwise(1 - end)
        return F.struct(mine.alias("a"), theirs.alias("b"))

    def sorted_out(xs: Column) -> Column:
        def is_open(x: Column) -> Column:
            return (x > 0) & (x < 1)

        both = F.array(with_x(carry, xs["a"]), with_x(item, xs["b"]))
        return F.struct(
            F.filter(both, lambda r: ~is_open(r["x"])).alias("done"),
            F.get(F.filter(both, lambda r: is_open(r["x"])), F.lit(0)).alias("carry"),
        )

    ratio = carry["size"] / item["size"]
    moves = F.struct(
        ratio.alias("ratio"),
        F.least(1 - carry["x"], item["x"] / ratio).alias("up"),
        F.least(carry["x"], (1 - item["x"]) / ratio).alias("down"),
        item["u"].alias("u"),
    )
    return let(let(moves, exchanged), sorted_out)


def _fold(rows: Column, kind: str) -> Column:
    """Fold sorted rows pairwise; ``kind`` is the SQL type of a row."""
    start = F.struct(F.expr(f"cast(array() as array<{kind}>)").alias("done"), F.expr(f"cast(null as {kind})").alias("carry"))

    def step(state: Column, item: Column) -> Column:
        alone = F.struct(state["done"].alias("done"), item.alias("carry"))

        def joined(met: Column) -> Column:
            return F.struct(F.concat(state["done"], met["done"]).alias("done"), met["carry"].alias("carry"))

        return F.when(state["carry"].isNull(), alone).otherwise(let(_meet(state["carry"], item), joined))

    return F.aggregate(rows, start, step)


_ROW = "struct<u:double,doc_id:bigint,size:bigint,m:bigint,sure:bigint,x:double>"
_FIELDS = [p.split(":")[0] for p in _ROW[7:-1].split(",")]


def round_fractions(items: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Settle ``x`` (0 < x < 1) of (key, doc_id, size, m, sure, x) rows to 0 or 1.

    Per key the sum of size times x changes by less than one size.
    """
    spark, done, level = items.sparkSession, [], 0
    while True:
        counts = items.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        blocks = materialise(counts.select("key", F.ceil(F.col("n") / block).cast("bigint").alias("blocks")), "blocks")
        picked = F.struct(*[F.col(c) for c in _FIELDS]).alias("row")
        placed = (
            items.join(blocks, "key")
            .withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "size"), F.col("blocks")))
            .withColumn("u", unit(F.lit(seed), F.lit(level), F.lit("pair"), "doc_id", "size"))
            .select("key", "block", picked)
        )
        folded = placed.groupBy("key", "block").agg(F.array_sort(F.collect_list("row")).alias("rows"))
        folded = materialise(folded.select("key", _fold(F.col("rows"), _ROW).alias("s")), "folded")
        done.append(folded.select("key", F.inline("s.done")))
        items = folded.where("s.carry is not null").select("key", "s.carry.*")
        level += 1
    # one fraction a source is left: drawn by itself
    last = items.withColumn("u", unit(F.lit(seed), F.lit("last"), "key", "doc_id", "size"))
    done.append(last.withColumn("x", (F.col("u") < F.col("x")).cast("double")))
    out = done[0].select("key", *_FIELDS)
    for part in done[1:]:
        out = out.unionByName(part.select("key", *_FIELDS))
    return out.drop("u")


def mix(docs: DataFrame, doc_id="doc_id", text="text", source="source", weights=WEIGHTS, cap=CAP,
        block=BLOCK, seed=SEED) -> DataFrame:
    """Copies of every document: (doc_id, key, source, size, source_size, target, copies).

    Rows whose id, source and size are equal are told apart by nothing here,
    so which of them gets more copies is open; their number is not.
    """
    sizes = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"),
        size_in_words(text_of(text)).alias("size"),
    )
    rows = materialise(
        sizes.withColumn("key", key_of("source")).groupBy("key", "source", "doc_id", "size")
        .agg(F.count(F.lit(1)).alias("m")), "sizes",
    )
    per_source = rows.groupBy("key").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    targets = materialise(source_targets(per_source, weights, cap), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # of m equal rows floor(m * x) take one copy more, and one keeps the rest of the fraction
    shared = (
        rows.join(targets, "key")
        .withColumn("base", F.floor(rate))
        .withColumn("part", F.col("m") * (rate - F.col("base")))
        .withColumn("sure", F.floor("part"))
        .withColumn("x", F.col("part") - F.col("sure"))
    )
    open_rows = (F.col("size") > 0) & (F.col("x") > 0)
    settled = round_fractions(shared.where(open_rows).select("key", "doc_id", "size", "m", "sure", "x"), block, seed)
    whole = shared.where(~open_rows).select("key", "doc_id", "size", "m", "sure", F.lit(0.0).alias("x"))
    extra = F.expr("case when i <= sure or (i = sure + 1 and x = 1) then 1 else 0 end")
    return (
        settled.unionByName(whole)
        .withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"))))
        .join(targets.withColumn("base", F.floor(rate)), "key")
        .select(
            "doc_id", "key", F.when(F.col("key") != "1", F.substring("key", 2, 2**31 - 1)).alias("source"), "size",
            "source_size", "target", (F.col("base") + extra).cast("bigint").alias("copies"),
        )
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as :func:`mix` takes it."""
    plan = mix(docs, **options)
    name = "_mix_"
    order = F.xxhash64(*[F.col(c) for c in docs.columns])
    plan = plan.groupBy("doc_id", "key", "size").agg(F.sort_array(F.collect_list("copies")).alias("copies"))
    plan = plan.select(*[F.col(c).alias(name + c) for c in plan.columns])
    from pyspark.sql.window import Window

    keyed = docs.select(
        "*", F.col("doc_id").cast("bigint").alias(name + "i"), key_of("source").alias(name + "k"),
        size_in_words(text_of("text")).alias(name + "s"),
    )
    same = Window.partitionBy(name + "i", name + "k", name + "s").orderBy(order)
    joined = keyed.withColumn(name + "r", F.row_number().over(same)).join(
        plan,
        keyed[name + "i"].eqNullSafe(plan[name + "doc_id"]) & (keyed[name + "k"] == plan[name + "key"])
        & (keyed[name + "s"] == plan[name + "size"]),
    )
    copies = F.get(F.col(name + "copies"), F.col(name + "r") - 1)
    taken = joined.where(copies > 0).withColumn(name + "c", F.explode(F.sequence(F.lit(1).cast("bigint"), copies)))
    return taken.select(*[F.col(c) for c in docs.columns])


def op5_mix(spark, sf_dir: str) -> DataFrame:
    """Contract query: size, source size, target and words taken of every document."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies"
    )
