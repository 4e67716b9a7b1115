"""Operator 10: mixing sources to target weights by Pareto order sampling.

Targets: all words of all sources are shared by weight; a source gets at most `most` times its own words, and what it
can't take is shared again among the others. With c = target / words of a source, each of its documents is taken
floor(c) times for certain. What the source then lacks is drawn as one more copy of some documents, with unequal inclusion
probabilities p = min(1, t * words ** lean): t is set for each source so that the expected words, the sum of p * words, are
what it lacks. At the default `lean` of 0.5 a longer text is likelier to be drawn, less than in proportion to its words; at
0 all documents of a source are alike; documents of p = 1 are certain too. Documents are ranked by random odds over
inclusion odds, u / (1 - u) * (1 - p) / p, with u a hash of id, text and seed, and taken in that order while their words
fit into what the source still lacks; one that doesn't fit is passed over, and the order goes on after it, until no
document fits any more. The one document whose words fill the remaining gap best follows, if it brings the total nearer.

No source is gathered in one task: ranks are counted in bins, the bin that holds the cut is binned again, and only the
rows of that finer bin are ordered. Decisions are a handful of numbers per source, joined back to the documents.

Nulls: a null source is a source of its own (last in order); a null text has no words and is never taken. Equal ids get
different draws by their texts; rows equal in id and text are taken together or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.shared import keep, small_side, words_count

#: Bins of the ranks of each source, and finer bins of the one with the cut: 1 / BINS ** LEVELS of the ranks are ordered.
BINS = 4096
LEVELS = 2


def targets(sizes: DataFrame, most: float = 3.0, weight: Column | None = None) -> DataFrame:
    """(__source, source_size, target): `sizes` has one row per source (__source, source_size).

    Without `weight` (a column over `sizes`), sources by code point, null last, weigh 1, 2, 3, repeating.
    """
    if weight is None:
        place = F.row_number().over(Window.orderBy(F.col("__source").isNull(), F.col("__source")))
        weight = (place - 1) % 3 + 1
    own = keep(sizes.withColumn("__w", weight.cast("double")).withColumn("__cap", F.col("source_size") * F.lit(float(most))), "sources")
    total = own.agg(F.sum("source_size")).first()[0] or 0
    rate = 0.0
    while True:
        # Words per unit of weight when the sources that reached their cap at the last rate are set aside.
        capped = F.col("__w") * F.lit(rate) >= F.col("__cap")
        taken, rest = own.agg(F.sum(F.when(capped, F.col("__cap")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("__w")))).first()
        new = (total - taken) / rest if rest else rate
        if not new > rate:
            break
        rate = new
    return own.withColumn("target", F.least(F.col("__w") * F.lit(rate), F.col("__cap"))).drop("__w", "__cap")


def inclusion(sizes: DataFrame, sources: DataFrame, lean: float) -> DataFrame:
    """sources (__source, __lack, ...) with __t: p = min(1, __t * size ** lean) gives the expected words `__lack`.

    `sizes` has one row per source and size with its number of documents (`__n`): as many rows as there are sizes.
    """
    known = sizes.join(small_side(sources.select(F.col("__source").alias("__s"), "__lack"), 100), F.col("__source").eqNullSafe(F.col("__s")))
    own = Window.partitionBy("__s")
    # If all documents longer than this size are certain, the shorter ones share the rest by words ** lean.
    longer = F.sum(F.col("size") * F.col("__n")).over(own.orderBy(F.desc("size"))) - F.col("size") * F.col("__n")
    mass = F.sum(F.pow("size", F.lit(1.0 + lean)) * F.col("__n")).over(own.orderBy("size"))
    rate = (F.col("__lack") - longer) / mass
    tried = known.where("size > 0 and __lack > 0").select("__s", "size", rate.alias("__rate"))
    # The largest size that isn't certain by its own rate; rounding may leave none where all are certain.
    fits = F.col("__rate") * F.pow("size", F.lit(lean)) <= 1.0
    chosen = tried.groupBy("__s").agg(F.coalesce(F.max_by("__rate", F.when(fits, F.col("size"))), F.max("__rate")).alias("__t"))
    return sources.join(chosen, F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s")


def _taken(rank: Column, size: Column) -> Column:
    """Whether some round took a document: between the one passed over before and the next one that didn't fit."""
    return F.exists("__rounds", lambda x: (rank > x["after"]) & (rank < x["last"]) & (size <= x["limit"]))


def _round(open_rows: DataFrame, state: DataFrame, i: int) -> DataFrame | None:
    """state after a round over the documents that are still open; None where there are none.

    A round takes the documents in rank order up to the first that doesn't fit (`last`), and goes on after it next time.
    """
    inside = open_rows.join(small_side(state.select("__k", "__gap"), 100), F.col("__s").eqNullSafe(F.col("__k"))).drop("__k").withColumn("__below", F.lit(0).cast("long"))
    totals = None
    for level in range(1, LEVELS + 1):
        # Words of each bin of a source, and below it: at most BINS rows for a source.
        place = F.floor(F.col("__r") * float(BINS**level))
        bins = inside.groupBy("__s", place.alias("__bin")).agg(F.sum("size").alias("__words"), F.first("__gap").alias("__gap"), F.first("__below").alias("__start"))
        below = F.col("__start") + F.sum("__words").over(Window.partitionBy("__s").orderBy("__bin")) - F.col("__words")
        bins = keep(bins.withColumn("__below", below), f"bins{i}_{level}")
        if totals is None:
            if bins.isEmpty():
                return None
            totals = bins.groupBy("__s").agg(F.sum("__words").alias("__total")).withColumnRenamed("__s", "__a")
        at = bins.where("__below <= __gap and __below + __words > __gap").select(F.col("__s").alias("__c"), F.col("__bin").alias("__cut"), "__below")
        inside = inside.drop("__below").join(small_side(at, 100), F.col("__s").eqNullSafe(F.col("__c")) & (place == F.col("__cut"))).drop("__c", "__cut")
    running = F.col("__below") + F.sum("size").over(Window.partitionBy("__s").orderBy("__r"))
    cut = inside.withColumn("__run", running).groupBy(F.col("__s").alias("__c")).agg(
        F.min(F.when(F.col("__run") > F.col("__gap"), F.col("__r"))).alias("__last"),
        F.coalesce(F.max(F.when(F.col("__run") <= F.col("__gap"), F.col("__run"))), F.first("__below")).alias("__sum"),
    )
    joined = state.join(cut, F.col("__k").eqNullSafe(F.col("__c")), "left").join(totals, F.col("__k").eqNullSafe(F.col("__a")), "left")
    # No cut: every open document is taken, and none is open afterwards.
    last = F.coalesce("__last", F.lit(2.0))
    gap = F.col("__gap") - F.coalesce("__sum", "__total", F.lit(0))
    done = F.struct(F.col("__after").alias("after"), F.col("__limit").alias("limit"), last.alias("last"))
    return joined.select("__k", last.alias("__after"), gap.alias("__limit"), gap.alias("__gap"), F.concat("__rounds", F.array(done)).alias("__rounds"))


def taken_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", most: float = 3.0, seed: int = 1, lean: float = 0.5) -> DataFrame:
    """df with size, source_size long, target double, copies long (columns of these names are replaced)."""
    if lean < 0:
        raise ValueError("lean is 0 or more")
    plain = df.drop("size", "source_size", "target", "copies")
    # 52 bits of a hash as a number strictly between 0 and 1.
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), 12).cast("double") + 0.5) / float(1 << 52)
    rows = plain.withColumn("size", words_count(text)).withColumn("__source", F.col(source).cast("string")).withColumn("__u", draw)
    small = keep(rows.select("__source", "size", "__u"), "sizes")

    sources = targets(small.groupBy("__source").agg(F.sum("size").alias("source_size")), most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("__whole", F.floor(ratio + 1e-12).cast("long"))
    sources = sources.withColumn("__lack", F.greatest(F.lit(0.0), F.col("target") - F.col("__whole") * F.col("source_size")))
    sizes = small.groupBy("__source", "size").agg(F.count("*").alias("__n"))
    sources = keep(inclusion(sizes, sources, lean), "targets")

    # The rank r is a growing function of the odds ratio that lies between 0 and 1, so it can be binned.
    p = F.least(F.lit(1 - 1e-9), F.col("__t") * F.pow("size", F.lit(lean)))
    odds = F.col("__u") / (1 - F.col("__u")) * (1 - p) / p
    rank = odds / (1 + odds)
    side = small_side(sources.withColumnRenamed("__source", "__s"), 200)
    drawn = small.where("size > 0").join(side, F.col("__source").eqNullSafe(F.col("__s"))).where("__t > 0")
    drawn = drawn.select("__s", "size", rank.alias("__r"))

    # A round goes on after the document that didn't fit before, among documents within what is still lacking.
    rounds = F.array().cast("array<struct<after: double, limit: double, last: double>>")
    state = sources.where("__t > 0").select(F.col("__source").alias("__k"), F.lit(-1.0).alias("__after"), F.lit(float("inf")).alias("__limit"), F.col("__lack").alias("__gap"), rounds.alias("__rounds"))
    state, open_rows, i = keep(state, "round"), drawn, 0
    while (after := _round(open_rows, state, i)) is not None:
        state, i = keep(after, f"round{i}"), i + 1
        bounds = small_side(state.select("__k", "__after", "__limit"), 100)
        still = open_rows.join(bounds, F.col("__s").eqNullSafe(F.col("__k"))).where("__r > __after and size <= __limit")
        open_rows = keep(still.select("__s", "size", "__r"), f"open{i}")
    # Of the documents not taken, the one whose words come nearest to the gap.
    over = drawn.join(small_side(state, 200), F.col("__s").eqNullSafe(F.col("__k"))).where(~_taken(F.col("__r"), F.col("size")))
    miss = F.abs(F.col("size") - F.col("__gap"))
    fill = over.where(miss < F.col("__gap")).groupBy("__s").agg(F.min(F.struct(miss.alias("a"), F.col("__r").alias("b"))).alias("__best"))
    fill = fill.select(F.col("__s").alias("__f"), F.col("__best.b").alias("__fill"))

    decided = sources.join(state, F.col("__source").eqNullSafe(F.col("__k")), "left").join(fill, F.col("__source").eqNullSafe(F.col("__f")), "left")
    decided = keep(decided.withColumnRenamed("__source", "__d").drop("__k", "__f", "__after", "__limit", "__gap", "__lack"), "decided")
    out = rows.join(small_side(decided, 300), F.col("__source").eqNullSafe(F.col("__d")), "left")
    drawn_too = F.coalesce((F.col("__t") > 0) & (_taken(rank, F.col("size")) | F.coalesce(rank == F.col("__fill"), F.lit(False))), F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("__whole") + F.when(drawn_too, 1).otherwise(0)).otherwise(0).cast("long")
    names = [F.col(f"`{c}`") for c in plain.columns]
    return out.select(*names, "size", "source_size", "target", copies.alias("copies"))


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", most: float = 3.0, seed: int = 1, lean: float = 0.5) -> DataFrame:
    """Every document as often as the mix takes it; the columns of df."""
    # All columns travel in one struct, so none can clash with the decisions.
    packed = df.select(F.struct([F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.col(doc_id).alias("__doc"), F.col(text).alias("__body"), F.col(source).alias("__from"))
    taken = taken_copies(packed, "__doc", "__body", "__from", most, seed, lean)
    return taken.where("copies > 0").select(F.explode(F.expr("array_repeat(__row, cast(copies as int))")).alias("__row")).select("__row.*")
