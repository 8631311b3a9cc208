"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the expected number of copies of each of its documents.
The whole part is certain; the fractional parts are rounded dependently.  Two documents with
fractional copies exchange words: one gains what the other loses, in a random direction whose odds
keep each expectation, until one of them is whole.  The mixed words of a source therefore stay at
its target but for the last document left.

The exchange runs in blocks of ``BLOCK`` documents: the rows of a source are numbered in the order of a
hash, and consecutive numbers are a block, so that equal rows never make a block larger.  Every block
leaves at most one document undecided; those are the documents of the next level, up to one block per
source.  A source of any size is spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.ranks import with_global_position
from corpusloom.staging import stage

BLOCK, CAP, SEED = 256, 3, 20_240

# One exchange between the undecided document ``a`` and the next one ``e``: what can be moved each
# way, the drawn direction, the new fractions, and who stays undecided.
_PIVOT = """
aggregate(
  filter(units, x -> x.s > 0 and x.p > 0),
  named_struct('k', bigint(-1), 's', double(0), 'p', double(0), 'done', array_remove(array(bigint(-1)), bigint(-1))),
  (a, e) -> if(a.k < 0,
    named_struct('k', e.k, 's', e.s, 'p', e.p, 'done', a.done),
    element_at(transform(array(named_struct(
        'd', least(a.s * (1 - a.p), e.s * e.p), 'g', least(a.s * a.p, e.s * (1 - e.p)))),
      m -> element_at(transform(array(if(e.u * (m.d + m.g) < m.g,
          named_struct('x', if(m.d >= a.s * (1 - a.p), double(1), a.p + m.d / a.s),
                       'y', if(m.d >= e.s * e.p, double(0), e.p - m.d / e.s)),
          named_struct('x', if(m.g >= a.s * a.p, double(0), a.p - m.g / a.s),
                       'y', if(m.g >= e.s * (1 - e.p), double(1), e.p + m.g / e.s)))),
        q -> named_struct(
          'k', if(q.x > 0 and q.x < 1, a.k, if(q.y > 0 and q.y < 1, e.k, bigint(-1))),
          's', if(q.x > 0 and q.x < 1, a.s, e.s),
          'p', if(q.x > 0 and q.x < 1, q.x, q.y),
          'done', concat(a.done, if(q.x >= 1, array(a.k), array_remove(array(a.k), a.k)),
                                 if(q.y >= 1, array(e.k), array_remove(array(e.k), e.k))))), 1)), 1)))
"""


def _uniform(*columns: Column) -> Column:
    """A number in (0, 1) that depends on the columns only."""
    bits = F.shiftrightunsigned(F.xxhash64(*columns), 12).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, cap: float = CAP) -> DataFrame:
    """Add ``target`` to ``(source, source_size)``: weights 1, 2, 3 repeating, by code point, null last.

    Targets share the total of all sizes by weight; a target above ``cap`` times its source's size
    stops there and the excess is shared again by weight until none is above.  Each sharing is one
    aggregate over the sources; only its three totals reach the driver.
    """
    order = [F.col("source").isNull(), F.col("source")]
    weighed = stage(with_global_position(sizes, order, "_at").withColumn("_w", F.col("_at") % 3 + 1), "sources")
    above = lambda rate: F.col("_w") * rate > cap * F.col("source_size")
    total = weighed.agg(F.sum("source_size").alias("t"), F.sum("_w").alias("w")).first()
    words, rate, stopped = total["t"] or 0, 0.0, -1
    rate = words / total["w"] if total["w"] else 0.0
    while True:
        at_cap = weighed.where(above(rate)).agg(
            F.count(F.lit(1)).alias("n"), F.sum("source_size").alias("t"), F.sum("_w").alias("w")
        ).first()
        if at_cap["n"] == stopped or not at_cap["n"] or total["w"] == at_cap["w"]:
            break
        stopped = at_cap["n"]
        rate = (words - cap * at_cap["t"]) / (total["w"] - at_cap["w"])
    target = F.when(above(rate), F.lit(float(cap)) * F.col("source_size")).otherwise(F.col("_w") * rate)
    return weighed.select("source", "source_size", target.cast("double").alias("target"))


def _round(blocks: DataFrame) -> DataFrame:
    """Run the exchanges of each block: ``rest`` is its undecided document, ``done`` the copied ones."""
    return blocks.withColumn("_r", F.expr(_PIVOT)).withColumns({"done": F.col("_r.done"), "rest": F.col("_r")}).drop("_r")


def mix(docs: DataFrame, text: str = "text", block: int = BLOCK, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies)`` of every row.

    ``size`` is the number of words of the text (null: 0), ``taken`` the words the mix takes from
    the row, repeats counted, at most three times its size.  Draws depend on the seed and the place of
    the row among its source's, which follows from ids, sizes and checksums of the texts, so reruns agree.
    Documents without words take nothing.  Repeated
    rows are rounded separately; null ids are ids like any other; a null source is a source.  An
    empty table gives no rows.  ``keep`` names further columns to carry.
    """
    keep = keep or []
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = stage(
        docs.select(
            "doc_id",
            "source",
            F.regexp_count(whole, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("size"),
            F.crc32(whole).alias("_crc"),
            *[F.col(c).alias(f"_keep_{c}") for c in keep],
        ),
        "sizes",
    )
    # Equal rows may change places; a number of their own keeps them from being one range.
    numbered = rows.withColumn("_own", F.monotonically_increasing_id())
    order = [F.col("source").isNull(), F.col("source"), F.xxhash64(F.lit(seed), "doc_id", "_crc", "size"), F.col("doc_id"), F.col("_own")]
    rows = with_global_position(numbered, order, "_at").drop("_own")
    totals = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")
    )
    targets = source_targets(totals.select("source", "source_size"))
    shares = stage(
        targets.join(totals.select(F.col("source").alias("_s"), "_n", "_first"), F.expr("source <=> _s")).select(
            F.col("source").alias("_source"), "source_size", "target", "_first",
            F.expr("if(source_size > 0, target / source_size, 0D)").alias("_rate"),
            F.ceil(F.col("_n") / block).cast("bigint").alias("_blocks"),
        ),
        "targets",
    )
    joined = rows.join(shares, F.expr("source <=> _source")).withColumn("_whole", F.floor("_rate"))
    draw = _uniform(F.lit(seed), "_source", F.col("_at") - F.col("_first"))
    unit = F.struct(
        (-F.col("size")).alias("_order"), F.col("_at").alias("_tie"), "doc_id", "size", "_whole",
        (F.col("_rate") - F.col("_whole")).alias("p"), draw.alias("u"), *[f"_keep_{c}" for c in keep],
    )
    # Large documents first, so that the one left over is small.
    grouped = joined.withColumn("_block", F.expr(f"(_at - _first) div {block}")).groupBy(
        "_source", "_block", "source_size", "target", "_blocks"
    ).agg(F.sort_array(F.collect_list(unit)).alias("_docs"))
    with_units = grouped.withColumn(
        "units",
        F.transform("_docs", lambda x, i: F.struct(i.cast("bigint").alias("k"), x["size"].cast("double").alias("s"), x["p"].alias("p"), x["u"].alias("u"))),
    )
    levels = [stage(_round(with_units).drop("units"), "level")]
    most = levels[0].agg(F.max("_blocks").alias("most")).first()["most"] or 0
    while most > 1:
        below = levels[-1].where("rest.k >= 0")
        up = below.withColumn("_up", F.expr(f"_block div {block}")).groupBy("_source", "_up").agg(
            F.sort_array(F.collect_list(F.struct(
                F.col("_block").alias("k"), F.col("rest.s").alias("s"), F.col("rest.p").alias("p"),
                _uniform(F.lit(seed + len(levels)), "_source", "_block").alias("u"),
            ))).alias("units")
        ).withColumnRenamed("_up", "_block")
        levels.append(stage(_round(up).drop("units"), "level"))
        most = -(-most // block)
    # The last document of each source goes to the nearer side of the target; then decisions go down level by level.
    top = levels[-1].select("_source", "_block", ((F.col("rest.k") >= 0) & (F.col("rest.p") >= 0.5)).alias("_won"))
    for level in reversed(levels[1:]):
        won = level.join(top.withColumnsRenamed({"_source": "_s", "_block": "_b"}), F.expr("_source <=> _s and _block = _b"))
        all_done = F.concat("done", F.when(F.col("_won"), F.array("rest.k")).otherwise(F.array().cast("array<bigint>")))
        top = won.select("_source", F.explode(all_done).alias("_block")).withColumn("_won", F.lit(True))
    decided = levels[0].join(top.withColumnsRenamed({"_source": "_s", "_block": "_b"}), F.expr("_source <=> _s and _block = _b"), "left")
    each = decided.select(
        "source_size", "target", "done", F.when(F.col("_won"), F.col("rest.k")).alias("_extra"), F.posexplode("_docs").alias("_k", "_doc")
    )
    extra = F.array_contains("done", F.col("_k").cast("bigint")) | F.coalesce(F.col("_extra") == F.col("_k"), F.lit(False))
    copies = F.when(F.col("_doc.size") > 0, F.col("_doc._whole") + extra.cast("int")).otherwise(0).cast("bigint")
    return each.select(
        F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.size").alias("size"), "source_size", "target",
        (F.col("_doc.size") * copies).alias("taken"), copies.alias("copies"), *[F.col(f"_doc._keep_{c}").alias(c) for c in keep],
    )
