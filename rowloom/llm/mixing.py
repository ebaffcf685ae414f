"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents, in hash order, form a stream of words that is cut into blocks of BLOCK words. Point t of the
golden-ratio sequence falls into one source's share of [0, 1), so slot t is that source's; the slots of a source, ranked,
take its blocks in turn, again from the first when all are taken. The mix is the blocks in the order of their slots: a
document plays as often as its stream is gone through, each time from the slot of the block that its first word lies in.
The sequence strays from a share by a few slots: those beyond a source's target are void, and those that it lacks follow
after the last point, so each source gives its target to the word.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .numbering import CHUNK_ROWS, chunk_bits, chunk_of, order_hash, running
from .scratch import dropping, store
from .words import Words, pieces

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Words of a block.
BLOCK = 256
#: No document is taken more often.
MOST = 3
#: The golden ratio's part of 2**31, odd, so that 2**31 points in a row fall on each multiple of 2**-31 once.
GOLDEN, PERIOD = 1_327_217_885, 1 << 31
#: Cells of [0, 1) in which points meet sources, at least, and the most points of a cell.
CELLS, POINTS = 4096, 1 << 16


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Never null; sorts as sources do, by code point and null last."""
    return F.when(source.isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), source))


def stream_order(doc_id: Column, text: Column) -> Column:
    """A hash that orders a source's documents: equal rows alone share it."""
    return order_hash(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.when(text.isNull(), F.lit(":")).otherwise(F.concat(F.lit("::"), text))))


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(skey, source_size, target, goal, blocks) of (skey, size). One row for each source, so one sort of all is small.

    Sources in order of most * size / weight: those up to the last whose limit is no more than its part of what the
    ones before leave stop at the limit, and the others share the rest by weight.
    """
    everything = W.partitionBy(F.lit(0))
    number = F.row_number().over(everything.orderBy("skey"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((number - 1) % len(weights) + 1).cast("int")).cast("long")
    by = sizes.groupBy("skey").agg(F.sum("size").alias("source_size")).withColumn("w", weight)
    by = by.withColumn("most", most * F.col("source_size"))
    at = everything.orderBy(F.col("most") / F.col("w"), "skey")
    before = at.rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    by = by.select("*", F.sum("source_size").over(everything).alias("total"), F.sum("w").over(everything).alias("all_w"), F.row_number().over(at).alias("n"), F.coalesce(F.sum("most").over(before), none).alias("most_before"), F.coalesce(F.sum("w").over(before), none).alias("w_before"))
    stops = F.col("most").cast("decimal(38,0)") * (F.col("all_w") - F.col("w_before")) <= F.col("w").cast("decimal(38,0)") * (F.col("total") - F.col("most_before"))
    by = by.withColumn("last", F.coalesce(F.max(F.when(stops, F.col("n"))).over(everything), F.lit(0)))
    stopped = F.col("n") <= F.col("last")
    given = lambda c: F.coalesce(F.sum(F.when(stopped, F.col(c))).over(everything), none)
    by = by.withColumn("left", F.col("total") - given("most")).withColumn("left_w", F.col("all_w") - given("w"))
    target = F.when(stopped, F.col("most").cast("double")).otherwise((F.col("w") * F.col("left")).cast("double") / F.col("left_w"))
    by = by.withColumn("target", target).withColumn("goal", F.floor(F.col("target") + 0.5).cast("long"))
    return by.select("skey", "source_size", "target", "goal", F.ceil(F.col("source_size") / BLOCK).cast("long").alias("blocks"))


def schedule(sources: DataFrame) -> DataFrame:
    """(slot, skey, round, block, words): the slots in order of (slot, skey). A slot takes the first ``words`` words of its
    source's ``block``, when the source is gone through for the ``round``-th time (from 0)."""
    spark = sources.sparkSession
    sources = sources.where("goal > 0")
    rest = F.expr("goal % source_size")
    by = sources.select("skey", "blocks", "goal", rest.alias("rest"), (F.expr("goal div source_size") * F.col("blocks") + F.ceil(rest / BLOCK)).cast("long").alias("need"))
    # shares of [0, PERIOD), each source's as an interval of whole numbers
    everything = W.partitionBy(F.lit(0)).orderBy("skey")
    by = by.withColumn("upto", F.sum("goal").over(everything).cast("decimal(38,0)")).withColumn("total", F.sum("goal").over(W.partitionBy(F.lit(0))).cast("decimal(38,0)"))
    by = by.withColumn("low", F.expr(f"(upto - goal) * {PERIOD} div total")).withColumn("high", F.expr(f"upto * {PERIOD} div total"))
    n = -(-(sources.agg(F.sum("goal")).first()[0] or 0) // BLOCK)
    width = PERIOD // min(PERIOD, max(CELLS, 1 << (n // POINTS).bit_length()))
    cell = lambda c: F.floor(F.col(c) / width)
    begins = by.where("low < high").select("skey", "low", F.explode(F.sequence(cell("low"), F.floor((F.col("high") - 1) / width))).alias("cell"))
    begins = begins.select("cell", F.greatest("low", F.col("cell") * width).alias("u"), F.lit(-1).cast("long").alias("slot"), "skey")
    points = spark.range(n).select(F.col("id").alias("slot"), F.pmod(F.pmod("id", F.lit(PERIOD)) * GOLDEN, F.lit(PERIOD)).alias("u"))
    points = points.select(cell("u").alias("cell"), "u", "slot", F.lit(None).cast("string").alias("skey"))
    # in each cell, a point is of the source that began last
    inside = W.partitionBy("cell").orderBy("u", "slot").rowsBetween(W.unboundedPreceding, 0)
    hit = begins.unionByName(points).withColumn("skey", F.last("skey", ignorenulls=True).over(inside)).where("slot >= 0")
    hit = store(hit.select("slot", "skey", F.floor(F.col("slot") / CHUNK_ROWS).alias("chunk")), "mix-points")
    ranked = running(hit, ["skey"], "chunk", ["slot"], F.lit(1), "turn")
    got = by.join(hit.groupBy("skey").agg(F.count("*").alias("got")), "skey", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    lacking = got.where("got < need").select("skey", F.explode(F.sequence("got", F.col("need") - 1)).alias("turn"))
    lacking = lacking.select((F.col("turn") + n).alias("slot"), "skey", "turn")
    both = ranked.select("slot", "skey", "turn").unionByName(lacking).join(by.select("skey", "blocks", "rest", "need"), "skey").where("turn < need")
    words = F.when((F.col("turn") == F.col("need") - 1) & (F.col("rest") > 0), (F.col("rest") - 1) % BLOCK + 1).otherwise(BLOCK)
    return both.select("slot", "skey", F.expr("turn div blocks").alias("round"), (F.col("turn") % F.col("blocks")).alias("block"), words.alias("words"))


def mix(rows: DataFrame) -> DataFrame:
    """What the schedule takes of each row of (rid, skey, size, hash, ...), stored: adds source_size, target, taken, first_slot
    (null if nothing is taken) and plays: (slot, start, words) of each time that the row is taken, by slot.

    ``hash`` orders a source's stream, ties by rid.
    Rows without words give nothing; the words taken of a row are its first ones in its last, cut turn.
    """
    with dropping(rows.sparkSession):
        rows = store(rows, "mix-rows")
        sources = store(targets(rows), "mix-sources")
        bits = chunk_bits(rows.count())
        placed = running(rows.withColumn("__rl_c", chunk_of(F.col("hash"), bits)), ["skey"], "__rl_c", ["hash", "rid"], F.col("size"), "start")
        placed = placed.select("rid", "skey", "size", "start").where("size > 0")
        low, high = F.greatest(F.col("start") - F.col("block") * BLOCK, F.lit(0)), F.least(F.col("start") + F.col("size") - F.col("block") * BLOCK, F.lit(BLOCK))
        parts = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK))))
        parts = parts.select("rid", "skey", "block", "start", low.alias("low"), high.alias("high")).join(schedule(sources), ["skey", "block"])
        parts = parts.withColumn("words", F.least("high", "words") - F.col("low")).where("words > 0")
        own = lambda c, r: F.when(F.col("round") == r, F.col(c))
        each = [f(own(c, r)).alias(f"{c}{r}") for r in range(MOST + 1) for f, c in ((F.min, "slot"), (F.sum, "words"))]
        plays = F.array(*(F.struct(F.col(f"slot{r}").alias("slot"), F.col("start"), F.col(f"words{r}").cast("long").alias("words")) for r in range(MOST + 1)))
        found = parts.groupBy("rid").agg(F.first("start").alias("start"), *each).select("rid", F.filter(plays, lambda x: x["slot"].isNotNull()).alias("plays"))
        out = rows.join(found, "rid", "left").join(sources.select("skey", "source_size", "target"), "skey")
        taken = F.coalesce(F.aggregate("plays", F.lit(0).cast("long"), lambda a, x: a + x["words"]), F.lit(0).cast("long"))
        return store(out.withColumns({"taken": taken, "first_slot": F.get("plays", F.lit(0))["slot"]}), "mix-taken", result=True)


def sized_rows(docs: DataFrame, **carry: Column) -> DataFrame:
    """A table of rows for mix(), with the columns ``carry`` names; equal rows get different rids."""
    text = F.col("text")
    return docs.select(F.monotonically_increasing_id().alias("rid"), source_key(F.col("source")).alias("skey"), words_of(text).alias("size"), stream_order(F.col("doc_id"), text).alias("hash"), *(c.alias(n) for n, c in carry.items()))


def _first_words(batches, text: str, chars: str | None):
    """Texts cut after their first ``words`` words where that is fewer than ``size``."""
    for b in pieces(batches, column=text):
        words, size = b.column("words").to_numpy(), b.column("size").to_numpy()
        part = (words < size).nonzero()[0]
        if len(part):
            cut = Words(b.column(text).take(pa.array(part)))
            raw, ends = cut.data.tobytes(), cut.ends[cut.first[:-1] + words[part] - 1]
            texts = dict(zip(part.tolist(), (raw[o:e].decode() for o, e in zip(cut.offsets[:-1], ends, strict=True)), strict=True))
            put = lambda c, new: b.set_column(b.schema.get_field_index(c), b.schema.field(c), pa.array([new[i] if i in new else x.as_py() for i, x in enumerate(b.column(c))], b.schema.field(c).type))  # noqa: B023, E731
            b = put(text, texts)
            if chars:
                b = put(chars, {i: len(x) for i, x in texts.items()})
        yield b.drop_columns(["words", "size"])


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all columns, in the order of the schedule: a row for each time that a
    document is taken, the last with its first words only where it is taken in part (and n_chars, if there is one, to match)."""
    names = [f"__rl_{i}" for i in range(len(docs.columns))]
    at = {c: n for c, n in zip(docs.columns, names, strict=True)}
    text, chars = at["text"], at.get("n_chars")
    with dropping(docs.sparkSession):
        told = store(sized_rows(docs, **{n: F.col(f"`{c}`") for c, n in at.items()}), "mix-docs", result=True)
        plays = store(mix(told.drop(*names)).where("taken > 0").select("rid", F.explode("plays").alias("play")), "mix-plays", result=True)
    out = told.join(plays, "rid").select(*names, "size", "play.words", "play.slot", "skey", "play.start")
    out = out.repartitionByRange("slot", "skey", "start").sortWithinPartitions("slot", "skey", "start").drop("slot", "skey", "start")
    schema = ", ".join(f"{n} {told.schema[n].dataType.simpleString()}" for n in names)
    out = out.mapInArrow(lambda it: _first_words(it, text, chars), schema)
    return out.select(*(F.col(n).alias(c) for c, n in at.items()))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed to weights 5, 2, 1, ...; a null source is a source, a null text has no words. ``first_slot``: the
    slot from which the document first plays (null: not taken; slots after the last point are those that a source lacked)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(sized_rows(docs, doc_id=F.col("doc_id"))).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


SQL = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN source IS NULL THEN 'z' ELSE 's' || source END AS skey,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size,
  substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || coalesce('::' || text, ':')), 1, 15) AS h FROM documents),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS size, [5, 2, 1][(row_number() OVER (ORDER BY skey) - 1) % 3 + 1] AS w FROM w GROUP BY skey),
-- targets: sources above their limit stop there and the others share the rest, until none is above
level(n, fixed) AS (SELECT 0, CAST([] AS VARCHAR[]) UNION ALL
  SELECT n + 1, list_concat(fixed, o.keys) FROM level, LATERAL (SELECT list(skey) AS keys FROM s WHERE NOT list_contains(fixed, skey)
    AND CAST(3 * size AS HUGEINT) * (SELECT sum(w) FROM s WHERE NOT list_contains(fixed, skey)) <= CAST(w AS HUGEINT) * ((SELECT sum(size) FROM s) - (SELECT coalesce(sum(3 * size), 0) FROM s WHERE list_contains(fixed, skey)))) o
  WHERE o.keys IS NOT NULL),
stopped AS (SELECT fixed FROM level ORDER BY n DESC LIMIT 1),
t AS (SELECT skey, size, CASE WHEN list_contains(fixed, skey) THEN CAST(3 * size AS DOUBLE) ELSE CAST(w * ((SELECT sum(size) FROM s) - (SELECT coalesce(sum(3 * size), 0) FROM s WHERE list_contains(fixed, skey))) AS DOUBLE) / (SELECT sum(w) FROM s WHERE NOT list_contains(fixed, skey)) END AS target FROM s, stopped),
g AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS goal, (size + {BLOCK - 1}) // {BLOCK} AS blocks FROM t),
shares AS (SELECT *, goal // size * blocks + (goal % size + {BLOCK - 1}) // {BLOCK} AS need, goal % size AS rest, CAST(sum(goal) OVER (ORDER BY skey) AS HUGEINT) AS upto, CAST(sum(goal) OVER () AS HUGEINT) AS total FROM g WHERE goal > 0),
points AS (SELECT i AS slot, i % {PERIOD} * {GOLDEN} % {PERIOD} AS u FROM range((SELECT CAST((coalesce(sum(goal), 0) + {BLOCK - 1}) // {BLOCK} AS BIGINT) FROM g)) x(i)),
ranked AS (SELECT slot, skey, row_number() OVER (PARTITION BY skey ORDER BY slot) - 1 AS turn FROM points JOIN shares ON u >= (upto - goal) * {PERIOD} // total AND u < upto * {PERIOD} // total),
lacking AS (SELECT skey, unnest(range(coalesce(got, 0), need)) AS turn FROM shares LEFT JOIN (SELECT skey, count(*) AS got FROM ranked GROUP BY skey) USING (skey)),
slots AS (SELECT slot, skey, turn FROM ranked UNION ALL SELECT turn + (SELECT count(*) FROM points), skey, turn FROM lacking),
used AS (SELECT slot, skey, turn % blocks AS block, CASE WHEN turn = need - 1 AND rest > 0 THEN (rest - 1) % {BLOCK} + 1 ELSE {BLOCK} END AS words FROM slots JOIN shares USING (skey) WHERE turn < need),
placed AS (SELECT rid, skey, size, CAST(sum(size) OVER (PARTITION BY skey ORDER BY h, rid) AS BIGINT) - size AS start FROM w),
parts AS (SELECT rid, skey, start, size, unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) AS block FROM placed WHERE size > 0),
hits AS (SELECT rid, slot, least(start + size - block * {BLOCK}, words) - greatest(start - block * {BLOCK}, 0) AS n FROM parts JOIN used USING (skey, block)),
taken AS (SELECT rid, sum(n) AS taken, min(slot) AS first_slot FROM hits WHERE n > 0 GROUP BY rid)
SELECT doc_id, w.size, t.size AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(first_slot AS BIGINT) AS first_slot FROM w JOIN t USING (skey) LEFT JOIN taken USING (rid)
"""
