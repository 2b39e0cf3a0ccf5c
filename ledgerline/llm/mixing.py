"""Mixing sources to target weights with a low-discrepancy schedule.

The mix is slots, each of which takes one block of one source.  Slot ``i`` stands at the van der Corput
point of ``i`` (its bits reversed); points are mapped through the sources' cumulative targets, so a
source's slots are spread evenly over the mix and their number is within one of its share.  A source
without a point has the slot around its share.  The words that a source gives (its target, rounded) are
dealt to its slots as equal blocks: with n slots and w words, the source's j-th slot takes the words
``j * w / n`` to ``(j + 1) * w / n`` (rounded down) of its documents in a shuffled order (by hash of the id),
starting over after the last.  So blocks are equal within one word for a source, and alike between sources but for
those of less than a few slots, whose blocks are smaller.

A document is cut into pieces, one for each block that holds some of its words, and pieces join the
schedule by source and block: what is taken of a document is the sum of its pieces, ``scheduled`` is the pieces
in their slots, and ``mix`` puts documents whole in the slot of their first piece.

Everything is DataFrame operations.  A source's running total is made in two steps, over hash
ranges and then within each, so that a source with a third of all documents is many groups.  The schedule is
broadcast if it has at most MOST_SENT rows, which is known from the number of sources; else it is joined by sorting.

Defined cases: null text has size 0 and is never taken; null source is a source of its own, the
last; a null doc_id is shuffled like any other; repeated rows count each for themselves; rows of
one doc_id are in order of size and then of a hash of the text; if no document has a word, nothing is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, row_hash

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # the mix holds 3/2 of all words
MOST = 2  # times that a source, and so a document, is taken at most
SLOT_BITS = 16
SLOTS = 1 << SLOT_BITS
#: Ranges of a source at least, and documents in a range; rows of a schedule that is broadcast (20 bytes each).
RANGE_BITS, RANGE_DOCS, MOST_SENT = 12, 1 << 14, 1 << 20


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc_id: Column) -> Column:
    """32 bits of hash by which a source's documents are shuffled."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source_key (array of no or one name), source_size, weight, target of each source.

    sizes: source_key and source_size, a row for each source.  A target is weight * level, or
    the source's limit if that is less; the level is where targets sum up to the mix.  With the
    sources in order of limit / weight, the level with the first k at their limits is
    (mix - their limits) / (weight of the others); the right k is the first whose level the next source
    can hold.
    """
    by_name = Window.orderBy(F.size("source_key").desc(), "source_key")
    rank = F.row_number().over(by_name)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(rank - 1, F.lit(len(WEIGHTS))) + 1)
    s = sizes.withColumn("rank", rank).withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * MOST)
    s = s.withColumn("ratio", F.col("most") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.withColumn("mix", F.sum("source_size").over(whole) * SHARE[0] / SHARE[1])
    left = F.col("mix") - F.coalesce(F.sum("most").over(before), F.lit(0))
    others = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level", left / others)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(whole)["level"]
    s = s.withColumn("target", F.least(F.col("most").cast("double"), F.coalesce(F.col("weight") * level, F.col("most").cast("double"))))
    return s.select("source_key", "rank", "source_size", "weight", "mix", "target")


def owned(sources: DataFrame) -> DataFrame:
    """The sources with first, end, n_slots and words: each owns the points v / SLOTS with v in [first, end)."""
    upto = F.sum("target").over(Window.orderBy("rank"))
    s = sources.withColumn("upto", upto).withColumn("share", F.when(F.col("mix") > 0, F.col("upto") / F.col("mix")).otherwise(F.lit(0.0)))
    s = s.withColumn("end", F.least(F.lit(SLOTS), F.ceil(F.round(F.col("share") * SLOTS, 6))).cast("long"))
    s = s.withColumn("first", F.coalesce(F.lag("end").over(Window.orderBy("rank")), F.lit(0)))
    return s.withColumns({"n_slots": F.greatest(F.col("end") - F.col("first"), F.lit(1)).cast("long"), "words": F.round("target").cast("long")})


def schedule(sources: DataFrame) -> DataFrame:
    """rank (of the source), block, slot: which block of which source each slot takes.  sources: as from ``owned``.

    The slot at point v is v with its bits reversed.
    """
    points = F.when(F.col("end") > F.col("first"), F.sequence("first", F.col("end") - 1)).otherwise(F.array(F.greatest(F.col("first") - 1, F.lit(0))))
    slots = sources.where("words > 0").select("rank", F.explode(points).alias("point"))
    slots = slots.select("rank", F.conv(F.reverse(F.lpad(F.bin("point"), SLOT_BITS, "0")), 2, 10).cast("long").alias("slot"))
    return slots.withColumn("block", (F.row_number().over(Window.partitionBy("rank").orderBy("slot")) - 1).cast("long"))


def measured(docs: DataFrame) -> DataFrame:
    """The documents with their size, source, and what they are shuffled by."""
    source = F.when(F.col("source").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.col("source").cast("string")))
    return docs.withColumns({"size": size_of(F.col("text").cast("string")), "_key": order_key(F.col("doc_id")), "_tie": row_hash(), "_source": source})


def placed(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Measured documents with ``start`` (words before them in their source's shuffled order), ``range`` and ``nth``
    (with rank a row's own key) and their source's figures; and the schedule."""
    bits = min(32, max(RANGE_BITS, (d.count() // RANGE_DOCS).bit_length()))
    d = d.withColumn("range", F.shiftright("_key", 32 - bits))
    totals = d.groupBy("_source", "range").agg(F.sum("size").alias("_total"))
    offset = F.sum("_total").over(Window.partitionBy("_source").orderBy("range")) - F.col("_total")
    sources = cut(owned(targets(totals.groupBy(F.col("_source").alias("source_key")).agg(F.sum("_total").alias("source_size")))))
    plan = schedule(sources)
    if SLOTS + sources.count() <= MOST_SENT:
        plan = F.broadcast(plan)
    figures = sources.select(F.col("source_key").alias("_source"), "rank", "source_size", "target", "words", "n_slots")
    ranges = totals.withColumn("_offset", offset).drop("_total").join(figures, "_source")
    within = Window.partitionBy("_source", "range").orderBy("_key", "doc_id", "size", "_tie")
    before = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    d = d.withColumn("_before", before).withColumn("nth", F.row_number().over(within)).join(ranges, ["_source", "range"])
    return d.withColumn("start", F.col("_before") + F.col("_offset")).drop("_before", "_offset", "_key", "_tie", "_source"), plan


def copies(d: DataFrame) -> DataFrame:
    """A row for each time that some of a document is taken: copy, and lo and hi, its words in its source's endless stream.

    A document of which nothing is taken has one copy, without words.
    """
    some = (F.col("size") > 0) & (F.col("start") < F.col("words"))
    d = d.withColumn("copy", F.explode(F.when(some, F.sequence(F.lit(0), F.expr("(words - 1 - start) div greatest(source_size, 1)"))).otherwise(F.array(F.lit(0)).cast("array<bigint>"))))
    d = d.withColumn("lo", F.col("start") + F.col("copy") * F.col("source_size"))
    return d.withColumn("hi", F.greatest("lo", F.least(F.col("lo") + F.col("size"), F.col("words"))))


#: The blocks that hold the words lo and hi - 1: block j starts at word j * words div n_slots.
_FIRST, _LAST = "((lo + 1) * n_slots - 1) div greatest(words, 1)", "(hi * n_slots - 1) div greatest(words, 1)"


def pieces(d: DataFrame, plan: DataFrame) -> DataFrame:
    """A row for each copy and block that holds words of it: block, slot, and a and z, its words there in the endless stream."""
    d = copies(d)
    none = F.array(F.expr("pmod(nth, n_slots)"))  # any block, so that rows without words don't meet in one
    d = d.withColumn("block", F.explode(F.when(F.col("hi") > F.col("lo"), F.sequence(F.expr(_FIRST), F.expr(_LAST))).otherwise(none)))
    d = d.withColumns({"a": F.greatest(F.col("lo"), F.expr("(block * words) div n_slots")), "z": F.least(F.col("hi"), F.expr("((block + 1) * words) div n_slots"))})
    return d.withColumn("z", F.greatest("a", "z")).join(plan, ["rank", "block"], "left")


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the slot that takes the document's first word."""
    # Written: a few numbers a document, which several steps read; texts are looked at once.
    d, plan = placed(cut(measured(docs.select("doc_id", "source", "text")).drop("text", "source")))
    p = pieces(d, plan)
    some = F.col("z") > F.col("a")
    first = F.min_by(F.when(some, F.col("slot")), F.when(some, F.struct("copy", "block")))
    taken = p.groupBy("rank", "range", "nth", "doc_id", "size", "source_size", "target").agg(F.sum(F.col("z") - F.col("a")).alias("taken"), first.alias("first_slot"))
    return taken.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def _words(text: Column, skip: Column, n: Column) -> Column:
    """n words of the text after the first ``skip``, with what stands before each."""
    found = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    return F.array_join(F.slice(found, (skip + 1).cast("int"), n.cast("int")), "")


def _in_order(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows by slot: each partition has a range of slots, which are about equally many words, and its rows in order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionById(parts, F.floor(F.col("slot") * parts / SLOTS).cast("int")).sortWithinPartitions("slot", "rank", "lo").select(*names)


def scheduled(docs: DataFrame) -> DataFrame:
    """slot, n_words and the documents' columns: a row for each slot and piece of a document, in order of slots.

    The text is the piece's; a document that fits its block is whole.  Documents may have columns of these names.
    """
    d, plan = placed(measured(docs.select("doc_id", "source", "text", F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("_row"))))
    p = pieces(d, plan).where("z > a")
    n = F.col("z") - F.col("a")
    text = F.when(n < F.col("size"), _words(F.col("text"), F.col("a") - F.col("lo"), n)).otherwise(F.col("text"))
    p = _in_order(p.withColumn("text", text).withColumn("n_words", n), ["slot", "n_words", "text", "_row"])
    return p.select("slot", "n_words", *[(F.col("text") if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself, with the documents' columns: a row for each time that a document is taken, in order of slots.

    A document stands whole in the slot of its first piece; where a source's last block ends within a document, the
    last copy of that document ends there too.
    """
    d, plan = placed(measured(docs.select("doc_id", "source", "text", F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("_row"))))
    d = copies(d).where("hi > lo").withColumn("block", F.expr(_FIRST)).join(plan, ["rank", "block"])
    n = F.col("hi") - F.col("lo")
    d = _in_order(d.withColumn("text", F.when(n < F.col("size"), _words(F.col("text"), F.lit(0), n)).otherwise(F.col("text"))), ["text", "_row"])
    return d.select(*[(F.col("text") if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


#: The same in SQL, from the definition: what is taken is the part of an endless stream that the first words cover.
ORACLE_SQL = f"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS k
  FROM documents),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank, 2 * source_size AS most FROM sized),
levels AS (
  SELECT *, most / weight AS ratio, sum(source_size) OVER () * 3 / 2 AS mix,
         (sum(source_size) OVER () * 3 / 2 - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, rank, source_size, mix,
         least(most::DOUBLE, weight * (SELECT arg_min(level, (ratio, rank)) FROM levels WHERE level <= ratio)) AS target FROM levels),
shares AS (
  SELECT *, least({SLOTS}, ceil(round(sum(target) OVER (ORDER BY rank) / mix * {SLOTS}, 6)))::BIGINT AS stop FROM goals),
owned AS (SELECT *, coalesce(lag(stop) OVER (ORDER BY rank), 0) AS first, round(target)::BIGINT AS words FROM shares),
slots AS (SELECT *, greatest(stop - first, 1) AS n FROM owned),
points AS (
  SELECT rank, list_sum([((v >> b::INT) & 1) << ({SLOT_BITS - 1} - b::INT) for b in range({SLOT_BITS})])::BIGINT AS slot
  FROM (SELECT rank, unnest(CASE WHEN stop > first THEN range(first, stop) ELSE [greatest(first - 1, 0)] END) AS v FROM slots WHERE words > 0)),
plan AS (SELECT rank, slot, row_number() OVER (PARTITION BY rank ORDER BY slot) - 1 AS block FROM points),
placed AS (
  SELECT doc_id, size, slots.*, sum(size) OVER (PARTITION BY docs.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM docs JOIN slots ON docs.source IS NOT DISTINCT FROM slots.source),
took AS (
  SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END * size
    + greatest(0, least(size, CASE WHEN source_size > 0 THEN words % source_size ELSE 0 END - start)) AS taken,
    CASE WHEN words > 0 THEN ((start + 1) * n - 1) // words END AS block FROM placed)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken, CASE WHEN taken > 0 THEN slot END::BIGINT AS first_slot
FROM took LEFT JOIN plan USING (rank, block)
"""
