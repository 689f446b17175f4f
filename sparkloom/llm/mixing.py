"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key ``-ln(u) / quality``; ``u`` comes from a
seeded hash, so reruns agree.  Within a source documents are taken in key
order until the source's word budget is spent.  A budget above the source's
size first takes whole epochs and samples only the rest.

Nothing is ever sorted by source alone.  Keys fall into ordered buckets, about
``sqrt(n)`` for a source of n rows; the sums of the buckets find the one in
which the budget ends, and only its rows are sorted.  The outcome is one cut
for each source, so deciding on a document needs no further shuffle.

Sources may be many (domains, say), and one may hold most rows: their table is
ordered by range, never in one task, and rows meet it on source and a salt.

Defined cases: a null or empty text counts 0 words, null is a source of its
own, rows of 0 words are never taken, an empty table gives an empty mix, a text
of any length is counted whole.  Rows that are equal in doc_id and text have
equal keys and count as copies: if a source ends among them, as many as it needs
are taken, numbered by their places in storage.  A null doc_id is a value like
others.  Further columns pass through whatever their names;
those named like an added one give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.rows import ROW, packed, passengers
from sparkloom.runtime import materialize

WORD = r"[^\x20\x09-\x0D]+"
SEED = 20240101
SALTS = 16
ADDED = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.25 to 1: grows with the share of letters among all characters."""
    letters = F.length(text) - F.length(F.regexp_replace(text, r"\p{L}+", ""))
    return F.coalesce(0.25 + 0.75 * letters / F.greatest(F.length(text), F.lit(1)), F.lit(0.25))


def sampling_key(doc_id: Column, text: Column, weight: Column, seed: int = SEED) -> Column:
    """Exponential with rate ``weight``, from the top 53 bits of a hash."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 11)
    return -F.log((bits.cast("double") + 0.5) / F.lit(2.0**53)) / weight


def measure(docs: DataFrame, seed: int = SEED, weight: Column | None = None) -> DataFrame:
    """``docs(doc_id, text, source)``, perhaps with a packed row, with size (words), _key and _tie."""
    text = F.col("text")
    weight = quality_weight(text) if weight is None else weight
    return docs.withColumns({"size": word_count(text), "_key": sampling_key(F.col("doc_id"), text, weight, seed), "_tie": F.xxhash64(F.lit(seed + 1), F.col("doc_id"), text)})


def _running(table: DataFrame, order: list[Column], label: str, **sums: Column) -> DataFrame:
    """``table`` with the sums over all rows before each in the given order.

    Ranges of the order are summed first, so what one task orders is a range,
    or the sums of the ranges: one row for each shuffle partition.
    """
    ranges = table.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranges = materialize(ranges, label)
    upto = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = ranges.groupBy("_range").agg(*[F.sum(c).alias(f"_r_{k}") for k, c in sums.items()])
    parts = parts.select("_range", *[F.coalesce(F.sum(f"_r_{k}").over(upto.orderBy("_range")), F.lit(0)).alias(f"_r_{k}") for k in sums])
    inside = upto.partitionBy("_range").orderBy(*order)
    within = ranges.withColumns({k: F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()})
    joined = within.join(F.broadcast(parts), "_range")  # a row for each shuffle partition
    return joined.withColumns({k: F.col(k) + F.col(f"_r_{k}") for k in sums}).drop("_range", *[f"_r_{k}" for k in sums])


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), ratio: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, n, source_size, target) from (source, n, source_size).

    Shares go by weight; a share above ``most`` times the size stops there and
    the excess goes to the others.  In the order of cap / weight the level of
    the first source that stays below its cap is the level of all the rest.
    """
    numbered = _running(sizes, [F.col("source").asc_nulls_last()], "mix-sources", _i=F.lit(1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    numbered = numbered.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_at", F.col("_cap") / F.col("_w"))
    ordered = materialize(_running(numbered, [F.col("_at"), F.col("_i")], "mix-caps", _caps=F.col("_cap"), _ws=F.col("_w")), "mix-levels")
    totals = ordered.agg(F.sum("source_size").alias("_all"), F.sum("_w").alias("_allw"))
    levels = ordered.join(F.broadcast(totals)).withColumn("_level", (F.col("_all") * F.lit(float(ratio)) - F.col("_caps")) / (F.col("_allw") - F.col("_ws")))  # one row
    free = F.when(F.col("_level") * F.col("_w") < F.col("_cap"), F.struct("_at", "_i", "_level"))
    first = levels.agg(F.min(free)["_level"].alias("_free"))
    target = F.coalesce(F.least(F.col("_cap"), F.col("_w") * F.col("_free")), F.col("_cap"))
    return ordered.join(F.broadcast(first)).select("source", "n", "source_size", target.alias("target"))  # one row


def _bucket(key: Column, n_buckets: Column) -> Column:
    return F.least(F.floor((1 - F.exp(-key)) * n_buckets), n_buckets - 1)


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def _by_source(rows: DataFrame, sources: DataFrame, *wanted: str) -> DataFrame:
    """``rows`` with the struct ``_s`` of their source's ``wanted`` columns.

    If the sources are too many to be sent to all tasks, the rows of a large
    one are dealt to ``SALTS`` tasks.
    """
    spread = sources.select(F.col("source").alias("_of"), F.struct(*wanted).alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    on = rows["source"].eqNullSafe(spread["_of"]) & (F.pmod(F.col("_tie"), F.lit(SALTS)) == F.col("_salt"))
    return rows.join(spread, on).drop("_of", "_salt")


def source_cuts(narrow: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), ratio: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row for each source: its target, whole epochs, and where the sample ends.

    ``narrow`` has source, size, _key and _tie and is read three times: give
    it from storage.
    """
    sizes = narrow.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    goals = source_targets(sizes, weights, ratio, most)
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    goals = goals.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("buckets", F.ceil(F.sqrt("n")))
    goals = materialize(goals, "mix-goals")

    keyed = _by_source(narrow, goals, "buckets").select("source", "size", "_key", "_tie", _bucket(F.col("_key"), F.col("_s.buckets")).alias("bucket"))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    ends = sums.join(goals.select("source", "rest"), _same(sums, goals)).where(F.col("before") + F.col("words") > F.col("rest"))
    ends = ends.groupBy(sums["source"]).agg(F.min(F.struct("bucket", "before")).alias("_end"))
    plan = goals.join(ends, _same(goals, ends), "left").select(
        goals["*"], F.coalesce(F.col("_end.bucket"), F.col("buckets")).alias("end_bucket"), F.coalesce(F.col("_end.before"), F.lit(0)).alias("end_before")
    )
    plan = materialize(plan, "mix-plan")

    at_end = _by_source(keyed, plan, "end_bucket", "end_before", "rest").where(F.col("bucket") == F.col("_s.end_bucket"))
    at_end = at_end.groupBy("source", "_key", "_tie", "size", "_s").agg(F.count("*").alias("copies"))
    ahead = Window.partitionBy("source").orderBy("_key", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_s.rest") - F.col("_s.end_before") - F.coalesce(F.sum(F.col("size") * F.col("copies")).over(ahead), F.lit(0))
    # A copy is taken if its middle lies before the end.
    fit = F.when(F.col("size") == 0, F.when(left >= 0, F.col("copies")).otherwise(0)).otherwise(F.floor(left / F.col("size") + 0.5))
    cut = at_end.withColumn("fit", F.least(fit, "copies")).where("fit > 0").groupBy("source").agg(F.max(F.struct("_key", "_tie", "fit", "copies")).alias("cut"))
    return materialize(plan.join(cut, _same(plan, cut), "left").select(plan["*"], "cut"), "mix-cuts")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with their number among those of a source, ``_no`` from 1.

    Rows are stored with their places; a task numbers those of one part of the
    storage, and the parts before add theirs.
    """
    placed = materialize(rows.withColumn("_at", F.monotonically_increasing_id()), "mix-copies")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy("source", "_part").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("_of"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    inside = placed.withColumn("_no", F.row_number().over(Window.partitionBy("source", "_part").orderBy("_at")))
    joined = inside.join(parts, inside["source"].eqNullSafe(parts["_of"]) & (inside["_part"] == parts["_p"]))
    return joined.withColumn("_no", F.col("_no") + F.col("_before")).drop("_at", "_part", "_of", "_p", "_before")


def apply_cuts(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """``measured`` with source_size, target and taken; a decision on each row by itself.

    Only copies among which a source ends are numbered first.
    """
    joined = _by_source(measured, cuts, "source_size", "target", "epochs", "buckets", "end_bucket", "cut")
    s = F.col("_s")
    bucket, at = _bucket(F.col("_key"), s["buckets"]), F.struct("_key", "_tie")
    end = F.struct(s["cut"]["_key"].alias("_key"), s["cut"]["_tie"].alias("_tie"))
    in_end = (bucket == s["end_bucket"]) & s["cut"].isNotNull()
    among = F.coalesce(in_end & (at == end) & (s["cut"]["fit"] < s["cut"]["copies"]), F.lit(False))
    sampled = (bucket < s["end_bucket"]) | F.coalesce(in_end & (at <= end), F.lit(False))

    def decided(rows: DataFrame, sampled: Column) -> DataFrame:
        taken = F.col("size") * (s["epochs"] + sampled.cast("long"))
        return rows.select(*[c for c in measured.columns if c not in ("_key", "_tie")], s["source_size"].alias("source_size"), s["target"].alias("target"), taken.alias("taken"))

    if not cuts.where("cut.fit < cut.copies").limit(1).count():
        return decided(joined, sampled)
    copies = _numbered(joined.where(among))
    return decided(joined.where(~among), sampled).union(decided(copies, F.col("_no") <= s["cut"]["fit"]))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), ratio: float = 1.5, most: float = 2.0, seed: int = SEED, quality: Column | None = None) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` with size, source_size, target and taken.

    ``quality`` may use doc_id, text and source.
    """
    measured = measure(packed(docs, "doc_id", "text", "source"), seed, quality)
    narrow = materialize(measured.select("source", "size", "_key", "_tie"), "mix-narrow")
    mixed = apply_cuts(measured, source_cuts(narrow, weights, ratio, most))
    return mixed.select(*passengers(mixed, ADDED), *ADDED)


def repeat_taken(mixed: DataFrame) -> DataFrame:
    """One row for each time the mix takes a document; the added columns go."""
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rows = packed(mixed, "size", "taken").where(F.col("taken") > 0)
    again = rows.select(ROW, F.explode(F.array_repeat(F.lit(1), times)))
    return again.select(*passengers(again, ADDED))
