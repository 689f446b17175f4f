"""Budget packing as a fold over sorted rows, and the context assemblies on top of it.

Spark deals rows by group and sorts them; a task walks through each group and
holds a few numbers, so a group may have any number of rows.  Rows leave as
they came, with ``used``, the tokens taken up to and with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkloom.functions import text as tx
from sparkloom.operators import budgets
from sparkloom.runtime import ship

C = F.col


@dataclass(frozen=True)
class Rules:
    """``stop``: a section ends at its first row that does not fit, else such rows are left out.

    ``most``: rows kept of a group.  ``carry``: what a section leaves of its
    allowance goes to the ones after it.
    """

    stop: bool = False
    most: int | None = None
    carry: bool = True


def fold(items: DataFrame, by: list[str], order: list[Column], budget: int | Column, rules: Rules = Rules(), section: str | None = None, allowance: Column | None = None, forced: Column | None = None) -> DataFrame:
    """The rows of ``items(tokens, ...)`` that fit, with ``used``.

    Within a group the sections go by ``section``, and rows within a section by
    ``order``.  ``allowance`` is the section's share of the budget (null: what
    is left); a row with ``forced`` ignores it, but not the budget.  Null tokens
    count as 0; without a section, a group is one.
    """
    ship(items.sparkSession)
    long = lambda c: (F.lit(c) if isinstance(c, int) else c).cast("long")
    place = F.lit(0) if section is None else C(section)
    told = items.withColumns({
        "_group": F.struct(*by),
        "_section": place.cast("long"),
        "_tokens": F.coalesce(C("tokens").cast("long"), F.lit(0)),
        "_budget": long(budget),
        "_share": long(allowance) if allowance is not None else F.lit(None).cast("long"),
        "_forced": F.coalesce(forced, F.lit(False)) if forced is not None else F.lit(False),
    })
    # Groups are told apart by all their values, as text: equal rows of Arrow structs are slow to compare.
    told = told.withColumn("_group", F.to_json("_group", {"ignoreNullFields": "false"}))
    columns = items.columns

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = part = None
        used = spent = kept = left = 0  # tokens of the group and of its section, kept rows, what earlier sections left
        share, over = None, False
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()  # noqa: B023, E731
            take, totals = [], []
            for i, (g, s, tokens, most, allowed, must) in enumerate(zip(*map(get, ("_group", "_section", "_tokens", "_budget", "_share", "_forced")), strict=True)):
                if g != group:
                    group, part, used, kept, left, share = g, s, 0, 0, 0, None
                    spent, over, share = 0, False, allowed
                elif s != part:
                    left = left + max(0, share - spent) if rules.carry and share is not None else left
                    part, spent, over, share = s, 0, False, allowed
                if over or (rules.most is not None and kept >= rules.most):
                    continue
                room = must or share is None or spent + tokens <= share + left
                if room and used + tokens <= most:
                    used, spent, kept = used + tokens, spent + tokens, kept + 1
                    take.append(i)
                    totals.append(used)
                elif rules.stop:
                    over = True
            picked = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(picked.column(picked.schema.get_field_index(c)) for c in columns), pa.array(totals, pa.int64())], names=[*columns, "used"])

    sort = [C("_section"), *order]
    schema = T.StructType([*items.schema.fields, T.StructField("used", T.LongType())])
    return told.repartition("_group").sortWithinPartitions("_group", *sort).mapInArrow(walk, schema)


def assemble_communities(scored: DataFrame, budget: int | Column, least_size: int = 2) -> tuple[DataFrame, DataFrame]:
    """(kept, hints) of ``scored(query_id, community, size, tokens, score)``.

    Communities of ``least_size`` nodes or more, best score first, those that do
    not fit left out and named as hints in the same order; ties to the smaller name.
    """
    big = scored.where(C("size") >= least_size).withColumn("tokens", F.greatest(C("tokens"), F.lit(1)).cast("long"))
    kept = fold(big, ["query_id"], [F.desc("score"), F.asc("community")], budget)
    hints = big.join(kept.select("query_id", "community"), ["query_id", "community"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "community"))
    return kept, hints.select("query_id", "community", place.alias("place"))


def assemble_files(scores: DataFrame, calls: DataFrame, contents: DataFrame, budget: int | Column, most: int = 20) -> DataFrame:
    """(query_id, path, score, tokens, used): the files of ``scores(query_id, path, score)`` with their content.

    Tests and hubs weigh less, callers of the best files more; the first file
    that does not fit ends the list, as does the ``most``-th.
    ``contents(path, text)`` has what is shown of a file.
    """
    weighed = scores.withColumn("score", C("score") * budgets.assembly_penalty(C("path")))
    risen = budgets.reverse_boost(weighed, calls)
    sized = contents.select("path", F.greatest(tx.estimate_tokens(C("text")), F.lit(1)).cast("long").alias("tokens"))
    return fold(risen.join(sized, "path").select("query_id", "path", "score", "tokens"), ["query_id"], [F.desc("score"), F.asc("path")], budget, Rules(stop=True, most=most))


#: The sections of a task's context in order; all before the blocks are one row each.
SECTIONS = ("objective", "step", "hypothesis", "constraints", "events", "hot_files", "block")


def section_text(task: DataFrame) -> DataFrame:
    """(task_id, section, priority, text) of ``task(task_id, objective, step, hypothesis, constraints, events, hot_files)``.

    Absent sections have no row; of the events (oldest first) the eight newest are told, newest first.
    """
    lines = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    newest = F.slice(F.reverse("events"), 1, 8)
    told = {
        "Task Objective": C("objective"), "Current Step": C("step"), "Active Hypothesis": C("hypothesis"),
        "Constraints": F.when(F.size("constraints") > 0, lines(C("constraints"))),
        "Recent Events": F.when(F.size("events") > 0, lines(newest)), "Hot Files": F.when(F.size("hot_files") > 0, lines(C("hot_files"))),
    }
    rows = F.array(*[F.struct(F.lit(i).alias("section"), F.lit(None).cast("double").alias("priority"), F.concat(F.lit(f"## {name}\n"), text).alias("text")) for i, (name, text) in enumerate(told.items())])
    return task.select("task_id", F.inline(rows)).where("text is not null")


def assemble_context(task: DataFrame, blocks: DataFrame, budget: int | Column) -> DataFrame:
    """(task_id, section, text, priority, tokens, used): a task's sections, then the blocks that fit by priority.

    ``blocks(task_id, text, score, feedback, assembled, positive)``; a section
    that does not fit is left out, the later ones are still tried.
    """
    fixed = section_text(task)
    priority = budgets.block_priority(C("score"), C("feedback"), C("assembled"), C("positive"))
    shown = blocks.select("task_id", F.lit(len(SECTIONS) - 1).alias("section"), priority.alias("priority"), "text")
    items = fixed.union(shown).withColumn("tokens", tx.estimate_tokens(C("text")))
    return fold(items, ["task_id"], [F.desc("priority"), F.asc("text")], budget, section="section")
