"""Incremental maintenance, path resolution, normalizers and session checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.runtime import materialize

C = F.col


def invalidated(now: DataFrame, before: DataFrame, deps: DataFrame, hops: int = 2, rebuild: float = 0.5) -> DataFrame:
    """(node, reason): nodes of changed hash and what depends on them, or all past ``rebuild``.

    ``now`` and ``before`` have node and hash; ``deps`` has node and needs.
    """
    changed = now.join(before.withColumnRenamed("hash", "old"), "node", "left").where(~C("hash").eqNullSafe(C("old"))).select("node", F.lit("changed").alias("reason"))
    front, out = changed.select("node"), changed
    for _ in range(hops):
        front = deps.join(front.withColumnRenamed("node", "needs"), "needs").select("node").distinct()
        out = out.union(front.select("node", F.lit("dependent").alias("reason")))
    least = out.groupBy("node").agg(F.min("reason").alias("reason"))
    share = changed.agg(F.count("*").alias("c")).join(F.broadcast(now.agg(F.count("*").alias("n"))))  # one row each
    whole = share.where(C("c") > rebuild * C("n")).select(F.lit(1).alias("_k"))
    every = now.select("node", F.lit(1).alias("_k")).join(F.broadcast(whole), "_k", "left_semi").select("node", F.lit("rebuild").alias("reason"))
    return least.union(every).groupBy("node").agg(F.max(F.struct((C("reason") == "rebuild").alias("r"), (C("reason") == "changed").alias("c"), "reason"))["reason"].alias("reason"))


def replace_file(edges: DataFrame, path: str, fresh: DataFrame) -> DataFrame:
    """Edges with those of one file taken out and its new ones put in."""
    return edges.where(C("path") != path).unionByName(fresh)


def merge_additional(edges: DataFrame, extra: DataFrame, weight: float = 1.5) -> DataFrame:
    """Adds the edges of another index that (source, target, type) does not hold yet.

    Both parts are stored: ``edges`` is read twice, and rows of a task stay bounded.
    """
    key = ["source", "target", "edge_type"]
    edges = materialize(edges, "merge-edges")
    new = extra.dropDuplicates(key).join(edges, key, "left_anti").withColumn("weight", F.lit(weight))
    return edges.unionByName(materialize(new.select(*edges.columns), "merge-new"))


def resolve_imports(imports: DataFrame, files: DataFrame, endings: tuple[str, ...] = (".ts", ".tsx", ".js", "/index.ts", "/index.js", ".py", "/__init__.py")) -> DataFrame:
    """(path, source, target): relative imports to the first candidate file that exists."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    joined = F.concat_ws("/", folder, F.regexp_replace("source", r"^\./", ""))
    # Part by part: a parent step takes back the part before it, at any depth.
    none = F.array().cast("array<string>")
    fold = lambda kept, part: F.when((part == "..") & (F.size(kept) > 0), F.slice(kept, F.lit(1), F.size(kept) - 1)).when(part.isin(".", ".."), kept).otherwise(F.concat(kept, F.array(part)))
    up = F.array_join(F.aggregate(F.split(joined, "/"), none, fold), "/")
    tries = F.array(up, *[F.concat(up, F.lit(e)) for e in endings])
    tried = imports.where(C("source").startswith(".")).select("path", "source", F.posexplode(tries).alias("n", "target"))
    found = tried.join(files.select(C("path").alias("target")), "target", "left_semi").groupBy("path", "source").agg(F.min_by("target", "n").alias("target"))
    return imports.select("path", "source").distinct().join(found, ["path", "source"], "left").withColumn("target", F.coalesce("target", F.lit("<external>")))


def namespaced_link(link: Column, namespace: Column) -> Column:
    """``memory:x`` and ``code:x`` as they are; a bare link belongs to the page's namespace."""
    return F.when(link.rlike("^(memory|code):"), link).otherwise(F.concat(namespace, F.lit(":"), link))


def context_miss(misses: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """(file, community): the owner of a missed file and the communities next to it."""
    own = misses.join(members, "file").select("file", "community")
    near = own.join(links, C("community") == C("s")).select("file", C("t").alias("community"))
    return own.union(near).distinct()


#: What changes from run to run in a command's output, and what stands for it, in order.
SCRUBS = (
    (r"\x1b\[[0-9;]*[A-Za-z]", ""),
    (r"/tmp/[A-Za-z0-9._-]+", "/tmp/<TEMP>"),
    (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<TS>"),
    (r"\b1[5-9]\d{8}\b", "<TS>"),
    (r"\b(?:pid|PID)\s*=?\s*\d+\b", "pid=<PID>"),
    (r"\b0x[0-9a-fA-F]+\b", "<ADDR>"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    (r"\b[0-9a-f]{8,}\b", "<HASH>"),
)


def scrub(output: Column) -> Column:
    """A command's output without what changes from run to run."""
    for pattern, to in SCRUBS:
        output = F.regexp_replace(output, pattern, to)
    return output


def normalised_call(tool: Column, args: Column, output: Column) -> Column:
    """Struct (args, output) by which calls of one tool compare; ``args`` is JSON.

    Commands are scrubbed; a read keeps its path; a search its pattern, path
    and query and the set of its lines; a web call its address or query and the
    head of its answer; another tool keeps both.
    """
    field = lambda *keys: F.coalesce(*[F.get_json_object(args, f"$.{k}") for k in keys])
    some = lambda *keys: F.to_json(F.struct(*[F.get_json_object(args, f"$.{k}").alias(k) for k in keys]))
    path, command = field("file_path", "path"), field("command")
    kept = (
        F.when((tool == "bash") & command.isNotNull(), F.to_json(F.struct(scrub(command).alias("command"))))
        .when((tool == "read_file") & path.isNotNull(), F.to_json(F.struct(path.alias("file_path"))))
        .when(tool.isin("grep", "glob"), some("pattern", "path", "query"))
        .when(tool.isin("web_search", "web_fetch"), some("url", "query", "q"))
        .otherwise(args)
    )
    lines = F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(output, "\n"), lambda x: x != ""))), "\n")
    out = (
        F.when(tool == "bash", scrub(output))
        .when(tool == "read_file", "")
        .when(tool.isin("grep", "glob"), F.sha2(lines, 256))
        .when(tool.isin("web_search", "web_fetch"), F.sha2(F.substring(output, 1, 2048), 256))
        .otherwise(output)
    )
    return F.struct(kept.alias("args"), out.alias("output"))


def affected(stdout: Column, stderr: Column) -> Column:
    """Struct (files, symbols), sorted, that a build or test output names.

    Files stand behind an arrow, or in a word ``folder/name.ext:line`` of five
    languages; symbols are test paths and, as ``crate:name``, compiled crates.
    """
    lines = F.split(F.concat_ws("\n", stderr, stdout), "\r?\n")
    arrow = lambda x: F.contains(x, F.lit("-->"))
    behind = F.transform(F.filter(lines, arrow), lambda x: F.trim(F.regexp_extract(x, r"-->\s*([^:]*):", 1)))
    behind = F.filter(behind, lambda p: F.contains(p, F.lit(".")) & ~F.contains(p, F.lit(" ")))
    words = F.flatten(F.transform(F.filter(lines, lambda x: ~arrow(x)), lambda x: F.split(x, r"\s+")))
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}/.:_-]+|[^\p{L}\p{N}/.:_-]+$", ""))
    placed = F.transform(F.filter(bare, lambda w: F.contains(w, F.lit(":"))), lambda w: F.substring_index(w, ":", 1))
    placed = F.filter(placed, lambda p: p.rlike(r"\.(?:rs|py|ts|go|js)$") & p.rlike(r"[/\\]"))
    tests = F.transform(lines, lambda x: F.regexp_extract(x, r"^(?:.*?\s)?test\s+(\S+)", 1))
    tests = F.filter(tests, lambda t: F.contains(t, F.lit("::")) & ~t.startswith("-"))
    crates = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"^\s*Compiling\s+(\S+)", 1)), lambda c: c != "")
    symbols = F.concat(tests, F.transform(crates, lambda c: F.concat(F.lit("crate:"), c)))
    return F.struct(F.array_sort(F.array_distinct(F.concat(behind, placed))).alias("files"), F.array_sort(F.array_distinct(symbols)).alias("symbols"))


def error_line(output: Column, most: int = 200) -> Column:
    lines = F.filter(F.split(output, "\n"), lambda x: F.trim(x).rlike(r"^(error|Error|ERROR|panicked|FAILED|thread ')"))
    return F.substring(F.trim(F.get(lines, F.lit(0))), 1, most)


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression."""
    out = ""
    i = 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in ".+()[]{}^$|\\" else c)
            i += 1
    return f"^{out}$"


def glob(paths: DataFrame, pattern: str, most: int = 100) -> DataFrame:
    """The first ``most`` matching paths, each with the total number of matches."""
    hit = paths.where(C("path").rlike(glob_regex(pattern)))
    total = hit.agg(F.count("*").alias("total"))
    return hit.select("path").orderBy("path").limit(most).join(F.broadcast(total))  # one row


def coverage(symbols: DataFrame, tested: DataFrame) -> DataFrame:
    """(community, tested, total, percent)"""
    t = tested.select("symbol").distinct().withColumn("hit", F.lit(1))
    g = symbols.join(t, "symbol", "left").groupBy("community").agg(F.count("hit").alias("tested"), F.count("*").alias("total"))
    return g.withColumn("percent", 100.0 * C("tested") / C("total"))


def session_metrics(used: DataFrame, context: DataFrame) -> DataFrame:
    """(run_id, hit, miss, over_read): files read inside, outside, and offered in vain."""
    u, c = used.select("run_id", "file").distinct().withColumn("u", F.lit(1)), context.select("run_id", "file").distinct().withColumn("c", F.lit(1))
    j = u.join(c, ["run_id", "file"], "full_outer")
    return j.groupBy("run_id").agg(F.count_if(C("u").isNotNull() & C("c").isNotNull()).alias("hit"), F.count_if(C("c").isNull()).alias("miss"), F.count_if(C("u").isNull()).alias("over_read"))


def tree_path(entries: DataFrame, leaf: str) -> DataFrame:
    """(id, depth) from a leaf of ``entries(id, parent)`` to its root, however deep; a loop ends where it closes.

    Each round doubles the steps of all pointers, so depth d takes log2(d) rounds.
    """
    known = entries.select(C("id").alias("_known"))
    jumps = materialize(entries.select("id", C("parent").alias("to")).join(known, C("to") == C("_known"), "left_semi"), "tree")
    found = materialize(entries.where(C("id") == leaf).select("id", F.lit(0).cast("long").alias("depth")), "tree-path")
    step, n = 1, found.count()
    while n:
        up = found.join(jumps, "id").select(C("to").alias("id"), (C("depth") + step).alias("depth"))
        found = materialize(found.union(up).groupBy("id").agg(F.min("depth").alias("depth")), "tree-path")
        before, n = n, found.count()
        if n == before:
            break
        twice = jumps.select("id", C("to").alias("_m")).join(jumps.select(C("id").alias("_m"), "to"), "_m").select("id", "to")
        jumps, step = materialize(twice, "tree"), 2 * step
    return found


#: Seconds without a compile, age of a lesson that was never used, milliseconds of recall.
STALE_SECONDS, UNUSED_SECONDS, P50_MS, P95_MS = 7200, 30 * 86400, 500.0, 2000.0


def lint(state: DataFrame, lessons: DataFrame, orphan_episodes: DataFrame, broken_pages: DataFrame) -> DataFrame:
    """(metric, severity, subject) of the memory's six checks.

    ``state(seconds_since_compile, p50_ms, p95_ms)`` has one row;
    ``lessons(id, age_seconds, hits)``, ``orphan_episodes(id)`` and
    ``broken_pages(slug)`` one for each of theirs.
    """
    issue = lambda metric, severity, subject: (F.lit(metric).alias("metric"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"))
    nothing = F.lit(None)
    found = [
        state.where(C("seconds_since_compile") > STALE_SECONDS).select(*issue("wiki.staleness", "warning", nothing)),
        lessons.where((C("age_seconds") >= UNUSED_SECONDS) & (C("hits") == 0)).select(*issue("lesson.zero_hit", "concern", C("id"))),
        orphan_episodes.select(*issue("episode.orphan", "info", C("id"))),
        broken_pages.select(*issue("wiki.broken_link", "warning", C("slug"))),
        state.where(C("p50_ms") > P50_MS).select(*issue("retrieval.p50_latency", "warning", nothing)),
        state.where(C("p95_ms") > P95_MS).select(*issue("retrieval.p95_latency", "critical", nothing)),
    ]
    return reduce(DataFrame.union, found)


def empty_sections(pages: DataFrame) -> DataFrame:
    """(slug, heading) of ``pages(slug, body)``: headings that another heading, or the end, follows but for blank lines."""
    lines = pages.select("slug", F.posexplode(F.split("body", "\n")).alias("pos", "line")).where(F.trim("line") != "")
    after = F.lead("line").over(Window.partitionBy("slug").orderBy("pos"))
    return lines.withColumn("_after", after).where(C("line").rlike("^#+ ") & (C("_after").isNull() | C("_after").rlike("^#+ "))).select("slug", C("line").alias("heading"))


def orphaned_calls(messages: DataFrame) -> DataFrame:
    """Tool calls of ``messages(conv_id, call_id, is_result)`` that no result answers."""
    return messages.where(~C("is_result")).join(messages.where("is_result").select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id")


def call_flow(calls: DataFrame, start: DataFrame, most: int = 20) -> DataFrame:
    """(root, step, node): callees by breadth from each start, up to ``most`` steps."""
    seen = front = start.select(C("node").alias("root"), "node", F.lit(0).alias("level"))
    for level in range(1, most):  # a level has a step at least, so ``most`` steps need no more
        near = front.join(calls, C("node") == C("src")).select("root", C("dst").alias("node")).distinct()
        front = materialize(near.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("level", F.lit(level)), "call-flow")
        full = seen.groupBy("root").agg(F.count("*").alias("_n")).where(C("_n") >= most)
        front = front.join(full, "root", "left_anti")  # these have their steps
        if front.limit(1).count() == 0:
            break
        seen = materialize(seen.unionByName(front), "call-flow")
    step = F.row_number().over(Window.partitionBy("root").orderBy("level", "node"))
    return seen.withColumn("step", step).where(C("step") <= most).select("root", "step", "node")


def entry_points(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    return nodes.join(calls.select(C("dst").alias("node")), "node", "left_anti")
