"""Sources: git logs, wiki pages, episodes, source trees, stream lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators import trajectory

C = F.col
LANGUAGES = {"rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "java": "java", "kt": "kotlin", "cs": "csharp", "php": "php", "rb": "ruby", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "swift": "swift", "scala": "scala", "sh": "bash"}
EXCLUDED = ("node_modules", "target", ".git", "dist", "build", "__pycache__", ".venv", "vendor")


def language(path: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return names[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))]


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, language) below ``root``, without build and vendor folders."""
    files = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.input_file_name().alias("path"), C("value").alias("text"))
    return files.where(~C("path").rlike("/(" + "|".join(e.replace(".", r"\.") for e in EXCLUDED) + ")/")).withColumn("language", language(C("path"))).where("language is not null")


def git_commits(lines: DataFrame) -> DataFrame:
    """(commit, ts, pos, file) from ``lines(line_no, line)``: ``COMMIT:<hash> <seconds>``, then file names."""
    head = C("line").startswith("COMMIT:")
    upto = Window.partitionBy("log").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    log = lines if "log" in lines.columns else lines.withColumn("log", F.lit(0))
    n = log.withColumn("_n", F.sum(head.cast("int")).over(upto))
    heads = n.where(head).select("log", "_n", F.regexp_extract("line", r"^COMMIT:(\S+)", 1).alias("commit"), F.regexp_extract("line", r"\s(\d+)$", 1).cast("long").alias("ts"))
    files = n.where(~head & (F.trim("line") != "")).withColumn("pos", F.row_number().over(Window.partitionBy("log", "_n").orderBy("line_no")) - 1)
    return files.join(heads, ["log", "_n"]).select("commit", "ts", "pos", F.trim("line").alias("file"))


def newest_messages(messages: DataFrame, most: int = 5) -> DataFrame:
    """(file, messages): up to ``most`` newest messages of each file."""
    newest = Window.partitionBy("file").orderBy(F.desc("ts"), "message")
    top = messages.withColumn("_n", F.row_number().over(newest)).where(C("_n") <= most)
    return top.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "message"))), lambda x: x["message"]).alias("messages"))


def frontmatter(pages: DataFrame) -> DataFrame:
    """``pages(slug, content)`` with title, tier, graph_hash and body of their YAML head."""
    head = F.regexp_extract("content", r"(?s)\A---\n(.*?)\n---\n", 1)
    field = lambda k: F.nullif(F.trim(F.regexp_extract("_h", rf"(?m)^{k}:\s*(.*)$", 1)), F.lit(""))
    out = pages.withColumn("_h", head).withColumn("body", F.regexp_replace("content", r"(?s)\A---\n.*?\n---\n", ""))
    return out.select(*pages.columns, "body", *[field(k).alias(k) for k in ("title", "tier", "graph_hash")])


def trajectories(spark: SparkSession, path: str) -> DataFrame:
    return trajectory.read_envelopes(spark.read.text(path))


def episodes(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema("run_id string, objective string, outcome string, files array<string>, created_at long, kind string").json(list(paths))


def stream_deltas(lines: DataFrame) -> DataFrame:
    """(id, text): the deltas of ``lines(id, line_no, line)`` of a server-sent stream, joined in order."""
    data = lines.where(C("line").startswith("data: ") & (C("line") != "data: [DONE]"))
    delta = F.get_json_object(F.substring("line", 7, 1 << 30), "$.choices[0].delta.content")
    return data.select("id", "line_no", delta.alias("d")).where("d is not null").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "d"))), lambda x: x["d"]), "").alias("text"))


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def changed_sources(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, state) of ``now(path, text)`` against ``manifest(path, sha)``: new, changed or gone."""
    n = now.select("path", F.sha2("text", 256).alias("_sha"))
    j = n.join(manifest, "path", "full_outer")
    state = F.when(C("sha").isNull(), "new").when(C("_sha").isNull(), "gone").when(C("sha") != C("_sha"), "changed")
    return j.select("path", state.alias("state")).where("state is not null")
