"""From a file listing to projects, infrastructure and the tree of folders and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions.extract import language_of

#: Files that mark a project (in order), a monorepo, infrastructure, CI; folders never looked into.
MARKERS = [("package.json", "nodejs"), ("pyproject.toml", "python"), ("setup.py", "python"), ("requirements.txt", "python"), ("go.mod", "go"), ("Cargo.toml", "rust"), ("pom.xml", "java"), ("build.gradle", "java"), ("build.gradle.kts", "java"), ("*.csproj", "dotnet"), ("*.sln", "dotnet"), ("*.fsproj", "dotnet")]
MONOREPO = ["nx.json", "turbo.json", "lerna.json", "pnpm-workspace.yaml", "rush.json"]
INFRA = ["Dockerfile", "docker-compose.yml", "docker-compose.yaml", "kubernetes", "k8s", "terraform", ".env.example"]
CI = {".github": "github-actions", ".gitlab-ci.yml": "gitlab-ci", "Jenkinsfile": "jenkins", ".circleci": "circleci", "azure-pipelines.yml": "azure-devops", "bitbucket-pipelines.yml": "bitbucket", ".travis.yml": "travis-ci"}
SKIP = "node_modules .git .svn __pycache__ .venv venv .idea .vscode dist build target .next .nuxt .turbo .nx".split()
LANGUAGES = {"nodejs": "typescript", "python": "python", "go": "go", "rust": "rust", "java": "java", "dotnet": "csharp"}


def list_folder(spark: SparkSession, root: str) -> DataFrame:
    """(path, size): the files under a folder, relative to it. Only the listing is read, never a file's content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    return files.select(F.regexp_replace("path", r"^(?:file:)?/*" + root.strip("/").replace(".", r"\.") + "/", "").alias("path"), "size")


def sanitize(c: Column | str) -> Column:
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[ :/\\]", "_")


def _inside(paths: DataFrame) -> DataFrame:
    """Paths without those below a skipped folder, with folder, name, top parts."""
    p = paths.select(F.regexp_replace("path", r"\\", "/").alias("path")).distinct()
    parts = F.split("path", "/")
    return p.where(~F.arrays_overlap(parts, F.array(*map(F.lit, SKIP)))).select("path", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("folder"), F.element_at(parts, -1).alias("name"), parts.alias("parts"))


def projects(paths: DataFrame, max_depth: int = 5) -> DataFrame:
    """(folder, name, project_type, marker, is_monorepo, infra, ci): one project per folder with a marker, the first in the markers' order;
    below a project that is no monorepo nothing further is one. Folders deeper than max_depth are not looked at."""
    p = _inside(paths)
    marks = [F.when(F.rlike("name", F.lit(f"^.*\\{m[1:]}$")) if m[0] == "*" else F.col("name") == m, F.struct(F.lit(i).alias("i"), F.lit(m).alias("marker"), F.lit(t).alias("type"))) for i, (m, t) in enumerate(MARKERS)]
    first = F.coalesce(*marks)
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    by = p.where(depth <= max_depth).groupBy("folder").agg(F.min(first).alias("m"), F.max(F.col("name").isin(MONOREPO)).alias("is_monorepo")).where("m is not null")
    heads = by.where("not is_monorepo").select(F.col("folder").alias("above"))
    ups = by.select("folder", F.explode(F.sequence(F.lit(0), F.greatest(F.size(F.split("folder", "/")) - 1, F.lit(0)))).alias("k")).select("folder", F.array_join(F.slice(F.split("folder", "/"), 1, F.col("k")), "/").alias("above")).where("above <> folder")
    inner = ups.join(heads, "above").select("folder").distinct()
    top = by.join(inner, "folder", "left_anti")
    things = p.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.struct(F.array_join(F.slice("parts", 1, k - 1), "/").alias("folder"), F.element_at("parts", k).alias("thing")))).alias("x")).select("x.*").where(F.col("thing").isin([*INFRA, *CI])).distinct()
    found = things.groupBy("folder").agg(F.sort_array(F.collect_set(F.when(F.col("thing").isin(INFRA), F.col("thing")))).alias("infra"), F.sort_array(F.collect_set(schema.lookup("thing", CI))).alias("ci"))
    none = F.array().cast("array<string>")
    return top.join(found, "folder", "left").select("folder", F.element_at(F.split("folder", "/"), -1).alias("name"), F.col("m.type").alias("project_type"), F.col("m.marker").alias("marker"), "is_monorepo", F.coalesce("infra", none).alias("infra"), F.coalesce("ci", none).alias("ci"))


def bridge(found: DataFrame, workspace: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a workspace: its projects and their infrastructure, all contained by the workspace."""
    w = workspace.replace(" ", "_").replace(":", "_").replace("/", "_").replace("\\", "_")
    root = f"workspace:{w}:{w}"
    spark = found.sparkSession
    cols = "id string, type string, name string, language string, tags array<string>"
    nodes = spark.createDataFrame([(root, "Workspace", workspace, None, [])], cols)
    pid = F.concat(F.lit(f"project:{w}:"), sanitize("name"))
    nodes = nodes.unionByName(found.select(pid.alias("id"), F.lit("Project").alias("type"), "name", schema.lookup("project_type", LANGUAGES).alias("language"), F.when(F.col("is_monorepo"), F.array(F.lit("monorepo"))).otherwise(F.array().cast("array<string>")).alias("tags")))
    infra = found.select("folder", F.explode("infra").alias("thing")).select(F.concat(F.lit(f"infraconfig:{w}:"), sanitize(F.concat_ws("/", F.nullif("folder", F.lit("")), "thing"))).alias("id"), F.lit("InfraConfig").alias("type"), F.col("thing").alias("name"), F.lit(None).cast("string").alias("language"), F.array().cast("array<string>").alias("tags"))
    nodes = nodes.unionByName(infra)
    edges = nodes.where(F.col("id") != root).select(F.lit(root).alias("source_id"), F.col("id").alias("target_id"), F.lit("CONTAINS").alias("type"))
    return nodes, edges


def tree_nodes(paths: DataFrame) -> DataFrame:
    """(id, type, name, path, parent_id, language): a Module for each folder and a File for each file, with its folder as parent."""
    parts = F.split("path", "/")
    every = paths.select("path").distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("path"), F.element_at(parts, k).alias("name"), (k == F.size(parts)).alias("is_file")))).alias("x")).select("x.*").distinct()
    up = F.when(F.contains("path", F.lit("/")), F.concat(F.lit("module:"), F.regexp_replace("path", "/[^/]*$", "")))
    return every.select(F.concat(F.when(F.col("is_file"), "file:").otherwise("module:"), "path").alias("id"), F.when(F.col("is_file"), "File").otherwise("Module").alias("type"), "name", "path", up.alias("parent_id"), F.when(F.col("is_file"), language_of(F.col("path"))).alias("language"))


def source_paths(paths: DataFrame) -> DataFrame:
    """Paths in a known language outside skipped folders."""
    return _inside(paths).select("path", language_of(F.col("path")).alias("language")).where("language is not null")


def parse_diff(lines: DataFrame) -> DataFrame:
    """(path, change_type, old_path) from lines (value) of a name-status listing: A added, M modified, D deleted, R renamed, C copied, which
    counts as added. Other lines are dropped."""
    f = F.split("value", "\t")
    mark = F.substring(f[0], 1, 1)
    two = mark.isin("R", "C")
    kind = F.when(mark.isin("A", "C"), "added").when(mark == "M", "modified").when(mark == "D", "deleted").when(mark == "R", "renamed")
    size_ok = F.when(two, F.size(f) >= 3).otherwise(F.size(f) >= 2)
    return lines.where(kind.isNotNull() & size_ok).select(F.when(two, F.get(f, F.lit(2))).otherwise(F.get(f, F.lit(1))).alias("path"), kind.alias("change_type"), F.when(mark == "R", F.get(f, F.lit(1))).alias("old_path"))
