"""From parsed files to a graph: ids, imports resolved to files, targets resolved to symbols, edges without repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.config import EXTENSIONS
from graphweave.schema import edge_id, node_id

GLOBAL_TYPES = ("CALLS", "INHERITS", "IMPORTS")


def parsed_nodes(results: DataFrame) -> DataFrame:
    """The nodes of parse results with their ids; a repeated node keeps one row."""
    rows = results.select(F.explode("nodes").alias("n")).select("n.*").where("qualified_name is not null and file_path is not null and type is not null")
    rows = rows.withColumn("id", node_id(F.col("file_path"), F.col("qualified_name"), F.col("type")))
    body = ["type", "name", "qualified_name", "file_path", "start_line", "end_line", "language", "signature", "docstring", "source_snippet"]
    return rows.groupBy("id").agg(F.min(F.struct(*body)).alias("s")).select("id", "s.*")


def parsed_edges(results: DataFrame) -> DataFrame:
    """The raw edges of parse results: ends are names, not yet symbols. Repeats are dropped."""
    rows = results.select(F.explode("edges").alias("e")).select("e.*")
    return rows.where("source_qualified is not null and target_qualified is not null").select("source_qualified", "target_qualified", "type", "file_path").distinct()


def strip_receiver(target: Column) -> Column:
    """A target without a leading 'self.' or 'cls.' (once)."""
    return F.regexp_replace(target, r"^(self|cls)\.", "")


def suffix_index(nodes: DataFrame) -> DataFrame:
    """(suffix, id, qualified_name): every dotted end of every qualified name, without the whole name itself."""
    parts = F.split("qualified_name", r"\.")
    rows = nodes.where("qualified_name is not null and contains(qualified_name, '.')").select("id", "qualified_name", F.posexplode(parts).alias("at", "part"))
    return rows.where("at > 0").select(F.expr("array_join(slice(split(qualified_name, '\\\\.'), at + 1, size(split(qualified_name, '\\\\.'))), '.')").alias("suffix"), "id", "qualified_name")


def resolve_targets(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_id, target_id, type, file_path, rung) of the raw edges that find both ends; the others are dropped.

    The ladder: 0 a symbol of the same file by qualified name; for calls, inheritance and imports
    also 1 a symbol anywhere by its whole qualified name, 2 the shortest qualified name that ends in
    a dotted target, 3 the one symbol that has the target's last part as its name. Every rung is an
    equi-join; an ambiguous name is dropped by its count before it is joined, so it never spreads.
    """
    known = nodes.where("qualified_name is not null").select("id", "name", "file_path", "qualified_name")
    local = known.groupBy("file_path", "qualified_name").agg(F.min("id").alias("id"))
    source = local.select(F.col("file_path"), F.col("qualified_name").alias("source_qualified"), F.col("id").alias("source_id"))
    edges = raw.join(source, ["file_path", "source_qualified"]).withColumn("wanted", strip_receiver(F.col("target_qualified")))
    edges = edges.withColumn("last", F.element_at(F.split("wanted", r"\."), -1)).withColumn("open", F.col("type").isin(*GLOBAL_TYPES))
    by_file = local.select("file_path", F.col("qualified_name").alias("target_qualified"), F.col("id").alias("t0"))
    by_name = known.groupBy(F.col("qualified_name").alias("wanted")).agg(F.min("id").alias("t1"))
    # only suffixes that some target asks for are kept, before the least is sought
    asked = edges.where("open and contains(wanted, '.')").select(F.col("wanted").alias("suffix")).distinct()
    by_end = suffix_index(known).join(asked, "suffix").groupBy(F.col("suffix").alias("wanted")).agg(F.min_by("id", F.struct(F.length("qualified_name"), "qualified_name", "id")).alias("t2"))
    by_last = known.groupBy(F.col("name").alias("last")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("t3")).where("n = 1").drop("n")
    found = edges.join(by_file, ["file_path", "target_qualified"], "left").join(by_name, "wanted", "left").join(by_end, "wanted", "left").join(by_last, "last", "left")
    only = lambda c: F.when(F.col("open"), F.col(c))
    rung = F.when(F.col("t0").isNotNull(), 0).when(only("t1").isNotNull(), 1).when(only("t2").isNotNull(), 2).when(only("t3").isNotNull(), 3)
    return found.select("source_id", F.coalesce(F.col("t0"), only("t1"), only("t2"), only("t3")).alias("target_id"), "type", "file_path", rung.alias("rung")).where("target_id is not null")


def graph_edges(resolved: DataFrame) -> DataFrame:
    """Edges with ids, one row per (source, target, type), and how many raw edges led to each."""
    rows = resolved.groupBy("source_id", "target_id", "type").agg(F.min("file_path").alias("file_path"), F.count(F.lit(1)).alias("attempts"))
    return rows.select(edge_id(F.col("source_id"), F.col("target_id"), F.col("type")).alias("id"), "source_id", "target_id", "type", "file_path", "attempts")


def resolve_imports(imports: DataFrame, files: DataFrame, extensions: dict[str, str] = EXTENSIONS) -> DataFrame:
    """(importer, import_path, importee) of the imports that lead to a known file.

    imports(importer, repo_path, import_path), files(path). Leading dots of a dotted path climb from
    the importer's folder, './' and '../' do the same; other paths start at the repository or at its
    src folder. Candidates carry a priority and are matched by equi-join; the first that exists wins.
    """
    folder = F.regexp_replace("importer", "/[^/]*$", "")
    raw = F.col("import_path")
    slashed = raw.startswith("./") | raw.startswith("../")
    dots = F.length(F.regexp_extract(raw, r"^(\.+)", 1))
    # how many folders up, and what is left of the path
    ups = F.when(slashed, F.size(F.split(raw, r"\.\./")) - 1).when(dots > 0, dots - 1)
    rest = F.when(slashed, F.regexp_replace(raw, r"^(\.\.?/)+", "")).otherwise(F.regexp_replace(F.regexp_replace(raw, r"^\.+", ""), r"\.", "/"))
    rows = imports.where("import_path is not null and import_path <> ''").withColumn("up", ups).withColumn("rest", rest)
    parts = F.split(folder, "/")
    base = F.when(F.col("up").isNotNull(), F.array(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - F.col("up"))), "/")))
    bases = F.coalesce(base, F.array("repo_path", F.concat(F.col("repo_path"), F.lit("/src")), folder))
    ends = F.array(*[F.lit(f".{e}") for e in extensions], *[F.lit(f"/index.{e}") for e in extensions], F.lit("/__init__.py"))
    spread = rows.select("importer", "import_path", "rest", F.posexplode(bases).alias("b", "base")).where("base is not null")
    spread = spread.select("importer", "import_path", "rest", "base", "b", F.posexplode(ends).alias("e", "ending"))
    glue = F.when(F.col("rest") == "", F.lit("")).otherwise(F.concat(F.lit("/"), F.col("rest")))
    tried = spread.select("importer", "import_path", F.concat(F.col("base"), glue, F.col("ending")).alias("path"), (F.col("b") * 100 + F.col("e")).alias("priority"))
    found = tried.join(files.select("path").distinct(), "path")
    return found.groupBy("importer", "import_path").agg(F.min_by("path", F.struct("priority", "path")).alias("importee"))


def file_deps(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(importer, importee): files that import each other's symbols, distinct, without a file's own."""
    where = nodes.select("id", "file_path")
    links = edges.where("type = 'IMPORTS'").select("source_id", "target_id")
    both = links.join(where.select(F.col("id").alias("source_id"), F.col("file_path").alias("importer")), "source_id").join(where.select(F.col("id").alias("target_id"), F.col("file_path").alias("importee")), "target_id")
    return both.where("importer <> importee").select("importer", "importee").distinct()
