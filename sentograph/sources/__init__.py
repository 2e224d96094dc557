"""Readers and writers, each with a fixed schema where the format has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentograph.operators import corpus
from sentograph.operators.graph import cut

REFERENCE = T.StructType([T.StructField(n, T.StringType()) for n in ("UniProt ID", "Gene", "Species", "Uniprot Domains", "Ref Sequence", "PDB IDs", "Uniprot Domain Architecture", "Interpro Domains", "Interpro Domain Architecture")])
#: Files of equal ids that a row of ``contained_files`` holds at a time, about; and up to how many files their names are broadcast.
PIECE, NAMES = 256, 2_000_000
MAPPING = T.StructType([T.StructField(n, T.StringType()) for n in ("Gene stable ID", "Gene name", "Gene Synonym", "UniProtKB/Swiss-Prot ID", "Version (gene)")])


def reference_files(spark: SparkSession, paths: list[str], key: str = "UniProt ID") -> DataFrame:
    """One row an entity; of several files that listed last wins. Nulls become empty strings; ids of the architecture are added if absent."""
    parts = None
    for k, path in enumerate(paths):
        one = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        if key not in one.columns:
            raise ValueError(f"{path} has no column {key!r}")
        one = one.withColumn("__file", F.lit(k))
        parts = one if parts is None else parts.unionByName(one, allowMissingColumns=True)
    rows = parts if len(paths) == 1 else corpus.latest_file_wins(parts, key, "__file")
    rows = rows.drop("__file").na.fill("")
    return corpus.with_architecture(rows, "Interpro Domains", "Interpro Domain Architecture IDs")


def reference_folder(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """All files of a folder whose names end so, with their file name."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("pathGlobFilter", f"*{suffix}").csv(folder)
    return rows.withColumn("file", F.col("_metadata.file_name")).na.fill("")


def corpus_of(reference: DataFrame, key: str = "UniProt ID", ids: str = "Interpro Domain Architecture IDs", keep_empty: bool = False) -> DataFrame:
    """(id, tokens)."""
    return reference.select(F.col(key).alias("id"), corpus.tokens(F.col(ids), keep_empty).alias("tokens"))


def differential(spark: SparkSession, path: str, key: str = "gene_id") -> DataFrame:
    """(gene_id, contrast, log2fc, stat, padj) from a wide file with log2FoldChange_, stat_ and padj_ columns for each contrast."""
    return long_contrasts(spark.read.option("header", True).option("inferSchema", True).option("nullValue", "NA").csv(path), key)


def long_contrasts(wide: DataFrame, key: str = "gene_id") -> DataFrame:
    """The same from a frame."""
    names = [c.removeprefix("log2FoldChange_") for c in wide.columns if c.startswith("log2FoldChange_")]
    col = lambda p, n: (F.col(f"`{p}_{n}`").cast("double") if f"{p}_{n}" in wide.columns else F.lit(None).cast("double"))
    each = F.array(*[F.struct(F.lit(n).alias("contrast"), col("log2FoldChange", n).alias("log2fc"), col("stat", n).alias("stat"), col("padj", n).alias("padj")) for n in names])
    return wide.select(F.col(key).alias("gene_id"), F.explode(each).alias("c")).select("gene_id", "c.*")


def delimited(spark: SparkSession, path: str, separator: str = "\t", header: bool = True) -> DataFrame:
    """TSV and the like, gzip included; without a header the columns are _c0, _c1, ..."""
    return spark.read.option("sep", separator).option("header", header).csv(path)


def merge_counts(frames: list[DataFrame], key: str) -> DataFrame:
    """Count matrices joined on their key."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, key)
    return out


def low_counts_removed(counts: DataFrame, key: str, more_than: int = 10) -> DataFrame:
    """Rows whose counts sum to more than that."""
    total = sum([F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in counts.columns if c != key], F.lit(0))
    return counts.where(total > more_than)


def gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """(set, gene) from JSON {set: {geneSymbols: [...]}}."""
    kind = "map<string, struct<geneSymbols: array<string>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("set", "v"))
    return rows.select("set", F.explode("v.geneSymbols").alias("gene"))


def write_adjacency_json(adjacency: DataFrame, path: str) -> None:
    """{row: {col: value}} a line for each row; zeros are left out."""
    rows = adjacency.where("value <> 0").groupBy("row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", F.col("value").cast("long"))))).alias("m"))
    rows.select(F.to_json(F.create_map("row", "m")).alias("value")).write.mode("overwrite").text(path)


def read_adjacency_json(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value) from one object in a file or one a line."""
    kind = "map<string, map<string, bigint>>"
    rows = spark.read.text(path).select(F.explode(F.from_json("value", kind)).alias("row", "m"))
    return rows.select("row", F.explode("m").alias("col", "value"))


def write_edges_csv(adjacency: DataFrame, path: str) -> None:
    """Edges without the diagonal."""
    adjacency.where("row <> col").write.mode("overwrite").option("header", True).csv(path)


def write_adjacency_csv(adjacency: DataFrame, removed: DataFrame, path: str, removed_path: str) -> None:
    """The edges, and beside them the n-grams that the nodes stand for, a line each without a header."""
    write_edges_csv(adjacency, path)
    removed.select("ngram").write.mode("overwrite").csv(removed_path)


def read_adjacency_csv(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value)."""
    return spark.read.option("header", True).schema("row string, col string, value long").csv(path)


def read_removed_csv(spark: SparkSession, path: str) -> DataFrame:
    """(ngram)."""
    return spark.read.schema("ngram string").csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder of any file system that the session knows is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_or_build(spark: SparkSession, path: str, read: Callable[[SparkSession, str], DataFrame], build: Callable[[], DataFrame]) -> DataFrame:
    """What is saved at the path, or else what is built; nothing is written."""
    return read(spark, path) if exists(spark, path) else build()


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Records from a JSON array, an object or an object a line."""
    reader = spark.read.option("multiLine", True)
    return (reader if schema is None else reader.schema(schema)).json(path)


def write_json(rows: DataFrame, path: str) -> None:
    """An object a line."""
    rows.write.mode("overwrite").json(path)


def write_tidy(rows: DataFrame, path: str) -> None:
    """(Comparison, variable, value)."""
    rows.select("Comparison", "variable", "value").write.mode("overwrite").option("header", True).csv(path)


def remaining(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a run that is taken up again has still to do."""
    return wanted.join(done, key, "left_anti")


def contained_files(rows: DataFrame, file: str = "file", key: str = "id") -> DataFrame:
    """(file, within): files all of whose ids another one has; of equal ones the smaller name stays. A file with a null id is within none.

    Files with equal ids are one set. A set is looked for only among those that have its rarest id, and bits of the ids' hashes rule out most of them before
    ids are compared. No candidate is shuffled or counted; contained sets alone are written, and go on to names of files in pieces.
    """
    own = rows.select(F.col(file).alias("file"), F.col(key).alias("k")).where("file is not null").distinct()
    named = cut(own.groupBy("file").agg(F.sort_array(F.collect_list("k")).alias("ks"), F.count(F.lit(1)).alias("n")))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(k), F.lit(64)).cast("int"))
    bits = F.aggregate("ks", F.lit(0).cast("long"), lambda acc, k: acc.bitwiseOR(bit(k)))
    sets = cut(named.groupBy("ks", "n").agg(F.min("file").alias("set")).withColumn("bits", bits))
    posted = sets.select("set", "n", "bits", "ks", F.explode("ks").alias("k"))
    common = posted.groupBy("k").agg(F.count(F.lit(1)).alias("common"))
    rarest = posted.where(F.size("ks") == F.col("n")).select("set", "k").join(common, "k").groupBy("set").agg(F.min_by("k", F.struct("common", "k")).alias("k"))
    asked = cut(rarest.join(sets, "set").select("set", "k", F.col("n").alias("size"), F.col("bits").alias("own"), F.col("ks").alias("mine")))
    # Holders of an id are dealt out, so that a common one is several tasks.
    parts = max(1, min(64, sets.count() // 1000))
    dealt = posted.join(asked.select("k").distinct(), "k", "left_semi").withColumnRenamed("set", "holder").withColumn("part", F.pmod(F.xxhash64("holder"), F.lit(parts).cast("long")))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    within = (F.col("n") > F.col("size")) & (F.col("own").bitwiseAND(F.bitwise_not("bits")) == 0) & (F.size(F.array_except("mine", "ks")) == 0)
    found = asked.hint("shuffle_hash").join(dealt, ["k", "part"]).where(within).select("set", "holder")
    member = named.join(sets.select("ks", "n", "set"), ["ks", "n"])
    alike = sets.where(F.size("ks") == F.col("n")).select("set", F.col("set").alias("holder"))
    return _spread(found.union(alike), cut(_pieces(member.select("set", "file"))))


def _pieces(member: DataFrame, size: int = PIECE) -> DataFrame:
    """(set, piece, files): each set's files, some at a time."""
    pieces = member.groupBy("set").agg(F.ceil(F.count(F.lit(1)) / size).alias("pieces"))
    rank = F.pmod(F.xxhash64("file"), F.col("pieces"))
    return member.join(pieces, "set").groupBy("set", rank.alias("piece")).agg(F.collect_list("file").alias("files"))


def _spread(found: DataFrame, names: DataFrame) -> DataFrame:
    """(file, within) of all files of pairs (set, holder); where these are one set, those of smaller name.

    What is dealt out are pairs of pieces, so that a pair of large sets is many tasks. Only in them do they become pairs of files, of lists that a row holds, without
    a lookup for each. Names are broadcast up to NAMES of them."""
    piece = lambda s, p, m: names.select(F.col("set").alias(s), F.col("piece").alias(p), F.size("files").cast("long").alias(m))
    units = cut(found.join(piece("set", "piece", "many"), "set").join(piece("holder", "other", "much"), "holder"))
    total = names.agg(F.sum(F.size("files"))).first()[0] or 0
    rows = units.agg(F.sum(F.col("many") * F.col("much"))).first()[0] or 0
    dealt = units.select("set", "piece", "holder", "other").repartition(max(1, min(2000, rows // 1_000_000)), "set", "piece", "holder", "other").alias("u")
    small = F.broadcast if total <= NAMES else lambda rows: rows
    both = dealt.join(small(names).alias("x"), F.expr("u.set = x.set AND u.piece = x.piece")).join(small(names).alias("y"), F.expr("u.holder = y.set AND u.other = y.piece"))
    lists = both.select(F.expr("u.set = u.holder").alias("same"), F.col("x.files").alias("files"), F.col("y.files").alias("holders"))
    pairs = lists.select("same", F.explode("files").alias("file"), "holders").select("same", "file", F.explode("holders").alias("within"))
    return pairs.where("NOT same OR within < file").select("file", "within")


def batches(rows: DataFrame, key: str, size: int = 300) -> DataFrame:
    """Adds batch numbers of about that many rows by hash, so no sort or single task is needed."""
    n = rows.count()
    return rows.withColumn("batch", F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // size))).cast("long")))


def as_corpus(spark: SparkSession, given, key: str = "UniProt ID") -> DataFrame:
    """(id, tokens) from a path, a list of paths, a reference frame, a frame that has them, or a dictionary id -> tokens or bar-joined string."""
    if isinstance(given, DataFrame):
        return given.select("id", "tokens") if {"id", "tokens"} <= set(given.columns) else corpus_of(corpus.with_architecture(given.na.fill(""), "Interpro Domains", "Interpro Domain Architecture IDs"), key)
    if isinstance(given, dict):
        rows = [(k, list(v) if not isinstance(v, str) else [t for t in [v] if t and corpus.BAR not in t] or (v.split(corpus.BAR) if v else [])) for k, v in given.items()]
        return spark.createDataFrame(rows, "id string, tokens array<string>")
    return corpus_of(reference_files(spark, [given] if isinstance(given, str) else list(given), key), key)


def as_ids(spark: SparkSession, given) -> DataFrame:
    """(id), each once, from one id, a collection of ids, or a frame, whose id or only column counts."""
    if isinstance(given, DataFrame):
        if "id" not in given.columns and len(given.columns) != 1:
            raise ValueError("the frame has no column id")
        return given.select(F.col("id" if "id" in given.columns else given.columns[0]).alias("id")).distinct()
    values = [given] if isinstance(given, (str, int)) else list(given)
    kind = "long" if values and all(isinstance(v, int) for v in values) else "string"
    return spark.createDataFrame([(v,) for v in values], f"id {kind}").distinct()
