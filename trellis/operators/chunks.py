"""Graph and markdown documents as index chunks.

Documents are assembled with ``concat_ws('\\n', ...)`` so optional lines
(null) drop out; lists are built from ``array_sort(collect_list(struct(ord,
text)))`` so their order never depends on shuffle order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import as_passage
from ..session import by_shuffle, cut_lineage, drop_cut
from .graph_ops import find_jobs, source_datasets
from .lineage_graph import LineageGraph, run_stats

# Fixed values the chunks must reproduce.
MIN_SECTION_CHARS = 60
SECTION_MARK = "\n## "
CHUNK_COLUMNS = ("id", "kind", "name", "namespace", "source", "document")

# Line labels of the chunk documents, as the reference writes them.
L_DATASET = "Dataset: "
L_NAMESPACE = "Namespace: "
L_FORMAT = "Format: "
L_SCHEMA = "Schema: "
L_PRODUCED = "Produced by jobs: "
L_CONSUMED = "Consumed by jobs: "
L_COLUMN_LINEAGE = "Column lineage:\n"
L_JOB = "Job (ETL pipeline): "
L_READS = "Reads from (inputs): "
L_WRITES = "Writes to (outputs): "
L_EXECUTIONS = "Executions: "
L_SUCCESSFUL = " successful, "
L_FAILED = " failed"
L_LAST_EVENT = "Last event: "
L_AT = " at "
L_CODE = "Glue source code:\n"
L_NONE = "none"
L_IMPACT = "Impact chain for dataset: "
L_CHAIN_JOB = "  -> job '"
L_CHAIN_DATASET = "' -> dataset '"
L_AFFECTED = "' changes schema or is deleted, the following are affected:"


#: The characters of Unicode's White_Space property, as ``(?U)\\s`` has them.
WHITESPACE = ("\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b)))
              + "\u2028\u2029\u202f\u205f\u3000")


def _strip(c: Column) -> Column:
    """Python ``str.strip()``: leading/trailing Unicode whitespace (read from the
    ends of the text only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def _ordered_join(items: Column, sep: str) -> Column:
    """Join ``items`` (array of struct(ord..., text)) by ``ord``."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["text"]), sep)


def lineage_lines(g: LineageGraph, with_transform: bool = True) -> DataFrame:
    """Per dataset: ``out_field ← table.field [type/subtype], ...`` lines in
    first-mention order (``key, lines: array<string>``)."""
    src = F.concat("src_table", F.lit("."), "src_field")
    if with_transform:
        src = F.concat(src, F.lit(" ["), "type", F.lit("/"), "subtype", F.lit("]"))
    per_field = (g.column_lineage
                 .withColumn("src_text", F.when(F.col("src_table").isNotNull(), src))
                 .groupBy("dataset_key", "out_field")
                 .agg(F.min("field_ord").alias("fo"),
                      F.collect_list(F.when(F.col("src_text").isNotNull(),
                                            F.struct(F.col("src_ord").alias("o"),
                                                     F.col("src_text").alias("text"))))
                      .alias("srcs"))
                 .select("dataset_key", "fo",
                         F.concat(F.lit("  "), F.col("out_field"), F.lit(" ← "),
                                  _ordered_join(F.col("srcs"), ", ")).alias("line")))
    return per_field.groupBy(F.col("dataset_key").alias("key")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("fo", F.col("line").alias("text")))),
                    lambda x: x["text"]).alias("lines"))


def dataset_chunks(g: LineageGraph) -> DataFrame:
    """One document per dataset."""
    pc = by_shuffle(find_jobs(g))
    ll = by_shuffle(lineage_lines(g))
    d = g.datasets.join(pc.select("key", "producers", "consumers"), "key", "left") \
        .join(ll, "key", "left")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit(L_DATASET), F.col("name")),
        F.concat(F.lit(L_NAMESPACE), F.col("namespace")),
        F.concat(F.lit(L_FORMAT), F.col("format")),
        F.when(F.size("schema") > 0, F.concat(F.lit(L_SCHEMA), F.array_join("schema", ", "))),
        F.when(F.size("producers") > 0,
               F.concat(F.lit(L_PRODUCED), F.array_join("producers", ", "))),
        F.when(F.size("consumers") > 0,
               F.concat(F.lit(L_CONSUMED), F.array_join("consumers", ", "))),
        F.when(F.size(F.coalesce("lines", F.array())) > 0,
               F.concat(F.lit(L_COLUMN_LINEAGE), F.array_join("lines", "\n"))))
    return d.select(F.col("key").alias("id"), F.lit("dataset").alias("kind"), "name",
                    "namespace", F.lit(None).cast("string").alias("source"),
                    text.alias("text"))


def job_chunks(g: LineageGraph, job_code: DataFrame | None = None) -> DataFrame:
    """One document per job (code appended when known:
    ``job_code(job_key, code)``)."""
    names = by_shuffle(g.datasets.select(F.col("key").alias("ds_key"),
                                         F.col("name").alias("ds_name")))
    ins = (g.edges.filter(F.col("relation") == "feeds")
           .select(F.col("dst").alias("key"), F.col("src").alias("ds_key"))
           .join(names, "ds_key").groupBy("key")
           .agg(F.array_sort(F.collect_list("ds_name")).alias("inputs")))
    outs = (g.edges.filter(F.col("relation") == "produces")
            .select(F.col("src").alias("key"), F.col("dst").alias("ds_key"))
            .join(names, "ds_key").groupBy("key")
            .agg(F.array_sort(F.collect_list("ds_name")).alias("outputs")))
    rs = run_stats(g.runs).withColumnRenamed("job_key", "key")
    j = (g.jobs.join(by_shuffle(ins), "key", "left").join(by_shuffle(outs), "key", "left")
         .join(by_shuffle(rs), "key", "left"))
    if job_code is not None:
        j = j.join(by_shuffle(job_code.select(F.col("job_key").alias("key"), "code")), "key", "left")
    else:
        j = j.withColumn("code", F.lit(None).cast("string"))

    def listing(c):
        return F.when(F.size(F.coalesce(c, F.array())) > 0, F.array_join(c, ", ")) \
            .otherwise(F.lit(L_NONE))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit(L_JOB), F.col("name")),
        F.concat(F.lit(L_NAMESPACE), F.col("namespace")),
        F.concat(F.lit(L_READS), listing(F.col("inputs"))),
        F.concat(F.lit(L_WRITES), listing(F.col("outputs"))),
        F.concat(F.lit(L_EXECUTIONS), F.coalesce("n_complete", F.lit(0)).cast("string"),
                 F.lit(L_SUCCESSFUL), F.coalesce("n_fail", F.lit(0)).cast("string"),
                 F.lit(L_FAILED)),
        F.when(F.col("last").isNotNull(),
               F.concat(F.lit(L_LAST_EVENT), F.col("last.event_type"), F.lit(L_AT),
                        F.col("last.event_time"))),
        F.when(F.coalesce(F.col("code"), F.lit("")) != "",
               F.concat(F.lit(L_CODE), F.col("code"))))
    return j.select(F.col("key").alias("id"), F.lit("job").alias("kind"), "name", "namespace",
                    F.lit(None).cast("string").alias("source"), text.alias("text"))


def impact_chunks(g: LineageGraph) -> DataFrame:
    """One-hop impact chain document per source dataset with chains."""
    jobs = g.jobs.select(F.col("key").alias("job_key"), F.col("name").alias("job_name"))
    outs = g.datasets.select(F.col("key").alias("out_key"), F.col("name").alias("out_name"))
    f = g.edges.filter(F.col("relation") == "feeds").select(
        F.col("src").alias("key"), F.col("dst").alias("job_key"))
    p = g.edges.filter(F.col("relation") == "produces").select(
        F.col("src").alias("job_key"), F.col("dst").alias("out_key"))
    src = by_shuffle(source_datasets(g).select("key", "name"))
    chains = (f.join(src.select("key"), "key", "left_semi").join(by_shuffle(p), "job_key")
              .join(by_shuffle(jobs), "job_key").join(by_shuffle(outs), "out_key")
              .select("key", F.concat(F.lit(L_CHAIN_JOB), F.col("job_name"),
                                      F.lit(L_CHAIN_DATASET), F.col("out_name"), F.lit("'"))
                      .alias("line")))
    per = chains.groupBy("key").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    d = src.join(by_shuffle(per), "key")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit(L_IMPACT), F.col("name")),
        F.concat(F.lit("If '"), F.col("name"),
                 F.lit(L_AFFECTED)),
        F.array_join("lines", "\n"))
    return d.select(F.concat(F.lit("impact::"), F.col("key")).alias("id"),
                    F.lit("impact_chain").alias("kind"), "name", F.lit("").alias("namespace"),
                    F.lit(None).cast("string").alias("source"), text.alias("text"))


def split_sections(md: DataFrame, path_col: str = "path",
                   content_col: str = "content") -> DataFrame:
    """Markdown split at ``\\n## ``; section 0 keeps its text and is
    titled by the file name, later ones become ``## title\\n\\nbody``;
    sections shorter than 60 characters are dropped.  Returns
    ``(source, idx, name, text)``."""
    parts = md.select(F.col(path_col).alias("source"),
                      F.posexplode(F.split(F.col(content_col), r"\n## ", -1))
                      .alias("idx", "section"))
    first_line = F.substring_index("section", "\n", 1)
    first_end = F.instr("section", "\n")         # 0: the section is one line
    body = F.when(first_end > 0, _strip(F.col("section").substr(
        first_end + 1, F.length("section")))).otherwise(F.lit(""))
    title = F.when(F.col("idx") == 0, F.col("source")).otherwise(_strip(first_line))
    text = F.when(F.col("idx") == 0, _strip(F.col("section"))).otherwise(
        F.concat(F.lit("## "), _strip(first_line), F.lit("\n\n"), body))
    out = parts.select("source", F.col("idx").cast("bigint").alias("idx"), title.alias("name"),
                       text.alias("text"))
    return out.filter(F.length("text") >= MIN_SECTION_CHARS)


def global_ordinal(df: DataFrame, order: list[str], out: str = "ordinal",
                   ranges: int | None = None) -> DataFrame:
    """0-based position of each row in ``order`` over the whole frame,
    without a single-task window.

    Rows are range-partitioned on ``order`` and checkpointed (so the
    partition a row lands in is fixed under recomputation); each partition
    numbers its rows, and the per-partition totals -- one row per
    partition, a proven small bound -- give the offsets.
    """
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = cut_lineage(df, "ordinal_rows")   # range bounds are sampled from it, then it is read
    part = cut_lineage(src.repartitionByRange(n, *order)
                       .withColumn("_pid", F.spark_partition_id()), "ordinal")
    drop_cut(src)
    w = Window.partitionBy("_pid").orderBy(*order)
    local = part.withColumn("_local", F.row_number().over(w) - 1)
    totals = part.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = totals.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)))
    return (local.join(F.broadcast(offsets.select("_pid", "_off")), "_pid")
            .withColumn(out, (F.col("_off") + F.col("_local")).cast("bigint"))
            .drop("_pid", "_local", "_off"))


def knowledge_chunks(md: DataFrame) -> DataFrame:
    """Section chunks of markdown files ``(path, content)``; ids number
    sections over the whole load in (file name, section) order.  Sections are
    numbered by their file and place alone and meet their texts once."""
    secs = split_sections(md)
    same = Window.partitionBy("source", "idx")      # sections of files of one name
    numbers = (global_ordinal(secs.select("source", "idx"), ["source", "idx"])
               .withColumn("copy", F.row_number().over(same.orderBy("ordinal")))
               .select(F.col("source").alias("_source"), F.col("idx").alias("_idx"),
                       F.col("copy").alias("_copy"), "ordinal"))
    numbered = (secs.withColumn("copy", F.row_number().over(same.orderBy("text")))
                .join(by_shuffle(numbers), F.col("source").eqNullSafe(F.col("_source"))
                      & (F.col("idx") == F.col("_idx")) & (F.col("copy") == F.col("_copy"))))
    return numbered.select(
        F.concat(F.lit("knowledge::"), F.col("source"), F.lit("::"),
                 F.col("ordinal").cast("string")).alias("id"),
        F.lit("knowledge").alias("kind"), "name", F.lit("").alias("namespace"), "source",
        F.col("text").alias("document"))


def build_chunks(g: LineageGraph, job_code: DataFrame | None = None,
                 markdown: DataFrame | None = None) -> DataFrame:
    """Node chunks and impact chunks (stored with the passage
    prefix) plus knowledge chunks (stored as written)."""
    nodes = dataset_chunks(g).unionByName(job_chunks(g, job_code)).unionByName(
        impact_chunks(g))
    nodes = nodes.select("id", "kind", "name", "namespace", "source",
                         as_passage(F.col("text")).alias("document"))
    if markdown is not None:
        nodes = nodes.unionByName(knowledge_chunks(markdown).select(*CHUNK_COLUMNS))
    return nodes


def upsert(index: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` replace rows with the same key; other old rows
    stay (stale ids are never deleted)."""
    return index.join(new.select(key), key, "left_anti").unionByName(new)


def get_chunks(index: DataFrame, where: Mapping[str, str] | None = None) -> DataFrame:
    """Metadata equality filter; ``{"$and": [{...}, {...}]}`` nests."""
    if not where:
        return index
    return index.filter(_where(where))


def _where(where: Mapping) -> Column:
    cond = F.lit(True)
    for k, v in where.items():
        if k == "$and":
            for sub in v:
                cond = cond & _where(sub)
        else:
            cond = cond & (F.col(k) == F.lit(v))
    return cond
