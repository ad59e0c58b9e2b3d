"""Bases, documents and their tree: filters, statistics, status, outline, subtrees."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window, functions as F

from stackwise.functions import text as T
from stackwise.session import saved


# --- scope and filters


def scope(df: DataFrame, base_ids: list | None) -> DataFrame:
    """Rows of the bases; None is all of them, an empty list none."""
    return df if base_ids is None else df.where(F.col("base_id").isin(*base_ids)) if base_ids else df.where(F.lit(False))


def known_base(bases: DataFrame, df: DataFrame, base_id) -> DataFrame:
    """Rows of one base, none if there is no such base."""
    return df.where(F.col("base_id") == F.lit(base_id)).join(bases.select("base_id"), "base_id", "left_semi")


def enabled(bases: DataFrame, pinned: list) -> DataFrame:
    """The pinned bases that exist; without any, all."""
    here = F.col("base_id").isin(*pinned) if pinned else F.lit(False)
    b = bases.select("base_id", here.alias("here")).withColumn("any", F.max("here").over(Window.partitionBy()))
    return b.where(F.col("here") | ~F.col("any")).select("base_id")


def by_documents(df: DataFrame, doc_ids: list, most: int | None = None) -> DataFrame:
    """Rows of the documents; over ``most`` ids, if set, is an error and not a cut."""
    if most is not None and len(doc_ids) > most:
        raise ValueError(f"more than {most} documents in a filter")
    return df.where(F.col("doc_id").isin(*doc_ids)) if doc_ids else df.where(F.lit(False))


def touched() -> Column:
    return F.coalesce("updated_at", "created_at")


def metadata_filter(title: str | None = None, source_types: list[str] | None = None, doc_ids: list | None = None, after: int | None = None, before: int | None = None) -> Column | None:
    """All clauses that are set, or None if none is: unrestricted. What matches nothing gives nothing."""
    clauses = []
    if title is not None and title.strip():
        clauses.append(F.contains(F.lower("title"), F.lit(title.strip().lower())))
    if source_types:
        clauses.append(F.col("source_type").isin(*source_types))
    if doc_ids:
        clauses.append(F.col("doc_id").isin(*doc_ids))
    if after is not None:
        clauses.append(touched() >= after)
    if before is not None:
        clauses.append(touched() <= before)
    out = None
    for c in clauses:
        out = c if out is None else out & c
    return out


def filtered(chunks: DataFrame, docs: DataFrame, **clauses) -> DataFrame:
    """Chunks of the documents that the clauses admit."""
    keep = metadata_filter(**clauses)
    return chunks if keep is None else chunks.join(docs.where(keep).select("doc_id"), "doc_id", "left_semi")


# --- statistics


def base_summary(bases: DataFrame, docs: DataFrame) -> DataFrame:
    """By base, those without documents too: documents (directories count), chunks, characters, tokens."""
    d = docs.groupBy("base_id").agg(F.count("*").alias("documents"), F.sum("chunk_count").alias("chunks"), F.sum("char_count").alias("chars"), F.sum(F.coalesce("token_count", F.lit(0))).alias("tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return bases.select("base_id").join(d, "base_id", "left").select("base_id", *map(zero, ("documents", "chunks", "chars", "tokens")))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("base_id", "embedding_model").agg(F.count("*").alias("chunks"), F.max(F.col("embedding").isNotNull()).alias("embedded"), F.max(F.size("embedding")).alias("dimension"))


def stale(chunks: DataFrame, tags: DataFrame) -> DataFrame:
    """By base (base_id, model_tag): embedded chunks of another model; bases without a tag, and without such chunks, are left out."""
    c = chunks.where("embedding is not null").join(tags.where("model_tag is not null"), "base_id")
    return c.groupBy("base_id").agg(F.count_if(~F.col("embedding_model").eqNullSafe(F.col("model_tag"))).alias("stale")).where("stale > 0")


def stats(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, characters, tokens, chunks, whether any is embedded, a dimension."""
    d = docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum("char_count"), F.lit(0)).alias("chars"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))
    c = chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.max(F.col("embedding").isNotNull()), F.lit(False)).alias("embedded"), F.max(F.size("embedding")).alias("dimension"))
    return d.crossJoin(c)


def doc_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))


def doc_status(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("embedding").isNull()).alias("missing"))


def derived_status(docs: DataFrame, chunks: DataFrame, active: list | None = None) -> DataFrame:
    """doc_id, status: failed, processing, completed (has chunks and all have vectors) or pending; directories have none."""
    s = doc_status(chunks).withColumnRenamed("chunks", "_chunks")
    busy = F.col("doc_id").isin(*active) if active else F.lit(False)
    done = (F.coalesce("_chunks", F.lit(0)) > 0) & (F.col("missing") == 0)
    status = F.when(F.col("source_type") == "directory", F.lit(None)).when(F.col("embedding_error").isNotNull(), "failed").when(busy, "processing").when(done, "completed").otherwise("pending")
    return docs.join(s, "doc_id", "left").select("doc_id", status.alias("status"))


def child_counts(docs: DataFrame) -> DataFrame:
    return docs.where("parent_directory_id is not null").groupBy("parent_directory_id").agg(F.count("*").alias("children"))


def reconciled(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with the chunk count there really is."""
    n = doc_counts(chunks).withColumnRenamed("chunks", "_n")
    return docs.join(n, "doc_id", "left").withColumn("chunk_count", F.coalesce("_n", F.lit(0)).cast("long")).drop("_n")


def recovered(docs: DataFrame, chunks: DataFrame, started_at: int) -> DataFrame:
    """doc_id, action for incomplete documents from before ``started_at``: resume where there is a source or a chunk to go on from, else remove; keep the rest."""
    n = doc_counts(chunks).withColumnRenamed("chunks", "_n")
    open_before = F.coalesce("incomplete", F.lit(False)) & (touched() < started_at)
    has_source = (F.coalesce(F.col("_n"), F.lit(0)) > 0) | F.col("raw_file_path").isNotNull() | (F.length("raw_text") > 0) | F.col("url").isNotNull()
    action = F.when(~open_before | (F.col("source_type") == "directory"), "keep").when(has_source, "resume").otherwise("remove")
    return docs.join(n, "doc_id", "left").select("doc_id", action.alias("action"))


# --- tree


def paths(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, path: keys and ids of the way down from the root) of the documents below a root, and the rows of ``docs`` on or below a cycle.

    Every document knows the end of its way, and what it is below; a step joins that one's end on, so
    the known part doubles, and the steps are few however deep the tree is. What is left when a step
    comes to no more roots never will.
    """
    key = F.array(F.struct(F.coalesce("title", F.lit("")).alias("_key"), F.col("doc_id").cast("string").alias("id")))
    known = docs.select(F.col("doc_id").alias("top"))
    now = saved(docs.join(known, docs["parent_directory_id"] == known["top"], "left").select("doc_id", "top", key.alias("path")), "paths")
    left = now.where("top is not null").count()
    while left:
        above = now.select(F.col("doc_id").alias("_d"), F.col("top").alias("_top"), F.col("path").alias("_path"))
        step = now.join(above, now["top"] == above["_d"], "left")
        now = saved(step.select("doc_id", F.col("_top").alias("top"), F.when(F.col("_d").isNull(), F.col("path")).otherwise(F.concat("_path", "path")).alias("path")), "paths")
        before, left = left, now.where("top is not null").count()
        if left == before:
            break
    return now.where("top is null").select("doc_id", "path"), docs.join(now.where("top is not null").select("doc_id"), "doc_id", "left_semi")


def walked(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """root_id, doc_id and depth of all below the roots, level by level; a way ends where it comes round to a document it has."""
    nodes = docs.select("doc_id", "parent_directory_id")
    level = nodes.join(roots.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("root_id"), "doc_id", F.lit(0).alias("depth"), F.array(F.col("doc_id").cast("string")).alias("path"))
    level = saved(level, "tree")
    out = level
    for depth in count(1):
        step = level.select("root_id", F.col("doc_id").alias("_parent"), "path").join(nodes, F.col("_parent") == F.col("parent_directory_id"))
        step = step.where(~F.exists("path", lambda p: p == F.col("doc_id").cast("string")))
        level = saved(step.select("root_id", "doc_id", F.lit(depth).alias("depth"), F.concat("path", F.array(F.col("doc_id").cast("string"))).alias("path")), "tree")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def numbered(df: DataFrame, by: str | list[str | Column], name: str) -> DataFrame:
    """``df`` with a number, from 1, in order of ``by``: the place in a partition of a range sort and the rows before it."""
    s = saved(df.orderBy(*([by] if isinstance(by, str) else by)).withColumn("_at", F.monotonically_increasing_id()), "sorted").withColumn("_range", F.shiftright("_at", 33))
    # one row a range partition
    before = s.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return s.join(before, "_range").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_range", "_before")


def numbered_in(df: DataFrame, group: list[str], by: list[str], name: str) -> DataFrame:
    """A number, from 1, inside each group: the place in the sort of all, less that of the group's first. A group may be of any size."""
    n = numbered(df, [*group, *by], "_place")
    first = n.groupBy(*group).agg(F.min("_place").alias("_first"))
    a, b = n.alias("a"), first.alias("b")
    on = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
    return a.join(b, on).select("a.*", (F.col("a._place") - F.col("b._first") + 1).alias(name)).drop("_place")


def outline(docs: DataFrame, collation: str | None = None) -> DataFrame:
    """doc_id, depth, position (from 1): the whole forest in pre-order, siblings by title, then id.

    Titles go by code points, or as the ``collation`` of a language has it (``UNICODE`` for any language), in which accents and
    case only decide between titles of the same letters.
    """
    below, _ = paths(docs)
    order = F.col("path")
    if collation:
        # titles that the collation holds equal are told apart by their code points
        order = F.transform("path", lambda p: F.struct(F.collate(p["_key"], collation).alias("as"), p["_key"].alias("key"), p["id"].alias("id")))
    # whole paths sort parents before children and keep subtrees together
    return numbered(below, [order], "position").select("doc_id", (F.size("path") - 1).alias("depth"), F.col("position").cast("int").alias("position"))


def below_any(docs: DataFrame, selected: DataFrame) -> DataFrame:
    """doc_id, depth (0 or more) of a document and each selected one that it is or that it is below."""
    sel = selected.select(F.col("doc_id").cast("string").alias("id")).distinct()
    rooted, cyclic = paths(docs)
    ways = rooted.select("doc_id", F.size("path").alias("_n"), F.posexplode(F.transform("path", lambda p: p.id)).alias("_i", "id"))
    out = ways.join(sel, "id", "left_semi").select("doc_id", (F.col("_n") - 1 - F.col("_i")).alias("depth"))
    if cyclic.isEmpty():
        return out
    return out.unionByName(walked(cyclic, selected).select("doc_id", "depth"))


def subtree(docs: DataFrame, selected: DataFrame) -> DataFrame:
    """The selected documents and all below them, once each."""
    return below_any(docs, selected).select("doc_id").distinct()


def outermost(docs: DataFrame, selected: DataFrame) -> DataFrame:
    """The selected documents that have no selected ancestor."""
    below = below_any(docs, selected).where("depth > 0").select("doc_id").distinct()
    return selected.select("doc_id").distinct().join(below, "doc_id", "left_anti")


def importing_folders(docs: DataFrame, processing: DataFrame) -> DataFrame:
    """All folders above documents that are being processed: the ways up from these."""
    folders = docs.where(F.col("source_type") == "directory").select("doc_id")
    rooted, cyclic = paths(docs)
    up = rooted.join(processing.select("doc_id").distinct(), "doc_id", "left_semi").select(F.explode(F.transform(F.slice("path", F.lit(1), F.size("path") - 1), lambda p: p.id)).alias("_id")).distinct()
    out = folders.join(up, F.col("doc_id").cast("string") == F.col("_id"), "left_semi")
    if cyclic.isEmpty():
        return out
    ring = walked(cyclic, folders).where("depth > 0").join(processing.select("doc_id"), "doc_id", "left_semi").select(F.col("root_id").alias("doc_id"))
    return out.union(ring).distinct()


def folders_of(paths: DataFrame) -> DataFrame:
    """From file paths (path): a row per folder and file: item, parent, is_file, depth."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    p = paths.select(parts.alias("parts")).where(F.size("parts") > 0)
    every = p.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.struct(F.array_join(F.slice("parts", F.lit(1), i), "/").alias("item"), F.array_join(F.slice("parts", F.lit(1), i - 1), "/").alias("parent"), (i == F.size("parts")).alias("is_file"), i.alias("depth")))).alias("x"))
    return every.select("x.*").groupBy("item", "parent", "depth").agg(F.min("is_file").alias("is_file")).withColumn("parent", F.when(F.col("parent") != "", F.col("parent")))


def scanned(paths: DataFrame, most_files: int = 500, most_depth: int = 8) -> DataFrame:
    """Paths with an accepted extension and no deeper than allowed, the first so many in order."""
    depth = F.size(F.filter(F.split("path", "/"), lambda x: x != ""))
    return paths.where(T.accepted(F.col("path")) & (depth <= most_depth)).orderBy("path").limit(most_files)


def summary(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Document rows as listed, with status and children."""
    d = docs.join(derived_status(docs, chunks), "doc_id", "left").join(child_counts(docs).withColumnRenamed("parent_directory_id", "doc_id"), "doc_id", "left")
    return d.select("doc_id", "base_id", "title", "source_type", "char_count", "token_count", "chunk_count", "status", F.coalesce("children", F.lit(0)).alias("children"))


def detail(docs: DataFrame, limit: int) -> DataFrame:
    """Documents with their text cut to ``limit`` and whether it was."""
    return docs.select("doc_id", "title", F.substring("raw_text", 1, limit).alias("raw_text"), (F.length("raw_text") > limit).alias("truncated"))
