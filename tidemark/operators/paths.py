"""Paths and patterns over file listings: a tree of path parts, walked level by level by joins.

A listing's folders and files are nodes (parent, name). A pattern starts at a folder and takes one part a level: a plain part by
an equality join, one with *, ? or [...] by a join on the folder whose names are matched, and ** by a join with all folders
below. Equal patterns walk once. No pattern meets files outside the folders that it has reached.

Parts "." and ".." are resolved first, in listings, bases and patterns, so a path is what it leads to and not how it is
written; ".." above the top stays at the top. A pattern names the first file by the order of parts.
"""

from __future__ import annotations

import fnmatch

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.stages import stored

WILD = r"[*?\[]"


def parts(path: Column) -> Column:
    """The parts that a path leads to; a leading slash is a part of its own, empty."""
    none = F.array().cast("array<string>")
    top = F.when(path.startswith("/"), F.array(F.lit(""))).otherwise(none)
    up = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    step = lambda a, p: F.when(p.isin("", "."), a).when(p == "..", up(a)).otherwise(F.concat(a, F.array(p)))
    return F.concat(top, F.aggregate(F.split(path, "/"), none, step))


def joined(names: Column) -> Column:
    return F.array_join(names, "/")


def normal(path: Column) -> Column:
    """A path without "." and ".."."""
    return joined(parts(path))


def tree(files: DataFrame) -> DataFrame:
    """(parent, name, node, at, is_file) of every folder and file of (path) rows; at: the node's parts."""
    own = files.select(parts(F.col("path")).alias("p")).where(F.size("p") > 0).distinct()
    heads = own.select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"))
    nodes = heads.select(F.slice("p", 1, F.col("n")).alias("at"), (F.col("n") == F.size("p")).alias("is_file")).groupBy("at").agg(F.bool_or("is_file").alias("is_file"))
    return nodes.select(joined(F.slice("at", 1, F.size("at") - 1)).alias("parent"), F.element_at("at", -1).alias("name"), joined(F.col("at")).alias("node"), "at", "is_file")


@F.pandas_udf(T.StringType())
def part_regex(part: pd.Series) -> pd.Series:
    """The pattern of one part (*, ?, [...]) as a regular expression; only distinct patterns come here."""
    return part.map(lambda p: "^" + fnmatch.translate(p).removesuffix("\\Z").removesuffix("\\z") + "\\z")


def walked(patterns: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pattern, at) of the files that each (pattern, names) reaches; names: its parts from the top. nodes: of tree()."""
    state = patterns.select("pattern", F.lit("").alias("node"), F.lit(None).cast("array<string>").alias("at"), F.lit(False).alias("is_file"), F.col("names").alias("rest"))
    depth = patterns.agg(F.max(F.size("names"))).first()[0] or 0
    nodes = stored(nodes)
    folders = nodes.where("not is_file").select("node", "at")
    # Every folder below each, and itself.
    below = folders.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("at")), lambda n: joined(F.slice("at", 1, n)))).alias("top"), F.col("node").alias("low"), F.col("at").alias("low_at"))
    below = below.unionByName(folders.sparkSession.range(1).select(F.lit("").alias("top"), F.lit("").alias("low"), F.lit(None).cast("array<string>").alias("low_at")))
    child = nodes.select(F.col("parent").alias("node"), "name", F.col("node").alias("next"), F.col("at").alias("next_at"), F.col("is_file").alias("next_file"))
    for _ in range(depth):
        ended = state.where(F.size("rest") == 0)
        going = state.where(F.size("rest") > 0).select("pattern", "node", "is_file", F.get("rest", F.lit(0)).alias("head"), F.slice("rest", 2, F.size("rest")).alias("rest"), "at").where("not is_file")
        moved = lambda df: df.select("pattern", F.col("next").alias("node"), F.col("next_at").alias("at"), F.col("next_file").alias("is_file"), "rest")
        plain = going.where(~F.col("head").rlike(WILD)).withColumnRenamed("head", "name").drop("is_file", "at").join(child, ["node", "name"])
        wild = going.where(F.col("head").rlike(WILD) & (F.col("head") != "**"))
        forms = wild.select("head").distinct().select("head", part_regex("head").alias("form"))
        globbed = wild.drop("is_file", "at").join(forms, "head").join(child, "node").where(F.expr("name rlike form"))
        deep = going.where("head = '**'").join(below, F.col("node") == F.col("top"))
        last = F.size("rest") == 0
        spread = deep.where(~last).select("pattern", F.col("low").alias("node"), F.col("low_at").alias("at"), F.lit(False).alias("is_file"), "rest")
        # At the end ** names all files below.
        leaves = deep.where(last).select("pattern", F.col("low").alias("node"), "rest").join(child.where("next_file"), "node")
        # Each level is read by several branches of the next, so it is written once.
        state = stored(ended.unionByName(moved(plain)).unionByName(moved(globbed)).unionByName(spread).unionByName(moved(leaves)).distinct())
    return state.where((F.size("rest") == 0) & F.col("is_file")).select("pattern", "at").distinct()


def resolved(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(pattern, path): the first file of (path) rows that each different pattern of (pattern) names, null for none."""
    distinct = asked.select("pattern").where("pattern is not null").distinct().withColumn("names", parts(F.col("pattern")))
    best = walked(distinct, tree(files)).groupBy("pattern").agg(F.min("at").alias("at"))
    return distinct.select("pattern").join(best, "pattern", "left").select("pattern", joined(F.col("at")).alias("path"))
