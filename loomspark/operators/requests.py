"""Request trees as rows: a path of child numbers keeps the depth-first order."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.options import CONTENT_TYPES, InvalidChunkingOptions

SCHEMA = "request_id string, parent_id string, path array<int>, type string, text string, items array<string>, ordered boolean, rows array<array<string>>, labels array<string>, tags map<string,string>"


def flatten(spark: SparkSession, trees: Iterable[dict]) -> DataFrame:
    """Nodes of nested dictionaries (id, type, text, unordered, ordered, table, labels, tags, children), one row each."""
    rows = []

    def visit(node: dict, path: tuple[int, ...]) -> None:
        kind = node.get("type", "Text")
        if kind not in CONTENT_TYPES:
            raise InvalidChunkingOptions(f"{kind!r} is no content type")
        items = node.get("unordered") if node.get("unordered") is not None else node.get("ordered")
        rows.append((node.get("id") or str(uuid.uuid4()), node.get("parent_id"), list(path), kind, node.get("text"), items, node.get("unordered") is None and items is not None, node.get("table"), node.get("labels"), node.get("tags")))
        for i, child in enumerate(node.get("children") or []):
            visit(child, (*path, i))

    for i, tree in enumerate(trees):
        visit(tree, (i,))
    return spark.createDataFrame(rows, SCHEMA)


def paths(nodes: DataFrame, node: str = "id", parent: str = "parent", order: str = "ord") -> DataFrame:
    """*nodes* with path and depth, from an adjacency list, by a recursive query."""
    view = f"loom_nodes_{uuid.uuid4().hex}"
    nodes.createOrReplaceTempView(view)
    return nodes.sparkSession.sql(
        f"""WITH RECURSIVE walk(id, path, depth) AS (
          SELECT {node}, array({order}), 0 FROM {view} WHERE {parent} IS NULL
          UNION ALL SELECT n.{node}, concat(w.path, array(n.{order})), w.depth + 1 FROM walk w JOIN {view} n ON n.{parent} = w.id)
        SELECT n.*, w.path, w.depth FROM {view} n JOIN walk w ON n.{node} = w.id"""
    )


def ordered(chunks: DataFrame) -> DataFrame:
    return chunks.orderBy("path", F.col("position"))
