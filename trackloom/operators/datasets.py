"""A table of graphs with what training needs: adding, splitting, balancing, and handing over to libraries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators import graphs, splits
from trackloom.sources import graph_files

FORMATS = {"dict": graph_files.to_dicts, "pyg": graph_files.to_torch, "spektral": graph_files.to_spektral}


class GraphDataset:
    """Graph rows, as ``build_graphs`` makes them. Nothing is collected but by ``records``, one partition at a time."""

    def __init__(self, graphs_: DataFrame):
        if missing := {"x", "e", "a", "label", "graph_id"} - set(graphs_.columns):
            raise ValueError(f"no graph rows: columns {sorted(missing)} are missing")
        self.graphs = graphs_

    def add(self, other: GraphDataset | DataFrame) -> GraphDataset:
        """This dataset's graphs and the other's; columns that only one has are null in the other's."""
        rows = other.graphs if isinstance(other, GraphDataset) else GraphDataset(other).graphs
        return GraphDataset(self.graphs.unionByName(rows, allowMissingColumns=True))

    def __len__(self) -> int:
        return self.graphs.count()

    def dimensions(self) -> tuple[int, int, int, int, int]:
        """Graphs, features per node, features per edge, labels, most nodes."""
        d = graphs.dimensions(self.graphs).first()
        return d["graphs"], d["node_features"], d["edge_features"], 1, d["most_nodes"]

    def split(self, train: float, test: float, validation: float | None = None, by_graph_id: bool = True, seed: int = 0, key: str = "frame_id") -> tuple[GraphDataset, ...]:
        """Train, test and, if asked for, validation; graphs of one id stay together if ids are given."""
        if by_graph_id:
            d = splits.split_groups(self.graphs, "graph_id", train, test, validation, seed, key)
        else:
            d = splits.split_rows(self.graphs, key, train, test, validation, seed)
        return tuple(GraphDataset(d.where(F.col("split") == s).drop("split")) for s in ("train", "test", "validation")[: 3 if validation else 2])

    def balanced(self, ratio: float, seed: int = 0, key: str = "frame_id") -> GraphDataset:
        return GraphDataset(splits.balanced(self.graphs, "label", key, ratio, seed))

    def records(self, format: str = "dict") -> Iterator:
        """Graphs one at a time as dicts of arrays, or as objects of a library that is installed."""
        if format not in FORMATS:
            raise ValueError(f"format must be one of {sorted(FORMATS)}, not {format!r}")
        return FORMATS[format](self.graphs)


def rows_of(spark: SparkSession, dicts: list[dict]) -> DataFrame:
    """Graph rows of dicts of arrays: x, e, a, id, label (or y), and perhaps frame_id, object_ids, ball_owning_team_id."""
    out = []
    for d in dicts:
        x, e, a = (np.asarray(d[c]) for c in "xea")
        label = d.get("label", d["y"][0] if d.get("y") is not None and len(d["y"]) else None)
        ids, frame, graph = d.get("object_ids"), d.get("frame_id"), d.get("id", d.get("graph_id"))
        shapes = [int(k) for m in (x, e, a) for k in m.shape]
        out.append((x.astype(float).tolist(), e.astype(float).tolist(), a.astype(int).tolist(), *shapes, None if graph is None else str(graph), None if label is None else int(label), None if frame is None else int(frame), None if ids is None else list(ids), d.get("ball_owning_team_id")))
    return spark.createDataFrame(out, graphs.SCHEMA)


def graph_dataset(spark: SparkSession, graphs: DataFrame | list[dict] | None = None, pickle_file: str | None = None, pickle_folder: str | None = None, parquet: str | None = None) -> GraphDataset:
    """A dataset of exactly one source: a table, a list of dicts, a pickle file, a folder of such, or Parquet."""
    given = {k: v for k, v in (("graphs", graphs), ("pickle_file", pickle_file), ("pickle_folder", pickle_folder), ("parquet", parquet)) if v is not None}
    if len(given) != 1:
        raise ValueError("give one of graphs, pickle_file, pickle_folder and parquet")
    if parquet:
        return GraphDataset(graph_files.read_graphs(spark, parquet))
    if isinstance(graphs, DataFrame):
        return GraphDataset(graphs)
    dicts = graphs if graphs is not None else graph_files.from_pickle(pickle_file or pickle_folder)
    if not isinstance(dicts, list) or not dicts or not all(isinstance(d, dict) for d in dicts):
        raise ValueError("graphs must be a table or a list, not empty, of dicts")
    return GraphDataset(rows_of(spark, dicts))


def dummy_labels(frames: list, seed: int = 0) -> dict:
    """A 0 or 1 by chance for each distinct frame."""
    rng = np.random.default_rng(seed)
    return {f: int(rng.integers(0, 2)) for f in dict.fromkeys(frames)}


def dummy_graph_ids(frames: list) -> dict:
    """A graph id of its own for each distinct frame."""
    return {f: k for k, f in enumerate(dict.fromkeys(frames))}
