"""Graph tables to and from files, and to the objects of training libraries."""

from __future__ import annotations

import glob
import gzip
import os
import pickle
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def to_dicts(graphs: DataFrame) -> Iterator[dict]:
    """Graphs one at a time as dicts of arrays, streamed partition by partition."""
    for r in graphs.toLocalIterator(prefetchPartitions=True):
        d = r.asDict()
        yield d | {"x": np.array(d["x"], float), "e": np.array(d["e"], float).reshape(d["e_shape_0"], d["e_shape_1"]), "a": np.array(d["a"], np.int8), "y": np.array([d["label"]]), "id": d["graph_id"]}


def to_pickle(graphs: DataFrame, path: str) -> None:
    """One gzip pickle of all graphs, for small tables; large ones go to Parquet."""
    if not path.endswith("pickle.gz"):
        raise ValueError("only compressed pickle files: the path must end in pickle.gz")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with gzip.open(path, "wb") as f:
        pickle.dump(list(to_dicts(graphs)), f)


def from_pickle(path: str) -> list[dict]:
    """Graphs of a file or of all files of a folder. Only for files of one's own: a pickle can run code."""
    names = sorted(glob.glob(os.path.join(path, "*pickle.gz"))) if os.path.isdir(path) else [path]
    out = []
    for n in names:
        with gzip.open(n, "rb") as f:
            out += pickle.load(f)
    return out


def write_graphs(graphs: DataFrame, path: str) -> None:
    graphs.write.mode("overwrite").parquet(path)


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def to_torch(graphs: DataFrame) -> Iterator:
    """Graph objects of torch_geometric, if it is installed."""
    try:
        import torch
        from torch_geometric.data import Data
    except ImportError as e:
        raise ImportError("torch and torch_geometric are not installed") from e
    for d in to_dicts(graphs):
        yield Data(x=torch.tensor(d["x"]), edge_index=torch.tensor(np.array(np.nonzero(d["a"]))), edge_attr=torch.tensor(d["e"]), y=torch.tensor(d["y"]), id=d["id"], frame_id=d["frame_id"], object_ids=d["object_ids"], ball_owning_team_id=d["ball_owning_team_id"])


def to_spektral(graphs: DataFrame) -> Iterator:
    """Graph objects of spektral, if it is installed."""
    try:
        from spektral.data import Graph
    except ImportError as e:
        raise ImportError("spektral is not installed") from e
    for d in to_dicts(graphs):
        yield Graph(x=d["x"], a=d["a"], e=d["e"], y=d["y"], id=d["id"], frame_id=d["frame_id"], object_ids=d["object_ids"], ball_owning_team_id=d["ball_owning_team_id"])
