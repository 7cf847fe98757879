"""Per-frame graphs: one row per frame with node, edge and adjacency matrices, from one shuffle by frame at most."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.scalar import finite
from trackloom.operators import features as X
from trackloom.operators import frames, pairs
from trackloom.schema import FRAME, FootballSettings, Settings

SCHEMA = (
    "x array<array<double>>, e array<array<double>>, a array<array<int>>, x_shape_0 long, x_shape_1 long, e_shape_0 long, e_shape_1 long, "
    "a_shape_0 long, a_shape_1 long, graph_id string, label long, frame_id long, object_ids array<string>, ball_owning_team_id string"
)


#: Columns of an object that the built-in edge features read.
SOCCER_EDGE, FOOTBALL_EDGE = ("x", "y", "z", "vx", "vy", "v"), ("x", "y", "v", "a", "o", "dir")


@dataclass(frozen=True)
class GraphConfig:
    adjacency: str = pairs.SPLIT_BY_TEAM
    connect: str = pairs.TO_BALL
    prediction: bool = False
    pad: bool = False
    sample_rate: float | None = None
    label_col: str = "label"
    graph_id_col: str = "graph_id"
    #: stored for callers; the adjacency does not use it
    self_loop_ball: bool = False
    label_type: str = "binary"
    global_cols: tuple[str, ...] = ()
    global_type: str = "ball"
    extra_cols: tuple[str, ...] = ()
    node_functions: tuple[Callable, ...] = ()
    edge_functions: tuple[Callable, ...] = ()
    #: whether the built-in columns come before those of numpy functions; for edges by default only where there are none
    builtin_nodes: bool = True
    builtin_edges: bool | None = None
    #: handed to numpy functions as ``feature_opts``
    feature_opts: dict = field(default_factory=dict)
    by: tuple[str, ...] = field(default=tuple(FRAME))

    def __post_init__(self):
        for name, kind in (("prediction", bool), ("pad", bool), ("self_loop_ball", bool), ("builtin_nodes", bool), ("label_col", str), ("graph_id_col", str), ("feature_opts", dict)):
            if not isinstance(getattr(self, name), kind):
                raise TypeError(f"{name} must be of type {kind.__name__}")
        if self.sample_rate is not None and (isinstance(self.sample_rate, bool) or not isinstance(self.sample_rate, (int, float))):
            raise TypeError("sample_rate must be a number")
        for name in ("global_cols", "extra_cols", "node_functions", "edge_functions"):
            if not isinstance(getattr(self, name), (tuple, list)):
                raise TypeError(f"{name} must be a tuple")
        if reserved := {"settings"} & set(self.feature_opts):
            raise ValueError(f"{reserved} is a reserved keyword")
        if self.adjacency not in (pairs.DENSE, pairs.DENSE_AP, pairs.DENSE_DP, pairs.SPLIT_BY_TEAM, pairs.DELAUNAY):
            raise ValueError(f"no adjacency {self.adjacency!r}")
        if self.connect not in (pairs.TO_BALL, pairs.TO_CARRIER, pairs.NO_CONNECTION):
            raise ValueError(f"no connection {self.connect!r}")
        if self.label_type != "binary":
            raise ValueError("labels must be binary")
        if self.global_type not in ("ball", "all"):
            raise ValueError("global features go to the ball or to all")


def prepared(df: DataFrame, config: GraphConfig, settings: Settings) -> DataFrame:
    """Checked columns; padded or whole frames; sampled."""
    if config.graph_id_col not in df.columns:
        raise ValueError(f"add graph ids first: no column {config.graph_id_col}")
    if config.label_col not in df.columns:
        if not config.prediction:
            raise ValueError(f"no column {config.label_col}; labels can be left out for prediction only")
        df = df.withColumn(config.label_col, F.lit(None).cast("int"))
    if missing := [c for c in (*config.global_cols, *config.extra_cols) if c not in df.columns]:
        raise ValueError(f"no columns {missing}")
    if not isinstance(settings, FootballSettings):
        df = frames.padded(df, settings) if config.pad else frames.whole_frames(df)
    else:
        df = frames.football_frames(df, list(config.by), settings.ball_id)
    return frames.sample_frames(df, config.sample_rate) if config.sample_rate else df


def of_style(functions: tuple[Callable, ...], style: str, kind: str) -> list[Callable]:
    return X.checked([f for f in functions if getattr(f, "feature_style", style) == style], kind)


def node_columns(config: GraphConfig, settings: Settings) -> list[Callable]:
    builtin = X.football_nodes if isinstance(settings, FootballSettings) else X.soccer_nodes
    own = of_style(config.node_functions, "columns", "node")
    return own or ([builtin] if config.builtin_nodes or not config.node_functions else [])


def edge_columns(config: GraphConfig, settings: Settings) -> list[Callable]:
    builtin = X.football_edges if isinstance(settings, FootballSettings) else X.soccer_edges
    own = of_style(config.edge_functions, "columns", "edge")
    return own or ([builtin] if config.builtin_edges or not config.edge_functions else [])


def node_table(df: DataFrame, config: GraphConfig, settings: Settings) -> tuple[DataFrame, list[str]]:
    """Rows widened by the node features, and the features' names in order."""
    football = isinstance(settings, FootballSettings)
    d = X.with_ball(df, settings.ball_id, list(config.by), "xy" if football else "xyz")
    if football:
        d = X.with_frame_units(d, list(config.by))
    columns = {k: v for f in node_columns(config, settings) for k, v in f(settings).items()}
    columns |= X.global_features(list(config.global_cols), config.global_type, settings.ball_id)
    return d.withColumns({f"f_{k}": finite(v.cast("double"), 0.0) for k, v in columns.items()}), [f"f_{k}" for k in columns]


def edge_inputs(d: DataFrame, settings: Settings) -> list[str]:
    columns = FOOTBALL_EDGE if isinstance(settings, FootballSettings) else SOCCER_EDGE
    return [c for c in ("id", "team_id", "ball_owning_team_id", "is_ball_carrier", *columns) if c in d.columns]


def edge_table(df: DataFrame, config: GraphConfig, settings: Settings) -> tuple[DataFrame, list[str]]:
    """A row per cell of each frame's matrix that is 1: i.row, j.row and the edge features."""
    p = pairs.pairs(df, list(config.by), frames.graph_order(settings), edge_inputs(df, settings))
    p = p.where(pairs.connected(config.adjacency, config.connect, settings.ball_id, "is_ball_carrier" in df.columns))
    features = {k: v for f in edge_columns(config, settings) for k, v in f(settings).items()}
    return X.with_differences(p, settings).withColumns({f"f_{k}": v.cast("double") for k, v in features.items()}), [f"f_{k}" for k in features]


def build_graphs(df: DataFrame, config: GraphConfig = GraphConfig(), settings: Settings = Settings()) -> DataFrame:
    """A row per frame: x (nodes by features), e (edges by features, row-major), a, their shapes, ids and label.

    Nodes are ordered attackers, defenders, ball, then by id. Rows are shuffled once, by frame, if they are not together
    already, and a frame's rows are packed; ``matrices`` makes a, e and what numpy functions add, so pairs never become
    rows. Only edge features of one's own that are column expressions need a row per pair (``with_cells``). Labels,
    graph ids and global columns must have one value in a frame.
    """
    numpy_style = of_style(config.node_functions, "numpy", "node") + of_style(config.edge_functions, "numpy", "edge")
    one_value = [config.graph_id_col, config.label_col, *config.global_cols]
    d, names = node_table(frames.constant_in_frame(prepared(df, config, settings), one_value, list(config.by)), config, settings)
    pairs.connected(config.adjacency, config.connect, settings.ball_id, "is_ball_carrier" in d.columns)  # raises where there is none
    keep = edge_inputs(d, settings)
    own = [c for c in d.columns if c not in config.by and c not in names] if numpy_style else []
    first = {"label": config.label_col, "graph_id": config.graph_id_col}
    g = d.groupBy(*config.by).agg(
        F.sort_array(F.collect_list(F.struct(frames.graph_order(settings).alias("_o"), *dict.fromkeys([*keep, *own]), F.array(*names).cast("array<double>").alias("f")))).alias("_n"),
        *(F.min(c).alias(k) for k, c in first.items()),
    )
    edge = {k: v for f in edge_columns(config, settings) for k, v in f(settings).items()}
    if of_style(config.edge_functions, "columns", "edge"):
        g = with_cells(g, edge, keep, config, settings)
    n = F.size("_n").cast("long")
    g = g.withColumns({
        "_m": matrices(keep, own, len(edge), config, settings),
        "x": F.col("_n.f"),
        "object_ids": F.transform("_n", lambda v: F.nullif(v["id"].cast("string"), F.lit(""))),
        "ball_owning_team_id": F.element_at("_n", 1)["ball_owning_team_id"],
    })
    g = g.withColumns({
        **({"x": F.col("_m.x")} if numpy_style else {}),
        "e": F.col("_m.e"), "a": F.col("_m.a"), "e_shape_0": F.size("_m.e").cast("long"), "x_shape_0": n, "a_shape_0": n, "a_shape_1": n,
        "x_shape_1": F.col("_m.x_shape_1") if numpy_style else F.lit(len(names)).cast("long"),
        "e_shape_1": F.col("_m.e_shape_1") if numpy_style else F.lit(len(edge)).cast("long"),
        "label": F.col("label").cast("long"), "frame_id": F.col("frame_id").cast("long"),
    })
    return g.select(*(c for c in config.by if c != "frame_id"), *(f.split()[0] for f in SCHEMA.split(", ")))


def with_cells(g: DataFrame, edge: dict, keep: list[str], config: GraphConfig, settings: Settings) -> DataFrame:
    """Add ``_e``: features of edges that are column expressions, from a row per pair and the packed frame on the first."""
    on = F.coalesce(pairs.connected(config.adjacency, config.connect, settings.ball_id, "is_ball_carrier" in keep), F.lit(False))
    cell = lambda v, k: [k.alias("row"), *(v[c].alias(c) for c in keep)]
    i = F.transform("_n", lambda v, k: F.struct(*cell(v, k), F.when(k == 0, F.struct("_n", "label", "graph_id")).alias("frame")))
    cells = g.select(*config.by, i.alias("_i"), F.transform("_n", lambda v, k: F.struct(*cell(v, k))).alias("_j"))
    cells = cells.select(*config.by, F.explode("_i").alias("i"), "_j").select(*config.by, "i", F.explode("_j").alias("j"))
    head = F.when((F.col("i.row") == 0) & (F.col("j.row") == 0), F.col("i.frame"))
    cells = cells.withColumns({"_on": on, "_head": head}).where(F.col("_on") | F.col("_head").isNotNull())
    made = F.struct(F.col("i.row").alias("i"), F.col("j.row").alias("j"), F.array(*(v.cast("double") for v in edge.values())).cast("array<double>").alias("f"))
    cells = X.with_differences(cells, settings).select(*config.by, F.when(F.col("_on"), made).alias("_c"), "_head")
    g = cells.groupBy(*config.by).agg(F.array_sort(F.collect_list("_c")).alias("_e"), F.first("_head", ignorenulls=True).alias("_head"))
    return g.select(*config.by, "_head.*", F.col("_e.f").alias("_e"))


def keywords(r: dict, config: GraphConfig, settings: Settings) -> dict:
    """What a numpy function gets: the frame's columns as arrays, and what follows from them."""
    finite_ = lambda m: np.nan_to_num(m, nan=1e-10, posinf=1e3, neginf=-1e3)
    kw = {c: np.asarray(v) for c, v in r.items()}
    n = len(kw["id"])
    kw["position"] = finite_(np.stack([kw[c].astype(float) for c in "xyz" if c in kw], 1))
    if "vx" in kw:
        kw["velocity"] = finite_(np.stack([kw[c].astype(float) for c in ("vx", "vy", "vz") if c in kw], 1))
    ball = np.flatnonzero(kw["team_id"] == settings.ball_id)
    carriers = np.flatnonzero(kw["is_ball_carrier"].astype(bool)) if "is_ball_carrier" in kw else []
    return kw | {
        "ball_id": settings.ball_id,
        "possession_team_id": kw["ball_owning_team_id"][0],
        "is_gk": kw["position_name"] == "GK" if "position_name" in kw else np.zeros(n, bool),
        "ball_position": kw["position"][ball[0]] if len(ball) else np.zeros(kw["position"].shape[1]),
        "ball_idx": ball if len(ball) else 0,
        "ball_carrier_idx": carriers[0] if len(carriers) else None,
        "settings": settings,
        "feature_opts": config.feature_opts,
    }


#: Frames whose matrices are held at a time.
SLICE = 256
MADE = "x array<array<double>>, e array<array<double>>, a array<array<int>>, x_shape_1 long, e_shape_1 long"


def listed(values: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Rows of ``values`` (rows, columns) as arrays of arrays, so many to each."""
    inner = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(np.ascontiguousarray(values).ravel()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rows)]).astype(np.int32)), inner)


def matrices(keep: list[str], own: list[str], n_edge: int, config: GraphConfig, settings: Settings) -> Column:
    """A struct per packed frame: a, e, and x where there are numpy functions. Frames of a size are done together.

    Numpy functions are called once per frame. Their keywords: every column of the input by name, position and velocity
    (N, 3), ball_position, ball_idx, ball_carrier_idx, is_gk, ball_id, possession_team_id, settings, feature_opts.
    Built-in columns come first, then the functions' in the order given.
    """
    own_nodes, own_edges = of_style(config.node_functions, "numpy", "node"), of_style(config.edge_functions, "numpy", "edge")
    in_cells = bool(of_style(config.edge_functions, "columns", "edge"))
    values = list(FOOTBALL_EDGE if isinstance(settings, FootballSettings) else SOCCER_EDGE) if n_edge and not in_cells else []
    carrier = "is_ball_carrier" in keep
    columns = {"team": F.col("_n.team_id").cast("array<string>"), "own": F.col("_n.ball_owning_team_id").cast("array<string>")}
    columns |= {"carries": F.col("_n.is_ball_carrier")} if carrier else {}
    columns |= {f"v_{c}": F.col(f"_n.{c}").cast("array<double>") for c in values}
    columns |= {"e": F.col("_e")} if in_cells else {}
    columns |= {"x": F.col("_n.f")} if own else {}
    columns |= {f"_{c}": F.col(f"_n.{c}") for c in own}
    given = list(columns)

    def own_features(b: dict, a: np.ndarray, x: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x and e of frames of a size, with the columns of numpy functions."""
        n = a.shape[1]
        added_x, added_e = [], []
        for k in range(len(a)):
            kw = keywords({c: b[f"_{c}"][k].values.to_numpy(zero_copy_only=False) for c in own}, config, settings)
            more_x, more_e = [], []
            for f in own_nodes:
                v = np.asarray(f(**kw), float)
                if v.shape[:1] != (n,) or v.ndim > 2:
                    raise ValueError(f"node feature {f.__name__} must return (N,) or (N, k), not {v.shape}")
                more_x.append(v.reshape(n, -1))
            for f in own_edges:
                got = f(**kw)
                for v in got if isinstance(got, tuple) else (got,):
                    v = np.asarray(v, float)
                    if v.shape != (n, n):
                        raise ValueError(f"edge feature {f.__name__} must return (N, N), not {v.shape}")
                    more_e.append(v[a[k]][:, None])
            added_x.append(np.hstack([np.empty((n, 0)), *more_x]))
            added_e.append(np.hstack([np.empty((a[k].sum(), 0)), *more_e]))
        return np.nan_to_num(np.hstack([x, np.concatenate(added_x)])), np.nan_to_num(np.hstack([e, np.concatenate(added_e)]))

    def frames_of(b: dict, n: int) -> pa.Array:
        """The structs of frames of ``n`` objects."""
        flat = lambda c: b[c].flatten().to_numpy(zero_copy_only=False)
        code = pa.concat_arrays([b["team"].flatten(), b["own"].flatten(), pa.array([settings.ball_id])]).dictionary_encode().indices
        code = code.fill_null(-1).to_numpy(zero_copy_only=False)
        team, own_code = code[:-1].reshape(2, -1, n)
        carries = flat("carries").reshape(-1, n) == True if carrier else np.zeros(team.shape, bool)  # noqa: E712  null is no carrier
        a = pairs.connected_in_numpy(config.adjacency, config.connect, team, own_code, code[-1], carries)
        cells, edges = np.nonzero(a), a.sum((1, 2))
        if in_cells:
            e = b["e"].flatten().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(cells[0]), n_edge)
        elif values:
            e = X.edges_in_numpy({c: flat(f"v_{c}").astype(float).reshape(-1, n) for c in values}, cells, team == code[-1], settings)
        else:
            e = np.empty((len(cells[0]), 0))
        x = None
        if own:
            x = b["x"].flatten().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(a.shape[0] * n, -1)
            x, e = own_features(b, a, x, e)
        every = np.full(len(a), n)
        long = lambda v: pa.array(np.full(len(a), v, np.int64))
        made = {"x": pa.nulls(len(a), pa.list_(pa.list_(pa.float64()))) if x is None else listed(x, every), "e": listed(e, edges), "a": listed(a.reshape(-1, n).astype(np.int32), every)}
        return pa.StructArray.from_arrays([*made.values(), long(0 if x is None else x.shape[1]), long(e.shape[1])], [*made, "x_shape_1", "e_shape_1"])

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch[0]), SLICE):
                b = dict(zip(given, (c.slice(at, SLICE) for c in batch), strict=True))
                size = pc.list_value_length(b["team"]).to_numpy(zero_copy_only=False)
                kinds = np.unique(size)
                if len(kinds) == 1:
                    yield frames_of(b, int(kinds[0]))
                    continue
                rows = [np.flatnonzero(size == n) for n in kinds]
                made = pa.concat_arrays([frames_of({c: v.take(pa.array(r)) for c, v in b.items()}, int(n)) for n, r in zip(kinds, rows, strict=True)])
                yield made.take(pa.array(np.argsort(np.concatenate(rows))))

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, MADE)(*columns.values())


def dimensions(graphs: DataFrame) -> DataFrame:
    """One row: most nodes, features per node, features per edge, number of graphs."""
    return graphs.agg(F.max("x_shape_0").alias("most_nodes"), F.max("x_shape_1").alias("node_features"), F.max("e_shape_1").alias("edge_features"), F.count("*").alias("graphs"))
