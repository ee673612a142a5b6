"""Flows: a DataFrame together with the total order that makes it a sequence, and metadata that travels along."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import stored


@dataclass(frozen=True)
class Flow:
    """Items in the order of `order`: column names, a leading '-' for descending. The columns must order the items totally; ties leave
    position-dependent results open. Nulls come first ascending and last descending, as Spark sorts."""

    df: DataFrame
    order: tuple[str, ...] = ()
    meta: dict[str, Any] = field(default_factory=dict)

    def sort_columns(self) -> list[Column]:
        return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in self.order]

    def with_df(self, df: DataFrame, order: tuple[str, ...] | None = None) -> Flow:
        return replace(self, df=df, order=self.order if order is None else tuple(order))

    def need_order(self) -> None:
        if self.df.isStreaming:
            raise ValueError("positions need a finite flow; this one is a stream")
        if not self.order:
            raise ValueError("the flow has no order; sort it first")

    # metadata, as nodes forward and fetch it
    def forward(self, key: str, value: Any) -> Flow:
        return replace(self, meta={**self.meta, key: value})

    def can_fetch(self, key: str) -> bool:
        return key in self.meta

    def fetch(self, key: str, kind: type | None = None) -> Any:
        """The value forwarded under a key; a missing key or a value of another type raises."""
        if key not in self.meta:
            raise KeyError(f"nothing was forwarded under {key!r}")
        if kind is not None and not isinstance(self.meta[key], kind):
            raise TypeError(f"{key!r} holds {type(self.meta[key]).__name__}, not {kind.__name__}")
        return self.meta[key]


def inverted(order: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(c[1:] if c.startswith("-") else f"-{c}" for c in order)


Node = Callable[[Flow], Any]


class Pipe:
    """Nodes composed with `|`.

    A begin makes a flow from nothing, a middle turns a flow into a flow, an end consumes it. begin | middle is a begin, middle | middle a
    middle, middle | end an end and begin | end a pipeline, which runs when called.
    """

    def __init__(self, run: Callable[..., Any], kind: str = "middle", name: str = "", steps: tuple[str, ...] = ()):
        if kind not in ("begin", "middle", "end", "pipeline"):
            raise ValueError(f"no such kind of pipe: {kind}")
        self.run, self.kind = run, kind
        self.steps = steps or (name or getattr(run, "__name__", "node"),)

    def __or__(self, other: Pipe) -> Pipe:
        kinds = {("begin", "middle"): "begin", ("middle", "middle"): "middle", ("middle", "end"): "end", ("begin", "end"): "pipeline"}
        kind = kinds.get((self.kind, other.kind))
        if kind is None:
            raise TypeError(f"a {other.kind} can't follow a {self.kind}")
        first, then = self.run, other.run
        whole = (lambda: then(first())) if self.kind == "begin" else (lambda flow: then(first(flow)))
        return Pipe(whole, kind, steps=self.steps + other.steps)

    def __call__(self, *args: Any) -> Any:
        return self.run(*args)

    def to_dot(self) -> str:
        """The nodes and their edges for GraphViz."""
        nodes = [f'  n{i} [label="{s}"];' for i, s in enumerate(self.steps)]
        edges = [f"  n{i} -> n{i + 1};" for i in range(len(self.steps) - 1)]
        return "\n".join(["digraph pipeline {", *nodes, *edges, "}"])


def begin(make: Callable[[], Flow], name: str = "") -> Pipe:
    return Pipe(make, "begin", name)


def middle(node: Node, name: str = "") -> Pipe:
    return Pipe(node, "middle", name)


def end(node: Node, name: str = "") -> Pipe:
    return Pipe(node, "end", name)


def identity() -> Pipe:
    """The empty middle: what an unassigned chunk stands for."""
    return middle(lambda flow: flow, "identity")


def chunk_if(flag: bool, pipe: Pipe) -> Pipe:
    """The pipe if the flag is set, else the identity."""
    return pipe if flag else identity()


def chunk_end_if(flag: bool, pipe: Pipe, otherwise: Pipe | None = None) -> Pipe:
    """The end if the flag is set, else the other end; without one, an end that gives the flow back."""
    return pipe if flag else otherwise or end(lambda flow: flow, "end")


def checked(pipe: Pipe | None, kind: str) -> Pipe:
    """A virtual chunk: a pipe of the kind that is asked for. One that isn't assigned is the identity, which only a middle can be."""
    if pipe is None:
        if kind != "middle":
            raise TypeError(f"an unassigned chunk can't be a {kind}")
        return identity()
    if pipe.kind != kind:
        raise TypeError(f"the chunk is a {pipe.kind}, not a {kind}")
    return pipe


def vfork(out: Pipe | None, side: Pipe | None) -> Pipe:
    """The flow goes on through `out`, and, where `side` is assigned, whole into that end as well. What the end gives is forwarded as "forked"."""

    def run(flow: Flow) -> Flow:
        if side is None:
            return checked(out, "middle")(flow)
        given = checked(side, "end")(flow)
        return checked(out, "middle")(flow).forward("forked", given)

    return middle(run, "vfork")


class Shared:
    """Data structures by name that pipelines share: one phase fills a structure, a later one reads it or adds to it.

    A structure is a written table, so that readers see what was there when the plan was made, and lost executors lose nothing.
    """

    def __init__(self) -> None:
        self._held: dict[str, Flow] = {}

    def put(self, name: str) -> Pipe:
        """An end that fills a structure, or adds items of the same columns to it."""

        def run(flow: Flow) -> Flow:
            held = self._held.get(name)
            whole = flow if held is None else held.with_df(held.df.unionByName(flow.df))
            self._held[name] = whole.with_df(stored(whole.df, "shared"))
            return self._held[name]

        return end(run, f"put {name}")

    def get(self, name: str) -> Flow:
        if name not in self._held:
            raise KeyError(f"no structure {name!r} was filled")
        return self._held[name]

    def source(self, name: str) -> Pipe:
        """A begin that gives a structure's items; it is looked up when the pipeline runs."""
        return begin(lambda: self.get(name), f"get {name}")


def preparer(hook: Callable[[Flow], None]) -> Pipe:
    """Identity that calls a hook when the plan is made."""

    def run(flow: Flow) -> Flow:
        hook(flow)
        return flow

    return middle(run, "preparer")


def forwarder(key: str, value: Any) -> Pipe:
    return middle(lambda flow: flow.forward(key, value), f"forward {key}")


def parallel(pipe: Pipe, jobs: int | None = None) -> Pipe:
    """Run a pipe on `jobs` partitions. Order lies in the order columns, so that any dealing of rows maintains it."""
    return middle(lambda flow: pipe(flow.with_df(flow.df.repartition(jobs) if jobs else flow.df)), "parallel")


def order_before(*pipelines: Pipe) -> list[Any]:
    """Run pipelines one after another."""
    return [p() for p in pipelines]
