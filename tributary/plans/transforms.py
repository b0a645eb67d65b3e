"""Named, versioned transforms and the combinators that compose them.

A transform maps DataFrames (or Columns) to a DataFrame (or Column).  Composition builds plans only: Spark
optimizes and runs what comes out, so maps fuse, and nothing is evaluated until an action.
"""

from __future__ import annotations

import asyncio
import dataclasses
import functools
import inspect
import textwrap
import threading
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager, nullcontext
from contextvars import ContextVar
from dataclasses import dataclass, field, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.hashing import python_hash

_registry: dict[str, Transform] = {}


@dataclass(frozen=True)
class Transform:
    """A function with a name, an identity and bound arguments."""

    func: Callable[..., Any]
    name: str
    namespace: str = ""
    version: str | None = None
    bound: tuple[tuple[Any, ...], tuple[tuple[str, Any], ...]] = ((), ())
    hash_includes: tuple[Any, ...] = ()
    options: tuple[tuple[str, Any], ...] = ()
    nout: int | None = None
    source: str = field(default="", compare=False)
    context: dict[str, Any] = field(default_factory=dict, compare=False)

    @property
    def fullname(self) -> str:
        return f"{self.namespace}.{self.name}" if self.namespace else self.name

    @property
    def hash(self) -> str:
        """Of the full name, the version or else the source without decorators, what is included, and overridden options."""
        what = ["version", self.version] if self.version is not None else ["source", self.source]
        own = python_hash("Task", self.fullname, what, list(self.hash_includes), list(self.options))
        args, kwargs = self.bound
        return python_hash("Partial", own, args, kwargs) if args or kwargs else own

    def __call__(self, *args: Any, **kwargs: Any) -> Any:
        first, named = self.bound
        with context(self.context) if self.context else nullcontext():
            out = self.func(*first, *args, **(dict(named) | kwargs))
        if self.nout is not None and isinstance(out, tuple) and len(out) != self.nout:
            raise ValueError(f"{self.fullname} gave {len(out)} results, not {self.nout}")
        return out

    def partial(self, *args: Any, **kwargs: Any) -> Transform:
        first, named = self.bound
        return replace(self, bound=((*first, *args), tuple({**dict(named), **kwargs}.items())))

    def update_context(self, values: dict[str, Any]) -> Transform:
        """A transform in whose calls, and all calls inside them, these values are merged into the context."""
        return replace(self, context=merge_dicts([self.context, values]))

    def with_options(self, **options: Any) -> Transform:
        return replace(self, options=tuple(sorted({**dict(self.options), **options}.items())))


def _source(f: Callable[..., Any]) -> str:
    """Source text without decorator lines."""
    try:
        lines = textwrap.dedent(inspect.getsource(f)).splitlines(keepends=True)
    except (OSError, TypeError):
        return getattr(f, "__qualname__", repr(f))
    start = next((i for i, x in enumerate(lines) if x.startswith(("def ", "async def ", "lambda")) or "lambda" in x), 0)
    return "".join(lines[start:])


def transform(func: Callable[..., Any] | None = None, *, name: str | None = None, namespace: str = "", version: str | None = None, hash_includes: Sequence[Any] = (), nout: int | None = None) -> Any:
    """Decorator: register a function as a transform."""
    def make(f: Callable[..., Any]) -> Transform:
        t = Transform(f, name or f.__name__, namespace, version, hash_includes=tuple(hash_includes), nout=nout, source=_source(f))
        if not t.name.isidentifier():
            raise ValueError(f"{t.name!r} is no name")
        _registry[t.fullname] = t
        return t
    return make(func) if func is not None else make


def lookup(name: str | None = None, hash: str | None = None) -> Transform | None:
    """A registered transform by full name or by hash."""
    if name is not None:
        return _registry.get(name)
    return next((t for t in _registry.values() if t.hash == hash), None)


def rename(old: str, new: str) -> Transform:
    ns, _, short = new.rpartition(".")
    t = replace(_registry.pop(old), name=short, namespace=ns)
    _registry[new] = t
    return t


def as_transform(f: Callable[..., Any]) -> Transform:
    """Lift any function."""
    return f if isinstance(f, Transform) else Transform(f, f.__name__ if f.__name__.isidentifier() else "anonymous", source=_source(f))


def wraps(outer: Callable[[Transform], Callable[..., Any]]) -> Callable[[Any], Transform]:
    """Decorator factory: a new transform around a transform; its identity includes the inner one's."""
    def make(inner: Any) -> Transform:
        t = as_transform(inner)
        w = Transform(outer(t), t.name, t.namespace, hash_includes=(t.hash,), source=_source(outer))
        _registry[w.fullname] = w
        return w
    return make


def macro(func: Callable[..., Any]) -> Transform:
    """Decorator: a transform that gets the active session and its arguments as they are written: plans and quoted plans, not their
    results.  What it doesn't force is never built."""
    def run(*args: Any, **kwargs: Any) -> Any:
        spark = SparkSession.getActiveSession()
        if spark is None:
            raise RuntimeError("no active session")
        return func(spark, *args, **kwargs)
    t = Transform(run, func.__name__, source=_source(func))
    _registry[t.fullname] = t
    return t


# --- composition


def compose(*fs: Callable[..., Any]) -> Callable[..., Any]:
    """Right to left: compose(f, g)(x) is f(g(x))."""
    if not fs:
        return identity
    def run(*args: Any, **kwargs: Any) -> Any:
        out = fs[-1](*args, **kwargs)
        for f in reversed(fs[:-1]):
            out = f(out)
        return out
    return run


def identity(x: Any) -> Any:
    return x


def const(x: Any, _: Any) -> Any:
    """x, after the second argument was evaluated: a frame is run for its effects."""
    if isinstance(_, DataFrame):
        _.write.format("noop").mode("overwrite").save()
    return x


def delay(f: Callable[[], Any]) -> Callable[[], Any]:
    """Something not yet built."""
    return f


class Quoted:
    """A plan kept from being built until ``eval``; quoted ones in its arguments stay quoted."""

    def __init__(self, f: Callable[..., Any], *args: Any, **kwargs: Any) -> None:
        self.f, self.args, self.kwargs = f, args, kwargs

    def eval(self) -> Any:
        return self.f(*self.args, **self.kwargs)


quote = Quoted


def force(f: Callable[[], Any] | Quoted) -> Any:
    return f.eval() if isinstance(f, Quoted) else f()


async def value(df: DataFrame) -> list[Any]:
    """The rows of a plan, run in a thread of its own so that other coroutines go on; for results that fit the driver."""
    return await asyncio.to_thread(df.collect)


def apply_func(f: Callable[..., Any], *args: Any, **kwargs: Any) -> Any:
    return f(*args, **kwargs)


def seq(thunks: Iterable[Callable[[], Any]]) -> list[Any]:
    """Run one after the other."""
    return [t() for t in thunks]


def eval_expr(df: DataFrame, text: str, into: str, **columns: Column) -> DataFrame:
    """df with a SQL expression over named columns; only what Spark's expression parser takes, never Python source."""
    clash = set(columns) & set(df.columns)
    if clash:
        raise ValueError(f"the frame already has {sorted(clash)}")
    return df.withColumns(columns).withColumn(into, F.expr(text)).select(*df.columns, into)


# --- over columns and arrays


def map_(f: Callable[[Column], Column], values: Column | DataFrame, column: str | None = None, into: str = "value") -> Any:
    """f over an array column, or over a column of a frame; consecutive maps become one projection."""
    if isinstance(values, DataFrame):
        return values.withColumn(into, f(F.col(column)))
    return F.transform(values, f)


def starmap(f: Callable[..., Column], structs: Column, fields: Sequence[str]) -> Column:
    """f over an array of structs, each given by its fields."""
    return F.transform(structs, lambda s: f(**{n: s[n] for n in fields}))


def flatten(lists: Column) -> Column:
    """One level; a null inner list counts as empty, unlike in the built-in function."""
    return F.flatten(F.filter(lists, lambda x: x.isNotNull()))


def flat_map(f: Callable[[Column], Column], values: Column) -> Column:
    return flatten(F.transform(values, f))


def zip_(*lists: Column) -> Column:
    """Positional, as long as the shortest, unlike the built-in function, which pads with nulls."""
    n = F.least(*[F.size(x) for x in lists]) if len(lists) > 1 else F.size(lists[0])
    return F.slice(F.arrays_zip(*lists), F.lit(1), n)


def reduce_(f: Callable[[Column, Column], Column], values: Column, start: Column) -> Column:
    return F.aggregate(values, start, f)


def cond(*args: Any) -> Any:
    """cond(c, then, c2, then2, ..., otherwise): by row for Columns; a Python bool chooses a plan, and only that is built.

    Plans to choose from are given as functions without arguments.
    """
    if isinstance(args[0], Column):
        out = F.when(args[0], args[1])
        for i in range(2, len(args) - 1, 2):
            out = out.when(args[i], args[i + 1])
        return out.otherwise(args[-1]) if len(args) % 2 else out
    for i in range(0, len(args) - 1, 2):
        if args[i]:
            return args[i + 1]() if callable(args[i + 1]) else args[i + 1]
    last = args[-1] if len(args) % 2 else None
    return last() if callable(last) else last


def throw(message: Column | str) -> Column:
    return F.raise_error(message if isinstance(message, Column) else F.lit(message))


def catch(thunk: Callable[[], Any], *handlers: Any) -> Any:
    """catch(thunk, Error, recover, Error2, recover2, ...): errors of building or running a plan; a frame is run once to see them."""
    try:
        out = thunk()
        if isinstance(out, DataFrame):
            out.write.format("noop").mode("overwrite").save()
        return out
    except Exception as e:
        for kind, recover in zip(handlers[::2], handlers[1::2]):
            if isinstance(e, kind):
                return recover(e)
        raise


def catch_value(attempt: Column, recovered: Column) -> Column:
    """attempt, a ``try_`` expression that is null where it fails, and there the recovered value."""
    return F.coalesce(attempt, recovered)


def catch_all(thunks: Sequence[Callable[[], Any]], error: type[BaseException] = Exception, recover: Callable[[list[Any]], Any] | None = None) -> Any:
    """Run all, then handle what failed together: recover gets results and errors in order; without it the first error is raised."""
    out: list[Any] = []
    for t in thunks:
        try:
            out.append(t())
        except error as e:
            out.append(e)
    errors = [x for x in out if isinstance(x, BaseException)]
    if not errors:
        return out
    if recover is None:
        raise errors[0]
    return recover(out)


def split_errors(df: DataFrame, attempt: Column, into: str = "value") -> tuple[DataFrame, DataFrame]:
    """Rows for which an expression gives a value, and those for which it is null: a dead-letter split, in one scan each."""
    x = df.withColumn(into, attempt)
    return x.where(F.col(into).isNotNull()), x.where(F.col(into).isNull()).drop(into)


# --- scopes, nested values, contexts


_record = threading.local()


@contextmanager
def no_provenance() -> Iterator[None]:
    """Runs inside aren't recorded by the engine."""
    before = getattr(_record, "off", False)
    _record.off = True
    try:
        yield
    finally:
        _record.off = before


def recording() -> bool:
    return not getattr(_record, "off", False)


@contextmanager
def options(spark: SparkSession, **conf: str) -> Iterator[SparkSession]:
    """Session settings for a scope; names with dots are given with ``__`` for each dot."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield spark
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def merge_dicts(dicts: Sequence[dict]) -> dict:
    """Nested merge: the values of a key are merged if all are dicts, else the last counts."""
    values: dict[Any, list] = {}
    for d in dicts:
        for k, v in d.items():
            values.setdefault(k, []).append(v)
    return {k: merge_dicts(v) if all(isinstance(x, dict) for x in v) else v[-1] for k, v in values.items()}


def _lacks(m: Column, k: Column, v: Column) -> Column:
    return ~F.coalesce(F.map_contains_key(m, k), F.lit(False))


def merge_maps(*maps: Column) -> Column:
    """Map columns as one; of a key given twice the later value counts.  Null maps count as empty."""
    out = maps[0]
    for m in maps[1:]:
        # What the later map has goes; each step looks keys up instead of copying an array per key.
        kept = F.map_filter(out, functools.partial(_lacks, m))
        out = F.when(m.isNull(), out).when(out.isNull(), m).otherwise(F.map_concat(kept, m))
    return out


_context: ContextVar[dict] = ContextVar("context", default={})


@contextmanager
def context(values: dict[str, Any]) -> Iterator[dict]:
    """Values merged into the context for a scope."""
    token = _context.set(merge_dicts([_context.get(), values]))
    try:
        yield _context.get()
    finally:
        _context.reset(token)


def current_context(path: str, default: Any = None) -> Any:
    """The value at a dotted path of the context around."""
    return get_context(_context.get(), path, default)


def get_context(context: dict, path: str, default: Any = None) -> Any:
    """The value at a dotted path."""
    for part in path.split("."):
        if not isinstance(context, dict) or part not in context:
            return default
        context = context[part]
    return context


def context_column(context: Column, path: str, default: Column) -> Column:
    """The text at a dotted path of a JSON column."""
    return F.coalesce(F.get_json_object(context, "$." + path), default)


def iter_leaves(value: Any) -> Iterator[Any]:
    """Leaves of nested lists, tuples, sets, dicts (keys and values)."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from iter_leaves(k)
            yield from iter_leaves(v)
    elif isinstance(value, (list, tuple, set, frozenset)):
        for v in value:
            yield from iter_leaves(v)
    elif dataclasses.is_dataclass(value) and not isinstance(value, type):
        for f in dataclasses.fields(value):
            yield from iter_leaves(getattr(value, f.name))
    else:
        yield value


def map_leaves(f: Callable[[Any], Any], value: Any) -> Any:
    """The same nesting with f of each leaf."""
    if isinstance(value, dict):
        return {map_leaves(f, k): map_leaves(f, v) for k, v in value.items()}
    if isinstance(value, tuple) and hasattr(value, "_fields"):
        return type(value)(*[map_leaves(f, v) for v in value])
    if isinstance(value, (list, tuple, set, frozenset)):
        return type(value)(map_leaves(f, v) for v in value)
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return dataclasses.replace(value, **{x.name: map_leaves(f, getattr(value, x.name)) for x in dataclasses.fields(value) if x.init})
    return f(value)


def map_array_leaves(f: Callable[[Column], Column], column: Column, depth: int) -> Column:
    """f over the leaves of arrays nested depth deep."""
    return f(column) if depth == 0 else F.transform(column, lambda x: map_array_leaves(f, x, depth - 1))


# --- threads


class Forked:
    """A result being made in another thread of the same session."""

    def __init__(self, spark: SparkSession, thunk: Callable[[], Any]) -> None:
        from pyspark import InheritableThread

        self._thunk = thunk
        self._got: list[Any] = []
        self._thread = InheritableThread(target=self._run)
        self._thread.start()

    def _run(self) -> None:
        try:
            self._got.append((True, self._thunk()))
        except BaseException as e:  # noqa: BLE001
            self._got.append((False, e))

    def join(self) -> Any:
        self._thread.join()
        ok, out = self._got[0]
        if not ok:
            raise out
        return out


def fork(spark: SparkSession, thunk: Callable[[], Any]) -> Forked:
    return Forked(spark, thunk)


def join(forked: Forked) -> Any:
    return forked.join()


def subrun(spark: SparkSession, f: Callable[[SparkSession], Any], **conf: str) -> Any:
    """f in a session of its own (own settings and temporary views, same cluster)."""
    own = spark.newSession()
    for k, v in conf.items():
        own.conf.set(k.replace("__", "."), v)
    return f(own)


@functools.cache
def _wrapped(f: Callable[..., Any], kind: str) -> Any:
    return F.pandas_udf(f, kind)


def _takes_series(f: Callable[..., Any]) -> bool:
    hints = getattr(f, "__annotations__", {}).values()
    return any(h is pd.Series or (isinstance(h, str) and h.endswith("Series")) for h in hints)


def udf(f: Callable[..., Any], return_type: str = "string", vectorized: bool | None = None) -> Callable[..., Any]:
    """f as a function of columns while a session is active, else f itself.  vectorized: f takes and gives Series; by default if its annotations say so."""
    if SparkSession.getActiveSession() is None:
        return f
    return _wrapped(f, return_type) if (_takes_series(f) if vectorized is None else vectorized) else F.udf(f, return_type, useArrow=True)
