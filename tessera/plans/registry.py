"""Named operators, advisors and model back ends: registration, look-up, dispatch in input order, and failures as rows."""

from __future__ import annotations

import itertools
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import is_empty_advice, token_estimate
from ..sources.shared import cut
from ..sources.stored import load_version, save_version

OUTPUT_CAP, OUTPUT_DEFAULT = 10_000, 2_000
RESULT = "ord int, name string, success boolean, output string, error string"


@dataclass
class Registry:
    """Functions from DataFrames to DataFrames by name."""

    tools: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)
    available: dict[str, Callable[[], bool]] = field(default_factory=dict)
    default: str | None = None

    def register(self, name: str, tool: Callable[..., DataFrame], available: Callable[[], bool] = lambda: True) -> None:
        self.tools[name], self.available[name] = tool, available

    def register_many(self, tools: dict[str, Callable[..., DataFrame]]) -> None:
        for name, tool in tools.items():
            self.register(name, tool)

    def register_table_function(self, spark: SparkSession, name: str, tool: type, returns: str) -> None:
        """A tool that SQL can call by this name, and this registry with a table, its keys and their order."""
        register_table_function(spark, name, tool, returns)
        by = lambda cols: ", ".join(f"`{c}`" for c in cols)
        self.register(name, lambda table, keys, order: spark.sql(f"SELECT * FROM {name}(TABLE({{t}}) PARTITION BY ({by(keys)}) ORDER BY ({by(order)}))", t=table))

    def unregister(self, name: str) -> None:
        self.tools.pop(name, None)
        self.available.pop(name, None)
        self.default = None if self.default == name else self.default

    def has(self, name: str) -> bool:
        return name in self.tools

    def names(self) -> list[str]:
        return sorted(n for n in self.tools if self.available[n]())

    def get(self, name: str | None = None) -> Callable[..., DataFrame]:
        return self.tools[name or self.default]

    def run(self, spark: SparkSession, name: str, *args, cap: int = OUTPUT_DEFAULT, **kwargs) -> DataFrame:
        """ord, name, success, output, error: one row a result row (as JSON, cut to cap), or one for a failure."""
        return self.run_all(spark, [(name, args, kwargs)], cap)

    def run_all(self, spark: SparkSession, calls: Iterable[tuple[str, tuple, dict]], cap: int = OUTPUT_DEFAULT, timeout: float | None = None, at_once: int = 4) -> DataFrame:
        """All calls, `at_once` at a time, in input order; unknown and unavailable tools, exceptions and calls over `timeout` seconds become rows.

        Each call is run to its end into a table of its own, so a failure at execution is a row too
        and takes no other call with it. A call that takes too long is cancelled by its tag.
        """
        cap, calls = min(cap, OUTPUT_CAP), list(calls)

        def one(ord_: int, name: str, args: tuple, kwargs: dict) -> DataFrame:
            timer, late = None, threading.Event()
            tag = f"tool-{uuid.uuid4().hex}"

            def stop() -> None:
                late.set()
                spark.sparkContext.cancelJobsWithTag(tag)

            try:
                if name not in self.tools:
                    raise LookupError("unknown tool")
                if not self.available[name]():
                    raise LookupError("tool is not available")
                spark.sparkContext.addJobTag(tag)
                if timeout is not None:
                    timer = threading.Timer(timeout, stop)
                    timer.start()
                got = self.tools[name](*args, **kwargs)
                rows = got.select(F.lit(ord_).alias("ord"), F.lit(name).alias("name"), F.lit(True).alias("success"), F.substring(F.to_json(F.struct("*")), 1, cap).alias("output"), F.lit(None).cast("string").alias("error"))
                rows = cut(rows)
                if late.is_set():
                    raise TimeoutError
                return rows
            except Exception as exc:  # a tool's failure is a result
                said = "timeout" if late.is_set() else (str(exc).strip().splitlines() or [type(exc).__name__])[0][:cap]
                return spark.createDataFrame([(ord_, name, False, None, said)], RESULT)
            finally:
                if timer:
                    timer.cancel()
                spark.sparkContext.removeJobTag(tag)

        with ThreadPoolExecutor(max(1, at_once)) as pool:
            tasks = [pool.submit(inheritable_thread_target(spark)(one), i, *call) for i, call in enumerate(calls)]
            parts = [t.result() for t in tasks]
        out = spark.createDataFrame([], RESULT)
        for rows in parts:
            out = out.unionByName(rows)
        return out

    def chain(self, first: str, fallbacks: dict[str, str]) -> list[str]:
        """A tool and its fallbacks, each once: cycles end the chain."""
        out = []
        while first and first not in out:
            out.append(first)
            first = fallbacks.get(first)
        return [n for n in out if n in self.tools]


def register_function(spark: SparkSession, name: str, parameters: str, returns: str, body: str) -> None:
    """A named function for SQL, as an expression over its parameters: Catalyst inlines it."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")


ADVICE = "struct<critique:string,plan:string,hypotheses:array<string>,tools:array<string>,threshold:double>"


@dataclass(frozen=True)
class Advisor:
    """When it is asked (a boolean column) and what it says (a column of type ADVICE, null or empty: nothing)."""

    name: str
    triggers: Column
    advises: Column
    priority: int = 50
    requires_network: bool = False


@dataclass
class Advisors:
    """Advisors by name, over a table of contexts (one a row). All modes are projections: no shuffle, one pass."""

    members: dict[str, Advisor] = field(default_factory=dict)
    default: str | None = None
    fallbacks: dict[str, str] = field(default_factory=dict)

    def register(self, advisor: Advisor) -> None:
        self.members[advisor.name] = advisor
        self.default = self.default or advisor.name

    def unregister(self, name: str) -> None:
        self.members.pop(name, None)
        self.default = next(iter(self.members), None) if self.default == name else self.default

    def set_default(self, name: str) -> None:
        if name not in self.members:
            raise LookupError(f"unknown advisor {name}")
        self.default = name

    def has(self, name: str) -> bool:
        return name in self.members

    def names(self) -> list[str]:
        return sorted(self.members)

    def chain(self, first: str | None = None) -> list[Advisor]:
        """An advisor (the default one) and its fallbacks, each once: a cycle ends the chain."""
        out, name = [], first or self.default
        while name and name not in out:
            out.append(name)
            name = self.fallbacks.get(name)
        return [self.members[n] for n in out if n in self.members]

    def by_priority(self) -> list[Advisor]:
        return sorted(self.members.values(), key=lambda a: (a.priority, a.name))

    @staticmethod
    def _said(a: Advisor) -> Column:
        advice = a.advises.cast(ADVICE)
        return F.when(F.coalesce(a.triggers, F.lit(False)) & advice.isNotNull() & ~is_empty_advice(advice), advice)

    def first(self, contexts: DataFrame, order: Sequence[Advisor] | None = None) -> DataFrame:
        """contexts plus advisor and advice: the first in order (the default's chain) that is asked and says something."""
        order = self.chain() if order is None else order
        if not order:
            return contexts.withColumns({"advisor": F.lit(None).cast("string"), "advice": F.lit(None).cast(ADVICE)})
        found = F.coalesce(*[F.when(self._said(a).isNotNull(), F.struct(F.lit(a.name).alias("n"), self._said(a).alias("a"))) for a in order])
        return contexts.withColumn("_f", found).withColumns({"advisor": F.col("_f.n"), "advice": F.col("_f.a")}).drop("_f")

    def every(self, contexts: DataFrame) -> DataFrame:
        """contexts plus advisor and advice, a row for each advisor that is asked and says something."""
        if not self.members:
            return self.first(contexts, []).limit(0)
        said = F.array(*[F.when(self._said(a).isNotNull(), F.struct(F.lit(a.name).alias("n"), self._said(a).alias("a"))) for a in self.members.values()])
        return contexts.withColumn("_f", F.explode(F.array_compact(said))).withColumns({"advisor": F.col("_f.n"), "advice": F.col("_f.a")}).drop("_f")


class Model(Protocol):
    """A back end: run() takes texts and gives an answer for each, or an exception in an answer's place."""

    name: str
    usd_in: float
    usd_out: float

    def run(self, texts: list[str]) -> Iterator: ...


def _answers(model: Model, texts: list[str]) -> list:
    """As many answers as texts: what a back end raises, or leaves out, stands in the place of those that it didn't give."""
    out: list = []
    try:
        for answer in itertools.islice(model.run(texts), len(texts)):
            out.append(answer)
    except Exception as exc:  # a back end's failure is a result
        return out + [exc] * (len(texts) - len(out))
    return out + [LookupError("no answer")] * (len(texts) - len(out))


def with_model(rows: DataFrame, model: Model, answer: str, text_col: str = "text") -> DataFrame:
    """rows plus answer (of the type given, null where the back end failed), error, tokens_in and usd (by 1,000 tokens).

    Null texts aren't sent and have neither. The back end is called an Arrow batch at a time, so its
    memory is bounded by the batch; it must be importable on executors. An exception in an answer's
    place, one that the back end raises, answers that are missing and such of another type are errors of their rows; the others keep theirs.
    """
    cols = rows.columns
    place = cols.index(text_col)
    extra = StructType([StructField("answer", rows.sparkSession.createDataFrame([], f"answer {answer}").schema["answer"].dataType), StructField("error", StringType())])
    schema = StructType([*rows.schema.fields, *extra.fields])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(extra["answer"].dataType)

        def fits(x):
            try:
                pa.array([x], kind)
            except (pa.ArrowInvalid, pa.ArrowTypeError, pa.ArrowNotImplementedError) as exc:
                return exc
            return x

        for x in batches:
            texts = x.column(place).to_pylist()
            got = iter(_answers(model, [t for t in texts if t is not None]))
            out = [None if t is None else next(got) for t in texts]
            try:
                values = pa.array([None if isinstance(o, Exception) else o for o in out], kind)
            except (pa.ArrowInvalid, pa.ArrowTypeError, pa.ArrowNotImplementedError):
                out = [o if isinstance(o, Exception) else fits(o) for o in out]
                values = pa.array([None if isinstance(o, Exception) else o for o in out], kind)
            bad = [str(o) or type(o).__name__ if isinstance(o, Exception) else None for o in out]
            yield pa.RecordBatch.from_arrays([*x.columns, values, pa.array(bad, pa.string())], names=[*cols, "answer", "error"])

    out = rows.mapInArrow(run, schema)
    tokens = F.when(F.col(text_col).isNotNull(), token_estimate(F.col(text_col)))
    return out.withColumns({"tokens_in": tokens, "usd": tokens * F.lit(model.usd_in) / 1000})


#: Vectors that a cache keeps, and how a row of one looks: the text's SHA-256, its vector, and the number of the last call that used it.
KEPT = 8192
CACHE = "key string, embedding array<double>, used long"
#: Cells that keys of one call fall into by their first digits, when some of them must go.
CELLS = 4096


def _stay(cache: DataFrame, most: int) -> DataFrame:
    """The keys that stay, `most` at most: those of the newest calls, and of the call in which the limit falls the smallest."""
    calls = cache.groupBy("used").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("used")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    calls = calls.withColumn("room", F.lit(most) - before).where("room > 0")  # a row a call
    kept = cache.select("key", "used").join(calls, "used")
    cell = F.conv(F.substring("key", 1, 3), 16, 10).cast("int")
    edge = kept.where("n > room").withColumn("cell", cell)
    cells = edge.groupBy("cell", "room").agg(F.count("*").alias("m"))
    below = F.coalesce(F.sum("m").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("cell", (F.col("room") - below).alias("left")).where("left > 0")  # CELLS rows at most
    some = edge.join(F.broadcast(cells), "cell").withColumn("i", F.row_number().over(Window.partitionBy("cell").orderBy("key"))).where("i <= left")
    return kept.where("n <= room").select("key").unionByName(some.select("key"))


def embed(rows: DataFrame, model: Model, text_col: str = "text", cache: str | None = None, most: int = KEPT) -> DataFrame:
    """rows plus embedding and error. Equal texts are sent once: they meet by their SHA-256, and the vectors are joined back.

    cache: a folder in shared storage that keeps vectors between calls, `most` of them. What is
    there is not sent, and wins over what another call has added meanwhile. Each call marks what it
    uses; beyond `most` the vectors that were used longest ago go. Failures are not kept. A cache serves one model.
    """
    spark, key = rows.sparkSession, F.sha2(F.col(text_col), 256)
    texts = rows.select(key.alias("key"), F.col(text_col).alias("_text")).where("key IS NOT NULL").groupBy("key").agg(F.first("_text").alias("_text"))
    if cache is None:
        vectors = cut(with_model(texts, model, "array<double>", "_text").select("key", F.col("answer").alias("embedding"), "error"))
    else:
        kept = load_version(spark, cache, CACHE)
        call = (kept.agg(F.max("used")).first()[0] or 0) + 1
        texts = cut(texts)
        hits = texts.select("key").join(kept, "key").select("key", "embedding", F.lit(None).cast("string").alias("error"))
        misses = texts.join(kept.select("key"), "key", "left_anti")
        sent = with_model(misses, model, "array<double>", "_text").select("key", F.col("answer").alias("embedding"), "error")
        vectors = cut(hits.unionByName(sent))  # the back end is called here, once
        mine = vectors.where("embedding IS NOT NULL").select("key", "embedding", F.lit(call).cast("long").alias("used"))
        whole = cut(mine.unionByName(load_version(spark, cache, CACHE).join(mine.select("key"), "key", "left_anti")))
        if whole.count() > most:
            whole = whole.join(cut(_stay(whole, most)), "key", "left_semi")
        save_version(whole, cache)
    return rows.withColumn("_k", key).join(vectors.withColumnRenamed("key", "_k").hint("merge"), "_k", "left").drop("_k")


def register_table_function(spark: SparkSession, name: str, tool: type, returns: str) -> None:
    """A tool for SQL: `SELECT * FROM name(TABLE(t) PARTITION BY k ORDER BY s)`.

    tool has eval(row), called for each row, and may have terminate(), called at the end of each
    partition; both yield tuples of the type `returns`. An instance serves one partition, so what it keeps
    must be bounded, whatever the partition holds. Rows come in Arrow batches.
    """
    spark.udtf.register(name, F.udtf(tool, returnType=returns, useArrow=True))
