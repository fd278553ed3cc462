"""Architecture analytics over symbols: patterns, interfaces, decisions, comparison.

symbols: file_path, name, kind, parent, visibility, start_line, end_line.  A
detector returns rows (pattern, file_path, symbol, role), one per piece of
evidence; ``patterns`` sums them up.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Detector = Callable[[DataFrame], DataFrame]
DETECTORS: dict[str, Detector] = {}

# What comparisons look for, by dimension.
DIMENSIONS = {
    "api_surface": "api endpoint route handler controller view resource".split(),
    "concurrency": "async thread lock queue pool concurrent parallel".split(),
    "configuration": "config settings env environment options configuration".split(),
    "error_handling": "error_handler custom_exception exception error result_type".split(),
    "state_management": "singleton repository registry cache store state session".split(),
    "testing": "test fixture mock assert spec setup teardown".split(),
}
MIN_DECISION = 0.5
#: Named patterns and what could stand in their place; any other has the default of ``decisions``.
ALTERNATIVES = {
    "middleware_chain": ["Decorators", "Event bus"], "plugin_system": ["Static imports", "Entry points"], "event_bus": ["Direct calls", "Message queue"],
    "repository": ["Active record", "Direct queries"], "strategy": ["Conditional branches", "Template method"],
}
_MARKS = re.compile(r"[,()\[\]{}]")


def detector(name: str) -> Callable[[Detector], Detector]:
    """Register a detector; patterns() runs all in this order."""

    def wrap(f: Detector) -> Detector:
        DETECTORS[name] = f
        return f

    return wrap


def confidence(n: Column) -> Column:
    return F.when(n >= 3, 0.85).when(n == 2, 0.60).when(n == 1, 0.30).otherwise(0.0)


def named(name: Column, keys: str) -> Column:
    return F.lower(name).rlike("|".join(keys.split()))


def classes(symbols: DataFrame) -> DataFrame:
    """file_path, symbol, parent, methods (lower-case names of public ones), shown (names as written), n_own: one row per class."""
    cls = symbols.where("kind = 'class'").select("file_path", F.col("name").alias("symbol"), "parent")
    dunder = F.col("name").startswith("__") & F.col("name").endswith("__")
    public = F.col("visibility") == "public"
    methods = symbols.where("kind = 'method'").groupBy("file_path", F.col("parent").alias("symbol")).agg(
        F.collect_set(F.when(public, F.lower("name"))).alias("methods"),
        F.collect_set(F.when(public & ~dunder, F.col("name"))).alias("shown"),
        F.collect_set(F.when(~dunder, F.col("name"))).alias("own"),
        F.count(F.when(~dunder, 1)).alias("n_own"),
    )
    out = cls.join(methods, ["file_path", "symbol"], "left")
    empty = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, empty) for c in ("methods", "shown", "own")} | {"n_own": F.coalesce("n_own", F.lit(0))})


def has(*names: str) -> Column:
    return F.arrays_overlap("methods", F.array(*map(F.lit, names)))


@detector("middleware_chain")
def middleware(symbols: DataFrame) -> DataFrame:
    rows = classes(symbols).withColumns({"full": has("set_next", "next") & has("process", "handle"), "works": has("process", "handle")})
    rows = rows.withColumn("chain", F.max("full").over(Window.partitionBy("file_path")))
    part = F.col("works") & (named(F.col("symbol"), "middleware handler chain filter interceptor") | F.col("chain"))
    return rows.where(F.col("full") | part).select("file_path", "symbol", F.when(F.col("full"), "chain").otherwise("participant").alias("role"))


@detector("plugin_system")
def plugins(symbols: DataFrame) -> DataFrame:
    rows = classes(symbols)
    registry = has("register", "unregister") & (has("get", "all") | named(F.col("symbol"), "registry manager store"))
    contract = F.col("parent").isNull() & named(F.col("symbol"), "plugin extension handler")
    return rows.where(registry | contract).select("file_path", "symbol", F.when(registry, "registry").otherwise("contract").alias("role")).dropDuplicates(["file_path", "symbol"])


@detector("event_bus")
def event_bus(symbols: DataFrame) -> DataFrame:
    subscribe, emit = "subscribe on listen add_listener add_handler".split(), "emit publish dispatch trigger fire send".split()
    rows = classes(symbols).withColumns({"s": F.array_intersect("methods", F.array(*map(F.lit, subscribe))), "e": has(*emit)})
    lone = (F.size("s") == 1) & F.array_contains("s", "on") & ~named(F.col("symbol"), "event bus emitter dispatcher listener")
    rows = rows.where(((F.size("s") > 0) | F.col("e")) & ~lone)
    return rows.select("file_path", "symbol", F.when((F.size("s") > 0) & F.col("e"), "bus").when(F.size("s") > 0, "subscriber").otherwise("emitter").alias("role"))


@detector("repository")
def repository(symbols: DataFrame) -> DataFrame:
    crud = "get find save create update delete all list fetch".split()
    rows = classes(symbols).withColumn("n", F.size(F.array_intersect("methods", F.array(*map(F.lit, crud)))))
    return rows.where((F.col("n") >= 3) | ((F.col("n") >= 2) & named(F.col("symbol"), "repo dao store data"))).select("file_path", "symbol", F.lit("repository").alias("role"))


@detector("strategy")
def strategy(symbols: DataFrame) -> DataFrame:
    """Classes of a file that share a method, with a protocol or a context among them."""
    rows = classes(symbols)
    shared = rows.select("file_path", "symbol", F.explode("shown").alias("m")).groupBy("file_path", "m").agg(F.count("*").alias("n")).where("n > 1")
    shared = shared.groupBy("file_path").agg(F.collect_set("m").alias("shared"))
    rows = rows.join(shared, "file_path")
    context = named(F.col("symbol"), "context executor runner engine sorter dispatcher") & (F.col("n_own") >= 1)
    protocol = named(F.col("symbol"), "strategy policy algorithm interface protocol") & (F.col("n_own") <= 3)
    rows = rows.withColumn("role", F.when(context, "context").when(protocol, "protocol").when(F.arrays_overlap("shown", "shared"), "concrete"))
    file = Window.partitionBy("file_path")
    rows = rows.withColumns({
        "protocols": F.count(F.when(F.col("role") == "protocol", 1)).over(file), "contexts": F.count(F.when(F.col("role") == "context", 1)).over(file),
        "concretes": F.count(F.when(F.col("role") == "concrete", 1)).over(file), "asked": F.flatten(F.collect_list(F.when(F.col("role") == "protocol", F.col("own"))).over(file)),
    })
    # no class shares a method by name: those that have a protocol's methods count
    rows = rows.withColumn("role", F.when(F.col("role").isNull() & (F.col("concretes") == 0) & F.arrays_overlap("shown", "asked"), "concrete").otherwise(F.col("role")))
    rows = rows.withColumn("concretes", F.count(F.when(F.col("role") == "concrete", 1)).over(file))
    return rows.where((F.col("concretes") > 0) & ((F.col("protocols") > 0) | (F.col("contexts") > 0)) & F.col("role").isNotNull()).select("file_path", "symbol", "role").dropDuplicates(["file_path", "symbol"])


def evidence(symbols: DataFrame, names: list[str] | None = None) -> DataFrame:
    out = None
    for name in names or list(DETECTORS):
        rows = DETECTORS[name](symbols).select(F.lit(name).alias("pattern"), "file_path", "symbol", "role")
        out = rows if out is None else out.unionByName(rows)
    return out


def patterns(symbols: DataFrame, names: list[str] | None = None) -> DataFrame:
    """pattern, n, confidence of what was found."""
    return evidence(symbols, names).groupBy("pattern").agg(F.count("*").alias("n")).withColumn("confidence", confidence(F.col("n")))


def verified(confidence_: Column, ratio: Column) -> Column:
    """Confidence after an outside check of the evidence: up by 0.10 (one at most), down by 0.15 where none holds."""
    return F.when(ratio >= 0.5, F.least(confidence_ + 0.10, F.lit(1.0))).when(ratio == 0, confidence_ - 0.15).otherwise(confidence_)


def return_type(signature: Column) -> Column:
    return F.when(F.contains(signature, F.lit("->")), F.trim(F.regexp_replace(F.substring_index(signature, "->", -1), r":\s*$", "")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_outside(texts: pd.Series) -> pd.Series:
    """Parts of each text at the commas outside of brackets, in one walk over the brackets and commas."""

    def parts(text: str | None) -> list[str]:
        out, depth, at = [], 0, 0
        for m in _MARKS.finditer(text or ""):
            if m[0] == ",":
                if not depth:
                    out.append(text[at : m.start()])
                    at = m.end()
            else:
                depth += 1 if m[0] in "([{" else -1
        return [*out, (text or "")[at:]]

    return texts.map(parts)


def parameters(signature: Column) -> Column:
    """array of (name, type, default, required) from the text in the outer brackets of a signature; commas inside brackets do not split."""
    inner = F.regexp_extract(signature, r"(?s)\((.*)\)", 1)
    parts = F.filter(F.transform(split_outside(inner), lambda p: F.trim(p)), lambda p: (p != "") & ~p.isin("self", "cls", "*", "/", "*args", "**kwargs"))
    pattern = r"^\*{0,2}(\w+)\s*(?::\s*([^=]+?))?\s*(?:=\s*(.+))?$"
    field = lambda p, i: F.nullif(F.regexp_extract(p, pattern, i), F.lit(""))
    return F.transform(parts, lambda p: F.struct(field(p, 1).alias("name"), field(p, 2).alias("type"), field(p, 3).alias("default"), field(p, 3).isNull().alias("required")))


def decisions(found: DataFrame, known: DataFrame) -> DataFrame:
    """Patterns of enough confidence with their alternatives (a default where none is known). known: pattern, alternatives."""
    rows = found.where(F.col("confidence") >= MIN_DECISION).join(known, "pattern", "left")
    return rows.withColumn("alternatives", F.coalesce("alternatives", F.array(F.lit("Custom implementation"))))


def known_alternatives(spark) -> DataFrame:
    """pattern, alternatives."""
    return spark.createDataFrame(list(ALTERNATIVES.items()), "pattern string, alternatives array<string>")


def unsupported(asked: DataFrame) -> DataFrame:
    """The dimensions asked that comparisons do not know."""
    return asked.select("dimension").distinct().where(~F.col("dimension").isin(*DIMENSIONS))


def dimension_evidence(items: DataFrame, text: str = "text") -> DataFrame:
    """items and dimension: one row per dimension whose keywords stand in the text."""
    hits = F.array_compact(F.array(*[F.when(F.lower(text).rlike("|".join(k)), F.lit(d)) for d, k in DIMENSIONS.items()]))
    return items.withColumn("dimension", F.explode(hits))


def trade_off(a: Column, b: Column) -> Column:
    return (
        F.when((a == 0) & (b == 0), "neither").when(a == 0, "only b").when(b == 0, "only a")
        .when(a > 2 * b, "a has more").when(b > 2 * a, "b has more").otherwise("comparable")
    )
