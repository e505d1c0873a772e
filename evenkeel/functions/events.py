"""Looking into event documents of any depth: their objects, and values by path, as variants.

A document's objects are found level by level: each is a row, and a step replaces what is not yet
opened by what lies in it. Values are looked up in the *roots* of an object: the object itself, and
the JSON texts that it boxes in ``payload`` or ``data``, to any depth. The objects are written once,
and the write counts what is still to be opened: documents deeper than the steps taken get more
steps in another pass. All of it is Column expressions; nothing visits Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from evenkeel.functions.json import let, name_variants
from evenkeel.session import spread, written

# Where events keep their content, their orders, an order's status and its id.
BOXES = ("payload", "data")
ORDERS = "orders"
STATUS_FIELDS = ("orderStatus", "status", "order_status")
ID_FIELDS = ("orderId", "order_id")

MAP, LIST = "map<string,variant>", "array<variant>"


def as_map(v: Column) -> Column:
    return F.try_variant_get(v, "$", MAP)


def as_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", LIST)


def _present(v: Column) -> Column:
    """A JSON null is a missing value."""
    return F.when(~F.is_variant_null(v), v)


def _scalar(v: Column) -> Column:
    """Text of a value that is neither an object nor a list; null for those."""
    return F.when(as_map(v).isNull() & as_list(v).isNull(), F.try_variant_get(v, "$", "string"))


def _text(v: Column) -> Column:
    return F.coalesce(_scalar(v), F.to_json(v))


def _boxed(v: Column) -> Column:
    """The document in a text that holds an object or a list."""
    return let(F.try_parse_json(_scalar(v)), lambda d: F.when(as_map(d).isNotNull() | as_list(d).isNotNull(), d))


def _field(m: Column, names: Column, name: str) -> Column:
    """A field of a map of fields: by its name, its snake or camel form, else in any case (``names`` are in lower case)."""
    forms = name_variants(name)
    at = [F.nullif(F.array_position(names, f), F.lit(0)) for f in dict.fromkeys(x.lower() for x in forms)]
    loose = F.get(F.map_values(m), ((F.least(*at) if len(at) > 1 else at[0]) - 1).cast("int"))
    return F.coalesce(*[_present(m[form]) for form in forms], _present(loose))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions read as values: an explode of one row keeps the planner from
    writing their expressions into every place that names them."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _below(v: Column, unwrap: bool) -> Column:
    """What an entry holds that rules look at: elements of a list; boxed texts, ``data`` and ``orders`` of an object."""
    def children(m: Column) -> Column:
        boxes = [_boxed(m[b]) for b in BOXES] if unwrap else []
        orders = F.when(as_list(m[ORDERS]).isNotNull() | F.lit(not unwrap), _present(m[ORDERS]))
        inner = [F.when(as_map(x).isNotNull() | as_list(x).isNotNull(), x) for x in (_present(m["data"]), orders)]
        return F.filter(F.array(*boxes, *inner), lambda x: x.isNotNull())

    return F.coalesce(as_list(v), let(as_map(v), lambda m: F.when(m.isNotNull(), children(m))), F.array().cast(LIST))


def _objects(events: DataFrame, payload: str, unwrap: bool, levels: int) -> DataFrame:
    """A row per object found in ``levels`` steps, as ``__node``, and rows with ``__open`` for what is left to be opened."""
    def opened(n: Column) -> Column:
        own = F.when(as_map(n["v"]).isNotNull(), F.array(F.struct(F.lit(False).alias("open"), n["v"].alias("v"))))
        return F.concat(F.coalesce(own, F.array().cast("array<struct<open:boolean,v:variant>>")),
                        F.transform(_below(n["v"], unwrap), lambda c: F.struct(F.lit(True).alias("open"), c.alias("v"))))

    kept = [F.col(f"`{c}`") for c in events.columns]
    rows = _once(spread(events), __n=F.struct(F.lit(True).alias("open"), F.try_parse_json(F.col(f"`{payload}`")).alias("v")))
    for _ in range(levels):
        rows = rows.select(*kept, F.explode(F.when(F.col("__n")["open"], opened(F.col("__n"))).otherwise(F.array("__n"))).alias("__n"))
    nested = F.col("__n")["open"] & (as_map(F.col("__n")["v"]).isNotNull() | as_list(F.col("__n")["v"]).isNotNull())
    rows = rows.select(*kept, F.col("__n")["v"].alias("__node"), F.col("__n")["open"].alias("__closed"), nested.alias("__open"))
    return rows.where(~F.col("__closed") | F.col("__open")).drop("__closed")


#: Levels of documents, and of JSON texts in JSON texts, that are opened at first; deeper ones take another pass.
LEVELS, BOXED = 6, 2


def _whole(make: Callable[[int], DataFrame], levels: int) -> DataFrame:
    """Write the rows of ``make(levels)`` once; again with twice the levels if any has something left to be opened.

    The write itself counts what is left, so documents of ordinary depth take one job.
    """
    while True:
        left = Observation()
        found = written(make(levels).observe(left, F.count_if("__open").alias("open")), "objects")
        if not left.get["open"]:
            return found.drop("__open")
        levels *= 2


def object_rows(events: DataFrame, payload: str, unwrap: bool = True) -> DataFrame:
    """A row per object that rules look at, with the event's columns and the object as ``__node``.

    Those are the elements of lists, ``data`` and ``orders`` below an object, and, with
    ``unwrap``, JSON kept as text in ``payload`` or ``data``. A text that is not JSON has none.
    """
    return _whole(lambda levels: _objects(events, payload, unwrap, levels), LEVELS)


def _steps(path: str) -> list[str]:
    return [part.strip() for part in re.split(r"[.\[\]]", path) if part.strip()]


def _with_roots(df: DataFrame, node: str, levels: int) -> DataFrame:
    """Add ``__roots``: the object and the JSON texts that it boxes, each with a rank, and ``__open``.

    The rank says in which order answers count: by name before what is boxed, by path after.
    """
    def boxes(root: Column) -> Column:
        inside = [_boxed(F.try_variant_get(root["v"], f"$.{b}", "variant")) for b in BOXES]
        found = F.array(*[F.struct(F.concat(root["rank"], F.lit(mark)).alias("rank"), x.alias("v")) for mark, x in zip("ab", inside)])
        return F.filter(found, lambda r: r["v"].isNotNull())

    roots = "array<struct<rank:string,v:variant>>"
    start = F.when(F.col(node).isNotNull(), F.array(F.struct(F.lit("").alias("rank"), F.col(node).alias("v"))))
    df = _once(df, __roots=F.array().cast(roots), __left=F.coalesce(start, F.array().cast(roots)))
    for _ in range(levels):
        df = _once(df, __roots=F.concat("__roots", "__left"), __left=F.flatten(F.transform("__left", boxes)))
    return df.withColumn("__open", F.size("__left") > 0).drop("__left")


def _opened(df: DataFrame, sources: dict[str, str]) -> DataFrame:
    """Add, for each tag and its column, the column's fields and those of the objects in its boxes, as maps
    and as names in lower case."""
    df = _once(df, **{f"{tag}m0": as_map(F.col(source)) for tag, source in sources.items()})
    df = _once(df, **{f"{tag}m{i}": as_map(_present(F.col(f"{tag}m0")[b])) for tag in sources for i, b in enumerate(BOXES, 1)})
    names = lambda m: F.split(F.lower(F.array_join(F.map_keys(m), "\x1f")), "\x1f")
    return _once(df, **{f"{tag}n{i}": names(F.col(f"{tag}m{i}")) for tag in sources for i in range(3)})


def _named(tag: str, name: str) -> list[Column]:
    return [_field(F.col(f"{tag}m{i}"), F.col(f"{tag}n{i}"), name) for i in range(3)]


def _entered(df: DataFrame, sources: dict[str, str]) -> DataFrame:
    """``_opened`` for what a name of a path is looked up in: first elements of lists, and a boxed ``payload``."""
    def first(df: DataFrame) -> DataFrame:
        for _ in range(2):  # lists in lists are opened twice
            df = _once(df, **{f"{tag}v": F.coalesce(F.get(as_list(F.col(f"{tag}v")), F.lit(0)), F.when(
                as_list(F.col(f"{tag}v")).isNull(), F.col(f"{tag}v"))) for tag in sources})
        return df

    df = first(df.withColumns({f"{tag}v": F.col(source) for tag, source in sources.items()}))
    df = _once(df, **{f"{tag}p": F.try_parse_json(_scalar(F.try_variant_get(f"{tag}v", "$.payload", "variant"))) for tag in sources})
    nested = lambda p: as_map(p).isNotNull() | as_list(p).isNotNull()
    df = df.withColumns({f"{tag}v": F.when(nested(F.col(f"{tag}p")), F.col(f"{tag}p")).otherwise(F.col(f"{tag}v")) for tag in sources})
    df = first(df).drop(*[f"{tag}p" for tag in sources])
    return _opened(df, {tag: f"{tag}v" for tag in sources}).drop(*[f"{tag}v" for tag in sources])


def _with_values(df: DataFrame, paths: Sequence[str], out: str, keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` of the rows, and ``out``: the texts at ``paths`` from their roots.

    A text is looked for by name in the object, then in the objects in its ``payload`` and
    ``data``, then in JSON texts there in the same way, then by following the path. Each root
    is a row while it is looked at; what they say is put together by the row they come from.
    """
    wanted = {k: p for k, p in enumerate(p.strip() for p in paths) if p}
    rows = df.withColumn("__id", F.monotonically_increasing_id())
    rows = rows.select(*[F.col(f"`{c}`") for c in keep], "__id", F.explode_outer("__roots").alias("__r"))
    rows = rows.withColumns({"__rank": F.col("__r")["rank"], "__v": F.col("__r")["v"]}).drop("__r")
    rows = _opened(rows, {"__o": "__v"})
    if wanted:
        rows = _once(rows, **{f"__x{k}_{i}": x for k, p in wanted.items() for i, x in enumerate(_named("__o", p))})
        rows = _once(rows, **{f"__q{k}": F.coalesce(*[F.nullif(_scalar(F.col(f"__x{k}_{i}")), F.lit("")) for i in range(3)]) for k in wanted})
        rows = rows.drop(*[c for c in rows.columns if c.startswith(("__x", "__o"))]).withColumns({f"__w{k}": F.col("__v") for k in wanted})
    # All paths take their steps together; the first step of all starts at the root.
    steps = {k: _steps(p) for k, p in wanted.items()}
    for i in range(max(map(len, steps.values()), default=0)):
        taking = {k: x[i] for k, x in steps.items() if len(x) > i}
        tags = {k: f"__s{k}" if i else "__s" for k in taking}
        rows = _entered(rows, {tags[k]: f"__w{k}" for k in taking} if i else {"__s": "__v"})

        def taken(k: int, step: str) -> Column:
            """An index of a list, or a name."""
            found, items = F.coalesce(*_named(tags[k], step)), as_list(F.col(f"__w{k}"))
            return F.when(F.size(items) > int(step), F.get(items, F.lit(int(step)))).otherwise(found) if step.isdigit() else found

        rows = _once(rows, **{f"__w{k}": taken(k, step) for k, step in taking.items()})
        rows = rows.drop(*[c for c in rows.columns if c.startswith("__s")])
    if wanted:
        # At the end of a path, a list stands for its first element, unless that is nested.
        rows = _once(rows, **{f"__l{k}": as_list(F.col(f"__w{k}")) for k in wanted})
        rows = _once(rows, **{f"__e{k}": F.nullif(F.when(F.size(f"__l{k}") > 0, _scalar(F.get(f"__l{k}", F.lit(0)))).otherwise(
            _text(F.col(f"__w{k}"))), F.lit("")) for k in wanted})
    best = []
    for k in wanted:
        for mark, name in (("0", f"__q{k}"), ("z", f"__e{k}")):
            answer = F.when(F.col(name).isNotNull(), F.struct(F.concat("__rank", F.lit(mark)).alias("rank"), F.col(name).alias("text")))
            best.append(F.min(answer).alias(name))
    whole = rows.groupBy("__id").agg(*[F.first(F.col(f"`{c}`")).alias(c) for c in keep], *best)
    texts = [F.coalesce(F.least(f"__q{k}", f"__e{k}")["text"], F.lit("")) if k in wanted else F.lit("") for k in range(len(paths))]
    return whole.select(*[F.col(f"`{c}`") for c in keep], F.array(*texts).cast("array<string>").alias(out))


def node_values(events: DataFrame, payload: str, paths: Sequence[str]) -> DataFrame:
    """One row per object of an event: its columns, the object as JSON ``node``, its texts ``values``."""
    def rooted(levels: int) -> DataFrame:
        found = _objects(events, payload, True, levels).withColumnRenamed("__open", "__deep")
        roots = _with_roots(found, "__node", max(1, levels * BOXED // LEVELS))
        return roots.withColumn("__open", F.col("__open") | F.col("__deep")).drop("__deep")

    found = _whole(rooted, LEVELS).withColumn("node", F.to_json("__node"))
    return _with_values(found, paths, "values", [*events.columns, "node"]).select(*[F.col(f"`{c}`") for c in events.columns], "node", "values")


def path_values(events: DataFrame, payload: str, paths: dict[str, str]) -> DataFrame:
    """The events with the text at a path of the whole document in each named column, or empty."""
    doc = F.try_parse_json(F.col(f"`{payload}`"))
    whole = _once(spread(events), __doc=let(doc, lambda v: F.when(as_map(v).isNotNull() | as_list(v).isNotNull(), v)))
    found = _whole(lambda levels: _with_roots(whole, "__doc", levels), BOXED)
    found = _with_values(found, list(paths.values()), "__values", events.columns)
    return found.withColumns({name: F.col("__values")[i] for i, name in enumerate(paths)}).drop("__values")


def order_rows(events: DataFrame, payload: str) -> DataFrame:
    """``status`` and ``order_id`` of every object of the events that carries an order id.

    Fields are those of the object in ``payload`` if there is one, else the object's own.
    """
    def first(*places: Column) -> Column:
        return F.trim(F.coalesce(*[let(_present(p), lambda x: F.when(x.isNotNull(), _text(x))) for p in places], F.lit("")))

    def pair(v: Column) -> Column:
        return let(as_map(v), lambda m: let(F.coalesce(as_map(m["payload"]), m), lambda body: F.struct(
            first(*[body[n] for n in STATUS_FIELDS], m[STATUS_FIELDS[0]]).alias("status"),
            first(*[body[n] for n in ID_FIELDS], *[m[n] for n in ID_FIELDS]).alias("order_id"))))

    found = object_rows(events.select(payload), payload, unwrap=False)
    return found.select(pair(F.col("__node")).alias("o")).select("o.*").filter(F.col("order_id") != "")
