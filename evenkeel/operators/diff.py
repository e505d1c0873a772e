"""Row and cell comparison of two frames, and the plan that brings them in line."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from evenkeel.functions.equality import cell_text, is_nested, key_text, norm_eq
from evenkeel.operators.skew import hot_keys, join_unique

MATCH, DIFFERENT, SOURCE_ONLY, TARGET_ONLY = "MATCH", "DIFFERENT", "SOURCE_ONLY", "TARGET_ONLY"
ROW_NUMBER = "__rn__"

# What a null key reads as, and the mark between key parts.
NULL_KEY = "\u0001NULL\u0001"
KEY_MARK = "\u0000"


@dataclass(frozen=True)
class DiffSpec:
    """How to compare: keys, hidden columns, order of duplicates, and plan choices.

    ``unique_keys`` states that the source holds each key once and no target key is
    hot; the comparison is then one full outer join without duplicate handling. It
    is taken for granted for keys the table declares.
    """

    keys: Sequence[str] = ()
    declared_keys: Sequence[str] = ()
    exclude: Sequence[str] = ()
    sort: Sequence[str] = ()
    return_matched: bool = True
    numeric: str = "double"
    unique_keys: bool = False
    hot_key_args: Mapping[str, float] = field(default_factory=dict)


# ---------------------------------------------------------------- columns, keys

def compared_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    hidden = {name.strip().lower() for name in exclude if name and name.strip()} | {ROW_NUMBER}
    return [name for name in df.columns if name.lower() not in hidden]


def exclude_columns(df: DataFrame, exclude: Iterable[str]) -> DataFrame:
    """Drop columns by name, trimmed and ignoring case; also the row-number helper."""
    return df.select(*[F.col(f"`{name}`") for name in compared_columns(df, exclude)])


def resolve_keys(spec: DiffSpec, df: DataFrame) -> list[str]:
    """Given keys, else declared keys, else sort columns, else every compared column."""
    wanted = list(spec.keys) or list(spec.declared_keys) or list(spec.sort)
    wanted = wanted or compared_columns(df, spec.exclude)
    exact = {name.lower(): name for name in reversed(df.columns)}
    missing = [name for name in wanted if name.lower() not in exact]
    if missing:
        raise ValueError(f"key columns not found: {missing}")
    return [exact[name.lower()] for name in wanted]


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def _target_names(source_cols: Sequence[str], target: DataFrame) -> dict[str, str | None]:
    by_lower = {name.lower(): name for name in reversed(target.columns)}
    return {name: by_lower.get(name.lower()) for name in source_cols}


NUMERIC = "evenkeel.numeric"
_BITS = 30  # null flags of this many key columns fit one int
# Types whose values are equal exactly when their texts are.
_NATIVE_KEYS = (T.IntegralType, T.StringType, T.DateType, T.BooleanType)


def _key_parts(df: DataFrame, names: Sequence[str | None], native: Sequence[bool]) -> list[Column]:
    """Join columns ``__k0..`` without nulls plus ``__kn``, which keeps null and
    default apart, so plain equality matches nulls and grouping and joining share
    one partitioning."""
    types = _types(df)
    parts, nulls = [], []
    for i, name in enumerate(names):
        col = F.lit(None).cast("string") if name is None else F.col(f"`{name}`")
        if native[i] and name is not None:
            dtype = types[name]
            default = {T.StringType: F.lit(""), T.BooleanType: F.lit(False),
                       T.DateType: F.lit("1970-01-01").cast("date")}.get(type(dtype), F.lit(0).cast("long"))
            value = col.cast("long") if isinstance(dtype, T.IntegralType) else col
        else:
            value = key_text(col, types[name]) if name is not None else col
            default = F.lit("")
        parts.append(F.coalesce(value, default).alias(f"__k{i}"))
        nulls.append(col.isNull())
    if len(nulls) <= _BITS:
        flags = reduce(lambda a, b: a.bitwiseOR(b), [
            F.when(null, F.lit(1 << i)).otherwise(F.lit(0)) for i, null in enumerate(nulls)])
    else:
        flags = F.concat(*[F.when(null, F.lit("1")).otherwise(F.lit("0")) for null in nulls])
    return parts + [flags.alias("__kn")]


def _row_key(keys: Sequence[str]) -> Column:
    """The key as one text, from the join columns."""
    def is_null(i: int) -> Column:
        if len(keys) <= _BITS:
            return F.col("__kn").bitwiseAND(F.lit(1 << i)) != 0
        return F.substring("__kn", i + 1, 1) == "1"

    return F.concat_ws(KEY_MARK, *[
        F.when(is_null(i), F.lit(NULL_KEY)).otherwise(F.col(f"__k{i}").cast("string")) for i in range(len(keys))])


def _orderable(dtype: T.DataType) -> bool:
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return False
    if isinstance(dtype, T.ArrayType):
        return _orderable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_orderable(f.dataType) for f in dtype.fields)
    return True


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the last by ``order``, ties broken by all columns.

    A partial aggregate runs before the shuffle, so a hot key moves one row per
    task; the result stays partitioned by the keys for a join that follows.
    """
    types = _types(df)
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = [*[c for c in order if c not in keys], *rest]
    if not row:
        return df.distinct()
    values = F.struct(*[F.col(f"`{c}`") for c in row])
    if all(_orderable(types[c]) for c in row):
        best = F.max(values)
    else:
        best = F.max_by(values, F.struct(*[
            F.col(f"`{c}`") if _orderable(types[c]) else F.to_json(F.col(f"`{c}`")) for c in row]))
    picked = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(best.alias("__row"))
    return picked.select(*[F.col(f"`{c}`") if c in keys else F.col(f"__row.`{c}`") for c in df.columns])


def duplicate_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter(F.col("row_count") > 1)


# ---------------------------------------------------------------- row comparison

def row_diff(source: DataFrame, target: DataFrame, spec: DiffSpec) -> DataFrame:
    """Match rows by key and give each a status.

    How numbers compare (``spec.numeric``) is noted on the status column, so that cells and
    reports of this diff compare the same way.

    Columns: ``row_key``, ``status``, then ``s_<column>`` and ``t_<column>`` for every
    compared column. A repeated source key keeps its last row; each repeated target
    row is compared on its own. Columns the target lacks read as null.
    """
    return _matched(source, target, spec, "full_outer")


def _matched(source: DataFrame, target: DataFrame, spec: DiffSpec, how: str) -> DataFrame:
    """``row_diff`` by a full outer join, or by a left join that leaves target-only rows out."""
    cols = compared_columns(source, spec.exclude)
    keys = resolve_keys(spec, source)
    t_name = _target_names([*cols, *keys], target)
    s_types, t_types = _types(source), _types(target)
    # Keys of one type, and whole numbers of any two widths, match as they are; others as text.
    native = [t_name[k] is not None and (
        s_types[k] == t_types[t_name[k]] and isinstance(s_types[k], _NATIVE_KEYS)
        or isinstance(s_types[k], T.IntegralType) and isinstance(t_types[t_name[k]], T.IntegralType)) for k in keys]

    s_cols = [F.col(f"`{c}`").alias(f"s_{c}") for c in cols]
    t_cols = [(F.col(f"`{t_name[c]}`") if t_name[c] else F.lit(None).cast(s_types[c])).alias(f"t_{c}")
              for c in cols]
    on = [f"__k{i}" for i in range(len(keys))] + ["__kn"]
    s_parts = _key_parts(source, keys, native)
    t_parts = _key_parts(target, [t_name[k] for k in keys], native)
    here = F.lit(True)
    t = target.select(*t_parts, here.alias("__t"), *t_cols)

    if spec.unique_keys:
        s = source.select(*s_parts, here.alias("__s"), *s_cols)
        joined = s.join(t, on, how)
    else:
        order = [c for c in spec.sort if c in s_types]
        helpers = [f"__sort{i}" for i in range(len(order))]
        extra = [F.col(f"`{c}`").alias(h) for c, h in zip(order, helpers)]
        s = dedupe_last(source.select(*s_parts, *extra, *s_cols), on, helpers)
        s = s.drop(*helpers).withColumn("__s", here)
        # Only a full outer join cannot be split at skewed keys by the planner.
        hot = hot_keys(t, on, **spec.hot_key_args) if how == "full_outer" else None
        if hot is None:
            joined = s.join(t, on, how)
        else:
            # A hot target key exists on the target, so its source row is never source-only:
            # the hot rows need only a left join to at most one source row per hot key.
            few = F.broadcast(hot)
            cold = s.join(few, on, "left_anti").join(t.join(few, on, "left_anti"), on, "full_outer")
            hot_source = F.broadcast(s.join(few, on, "left_semi"))
            joined = cold.unionByName(t.join(few, on, "left_semi").join(hot_source, on, "left"))

    same = F.lit(True)
    for c in cols:
        if c not in keys:
            tt = t_types[t_name[c]] if t_name[c] else s_types[c]
            same = same & norm_eq(F.col(f"`s_{c}`"), F.col(f"`t_{c}`"), s_types[c], tt, spec.numeric)
    status = (
        F.when(F.col("__t").isNull(), F.lit(SOURCE_ONLY))
        .when(F.col("__s").isNull(), F.lit(TARGET_ONLY))
        .when(same, F.lit(MATCH))
        .otherwise(F.lit(DIFFERENT))
    )
    out = joined.select(
        _row_key(keys).alias("row_key"),
        status.alias("status", metadata={NUMERIC: spec.numeric}),
        *[F.col(f"`{side}_{c}`") for c in cols for side in ("s", "t")],
    )
    return out if spec.return_matched else out.filter(F.col("status") != MATCH)


def source_driven_diff(source: DataFrame, target: DataFrame, spec: DiffSpec,
                       lo=None, hi=None) -> DataFrame:
    """Compare a key range of the source with the same keys of the target.

    The range ``lo <= first key < hi`` replaces offset pages; it reaches both scans.
    Target-only rows never appear.
    """
    if not (spec.keys or spec.declared_keys or spec.sort):
        raise ValueError("comparing by source keys needs keys or sort columns")
    first = resolve_keys(spec, source)[0]
    other = _target_names([first], target)[first]
    same_type = other is not None and _types(source)[first] == _types(target)[other]
    for bound, test in ((lo, "__ge__"), (hi, "__lt__")):
        if bound is not None:
            source = source.filter(getattr(F.col(f"`{first}`"), test)(F.lit(bound)))
            if same_type:
                target = target.filter(getattr(F.col(f"`{other}`"), test)(F.lit(bound)))
    return _matched(source, target, spec, "left")


def _diff_columns(diff: DataFrame) -> list[str]:
    return [name[2:] for name in diff.columns if name.startswith("s_") and f"t_{name[2:]}" in diff.columns]


def _numeric(diff: DataFrame, given: str | None) -> str:
    """How numbers of this diff compare: as given, else as the diff was made."""
    return given or diff.schema["status"].metadata.get(NUMERIC, "double")


def _cell_structs(diff: DataFrame, numeric: str | None) -> list[Column]:
    numeric = _numeric(diff, numeric)
    types = _types(diff)
    one_sided = F.col("status").isin(SOURCE_ONLY, TARGET_ONLY)
    cells = []
    for c in _diff_columns(diff):
        s, t = F.col(f"`s_{c}`"), F.col(f"`t_{c}`")
        ts, tt = types[f"s_{c}"], types[f"t_{c}"]
        differs = F.when(F.col("status") == MATCH, F.lit(False)).otherwise(
            one_sided | ~norm_eq(s, t, ts, tt, numeric))
        cells.append(F.struct(F.lit(c).alias("column"), cell_text(s, ts).alias("source_value"),
                              cell_text(t, tt).alias("target_value"), differs.alias("is_different")))
    return cells


def cell_diff(diff: DataFrame, include_matches: bool = False, numeric: str | None = None) -> DataFrame:
    """One record per compared cell; every cell of a one-sided row is different.

    Matching rows are dropped before the cells are laid out unless asked for.
    """
    rows = diff if include_matches else diff.filter(F.col("status") != MATCH)
    return rows.select("row_key", "status", F.explode(F.array(*_cell_structs(diff, numeric))).alias("cell")) \
        .select("row_key", "status", "cell.*")


def with_cells(diff: DataFrame, numeric: str | None = None) -> DataFrame:
    """Row form: ``row_key``, ``status`` and an array of cells."""
    return diff.select("row_key", "status", F.array(*_cell_structs(diff, numeric)).alias("cells"))


def render_cells(diff: DataFrame, numeric: str | None = None) -> DataFrame:
    """Report text per column: a different cell shows both sides, an equal one its value."""
    numeric = _numeric(diff, numeric)
    types = _types(diff)
    out = []
    for c in _diff_columns(diff):
        s, t = F.col(f"`s_{c}`"), F.col(f"`t_{c}`")
        ts, tt = types[f"s_{c}"], types[f"t_{c}"]
        left, right = cell_text(s, ts), cell_text(t, tt)
        both = F.concat(F.lit("[SRC] "), F.coalesce(left, F.lit("NULL")),
                        F.lit("\n[TGT] "), F.coalesce(right, F.lit("NULL")))
        differs = (F.col("status") != MATCH) & (
            F.col("status").isin(SOURCE_ONLY, TARGET_ONLY) | ~norm_eq(s, t, ts, tt, numeric))
        out.append(F.when(differs, both).otherwise(F.coalesce(left, right, F.lit(""))).alias(c))
    return diff.select("status", "row_key", *out)


def export_diff(diff: DataFrame, path: str) -> None:
    """Write the report rows as one folder per status, and the summary beside them.

    The statuses are the sets a reader opens one at a time; all of them together
    are the whole report.
    """
    render_cells(diff).write.mode("errorifexists").partitionBy("status").parquet(f"{path}/rows")
    spark = diff.sparkSession
    diff_summary(spark.read.parquet(f"{path}/rows")).coalesce(1).write.json(f"{path}/summary")


def filter_status(diff: DataFrame, status: str) -> DataFrame:
    """Keep one status; ``ALL`` keeps everything and ``IDENTICAL`` means ``MATCH``."""
    wanted = status.strip().upper()
    if wanted == "ALL":
        return diff
    wanted = MATCH if wanted == "IDENTICAL" else wanted
    if wanted not in (MATCH, DIFFERENT, SOURCE_ONLY, TARGET_ONLY):
        raise ValueError(f"unknown status: {status}")
    return diff.filter(F.col("status") == wanted)


def status_counts(df: DataFrame, by: Sequence[str] = ("status",)) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"))


_TOTALS = ("total_source", "total_target", "match_count", "different_count",
           "source_only_count", "target_only_count", "total_differences")


def diff_summary(diff: DataFrame, source: DataFrame | None = None, target: DataFrame | None = None) -> DataFrame:
    """One row of totals.

    With repeated keys the totals of the inputs count all their rows, so pass the
    inputs; their plain counts come from file footers. Without them the totals are
    taken from the statuses, which is the same when keys are unique.
    """
    is_ = {s: F.count_if(F.col("status") == s) for s in (MATCH, DIFFERENT, SOURCE_ONLY, TARGET_ONLY)}
    counts = diff.agg(*[c.alias(s) for s, c in is_.items()]).select(
        (F.col(MATCH) + F.col(DIFFERENT) + F.col(SOURCE_ONLY)).alias("total_source"),
        (F.col(MATCH) + F.col(DIFFERENT) + F.col(TARGET_ONLY)).alias("total_target"),
        F.col(MATCH).alias("match_count"), F.col(DIFFERENT).alias("different_count"),
        F.col(SOURCE_ONLY).alias("source_only_count"), F.col(TARGET_ONLY).alias("target_only_count"),
        (F.col(DIFFERENT) + F.col(SOURCE_ONLY) + F.col(TARGET_ONLY)).alias("total_differences"))
    for name, df in (("total_source", source), ("total_target", target)):
        if df is not None:
            zero = [F.lit(0).cast("long").alias(c) for c in _TOTALS if c != name]
            counts = counts.withColumn(name, F.lit(0).cast("long")).unionByName(
                df.agg(F.count(F.lit(1)).alias(name)).select(name, *zero))
    if source is None and target is None:
        return counts
    return counts.agg(*[F.sum(c).alias(c) for c in _TOTALS])


def count_both(source: DataFrame, target: DataFrame) -> DataFrame:
    one = F.lit(1).cast("long")
    none = F.lit(0).cast("long")
    return (
        source.agg(F.count(F.lit(1)).alias("source_count")).select("source_count", none.alias("target_count"))
        .unionByName(target.agg(F.count(one).alias("target_count")).select(none.alias("source_count"), "target_count"))
        .agg(F.sum("source_count").alias("source_count"), F.sum("target_count").alias("target_count"))
    )


# ---------------------------------------------------------------- fingerprints

def row_fingerprint(cols: Sequence[Column]) -> Column:
    """MD5 over the cells as text, each pair separated by three bars, nulls as empty."""
    return F.md5(F.concat_ws("|||", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def bucket_checksums(df: DataFrame, keys: Sequence[str], buckets: int = 1024) -> DataFrame:
    """Row count and an order-free checksum per key bucket: a cheap look before a full diff."""
    types = _types(df)
    text = [F.coalesce(key_text(F.col(f"`{k}`"), types[k]), F.lit(NULL_KEY)) for k in keys]
    bucket = F.pmod(F.xxhash64(*text), F.lit(buckets)).cast("int")
    row_hash = F.xxhash64(*[F.coalesce(cell_text(F.col(f"`{c}`"), types[c]), F.lit(NULL_KEY)) for c in df.columns])
    return df.select(bucket.alias("bucket"), row_hash.alias("h")).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("row_count"), F.bit_xor("h").alias("xor_hash"),
        F.sum(F.col("h").cast("decimal(20,0)")).alias("sum_hash"))


def differing_buckets(a: DataFrame, b: DataFrame, keys: Sequence[str], buckets: int = 1024) -> DataFrame:
    """Buckets whose checksums disagree; equal frames give none."""
    one, two = bucket_checksums(a, keys, buckets), bucket_checksums(b, keys, buckets)
    measures = ["row_count", "xor_hash", "sum_hash"]
    return one.unionByName(two).groupBy("bucket", *measures).agg(F.count(F.lit(1)).alias("n")) \
        .filter(F.col("n") != 2).select("bucket").distinct()


# ---------------------------------------------------------------- many tables

def compare_many(spark: SparkSession, mappings: Mapping[str, Callable[[], tuple[DataFrame, DataFrame, DiffSpec]]],
                 parallel: int = 2, history_path: str | None = None, job: str = "compare",
                 run_id: str | None = None) -> DataFrame:
    """Compare many pairs; a pair that fails is reported and the others go on.

    Each mapping is a function giving ``(source, target, spec)``. A failing pair is
    tried once more. With ``history_path`` and ``run_id`` the rows that do not match
    are stored as JSON, one folder per run and table, rewritten whole on a retry, and
    the totals of the run are added to ``<history_path>/runs``.
    """

    def once(name: str) -> tuple:
        source, target, spec = mappings[name]()
        if not (history_path and run_id):
            diff = row_diff(source, target, replace(spec, return_matched=True))
            counts = diff_summary(diff, source, target).first().asDict()
        else:
            # One comparison: store the rows that differ, then count what was stored.
            # Every target row is compared, so the matches are the target rows left over.
            folder = f"{history_path}/rows/run_id={run_id}/table_name={quote(name, safe='')}"
            rows = with_cells(row_diff(source, target, replace(spec, return_matched=False)), spec.numeric)
            data = F.translate(F.to_json("cells"), "\u0000", "")
            rows.select(F.lit(job).alias("job"), "row_key", "status", data.alias("data_json")) \
                .write.mode("overwrite").parquet(folder)
            counts = diff_summary(spark.read.parquet(folder).select("status"), source, target).first().asDict()
            counts["match_count"] = (counts["total_target"] - counts["different_count"]
                                     - counts["target_only_count"])
        return (name, *[counts[c] for c in _TOTALS], None)

    def guarded(name: str) -> tuple:
        for attempt in (1, 2):
            try:
                return once(name)
            except Exception as error:  # one failing table must not stop the rest
                failure = f"{type(error).__name__}: {str(error)}"
        return (name, *([None] * len(_TOTALS)), failure)

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        results = list(pool.map(guarded, mappings))
    schema = "table_name string, " + ", ".join(f"{c} long" for c in _TOTALS) + ", error_message string"
    summary = spark.createDataFrame(results, schema)
    if history_path and run_id:
        errors = "; ".join(f"{row[0]}: {row[-1]}" for row in results if row[-1]) or None
        counts = [c for c in _TOTALS if c.endswith("_count")]
        summary.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts]).select(
            F.lit(run_id).alias("id"), F.lit(job).alias("schedule_id"), F.now().alias("run_time"), *counts,
            F.lit(errors).cast("string").alias("error_message")) \
            .write.mode("overwrite").parquet(f"{history_path}/runs/run={run_id}")
    return summary


def run_history(runs: DataFrame, job, n: int = 50) -> DataFrame:
    """The last ``n`` runs of a job, newest first."""
    return runs.filter(F.col("schedule_id") == job).orderBy(F.desc("run_time"), F.desc("id")).limit(n)


def run_rows(rows: DataFrame, run_id, table_name: str | None = None) -> DataFrame:
    """The stored rows of one run, optionally of one table."""
    kept = rows.filter(F.col("run_id") == run_id)
    return kept if table_name is None else kept.filter(F.col("table_name") == table_name)


def template_of(mapping_id: Column) -> Column:
    """The template a mapping was made from, by the form of its id; null if by hand."""
    return F.when(mapping_id.startswith("template-"), F.nullif(F.substring_index(mapping_id, "template-", -1), F.lit(""))) \
        .when(mapping_id.startswith("tpl_"), mapping_id)


def resolve_mappings(mappings: DataFrame, templates: DataFrame) -> DataFrame:
    """A mapping linked to a template takes the template's queries and keys where it has any.

    Mappings carry ``template_id``, or an ``id`` that tells it.
    """
    given = mappings.columns
    if "template_id" not in given:
        mappings = mappings.withColumn("template_id", template_of(F.col("id")))
    shared = [c for c in templates.columns if c != "template_id" and c in mappings.columns]
    # One template an id, also where an id repeats: the least by its columns.
    one = templates.groupBy("template_id").agg(F.min(F.struct(*shared)).alias("__t")) if shared else templates.select("template_id").distinct()
    t = one.select("template_id", *[F.col(f"__t.`{c}`").alias(f"__t_{c}") for c in shared])
    joined = join_unique(mappings, t, ["template_id"])
    return joined.select(*[
        F.coalesce(F.nullif(F.trim(f"__t_{c}"), F.lit("")), F.col(c)).alias(c) if c in shared else F.col(c)
        for c in given])
