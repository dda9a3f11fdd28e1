"""Read-only check of SQL text by its parsed plan and expressions, and a limit on what it returns."""

from __future__ import annotations

import re
import threading

from pyspark.sql import DataFrame, SparkSession

#: Plan nodes that only read (names of Catalyst's logical operators).
READS = {
    "Project", "Filter", "Join", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Limit", "Offset", "SubqueryAlias", "Union", "Distinct", "Deduplicate", "UnresolvedRelation", "UnresolvedInlineTable", "UnresolvedWith", "CTERelationDef",
    "UnresolvedSubqueryColumnAliases", "Window", "WithWindowDefinition", "UnresolvedHaving", "OneRowRelation", "Except", "Intersect", "Generate", "UnresolvedTableValuedFunction", "LocalRelation", "Expand", "LateralJoin", "Pivot", "Unpivot", "Sample",
}
#: Functions that compute from their arguments alone; all others are refused.
FUNCTIONS = frozenset("""
abs acos aggregate any any_value approx_count_distinct array array_agg array_contains array_distinct array_except array_intersect array_join array_max array_min array_position array_remove array_sort array_union arrays_overlap
ascii asin atan atan2 avg base64 between bigint bit_count bool_and bool_or boolean bround btrim cardinality ceil ceiling char char_length character_length chr coalesce collect_list collect_set concat concat_ws contains corr cos count count_if
covar_pop covar_samp crc32 cume_dist current_date current_timestamp date date_add date_diff date_format date_sub date_trunc datediff day dayofmonth dayofweek dayofyear decimal degrees dense_rank double element_at endswith every exists exp
explode explode_outer extract filter find_in_set first first_value flatten float floor forall format_number format_string from_json from_unixtime get get_json_object greatest grouping grouping_id hash hex hour if ifnull ilike in initcap inline
inline_outer instr int isnan isnotnull isnull json_array_length kurtosis lag last last_day last_value lcase lead least left len length levenshtein like ln locate log log10 log2 lower lpad ltrim map map_from_arrays map_keys map_values max
max_by md5 mean median min min_by minute mod mode month months_between named_struct nanvl next_day now nth_value ntile nullif nvl nvl2 overlay percent_rank percentile percentile_approx pmod posexplode posexplode_outer position pow power
quarter radians range rank regexp regexp_count regexp_extract regexp_extract_all regexp_like regexp_replace repeat replace reverse right rint rlike round row_number rpad rtrim second sequence sha1 sha2 shuffle sign size skewness slice some
sort_array soundex split split_part sqrt stack startswith std stddev stddev_pop stddev_samp string struct substr substring substring_index sum tan timestamp to_date to_json to_timestamp transform translate trim trunc try_add try_cast
try_divide try_element_at ucase unhex unix_timestamp upper var_pop var_samp variance weekday weekofyear when width_bucket window xxhash64 year zip_with
""".split())
#: Expressions that name their table or function only when they run.
LATE = {"ExpressionWithUnresolvedIdentifier", "PlanWithUnresolvedIdentifier", "FunctionTableSubqueryArgumentExpression"}
#: Expressions that hold a plan.
SUBQUERIES = {"ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"}
#: Names before a path in ``format.`path```.
FORMATS = {"parquet", "json", "csv", "orc", "text", "binaryfile", "avro", "xml", "jdbc", "delta", "iceberg", "hudi"}
DEFAULT_LIMIT, MOST = 50, 100


def _each(seq):
    return (seq.apply(i) for i in range(seq.size()))


def _name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _of_expression(e) -> str | None:
    """Why an expression of a parsed plan is more than a computation on rows, or None."""
    name = _name(e)
    if name in LATE:
        return f"not allowed: {name}"
    if name == "UnresolvedFunction":
        called = ".".join(_each(e.nameParts()))
        if called.lower() not in FUNCTIONS:
            return f"not allowed: function {called}"
    if name in SUBQUERIES and (why := _of_plan(e.plan())):
        return why
    return next((why for kid in _each(e.children()) if (why := _of_expression(kid))), None)


def _of_plan(node) -> str | None:
    name = _name(node)
    if name not in READS:
        return f"not allowed: {name}"
    if name == "UnresolvedRelation":
        parts = list(_each(node.multipartIdentifier()))
        if any(re.search(r"[/\\:*]", p) for p in parts) or parts[0].lower() in FORMATS:
            return f"not allowed: path {'.'.join(parts)}"
    if name == "UnresolvedTableValuedFunction":
        called = ".".join(_each(node.name()))
        if called.lower() not in FUNCTIONS:
            return f"not allowed: function {called}"
    for e in _each(node.expressions()):
        if why := _of_expression(e):
            return why
    for kids in (node.children(), node.innerChildren()):
        for kid in _each(kids):
            if ".catalyst.expressions." not in kid.getClass().getName() and (why := _of_plan(kid)):
                return why
    return None


def violation(spark: SparkSession, sql: str) -> str | None:
    """Why ``sql`` is not a plain read of tables that exist, or None."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        return f"does not parse: {str(e).splitlines()[0]}"
    if why := _of_plan(plan):
        return why
    try:
        spark.sql(sql)  # a read: analysed here, run by nobody
    except Exception as e:
        return f"does not resolve: {str(e).splitlines()[0]}"
    return None


def limit_of(sql: str) -> int:
    """The number of rows that ``sql`` may return: its own last LIMIT (an OFFSET may follow) if it is small enough."""
    found = re.findall(r"\blimit\s+(\d+)(?:\s+offset\s+\d+)?\s*;?\s*\Z", sql, re.I)
    return int(found[-1]) if found and int(found[-1]) <= MOST else DEFAULT_LIMIT


def run(spark: SparkSession, sql: str) -> DataFrame:
    """The result of a read-only query, limited; ValueError if it is none."""
    why = violation(spark, sql)
    if why:
        raise ValueError(why)
    return spark.sql(sql.rstrip().rstrip(";")).limit(limit_of(sql))


def within(spark: SparkSession, seconds: float, act, default=None):
    """``act()`` or, if its jobs take longer than ``seconds`` or fail, ``default``; the jobs are cancelled."""
    tag = f"strataflow-{threading.get_ident()}-{id(act)}"
    timer = threading.Timer(seconds, lambda: spark.sparkContext.cancelJobsWithTag(tag))
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        return act()
    except Exception:
        return default
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)
