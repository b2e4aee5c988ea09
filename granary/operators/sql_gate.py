"""The read-only gate of the SQL surface: a statement is parsed, not searched for words.

The parser's plan is walked whole, with its common tables and subqueries. Only kinds of nodes, expressions and functions that are named here may stand in it, and
relations must be plain names, so a new statement, a function that reads files or a path in place of a table is refused without being known.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

MAX_SQL_CHARS = 2000

#: Kinds of plan nodes that only read.
NODES = set(
    """Aggregate CTERelationRef Deduplicate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Project RelationTimeTravel Sort SubqueryAlias
    UnresolvedHaving UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedWith Union WithWindowDefinition Expand Pivot UnresolvedOrderBy Window""".split()
)
#: Kinds of expressions: operators, names, literals, casts, cases, windows and subqueries.
EXPRESSIONS = set(
    """Add Alias And AttributeReference Between BitwiseAnd BitwiseNot BitwiseOr BitwiseXor CaseWhen Cast Concat CreateArray CreateNamedStruct Cube CurrentDate CurrentTimestamp CurrentRow$ Divide EqualNullSafe EqualTo Exists GreaterThan
    GreaterThanOrEqual GroupingSets ILike If In InSubquery IntegralDivide IsFalse IsNotNull IsNotUnknown IsNull IsTrue IsUnknown LambdaFunction LateralSubquery LessThan LessThanOrEqual Like LikeAll LikeAny ListQuery Literal MultiAlias
    Multiply NamePlaceholder$ Not NotLikeAll NotLikeAny NamedParameter Or OuterReference PosParameter RLike Remainder Rollup ScalarSubquery SortOrder SpecifiedWindowFrame StringTrim StringTrimBoth StringTrimLeft
    StringTrimRight Substring Subtract TimestampAdd TimestampDiff TryCast UnaryMinus UnaryPositive UnboundedFollowing$ UnboundedPreceding$ UnresolvedAlias UnresolvedAttribute UnresolvedExtractValue UnresolvedFunction
    UnresolvedNamedLambdaVariable UnresolvedOrdinal UnresolvedStar UnresolvedWindowExpression UnspecifiedFrame$ WindowExpression WindowSpecDefinition ZonedTimestamp""".split()
)
#: Functions that compute from their arguments alone.
FUNCTIONS = set(
    """abs acos add_months aggregate any any_value approx_count_distinct array array_agg array_contains array_distinct array_join array_max array_min array_position array_size array_sort ascii asin atan atan2 avg between
    bit_and bit_length bit_or bit_xor bool_and bool_or bround cardinality cbrt ceil ceiling char_length character_length chr coalesce collect_list collect_set concat concat_ws contains corr cos count count_if covar_pop
    covar_samp cume_dist current_date date_add date_diff date_format date_part date_sub date_trunc datediff day dayofmonth dayofweek dayofyear degrees dense_rank div element_at endswith every exists exp explode
    extract filter first first_value floor forall from_unixtime get greatest grouping grouping_id hash hour if ifnull initcap instr isnan isnotnull isnull kurtosis lag last last_day last_value lcase lead least left
    length ln locate log log10 log1p log2 lower lpad ltrim make_date map map_keys map_values max max_by mean median min min_by minute mod mode month months_between named_struct negative next_day not nth_value ntile nullif
    nvl nvl2 octet_length overlay pmod percent_rank percentile percentile_approx percentile_cont percentile_disc posexplode position positive pow power quarter radians rank regexp_count regexp_extract
    regexp_extract_all regexp_like regexp_replace repeat replace reverse right round row_number rpad rtrim second sequence sha2 sign signum sin size skewness slice some sort_array split split_part sqrt startswith std stddev
    stddev_pop stddev_samp string_agg struct substr substring sum tan to_date to_timestamp transform translate trim trunc try_divide typeof ucase upper var_pop var_samp variance weekday weekofyear when
    width_bucket xxhash64 year zip_with""".split()
)


class SqlRejected(ValueError):
    """The statement is not an acceptable read-only query."""


def _each(sequence) -> Iterator:
    for i in range(sequence.size()):
        yield sequence.apply(i)


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _check_expression(e) -> None:
    kind = _kind(e)
    if kind not in EXPRESSIONS:
        raise SqlRejected(f"expression {kind} is not permitted")
    if kind == "UnresolvedFunction":
        name = [str(part).lower() for part in _each(e.nameParts())]
        if len(name) != 1 or name[0] not in FUNCTIONS:
            raise SqlRejected(f"function {'.'.join(name)} is not permitted")
    if kind in ("Exists", "LateralSubquery", "ListQuery", "ScalarSubquery"):
        _check_plan(e.plan())
    if kind == "InSubquery":
        _check_expression(e.query())
    for child in _each(e.children()):
        _check_expression(child)


def _check_plan(plan) -> None:
    kind = _kind(plan)
    if kind not in NODES:
        raise SqlRejected(f"{kind} is not permitted")
    if kind == "UnresolvedRelation" and plan.multipartIdentifier().size() != 1:
        raise SqlRejected("relations must be plain names")
    if kind == "UnresolvedWith":
        for pair in _each(plan.cteRelations()):
            _check_plan(pair._2())
    if kind == "LateralJoin":
        _check_expression(plan.right())
    for e in _each(plan.expressions()):
        _check_expression(e)
    for child in _each(plan.children()):
        _check_plan(child)


def validate_read_only(sql: str, spark: SparkSession | None = None) -> str:
    """The statement without a trailing semicolon, if it is one query that reads plain relations by known means; else :class:`SqlRejected`. Comments are refused too."""
    text = sql.strip().removesuffix(";").strip()
    if not text or len(text) > MAX_SQL_CHARS or "\x00" in text:
        raise SqlRejected("empty, too long or with null bytes")
    if re.search(r"--|/\*|\*/", re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", "''", text)):
        raise SqlRejected("comments are not permitted")
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as e:
        raise SqlRejected("not one statement that can be read") from e
    _check_plan(plan)
    return text
