"""Typed raw tables: text columns cast to the contract's types with domain rules.

A value that does not fit its column (unparseable, out of range, too long, not
in the enum, outside a declared bound) would make the source system's insert
fail.  Here it is counted per column in one aggregate and reported as an
error issue, so the load can stop *before* anything is written and the report
names the column, instead of a bare cast failure deep inside a task.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.contracts import ColumnRule, DatasetContract
from tradelens.operators.quality import ERROR

TYPE_REJECTED = "type_rejected"


def _typed(raw: Column, rule: ColumnRule) -> Column:
    return raw.try_cast(rule.dtype)


def _violates(raw: Column, typed: Column, rule: ColumnRule) -> Column:
    bad = raw.isNotNull() & typed.isNull()
    if rule.max_length is not None:
        bad = bad | (F.length(raw) > rule.max_length)
    if rule.allowed is not None:
        bad = bad | (raw.isNotNull() & ~raw.isin(*rule.allowed))
    if rule.bounds is not None:
        lo, hi = rule.bounds
        bad = bad | (typed.isNotNull() & ((typed < lo) | (typed > hi)))
    return F.coalesce(bad, F.lit(False))


def to_typed(df: DataFrame, contract: DatasetContract) -> DataFrame:
    """Contract columns in contract order, cast; absent columns are typed NULLs."""
    cols = []
    for name, rule in contract.columns:
        if name in df.columns:
            cols.append(_typed(F.col(name), rule).alias(name))
        else:
            cols.append(F.lit(None).cast(rule.dtype).alias(name))
    return df.select(*cols)


REJECTS = "__rejects"


def with_rejects(df: DataFrame, contract: DatasetContract) -> DataFrame:
    """``df`` with one more column: the values of a record that do not fit (column, value, reason).

    It is computed while the text is staged, so finding the bad records later
    reads only that column's statistics and their rows, not the source again.
    """
    found = [
        F.when(
            _violates(F.col(f"`{n}`"), _typed(F.col(f"`{n}`"), r), r),
            F.struct(
                F.lit(n).alias("column"),
                F.col(f"`{n}`").alias("value"),
                _reason(F.col(f"`{n}`"), _typed(F.col(f"`{n}`"), r), r).alias("reason"),
            ),
        )
        for n, r in contract.columns
        if n in df.columns
    ]
    none = F.expr("cast(array() as array<struct<column:string,value:string,reason:string>>)")
    return df.withColumn(REJECTS, F.array_compact(F.array(*found)) if found else none)


def _reason(raw: Column, typed: Column, rule: ColumnRule) -> Column:
    """Why a value that ``_violates`` its rule does not fit."""
    why = F.when(raw.isNotNull() & typed.isNull(), F.lit(f"not a {rule.dtype.simpleString()}"))
    if rule.max_length is not None:
        why = why.when(F.length(raw) > rule.max_length, F.lit(f"longer than {rule.max_length}"))
    if rule.allowed is not None:
        why = why.when(~raw.isin(*rule.allowed), F.lit("not an allowed value"))
    return why.otherwise(F.lit("out of bounds"))


def quarantined(staged: DataFrame, contract: DatasetContract, file_column: str | None = None) -> DataFrame:
    """One row per rejected value: table, file, column, value, reason and the whole record as JSON.

    ``staged`` comes from ``with_rejects``.
    """
    fields = [c for c in staged.columns if c not in (REJECTS, file_column)]
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in fields]), {"ignoreNullFields": "false"})
    return staged.where(F.size(REJECTS) > 0).select(
        F.lit(contract.destination_table).alias("table"),
        (F.col(f"`{file_column}`") if file_column else F.lit(None).cast("string")).alias("file"),
        record.alias("record"),
        F.inline(REJECTS),
    )


def type_rejects(df: DataFrame, contract: DatasetContract) -> DataFrame:
    """Issue rows (one per column with rejected values), from one aggregate."""
    present = [(n, r) for n, r in contract.columns if n in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], "table string, check string, severity string, "
                                               "column string, n_rows long, message string")
    aggs = [
        F.count_if(_violates(F.col(n), _typed(F.col(n), r), r)).alias(f"__r{i}")
        for i, (n, r) in enumerate(present)
    ]
    structs = [
        F.struct(
            F.lit(n).alias("column"),
            F.col(f"__r{i}").alias("n_rows"),
            F.format_string(f"%d row(s) with a value that does not fit {n} "
                            f"({r.dtype.simpleString()})", F.col(f"__r{i}")).alias("message"),
        )
        for i, (n, r) in enumerate(present)
    ]
    return (
        df.agg(*aggs)
        .select(F.inline(F.array(*structs)))
        .where(F.col("n_rows") > 0)
        .select(
            F.lit(contract.destination_table).alias("table"),
            F.lit(TYPE_REJECTED).alias("check"),
            F.lit(ERROR).alias("severity"),
            "column",
            F.col("n_rows").cast("long").alias("n_rows"),
            "message",
        )
    )


def typed_view(df: DataFrame, contract: DatasetContract) -> DataFrame:
    """Contract columns cast in place, unexpected columns kept as read, none added.

    This is the frame the validators see: missing columns stay missing (so the
    missing-columns check fires) and unexpected ones still count for the
    NULL-share check.
    """
    rules = contract.rules
    return df.select(
        *[
            (_typed(F.col(f"`{c}`"), rules[c]) if c in rules else F.col(f"`{c}`")).alias(c)
            for c in df.columns
        ]
    )


def validate_text(df: DataFrame, contract: DatasetContract) -> DataFrame:
    """Contract checks of the typed view plus type rejects, in one scan of ``df``.

    The aggregate reads the text columns once: each contract column appears
    cast (for the checks) and as text (to count values that did not fit).
    """
    from tradelens.operators.quality import issue_struct, validate_frame

    # Bounds are a check of the validators; counted here too, one bad value would be two errors.
    rules = {n: replace(r, bounds=None) for n, r in contract.rules.items()}
    typed_cols = [c for c in df.columns if c in rules]
    raw_name = {c: f"__text_{i}" for i, c in enumerate(typed_cols)}
    both = df.select(
        *[(_typed(df[c], rules[c]) if c in rules else df[c]).alias(c) for c in df.columns],
        *[df[c].alias(raw_name[c]) for c in typed_cols],
    )
    extra = []
    for i, c in enumerate(typed_cols):
        key = f"__rej{i}"
        n = F.col(key)
        extra.append((
            key,
            F.count_if(_violates(F.col(raw_name[c]), F.col(c), rules[c])),
            issue_struct(
                TYPE_REJECTED, ERROR, c, n,
                F.format_string(f"%d row(s) with a value that does not fit {c} "
                                f"({rules[c].dtype.simpleString()})", n),
                n > 0,
            ),
        ))
    return validate_frame(both, contract, columns=list(df.columns), extra=extra)

