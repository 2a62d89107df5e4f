"""CSV records of files whose fields go on in the next line, found in many tasks.

Whether a line begins a record can't be seen in the line, only whether it would leave a quoted field open if it began outside of one, and if it began inside. A line
is thus a function of two states. Most are constant (what was before doesn't matter) or keep the state; a few swap it. Functions compose, so a file split is
one function as well: the value of its last constant line, changed by the swaps after it. Composed over the splits of a file, a row each, they give the state in which each
split begins. Splits that begin outside and hold no open line, by far the most, have one record a line and are not moved. The lines of the others are ordered
inside their split, joined to records, and pieces of a record from several splits are put together.

A quote only counts where it begins a field, as in ``a,"b"``; in ``5" screen`` it is a character like others. ``""`` inside a quoted field is one quote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from voxtally.session import stage

_QUOTED = '[^"]*+(?:""[^"]*+)*+"[^,]*+'
_FIELD = f'(?:"{_QUOTED}|[^",][^,]*+)?+'
_FIELDS = rf"(?:{_FIELD},)*+{_FIELD}\z"
#: Lines that end outside of a quoted field if they begin a record, or inside of a field.
CLOSED_FROM_OUTSIDE, CLOSED_FROM_INSIDE = rf"\A{_FIELDS}", rf"\A{_QUOTED}(?:\z|,{_FIELDS})"

_SPLIT = ["_file", "_split"]


class OpenQuoteError(ValueError):
    """The last record of a file has a quote that is never closed."""


def tagged_lines(spark: SparkSession, path: str) -> DataFrame:
    """Each line with file, split, place, and what it does with the state: ``open_out`` and ``open_in`` tell whether it ends inside
    a quoted field when it begins outside or inside of one."""
    lines = spark.read.option("lineSep", "\n").text(path)
    at_start = (F.col("_metadata.file_block_start") == 0) & F.startswith("value", F.lit("\ufeff"))
    rows = lines.select(
        F.xxhash64(F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"),
        F.when(at_start, F.substr("value", F.lit(2))).otherwise(F.col("value")).alias("line"))
    quoted = F.contains("line", F.lit('"'))
    return rows.withColumns({
        "open_out": quoted & ~F.rlike("line", F.lit(CLOSED_FROM_OUTSIDE)),
        "open_in": ~quoted | ~F.rlike("line", F.lit(CLOSED_FROM_INSIDE)),
        "blank": F.btrim("line", F.lit(" \t\r")) == "",
    })


# A function of the state as columns: its value if it is constant (else null), and whether it swaps if it is not.


def _constant(out: Column, inside: Column) -> Column:
    return F.when(out == inside, out.cast("int"))


def _swaps(out: Column, inside: Column) -> Column:
    return (out & ~inside).cast("int")


def _state_before(order, start: Column | int = 0) -> Column:
    """The state (0 outside, 1 inside) that the rows before leave, from columns ``constant`` and ``swaps``.

    It is the value of the last constant row, or ``start``, changed by the swaps since: with running counts of swaps, the sum of both counts tells whether it changed.
    """
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("constant").isNotNull(), F.col("constant") + F.col("_cum")), ignorenulls=True).over(before)
    swapped = F.coalesce(F.lag("_cum").over(order), F.lit(0))
    return (F.coalesce(last, F.lit(start) if isinstance(start, int) else start) + swapped) % 2


def _with_running_swaps(rows: DataFrame, order) -> DataFrame:
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_cum", F.sum("swaps").over(upto))


def split_states(lines: DataFrame) -> DataFrame:
    """``_file, _split, first_at (first line that is not blank), plain, state, last_state`` for each split: whether all its lines are records of their own (once it begins outside), the
    state in which it begins and ends.  Both aggregates are combined in the task; what is ordered is one row a split."""
    codes = lines.select(*_SPLIT, "_at", "blank", "open_out", _constant(F.col("open_out"), F.col("open_in")).alias("constant"), _swaps(F.col("open_out"), F.col("open_in")).alias("swaps"))
    ends = codes.groupBy(*_SPLIT).agg(
        F.min(F.when(~F.col("blank"), F.col("_at"))).alias("first_at"), (F.count_if(F.col("open_out") | F.col("blank")) == 0).alias("plain"),
        F.max(F.when(F.col("constant").isNotNull(), F.struct("_at", "constant"))).alias("last"))
    ends = stage(ends, "split-ends")
    later = codes.where("swaps = 1").join(ends.select(*_SPLIT, F.col("last._at").alias("last_at")), _SPLIT, "left").where("last_at is null or _at > last_at")
    swaps = later.groupBy(*_SPLIT).agg(F.count(F.lit(1)).alias("n"))
    whole = ends.join(swaps, _SPLIT, "left").withColumn("parity", (F.coalesce("n", F.lit(0)) % 2).cast("int"))
    whole = whole.withColumns({"constant": ((F.col("last.constant") + F.col("parity")) % 2).cast("int"), "swaps": F.when(F.col("last").isNull(), F.col("parity")).otherwise(0)})
    order = Window.partitionBy("_file").orderBy("_split")
    whole = _with_running_swaps(whole, order).withColumn("state", _state_before(order).cast("int"))
    last_state = F.coalesce("constant", ((F.col("state") + F.col("swaps")) % 2).cast("int"))
    return stage(whole.select(*_SPLIT, "first_at", "plain", "state", last_state.alias("last_state")), "split-states")


def _joined_lines(pieces: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(pieces), lambda p: p["line"]), "\n")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``_file, _split, _rank, record``: every record below the header, with the split that it begins in and its place among those of that split.

    Blank lines between records are no records. A quote that is never closed is an error.
    """
    lines = stage(tagged_lines(spark, path), "lines")
    states = split_states(lines)
    last = Window.partitionBy("_file").orderBy(F.desc("_split"))
    if not states.withColumn("n", F.row_number().over(last)).where("n = 1 and last_state = 1").isEmpty():
        raise OpenQuoteError("A quote is never closed.")
    first = Window.partitionBy("_file").orderBy("_split")
    with_text = Window.partitionBy("_file").orderBy(F.col("first_at").isNull(), "_split")
    states = states.withColumn("heads", F.row_number().over(with_text) == 1)  # the header is the first line with text
    known = lines.join(states.select(*_SPLIT, "first_at", "plain", "state", "heads"), _SPLIT, "left")
    plain = F.col("plain") & (F.col("state") == 0)
    is_header = F.col("heads") & (F.col("_at") == F.col("first_at"))

    direct = known.where(plain & ~is_header).select(*_SPLIT, (F.col("_at") - F.col("first_at") - F.col("heads").cast("int")).alias("_rank"), F.col("line").alias("record"))

    order = Window.partitionBy(*_SPLIT).orderBy("_at")
    others = known.where(~plain).withColumns({"constant": _constant(F.col("open_out"), F.col("open_in")), "swaps": _swaps(F.col("open_out"), F.col("open_in"))})
    others = _with_running_swaps(others, order).withColumn("inside", _state_before(order, F.col("state")) == 1)
    counts = ~F.col("inside") & ~is_header & ~F.col("blank")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    others = others.withColumns({
        "_rank": F.coalesce(F.count_if(counts).over(before), F.lit(0)),
        "_begun": F.max(F.when(~F.col("inside"), F.col("_at"))).over(upto),  # null: goes on from an earlier split
    })
    others = stage(others.select(*_SPLIT, "_at", "line", "_rank", "_begun", "inside", "open_out", counts.alias("counts"), is_header.alias("is_header")), "open-lines")
    single = others.where("not inside and not open_out and counts").select(*_SPLIT, "_rank", F.col("line").alias("record"))

    several = others.where("inside or open_out")
    pieces = several.groupBy(*_SPLIT, "_begun").agg(
        _joined_lines(F.collect_list(F.struct("_at", "line"))).alias("line"), F.min(F.when(~F.col("inside"), F.col("_rank"))).alias("_rank"), F.bool_or("is_header").alias("is_header"))
    pieces = stage(pieces, "record-pieces")
    begun = pieces.groupBy(*_SPLIT).agg(F.max("_begun").alias("begun"))
    earlier = first.rowsBetween(Window.unboundedPreceding, -1)
    owners = begun.withColumn("owner", F.last(F.when(F.col("begun").isNotNull(), F.struct(F.col("_split").alias("s"), F.col("begun").alias("b"))), ignorenulls=True).over(earlier))
    owned = pieces.join(owners.select(*_SPLIT, "owner"), _SPLIT, "left")
    own = F.when(F.col("_begun").isNull(), F.col("owner")).otherwise(F.struct(F.col("_split").alias("s"), F.col("_begun").alias("b")))
    whole = owned.select("_file", own.alias("own"), F.struct("_split", "line").alias("piece"), "_rank", "is_header").groupBy("_file", "own").agg(
        _joined_lines(F.collect_list("piece")).alias("record"), F.min("_rank").alias("_rank"), F.bool_or("is_header").alias("is_header"))
    joined = whole.where("not is_header").select("_file", F.col("own.s").alias("_split"), "_rank", "record")
    records = direct.union(single).union(joined)
    return records.withColumn("record", F.when(F.endswith("record", F.lit("\r")), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record")))


def number_records(records: DataFrame, start: int = 2) -> DataFrame:
    """``_row_number``: the place of a record in its file plus ``start``, from one row (split, records) a split."""
    sizes = records.groupBy(*_SPLIT).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    bases = stage(sizes.select(*_SPLIT, (F.coalesce(F.sum("n").over(earlier), F.lit(0)) + start).alias("_base")), "record-bases")
    return records.join(bases, _SPLIT, "left").withColumn("_row_number", (F.col("_base") + F.col("_rank")).cast("long")).drop(*_SPLIT, "_rank", "_base")
