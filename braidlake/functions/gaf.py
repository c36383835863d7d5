"""Alignment records: text lines to columns and back, validation, predicates and sort keys, without Python functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidlake.functions import cs
from braidlake.schema import flip, flipped_path, walk_text

FIELD = "array<struct<tag:string,type:string,value:string>>"
MISSING_MAPQ = 255
KNOWN = ("AS", "bq", "cs", "pd", "fn", "fp")
PATH = r"^([<>][0-9]+)+$"


def number(x: Column) -> Column:
    """A non-negative number; `*` is 0, null if it is neither."""
    return F.when(x == "*", F.lit(0).cast("long")).when(F.rlike(x, F.lit("^[0-9]+$")), x.try_cast("long"))


def parse_path(x: Column) -> Column:
    """An array of handles; `*` is empty, null if malformed."""
    tokens = F.regexp_extract_all(x, F.lit("[<>][0-9]+"), F.lit(0))
    handles = F.transform(tokens, lambda t: F.substr(t, F.lit(2)).try_cast("long") * 2 + F.when(F.substring(t, 1, 1) == "<", 1).otherwise(0))
    return F.when(x == "*", F.array().cast("array<bigint>")).when(F.rlike(x, F.lit(PATH)), handles)


def typed_field_is_valid(x: Column) -> Column:
    """TAG:TYPE:VALUE with a type of A, Z, i, f or b and a value of that type."""
    shape = (F.length(x) >= 5) & (F.substring(x, 3, 1) == ":") & (F.substring(x, 5, 1) == ":")
    kind, value = F.substring(x, 4, 1), F.substr(x, F.lit(6))
    good = F.when(kind == "A", F.length(value) == 1).when(kind == "Z", F.lit(True)).when(kind == "b", value.isin("0", "1"))
    good = good.when(kind == "i", F.rlike(value, F.lit("^[+-]?[0-9]+$")) & value.try_cast("long").isNotNull())
    good = good.when(kind == "f", F.rlike(value, F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")))
    return shape & F.coalesce(good, F.lit(False))


def typed_field(x: Column) -> Column:
    return F.struct(F.substring(x, 1, 2).alias("tag"), F.substring(x, 4, 1).alias("type"), F.substr(x, F.lit(6)).alias("value"))


def _value(tag: str) -> Column:
    return F.try_element_at(F.filter(F.col("fields"), lambda f: f["tag"] == tag), F.lit(1))["value"]


def evaluated(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row: no filter or projection above can pull their expressions up or repeat them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Columns of records in lines (aln_id, value, …); error is null for a good record and says what is wrong otherwise.

    Header lines must be taken out before. Records with strand `-` come out on the flipped path.
    """
    get = lambda i: F.get(F.col("part"), F.lit(i))
    df = evaluated(lines, part=F.split(F.regexp_replace("value", "\n$", ""), "\t", -1)).drop("value")
    raw = F.when(F.size("part") > 12, F.slice("part", 13, F.greatest(F.size("part") - 12, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    df = evaluated(df, raw=raw)
    count = lambda tag: F.size(F.filter(F.col("fields"), lambda f: f["tag"] == tag))
    twice = (count("AS") > 1) | (count("bq") > 1) | (count("cs") > 1) | (count("pd") > 1) | (count("fn") + count("fp") > 1)
    df = evaluated(df, fields=F.transform("raw", typed_field), bad_field=F.exists("raw", lambda x: ~typed_field_is_valid(x))).drop("raw")
    df = evaluated(df, cs=F.coalesce(_value("cs"), F.lit("")), twice=twice, path0=parse_path(get(5)), **{f"n{i}": number(get(i)) for i in (1, 2, 3, 6, 7, 8, 9, 10, 11)})
    df = evaluated(df, ops=cs.parse(F.col("cs")), good=cs.is_valid(F.col("cs"))).drop("cs")
    df = evaluated(df, diff=F.when(F.col("good"), cs.normalize(F.col("ops")))).drop("ops", "good")
    n, has, diff = (lambda i: F.col(f"n{i}")), F.coalesce(F.size("diff") > 0, F.lit(False)), F.col("diff")
    error = (
        F.when(F.size("part") < 12, F.lit("too few fields"))
        .when(n(1).isNull() | n(2).isNull() | n(3).isNull(), "bad query interval")
        .when(~get(4).isin("+", "-", "*"), "bad strand").when(F.col("path0").isNull(), "bad path").when(n(6).isNull(), "bad path length")
        .when((n(7).isNull() | n(8).isNull()) & ~has, "bad target interval")
        .when(n(9).isNull() | n(10).isNull() | n(11).isNull(), "bad number")
        .when(F.col("bad_field"), "bad optional field").when(F.col("twice"), "duplicate field").when(diff.isNull(), "bad difference string")
    )
    start0 = F.coalesce(n(7), F.lit(0).cast("long"))
    back = get(4) == "-"
    path = F.when(back, flipped_path(F.col("path0"))).otherwise(F.col("path0"))
    df = evaluated(df, error=error, start0=start0, end0=F.coalesce(n(8), start0), back=back, path=path)
    back, path_len = F.col("back"), F.col("n6")
    start = F.when(back, F.greatest(path_len - F.col("end0"), F.lit(0))).otherwise(F.col("start0"))
    end = F.when(back, F.greatest(path_len - F.col("start0"), F.lit(0))).otherwise(F.col("end0"))
    mapq = n(11)
    rest = F.filter(F.col("fields"), lambda f: ~f["tag"].isin(*KNOWN))
    keep = [F.col(c) for c in lines.columns if c != "value"]
    return df.select(
        *keep, "error", get(0).alias("name"), n(1).alias("seq_len"), n(2).alias("seq_start"),
        F.when(has, n(2) + cs.query_len(diff)).otherwise(n(3)).alias("seq_end"), "path", path_len.alias("path_len"), start.alias("path_start"),
        F.when(has, start + cs.target_len(diff)).otherwise(end).alias("path_end"),
        F.when(has, cs.matches(diff)).otherwise(n(9)).alias("matches"),
        F.when(has, cs.edits(diff)).otherwise(F.greatest(n(10) - n(9), F.lit(0))).alias("edits"),
        F.when(mapq != MISSING_MAPQ, mapq).alias("mapq"), _value("AS").try_cast("long").alias("score"), F.coalesce(_value("bq"), F.lit("")).alias("base_quality"),
        "diff", F.coalesce(_value("fn"), _value("fp")).alias("pair_name"),
        F.when(_value("fn").isNotNull(), True).when(_value("fp").isNotNull(), False).alias("pair_is_next"),
        F.when(F.coalesce(_value("fn"), _value("fp")).isNotNull(), F.coalesce(_value("pd") == "1", F.lit(False))).alias("pair_is_proper"),
        rest.alias("optional"), F.array_min("path").alias("min_handle"), F.array_max("path").alias("max_handle"),
    )


def to_line(target: Column | None = None) -> Column:
    """The text line of a record; target is the sequence of its whole path, needed if it has a difference string."""
    c = F.col
    text = lambda x: x.cast("string")
    field = lambda head, value: F.when(value.isNotNull(), F.concat(F.lit(f"\t{head}:"), value)).otherwise("")
    aligned = F.substr(target, (c("path_start") + 1).cast("int"), (c("path_end") - c("path_start")).cast("int")) if target is not None else F.lit("")
    difference = F.when(F.size("diff") > 0, cs.to_text(c("diff"), aligned))
    quality = F.when(F.length("base_quality") > 0, c("base_quality"))
    pair = F.when(c("pair_name").isNull(), "").otherwise(
        F.concat(F.when(c("pair_is_next"), "\tfn:Z:").otherwise("\tfp:Z:"), c("pair_name"), F.lit("\tpd:b:"), F.when(c("pair_is_proper"), "1").otherwise("0")))
    rest = F.array_join(F.transform("optional", lambda f: F.concat(F.lit("\t"), f["tag"], F.lit(":"), f["type"], F.lit(":"), f["value"])), "")
    main = F.concat_ws(
        "\t", "name", text(c("seq_len")), text(c("seq_start")), text(c("seq_end")), F.lit("+"), F.when(F.size("path") == 0, "*").otherwise(walk_text(c("path"))),
        text(c("path_len")), text(c("path_start")), text(c("path_end")), text(c("matches")), text(c("matches") + c("edits")), text(F.coalesce("mapq", F.lit(MISSING_MAPQ))))
    return F.concat(main, field("AS:i", text(c("score"))), field("bq:Z", quality), field("cs:Z", difference), pair, rest)


def validation_error() -> Column:
    """Null for a consistent record."""
    c, diff = F.col, F.col("diff")
    has = F.size("diff") > 0
    return (
        F.when((c("seq_start") > c("seq_end")) | (c("seq_end") > c("seq_len")), "query interval")
        .when((c("path_start") > c("path_end")) | (c("path_end") > c("path_len")), "target interval")
        .when((F.size("path") == 0) & (c("path_len") > 0), "empty path with a length")
        .when(has & (cs.query_len(diff) != c("seq_end") - c("seq_start")), "query length")
        .when(has & (cs.target_len(diff) != c("path_end") - c("path_start")), "target length")
        .when(has & (cs.matches(diff) != c("matches")), "matches").when(has & (cs.edits(diff) != c("edits")), "edits")
    )


def is_unaligned() -> Column:
    return (F.col("seq_start") == F.col("seq_end")) | (F.col("path_start") == F.col("path_end"))


def is_full() -> Column:
    return (F.col("seq_start") == 0) & (F.col("seq_end") == F.col("seq_len"))


def is_exact() -> Column:
    return (F.col("seq_end") > F.col("seq_start")) & (F.col("edits") == 0)


def sort_key(value: Column) -> Column:
    """(nothing to sort by, min handle, max handle) of a line; malformed lines and `*` come last."""
    handles = parse_path(F.get(F.split(value, "\t", -1), F.lit(5)))
    lo, hi = F.array_min(handles), F.array_max(handles)
    return F.struct(lo.isNull().alias("none"), lo.alias("lo"), hi.alias("hi"))
